"""Retrieval over graphs and passages: hops, chains, fusion, rank propagation, dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..common import cut_lineage, top_k
from ..functions import constants as K
from ..functions.answers import clean_link
from ..functions.text import norm_text, tokenize
from . import bm25, iterate, walk
from .graph import adjacency, degrees

NODE = ["graph_id", "node_id"]
ASK = ["graph_id", "qid"]


def node_docs(nodes: DataFrame, edges: DataFrame, neighbors: int = 8) -> DataFrame:
    """Node text with its first neighbours' names, relation types and evidence."""
    first = top_k(adjacency(edges), NODE, [F.col("edge_id"), F.col("neighbor")], neighbors)
    names = nodes.select("graph_id", F.col("node_id").alias("neighbor"), F.col("name").alias("other"))
    said = first.join(names, ["graph_id", "neighbor"], "left").withColumn("piece", F.concat_ws(" ", "other", "type", "evidence"))
    context = said.groupBy(*NODE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda s: s["piece"]), " ").alias("context")
    )
    text = F.concat_ws(" ", "name", "alias", "description", "context")
    return nodes.join(context, NODE, "left").select(*NODE, text.alias("text"))


def graph_docs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Index documents for nodes and edges; central ones carry a priority tag."""
    tag = lambda c: F.when(F.coalesce(c, F.lit(3)) >= 4, "DECISIVE CENTRAL").otherwise("")
    n = nodes.select(
        "graph_id", F.col("node_id").alias("item"),
        F.concat(F.lit("ENTITY "), "name", F.lit("; TYPE "), "type", F.lit("; ALIASES "), "alias", F.lit("; DESCRIPTION "), "description",
                 F.lit("; PRIORITY "), tag(F.col("salience"))).alias("text"),
    )
    names = nodes.select("graph_id", "node_id", "name")
    s = names.select("graph_id", F.col("node_id").alias("src"), F.col("name").alias("s_name"))
    t = names.select("graph_id", F.col("node_id").alias("dst"), F.col("name").alias("t_name"))
    e = edges.join(s, ["graph_id", "src"], "left").join(t, ["graph_id", "dst"], "left").select(
        "graph_id", F.col("edge_id").alias("item"),
        F.concat(F.lit("GRAPH FACT "), F.coalesce("s_name", F.lit("")), F.lit("; RELATION "), "type", F.lit("; "), F.coalesce("t_name", F.lit("")),
                 F.lit("; PRIORITY "), tag(F.col("importance")), F.lit("; DECOY "), F.col("decoy").cast("string"),
                 F.lit("; GROUNDED EVIDENCE "), "evidence").alias("text"),
    )
    return n.unionByName(e)


def best_links(edges: DataFrame, weight: Column, k: int) -> DataFrame:
    """The ``k`` best neighbours of every node by their strongest edge, ties by id: (graph_id, node_id, neighbor, w)."""
    adj = adjacency(edges.withColumn("w", weight).select("graph_id", "src", "dst", "w")).repartition(*NODE)
    once = adj.groupBy(*NODE, "neighbor").agg(F.max("w").alias("w"))
    return top_k(once, NODE, [F.desc("w"), F.col("neighbor")], k).drop("rank")


def next_hop(seen: DataFrame, frontier: DataFrame, links: DataFrame, k: int, hop: int) -> DataFrame:
    """Best unseen neighbours of a frontier by their strongest edge; ties by node id."""
    near = frontier.select(*ASK, "node_id").join(links, NODE).groupBy(*ASK, F.col("neighbor").alias("node_id")).agg(F.max("w").alias("score"))
    fresh = near.join(seen.select(*ASK, "node_id"), [*ASK, "node_id"], "left_anti")
    return top_k(fresh, ASK, [F.desc("score"), F.col("node_id")], k).withColumn("hop", F.lit(hop))


def k_hop(first: DataFrame, edges: DataFrame, sizes: list[int], weight: Column | None = None) -> DataFrame:
    """First-order nodes plus one hop per entry of ``sizes``: (graph_id, qid, node_id, hop, rank, score).

    A neighbour among the best k of a hop has fewer than k unseen ones before it in the list of the node that gives
    it its score, besides those already seen. So as many of each node's best neighbours as a question can
    take and have seen are enough for every hop, and a hub's other edges meet no question.
    """
    weight = F.coalesce("confidence", F.lit(0.0)) if weight is None else weight
    cols = [*ASK, "node_id", "hop", "rank", "score"]
    seen = first.withColumn("hop", F.lit(1)).select(*cols)
    frontier = seen
    most = seen.groupBy(*ASK).count().agg(F.max("count")).first()[0] or 0
    links = cut_lineage(best_links(edges, weight, most + sum(sizes)))
    for i, k in enumerate(sizes):
        frontier = cut_lineage(next_hop(seen, frontier, links, k, i + 2).select(*cols))  # few rows; later hops read them again
        seen = seen.unionByName(frontier)
    return seen


def planned_weight() -> Column:
    return (
        F.coalesce("confidence", F.lit(0.0)) * F.when(F.col("decoy"), 0.4).otherwise(1.0)
        * F.greatest(F.coalesce("importance", F.lit(3)), F.lit(1)) / 3.0
    )


def clue_chains(hops: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """Strongest links from each first-order node to second-order nodes (or itself)."""
    first = hops.filter("hop = 1").select(*ASK, "node_id")
    second = hops.filter("hop = 2").select(*ASK, F.col("node_id").alias("neighbor"), F.lit(True).alias("second"))
    links = first.join(adjacency(edges), NODE).join(second, [*ASK, "neighbor"], "left")
    near = links.filter("second or neighbor = node_id").drop("second")
    return top_k(near, [*ASK, "node_id"], [F.desc("confidence"), F.col("edge_id"), F.col("neighbor")], k)


def induced(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the graph with both ends among a query's nodes.

    Each edge meets the queries of its end of fewer edges, so a hub's edges are not copied once per query that holds it.
    """
    got = hops.select(*ASK, "node_id").distinct()
    degree = degrees(edges)
    of = lambda end, n: degree.select("graph_id", F.col("node_id").alias(end), F.col("degree").alias(n))
    sized = edges.join(of("src", "_s"), ["graph_id", "src"]).join(of("dst", "_d"), ["graph_id", "dst"])
    low = F.col("_s") <= F.col("_d")
    sized = sized.withColumn("_near", F.when(low, F.col("src")).otherwise(F.col("dst"))).withColumn("_far", F.when(low, F.col("dst")).otherwise(F.col("src")))
    near = sized.drop("_s", "_d").join(got.withColumnRenamed("node_id", "_near"), ["graph_id", "_near"])
    return near.join(got.withColumnRenamed("node_id", "_far"), [*ASK, "_far"], "left_semi").drop("_near", "_far")


def planned_top(nodes: DataFrame, scores: DataFrame, weights: dict[str, float], targets: DataFrame, k: int) -> DataFrame:
    """Best ``k`` nodes per question by planned score: the weighted sum of per-part scores, +3 per named target, times the type boost, plus a salience bonus.

    ``scores``: (graph_id, qid, label, node_id, score); ``targets``: (graph_id, qid, name). Candidates are the
    text hits, the named nodes and, per graph, the ``k`` nodes of largest bonus. The bonus hangs on the node
    alone and the other part is never negative: a node that is none of these has ``k`` nodes before it.
    """
    w = F.lit(0.0)
    for label, value in weights.items():
        w = F.when(F.col("label") == label, value).otherwise(w)
    boost = F.lit(1.0)
    for kind, value in K.TYPE_BOOST.items():
        boost = F.when(F.col("type") == kind, value).otherwise(boost)
    valued = nodes.select(*NODE, "name", boost.alias("boost"), (0.4 * F.greatest(F.coalesce("salience", F.lit(3)) - 1, F.lit(0))).alias("bonus"))
    plain = valued.select(*NODE, "bonus")
    heads = top_k(plain, ["graph_id"], [F.desc("bonus"), F.col("node_id")], k)
    asked = scores.select(*ASK).unionByName(targets.select(*ASK)).distinct()
    by_bonus = asked.join(heads, "graph_id").select(*ASK, "node_id", F.lit(0.0).alias("part"))
    by_name = targets.join(valued, ["graph_id", "name"]).select(*ASK, "node_id", F.lit(3.0).alias("part"))
    by_text = scores.select(*ASK, "node_id", (F.col("score") * w).alias("part"))
    found = by_text.unionByName(by_name).unionByName(by_bonus).groupBy(*ASK, "node_id").agg(F.sum("part").alias("part"))
    total = found.join(valued.select(*NODE, "boost", "bonus"), NODE).select(*ASK, "node_id", (F.col("part") * F.col("boost") + F.col("bonus")).alias("score"))
    return top_k(total.withColumn("score", F.round("score", 9)).filter("score > 0"), ASK, [F.desc("score"), F.col("node_id")], k)


#: Terms of the rows that stand for a node's bonus and its name among its text terms, which hold no such signs.
BONUS, NAMED = " bonus", "= "


def planned_best(nodes: DataFrame, units: DataFrame, parts: DataFrame, weights: dict[str, float], targets: DataFrame, k: int) -> DataFrame:
    """The rows of ``planned_top`` over the text scores of ``parts`` (scope, qid, label, query), without a row per question and node.

    A planned score is a sum over terms: a text term's weight times the node's boost, taken as often as the parts that
    hold it weigh; the boost three times for a named node; and the bonus. So it is ranked by ``bm25.best_units``.
    """
    boost = F.lit(1.0)
    for kind, value in K.TYPE_BOOST.items():
        boost = F.when(F.col("type") == kind, value).otherwise(boost)
    valued = nodes.select(*NODE, "name", boost.alias("boost"), (0.4 * F.greatest(F.coalesce("salience", F.lit(3)) - 1, F.lit(0))).alias("bonus"))
    text = bm25.text_weights(units, bm25.text_vocabulary(parts)).withColumnsRenamed({"scope": "graph_id", "unit": "node_id"})
    text = text.join(valued.select(*NODE, "boost"), NODE).select("graph_id", "term", "node_id", (F.col("weight") * F.col("boost")).alias("weight"))
    name = F.concat(F.lit(NAMED), "name").alias("term")
    asked_names = targets.select("graph_id", name).distinct()
    named = valued.select("graph_id", name, "node_id", F.col("boost").alias("weight")).join(asked_names, ["graph_id", "term"], "left_semi")
    extra = valued.filter("bonus > 0").select("graph_id", F.lit(BONUS).alias("term"), "node_id", F.col("bonus").alias("weight"))
    postings = cut_lineage(text.unionByName(named).unionByName(extra).withColumnsRenamed({"graph_id": "scope", "node_id": "unit"}))
    w = F.lit(0.0)
    for label, value in weights.items():
        w = F.when(F.col("label") == label, value).otherwise(w)
    terms = parts.select("scope", "qid", F.explode(F.array_distinct(tokenize("query"))).alias("term"), w.alias("w"))
    one = lambda term, value: targets.select(F.col("graph_id").alias("scope"), "qid", term.alias("term"), F.lit(value).alias("w"))
    terms = terms.unionByName(one(F.concat(F.lit(NAMED), "name"), 3.0)).unionByName(one(F.lit(BONUS), 1.0).distinct())
    packed = terms.groupBy("scope", "qid", "term").agg(F.sum("w").alias("w")).groupBy("scope", "qid").agg(F.collect_list(F.struct("term", "w")).alias("p"))
    asked = packed.select("scope", "qid", F.lit("plan").alias("label"), F.col("p.term").alias("terms"), F.col("p.w").alias("factors"))
    best = bm25.best_units(postings, asked, k)
    return best.select(F.col("scope").alias("graph_id"), "qid", F.col("unit").alias("node_id"), "score", "rank")


def glossary(nodes: DataFrame, degree: DataFrame, cap: int = 60) -> DataFrame:
    """Nodes of highest salience plus degree."""
    rows = nodes.join(degree, NODE, "left").withColumn("weight", F.col("salience") + F.coalesce("degree", F.lit(0)))
    return top_k(rows, ["graph_id"], [F.desc("weight"), F.col("node_id")], cap)


# -- fusion ----------------------------------------------------------------------------
def fused(lists: DataFrame, keys: list[str], weights: dict[str, float], k: int, unit: str = "unit", absent: int = 10**6) -> DataFrame:
    """Weighted reciprocal-rank fusion of named lists with 0-based ``rank0``; a missing rank counts as ``absent``."""
    present = lists.groupBy(*keys, unit).agg(*[F.min(F.when(F.col("list") == n, F.col("rank0"))).alias(f"r_{n}") for n in weights])
    score = sum((F.lit(w) / (k + F.coalesce(f"r_{n}", F.lit(absent))) for n, w in weights.items()), F.lit(0.0))
    return present.select(*keys, unit, score.alias("score"))


def option_fusion(chunk_lists: DataFrame, node_lists: DataFrame, node_chunks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per-option rank fusion: chunks at 60+rank, nodes at 60+rank, node evidence chunks at 65+rank."""
    part = lambda base: F.lit(1.0) / (base + F.col("rank0"))
    own = chunk_lists.select(*keys, "unit", part(60).alias("p"))
    through = node_lists.join(node_chunks, "node").select(*keys, "unit", part(65).alias("p"))
    chunks = own.unionByName(through).groupBy(*keys, "unit").agg(F.sum("p").alias("score"))
    nodes = node_lists.select(*keys, "node", part(60).alias("p")).groupBy(*keys, "node").agg(F.sum("p").alias("score"))
    return chunks, nodes


def combined_lexical(scores: DataFrame, keys: list[str], question: float = 0.65, option: float = 0.55) -> DataFrame:
    """Best of the weighted question score and the weighted option scores (all max-normalised)."""
    w = F.when(F.col("label") == "Q", question).otherwise(option)
    return scores.groupBy(*keys, "unit").agg(F.max(F.col("score") * w).alias("score"))


# -- graph mass --------------------------------------------------------------------------
def relation_weight(high: float, low: float, other: float = 1.0) -> Column:
    t = F.col("type")
    return F.when(t.isin(K.HIGH_VALUE_RELATIONS), high).when(t.isin(K.LOW_VALUE_RELATIONS), low).otherwise(other)


def transition_weight(default_confidence: float = 0.6) -> Column:
    conf = F.greatest(F.lit(0.05), F.coalesce("confidence", F.lit(default_confidence)))
    return conf * relation_weight(1.45, 0.35) * F.when(F.coalesce("evidence", F.lit("")) != "", 1.15).otherwise(1.0)


def rank_seeds(asked: DataFrame, scores: DataFrame, mentions: DataFrame, nodes: DataFrame, question: float = 0.45, option: float = 0.30) -> DataFrame:
    """Restart weights per query: best weighted text score plus 1 per named node, summing to one.

    A query that touches nothing restarts at every node of its graph alike.
    """
    w = F.when(F.col("label") == "Q", question).otherwise(option)
    text = scores.groupBy(*ASK, "node_id").agg(F.max(F.col("score") * w).alias("s"))
    named = mentions.select(*ASK, "node_id", F.lit(1.0).alias("s"))
    raw = text.unionByName(named).groupBy(*ASK, "node_id").agg(F.sum("s").alias("s"))
    total = raw.groupBy(*ASK).agg(F.sum("s").alias("t")).filter("t > 0")
    blank = asked.join(total, ASK, "left_anti").join(nodes.select(*NODE), "graph_id")
    size = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    even = blank.join(size, "graph_id").select(*ASK, "node_id", (F.lit(1.0) / F.col("n")).alias("seed"))
    return raw.join(total, ASK).select(*ASK, "node_id", (F.col("s") / F.col("t")).alias("seed")).unionByName(even)


def graph_ranks(
    nodes: DataFrame, edges: DataFrame, units: DataFrame, asks: DataFrame, mentions: DataFrame, alpha: float = K.RANK_ALPHA, iterations: int = K.RANK_ITERATIONS,
    graph_rows: int = walk.GRAPH_ROWS, question: float = 0.45, option: float = 0.30,
) -> DataFrame:
    """Query-personalised rank of every node: (graph_id, qid, node_id, rank).

    ``units`` (scope = graph, unit = node, text) and ``asks`` (scope, qid, label, query) give the text scores,
    ``mentions`` the named nodes. Graphs that fit a task are walked in blocks; others as tables.
    """
    index = bm25.build_index(units, bm25.text_vocabulary(asks))
    postings = cut_lineage(bm25.weighted(index).withColumnsRenamed({"scope": "graph_id", "unit": "node_id"}))
    edges = edges.select("graph_id", "src", "dst", transition_weight().alias("weight"))
    asked = asks.withColumnRenamed("scope", "graph_id")
    sizes = cut_lineage(walk.fitting(nodes, edges, postings, graph_rows))
    weight = F.when(F.col("label") == "Q", question).otherwise(option)
    small = walk.question_ranks(sizes, nodes, edges, postings, asked, mentions, weight, alpha, iterations)
    large = sizes.filter("NOT fits").select("graph_id")
    if large.isEmpty():
        return small
    of = lambda df: df.join(large, "graph_id", "left_semi")
    terms = bm25.query_terms(of(asked).withColumnRenamed("graph_id", "scope")).withColumnRenamed("scope", "graph_id")
    scores = of(postings).join(terms, ["graph_id", "term"]).groupBy("graph_id", "qid", "label", "node_id").agg(F.sum("weight").alias("score"))
    scores = cut_lineage(scores).withColumnRenamed("graph_id", "scope")
    scores = bm25.normalized(scores).withColumnRenamed("scope", "graph_id")
    seeds = rank_seeds(of(asked).select(*ASK).distinct(), scores, of(mentions), of(nodes), question, option)
    inside = of(edges).join(nodes.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi")
    inside = inside.join(nodes.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_semi")
    return small.unionByName(iterate.personalized_rank(inside, seeds, ["graph_id"], alpha, iterations).select("graph_id", "qid", "node_id", "rank"))


def edge_mass(weights: Column, default_confidence: float) -> Column:
    conf = F.coalesce("confidence", F.lit(default_confidence))
    return weights * conf * (F.col("src_rank") + F.col("dst_rank"))


def chunk_mass(edge_rows: DataFrame, node_rows: DataFrame | None, keys: list[str]) -> DataFrame:
    """Mass of edges (and nodes) summed onto their evidence chunks."""
    rows = edge_rows.select(*keys, "chunk_idx", "mass")
    if node_rows is not None:
        rows = rows.unionByName(node_rows.select(*keys, "chunk_idx", F.col("rank").alias("mass")))
    return rows.groupBy(*keys, "chunk_idx").agg(F.sum("mass").alias("mass"))


def passage_scores(lexical: DataFrame, mass: DataFrame, keys: list[str], text: float = 0.48, graph: float = 0.52) -> DataFrame:
    """Blend of text score and graph mass over its question's largest: (keys, chunk_idx, lexical, graph, score)."""
    most = mass.groupBy(*keys).agg(F.max("mass").alias("most")).filter("most > 0")
    share = mass.join(most, keys).select(*keys, "chunk_idx", (F.col("mass") / F.col("most")).alias("graph"))
    both = lexical.select(*keys, "chunk_idx", F.col("score").alias("lexical")).join(share, [*keys, "chunk_idx"], "full").na.fill(0.0, ["lexical", "graph"])
    return both.withColumn("score", text * F.col("lexical") + graph * F.col("graph"))


def link_overlay(edge_rows: DataFrame, selected: DataFrame, keys: list[str], cap: int = 6) -> DataFrame:
    """Heaviest high-value edges inside the selected chunks, each edge once."""
    rows = edge_rows.filter(F.col("type").isin(K.HIGH_VALUE_RELATIONS) & (norm_text("src_name") != norm_text("dst_name")) & (F.trim("src_name") != "") & (F.trim("dst_name") != ""))
    rows = rows.join(selected, [*keys, "chunk_idx"], "left_semi")
    once = rows.groupBy(*keys, "edge").agg(F.max(F.struct("mass", "chunk_idx", "type", "src_name", "dst_name")).alias("best")).select(*keys, "edge", "best.*")
    return top_k(once, keys, [F.desc(F.round("mass", 9)), F.desc("edge")], cap)


def best_two(rows: DataFrame, keys: list[str], bonus: float = 0.15) -> DataFrame:
    """Chunk score = best document score + a share of the second best."""
    two = top_k(rows, [*keys, "chunk"], [F.desc("score"), F.col("doc")], 2)
    return two.groupBy(*keys, "chunk").agg(F.sum(F.col("score") * F.when(F.col("rank") == 1, 1.0).otherwise(bonus)).alias("score"))


# -- packets -----------------------------------------------------------------------------
def dossier(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per-option packets merged by chunk: which options want it, best rank, best score."""
    return rows.groupBy(*keys, "unit").agg(
        F.array_join(F.array_sort(F.collect_set("letter")), ",").alias("for_options"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score")
    )


def signed_links(links: DataFrame, keys: list[str], cap: int = 6) -> DataFrame:
    """Clean, distinct links of the dossier, best first. Links carry letter, source, relation, target, unit, evidence, passage, score."""
    ok = links.filter(clean_link("source", "target", "relation", "evidence", "passage"))
    once = ok.groupBy(*keys, "letter", "source", "relation", "target", "unit").agg(F.max("score").alias("score"))
    return top_k(once, keys, [F.desc("score"), F.col("letter"), F.col("source"), F.col("target"), F.col("relation"), F.col("unit")], cap)


def option_margin(links: DataFrame, keys: list[str]) -> DataFrame:
    """Link mass of the leading option minus the runner-up's."""
    mass = links.groupBy(*keys, "letter").agg(F.sum("score").alias("mass"))
    tops = F.sort_array(F.collect_list("mass"), asc=False)
    per = mass.groupBy(*keys).agg(tops.alias("m"))
    return per.select(*keys, (F.get("m", F.lit(0)) - F.coalesce(F.get("m", F.lit(1)), F.lit(0.0))).alias("margin"))


def frontier(visited: DataFrame, edges: DataFrame, nodes: DataFrame, per_node: int = 10, cap: int = 28) -> DataFrame:
    """Unvisited neighbours of visited nodes, distinct by name."""
    links = adjacency(edges).join(visited.select(*NODE, "ord"), NODE)
    near = top_k(links, NODE, [F.col("edge_id"), F.col("neighbor")], per_node).drop("rank")
    fresh = near.join(visited.select("graph_id", F.col("node_id").alias("neighbor")), ["graph_id", "neighbor"], "left_anti")
    named = fresh.join(nodes.select("graph_id", F.col("node_id").alias("neighbor"), "name"), ["graph_id", "neighbor"])
    first = named.groupBy("graph_id", "name").agg(F.min(F.struct("ord", "edge_id")).alias("at"), F.min_by("type", F.struct("ord", "edge_id")).alias("via"))
    return top_k(first, ["graph_id"], [F.col("at"), F.col("name")], cap).select("graph_id", "name", "via", "rank")


def with_provenance(lists: DataFrame, keys: list[str], unit: str = "unit") -> DataFrame:
    """Union of retrievals; each unit names the lists it came from."""
    return lists.groupBy(*keys, unit).agg(F.array_join(F.array_sort(F.collect_set("list")), "+").alias("sources"))


def first_paragraphs(hits: DataFrame, keys: list[str], cap: int = 6) -> DataFrame:
    """Distinct paragraphs in the order of the nodes that led to them."""
    first = hits.groupBy(*keys, "para").agg(F.min("ord").alias("ord"))
    return top_k(first, keys, [F.col("ord"), F.col("para")], cap)


def entity_chunks(named: DataFrame, lexical: DataFrame, keys: list[str], want: int, cap: int) -> DataFrame:
    """Chunks naming the entities in text order; lexical ranks fill up when fewer than ``want`` do."""
    lead = top_k(named.select(*keys, "unit").distinct(), keys, [F.col("unit")], cap)
    count = lead.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    more = lexical.join(lead.select(*keys, "unit"), [*keys, "unit"], "left_anti").join(count, keys, "left")
    more = more.filter(F.coalesce("n", F.lit(0)) < want).select(*keys, "unit", (F.col("rank") + cap).alias("ord"), F.lit("lexical").alias("via"))
    rows = lead.select(*keys, "unit", F.col("rank").alias("ord"), F.lit("entity").alias("via")).unionByName(more)
    return top_k(rows, keys, [F.col("ord")], cap).select(*keys, "unit", "via", "rank")
