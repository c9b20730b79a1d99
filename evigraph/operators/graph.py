"""Build, clean, merge, mask and measure evidence graphs.

Relations: nodes(graph_id, node_id, name, type, ...), edges(graph_id, edge_id, src, dst, type,
evidence, confidence, decoy, importance). Work is keyed by (graph, node) or (graph, edge), so a
graph that holds a large share of all rows still spreads over the cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from ..common import cut_lineage, discard, first_per_key, prefix_scan, scratch_path, top_k
from ..functions import constants as K
from ..functions.answers import is_generic_name
from ..functions.text import canonical_name, norm_text, word_regex
from .ground import contained_pairs, held_texts
from .iterate import components

GID = ["graph_id"]


# -- names and endpoints -------------------------------------------------------------
def all_names(nodes: DataFrame, *keep: str) -> DataFrame:
    """One row (keep, raw) per name of a node: its name, its ``alias`` and each of its ``aliases``, as far as it has them."""
    one = F.array(*[F.col(c) for c in ("name", "alias") if c in nodes.columns])
    every = F.concat(one, F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in nodes.columns else one
    return nodes.select(*keep, F.explode(every).alias("raw"))


def named_keys(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, key) of the rows whose ``raw`` name has a canonical form. A filter cannot pass the generator, so each name is cleaned once."""
    return rows.filter("raw <> ''").select(*keep, F.explode(F.array(canonical_name("raw"))).alias("key")).filter("key <> ''")


def name_index(nodes: DataFrame) -> DataFrame:
    """Canonical name or alias -> node; a shared key goes to the smallest node id."""
    keyed = named_keys(all_names(nodes, "graph_id", "node_id"), "graph_id", "node_id")
    return keyed.groupBy("graph_id", "key").agg(F.min("node_id").alias("node_id"))


def resolved_endpoints(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with both endpoint names mapped to nodes; a miss leaves a null."""
    index = name_index(nodes)
    out = relations.withColumn("s_key", canonical_name("source")).withColumn("t_key", canonical_name("target"))
    s = index.select("graph_id", F.col("key").alias("s_key"), F.col("node_id").alias("src"))
    t = index.select("graph_id", F.col("key").alias("t_key"), F.col("node_id").alias("dst"))
    return out.join(s, ["graph_id", "s_key"], "left").join(t, ["graph_id", "t_key"], "left").drop("s_key", "t_key")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one endpoint that is not a node."""
    ids = nodes.select("graph_id", "node_id", F.lit(1).alias("hit"))
    s = ids.select("graph_id", F.col("node_id").alias("src"), F.col("hit").alias("s_hit"))
    t = ids.select("graph_id", F.col("node_id").alias("dst"), F.col("hit").alias("t_hit"))
    return edges.join(s, ["graph_id", "src"], "left").join(t, ["graph_id", "dst"], "left").filter("s_hit is null or t_hit is null")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("graph_id", "node_id")
    out = edges.join(ids.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi")
    return out.join(ids.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi")


induced_subgraph = valid_edges


#: Graphs whose least values are sent to every task.
FEW_GRAPHS = 200_000


def _not_below(edges: DataFrame, by: str, k: int) -> DataFrame:
    """Edges whose value is not below that of the ``k``-th largest of their graph, found from counts of values; nulls come last."""
    counts = edges.groupBy("graph_id", by).agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("graph_id").orderBy(F.desc(by)).rowsBetween(W.unboundedPreceding, -1)
    wanted = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).filter(F.col("before") < k)
    least = cut_lineage(wanted.groupBy("graph_id").agg(F.min(by).alias("_least"), F.bool_or(F.col(by).isNull()).alias("_all")))
    least = F.broadcast(least) if least.count() <= FEW_GRAPHS else least
    return edges.join(least, "graph_id").filter(F.col("_all") | (F.col(by) >= F.col("_least"))).drop("_least", "_all")


def top_valid_edges(edges: DataFrame, nodes: DataFrame, by: str, k: int) -> DataFrame:
    """The first ``k`` edges per graph, largest ``by`` first and then by id, whose ends are both nodes, ranked.

    Edges that cannot be among the first of their graph stay where they lie, and only the first look up their ends: twice
    ``k`` of them, and four times as many each round while some graph has more edges and fewer than ``k`` valid ones.
    """
    tried, order = 2 * k, [F.desc(by), F.col("edge_id")]
    while True:
        some = cut_lineage(top_k(_not_below(edges, by, tried), GID, order, tried, "_at"))
        best = cut_lineage(top_k(valid_edges(some.drop("_at"), nodes), GID, order, k))
        short = some.filter(F.col("_at") == tried).select("graph_id").join(best.filter(F.col("rank") == k).select("graph_id"), "graph_id", "left_anti")
        if short.isEmpty():
            return best
        discard(some)
        discard(best)
        tried *= 4


def referenced_nodes(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Nodes whose name or alias is an endpoint of some relation."""
    said = relations.select("graph_id", F.explode(F.array("source", "target")).alias("raw"))
    said = said.groupBy("graph_id", "raw").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")  # a plain distinct would be dropped for the one below
    used = named_keys(said, "graph_id").distinct()
    keys = named_keys(all_names(nodes, "graph_id", "node_id"), "graph_id", "node_id")
    hit = keys.join(used, ["graph_id", "key"], "left_semi").select("graph_id", "node_id").distinct()
    return nodes.join(hit, ["graph_id", "node_id"], "left_semi")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))


def without_ungrounded_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Drop nodes that touch no edge and were never mentioned."""
    lone = nodes.filter("mention_count = 0").join(endpoints(edges), ["graph_id", "node_id"], "left_anti")
    return nodes.join(lone.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.select(*rest, F.col("src").alias("node_id"), F.col("dst").alias("neighbor"))
    return out.unionByName(edges.select(*rest, F.col("dst").alias("node_id"), F.col("src").alias("neighbor")))


def name_mentions(nodes: DataFrame, texts: DataFrame, min_chars: int = 3) -> DataFrame:
    """Nodes whose name or alias occurs as whole words in a text of their graph.

    A name from its first to its last letter or digit is a run of whole words with what stands between
    them, so it equals a run of as many words of the text: an equi-join on runs of the lengths that the
    graph's names have. Texts stay behind; only those that meet a name with signs around it, or a name
    without letters and digits, are joined back for a look at the signs. Distinct names meet the texts; the nodes
    of a name join last, and what they add is written nowhere, as many nodes may share one.
    """
    held = all_names(nodes, "graph_id", "node_id").select("graph_id", "node_id", norm_text("raw").alias("nm")).filter(F.length("nm") >= min_chars)
    owners = held.groupBy("graph_id", "node_id").agg(F.sort_array(F.collect_set("nm")).alias("all"))
    core = F.regexp_replace("nm", "^[^a-z0-9]+|[^a-z0-9]+$", "")
    names = held.select("graph_id", "nm").distinct().withColumn("run", core).withColumn("words", F.size(F.regexp_extract_all("nm", F.lit("[a-z0-9]+"), F.lit(0))))
    lengths = names.filter("words > 0").groupBy("graph_id").agg(F.collect_set("words").alias("lengths"))
    body = texts.select("graph_id", "qid", norm_text("text").alias("body"))
    pieces = body.join(lengths, "graph_id").select("graph_id", "qid", "lengths", F.regexp_extract_all("body", F.lit("[a-z0-9]+|[^a-z0-9]+"), F.lit(0)).alias("p"))
    first = F.when(F.get("p", F.lit(0)).rlike("^[a-z0-9]"), 1).otherwise(2)
    span = lambda k: 2 * k - 1  # noqa: E731  # words and what stands between them
    at = lambda k: F.when(F.size("p") - span(k) + 1 >= first, F.sequence(first, F.size("p") - span(k) + 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform("lengths", lambda k: F.transform(at(k), lambda i: F.array_join(F.slice("p", i, span(k)), ""))))
    words = pieces.select("graph_id", "qid", F.explode(F.array_distinct(runs)).alias("run"))
    hits = names.filter("words > 0").join(words, ["graph_id", "run"])
    exact = F.concat(F.lit(r"(?<![a-z0-9])\Q"), "nm", F.lit(r"\E(?![a-z0-9])"))
    signs = hits.filter("nm <> run").select("graph_id", "qid", "nm").join(body, ["graph_id", "qid"]).filter(F.rlike("body", exact))
    bare = names.filter("words = 0").select("graph_id", "nm")
    odd = contained_pairs(bare, body, GID, "nm", "body").filter(F.rlike("body", exact))
    found = [df.select("graph_id", "qid", "nm") for df in (hits.filter("nm = run"), signs, odd)]
    said = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("graph_id", "qid").agg(F.collect_set("nm").alias("said"))
    said = said.select("graph_id", "qid", "said", F.explode("said").alias("nm"))
    # a node counts at the first of its names that is said, so its rows need no shuffle to be told apart
    named = owners.select("graph_id", "node_id", F.posexplode("all").alias("at", "nm"), "all").select("graph_id", "node_id", "nm", F.slice("all", F.lit(1), F.col("at")).alias("before"))
    return said.join(named, ["graph_id", "nm"]).filter(~F.arrays_overlap("before", "said")).select("graph_id", "qid", "node_id")


def find_nodes(lookups: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Up to ``k`` nodes per looked-up name: exact first, then either name inside the other.

    Of each text only the ``k`` smallest node ids that have it can count, so no more go on to the next join.
    """
    asked = lookups.select("graph_id", "lookup", norm_text("lookup").alias("want")).filter("want <> ''").distinct()
    want = asked.select("graph_id", "want").distinct()
    have = nodes.select("graph_id", "node_id", norm_text("name").alias("nm")).filter("nm <> ''")
    named = top_k(have.distinct(), ["graph_id", "nm"], [F.col("node_id")], k).drop("rank")
    exact = want.join(named.withColumnRenamed("nm", "want"), ["graph_id", "want"]).withColumn("tier", F.lit(0))
    outer = held_texts(want, have, GID, "want", "nm", ("node_id", k)).withColumn("tier", F.lit(1))
    inner = held_texts(named, want.withColumn("body", F.col("want")), GID, "nm", "body").join(named, ["graph_id", "nm"]).drop("nm").withColumn("tier", F.lit(1))
    hits = exact.unionByName(outer).unionByName(inner).groupBy("graph_id", "want", "node_id").agg(F.min("tier").alias("tier"))
    best = top_k(hits, ["graph_id", "want"], [F.col("tier"), F.col("node_id")], k)
    return asked.join(best, ["graph_id", "want"]).select("graph_id", "lookup", "node_id", "tier", "rank")


def near_duplicate_names(names: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of different names where one contains the other."""
    n = names.select(*keys, norm_text("name").alias("nm")).filter("nm <> ''").distinct()
    pairs = contained_pairs(n.withColumnRenamed("nm", "inner"), n.withColumnRenamed("nm", "outer"), keys, "inner", "outer")
    return pairs.filter("inner <> outer").distinct()


# -- merging records into a graph ------------------------------------------------------
def resolved_entities(records: DataFrame, keys: list[str], entity: str, mode: str = "linked") -> DataFrame:
    """One node per set of records that share names: (keys, entity, label), the label being the node's first record.

    ``records`` carry ``names`` (array, the name before its aliases) and their order in ``entity``. A node keeps
    the name of its first record. ``mode="linked"`` is order-free: records linked by any chain of shared names are
    one node. ``mode="first"`` reads records in order (``entity`` a whole number, once per key): a record joins the
    node that its first known name stands for at that moment, and all its names stand for that node from then on;
    a record whose own name is empty makes none.
    """
    if mode == "first":
        return _first_resolved(records, keys, entity)
    links = named_keys(records.select(*keys, entity, F.explode("names").alias("raw")), *keys, entity)
    return components(links, keys, entity, "key")


#: Stretch of record numbers that one window covers when earlier holders of a name are looked up.
RECORD_SPAN = 2**40


def _first_resolved(records: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Records in order, without a loop over them.

    A name always stands for the node of the last record that held it. So each record follows one earlier
    record, known beforehand: the last holder of its first name that has one. These steps form trees, whose roots
    start the nodes; pointers double their reach each round, so a chain of n records takes log2(n) rounds. A record
    is followed at most once per name, so no join key is hot at first, and pointers that reached a root stop joining.
    """
    known = records.filter(canonical_name(F.get("names", F.lit(0))) != "")
    names = known.select(*keys, F.col(entity).alias("rec"), F.posexplode("names").alias("pos", "raw"))
    names = named_keys(names, *keys, "rec", "pos")
    held = names.groupBy(*keys, "key", "rec").agg(F.min("pos").alias("pos")).withColumn("back", -F.col("rec"))
    held = held.withColumn("stretch", F.floor(F.col("back") / F.lit(RECORD_SPAN)))
    seen = prefix_scan(held, [*keys, "key"], ["stretch"], ["back"], {"before": ("next", "rec")})
    step = seen.groupBy(*keys, "rec").agg(F.min_by("before", F.when(F.col("before").isNotNull(), F.col("pos"))).alias("up"))
    state = cut_lineage(step.select(*keys, "rec", F.coalesce("up", "rec").alias("up"), F.col("up").isNull().alias("done")))
    while not state.filter("NOT done").isEmpty():
        ahead = state.select(*keys, F.col("rec").alias("up"), F.col("up").alias("to"), F.col("done").alias("there"))
        jumped = state.filter("NOT done").join(ahead, [*keys, "up"]).select(*keys, "rec", F.col("to").alias("up"), F.col("there").alias("done"))
        old, state = state, cut_lineage(state.filter("done").unionByName(jumped))
        discard(old)
    return state.select(*keys, F.col("rec").alias(entity), F.col("up").alias("label"))


def folded_nodes(mentions: DataFrame) -> DataFrame:
    """Mentions (graph_id, node_id, ord, alias, evidence, description, salience) -> one row per node.

    Everything is an aggregate with map-side combine; only the first three distinct evidence
    texts and the distinct aliases of a node are gathered.
    """
    key = ["graph_id", "node_id"]
    seen = lambda col: mentions.filter(F.col(col) != "").groupBy(*key, col).agg(F.min("ord").alias("ord"))
    joined = lambda col: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", col))), lambda s: s[col]), "|")
    ev = top_k(seen("evidence"), key, [F.col("ord")], 3).groupBy(*key).agg(joined("evidence").alias("evidence"))
    al = seen("alias").groupBy(*key).agg(joined("alias").alias("aliases"))
    longest = F.max_by("description", F.struct(F.length("description"), F.struct((-F.col("ord.o")).alias("o"), (-F.col("ord.i")).alias("i"))))
    base = mentions.groupBy(*key).agg(longest.alias("description"), F.max("salience").alias("salience"), F.count(F.lit(1)).alias("mention_count"))
    return base.join(al, key, "left").join(ev, key, "left")


def last_attributes(attrs: DataFrame) -> DataFrame:
    """Attribute rows (graph_id, node_id, ord, key, value): the latest value of each key."""
    return attrs.groupBy("graph_id", "node_id", "key").agg(F.max_by("value", "ord").alias("value"))


def node_positions(mentions: DataFrame) -> DataFrame:
    """Mean text and time position and the banker's-rounded mean day of each node."""
    return mentions.groupBy("graph_id", "node_id").agg(
        F.coalesce(F.avg("char_pos") / F.greatest(F.max("n_chars"), F.lit(1)), F.lit(0.0)).alias("text_pos"),
        F.coalesce(F.avg("time_pos"), F.lit(0.5)).alias("time_pos"),
        F.bround(F.avg("day")).cast("int").alias("day"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends per node; a self-loop counts twice."""
    return endpoints(edges).groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))


def deduped_edges(edges: DataFrame, order: list[str], texts: bool = True) -> DataFrame:
    """First edge per (source, target, type, normalised evidence); without ``texts``, the evidence itself is not returned."""
    keyed = edges.withColumn("_ev", norm_text("evidence"))
    keyed = keyed if texts else keyed.drop("evidence")
    keys = ["graph_id", "src", "dst", "type", "_ev"]
    if set(keyed.columns) == set(keys):
        return keyed.distinct().drop("_ev")
    return first_per_key(keyed, keys, order).drop("_ev")


def graph_totals(nodes: DataFrame, edges: DataFrame, raw: DataFrame) -> DataFrame:
    """Per-graph counts of nodes, edges, types and of relations lost on the way."""
    kinds = lambda df, name: df.groupBy("graph_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("graph_id").agg(
        F.sum("n").alias(name), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", F.col("n").cast("string")))), ",").alias(f"{name}_by_type")
    )
    lost = raw.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("dropped")
    )
    out = kinds(nodes, "nodes").join(kinds(edges, "edges"), "graph_id", "left").join(lost, "graph_id", "left")
    return out.withColumn("deduplicated", F.col("candidates") - F.col("dropped") - F.col("edges"))


# -- coreference and consolidation -------------------------------------------------------
def antecedent_map(raw: DataFrame, valid: DataFrame) -> DataFrame:
    """Antecedent rows with keys ``385`` or ``id=385``; unknown lines are dropped, null words cleared."""
    seq = F.regexp_extract("key", r"(?i)^\s*(?:id\s*=\s*)?(\d+)\s*$", 1)
    rows = raw.withColumn("seq", F.when(seq != "", seq.try_cast("long"))).filter("seq is not null")
    name = F.when(~F.coalesce("name", F.lit("")).isin("", "null"), F.col("name"))
    return rows.withColumn("name", name).join(valid, [c for c in valid.columns], "left_semi").drop("key")


def reattached_edges(edges: DataFrame, nodes: DataFrame, antecedents: DataFrame) -> DataFrame:
    """Move the generic end of a pronoun edge to the node its line's antecedent names.

    ``edges`` carry ``seq`` (the evidence line). ``moved`` says what happened to pronoun edges.
    """
    generic = nodes.filter(is_generic_name("name")).select("graph_id", "node_id", F.lit(True).alias("generic"))
    s = generic.select("graph_id", F.col("node_id").alias("src"), F.col("generic").alias("s_gen"))
    t = generic.select("graph_id", F.col("node_id").alias("dst"), F.col("generic").alias("t_gen"))
    index = nodes.select("graph_id", norm_text("name").alias("key"), "node_id").groupBy("graph_id", "key").agg(F.max("node_id").alias("to"))
    lines = antecedents.filter("name is not null").select("graph_id", "seq", norm_text("name").alias("key"))
    target = lines.join(index, ["graph_id", "key"]).select("graph_id", "seq", "to")
    # only edges with a pronoun look up their ends; the texts stay behind where no one returns them
    said = edges.withColumn("_said", F.coalesce(F.col("evidence").rlike(word_regex(K.PRONOUNS)), F.lit(False)))
    rest = said.filter("NOT _said").drop("_said").withColumn("moved", F.lit(None).cast("boolean"))
    out = said.filter("_said").drop("_said").join(s, ["graph_id", "src"], "left").join(t, ["graph_id", "dst"], "left").join(target, ["graph_id", "seq"], "left")
    pronoun = F.coalesce("s_gen", F.lit(False)) | F.coalesce("t_gen", F.lit(False))
    move = pronoun & F.col("to").isNotNull()
    out = (
        out.withColumn("moved", F.when(pronoun, F.col("to").isNotNull()))
        .withColumn("new_src", F.when(move & F.col("s_gen"), F.col("to")).otherwise(F.col("src")))
        .withColumn("new_dst", F.when(move & F.col("s_gen").isNull(), F.col("to")).otherwise(F.col("dst")))
        .drop("s_gen", "t_gen", "to", "src", "dst").withColumnsRenamed({"new_src": "src", "new_dst": "dst"})
    )
    return out.unionByName(rest)


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two strings."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def name_compatible(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Flag name pairs that may be one person; the ratio runs only where tokens do not decide."""
    titles = lambda words: F.array(*[F.lit(w) for w in words])
    words = lambda c: F.split(F.trim(F.regexp_replace(F.regexp_replace(norm_text(c), r"[.\-]", " "), " +", " ")), " ")
    out = pairs
    for side, c in (("a", left), ("b", right)):
        out = out.withColumn(f"_{side}w", words(c))
        out = out.withColumn(f"_{side}p", F.filter(f"_{side}w", lambda t: ~t.isin(*K.TITLE_TOKENS, "")))
    has = lambda side, group: F.arrays_overlap(f"_{side}w", titles(group))
    clash = (has("a", K.MALE_TITLES) & has("b", K.FEMALE_TITLES)) | (has("a", K.FEMALE_TITLES) & has("b", K.MALE_TITLES))
    empty = (F.size("_ap") == 0) | (F.size("_bp") == 0)
    subset = (F.size(F.array_except("_ap", "_bp")) == 0) | (F.size(F.array_except("_bp", "_ap")) == 0)
    state = F.when(empty | clash, "no").when(subset, "yes").otherwise("ask")
    out = out.withColumn("_s", state).withColumn("_aj", F.array_join("_ap", "")).withColumn("_bj", F.array_join("_bp", ""))
    first = F.left("_aj", F.lit(1)) == F.left("_bj", F.lit(1))
    sure = out.filter((F.col("_s") != "ask") | ~first).withColumn("compatible", F.col("_s") == "yes")
    asked = out.filter((F.col("_s") == "ask") & first).withColumn("compatible", similarity_ratio("_aj", "_bj") >= K.NAME_RATIO)
    return sure.unionByName(asked).drop("_aw", "_bw", "_ap", "_bp", "_s", "_aj", "_bj")


def consolidation_plan(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Member -> canonical node from ordered candidate groups (graph_id, group_no, member names).

    A group joins its nodes under one head. It may hold nodes of at most one head of earlier groups,
    and that head must be in it; without one, its node of highest degree becomes the head. Which
    names go together is decided beforehand, for all pairs of a group, by ``name_compatible``.
    """
    index = nodes.groupBy("graph_id", norm_text("name").alias("key")).agg(F.max_by(F.struct("node_id", "name", "degree"), "node_id").alias("n"))
    rows = groups.select("graph_id", "group_no", F.posexplode("members").alias("pos", "raw"))
    rows = rows.select("graph_id", "group_no", "pos", norm_text("raw").alias("key")).join(index, ["graph_id", "key"])
    rows = rows.groupBy("graph_id", "group_no", F.col("n.node_id").alias("node_id")).agg(
        F.min("pos").alias("pos"), F.first("n.name").alias("name"), F.first("n.degree").alias("degree")
    )
    rows = cut_lineage(rows)
    group = ["graph_id", "group_no"]
    a = rows.select(*group, F.col("node_id").alias("left"), F.col("name").alias("left_name"))
    b = rows.select(*group, F.col("node_id").alias("right"), F.col("name").alias("right_name"))
    pairs = name_compatible(a.join(b, group).filter("left <> right"), "left_name", "right_name").filter("compatible")
    fits = pairs.groupBy(*group, F.col("left").alias("node_id")).agg(F.collect_set("right").alias("fits"))
    member = F.struct("pos", "node_id", "fits")
    best = F.min_by("node_id", F.struct(-F.col("degree"), "pos"))
    packed = rows.join(fits, [*group, "node_id"], "left").groupBy(*group).agg(F.array_sort(F.collect_list(member)).alias("members"), best.alias("best"))
    return _in_waves(packed.filter(F.size("members") > 1))


def _in_waves(packed: DataFrame) -> DataFrame:
    """Settle ordered groups in waves: each wave takes every group that no open earlier group can still change.

    A node's head is written once. So a group waits only for nodes without a head that an open earlier
    group may still take in; a node with a head keeps nobody waiting, however many groups hold it, and
    a group that holds two heads of earlier groups is out whatever else comes. The earliest open group
    of each graph never waits, so every wave settles some.

    Groups carry their members, so a wave is one shuffle by node and one by group of what is still open. Its joins are
    sort-merge joins by hint, as small tables of very many waves would otherwise all pass through the driver.
    """
    spark, group, node = packed.sparkSession, ["graph_id", "group_no"], ["graph_id", "node_id"]
    fitting = F.flatten(F.transform("members", lambda m: F.coalesce(m.fits, F.array().cast("array<string>"))))
    unheld = lambda m: F.struct(
        m.pos.alias("pos"), m.node_id.alias("node_id"), m.fits.alias("fits"), (m.fits.isNotNull() | F.array_contains("fitting", m.node_id)).alias("can"),
        F.lit(None).cast("string").alias("head"), F.lit(None).cast("long").alias("since"),
    )
    waiting = packed.withColumn("fitting", fitting).select(*group, "best", F.transform("members", unheld).alias("members"))
    state, fresh = cut_lineage(waiting.withColumn("open", F.lit(True))), None
    path, wave = scratch_path(spark, "waves"), 0
    while True:
        rows = state.filter("open").select(*group, "best", F.inline("members"))
        if fresh is not None:
            rows = rows.join(fresh.dropDuplicates(node).hint("merge"), node, "left")
            rows = rows.withColumn("head", F.coalesce("head", "to")).withColumn("since", F.coalesce("since", "at")).drop("to", "at")
        first = rows.filter("can AND head IS NULL").groupBy(*node).agg(F.min("group_no").alias("first"))
        seen = rows.join(first.hint("merge"), node, "left").withColumn("earlier", F.when(F.col("since") < F.col("group_no"), F.col("head")))
        verdict = seen.groupBy(*group).agg(
            F.first("best").alias("best"), F.array_sort(F.collect_list(F.struct("pos", "node_id", "fits", "can", "head", "since"))).alias("members"),
            F.collect_set("earlier").alias("heads"), F.collect_set(F.when(F.col("earlier").isNotNull(), F.col("node_id"))).alias("taken"),
            F.coalesce(F.bool_or(F.col("head").isNull() & (F.col("first") < F.col("group_no"))), F.lit(False)).alias("waits"),
        )
        past, state = state, cut_lineage(verdict.withColumn("open", F.col("waits") & (F.size("heads") < 2)).drop("waits"))
        ready = state.filter("NOT open").withColumn("canonical", F.coalesce(F.get("heads", F.lit(0)), "best"))
        of_head = F.get(F.filter("members", lambda m: m.node_id == F.col("canonical")), F.lit(0)).fits
        takes = F.filter(F.transform("members", lambda m: m.node_id), lambda n: F.array_contains(of_head, n) & ~F.array_contains("taken", n))
        news = F.when(F.size("heads") < 2, F.coalesce(takes, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
        done = ready.select(*group, "canonical", news.alias("news")).filter(F.size("news") > 0)
        done.write.parquet(f"{path}/wave={wave}")
        done = spark.read.schema(done.schema).parquet(f"{path}/wave={wave}")
        held = F.explode(F.concat("news", F.array("canonical"))).alias("node_id")
        fresh = done.select("graph_id", held, F.col("canonical").alias("to"), F.col("group_no").alias("at"))
        discard(past)
        wave += 1
        if state.filter("open").isEmpty():
            break
    every = spark.read.schema(done.schema).parquet(path)
    return every.select(*group, F.explode("news").alias("node_id"), "canonical")


def merged_graph(edges: DataFrame, mapping: DataFrame, order: list[str], texts: bool = True) -> DataFrame:
    """Rewire edges to canonical nodes, drop the self-loops that arise, then deduplicate; ``texts`` as in ``deduped_edges``."""
    m = mapping.select("graph_id", "node_id", "canonical")
    s = m.select("graph_id", F.col("node_id").alias("src"), F.col("canonical").alias("s_to"))
    t = m.select("graph_id", F.col("node_id").alias("dst"), F.col("canonical").alias("t_to"))
    out = edges.join(s, ["graph_id", "src"], "left").join(t, ["graph_id", "dst"], "left")
    out = out.withColumn("src", F.coalesce("s_to", "src")).withColumn("dst", F.coalesce("t_to", "dst")).drop("s_to", "t_to")
    return deduped_edges(out.filter("src <> dst"), order, texts)


def person_candidates(nodes: DataFrame, edges: DataFrame, cap: int = 60) -> DataFrame:
    """Named persons with an edge or salience of 3 or more, by degree, then salience, then id."""
    people = nodes.filter((F.col("type") == "person") & ~is_generic_name("name"))
    ranked = people.join(degrees(edges), ["graph_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ranked = ranked.filter("degree > 0 or salience >= 3")
    return top_k(ranked, GID, [F.desc("degree"), F.desc("salience"), F.col("node_id")], cap)


# -- measuring -------------------------------------------------------------------------
def _edge_facts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-graph edge counts and the set of connected nodes."""
    ok = valid_edges(edges, nodes)
    loops = ok.groupBy("graph_id").agg(F.count(F.lit(1)).alias("valid_edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    every = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    return every.join(loops, "graph_id", "left"), endpoints(ok).distinct()


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, valid and dangling edges, self-loops, isolates and their ratios per graph."""
    facts, linked = _edge_facts(nodes, edges)
    flagged = nodes.join(linked.withColumn("linked", F.lit(1)), ["graph_id", "node_id"], "left")
    n = flagged.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("linked").isNull()).alias("isolates"),
        F.count_if(F.col("mention_count") == 0).alias("ungrounded"),
        F.count_if((F.col("mention_count") == 0) & F.col("linked").isNull()).alias("ungrounded_isolates"),
    )
    out = n.join(facts, "graph_id", "left").fillna(0, ["edges", "valid_edges", "self_loops"])
    return (
        out.withColumn("dangling", F.col("edges") - F.col("valid_edges"))
        .withColumn("isolate_rate", F.col("isolates") / F.col("nodes"))
        .withColumn("edge_node_ratio", F.col("edges") / F.col("nodes"))
    )


def quality_gate(
    metrics: DataFrame, max_isolate_rate: float = 0.60, min_edge_node_ratio: float = 0.50, max_dropped_rate: float = 0.55
) -> DataFrame:
    """Pass/fail with reasons; ``metrics`` add dropped, deduplicated, candidate_persons, merged_nodes."""
    total = F.col("edges") + F.col("dropped") + F.col("deduplicated")
    out = metrics.withColumn("dropped_rate", F.coalesce(F.try_divide("dropped", total), F.lit(1.0)))
    tests = [
        (F.col("nodes") == 0, "no nodes"), (F.col("edges") == 0, "no edges"),
        (F.col("isolate_rate") > max_isolate_rate, "isolate_rate"), (F.col("edge_node_ratio") < min_edge_node_ratio, "edge_node_ratio"),
        (F.col("dropped_rate") > max_dropped_rate, "dropped_relation_rate"), (F.col("dangling") > 0, "dangling_edges"),
        (F.col("ungrounded_isolates") > 0, "ungrounded_isolates"),
    ]
    soft = [
        ((F.col("candidate_persons") >= 80) & (F.col("merged_nodes") == 0), "no merges"), (F.col("ungrounded") > 0, "ungrounded_nodes"),
    ]
    flags = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    out = out.withColumn("failures", flags(tests)).withColumn("warnings", flags(soft))
    return out.withColumn("passed", F.size("failures") == 0)


def simple_pairs(edges: DataFrame) -> DataFrame:
    """Undirected simple graph: no self-loops, no parallel edges."""
    pairs = edges.filter("src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.distinct()


def core_enrichment(per_graph: DataFrame) -> DataFrame:
    """How much denser gold nodes sit in the core: micro and macro rates, ratio, Haldane odds ratio.

    Input per graph: nodes, core, gold, gold_core.
    """
    sums = per_graph.agg(
        F.sum("gold").alias("gold_total"), F.sum("gold_core").alias("gold_dense"),
        F.sum(F.col("nodes") - F.col("gold")).alias("other_total"), F.sum(F.col("core") - F.col("gold_core")).alias("other_dense"),
        F.avg(F.try_divide("gold_core", "gold")).alias("gold_rate_macro"),
    )
    half = lambda c: c + F.lit(0.5)
    odds = half(F.col("gold_dense")) * half(F.col("other_total") - F.col("other_dense")) / (
        half(F.col("gold_total") - F.col("gold_dense")) * half(F.col("other_dense"))
    )
    out = sums.withColumn("gold_rate", F.try_divide("gold_dense", "gold_total")).withColumn("other_rate", F.try_divide("other_dense", "other_total"))
    return out.withColumn("enrichment", F.try_divide("gold_rate", "other_rate")).withColumn("odds_ratio", odds)


def dense_region(nodes: DataFrame, quantile: float = 0.75, radius: float = 0.45) -> DataFrame:
    """Nodes of at least upper-quartile degree near the centroid; needs degree, fx, fy, fz.

    The order statistic comes from a degree histogram, so no graph is sorted in one task.
    """
    hist = nodes.groupBy("graph_id", "degree").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("graph_id").orderBy("degree")
    upto = hist.withColumn("cum", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy("graph_id")))
    cut = upto.filter(F.col("cum") > F.floor(F.col("all") * quantile)).groupBy("graph_id").agg(F.min("degree").alias("cut"))
    mid = nodes.groupBy("graph_id").agg(*[F.avg(c).alias(f"m{c}") for c in ("fx", "fy", "fz")])
    dist = F.sqrt(sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in ("fx", "fy", "fz")))
    out = nodes.join(cut, "graph_id").join(mid, "graph_id").withColumn("distance", dist)
    return out.filter((F.col("degree") >= F.col("cut")) & (F.col("distance") <= radius)).drop("cut", "mfx", "mfy", "mfz")


# -- masking ---------------------------------------------------------------------------
def masked_nodes(nodes: DataFrame, limit: Column | float) -> DataFrame:
    """Nodes first seen at or before a text position; an unknown position counts as the end."""
    return nodes.filter(F.coalesce("text_pos", F.lit(1.0)) <= limit)


def proven_quotes(quotes: DataFrame, texts: DataFrame, lot: int = 1000) -> DataFrame:
    """Distinct quotes (graph_id, quote), normalised, that lie in the visible text of their graph.

    Quotes meet their text in lots of about ``lot``: the text is copied once a lot, not once a quote, and
    a graph with very many quotes spreads over as many rows as it has lots.
    """
    asked = quotes.filter("quote <> ''").distinct()
    lots = asked.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) / lot).alias("lots"))
    packed = asked.join(lots, "graph_id").groupBy("graph_id", F.expr("pmod(xxhash64(quote), lots)").alias("lot")).agg(F.collect_list("quote").alias("asked"))
    body = texts.select("graph_id", norm_text("visible").alias("body"))
    return packed.join(body, "graph_id").select("graph_id", F.explode(F.filter("asked", lambda q: F.contains("body", q))).alias("quote"))


def strict_mask(nodes: DataFrame, edges: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep only what the visible text proves: evidence found in it, rebuilt descriptions, no aliases.

    ``texts`` carry visible and visible_ratio, one row per graph; nodes carry evidence as an array.
    """
    items = nodes.select("graph_id", "node_id", F.posexplode("evidence").alias("pos", "item")).withColumn("quote", norm_text("item"))
    linked = edges.withColumn("quote", norm_text("evidence"))
    seen = proven_quotes(items.select("graph_id", "quote").unionByName(linked.select("graph_id", "quote")), texts)
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
    proof = items.join(seen, ["graph_id", "quote"], "left_semi").groupBy("graph_id", "node_id").agg(held.alias("seen"))
    kept = nodes.join(texts.select("graph_id", "visible_ratio"), "graph_id").join(proof, ["graph_id", "node_id"], "left")
    kept = kept.withColumn("evidence", F.coalesce("seen", F.array().cast("array<string>"))).drop("seen")
    kept = kept.filter((F.size("evidence") > 0) | (F.coalesce("text_pos", F.lit(1.0)) <= F.col("visible_ratio")))
    kept = kept.withColumn("description", F.array_join(F.slice("evidence", 1, 3), " ")).withColumn("alias", F.lit(None).cast("string"))
    proven = linked.join(seen, ["graph_id", "quote"], "left_semi").drop("quote")
    return kept.drop("visible_ratio"), valid_edges(proven, kept)


# -- reading off the graph ----------------------------------------------------------------
def suspect_chain(nodes: DataFrame, edges: DataFrame, cap: int = 4, per_person: int = 4, victims: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Persons ranked by weighted incriminating edges, and each one's strongest edges.

    ``victims`` (graph_id, victim): names that are no suspects in their graph.
    """
    people = nodes.filter("type = 'person'").select("graph_id", F.col("node_id").alias("src"), "name")
    if victims is not None:
        out = victims.select("graph_id", F.lower("victim").alias("_low")).distinct()
        people = people.withColumn("_low", F.lower("name")).join(out, ["graph_id", "_low"], "left_anti").drop("_low")
    weight = (
        F.coalesce("confidence", F.lit(0.0)) * F.when(F.col("decoy"), 0.3).otherwise(1.0)
        * F.greatest(F.coalesce("importance", F.lit(3)), F.lit(1)) / 3.0
    )
    hits = edges.filter(F.col("type").isin(K.SUSPECT_EDGE_TYPES)).join(people, ["graph_id", "src"]).withColumn("w", weight)
    sums = hits.groupBy("graph_id", "src", "name").agg(F.round(F.sum("w"), 6).alias("score"))
    best = top_k(sums, GID, [F.desc("score"), F.col("src")], cap)
    chosen = hits.join(best.select("graph_id", "src", "rank"), ["graph_id", "src"])
    proof = top_k(chosen.withColumnRenamed("rank", "person_rank"), ["graph_id", "src"], [F.desc("confidence"), F.col("edge_id")], per_person)
    return best, proof


def victim_neighbours(nodes: DataFrame, edges: DataFrame, victims: DataFrame) -> DataFrame:
    """First tier of candidate names: persons linked with a victim (graph_id, node_id) of their graph."""
    near = adjacency(edges).join(victims, ["graph_id", "node_id"], "left_semi").select("graph_id", F.col("neighbor").alias("node_id")).distinct()
    people = nodes.filter("type = 'person'").join(near, ["graph_id", "node_id"], "left_semi")
    return people.select("graph_id", "name", F.lit(0).alias("tier"), F.col("node_id").alias("ord"))


def candidate_names(tiers: DataFrame, cap: int = 6) -> DataFrame:
    """Distinct candidate names by source tier, then order inside it; generic names are skipped."""
    named = tiers.filter(~F.lower("name").isin(K.GENERIC_PERSONS))
    first = named.groupBy("graph_id", "name").agg(F.min(F.struct("tier", "ord")).alias("at"))
    return top_k(first, GID, [F.col("at"), F.col("name")], cap).select("graph_id", "name", F.col("at.tier").alias("tier"), "rank")


def confession_rows(rows: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """First k/2 and last k-k/2 sentences with confession wording."""
    hits = rows.filter(F.col("text").rlike(word_regex(K.CONFESSION_WORDS)))
    head = top_k(hits, keys, [F.col("seq")], k // 2).drop("rank")
    tail = top_k(hits, keys, [F.desc("seq")], k - k // 2).drop("rank")
    return head.unionByName(tail).distinct()


def contradiction_edges(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges from evidence item to testimony item for each listed pair (doc_id, evidence, testimony)."""
    ev = items.filter("kind = 'evidence'").select("doc_id", F.col("number").alias("evidence"), F.concat(F.lit("ev_"), F.col("number").cast("string")).alias("src"))
    te = items.filter("kind = 'testimony'").select("doc_id", F.col("number").alias("testimony"), F.concat(F.lit("te_"), F.col("number").cast("string")).alias("dst"))
    out = pairs.join(ev, ["doc_id", "evidence"]).join(te, ["doc_id", "testimony"])
    return out.select(
        "doc_id", "src", "dst", F.lit("contradicts").alias("type"), F.left(F.coalesce("reason", F.lit("")), F.lit(200)).alias("evidence"),
        F.lit(0.9).alias("confidence"), F.lit(5).alias("importance"),
    )


def informative_ratio(picked: DataFrame, nodes: DataFrame, hubs: DataFrame) -> DataFrame:
    """Share of picked nodes of an informative type that are not hubs."""
    rows = picked.join(nodes.select("graph_id", "node_id", "type"), ["graph_id", "node_id"])
    rows = rows.join(hubs.select("graph_id", "node_id", F.lit(1).alias("hub")), ["graph_id", "node_id"], "left")
    good = F.col("type").isin(K.INFORMATIVE_TYPES) & F.col("hub").isNull()
    return rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("picked"), F.avg(good.cast("double")).alias("informative"))
