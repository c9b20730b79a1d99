"""Registered queries: building, cleaning, masking and measuring graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import cut_lineage, table, top_k
from ..functions import constants as K
from ..functions.text import hash_mod
from ..operators import graph as G, iterate as I
from .answer_queries import words_sql
from .inputs import UNIT, Dialect, check, relation
from .registry import query
from .text_queries import NAME, NORM, docs

DUCK = Dialect(False)
H = DUCK.h
quoted = lambda words: ", ".join(f"'{w}'" for w in words)


def nodes_of(spark, sf):
    return relation(spark, sf, "nodes")


def edges_of(spark, sf):
    return relation(spark, sf, "edges")


def key_of(prefix, *cols):
    return F.concat(F.lit(prefix), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])


# -- endpoint resolution -----------------------------------------------------------
RAW_SQL = f"""raw AS (SELECT e.graph_id, e.edge_id, e.type, e.evidence, e.confidence,
    CASE WHEN {H("'s' || e.edge_id")} % 10 = 0 THEN 'unknown stranger' WHEN {H("'s' || e.edge_id")} % 3 = 0 THEN a.alias ELSE 'The  ' || a.name END AS source,
    CASE WHEN {H("'t' || e.edge_id")} % 12 = 0 THEN 'nowhere' WHEN {H("'t' || e.edge_id")} % 12 = 1 THEN 'Item  ' || e.dst ELSE upper(b.name) END AS target
  FROM edges e JOIN nodes a ON e.graph_id = a.graph_id AND e.src = a.node_id JOIN nodes b ON e.graph_id = b.graph_id AND e.dst = b.node_id)"""
INDEX_SQL = f"""idx AS (SELECT graph_id, key, min(node_id) AS node_id FROM (
    SELECT graph_id, node_id, {NAME(NORM('name'))} AS key FROM nodes UNION ALL SELECT graph_id, node_id, {NAME(NORM('alias'))} FROM nodes
    UNION ALL SELECT graph_id, node_id, {NAME(NORM("'item ' || node_id"))} FROM nodes) k
    WHERE key <> '' GROUP BY ALL)"""
RES_SQL = f"""{RAW_SQL}, {INDEX_SQL}, res AS (SELECT r.*, s.node_id AS src, t.node_id AS dst FROM raw r
    LEFT JOIN idx s ON r.graph_id = s.graph_id AND s.key = {NAME(NORM('r.source'))}
    LEFT JOIN idx t ON r.graph_id = t.graph_id AND t.key = {NAME(NORM('r.target'))})"""


def aliased_nodes(spark, sf):
    return nodes_of(spark, sf).withColumn("aliases", F.array(F.concat(F.lit("item "), "node_id"), F.lit("")))


def raw_relations(spark, sf):
    """Edges with names in place of ids; some names are unknown, some are aliases."""
    n = nodes_of(spark, sf).select("graph_id", "node_id", "name", "alias")
    a = n.select("graph_id", F.col("node_id").alias("src"), F.col("name").alias("a_name"), F.col("alias").alias("a_alias"))
    b = n.select("graph_id", F.col("node_id").alias("dst"), F.col("name").alias("b_name"))
    # which name an edge shows is settled before the joins, so that ids travel through them only where a query returns them
    sh, th = hash_mod(key_of("s", "edge_id"), 1 << 32), hash_mod(key_of("t", "edge_id"), 12)
    s_kind = F.when(sh % 10 == 0, 0).when(sh % 3 == 0, 1).otherwise(2).cast("byte")
    e = edges_of(spark, sf).withColumn("s_kind", s_kind).withColumn("t_kind", F.least(th, F.lit(2)).cast("byte"))
    e = e.select("graph_id", "src", "dst", "edge_id", "type", "evidence", "confidence", "s_kind", "t_kind").join(a, ["graph_id", "src"])
    source = F.when(F.col("s_kind") == 0, "unknown stranger").when(F.col("s_kind") == 1, F.col("a_alias")).otherwise(F.concat(F.lit("The  "), "a_name"))
    e = e.withColumn("source", source).drop("src", "s_kind", "a_alias", "a_name").join(b, ["graph_id", "dst"])
    target = F.when(F.col("t_kind") == 0, "nowhere").when(F.col("t_kind") == 1, F.concat(F.lit("Item  "), "dst")).otherwise(F.upper("b_name"))
    return e.select("graph_id", "edge_id", "type", "evidence", "confidence", "source", target.alias("target"))


@query("endpoint_resolve", check("nodes edges", f"WITH {RES_SQL} SELECT graph_id, edge_id, src, dst FROM res"))
def endpoint_resolve(spark, sf):
    out = G.resolved_endpoints(raw_relations(spark, sf), aliased_nodes(spark, sf))
    return out.select("graph_id", "edge_id", "src", "dst")


KEPT_SQL = f"""{RES_SQL}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, src, dst, type, {NORM('evidence')}
        ORDER BY edge_id) AS rn FROM res WHERE src IS NOT NULL AND dst IS NOT NULL) z WHERE rn = 1),
      nt AS (SELECT graph_id, sum(n) AS nodes, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS nodes_by_type FROM (SELECT graph_id, type, count(*) n FROM nodes GROUP BY ALL) a GROUP BY 1),
      et AS (SELECT graph_id, sum(n) AS edges, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS edges_by_type FROM (SELECT graph_id, type, count(*) n FROM kept GROUP BY ALL) b GROUP BY 1),
      lost AS (SELECT graph_id, count(*) AS candidates, count(*) FILTER (src IS NULL OR dst IS NULL) AS dropped FROM res GROUP BY 1),
      totals AS (SELECT graph_id, cast(nodes AS BIGINT) AS nodes, nodes_by_type, cast(edges AS BIGINT) AS edges, edges_by_type, candidates, dropped,
        cast(candidates - dropped - edges AS BIGINT) AS deduplicated FROM nt LEFT JOIN et USING (graph_id) LEFT JOIN lost USING (graph_id))"""


def totals_of(spark, sf):
    nodes = nodes_of(spark, sf)
    raw = G.resolved_endpoints(raw_relations(spark, sf), aliased_nodes(spark, sf))
    raw = cut_lineage(raw.select("graph_id", "type", "evidence", "src", "dst"))  # what is counted; which of equal edges stays changes no count
    kept = G.deduped_edges(raw.filter("src is not null and dst is not null"), ["evidence"], texts=False)
    return G.graph_totals(nodes, kept, raw)


@query("merge_stats", check("nodes edges", f"WITH {KEPT_SQL} SELECT * FROM totals"))
def merge_stats(spark, sf):
    return totals_of(spark, sf)


# every tenth node or so gets an edge to a node that does not exist
ALL_EDGES = """all_edges AS (SELECT graph_id, edge_id, src, dst FROM edges
    UNION ALL SELECT graph_id, 'bad_' || node_id, node_id, 'ghost_' || node_id FROM nodes WHERE text_pos >= 0.9)"""


def with_ghosts(spark, sf):
    late = nodes_of(spark, sf).filter("text_pos >= 0.9")
    bad = late.select("graph_id", key_of("bad_", "node_id").alias("edge_id"), F.col("node_id").alias("src"), key_of("ghost_", "node_id").alias("dst"))
    return edges_of(spark, sf).select("graph_id", "edge_id", "src", "dst").unionByName(bad)


@query(
    "dangling_edges",
    check("nodes edges", f"""WITH {ALL_EDGES}, n AS (SELECT DISTINCT graph_id, node_id FROM nodes) SELECT e.graph_id, edge_id, src, dst FROM all_edges e
      LEFT JOIN n s ON s.graph_id = e.graph_id AND s.node_id = e.src LEFT JOIN n t ON t.graph_id = e.graph_id AND t.node_id = e.dst
      WHERE s.node_id IS NULL OR t.node_id IS NULL"""),
)
def dangling_edges(spark, sf):
    return G.dangling_edges(with_ghosts(spark, sf), nodes_of(spark, sf)).select("graph_id", "edge_id", "src", "dst")


@query(
    "referenced_entities",
    check("nodes edges", f"""WITH {RAW_SQL}, used AS (SELECT DISTINCT graph_id, key FROM (SELECT graph_id, {NAME(NORM('source'))} AS key FROM raw
        UNION ALL SELECT graph_id, {NAME(NORM('target'))} FROM raw) u WHERE key <> '')
    SELECT DISTINCT k.graph_id, k.node_id, k.name FROM (SELECT graph_id, node_id, name, {NAME(NORM('name'))} AS key FROM nodes
      UNION ALL SELECT graph_id, node_id, name, {NAME(NORM('alias'))} FROM nodes
      UNION ALL SELECT graph_id, node_id, name, {NAME(NORM("'item ' || node_id"))} FROM nodes) k JOIN used USING (graph_id, key)"""),
)
def referenced_entities(spark, sf):
    return G.referenced_nodes(aliased_nodes(spark, sf), raw_relations(spark, sf)).select("graph_id", "node_id", "name")


@query(
    "prune_isolates",
    check("nodes edges", """SELECT graph_id, node_id, mention_count FROM nodes n WHERE NOT (mention_count = 0 AND NOT EXISTS (
      SELECT 1 FROM (SELECT graph_id, src AS node_id FROM edges UNION ALL SELECT graph_id, dst FROM edges) e WHERE e.graph_id = n.graph_id AND e.node_id = n.node_id))"""),
)
def prune_isolates(spark, sf):
    return G.without_ungrounded_isolates(nodes_of(spark, sf), edges_of(spark, sf)).select("graph_id", "node_id", "mention_count")


@query(
    "adjacency",
    check("edges", """SELECT graph_id, node_id, count(*) AS n_links, count(DISTINCT neighbor) AS n_neighbors, round(max(confidence), 6) AS top_confidence FROM (
      SELECT graph_id, src AS node_id, dst AS neighbor, confidence FROM edges UNION ALL SELECT graph_id, dst, src, confidence FROM edges) a GROUP BY ALL"""),
)
def adjacency(spark, sf):
    adj = G.adjacency(edges_of(spark, sf))
    per = adj.groupBy("graph_id", "node_id", "neighbor").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("c"))
    return per.groupBy("graph_id", "node_id").agg(
        F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_neighbors"), F.round(F.max("c"), 6).alias("top_confidence")
    )


@query(
    "name_mentions",
    check("nodes graph_questions", f"""WITH q AS (SELECT graph_id, qid, {NORM("question || ' ' || choice_a || ' ' || choice_b")} AS body FROM graph_questions),
      n AS (SELECT graph_id, node_id, {NORM('name')} AS nm FROM nodes UNION ALL SELECT graph_id, node_id, {NORM('alias')} FROM nodes)
    SELECT DISTINCT q.graph_id, q.qid, n.node_id FROM q JOIN n ON q.graph_id = n.graph_id AND length(n.nm) >= 3
      AND regexp_matches(q.body, '(^|[^a-z0-9])' || regexp_escape(n.nm) || '($|[^a-z0-9])')"""),
)
def name_mentions(spark, sf):
    texts = relation(spark, sf, "graph_questions").withColumn("text", F.concat_ws(" ", "question", "choice_a", "choice_b"))
    return G.name_mentions(nodes_of(spark, sf), texts)


@query(
    "find_nodes",
    check("nodes graph_questions", f"""WITH w AS (SELECT DISTINCT graph_id, lookup, {NORM('lookup')} AS want FROM (SELECT graph_id, choice_a AS lookup FROM graph_questions
        UNION ALL SELECT graph_id, choice_b FROM graph_questions) l),
      hit AS (SELECT w.graph_id, w.lookup, n.node_id, min(CASE WHEN {NORM('n.name')} = want THEN 0 ELSE 1 END) AS tier FROM w JOIN nodes n ON w.graph_id = n.graph_id
        AND (contains({NORM('n.name')}, want) OR contains(want, {NORM('n.name')})) GROUP BY ALL)
    SELECT graph_id, lookup, node_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, lookup ORDER BY tier, node_id) AS rank FROM hit) r WHERE rank <= 5"""),
)
def find_nodes(spark, sf):
    q = relation(spark, sf, "graph_questions")
    lookups = q.select("graph_id", F.explode(F.array("choice_a", "choice_b")).alias("lookup"))
    return G.find_nodes(lookups, nodes_of(spark, sf), 5)


@query(
    "dup_names",
    """WITH n AS (SELECT DISTINCT p_brand, lower(p_name || ' ' || p_size) AS nm FROM part)
    SELECT a.p_brand, a.nm AS "inner", b.nm AS "outer" FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.nm <> b.nm AND contains(b.nm, a.nm)""",
)
def dup_names(spark, sf):
    names = table(spark, sf, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_size").alias("name"))
    return G.near_duplicate_names(names, ["p_brand"])


# -- entity resolution ----------------------------------------------------------------
ENT_SQL = f"""ent AS (SELECT source, doc_id * 2147483648 + seq AS rec, {NAME(NORM('substr(text, 1, 24)'))} AS k1, {NAME(NORM('right(text, 24)'))} AS k2 FROM lines),
  links AS (SELECT DISTINCT source, rec, key FROM (SELECT source, rec, k1 AS key FROM ent UNION ALL SELECT source, rec, k2 FROM ent) u WHERE key <> ''),
  walk(source, rec, reach) AS (SELECT DISTINCT source, rec, rec FROM links
    UNION SELECT w.source, w.rec, b.rec FROM walk w JOIN links a ON a.source = w.source AND a.rec = w.reach JOIN links b ON b.source = a.source AND b.key = a.key)
  SELECT source, rec, min(reach) AS label FROM walk GROUP BY source, rec"""


def line_records(spark, sf):
    """Records named by the head and the tail of a line."""
    lines = relation(spark, sf, "lines")
    return lines.select("source", (F.col("doc_id") * UNIT + F.col("seq")).alias("rec"), F.array(F.left("text", F.lit(24)), F.right("text", F.lit(24))).alias("names"))


@query("entity_resolve", check("lines", f"WITH RECURSIVE {ENT_SQL}"))
def entity_resolve(spark, sf):
    """Records merged within a source, whatever their order."""
    return G.resolved_entities(line_records(spark, sf), ["source"], "rec")


FIRST_SQL = f"""ent AS (SELECT source, doc_id * 2147483648 + seq AS rec, {NAME(NORM('substr(text, 1, 24)'))} AS k1, {NAME(NORM('right(text, 24)'))} AS k2 FROM lines),
  held AS (SELECT source, rec, key, min(pos) AS pos FROM (SELECT source, rec, k1 AS key, 0 AS pos FROM ent WHERE k1 <> '' UNION ALL SELECT source, rec, k2, 1 FROM ent WHERE k1 <> '' AND k2 <> '') u GROUP BY ALL),
  prior AS (SELECT *, lag(rec) OVER (PARTITION BY source, key ORDER BY rec) AS before FROM held),
  step AS MATERIALIZED (SELECT source, rec, arg_min(before, pos) FILTER (WHERE before IS NOT NULL) AS up FROM prior GROUP BY ALL),
  walk(source, rec, label) AS (SELECT source, rec, rec FROM step WHERE up IS NULL UNION ALL SELECT s.source, s.rec, w.label FROM walk w JOIN step s ON s.source = w.source AND s.up = w.rec)
  SELECT source, rec, label FROM walk"""


@query("entity_resolve_first", check("lines", f"WITH RECURSIVE {FIRST_SQL}"))
def entity_resolve_first(spark, sf):
    """Records merged within a source in their order: the first known name decides, the last holder of a name owns it."""
    return G.resolved_entities(line_records(spark, sf), ["source"], "rec", mode="first")


MEN_SQL = """men AS (SELECT c_nationkey AS graph_id, 'p' || l_partkey AS node_id, l_orderkey AS o, l_linenumber * 2147483648 + l_suppkey AS i, l_returnflag || l_linestatus AS alias,
    'qty ' || cast(l_quantity AS INT) AS evidence, 'seen on ' || strftime(l_shipdate, '%Y-%m-%d') || CASE WHEN l_tax > 0.05 THEN ' taxed' ELSE '' END AS description,
    1 + l_linenumber % 5 AS salience, o_totalprice AS char_pos, 700001 AS n_chars, l_discount AS time_pos, CASE WHEN l_tax > 0.02 THEN l_linenumber END AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def part_mentions(spark, sf):
    li, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    taxed = F.when(F.col("l_tax") > 0.05, " taxed").otherwise("")
    return j.select(
        F.col("c_nationkey").alias("graph_id"), key_of("p", "l_partkey").alias("node_id"),
        F.struct(F.col("l_orderkey").alias("o"), (F.col("l_linenumber").cast("bigint") * UNIT + F.col("l_suppkey")).alias("i")).alias("ord"),
        F.concat("l_returnflag", "l_linestatus").alias("alias"), key_of("qty ", F.col("l_quantity").cast("int").cast("string")).alias("evidence"),
        F.concat(F.lit("seen on "), F.date_format("l_shipdate", "yyyy-MM-dd"), taxed).alias("description"),
        (1 + F.col("l_linenumber") % 5).alias("salience"), F.col("o_totalprice").alias("char_pos"), F.lit(700001).alias("n_chars"),
        F.col("l_discount").alias("time_pos"), F.when(F.col("l_tax") > 0.02, F.col("l_linenumber")).alias("day"),
    )


@query(
    "node_fold",
    f"""WITH {MEN_SQL}, ev AS (SELECT graph_id, node_id, string_agg(evidence, '|' ORDER BY k) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, node_id ORDER BY k) AS rn FROM (
        SELECT graph_id, node_id, evidence, min((o, i)) AS k FROM men GROUP BY ALL) a) b WHERE rn <= 3 GROUP BY ALL),
      al AS (SELECT graph_id, node_id, string_agg(alias, '|' ORDER BY k) AS aliases FROM (SELECT graph_id, node_id, alias, min((o, i)) AS k FROM men GROUP BY ALL) a GROUP BY ALL)
    SELECT m.graph_id, m.node_id, arg_max(description, (length(description), -o, -i)) AS description, max(salience) AS salience, count(*) AS mention_count,
      any_value(al.aliases) AS aliases, any_value(ev.evidence) AS evidence FROM men m JOIN ev USING (graph_id, node_id) JOIN al USING (graph_id, node_id) GROUP BY ALL""",
)
def node_fold(spark, sf):
    return G.folded_nodes(part_mentions(spark, sf))


@query(
    "node_attributes",
    f"""WITH {MEN_SQL}, kv AS (SELECT graph_id, node_id, (o, i) AS k, 'flag' AS key, alias AS value FROM men UNION ALL SELECT graph_id, node_id, (o, i), 'salience', salience::VARCHAR FROM men)
    SELECT graph_id, node_id, key, arg_max(value, k) AS value FROM kv GROUP BY ALL""",
)
def node_attributes(spark, sf):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    rows = part_mentions(spark, sf).select(
        "graph_id", "node_id", "ord", F.inline(F.array(pair("flag", F.col("alias")), pair("salience", F.col("salience").cast("string"))))
    )
    return G.last_attributes(rows)


@query(
    "node_positions",
    f"""WITH {MEN_SQL} SELECT graph_id, node_id, round(avg(char_pos / n_chars), 6) AS text_pos, round(coalesce(avg(time_pos), 0.5), 6) AS time_pos,
      cast(round_even(avg(day), 0) AS INT) AS day FROM men GROUP BY ALL""",
)
def node_positions(spark, sf):
    out = G.node_positions(part_mentions(spark, sf))
    return out.withColumn("text_pos", F.round("text_pos", 6)).withColumn("time_pos", F.round("time_pos", 6))


@query(
    "degree",
    check("edges", "SELECT graph_id, node_id, count(*) AS degree FROM (SELECT graph_id, src AS node_id FROM edges UNION ALL SELECT graph_id, dst FROM edges) e GROUP BY ALL"),
)
def degree(spark, sf):
    return G.degrees(edges_of(spark, sf))


@query(
    "edge_dedup",
    check("edges", f"""SELECT graph_id, src, dst, type, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, src, dst, type, {NORM('evidence')}
      ORDER BY confidence DESC, edge_id) AS rn FROM edges) t WHERE rn = 1"""),
)
def edge_dedup(spark, sf):
    edges = edges_of(spark, sf).select("graph_id", "src", "dst", "type", "evidence", "edge_id", (-F.col("confidence")).alias("neg"))
    return G.deduped_edges(edges, ["neg", "edge_id"]).select("graph_id", "src", "dst", "type", "edge_id")


# -- coreference -------------------------------------------------------------------------
PRO_SQL = f"""people AS (SELECT graph_id, node_id, CASE WHEN type = 'person' AND {H("'gen' || node_id")} % 3 = 0 THEN 'the man' ELSE name END AS name FROM nodes),
  line AS (SELECT e.*, importance AS seq, CASE WHEN {H("'pro' || edge_id")} % 2 = 0 THEN 'he took the ' || evidence ELSE evidence END AS said FROM edges e),
  ante AS (SELECT graph_id, cast(seq AS BIGINT) AS seq, min(name) AS name FROM people, (VALUES (1),(2),(4)) s(seq) WHERE name <> 'the man' AND node_id LIKE 'c%' AND graph_id <> 3 GROUP BY ALL),
  too AS (SELECT a.graph_id, a.seq, max(p.node_id) AS goes_to FROM ante a JOIN people p ON a.graph_id = p.graph_id AND {NORM('p.name')} = {NORM('a.name')} GROUP BY ALL)"""


def pronoun_case(spark, sf):
    gen = (F.col("type") == "person") & (hash_mod(key_of("gen", "node_id"), 3) == 0)
    people = nodes_of(spark, sf).withColumn("name", F.when(gen, "the man").otherwise(F.col("name")))
    said = F.when(hash_mod(key_of("pro", "edge_id"), 2) == 0, F.concat(F.lit("he took the "), "evidence")).otherwise(F.col("evidence"))
    edges = edges_of(spark, sf).withColumn("evidence", said).withColumn("seq", F.col("importance"))
    named = people.filter("name <> 'the man' and node_id like 'c%' and graph_id <> 3").groupBy("graph_id").agg(F.min("name").alias("name"))
    ante = named.select("graph_id", "name", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)).cast("array<bigint>")).alias("seq"))
    return edges, people, ante


@query(
    "coref_reattach",
    check("nodes edges", f"""WITH {PRO_SQL} SELECT graph_id, edge_id, CASE WHEN mv AND sg THEN goes_to ELSE src END AS src,
      CASE WHEN mv AND NOT sg THEN goes_to ELSE dst END AS dst, CASE WHEN pro THEN goes_to IS NOT NULL END AS moved FROM (
      SELECT l.graph_id, l.edge_id, l.src, l.dst, t.goes_to, coalesce(s.name = 'the man', false) AS sg,
        starts_with(l.said, 'he ') AND (coalesce(s.name = 'the man', false) OR coalesce(d.name = 'the man', false)) AS pro, pro AND t.goes_to IS NOT NULL AS mv
      FROM line l LEFT JOIN people s ON l.graph_id = s.graph_id AND l.src = s.node_id LEFT JOIN people d ON l.graph_id = d.graph_id AND l.dst = d.node_id
        LEFT JOIN too t ON l.graph_id = t.graph_id AND l.seq = t.seq) z"""),
)
def coref_reattach(spark, sf):
    edges, people, ante = pronoun_case(spark, sf)
    return G.reattached_edges(edges, people, ante).select("graph_id", "edge_id", "src", "dst", "moved")


@query(
    "antecedents",
    """SELECT event_id, user_id AS seq, CASE WHEN event_type NOT IN ('error') THEN event_type END AS name FROM events
    WHERE event_id % 3 <> 2 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error')""",
)
def antecedents(spark, sf):
    ev = table(spark, sf, "events")
    uid = F.col("user_id").cast("string")
    key = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" id = "), uid)).when(F.col("event_id") % 3 == 1, uid).otherwise(F.concat(F.lit("x"), uid))
    raw = ev.select("event_id", key.alias("key"), F.when(F.col("event_type") == "error", "null").otherwise(F.col("event_type")).alias("name"))
    valid = ev.filter("event_type = 'error'").select(F.col("user_id").alias("seq")).distinct()
    return G.antecedent_map(raw, valid)


# -- consolidation -----------------------------------------------------------------------
def person_names(spark, sf):
    """Customers under story names; the customer key in the name keeps them distinct."""
    title = F.get(F.array(*[F.lit(t) for t in ("", "Mr. ", "Lady ", "Dr. ")]), F.col("c_custkey").cast("int") % 4)
    tail = F.get(F.array(*[F.lit(t) for t in ("", " smith", "-jones")]), F.col("c_custkey").cast("int") % 3)
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("graph_id"), key_of("c", "c_custkey").alias("node_id"), "c_custkey",
        F.concat(title, F.lower("c_mktsegment"), tail, F.lit(" "), (F.col("c_custkey") % 7).cast("string")).alias("name"),
        F.floor("c_acctbal").cast("long").alias("degree"),
    )


@query("consolidate_plan")
def consolidate_plan(spark, sf):
    """Candidate groups: customers of a nation with one segment and one residue, in key order."""
    people = person_names(spark, sf)
    seg = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    near = people.join(seg, "c_custkey").withColumn("part", F.floor(F.col("c_custkey") / 256))
    rows = near.groupBy("graph_id", "c_mktsegment", "part").agg(F.min("c_custkey").alias("group_no"), F.array_sort(F.collect_set("name")).alias("members"))
    return G.consolidation_plan(rows.select("graph_id", "group_no", "members"), people)


@query("name_compatible")
def name_compatible(spark, sf):
    """Each customer against the first one of the same nation and segment."""
    seg = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    people = person_names(spark, sf).join(seg, "c_custkey")
    head = people.groupBy("graph_id", "c_mktsegment").agg(F.min_by("name", "c_custkey").alias("head"))
    pairs = people.join(head, ["graph_id", "c_mktsegment"]).select("c_custkey", F.col("head").alias("left_name"), F.col("name").alias("right_name"))
    return G.name_compatible(pairs, "left_name", "right_name")


@query(
    "consolidate_apply",
    check("edges", f"""WITH m AS (SELECT 'c' || c_custkey AS node_id, c_nationkey AS graph_id, 'c' || min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, c_custkey // 50) AS canonical FROM customer
      UNION ALL SELECT DISTINCT 's' || s_suppkey, g.graph_id, 's' || (s_suppkey // 2 * 2) FROM supplier, (SELECT DISTINCT graph_id FROM edges) g),
      r AS (SELECT e.graph_id, e.edge_id, coalesce(s.canonical, e.src) AS src, coalesce(t.canonical, e.dst) AS dst, type, {NORM('evidence')} AS ev FROM edges e
        LEFT JOIN m s ON e.graph_id = s.graph_id AND e.src = s.node_id LEFT JOIN m t ON e.graph_id = t.graph_id AND e.dst = t.node_id)
    SELECT graph_id, edge_id, src, dst, type FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, src, dst, type, ev ORDER BY edge_id) AS rn FROM r WHERE src <> dst) z WHERE rn = 1"""),
)
def consolidate_apply(spark, sf):
    edges = edges_of(spark, sf).select("graph_id", "edge_id", "src", "dst", "type", "evidence")
    c = table(spark, sf, "customer").withColumn("part", F.floor(F.col("c_custkey") / 50))
    head = c.groupBy("c_nationkey", "c_mktsegment", "part").agg(F.min("c_custkey").alias("head"))
    people = c.join(head, ["c_nationkey", "c_mktsegment", "part"]).select(
        F.col("c_nationkey").alias("graph_id"), key_of("c", "c_custkey").alias("node_id"), key_of("c", "head").alias("canonical")
    )
    number = F.substring("dst", 2, 20).cast("long")
    vendors = edges.filter("dst like 's%'").select("graph_id", F.col("dst").alias("node_id"), F.concat(F.lit("s"), (number - number % 2).cast("string")).alias("canonical")).distinct()
    return G.merged_graph(edges, people.unionByName(vendors), ["edge_id"], texts=False).select("graph_id", "edge_id", "src", "dst", "type")


DEG = "deg AS (SELECT graph_id, node_id, count(*) AS degree FROM (SELECT graph_id, src AS node_id FROM edges UNION ALL SELECT graph_id, dst FROM edges) e GROUP BY ALL)"


@query(
    "person_candidates",
    check("nodes edges", f"""WITH {DEG} SELECT graph_id, node_id, degree, salience, rank FROM (SELECT n.graph_id, n.node_id, coalesce(degree, 0) AS degree, salience,
      row_number() OVER (PARTITION BY n.graph_id ORDER BY coalesce(degree, 0) DESC, salience DESC, n.node_id) AS rank FROM nodes n LEFT JOIN deg USING (graph_id, node_id)
      WHERE type = 'person' AND (coalesce(degree, 0) > 0 OR salience >= 3)) r WHERE rank <= 20"""),
)
def person_candidates(spark, sf):
    return G.person_candidates(nodes_of(spark, sf), edges_of(spark, sf), 20).select("graph_id", "node_id", "degree", "salience", "rank")


# -- metrics -----------------------------------------------------------------------------
MET_SQL = f"""{ALL_EDGES}, ok AS (SELECT e.* FROM all_edges e JOIN nodes s ON e.graph_id = s.graph_id AND e.src = s.node_id JOIN nodes t ON e.graph_id = t.graph_id AND e.dst = t.node_id),
  lk AS (SELECT DISTINCT graph_id, node_id FROM (SELECT graph_id, src AS node_id FROM ok UNION ALL SELECT graph_id, dst FROM ok) a),
  met AS (SELECT n.*, coalesce(e.edges, 0) AS edges, coalesce(o.valid_edges, 0) AS valid_edges, coalesce(o.self_loops, 0) AS self_loops, coalesce(e.edges, 0) - coalesce(o.valid_edges, 0) AS dangling,
      isolates / nodes AS isolate_rate, coalesce(e.edges, 0) / nodes AS edge_node_ratio FROM (
    SELECT s.graph_id, count(*) AS nodes, count(*) FILTER (lk.node_id IS NULL) AS isolates, count(*) FILTER (mention_count = 0) AS ungrounded,
      count(*) FILTER (mention_count = 0 AND lk.node_id IS NULL) AS ungrounded_isolates FROM nodes s LEFT JOIN lk USING (graph_id, node_id) GROUP BY 1) n
    LEFT JOIN (SELECT graph_id, count(*) AS edges FROM all_edges GROUP BY 1) e USING (graph_id)
    LEFT JOIN (SELECT graph_id, count(*) AS valid_edges, count(*) FILTER (src = dst) AS self_loops FROM ok GROUP BY 1) o USING (graph_id))"""
ROUNDED = "round(isolate_rate, 6) AS isolate_rate, round(edge_node_ratio, 6) AS edge_node_ratio"


def metrics_of(spark, sf):
    return G.graph_metrics(nodes_of(spark, sf), with_ghosts(spark, sf))


@query(
    "graph_metrics",
    check("nodes edges", f"""WITH {MET_SQL} SELECT r_name, graph_id, sum(nodes)::BIGINT AS nodes, sum(edges)::BIGINT AS edges, sum(valid_edges)::BIGINT AS valid_edges, sum(dangling)::BIGINT AS dangling,
      sum(isolates)::BIGINT AS isolates, round(sum(isolates) / sum(nodes), 6) AS isolate_rate, round(sum(edges) / sum(nodes), 6) AS edge_node_ratio
    FROM met JOIN nation ON graph_id = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, graph_id)"""),
)
def graph_metrics(spark, sf):
    """Per graph, per region and overall."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    m = metrics_of(spark, sf)
    j = m.join(n, m.graph_id == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    total = lambda c: F.sum(c).alias(c)
    out = j.rollup("r_name", "graph_id").agg(*[total(c) for c in ("nodes", "edges", "valid_edges", "dangling", "isolates")])
    ratio = lambda a: F.round(F.col(a) / F.col("nodes"), 6)
    return out.withColumn("isolate_rate", ratio("isolates")).withColumn("edge_node_ratio", ratio("edges"))


@query(
    "graph_quality",
    check("nodes edges", f"""WITH {MET_SQL}, {KEPT_SQL}, ppl AS (SELECT graph_id, count(*) AS candidate_persons FROM nodes WHERE type = 'person' GROUP BY 1),
      x AS (SELECT met.*, dropped, deduplicated, candidate_persons, deduplicated AS merged_nodes FROM met JOIN totals USING (graph_id) JOIN ppl USING (graph_id)),
      y AS (SELECT *, dropped / (edges + dropped + deduplicated) AS dropped_rate FROM x)
    SELECT graph_id, {ROUNDED}, round(dropped_rate, 6) AS dropped_rate,
      array_to_string(list_filter([CASE WHEN isolate_rate > 0.05 THEN 'isolate_rate' END, CASE WHEN edge_node_ratio < 2.5 THEN 'edge_node_ratio' END,
        CASE WHEN dropped_rate > 0.4 THEN 'dropped_relation_rate' END, CASE WHEN dangling > 0 THEN 'dangling_edges' END,
        CASE WHEN ungrounded_isolates > 0 THEN 'ungrounded_isolates' END], lambda v: v IS NOT NULL), ',') AS failures,
      array_to_string(list_filter([CASE WHEN candidate_persons >= 80 AND merged_nodes = 0 THEN 'no merges' END, CASE WHEN ungrounded > 0 THEN 'ungrounded_nodes' END], lambda v: v IS NOT NULL), ',') AS warnings,
      isolate_rate <= 0.05 AND edge_node_ratio >= 2.5 AND dropped_rate <= 0.4 AND dangling = 0 AND ungrounded_isolates = 0 AS passed
    FROM y"""),
)
def graph_quality(spark, sf):
    people = nodes_of(spark, sf).filter("type = 'person'").groupBy("graph_id").agg(F.count(F.lit(1)).alias("candidate_persons"))
    totals = totals_of(spark, sf).select("graph_id", "dropped", "deduplicated", F.col("deduplicated").alias("merged_nodes"))
    m = metrics_of(spark, sf).join(totals, "graph_id").join(people, "graph_id")
    out = G.quality_gate(m, 0.05, 2.5, 0.4)
    return out.select(
        "graph_id", *[F.round(c, 6).alias(c) for c in ("isolate_rate", "edge_node_ratio", "dropped_rate")],
        F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"), "passed",
    )


@query(
    "mask_graph",
    check("nodes edges", """WITH m AS (SELECT * FROM nodes WHERE coalesce(CASE WHEN salience = 5 THEN NULL ELSE text_pos END, 1.0) <= 0.5)
    SELECT e.graph_id, e.edge_id, e.src, e.dst FROM edges e JOIN m a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN m b ON b.graph_id = e.graph_id AND b.node_id = e.dst"""),
)
def mask_graph(spark, sf):
    known = nodes_of(spark, sf).withColumn("text_pos", F.when(F.col("salience") < 5, F.col("text_pos")))
    return G.valid_edges(edges_of(spark, sf), G.masked_nodes(known, 0.5)).select("graph_id", "edge_id", "src", "dst")


def text_graph(spark, sf):
    """One graph per document: a node per line with two evidence texts, an edge to the next line."""
    lines = relation(spark, sf, "lines")
    total = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = lines.join(total, "doc_id").withColumnRenamed("doc_id", "graph_id")
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    nodes = rows.select(
        "graph_id", node(F.col("seq")).alias("node_id"), F.left("text", F.lit(12)).alias("name"), F.right("text", F.lit(12)).alias("alias"),
        F.array(F.substring("text", 1, 40), F.substring("text", 10, 30)).alias("evidence"), ((F.col("seq") + 1) / F.col("n")).alias("text_pos"),
        (F.col("seq") / F.col("n")).alias("line_pos"), F.col("text").alias("description"),
    )
    edges = rows.filter("seq + 1 < n").select(
        "graph_id", node(F.col("seq")).alias("src"), node(F.col("seq") + 1).alias("dst"), F.substring("text", 5, 50).alias("evidence"), F.lit("supports").alias("type")
    )
    half = docs(spark, sf).select(
        F.col("doc_id").alias("graph_id"), F.left("text", F.floor(F.length("text") / 2).cast("int")).alias("visible"),
        (F.floor(F.length("text") / 2) / F.greatest(F.length("text"), F.lit(1))).alias("visible_ratio"),
    )
    return nodes, edges, half


STRICT_SQL = f"""WITH v AS (SELECT doc_id, {NORM('left(text, length(text) // 2)')} AS v, (length(text) // 2) / greatest(length(text), 1) AS ratio FROM documents),
  t AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1),
  k AS (SELECT l.doc_id, seq, n, v, {NORM('substr(l.text, 1, 40)')} <> '' AND contains(v, {NORM('substr(l.text, 1, 40)')}) AS e1, {NORM('substr(l.text, 10, 30)')} <> '' AND contains(v, {NORM('substr(l.text, 10, 30)')}) AS e2,
    substr(l.text, 1, 40) AS t1, substr(l.text, 10, 30) AS t2, (seq + 1) / n <= ratio AS early, {NORM('substr(l.text, 5, 50)')} AS ev FROM lines l JOIN t USING (doc_id) JOIN v USING (doc_id)),
  kept AS (SELECT *, CASE WHEN e1 AND e2 THEN t1 || ' ' || t2 WHEN e1 THEN t1 WHEN e2 THEN t2 ELSE '' END AS description FROM k WHERE e1 OR e2 OR early)"""


@query(
    "mask_graph_strict",
    check("lines", f"""{STRICT_SQL} SELECT 'node' AS kind, doc_id AS graph_id, 'n' || seq AS a, '' AS b, description AS detail FROM kept
    UNION ALL SELECT 'edge', x.doc_id, 'n' || x.seq, 'n' || y.seq, '' FROM kept x JOIN kept y ON x.doc_id = y.doc_id AND y.seq = x.seq + 1 WHERE x.ev <> '' AND contains(x.v, x.ev)"""),
)
def mask_graph_strict(spark, sf):
    nodes, edges = G.strict_mask(*text_graph(spark, sf))
    empty = F.lit("")
    return nodes.select(F.lit("node").alias("kind"), "graph_id", F.col("node_id").alias("a"), empty.alias("b"), F.col("description").alias("detail")).unionByName(
        edges.select(F.lit("edge").alias("kind"), "graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), empty.alias("detail"))
    )


@query("simple_graph", check("edges", "SELECT DISTINCT graph_id, least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst"))
def simple_graph(spark, sf):
    return G.simple_pairs(edges_of(spark, sf))


def core_sql(rounds: int) -> str:
    steps = ["c0 AS (SELECT DISTINCT graph_id, least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst)"]
    for i in range(rounds):
        deg = f"(SELECT graph_id, node FROM (SELECT graph_id, a AS node FROM c{i} UNION ALL SELECT graph_id, b FROM c{i}) u GROUP BY ALL HAVING count(*) >= 2)"
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.* FROM c{i} c JOIN {deg} x ON c.graph_id = x.graph_id AND c.a = x.node JOIN {deg} y ON c.graph_id = y.graph_id AND c.b = y.node)")
    return ", ".join(steps)


def sparse_core(spark, sf):
    return I.k_core(G.simple_pairs(edges_of(spark, sf)), ["graph_id"], 2)


@query("k_core", check("edges", f"WITH {core_sql(40)} SELECT graph_id, a, b FROM c40"))
def k_core(spark, sf):
    return sparse_core(spark, sf)


@query(
    "core_enrichment",
    check("nodes edges", f"""WITH {core_sql(40)}, core AS (SELECT DISTINCT graph_id, node_id FROM (SELECT graph_id, a AS node_id FROM c40 UNION ALL SELECT graph_id, b FROM c40) u),
      per AS (SELECT n.graph_id, count(*) AS nodes, count(c.node_id) AS core, count(*) FILTER (mention_count = 0) AS gold, count(c.node_id) FILTER (mention_count = 0) AS gold_core
        FROM nodes n LEFT JOIN core c USING (graph_id, node_id) GROUP BY 1),
      s AS (SELECT sum(gold)::BIGINT AS gold_total, sum(gold_core)::BIGINT AS gold_dense, sum(nodes - gold)::BIGINT AS other_total, sum(core - gold_core)::BIGINT AS other_dense,
        avg(gold_core / gold) AS gold_rate_macro FROM per)
    SELECT gold_total, gold_dense, other_total, other_dense, round(gold_rate_macro, 6) AS gold_rate_macro, round(gold_dense / gold_total, 6) AS gold_rate, round(other_dense / other_total, 6) AS other_rate,
      round((gold_dense / gold_total) / (other_dense / other_total), 6) AS enrichment,
      round((gold_dense + 0.5) * (other_total - other_dense + 0.5) / ((gold_total - gold_dense + 0.5) * (other_dense + 0.5)), 6) AS odds_ratio FROM s"""),
)
def core_enrichment(spark, sf):
    core = sparse_core(spark, sf)
    members = core.select("graph_id", F.explode(F.array("a", "b")).alias("node_id")).distinct().withColumn("hit", F.lit(1))
    n = nodes_of(spark, sf).join(members, ["graph_id", "node_id"], "left")
    gold = F.col("mention_count") == 0
    per = n.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count("hit").alias("core"), F.count_if(gold).alias("gold"), F.count_if(gold & F.col("hit").isNotNull()).alias("gold_core")
    )
    out = G.core_enrichment(per)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    "dense_region",
    check("nodes edges", f"""WITH {DEG}, p AS (SELECT n.graph_id, n.node_id, coalesce(degree, 0) AS degree, {H("'x' || n.node_id")} % 1000 / 1000.0e0 AS fx, {H("'y' || n.node_id")} % 1000 / 1000.0e0 AS fy,
        {H("'z' || n.node_id")} % 1000 / 1000.0e0 AS fz FROM nodes n LEFT JOIN deg USING (graph_id, node_id)),
      s AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY degree) - 1 AS i, count(*) OVER (PARTITION BY graph_id) AS n, avg(fx) OVER g AS mx, avg(fy) OVER g AS my, avg(fz) OVER g AS mz FROM p WINDOW g AS (PARTITION BY graph_id)),
      c AS (SELECT graph_id, degree AS cut FROM s WHERE i = cast(floor(n * 0.75) AS BIGINT))
    SELECT s.graph_id, node_id, s.degree, round(sqrt((fx - mx) * (fx - mx) + (fy - my) * (fy - my) + (fz - mz) * (fz - mz)), 6) AS distance FROM s JOIN c USING (graph_id)
    WHERE s.degree >= cut AND sqrt((fx - mx) * (fx - mx) + (fy - my) * (fy - my) + (fz - mz) * (fz - mz)) <= 0.45"""),
)
def dense_region(spark, sf):
    at = lambda p: hash_mod(key_of(p, "node_id"), 1000) / 1000
    n = nodes_of(spark, sf).join(G.degrees(edges_of(spark, sf)), ["graph_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    n = n.select("graph_id", "node_id", "degree", at("x").alias("fx"), at("y").alias("fy"), at("z").alias("fz"))
    return G.dense_region(n).select("graph_id", "node_id", "degree", F.round("distance", 6).alias("distance"))


# -- reading off the graph ------------------------------------------------------------------
@query(
    "suspect_chain",
    check("nodes edges", f"""WITH hit AS (SELECT e.graph_id, e.src, n.name, e.edge_id, e.type, e.confidence, confidence * CASE WHEN decoy THEN 0.3e0 ELSE 1.0e0 END * greatest(importance, 1) / 3.0e0 AS w
        FROM edges e JOIN nodes n ON e.graph_id = n.graph_id AND e.src = n.node_id WHERE n.type = 'person' AND e.type IN ({quoted(K.SUSPECT_EDGE_TYPES)})
          AND n.node_id <> (SELECT min(v.node_id) FROM nodes v WHERE v.graph_id = n.graph_id AND v.type = 'person')),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, src) AS rank FROM (
        SELECT graph_id, src, name, round(sum(w), 6) AS score FROM hit GROUP BY ALL) s) r WHERE rank <= 4)
    SELECT b.graph_id, b.src, b.name, b.rank, b.score, h.edge_id, h.type, h.erank FROM best b JOIN (SELECT *, row_number() OVER (PARTITION BY graph_id, src ORDER BY confidence DESC, edge_id) AS erank FROM hit) h
      ON h.graph_id = b.graph_id AND h.src = b.src AND erank <= 4"""),
)
def suspect_chain(spark, sf):
    """The first person of each graph is the victim; names are unique here."""
    n = nodes_of(spark, sf)
    victims = n.filter("type = 'person'").groupBy("graph_id").agg(F.upper(F.min_by("name", "node_id")).alias("victim"))
    best, proof = G.suspect_chain(n, edges_of(spark, sf), victims=victims)
    return proof.join(best.select("graph_id", "src", "score"), ["graph_id", "src"]).select(
        "graph_id", "src", "name", F.col("person_rank").alias("rank"), "score", "edge_id", "type", F.col("rank").alias("erank")
    )


@query(
    "candidate_names",
    check("nodes edges", """WITH t AS (SELECT n.graph_id, n.name, 0 AS tier, n.node_id AS ord FROM edges e JOIN nodes n ON e.graph_id = n.graph_id AND e.src = n.node_id
        WHERE e.dst = (SELECT min(v.dst) FROM edges v WHERE v.graph_id = e.graph_id AND v.type <> 'belongs_to') AND n.type = 'person'
      UNION ALL SELECT graph_id, name, 1, lpad(cast(1000 - text_pos * 1000 AS INT)::VARCHAR, 6, '0') FROM nodes WHERE type = 'person'
      UNION ALL SELECT graph_id, name, 2, node_id FROM nodes WHERE type = 'event'),
      f AS (SELECT graph_id, name, min((tier, ord)) AS k FROM t GROUP BY ALL)
    SELECT graph_id, name, k[1] AS tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY k, name) AS rank FROM f) r WHERE rank <= 6"""),
)
def candidate_names(spark, sf):
    """Neighbours of the victim node, then persons by position, then the remaining targets."""
    n = nodes_of(spark, sf)
    people = n.filter("type = 'person'")
    edges = edges_of(spark, sf)
    victims = edges.filter("type <> 'belongs_to'").groupBy("graph_id").agg(F.min("dst").alias("node_id"))
    t0 = G.victim_neighbours(n, edges, victims)
    place = F.lpad((F.lit(1000) - F.col("text_pos") * 1000).cast("int").cast("string"), 6, "0")
    t1 = people.select("graph_id", "name", F.lit(1).alias("tier"), place.alias("ord"))
    t2 = n.filter("type = 'event'").select("graph_id", "name", F.lit(2).alias("tier"), F.col("node_id").alias("ord"))
    return G.candidate_names(t0.unionByName(t1).unionByName(t2))


@query(
    "confession_rows",
    check("lines", f"""WITH s AS (SELECT doc_id, seq, text || CASE {H("'con' || doc_id || ':' || seq")} % 3 WHEN 0 THEN ' In fact he was there' WHEN 1 THEN ' guiltyish' ELSE '' END AS text FROM lines),
      h AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS b
        FROM s WHERE {words_sql(K.CONFESSION_WORDS, 'text')})
    SELECT doc_id, seq FROM h WHERE a <= 2 OR b <= 2"""),
)
def confession_rows(spark, sf):
    h = hash_mod(F.concat(F.lit("con"), "doc_id", F.lit(":"), "seq"), 3)
    extra = F.when(h == 0, " In fact he was there").when(h == 1, " guiltyish").otherwise("")
    rows = relation(spark, sf, "lines").select("doc_id", "seq", F.concat("text", extra).alias("text"))
    return G.confession_rows(rows, ["doc_id"]).select("doc_id", "seq")


@query(
    "contradiction_edges",
    check("lines", """SELECT l.doc_id, 'ev_' || a.seq AS src, 'te_' || b.seq AS dst, 'contradicts' AS type, 'quality ' || l.quality AS evidence, 0.9e0 AS confidence, 5 AS importance
    FROM labels l JOIN lines a ON a.doc_id = l.doc_id AND a.seq = l.quality * 2 JOIN lines b ON b.doc_id = l.doc_id AND b.seq = l.toxic * 2 + 1"""),
)
def contradiction_edges(spark, sf):
    kind = F.when(F.col("seq") % 2 == 0, "evidence").otherwise("testimony")
    items = relation(spark, sf, "lines").select("doc_id", F.col("seq").alias("number"), kind.alias("kind"))
    lab = table(spark, sf, "labels")
    pairs = lab.select("doc_id", (F.col("quality") * 2).cast("long").alias("evidence"), (F.col("toxic") * 2 + 1).cast("long").alias("testimony"), key_of("quality ", "quality").alias("reason"))
    return G.contradiction_edges(items, pairs)


@query(
    "informative_ratio",
    check("nodes edges", f"""WITH {DEG}, hub AS (SELECT * FROM (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, node_id) AS r FROM deg) d WHERE r <= 8)
    SELECT n.graph_id, count(*) AS picked, round(avg(CASE WHEN type IN ({quoted(K.INFORMATIVE_TYPES)}) AND h.node_id IS NULL THEN 1.0e0 ELSE 0 END), 6) AS informative
    FROM nodes n LEFT JOIN hub h USING (graph_id, node_id) WHERE salience >= 3 GROUP BY 1"""),
)
def informative_ratio(spark, sf):
    n = nodes_of(spark, sf)
    hubs = top_k(G.degrees(edges_of(spark, sf)), ["graph_id"], [F.desc("degree"), F.col("node_id")], 8)
    out = G.informative_ratio(n.filter("salience >= 3").select("graph_id", "node_id"), n, hubs)
    return out.withColumn("informative", F.round("informative", 6))
