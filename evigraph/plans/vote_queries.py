"""Registered queries: votes, routes, gates and held-out selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import cut_lineage, table
from ..functions import constants as K
from ..functions.text import hash_mod
from ..operators import vote as V
from .inputs import METHODS, Dialect, check, relation
from .registry import query

DUCK = Dialect(False)
H = DUCK.h
NAMES = [m for m, _, _ in METHODS]
GRAPH3 = ["graph_a", "graph_b", "graph_c"]
WIDE = "wide AS (SELECT cohort, novel, qid, qtype, unanimous, gold, " + ", ".join(f"max(selected) FILTER (method = '{m}') AS {m}" for m in NAMES) + " FROM answers GROUP BY ALL)"
quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)


def answers(spark, sf):
    return relation(spark, sf, "answers")


def wide_rows(spark, sf):
    return V.wide(answers(spark, sf), NAMES, ["cohort", "novel", "qid", "qtype", "unanimous", "gold"])


def vote_sql(methods, named, keys="qid"):
    """Votes per question with the named tie-break."""
    return f"""SELECT {keys}, arg_max(selected, (n, named, -ascii(selected))) AS winner, max(n) AS votes FROM (
      SELECT {keys}, selected, count(*) AS n, max(CASE WHEN method = '{named}' THEN 1 ELSE 0 END) AS named FROM answers
      WHERE selected IS NOT NULL AND method IN ({quoted(methods)}) GROUP BY ALL) t GROUP BY {keys}"""


FOUR = ["graph_a", "graph_b", "tail", "vector"]


@query("vote_majority", check("answers", vote_sql(FOUR, "tail")))
def vote_majority(spark, sf):
    return V.majority(answers(spark, sf).filter(F.col("method").isin(*FOUR)), ["qid"], "tail")


@query(
    "vote_latest",
    check("answers", f"""SELECT qid, arg_max(selected, (n, late)) AS winner, sum(n)::BIGINT AS "cast" FROM (SELECT qid, selected, count(*) AS n, max(morder) AS late FROM answers
      WHERE selected IS NOT NULL AND method IN ({quoted(FOUR)}) GROUP BY ALL) t GROUP BY qid HAVING sum(n) >= 2"""),
)
def vote_latest(spark, sf):
    return V.latest(answers(spark, sf).filter(F.col("method").isin(*FOUR)), ["qid"])


MAJ3 = "CASE WHEN graph_a = graph_b OR graph_a = graph_c THEN graph_a WHEN graph_b = graph_c THEN graph_b END"


@query("majority_or_fallback", check("answers", f"WITH {WIDE} SELECT qid, coalesce({MAJ3}, tail) AS choice, CASE WHEN {MAJ3} IS NULL THEN 'fallback' ELSE 'majority' END AS route FROM wide"))
def majority_or_fallback(spark, sf):
    choice, route = V.majority_or(GRAPH3, "tail")
    return wide_rows(spark, sf).select("qid", choice.alias("choice"), route.alias("route"))


def agree_sql(a, b, fb):
    return f"SELECT qid, CASE WHEN {a} = {b} THEN {a} ELSE {fb} END AS choice, CASE WHEN {a} = {b} THEN 'agreement' ELSE 'fallback' END AS route"


@query("stability_gate", check("answers", f"WITH {WIDE} {agree_sql('graph_a', 'graph_b', 'tail')} FROM wide"))
def stability_gate(spark, sf):
    choice, route = V.agree_else("graph_a", "graph_b", "tail")
    return wide_rows(spark, sf).select("qid", choice.alias("choice"), route.alias("route"))


@query(
    "agreement_route",
    check("answers", f"WITH {WIDE} {agree_sql('tail', 'graph_expand', 'vector')}, coalesce(tail <> graph_expand AND tail <> vector AND graph_expand <> vector, false) AS all_differ FROM wide"),
)
def agreement_route(spark, sf):
    choice, route = V.agree_else("tail", "graph_expand", "vector")
    three = (F.col("tail") != F.col("graph_expand")) & (F.col("tail") != F.col("vector")) & (F.col("graph_expand") != F.col("vector"))
    return wide_rows(spark, sf).select("qid", choice.alias("choice"), route.alias("route"), F.coalesce(three, F.lit(False)).alias("all_differ"))


@query(
    "consensus_gate",
    check("answers", f"""WITH {WIDE}, v AS ({vote_sql(NAMES[:5], 'graph_a')}) SELECT qid, threshold, CASE WHEN votes >= threshold THEN winner ELSE tail END AS choice
    FROM wide LEFT JOIN v USING (qid), (VALUES (2), (3), (4)) t(threshold)"""),
)
def consensus_gate(spark, sf):
    """Vote of five graph methods where it reaches 2, 3 or 4 voices, else the tail answer."""
    v = V.majority(answers(spark, sf).filter(F.col("method").isin(*NAMES[:5])), ["qid"], "graph_a")
    rows = wide_rows(spark, sf).select("qid", "tail").join(v, "qid", "left").withColumn("threshold", F.explode(F.array(*map(F.lit, (2, 3, 4)))))
    return rows.select("qid", "threshold", F.when(F.col("votes") >= F.col("threshold"), F.col("winner")).otherwise(F.col("tail")).alias("choice"))


def rules():
    """Fixed routes; a rule is a Column over the wide answer row."""
    c = F.col
    either = lambda cond, a, b: F.when(F.coalesce(cond, F.lit(False)), c(a)).otherwise(c(b))
    perm = V.row_majority(GRAPH3, "graph_a")
    return {
        "graph_a": c("graph_a"), "graph_expand": c("graph_expand"),
        "compress_if_unanimous_else_graph_a": either(c("unanimous"), "compress", "graph_a"),
        "vector_if_unanimous_else_graph_a": either(c("unanimous"), "vector", "graph_a"),
        "graph_a_if_unanimous_else_compress": either(c("unanimous"), "graph_a", "compress"),
        "graph_a_if_unanimous_else_vector": either(c("unanimous"), "graph_a", "vector"),
        "graph_a_vector_agree_else_compress": either(c("graph_a") == c("vector"), "graph_a", "compress"),
        "majority_of_five": V.row_majority([*GRAPH3, "compress", "vector"], "graph_a"),
        "expand_agrees_any_else_majority": F.when(V.agrees("graph_expand", *GRAPH3) >= 1, c("graph_expand")).otherwise(perm),
        "expand_agrees_two_else_compress": F.when(V.agrees("graph_expand", *GRAPH3) >= 2, c("graph_expand")).otherwise(c("compress")),
    }


def count_sql(letter, methods):
    return "(" + " + ".join(f"CASE WHEN {m} = '{letter}' THEN 1 ELSE 0 END" for m in methods) + ")"


def row_major_sql(methods, fb):
    counts = {x: count_sql(x, methods) for x in K.LETTERS}
    top = f"greatest({', '.join(counts.values())})"
    lead = " OR ".join(f"({fb} = '{x}' AND {c} = {top})" for x, c in counts.items())
    return f"CASE WHEN {top} = 0 THEN NULL WHEN {lead} THEN {fb} " + " ".join(f"WHEN {c} = {top} THEN '{x}'" for x, c in counts.items()) + " END"


AGREE_N = "(" + " + ".join(f"CASE WHEN graph_expand = {m} THEN 1 ELSE 0 END" for m in GRAPH3) + ")"
RULES = {
    "graph_a": "graph_a", "graph_expand": "graph_expand",
    "compress_if_unanimous_else_graph_a": "CASE WHEN unanimous THEN compress ELSE graph_a END",
    "vector_if_unanimous_else_graph_a": "CASE WHEN unanimous THEN vector ELSE graph_a END",
    "graph_a_if_unanimous_else_compress": "CASE WHEN unanimous THEN graph_a ELSE compress END",
    "graph_a_if_unanimous_else_vector": "CASE WHEN unanimous THEN graph_a ELSE vector END",
    "graph_a_vector_agree_else_compress": "CASE WHEN graph_a = vector THEN graph_a ELSE compress END",
    "majority_of_five": row_major_sql([*GRAPH3, "compress", "vector"], "graph_a"),
    "expand_agrees_any_else_majority": f"CASE WHEN {AGREE_N} >= 1 THEN graph_expand ELSE {row_major_sql(GRAPH3, 'graph_a')} END",
    "expand_agrees_two_else_compress": f"CASE WHEN {AGREE_N} >= 2 THEN graph_expand ELSE compress END",
}
RULED = f"{WIDE}, ruled AS (" + " UNION ALL ".join(f"SELECT novel, qid, gold, '{n}' AS rule, {i} AS priority, {e} AS choice FROM wide" for i, (n, e) in enumerate(RULES.items())) + ")"


def ruled_rows(spark, sf):
    return V.apply_rules(wide_rows(spark, sf), rules()).select("novel", "qid", "gold", "rule", "priority", "choice")


@query("route_rules", check("answers", f"WITH {RULED} SELECT qid, rule, choice FROM ruled"))
def route_rules(spark, sf):
    return ruled_rows(spark, sf).select("qid", "rule", "choice")


# what the conditions of the routes look at, besides the answers
FEATURES = {"graph_only_chunks": 6, "valid_relations": 12, "links": 12, "removed": 6}
AGREEING = ["graph_a", "graph_c", "graph_gate"]
VOTES = {
    "perm3": (GRAPH3, "graph_a"), "graph5": ([*GRAPH3, "graph_gate", "graph_expand"], "graph_expand"), "with_both": ([*GRAPH3, "compress", "vector"], "graph_a"),
    "with_compress": ([*GRAPH3, "compress"], "graph_a"), "with_vector": ([*GRAPH3, "vector"], "graph_a"),
}
ROUTE_ROWS = f"""{WIDE}, hi AS (SELECT qid, confidence = 'high' AS high FROM answers WHERE method = 'graph_expand'),
  rr AS (SELECT wide.*, high, {' + '.join(f"CASE WHEN graph_expand = {m} THEN 1 ELSE 0 END" for m in AGREEING)} AS agreeing, coalesce(graph_a = graph_b AND graph_b = graph_c, false) AS stable,
    {', '.join(f"{H(chr(39) + f + chr(39) + ' || qid')} % {n} AS {f}" for f, n in FEATURES.items())}, {H("'rag_overlap' || qid")} % 100 / 100.0e0 AS rag_overlap, {H("'margin' || qid")} % 9 - 4 AS margin,
    {', '.join(f'{row_major_sql(m, fb)} AS {n}' for n, (m, fb) in VOTES.items())} FROM wide JOIN hi USING (qid))"""
ROUTES_SQL = " UNION ALL ".join(
    f"SELECT qid, '{study}' AS study, '{name}' AS rule, CASE WHEN {cond} THEN {then} ELSE {other} END AS choice FROM rr"
    for study, rows in K.ROUTE_TABLES.items() for name, cond, then, other in rows
)


@query("route_tables", check("answers", f"WITH {ROUTE_ROWS} {ROUTES_SQL}"))
def route_tables(spark, sf):
    """The routes of four studies on every question."""
    a = answers(spark, sf)
    high = a.filter("method = 'graph_expand'").select("qid", (F.col("confidence") == "high").alias("high"))
    number = lambda name, n: hash_mod(F.concat(F.lit(name), "qid"), n)
    rows = wide_rows(spark, sf).join(high, "qid").withColumn("agreeing", V.agrees("graph_expand", *AGREEING))
    same = F.coalesce((F.col("graph_a") == F.col("graph_b")) & (F.col("graph_b") == F.col("graph_c")), F.lit(False))
    rows = rows.withColumns({"stable": same, "rag_overlap": number("rag_overlap", 100) / 100, "margin": number("margin", 9) - 4} | {f: number(f, n) for f, n in FEATURES.items()})
    rows = rows.withColumns({n: V.row_majority(m, fb) for n, (m, fb) in VOTES.items()})
    return V.route_tables(rows, K.ROUTE_TABLES).select("qid", "study", "rule", "choice")


REL = """rel AS (SELECT t.qtype, t.method, 0.75e0 * g + 0.25e0 * (t.c + 2 * g) / (t.n + 2) AS weight FROM
  (SELECT qtype, method, sum(correct) AS c, count(*) AS n FROM answers GROUP BY ALL) t JOIN (SELECT method, (sum(correct) + 1) / (count(*) + 2) AS g FROM answers GROUP BY ALL) o USING (method))"""


@query("reliability", check("answers", f"WITH {REL} SELECT qtype, method, round(weight, 6) AS weight FROM rel"))
def reliability(spark, sf):
    return V.reliability(answers(spark, sf), 0.25).withColumn("weight", F.round("weight", 6))


def weighted_sql(rows, fb, keys="novel, qid, gold"):
    """Weighted vote over rows(keys, method, selected, weight)."""
    return f"""SELECT {keys}, arg_max(selected, (s, named, -ascii(selected))) AS winner, max(s) - coalesce(max(s) FILTER (rk = 2), 0) AS margin FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY s DESC) AS rk FROM (SELECT {keys}, selected, round(sum(weight), 9) AS s, max(CASE WHEN method = '{fb}' THEN 1 ELSE 0 END) AS named
        FROM {rows} WHERE selected IS NOT NULL GROUP BY ALL) a) b GROUP BY {keys}"""


@query("weighted_vote", check("answers", f"WITH {REL}, w AS (SELECT a.*, weight FROM answers a JOIN rel USING (qtype, method)) SELECT qid, winner, round(margin, 6) AS margin FROM ({weighted_sql('w', 'graph_a')}) z"))
def weighted_vote(spark, sf):
    a = answers(spark, sf)
    rows = a.join(V.reliability(a, 0.25), ["qtype", "method"])
    return V.weighted_vote(rows, V.Q, "graph_a").select("qid", "winner", F.round("margin", 6).alias("margin"))


# held-out sums written out the long way: every other group is joined explicitly
TRAIN = """grp AS (SELECT DISTINCT novel FROM answers), mc AS (SELECT novel, qtype, method, morder, sum(correct) AS c, count(*) AS n FROM answers GROUP BY ALL),
  tr AS (SELECT g.novel, m.method, m.morder, sum(m.c) AS c, sum(m.n) AS n FROM grp g JOIN mc m ON m.novel <> g.novel GROUP BY ALL),
  kinds AS (SELECT DISTINCT qtype, method, morder FROM answers),
  trt AS (SELECT g.novel, k.qtype, k.method, k.morder, coalesce(sum(m.c), 0) AS c, coalesce(sum(m.n), 0) AS n FROM grp g CROSS JOIN kinds k LEFT JOIN mc m ON m.novel <> g.novel AND m.qtype = k.qtype AND m.method = k.method GROUP BY ALL)"""


@query(
    "logo_best",
    check("answers", f"""WITH {TRAIN}, b AS (SELECT novel, arg_max(method, ((c + 2.0) / (n + 8.0), -morder)) AS method FROM tr GROUP BY novel)
    SELECT a.qid, a.method, a.selected, a.correct FROM answers a JOIN b USING (novel, method)"""),
)
def logo_best(spark, sf):
    return V.best_method_held_out(answers(spark, sf), by_type=False).select("qid", "method", "selected", "correct")


@query(
    "logo_type",
    check("answers", f"""WITH {TRAIN}, b AS (SELECT novel, qtype, arg_max(method, (CASE WHEN n = 0 THEN 0.25 ELSE (c + 2.0) / (n + 8.0) END, -morder)) AS method FROM trt GROUP BY ALL)
    SELECT a.qid, a.method, a.selected, a.correct FROM answers a JOIN b USING (novel, qtype, method)"""),
)
def logo_type(spark, sf):
    return V.best_method_held_out(answers(spark, sf), by_type=True).select("qid", "method", "selected", "correct")


@query(
    "logo_router",
    check("answers", f"""WITH {TRAIN}, b AS (SELECT novel, qtype, arg_max(t.method, (CASE WHEN t.n >= 5 THEN t.c / t.n ELSE r.c / r.n END, -t.morder)) AS method FROM trt t JOIN tr r USING (novel, method) GROUP BY ALL)
    SELECT a.qid, a.method, a.selected, a.correct FROM answers a JOIN b USING (novel, qtype, method)"""),
)
def logo_router(spark, sf):
    return V.routed_by_type(answers(spark, sf)).select("qid", "method", "selected", "correct")


@query(
    "logo_weighted",
    check("answers", f"""WITH {TRAIN}, w AS (SELECT a.*, greatest((t.c + 2.0) / (t.n + 8.0) - 0.25, 0) AS weight FROM answers a JOIN tr t USING (novel, method))
    SELECT qid, winner FROM ({weighted_sql('w', 'graph_gate')}) z"""),
)
def logo_weighted(spark, sf):
    return V.weighted_held_out(answers(spark, sf), "graph_gate").select("qid", "winner")


SIX = ["graph_expand", "graph_a", "graph_c", "graph_gate", "compress", "vector"]


@query(
    "confidence_vote",
    check("answers", f"""WITH {TRAIN}, sure AS (SELECT g.novel, (count(*) FILTER (a.correct = 1) + 1) / (count(a.qid) + 2) AS sure FROM grp g
        LEFT JOIN (SELECT * FROM answers WHERE method = 'graph_expand' AND confidence = 'high') a ON a.novel <> g.novel GROUP BY 1),
      w AS (SELECT a.*, CASE WHEN method = 'graph_expand' AND confidence = 'high' THEN sure ELSE (t.c + 1) / (t.n + 2) END AS weight FROM answers a JOIN tr t USING (novel, method) JOIN sure USING (novel) WHERE method IN ({quoted(SIX)}))
    SELECT qid, winner, round(margin, 6) AS margin FROM ({weighted_sql('w', 'graph_expand')}) z"""),
)
def confidence_vote(spark, sf):
    """Weights from the other groups; sure answers of the lead method weigh by how often such answers are right."""
    out = V.confidence_vote_held_out(answers(spark, sf), "graph_expand", SIX)
    return out.select("qid", "winner", F.round("margin", 6).alias("margin"))


@query(
    "logo_rule",
    check("answers", f"""WITH {RULED}, s AS (SELECT *, CASE WHEN choice = gold THEN 1 ELSE 0 END AS hit FROM ruled), rc AS (SELECT novel, rule, priority, sum(hit) AS c FROM s GROUP BY ALL),
      b AS (SELECT novel, arg_max(rule, (c, -priority)) AS rule FROM (SELECT g.novel, r.rule, r.priority, sum(r.c) AS c FROM (SELECT DISTINCT novel FROM s) g JOIN rc r ON r.novel <> g.novel GROUP BY ALL) t GROUP BY novel)
    SELECT s.qid, s.rule, s.choice, s.hit FROM s JOIN b USING (novel, rule)"""),
)
def logo_rule(spark, sf):
    return V.best_rule_held_out(ruled_rows(spark, sf)).select("qid", "rule", "choice", "hit")


BASE = ["tail", "compress", "question_only"]


@query(
    "threshold_combine",
    check("answers", f"""WITH {TRAIN}, b AS (SELECT novel, arg_max(method, (c / n, -morder)) FILTER (method IN ({quoted(NAMES[:5])})) AS a, max(c / n) FILTER (method IN ({quoted(NAMES[:5])})) AS av,
        arg_max(method, (c / n, -morder)) FILTER (method IN ({quoted(BASE)})) AS b, max(c / n) FILTER (method IN ({quoted(BASE)})) AS bv FROM tr GROUP BY novel)
    SELECT x.qid, x.method, x.selected, x.correct FROM answers x JOIN b ON x.novel = b.novel AND x.method = CASE WHEN round(av - bv, 9) >= 0.05 THEN b.a ELSE b.b END"""),
)
def threshold_combine(spark, sf):
    return V.combine_if_better(answers(spark, sf), NAMES[:5], BASE).select("qid", "method", "selected", "correct")


GATE_ROWS = f"""gr AS (SELECT novel, qid, gold, graph_gate AS first, tail AS fallback, {H("'g1' || qid")} % 7 AS evidence, {H("'g2' || qid")} % 4 AS support,
    {' + '.join(f'CASE WHEN graph_gate = {m} THEN 1 ELSE 0 END' for m in ['graph_a', 'graph_b', 'graph_c', 'graph_expand'])} AS agree, {H("'g3' || qid")} % 3 AS confidence,
    CASE WHEN graph_gate = compress THEN 1 ELSE 0 END AS third FROM wide)"""


def gate_rows(spark, sf):
    key = lambda p: F.concat(F.lit(p), F.col("qid").cast("string"))
    w = wide_rows(spark, sf)
    return w.select(
        "novel", "qid", "gold", F.col("graph_gate").alias("first"), F.col("tail").alias("fallback"), hash_mod(key("g1"), 7).alias("evidence"), hash_mod(key("g2"), 4).alias("support"),
        V.agrees("graph_gate", "graph_a", "graph_b", "graph_c", "graph_expand").alias("agree"), hash_mod(key("g3"), 3).alias("confidence"), V.agrees("graph_gate", "compress").alias("third"),
    )


@query(
    "gate_grid",
    check("answers", f"""WITH {WIDE}, {GATE_ROWS}, grid AS (SELECT e, s, a, c, t FROM range(7) x1(e), range(4) x2(s), range(5) x3(a), range(3) x4(c), range(2) x5(t)),
      rc AS (SELECT g.*, novel, sum(CASE WHEN CASE WHEN evidence >= e AND support >= s AND agree >= a AND confidence >= c AND third >= t THEN first ELSE fallback END = gold THEN 1 ELSE 0 END) AS ok,
        sum(CASE WHEN evidence >= e AND support >= s AND agree >= a AND confidence >= c AND third >= t AND first IS DISTINCT FROM fallback THEN 1 ELSE 0 END) AS sw FROM gr CROSS JOIN grid g GROUP BY ALL),
      tt AS (SELECT e, s, a, c, t, sum(ok) AS ok, sum(sw) AS sw FROM rc GROUP BY ALL),
      b AS (SELECT r.novel, arg_max((r.e, r.s, r.a, r.c, r.t), (tt.ok - r.ok, -(tt.sw - r.sw), r.e + r.s + r.a + r.c, r.t, r.e, r.s, r.a, r.c, r.t)) AS g FROM rc r JOIN tt USING (e, s, a, c, t) GROUP BY r.novel)
    SELECT qid, g[1] AS min_evidence, g[2] AS min_support, g[3] AS min_agree, g[4] AS min_confidence, g[5] AS min_third,
      CASE WHEN evidence >= g[1] AND support >= g[2] AND agree >= g[3] AND confidence >= g[4] AND third >= g[5] THEN first ELSE fallback END AS choice FROM gr JOIN b USING (novel)"""),
)
def gate_grid(spark, sf):
    rows = cut_lineage(gate_rows(spark, sf))
    out = V.apply_gate(rows, V.gate_grid(rows))
    return out.select("qid", *[f"min_{n}" for n in V.GATE], "choice")


BLENDS = [0.0, 0.25, 0.5, 0.75, 1.0]
BLEND_SQL = f"""old AS (SELECT * FROM answers WHERE cohort = 'old' AND method IN ({quoted(GRAPH3)})), new AS (SELECT * FROM answers WHERE cohort = 'new' AND method IN ({quoted(GRAPH3)})),
  grp AS (SELECT DISTINCT novel FROM old), kinds AS (SELECT DISTINCT qtype, method FROM old), bl AS (SELECT unnest([0.0e0, 0.25e0, 0.5e0, 0.75e0, 1.0e0]) AS blend),
  g AS (SELECT p.novel, o.method, (sum(o.correct) + 1) / (count(*) + 2) AS g FROM grp p JOIN old o ON o.novel <> p.novel GROUP BY ALL),
  t AS (SELECT p.novel, k.qtype, k.method, coalesce(sum(o.correct), 0) AS c, count(o.qid) AS n FROM grp p CROSS JOIN kinds k LEFT JOIN old o ON o.novel <> p.novel AND o.qtype = k.qtype AND o.method = k.method GROUP BY ALL),
  w AS (SELECT o.*, blend, (1 - blend) * g + blend * (t.c + 2 * g) / (t.n + 2) AS weight FROM old o JOIN g USING (novel, method) JOIN t USING (novel, qtype, method), bl),
  cv AS (SELECT blend, sum(CASE WHEN winner = gold THEN 1 ELSE 0 END) AS correct FROM ({weighted_sql('w', 'graph_a', 'blend, novel, qid, gold')}) z GROUP BY blend),
  best AS (SELECT arg_max(blend, (correct, -blend)) AS blend FROM cv),
  og AS (SELECT method, (sum(correct) + 1) / (count(*) + 2) AS g FROM old GROUP BY ALL),
  fr AS (SELECT qtype, method, (1 - blend) * g + blend * (sum(correct) + 2 * g) / (count(*) + 2) AS weight FROM old JOIN og USING (method), best GROUP BY qtype, method, g, blend),
  nw AS (SELECT n.*, coalesce(f.weight, og.g) AS weight FROM new n JOIN og USING (method) LEFT JOIN fr f USING (qtype, method))
  SELECT z.qid, b.blend, z.winner, round(z.margin, 6) AS margin FROM ({weighted_sql('nw', 'graph_a')}) z, best b"""


@query("blend_select", check("answers", f"WITH {BLEND_SQL}"))
def blend_select(spark, sf):
    """Blend chosen on the old cohort by held-out votes, then frozen for the new cohort."""
    three = answers(spark, sf).filter(F.col("method").isin(*GRAPH3))
    old, new = three.filter("cohort = 'old'"), three.filter("cohort = 'new'")
    best = V.blend_scores(old, "graph_a", BLENDS).agg(F.max_by("blend", F.struct("correct", -F.col("blend"))).alias("blend"))
    overall = old.groupBy("method").agg(((F.sum("correct") + 1) / (F.count(F.lit(1)) + 2)).alias("g"))
    by_type = old.groupBy("qtype", "method").agg(F.sum("correct").alias("c"), F.count(F.lit(1)).alias("n"))
    rows = new.join(overall, "method").join(by_type, ["qtype", "method"], "left").withColumn("blend", best.scalar())
    local = (F.coalesce("c", F.lit(0)) + 2 * F.col("g")) / (F.coalesce("n", F.lit(0)) + 2)
    rows = rows.withColumn("weight", (1 - F.col("blend")) * F.col("g") + F.col("blend") * local)
    return V.weighted_vote(rows, ["blend", *V.Q], "graph_a").select("qid", "blend", "winner", F.round("margin", 6).alias("margin"))


VERDICT = f"""SELECT doc_id AS qid, letter AS candidate, ascii(letter) AS ord, CASE {H("'v' || doc_id || letter")} % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'refute' ELSE 'unknown' END AS verdict,
  {H("'w' || doc_id || letter")} % 100 / 100.0e0 AS confidence FROM labels, (VALUES ('A'),('B'),('C'),('D')) v(letter)"""


def letters_of(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), F.explode(F.array(*map(F.lit, K.LETTERS))).alias("candidate"))


def picked(words, n):
    return F.get(F.array(*map(F.lit, words)), n.cast("int"))


@query(
    "verdict_best",
    f"""SELECT qid, round(score, 6) AS score, CASE WHEN score > 0.3 THEN best END AS best FROM (SELECT qid, max(s) AS score, arg_max(candidate, (s, -ord)) AS best FROM (
      SELECT *, CASE verdict WHEN 'support' THEN confidence WHEN 'refute' THEN -confidence ELSE 0 END AS s FROM ({VERDICT}) v) a GROUP BY qid) b""",
)
def verdict_best(spark, sf):
    key = lambda p: F.concat(F.lit(p), "qid", "candidate")
    rows = letters_of(spark, sf).select(
        "qid", "candidate", F.ascii("candidate").alias("ord"), picked(["support", "refute", "unknown"], hash_mod(key("v"), 3)).alias("verdict"), (hash_mod(key("w"), 100) / 100).alias("confidence")
    )
    return V.best_candidate(rows, ["qid"]).select("qid", F.round("score", 6).alias("score"), "best")


OBLIG = f"""ob AS (SELECT doc_id AS qid, letter AS candidate, ord, CASE {H("'ov' || doc_id || letter || ord")} % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'violated' ELSE 'open' END AS verdict,
  {H("'oc' || doc_id || letter || ord")} % 90 / 100.0e0 AS confidence FROM labels, (VALUES ('A'),('B'),('C'),('D')) v(letter), (VALUES (1),(2),(3)) o(ord)),
  st AS (SELECT qid, candidate, min(ord) AS stop, arg_min(verdict, ord) AS fin FROM ob WHERE confidence >= 0.6 AND verdict <> 'open' GROUP BY ALL)
  SELECT o.qid, o.candidate, CASE fin WHEN 'supported' THEN 'accepted' WHEN 'violated' THEN 'rejected' ELSE 'unknown' END AS state,
    round(sum(CASE verdict WHEN 'supported' THEN confidence WHEN 'violated' THEN -confidence ELSE 0 END) + CASE fin WHEN 'supported' THEN 0.5 WHEN 'violated' THEN -0.5 ELSE 0 END, 3) AS score
  FROM ob o LEFT JOIN st s ON s.qid = o.qid AND s.candidate = o.candidate WHERE stop IS NULL OR ord <= stop GROUP BY o.qid, o.candidate, fin"""


@query("obligation_score", f"WITH {OBLIG}")
def obligation_score(spark, sf):
    rows = letters_of(spark, sf).withColumn("ord", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    key = lambda p: F.concat(F.lit(p), "qid", "candidate", "ord")
    rows = rows.withColumn("verdict", picked(["supported", "violated", "open"], hash_mod(key("ov"), 3))).withColumn("confidence", hash_mod(key("oc"), 90) / 100)
    return V.obligation_scores(rows, ["qid", "candidate"])


GATE_C = f"""cand AS (SELECT qid, method, selected, {H("'ne' || qid || method")} % 3 AS n_evidence, {H("'co' || qid || method")} % 2 = 0 AS consistent FROM answers WHERE method IN ({quoted(GRAPH3)})),
  d AS (SELECT qid, selected AS direct FROM cand WHERE method = 'graph_a' AND selected IS NOT NULL AND consistent AND n_evidence > 0),
  bk AS (SELECT d.qid, d.direct, count(*) AS n FROM d JOIN cand c ON c.qid = d.qid AND c.selected = d.direct AND c.n_evidence > 0 GROUP BY ALL),
  hv AS (SELECT qid, arg_max(selected, (w, -ascii(selected))) AS heaviest FROM (SELECT qid, selected, sum(2 * n_evidence) AS w FROM cand WHERE selected IS NOT NULL GROUP BY ALL) a GROUP BY qid),
  fb AS (SELECT qid, selected AS fb FROM answers WHERE method = 'tail')
  SELECT q.qid, coalesce(n >= 2, false) AS accepted, CASE WHEN n >= 2 THEN bk.direct ELSE coalesce(heaviest, fb, 'A') END AS winner
  FROM (SELECT DISTINCT qid FROM cand) q LEFT JOIN bk USING (qid) LEFT JOIN hv USING (qid) LEFT JOIN fb USING (qid)"""


@query("evidence_gate", check("answers", f"WITH {GATE_C}"))
def evidence_gate(spark, sf):
    a = answers(spark, sf)
    key = lambda p: F.concat(F.lit(p), "qid", "method")
    fb = a.filter("method = 'tail'").select("qid", F.col("selected").alias("fb"))
    cands = a.filter(F.col("method").isin(*GRAPH3)).join(fb, "qid", "left").withColumn("n_evidence", hash_mod(key("ne"), 3)).withColumn("consistent", hash_mod(key("co"), 2) == 0)
    return V.evidence_gate(cands, "graph_a", "fb")


@query(
    "stability_features",
    check("answers", f"""SELECT qid, count(DISTINCT coalesce(selected, '-')) = 1 AS unanimous_orders, count(DISTINCT selected) AS n_letters, count(selected) AS n_parsed FROM answers WHERE method IN ({quoted(GRAPH3)}) GROUP BY qid"""),
)
def stability_features(spark, sf):
    rows = answers(spark, sf).filter(F.col("method").isin(*GRAPH3))
    seen = F.collect_set(F.coalesce("selected", F.lit("-")))
    return rows.groupBy("qid").agg(
        (F.size(seen) == 1).alias("unanimous_orders"), F.size(F.collect_set("selected")).alias("n_letters"), F.count("selected").alias("n_parsed")
    )
