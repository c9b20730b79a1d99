"""Registered queries: accuracy, tests, bootstraps, reports, recall audits and density series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import cut_lineage, table, top_k
from ..functions import answers as A, constants as K
from ..functions.text import content_tokens, hash_mod, norm_text
from ..operators import bm25 as B, evaluate as E, graph as G, segment as S, vote as V
from .answer_queries import patterns_sql
from .graph_queries import edges_of, metrics_of, nodes_of, MET_SQL
from .inputs import Dialect, check, relation
from .registry import query
from .retrieval_queries import GRAPH_INPUTS, HOPS, HOPS_UNION, OWN, OWN_RANK, hops, own_ranked
from .text_queries import NORM, STORY, doc_text, docs, placed_spans
from .vote_queries import NAMES, WIDE, answers, quoted

DUCK = Dialect(False)
H = DUCK.h
six = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
# exact p values are dyadic and often lie on a rounding edge; a nudge settles it
nudged = lambda *cs: [F.round(F.col(c) + 1e-9, 6).alias(c) for c in cs]


# -- accuracy ----------------------------------------------------------------------------
ACC = "sum(correct)::BIGINT AS correct, count(*) AS total, count(selected) AS parsed, round(avg(correct), 6) AS accuracy"


@query("accuracy", check("answers", f"SELECT method, {ACC} FROM answers GROUP BY method"))
def accuracy(spark, sf):
    return E.accuracy(answers(spark, sf), ["method"]).select("method", "correct", "total", "parsed", *six("accuracy"))


@query(
    "accuracy_macro",
    check("answers", "SELECT method, round(avg(a), 6) AS macro, count(*) AS groups FROM (SELECT method, novel, avg(correct) AS a FROM answers GROUP BY ALL) t GROUP BY method"),
)
def accuracy_macro(spark, sf):
    return E.macro_accuracy(answers(spark, sf), ["method"]).select("method", *six("macro"), "groups")


Z = K.WILSON_Z
WILSON = f"""round((c / n + {Z * Z} / (2 * n) - {Z} * sqrt(c / n * (1 - c / n) / n + {Z * Z} / (4 * n * n))) / (1 + {Z * Z} / n), 6) AS low,
  round((c / n + {Z * Z} / (2 * n) + {Z} * sqrt(c / n * (1 - c / n) / n + {Z * Z} / (4 * n * n))) / (1 + {Z * Z} / n), 6) AS high"""


@query("wilson", check("answers", f"SELECT cohort, method, c AS correct, n AS total, {WILSON} FROM (SELECT cohort, method, sum(correct)::BIGINT AS c, count(*) AS n FROM answers GROUP BY ALL) t"))
def wilson(spark, sf):
    a = E.accuracy(answers(spark, sf), ["cohort", "method"])
    low, high = E.wilson("correct", "total")
    return a.select("cohort", "method", "correct", "total", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


PAIR = """pr AS (SELECT a.cohort, a.method, count(*) FILTER (a.correct = 1 AND b.correct = 0) AS wins, count(*) FILTER (a.correct = 0 AND b.correct = 1) AS losses, avg(a.correct - b.correct) AS delta
    FROM answers a JOIN answers b ON a.qid = b.qid AND b.method = '{}' WHERE a.method <> '{}' GROUP BY ALL),
  pv AS (SELECT *, CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)))
    FROM (SELECT unnest(range(0, least(wins, losses) + 1)) AS i) r)) END AS p FROM pr)""".format


@query("mcnemar", check("answers", f"WITH {PAIR('tail', 'tail')} SELECT cohort, method, wins, losses, round(delta, 6) AS delta, round(p + 1e-9, 6) AS p FROM pv"))
def mcnemar(spark, sf):
    return E.paired(answers(spark, sf), ["cohort"], "tail").select("cohort", "method", "wins", "losses", *six("delta"), *nudged("p"))


HOLM = """hm AS (SELECT *, max(raw) OVER (PARTITION BY cohort ORDER BY p, method) AS holm_p FROM (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY cohort) - row_number() OVER (PARTITION BY cohort ORDER BY p, method) + 1)) AS raw FROM pv) z)"""


@query("holm", check("answers", f"WITH {PAIR('tail', 'tail')}, {HOLM} SELECT cohort, method, round(p + 1e-9, 6) AS p, round(holm_p + 1e-9, 6) AS holm_p FROM hm"))
def holm(spark, sf):
    tests = E.paired(answers(spark, sf), ["cohort"], "tail").withColumn("p", F.round("p", 12))
    return E.holm(tests, ["cohort"]).select("cohort", "method", *nudged("p", "holm_p"))


@query(
    "practical_flag",
    check("answers", f"""WITH base AS (SELECT cohort, arg_max(method, (c, -o)) AS method FROM (SELECT cohort, method, min(morder) AS o, sum(correct) AS c FROM answers WHERE method IN ('tail', 'compress', 'question_only') GROUP BY ALL) t GROUP BY cohort),
      pr AS (SELECT a.cohort, a.method, bb.method AS baseline, count(*) FILTER (a.correct = 1 AND b.correct = 0) AS wins, count(*) FILTER (a.correct = 0 AND b.correct = 1) AS losses, avg(a.correct - b.correct) AS delta
        FROM answers a JOIN base bb ON a.cohort = bb.cohort JOIN answers b ON a.qid = b.qid AND b.method = bb.method WHERE a.method NOT IN ('tail', 'compress', 'question_only') GROUP BY ALL),
      pv AS (SELECT *, CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) FROM (SELECT unnest(range(0, least(wins, losses) + 1)) AS i) r)) END AS p FROM pr), {HOLM}
    SELECT cohort, method, baseline, round(delta, 6) AS delta, round(holm_p + 1e-9, 6) AS holm_p, round(delta, 9) >= 0.05 AND holm_p < 0.05 AS practical FROM hm"""),
)
def practical_flag(spark, sf):
    """New methods against the best baseline of their cohort."""
    a = answers(spark, sf)
    basis = ["tail", "compress", "question_only"]
    counts = a.filter(F.col("method").isin(basis)).groupBy("cohort", "method").agg(F.sum("correct").alias("c"), F.min("morder").alias("o"))
    best = counts.groupBy("cohort").agg(F.max_by("method", F.struct("c", -F.col("o"))).alias("baseline"))
    ref = a.join(best, (a.cohort == best.cohort) & (a.method == best.baseline)).select("qid", "baseline", F.col("correct").alias("base"))
    rows = a.filter(~F.col("method").isin(basis)).join(ref, "qid").groupBy("cohort", "method", "baseline").agg(
        F.count_if((F.col("correct") == 1) & (F.col("base") == 0)).alias("wins"), F.count_if((F.col("correct") == 0) & (F.col("base") == 1)).alias("losses"), F.avg(F.col("correct") - F.col("base")).alias("delta")
    )
    out = E.holm(rows.withColumn("p", F.round(E.exact_p("wins", "losses"), 12)), ["cohort"])
    flag = (F.round("delta", 9) >= 0.05) & (F.col("holm_p") < 0.05)
    return out.select("cohort", "method", "baseline", *six("delta"), *nudged("holm_p"), flag.alias("practical"))


# -- bootstraps ----------------------------------------------------------------------------
DELTA = "delta AS (SELECT a.novel, a.qid, a.correct - b.correct AS value FROM answers a JOIN answers b ON a.qid = b.qid AND b.method = 'tail' WHERE a.method = 'graph_expand')"
PICKS = f"""picks AS (SELECT draw, slot, {H("'seed:' || draw || ':' || slot")} % n AS idx FROM (SELECT count(*) AS n FROM cl) c, range(0, {{}}) d(draw), LATERAL (SELECT unnest(range(0, n)) AS slot) s)"""
ORDER_STATS = """SELECT round(max(value) FILTER (i = cast(floor(0.025 * {0}) AS BIGINT)), 6) AS low, round(max(value) FILTER (i = least(cast(floor(0.975 * {0}) AS BIGINT), {0} - 1)), 6) AS high, count(*) AS draws
  FROM (SELECT value, row_number() OVER (ORDER BY value, draw) - 1 AS i FROM dv) z"""


def deltas(spark, sf):
    a = answers(spark, sf)
    base = a.filter("method = 'tail'").select("qid", F.col("correct").alias("base"))
    return a.filter("method = 'graph_expand'").join(base, "qid").select("novel", "qid", (F.col("correct") - F.col("base")).alias("value"))


@query(
    "cluster_bootstrap",
    check("answers", f"""WITH {DELTA}, cl AS (SELECT *, row_number() OVER (ORDER BY md5(novel)) - 1 AS idx FROM (SELECT novel, sum(value) AS s, count(*) AS n FROM delta GROUP BY novel) t),
      {PICKS.format(5000)}, dv AS (SELECT draw, sum(s) / sum(n) AS value FROM picks JOIN cl USING (idx) GROUP BY draw) {ORDER_STATS.format(5000)}"""),
)
def cluster_bootstrap(spark, sf):
    return E.cluster_bootstrap(deltas(spark, sf), "novel", 5000).select(*six("low", "high"), "draws")


@query(
    "two_stage_bootstrap",
    check("answers", f"""WITH {DELTA}, cl AS (SELECT *, row_number() OVER (ORDER BY md5(novel)) - 1 AS idx FROM (SELECT novel, count(*) AS n, count(*) FILTER (value < 0) AS neg, count(*) FILTER (value > 0) AS pos FROM delta GROUP BY novel) t),
      {PICKS.format(10000)}, rr AS (SELECT draw, c.n, neg, pos, {H("'row:' || draw || ':' || slot || ':' || j")} % c.n AS r FROM picks JOIN cl c USING (idx), LATERAL (SELECT unnest(range(0, c.n)) AS j) x),
      dv AS (SELECT draw, sum(CASE WHEN r < neg THEN -1 WHEN r < neg + pos THEN 1 ELSE 0 END) / count(*) AS value FROM rr GROUP BY draw) {ORDER_STATS.format(10000)}"""),
)
def two_stage_bootstrap(spark, sf):
    return E.two_stage_bootstrap(deltas(spark, sf), "novel", 10000).select(*six("low", "high"), "draws")


# -- subsets and controls ------------------------------------------------------------------
@query(
    "hard_subset",
    check("answers", f"""SELECT subset, method, {ACC} FROM (SELECT a.*, CASE WHEN c.correct = 0 THEN 'hard' ELSE 'easy' END AS subset FROM answers a JOIN answers c ON a.qid = c.qid AND c.method = 'question_only') t GROUP BY ALL"""),
)
def hard_subset(spark, sf):
    a = answers(spark, sf)
    wrong = a.filter("method = 'question_only' and correct = 0").select("qid")
    hard = a.join(wrong, "qid", "left_semi").withColumn("subset", F.lit("hard"))
    easy = a.join(wrong, "qid", "left_anti").withColumn("subset", F.lit("easy"))
    return E.accuracy(hard.unionByName(easy), ["subset", "method"]).select("subset", "method", "correct", "total", "parsed", *six("accuracy"))


@query(
    "rescue_metrics",
    check("answers", """WITH r AS (SELECT a.method, count(*) FILTER (c.correct = 0) AS hard, count(*) FILTER (c.correct = 0 AND a.correct = 1) AS rescued, count(*) FILTER (c.correct = 1) AS easy,
        count(*) FILTER (c.correct = 1 AND a.correct = 1) AS preserved, count(*) AS total FROM answers a JOIN answers c ON a.qid = c.qid AND c.method = 'question_only' WHERE a.method <> 'question_only' GROUP BY ALL)
    SELECT method, hard, rescued, easy, preserved, total, round(rescued / hard, 6) AS rescue_rate, round(preserved / easy, 6) AS preservation_rate, round((rescued - (easy - preserved)) / total, 6) AS net_gain FROM r"""),
)
def rescue_metrics(spark, sf):
    out = E.rescue(answers(spark, sf), "question_only")
    return out.select("method", "hard", "rescued", "easy", "preserved", "total", *six("rescue_rate", "preservation_rate", "net_gain"))


@query(
    "control_strata",
    check("answers", """WITH c AS (SELECT qid, sum(correct) AS votes FROM answers WHERE method IN ('question_only', 'tail') GROUP BY qid)
    SELECT votes::BIGINT AS votes, method, sum(correct)::BIGINT AS correct, count(*) AS total FROM answers JOIN c USING (qid) GROUP BY ALL"""),
)
def control_strata(spark, sf):
    """Accuracy by how many of two control methods were right; zero is the both-wrong set."""
    a = answers(spark, sf)
    votes = a.filter(F.col("method").isin("question_only", "tail")).groupBy("qid").agg(F.sum("correct").alias("votes"))
    return a.join(votes, "qid").groupBy("votes", "method").agg(F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("total"))


@query(
    "oracle",
    check("answers", f"""WITH {WIDE}, o AS (SELECT qid, max(correct) AS any_right, max(correct) FILTER (method IN ({quoted(NAMES[:5])})) AS graph_right, max(correct) FILTER (method = 'tail') AS base FROM answers GROUP BY qid)
    SELECT count(*) AS questions, sum(any_right)::BIGINT AS oracle, sum(CASE WHEN base = 1 AND graph_right = 0 THEN 1 ELSE 0 END)::BIGINT AS only_baseline, sum(CASE WHEN base = 0 AND graph_right = 1 THEN 1 ELSE 0 END)::BIGINT AS rescued FROM o"""),
)
def oracle(spark, sf):
    best = lambda cond: F.max(F.when(cond, F.col("correct")))
    per = answers(spark, sf).groupBy("qid").agg(F.max("correct").alias("any"), best(F.col("method").isin(NAMES[:5])).alias("graph"), best(F.col("method") == "tail").alias("base"))
    return per.agg(
        F.count(F.lit(1)).alias("questions"), F.sum("any").alias("oracle"), F.count_if((F.col("base") == 1) & (F.col("graph") == 0)).alias("only_baseline"),
        F.count_if((F.col("base") == 0) & (F.col("graph") == 1)).alias("rescued"),
    )


@query(
    "agreement",
    check("answers", "SELECT a.method AS m1, b.method AS m2, round(avg(CASE WHEN a.selected = b.selected THEN 1.0e0 ELSE 0 END), 6) AS agree FROM answers a JOIN answers b ON a.qid = b.qid AND a.morder < b.morder GROUP BY ALL"),
)
def agreement(spark, sf):
    """Share of equal answers for every pair of methods, from one wide row per question."""
    w = V.wide(answers(spark, sf), NAMES, ["qid"])
    pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1:]]
    row = F.inline(F.array(*[F.struct(F.lit(a).alias("m1"), F.lit(b).alias("m2"), F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int").alias("same")) for a, b in pairs]))
    return w.select(row).groupBy("m1", "m2").agg(F.round(F.avg("same"), 6).alias("agree"))


# -- reports -------------------------------------------------------------------------------
REPORT = "sum(correct)::BIGINT AS correct, count(*) AS total, round(avg(correct), 6) AS accuracy"


def report_aggs():
    return [F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("total"), F.round(F.avg("correct"), 6).alias("accuracy")]


@query(
    "report_grouping_sets",
    check("answers", f"SELECT cohort, novel, qtype, unanimous, method, {REPORT} FROM answers GROUP BY GROUPING SETS ((cohort, method), (qtype, method), (novel, method), (unanimous, method), (method), ())"),
)
def report_grouping_sets(spark, sf):
    a = answers(spark, sf)
    c = lambda *names: [F.col(n) for n in names]
    sets = [c("cohort", "method"), c("qtype", "method"), c("novel", "method"), c("unanimous", "method"), c("method"), []]
    return a.groupingSets(sets, "cohort", "novel", "qtype", "unanimous", "method").agg(*report_aggs())


@query("report_rollup", check("answers", f"SELECT cohort, novel, method, {REPORT} FROM answers GROUP BY ROLLUP (cohort, novel, method)"))
def report_rollup(spark, sf):
    return answers(spark, sf).rollup("cohort", "novel", "method").agg(*report_aggs())


@query("report_cube", check("answers", f"SELECT cohort, qtype, method, {REPORT} FROM answers GROUP BY CUBE (cohort, qtype, method)"))
def report_cube(spark, sf):
    return answers(spark, sf).cube("cohort", "qtype", "method").agg(*report_aggs())


@query("per_letter", check("answers", f"SELECT method, gold, {REPORT} FROM answers GROUP BY ALL"))
def per_letter(spark, sf):
    return answers(spark, sf).groupBy("method", "gold").agg(*report_aggs())


@query("letter_dist", check("answers", "SELECT method, " + ", ".join(f"count(*) FILTER (selected = '{x}') AS {x}" for x in K.LETTERS) + ", count(*) FILTER (selected IS NULL) AS unparsed FROM answers GROUP BY method"))
def letter_dist(spark, sf):
    a = answers(spark, sf).withColumn("selected", F.coalesce("selected", F.lit("unparsed")))
    return a.groupBy("method").pivot("selected", [*K.LETTERS, "unparsed"]).count().fillna(0)


@query(
    "mask_effect",
    check("answers", f"""WITH {PAIR('graph_b', 'graph_b')} SELECT cohort, wins, losses, round(delta, 6) AS delta, round(p + 1e-9, 6) AS p FROM pv WHERE method = 'graph_a'"""),
)
def mask_effect(spark, sf):
    """Two runs of one method stand for the unmasked and the masked condition."""
    two = answers(spark, sf).filter(F.col("method").isin("graph_a", "graph_b"))
    return E.paired(two, ["cohort"], "graph_b").select("cohort", "wins", "losses", *six("delta"), *nudged("p"))


# -- correlations --------------------------------------------------------------------------
@query(
    "pearson",
    check("answers", """SELECT qtype, count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END, 6) AS r FROM (
      SELECT qtype, novel, avg(correct) FILTER (method = 'graph_expand') AS x, avg(correct) FILTER (method = 'tail') AS y FROM answers GROUP BY ALL) t GROUP BY qtype"""),
)
def pearson(spark, sf):
    part = lambda m: F.avg(F.when(F.col("method") == m, F.col("correct")))
    rows = answers(spark, sf).groupBy("qtype", "novel").agg(part("graph_expand").alias("x"), part("tail").alias("y"))
    return E.correlation(rows, ["qtype"], "x", "y").withColumn("r", F.round("r", 6))


@query(
    "spearman",
    """SELECT n, round(r, 6) AS r FROM (SELECT count(*) AS n, corr(rx, ry) AS r FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
      FROM (SELECT n_chars AS x, quality * 2 + toxic AS y FROM documents JOIN labels USING (doc_id)) b) a) t""",
)
def spearman(spark, sf):
    rows = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(F.col("n_chars").alias("x"), (F.col("quality") * 2 + F.col("toxic")).alias("y"))
    return E.spearman(rows, "x", "y", (4096, 1)).withColumn("r", F.round("r", 6))


@query(
    "delta_stats",
    check("answers", f"""WITH p AS (SELECT qid, method, ({H("'pf' || qid || method")} % 1000 - {H("'pa' || qid || method")} % 1000) / 1000.0e0 AS d FROM answers)
    SELECT method, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(avg(CASE WHEN d > 0 THEN 1.0e0 ELSE 0 END), 6) AS positive,
      (SELECT round(avg(CASE WHEN top = gold THEN 1.0e0 ELSE 0 END), 6) FROM (SELECT qid, arg_max(selected, (d, -morder)) AS top, any_value(gold) AS gold FROM p JOIN answers USING (qid, method) WHERE selected IS NOT NULL GROUP BY qid) z) AS argmax_accuracy
    FROM p GROUP BY method"""),
)
def delta_stats(spark, sf):
    """Paired full-minus-ablated deltas, and the accuracy of trusting the largest delta."""
    key = lambda p: F.concat(F.lit(p), "qid", "method")
    d = (hash_mod(key("pf"), 1000) - hash_mod(key("pa"), 1000)) / 1000
    rows = answers(spark, sf).withColumn("d", d)
    top = rows.filter("selected is not null").groupBy("qid").agg(F.max_by("selected", F.struct("d", -F.col("morder"))).alias("top"), F.first("gold").alias("gold"))
    acc = top.agg(F.round(F.avg((F.col("top") == F.col("gold")).cast("int")), 6).alias("argmax_accuracy"))
    per = rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.median("d"), 6).alias("median"), F.round(F.avg((F.col("d") > 0).cast("int")), 6).alias("positive")
    )
    return per.withColumn("argmax_accuracy", acc.scalar())


# -- recall audits ---------------------------------------------------------------------------
GOLD = """gold AS (SELECT c.doc_id AS qid, c.chunk_idx AS unit, k.kind FROM chunks c JOIN (SELECT doc_id, length(text) // 2 AS pos, 'answer' AS kind FROM documents UNION ALL
    SELECT doc_id, least(length(text) // 2 + 199, length(text) - 1), 'clue' FROM documents) k ON k.doc_id = c.doc_id AND k.pos >= c.start AND k.pos < c."end")"""
FOUND = f"""{OWN}, {OWN_RANK}, last AS (SELECT doc_id, max(chunk_idx) AS top FROM chunks GROUP BY 1),
  found AS (SELECT 'text_1' AS variant, qid, unit FROM ork WHERE rank <= 1 UNION ALL SELECT 'text_3', qid, unit FROM ork WHERE rank <= 3 UNION ALL SELECT 'tail_2', c.doc_id, c.chunk_idx FROM chunks c JOIN last l USING (doc_id) WHERE c.chunk_idx > l.top - 2),
  sized AS (SELECT f.*, length(c.text) AS chars FROM found f JOIN chunks c ON c.doc_id = f.qid AND c.chunk_idx = f.unit)"""
VARIANTS = ["text_1", "text_3", "tail_2"]


def own_gold(spark, sf):
    """The chunks that hold the start (answer) and the end (clue) of each document's query."""
    chunks = S.chunk_fixed(doc_text(spark, sf))
    half = F.floor(F.length("text") / 2)
    points = docs(spark, sf).filter("length(text) > 0").select(F.col("doc_id"), F.inline(F.array(
        F.struct(F.lit("answer").alias("kind"), half.alias("pos")), F.struct(F.lit("clue").alias("kind"), F.least(half + 199, F.length("text") - 1).alias("pos"))
    )))
    bins = chunks.select("doc_id", "chunk_idx", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 1500), F.floor((F.col("end") - 1) / 1500))).alias("bin"))
    hit = points.withColumn("bin", F.floor(F.col("pos") / 1500)).join(bins, ["doc_id", "bin"]).filter("start <= pos and pos < end")
    return hit.select(F.col("doc_id").alias("qid"), F.col("chunk_idx").cast("long").alias("unit"), "kind")


def found_units(spark, sf):
    ranked = own_ranked(spark, sf, 3).select("qid", "unit", "rank")
    chunks = S.chunk_fixed(doc_text(spark, sf)).select(F.col("doc_id").alias("qid"), F.col("chunk_idx").cast("long").alias("unit"), F.length("text").alias("chars"))
    top = chunks.groupBy("qid").agg(F.max("unit").alias("top"))
    tail = chunks.join(top, "qid").filter("unit > top - 2").select(F.lit("tail_2").alias("variant"), "qid", "unit")
    text = ranked.select(F.explode(F.when(F.col("rank") == 1, F.array(F.lit("text_1"), F.lit("text_3"))).otherwise(F.array(F.lit("text_3")))).alias("variant"), "qid", "unit")
    return text.unionByName(tail).join(chunks, ["qid", "unit"])


@query(
    "retrieval_recall",
    check("chunks own_units own_asks", f"""WITH {FOUND}, {GOLD}, want AS (SELECT qid, count(DISTINCT (unit, kind)) AS want FROM gold GROUP BY 1),
      sz AS (SELECT variant, qid, count(*) AS chunks, sum(chars) AS chars FROM sized GROUP BY ALL),
      ht AS (SELECT variant, qid, max(CASE WHEN kind = 'answer' THEN 1 ELSE 0 END) AS answer, count(DISTINCT (unit, kind)) AS hit FROM found JOIN gold USING (qid, unit) GROUP BY ALL)
    SELECT v.variant, count(*) AS questions, round(avg(CASE WHEN hit > 0 THEN 1.0e0 ELSE 0 END), 6) AS any_recall, round(avg(coalesce(answer, 0)), 6) AS answer_recall, round(avg(CASE WHEN want > 0 THEN coalesce(hit, 0) / want END), 6) AS unit_recall,
      round(avg(coalesce(sz.chunks, 0)), 6) AS mean_chunks, round(avg(coalesce(chars, 0)), 6) AS mean_chars
    FROM documents d CROSS JOIN (VALUES ('text_1'), ('text_3'), ('tail_2')) v(variant) LEFT JOIN sz ON sz.qid = d.doc_id AND sz.variant = v.variant LEFT JOIN ht ON ht.qid = d.doc_id AND ht.variant = v.variant LEFT JOIN want w ON w.qid = d.doc_id GROUP BY v.variant"""),
)
def retrieval_recall(spark, sf):
    out = E.recall(found_units(spark, sf), own_gold(spark, sf), docs(spark, sf).select(F.col("doc_id").alias("qid")), VARIANTS)
    return out.select("variant", "questions", *six("any_recall", "answer_recall", "unit_recall", "mean_chunks", "mean_chars"))


@query(
    "recall_misses",
    check("chunks own_units own_asks", f"WITH {FOUND}, {GOLD} SELECT DISTINCT g.qid FROM gold g WHERE g.qid NOT IN (SELECT f.qid FROM found f JOIN gold h USING (qid, unit) WHERE f.variant = 'text_1')"),
)
def recall_misses(spark, sf):
    """Questions with gold passages of which the top text passage is none."""
    gold = own_gold(spark, sf)
    hit = found_units(spark, sf).filter("variant = 'text_1'").join(gold.select("qid", "unit").distinct(), ["qid", "unit"], "left_semi")
    return gold.select("qid").distinct().join(hit.select("qid"), "qid", "left_anti")


@query(
    "ablation_delta",
    check("chunks own_units own_asks", f"""WITH {OWN}, {GOLD}, s AS (SELECT qid, unit, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit) AS rk FROM ob_scores) z WHERE rk <= 3),
      f AS (SELECT qid, sum(score) AS full_score, sum(score) FILTER ((qid, unit) NOT IN (SELECT qid, unit FROM gold)) AS cut_score FROM s GROUP BY qid)
    SELECT qid, round(full_score, 4) AS full_score, round(coalesce(cut_score, 0), 4) AS cut_score, round(full_score - coalesce(cut_score, 0), 4) AS delta FROM f"""),
)
def ablation_delta(spark, sf):
    """Evidence mass of the top passages with and without the gold ones."""
    top = cut_lineage(own_ranked(spark, sf, 3))
    kept = top.join(own_gold(spark, sf).select("qid", "unit").distinct(), ["qid", "unit"], "left_anti")
    full = top.groupBy("qid").agg(F.sum("score").alias("full_score"))
    less = kept.groupBy("qid").agg(F.sum("score").alias("cut_score"))
    out = full.join(less, "qid", "left").withColumn("cut_score", F.coalesce("cut_score", F.lit(0.0)))
    four = lambda c, n: F.round(c, 4).alias(n)
    return out.select("qid", four("full_score", "full_score"), four("cut_score", "cut_score"), four(F.col("full_score") - F.col("cut_score"), "delta"))


TOKS = f"regexp_extract_all(lower({{}}), '{K.TOKEN_PATTERN}')".format
STOPS = ",".join(f"'{w}'" for w in K.STOP_WORDS)
GT = f"""gt AS (SELECT DISTINCT graph_id, qid, tok FROM (SELECT graph_id, qid, unnest({TOKS("question || ' ' || choice_a || ' ' || choice_b")}) AS tok FROM graph_questions) t WHERE length(tok) > 1 AND tok NOT IN ({STOPS})),
  nt AS (SELECT DISTINCT graph_id, node_id, tok FROM (SELECT graph_id, node_id, unnest({TOKS("name || ' ' || alias || ' ' || description")}) AS tok FROM nodes) t WHERE length(tok) > 1 AND tok NOT IN ({STOPS}))"""
TOP40 = "tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, qid ORDER BY overlap DESC, node_id) AS rank FROM (SELECT g.graph_id, g.qid, n.node_id, count(*) AS overlap FROM gt g JOIN nt n USING (graph_id, tok) GROUP BY ALL) o) r WHERE rank <= 40)"


def gold_terms(spark, sf):
    q = relation(spark, sf, "graph_questions")
    return q.select("graph_id", "qid", F.explode(content_tokens(F.concat_ws(" ", "question", "choice_a", "choice_b"))).alias("tok"))


def node_terms(spark, sf):
    return nodes_of(spark, sf).select("graph_id", "node_id", F.explode(content_tokens(F.concat_ws(" ", "name", "alias", "description"))).alias("tok"))


def gold_top(spark, sf):
    """The 40 nodes of each question that share most gold terms with it: every term of a node weighs one."""
    terms = node_terms(spark, sf).select(F.col("graph_id").alias("scope"), F.col("tok").alias("term"), F.col("node_id").alias("unit"), F.lit(1.0).alias("weight"))
    asked = gold_terms(spark, sf).groupBy(F.col("graph_id").alias("scope"), "qid", F.lit("Q").alias("label")).agg(F.collect_list("tok").alias("terms"))
    best = B.best_units(cut_lineage(terms.join(asked.select("scope", F.explode("terms").alias("term")), ["scope", "term"], "left_semi")), asked, 40)
    return best.select(F.col("scope").alias("graph_id"), "qid", F.col("unit").alias("node_id"), F.col("score").cast("long").alias("overlap"), "rank")


@query("gold_nodes_top", check("nodes graph_questions", f"WITH {GT}, {TOP40} SELECT graph_id, qid, node_id, overlap, rank FROM tp"))
def gold_nodes_top(spark, sf):
    return gold_top(spark, sf)


@query(
    "gold_coverage",
    check(GRAPH_INPUTS, f"""WITH {HOPS}, {GT}, hp AS ({HOPS_UNION}), tot AS (SELECT graph_id, qid, count(*) AS n FROM gt GROUP BY ALL),
      cv AS (SELECT h.graph_id, h.qid, g.tok, min(h.hop) AS hop FROM hp h JOIN nt n USING (graph_id, node_id) JOIN gt g ON g.graph_id = h.graph_id AND g.qid = h.qid AND g.tok = n.tok GROUP BY ALL)
    SELECT t.graph_id, t.qid, l.upto, count(c.tok) AS covered, round(count(c.tok) / any_value(t.n), 6) AS coverage FROM tot t CROSS JOIN (VALUES (1), (2), (3)) l(upto) LEFT JOIN cv c ON c.graph_id = t.graph_id AND c.qid = t.qid AND c.hop <= l.upto GROUP BY t.graph_id, t.qid, l.upto"""),
)
def gold_coverage(spark, sf):
    """Share of gold terms named by nodes retrieved within 1, 2 and 3 hops."""
    gold = gold_terms(spark, sf)
    seen = hops(spark, sf).join(node_terms(spark, sf), ["graph_id", "node_id"]).join(gold, ["graph_id", "qid", "tok"], "left_semi")
    first = seen.groupBy("graph_id", "qid", "tok").agg(F.min("hop").alias("hop"))
    rows = gold.join(first, ["graph_id", "qid", "tok"], "left")
    counts = rows.groupBy("graph_id", "qid").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("hop") <= i).alias(f"c{i}") for i in (1, 2, 3)])
    upto = F.inline(F.array(*[F.struct(F.lit(i).alias("upto"), F.col(f"c{i}").alias("covered"), F.round(F.col(f"c{i}") / F.col("n"), 6).alias("coverage")) for i in (1, 2, 3)]))
    return counts.select("graph_id", "qid", upto)


@query(
    "gold_hop",
    check(GRAPH_INPUTS, f"""WITH {HOPS}, {GT}, {TOP40}, hp AS ({HOPS_UNION}) SELECT t.graph_id, t.qid, coalesce(h.hop::VARCHAR, 'never') AS hop, count(*) AS n FROM tp t LEFT JOIN hp h USING (graph_id, qid, node_id) GROUP BY ALL"""),
)
def gold_hop(spark, sf):
    """At which hop the gold nodes were retrieved."""
    got = hops(spark, sf).groupBy("graph_id", "qid", "node_id").agg(F.min("hop").alias("hop"))
    rows = gold_top(spark, sf).join(got, ["graph_id", "qid", "node_id"], "left")
    return rows.groupBy("graph_id", "qid", F.coalesce(F.col("hop").cast("string"), F.lit("never")).alias("hop")).agg(F.count(F.lit(1)).alias("n"))


LEAF = f"""lf AS (SELECT l.doc_id, seq, CASE seq % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'commonsense' ELSE 'deduced' END AS fact_type, {NORM('left(d.text, length(d.text) // 2)')} AS ctx, {NORM('l.text')} AS txt FROM lines l JOIN documents d USING (doc_id)),
  jd AS (SELECT doc_id, fact_type, contains(ctx, txt) AS verbatim, len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(ctx, x))) = 0 AS all_words FROM (
    SELECT *, list_filter(regexp_extract_all(txt, '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 3) AS w FROM lf) z)"""


def leaf_rows(spark, sf):
    kind = lambda i: F.when(i % 3 == 0, "explicit").when(i % 3 == 1, "commonsense").otherwise("deduced")
    leaves = F.transform(F.split("text", "\n"), lambda x, i: F.struct(kind(i).alias("fact_type"), x.alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    return E.leaf_coverage(docs(spark, sf).select("doc_id", F.left("text", half).alias("context"), leaves.alias("leaves")), ["doc_id"])


@query("leaf_coverage", check("lines", f"WITH {LEAF} SELECT doc_id, count(*) AS leaves, count(*) FILTER (all_words) AS covered, round(count(*) FILTER (all_words) / count(*), 6) AS rate FROM jd GROUP BY doc_id"))
def leaf_coverage(spark, sf):
    out = leaf_rows(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("leaves"), F.count_if("all_words").alias("covered"))
    return out.withColumn("rate", F.round(F.col("covered") / F.col("leaves"), 6))


@query("fact_coverage", check("lines", f"WITH {LEAF} SELECT fact_type, count(*) AS facts, count(*) FILTER (verbatim) AS verbatim, count(*) FILTER (all_words) AS all_words FROM jd GROUP BY fact_type"))
def fact_coverage(spark, sf):
    return leaf_rows(spark, sf).groupBy("fact_type").agg(F.count(F.lit(1)).alias("facts"), F.count_if("verbatim").alias("verbatim"), F.count_if("all_words").alias("all_words"))


# -- run diagnostics -------------------------------------------------------------------------
@query(
    "run_diagnostics",
    check("answers", f"""WITH r AS (SELECT *, {H("'fb' || qid || method")} % 10 = 0 AS fallback, {H("'st' || qid || method")} % 3 AS stage FROM answers),
      l AS (SELECT method, string_agg(x || '=' || n, ',' ORDER BY x || '=' || n) AS letters FROM (SELECT method, coalesce(selected, 'unparsed') AS x, count(*) AS n FROM r GROUP BY ALL) a GROUP BY 1),
      s AS (SELECT method, string_agg(stage || '=' || n, ',' ORDER BY stage || '=' || n) AS stages FROM (SELECT method, stage, count(*) AS n FROM r GROUP BY ALL) a GROUP BY 1)
    SELECT method, count(*) AS answers, count(*) FILTER (selected IS NULL) AS unparsed, round(avg(elapsed), 6) AS mean_elapsed, count(*) FILTER (confidence = 'high') AS grounded,
      count(*) FILTER (fallback) AS fallbacks, count(*) FILTER (unanimous) AS consistent, count(*) FILTER (unanimous AND confidence = 'high') AS direct, any_value(letters) AS letters, any_value(stages) AS stages
    FROM r JOIN l USING (method) JOIN s USING (method) GROUP BY method"""),
)
def run_diagnostics(spark, sf):
    number = lambda p, n: hash_mod(F.concat(F.lit(p), "qid", "method"), n)
    rows = answers(spark, sf).withColumns({"fallback": number("fb", 10) == 0, "stage": number("st", 3)})
    rows = rows.withColumns({"grounded": F.col("confidence") == "high", "consistent": F.col("unanimous"), "direct": F.col("unanimous") & (F.col("confidence") == "high")})
    out = E.run_diagnostics(rows, ["method"])
    shown = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",").alias(c)
    return out.select("method", "answers", "unparsed", *six("mean_elapsed"), "grounded", "fallbacks", "consistent", "direct", shown("letters"), shown("stages"))


PRICE = K.TOKEN_PRICES


@query(
    "usage_cost",
    f"""SELECT event_type AS job, count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(least(cached, prompt))::BIGINT AS cached, sum(completion)::BIGINT AS completion,
      round(sum(prompt - least(cached, prompt)) * {PRICE['prompt']:.2e} + sum(least(cached, prompt)) * {PRICE['cached']:.2e} + sum(completion) * {PRICE['completion']:.2e}, 6) AS cost FROM (
      SELECT event_type, user_id * 10 AS prompt, event_id % 700 AS cached, json_extract(props, '$.k')::BIGINT AS completion FROM events) t GROUP BY event_type""",
)
def usage_cost(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("job"), (F.col("user_id") * 10).alias("prompt"), (F.col("event_id") % 700).alias("c"), F.get_json_object("props", "$.k").cast("long").alias("completion")
    ).withColumn("cached", F.least("c", "prompt"))
    out = ev.groupBy("job").agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in ("prompt", "cached", "completion")])
    cost = (F.col("prompt") - F.col("cached")) * PRICE["prompt"] + F.col("cached") * PRICE["cached"] + F.col("completion") * PRICE["completion"]
    return out.withColumn("cost", F.round(cost, 6))


@query(
    "judge_conflicts",
    check("answer_texts", f"""SELECT qid, letter, gold, judged FROM (SELECT qid, {patterns_sql(K.LETTER_LAST)} AS letter, substr('ABCD', cast(1 + {H("'let' || qid")} % 4 AS INT), 1) AS gold, {H("'jd' || qid")} % 4 > 0 AS judged FROM answer_texts) t
    WHERE letter IS NOT NULL AND (letter = gold) <> judged"""),
)
def judge_conflicts(spark, sf):
    """Stored verdicts that disagree with the parsed letter."""
    key = lambda p: F.concat(F.lit(p), "qid")
    gold = F.lit(K.LETTERS).substr((hash_mod(key("let"), 4) + 1).cast("int"), F.lit(1))
    # exploding a one-entry array keeps the parsed letter from being inlined into the filter three times
    parsed = F.explode(F.array(A.answer_letter("answer"))).alias("letter")
    rows = relation(spark, sf, "answer_texts").select("qid", parsed, gold.alias("gold"), (hash_mod(key("jd"), 4) > 0).alias("judged"))
    return rows.filter("letter is not null and (letter = gold) <> judged")


# -- story statistics --------------------------------------------------------------------------
KEPT = f"""ks AS (SELECT *, CASE WHEN {H("'dr' || doc_id || ':' || chunk_idx")} % 3 = 0 THEN CASE chunk_idx % 5 {' '.join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(K.DROP_REASONS))} END END AS reason FROM spans)"""


def split_spans(spark, sf):
    drop = hash_mod(F.concat(F.lit("dr"), "doc_id", F.lit(":"), "chunk_idx"), 3) == 0
    reason = F.get(F.array(*map(F.lit, K.DROP_REASONS)), (F.col("chunk_idx") % 5).cast("int"))
    return relation(spark, sf, "spans").withColumn("reason", F.when(drop, reason))


@query(
    "filter_stats",
    check("spans", f"""WITH {KEPT}, n AS (SELECT doc_id, greatest(length(text), 1) AS total FROM documents), r AS (SELECT doc_id, string_agg(reason || '=' || c, ',' ORDER BY reason) AS by_reason FROM (SELECT doc_id, reason, sum(length(text)) AS c FROM ks WHERE reason IS NOT NULL GROUP BY ALL) z GROUP BY 1)
    SELECT k.doc_id, count(*) FILTER (reason IS NULL) AS n_kept, coalesce(sum(length(text)) FILTER (reason IS NULL), 0)::BIGINT AS kept_chars, count(*) FILTER (reason IS NOT NULL) AS n_dropped, coalesce(sum(length(text)) FILTER (reason IS NOT NULL), 0)::BIGINT AS dropped_chars,
      coalesce(any_value(by_reason), '') AS by_reason, round(coalesce(sum(length(text)) FILTER (reason IS NULL), 0) / any_value(total), 6) AS kept_ratio, count(DISTINCT time_label) FILTER (reason IS NULL AND time_label <> 'unknown') AS labels_seen
    FROM ks k JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY k.doc_id"""),
)
def filter_stats(spark, sf):
    rows = split_spans(spark, sf).withColumn("len", F.length("text"))
    parts = rows.groupBy("doc_id", "reason", "time_label").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("c"))
    why = parts.filter("reason is not null").groupBy("doc_id", "reason").agg(F.sum("c").alias("c")).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", F.col("c").cast("string")))), ",").alias("by_reason")
    )
    kept = F.col("reason").isNull()
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    out = parts.groupBy("doc_id").agg(
        total(kept, "n").alias("n_kept"), total(kept, "c").alias("kept_chars"), total(~kept, "n").alias("n_dropped"), total(~kept, "c").alias("dropped_chars"),
        F.count_distinct(F.when(kept & (F.col("time_label") != "unknown"), F.col("time_label"))).alias("labels_seen"),
    )
    n = docs(spark, sf).select("doc_id", F.greatest(F.length("text"), F.lit(1)).alias("total"))
    out = out.join(n, "doc_id").join(why, "doc_id", "left").withColumn("kept_ratio", F.round(F.col("kept_chars") / F.col("total"), 6))
    return out.withColumn("by_reason", F.coalesce("by_reason", F.lit(""))).drop("total")


HIST = f"""hs AS (SELECT d.doc_id, b.bin, coalesce(sum(w), 0) AS value FROM (SELECT DISTINCT doc_id FROM placed) d CROSS JOIN range(100) b(bin) LEFT JOIN (SELECT doc_id, least(cast(floor(text_position * 100) AS BIGINT), 99) AS bin, length(text) AS w FROM placed) p
    ON p.doc_id = d.doc_id AND p.bin = b.bin GROUP BY d.doc_id, b.bin)"""


def span_hist(spark, sf):
    return E.histogram(placed_spans(spark, sf).withColumn("w", F.length("text")), ["doc_id"], "text_position", 100, "w")


@query("hist_weighted", check("lines spans", f"WITH {STORY}, {HIST} SELECT doc_id, bin, value::BIGINT AS value FROM hs"))
def hist_weighted(spark, sf):
    return span_hist(spark, sf)


@query("moving_average", check("lines spans", f"WITH {STORY}, {HIST} SELECT doc_id, bin, round(avg(value) OVER (PARTITION BY doc_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM hs"))
def moving_average(spark, sf):
    return E.moving_average(span_hist(spark, sf), ["doc_id"], 5).select("doc_id", "bin", *six("smooth"))


@query(
    "bin_flags",
    check("lines spans", f"""WITH {STORY}, {HIST}, m AS (SELECT *, avg(value) OVER (PARTITION BY doc_id) AS mean FROM hs),
      s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bin) AS r FROM m WHERE value > 0 AND value < 0.3 * mean), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bin) AS r FROM m WHERE value >= greatest(1.5 * mean, 1.0))
    SELECT doc_id, bin, 'sparse' AS flag, value::BIGINT AS value FROM s WHERE r <= 3 UNION ALL SELECT doc_id, bin, 'dense', value::BIGINT FROM d WHERE r <= 5"""),
)
def bin_flags(spark, sf):
    return E.bin_flags(cut_lineage(span_hist(spark, sf)), ["doc_id"])


@query(
    "hist2d",
    check("lines spans", f"""WITH {STORY}, g AS (SELECT least(cast(floor(text_position * 40) AS BIGINT), 39) AS bx, least(cast(floor(time_position * 40) AS BIGINT), 39) AS "by", l.lang FROM placed p JOIN (SELECT doc_id, lang FROM documents) l USING (doc_id))
    SELECT d.lang, x.i AS bx, y.i AS "by", count(g.bx) AS n FROM (SELECT DISTINCT lang FROM g) d CROSS JOIN range(40) x(i) CROSS JOIN range(40) y(i) LEFT JOIN g ON g.lang = d.lang AND g.bx = x.i AND g."by" = y.i GROUP BY ALL"""),
)
def hist2d(spark, sf):
    rows = placed_spans(spark, sf).join(docs(spark, sf).select("doc_id", "lang"), "doc_id")
    return E.histogram2d(rows, ["lang"], "text_position", "time_position", 40)


@query(
    "edge_display",
    check("nodes edges", """SELECT graph_id, edge_id, rank, round(greatest(a, b), 6) AS edge_pos FROM (SELECT e.graph_id, e.edge_id, coalesce(x.text_pos, 0.5) AS a, coalesce(y.text_pos, 0.5) AS b, row_number() OVER (PARTITION BY e.graph_id ORDER BY confidence DESC, e.edge_id) AS rank
      FROM edges e JOIN nodes x ON x.graph_id = e.graph_id AND x.node_id = e.src JOIN nodes y ON y.graph_id = e.graph_id AND y.node_id = e.dst) r WHERE rank <= 1500"""),
)
def edge_display(spark, sf):
    """Strongest 1,500 edges per graph with the later position of their ends."""
    pos = nodes_of(spark, sf).select("graph_id", "node_id", F.coalesce("text_pos", F.lit(0.5)).alias("pos"))
    edges = edges_of(spark, sf).select("graph_id", "edge_id", "src", "dst", "confidence")
    top = G.top_valid_edges(edges, pos, "confidence", 1500)
    s = pos.select("graph_id", F.col("node_id").alias("src"), F.col("pos").alias("a"))
    t = pos.select("graph_id", F.col("node_id").alias("dst"), F.col("pos").alias("b"))
    return top.join(s, ["graph_id", "src"]).join(t, ["graph_id", "dst"]).select("graph_id", "edge_id", "rank", F.round(F.greatest("a", "b"), 6).alias("edge_pos"))


@query(
    "novel_facts",
    check("answers nodes edges", f"""WITH {MET_SQL}, acc AS (SELECT novel, {', '.join(f"avg(correct) FILTER (method = '{m}') AS {m}" for m in NAMES)} FROM answers GROUP BY novel)
    SELECT novel, round(graph_expand, 6) AS graph_expand, round(tail, 6) AS tail, round(vector, 6) AS vector, m.nodes, m.edges, round(m.isolate_rate, 6) AS isolate_rate,
      round(graph_expand - greatest(tail, compress, question_only), 6) AS gap FROM acc LEFT JOIN met m ON m.graph_id = cast(substr(novel, 4) AS INT)"""),
)
def novel_facts(spark, sf):
    """Per group: accuracies, size of its graph and the gap to its best baseline."""
    wide = answers(spark, sf).groupBy("novel").pivot("method", NAMES).agg(F.avg("correct"))
    m = metrics_of(spark, sf).select("graph_id", "nodes", "edges", "isolate_rate")
    out = wide.withColumn("graph_id", F.substring("novel", 4, 9).cast("int")).join(m, "graph_id", "left")
    gap = F.col("graph_expand") - F.greatest("tail", "compress", "question_only")
    return out.select("novel", *six("graph_expand", "tail", "vector"), "nodes", "edges", *six("isolate_rate"), F.round(gap, 6).alias("gap"))


@query(
    "profile",
    """SELECT 'text' AS "column", 'length' AS value, count(text) AS n, min(length(text)) AS low, max(length(text)) AS high, round(avg(length(text)), 6) AS mean FROM documents
    UNION ALL SELECT 'source', source, count(*), NULL, NULL, NULL FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*), NULL, NULL, NULL FROM documents GROUP BY lang""",
)
def profile(spark, sf):
    return E.column_profile(docs(spark, sf), ["text"], ["source", "lang"]).withColumn("mean", F.round("mean", 6))


@query(
    "context_chars",
    check("chunks questions own_units own_asks", f"""WITH {OWN}, {OWN_RANK}, p AS (SELECT o.qid, sum(length(c.text)) AS chars FROM ork o JOIN chunks c ON c.doc_id = o.qid AND c.chunk_idx = o.unit WHERE rank <= 3 GROUP BY 1)
    SELECT q.qid, m.method, cast(20 + CASE m.method WHEN 'question_only' THEN 0 WHEN 'tail' THEN least(50000, length(d.text)) ELSE coalesce(p.chars, 0) END AS BIGINT) AS chars
    FROM questions q JOIN documents d ON d.doc_id = q.qid LEFT JOIN p ON p.qid = q.qid CROSS JOIN (VALUES ('question_only'), ('tail'), ('passages')) m(method)"""),
)
def context_chars(spark, sf):
    """Characters each method reads: a fixed prompt plus nothing, the tail window or the passages."""
    chunks = S.chunk_fixed(doc_text(spark, sf)).select(F.col("doc_id").alias("qid"), F.col("chunk_idx").cast("long").alias("unit"), F.length("text").alias("len"))
    read = own_ranked(spark, sf, 3).join(chunks, ["qid", "unit"]).groupBy("qid").agg(F.sum("len").alias("passages"))
    rows = docs(spark, sf).select(F.col("doc_id").alias("qid"), F.least(F.lit(50000), F.length("text")).alias("tail")).join(read, "qid", "left")
    cost = lambda m, c: F.struct(F.lit(m).alias("method"), (20 + c).cast("long").alias("chars"))
    return rows.select("qid", F.inline(F.array(cost("question_only", F.lit(0)), cost("tail", F.col("tail")), cost("passages", F.coalesce("passages", F.lit(0))))))


@query(
    "answers_wide",
    check("answers", f"""WITH {WIDE} SELECT qid, novel, gold, {', '.join(NAMES)}, {' + '.join(f'CASE WHEN {m} IS NULL THEN 1 ELSE 0 END' for m in NAMES)} AS unparsed, true AS complete FROM wide"""),
)
def answers_wide(spark, sf):
    """One record per question with every method's letter, parse status and completeness."""
    a = answers(spark, sf)
    n = a.groupBy("qid").agg(F.count_if(F.col("selected").isNull()).alias("unparsed"), (F.count_distinct("method") == len(NAMES)).alias("complete"))
    return V.wide(a, NAMES, ["qid", "novel", "gold"]).join(n, "qid").select("qid", "novel", "gold", *NAMES, "unparsed", "complete")


@query(
    "position_check",
    check("lines spans", f"""WITH {STORY} SELECT doc_id, period, round(avg(text_position), 6) AS node_pos, round(avg(chunk_idx / n), 6) AS mean_line, round(min(chunk_idx / n), 6) AS min_line, round(max(chunk_idx / n), 6) AS max_line
    FROM placed JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1) t USING (doc_id) GROUP BY ALL"""),
)
def position_check(spark, sf):
    """Mean position of a node (here: a period) against the positions of its source lines."""
    p = placed_spans(spark, sf)
    n = relation(spark, sf, "lines").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    line = F.col("chunk_idx") / F.col("n")
    return p.join(n, "doc_id").groupBy("doc_id", "period").agg(
        F.round(F.avg("text_position"), 6).alias("node_pos"), F.round(F.avg(line), 6).alias("mean_line"), F.round(F.min(line), 6).alias("min_line"), F.round(F.max(line), 6).alias("max_line")
    )


@query(
    "stratum_first_n",
    """SELECT d.lang, l.doc_id, l.quality FROM labels l JOIN (SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) z WHERE r <= 25) d ON d.doc_id = l.doc_id""",
)
def stratum_first_n(spark, sf):
    """All questions of the first 25 documents per language."""
    first = top_k(docs(spark, sf).select("doc_id", "lang"), ["lang"], [F.col("doc_id")], 25).drop("rank")
    return table(spark, sf, "labels").join(first, "doc_id").select("lang", "doc_id", "quality")


@query(
    "ruler_segments",
    check("chunks", f"""SELECT doc_id, chunk_idx, kind, round(start / n, 6) AS x0, round(greatest("end" / n, start / n + 0.001), 6) AS x1 FROM (SELECT c.doc_id, chunk_idx, start, "end", length(d.text) AS n,
      CASE WHEN {H("'ru' || c.doc_id || ':' || chunk_idx")} % 3 = 0 THEN 'dropped' ELSE 'kept' END AS kind FROM chunks c JOIN documents d USING (doc_id)) t"""),
)
def ruler_segments(spark, sf):
    """Kept and dropped segments of each text on a 0..1 ruler."""
    chunks = S.chunk_fixed(docs(spark, sf).select("doc_id", F.length("text").alias("n"), "text"))
    kind = F.when(hash_mod(F.concat(F.lit("ru"), "doc_id", F.lit(":"), "chunk_idx"), 3) == 0, "dropped").otherwise("kept")
    x0 = F.col("start") / F.col("n")
    return chunks.select("doc_id", "chunk_idx", kind.alias("kind"), F.round(x0, 6).alias("x0"), F.round(F.greatest(F.col("end") / F.col("n"), x0 + 0.001), 6).alias("x1"))


@query("domain_summary", check("answers", "SELECT qtype AS domain, method, count(*) AS n, sum(correct)::BIGINT AS correct, round(avg(correct), 6) AS accuracy, round(count(selected) / count(*), 6) AS parse_rate FROM answers GROUP BY ALL"))
def domain_summary(spark, sf):
    return answers(spark, sf).groupBy(F.col("qtype").alias("domain"), "method").agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("correct"), F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.count("selected") / F.count(F.lit(1)), 6).alias("parse_rate")
    )


# -- set operations ------------------------------------------------------------------------
@query(
    "set_union_ordered",
    check("answers", """SELECT qid, selected, min(morder) AS first_at FROM answers WHERE selected IS NOT NULL AND method IN ('tail', 'vector', 'compress') GROUP BY ALL"""),
)
def set_union_ordered(spark, sf):
    """Distinct letters of three methods in order of first appearance."""
    a = answers(spark, sf).filter("selected is not null").select("qid", "selected", "morder", "method")
    parts = [a.filter(F.col("method") == m).drop("method") for m in ("tail", "vector", "compress")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("qid", "selected").agg(F.min("morder").alias("first_at"))


@query(
    "set_intersect_runs",
    check("answers", "SELECT qid FROM answers WHERE selected IS NOT NULL AND method IN ('graph_a', 'graph_b', 'graph_c', 'tail', 'vector') GROUP BY qid HAVING count(*) = 5"),
)
def set_intersect_runs(spark, sf):
    """Questions with a parsed answer in all of five runs."""
    a = answers(spark, sf).filter("selected is not null")
    runs = [a.filter(F.col("method") == m).select("qid") for m in ("graph_a", "graph_b", "graph_c", "tail", "vector")]
    out = runs[0]
    for r in runs[1:]:
        out = out.intersect(r)
    return out


@query("set_except_missing", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except_missing(spark, sf):
    return docs(spark, sf).select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id"))
