"""Registered queries: readers, writers, resume, drift and streaming jobs.

A query writes a given table in the layout under test to scratch space in the shared folder and
reads it back; the expected result is stated on the original table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import scratch_path, spread, table
from ..functions import constants as K
from ..functions.text import hash_mod
from ..sources import readers as R, sinks as W
from ..streaming import jobs as J
from .graph_queries import key_of
from .inputs import Dialect, check
from .registry import query
from .text_queries import docs
from .vote_queries import NAMES, answers

H = Dialect(False).h
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@query("src_jsonl", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def src_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    # a blank line after every record
    docs(spark, sf).select(F.concat(F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars")), F.lit("\n"))).write.text(path)
    return R.read_jsonl(spark, path, DOC)


HARD = ' } { "q" \\" {"a": 1}{ '


@query("src_json_concat", f"SELECT doc_id, text || '{HARD}' AS text, lang, source, n_chars FROM documents")
def src_json_concat(spark, sf):
    """Objects with braces and quotes inside their strings, some indented, with any white space between."""
    path = scratch_path(spark, "concat")
    fields = F.struct("doc_id", "text", "lang", "source", "n_chars")
    rows = docs(spark, sf).withColumn("text", F.concat("text", F.lit(HARD)))
    raw = F.when(F.col("doc_id") % 3 == 0, F.to_json(fields, {"pretty": "true"})).otherwise(F.to_json(fields))
    rows = rows.withColumn("raw", F.concat(raw, F.when(F.col("doc_id") % 2 == 0, "").otherwise(" \t")))
    rows.groupBy(F.floor(F.col("doc_id") / 5)).agg(F.array_join(F.collect_list("raw"), "").alias("value")).select("value").write.text(path)
    return R.read_concatenated_json(spark, path, DOC)


@query("src_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'a \"quoted\", ' || c_mktsegment AS note FROM customer")
def src_csv(spark, sf):
    path = scratch_path(spark, "csv")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("﻿c_custkey"), "c_name", "c_nationkey", "c_acctbal", F.concat(F.lit('a "quoted", '), "c_mktsegment").alias("note")
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return R.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, note string")


@query("src_wholetext", "SELECT page_id, html AS text FROM pages")
def src_wholetext(spark, sf):
    path = scratch_path(spark, "texts")
    # a file for each page takes its time whatever its size, so a few splits are dealt out to all cores
    spread(table(spark, sf, "pages").select("page_id", "html"), "page_id").write.partitionBy("page_id").text(path)
    rows = R.read_texts(spark, path, r"page_id=(\d+)/")
    return rows.select(F.col("key").cast("long").alias("page_id"), F.regexp_replace("text", "\n$", "").alias("text"))


@query(
    "src_answer_tree",
    check("answers", "SELECT a.qid, a.method, CASE WHEN l.quality = 1 THEN 'Z' WHEN l.toxic = 1 THEN 'Y' ELSE a.selected END AS selected, a.gold FROM answers a JOIN labels l ON l.doc_id = a.qid"),
)
def src_answer_tree(spark, sf):
    """Three runs in a tree: answers by line, one indented answer after the other, indented arrays; later runs overwrite."""
    path = scratch_path(spark, "tree")
    a = answers(spark, sf).select("novel", "qid", "method", "selected", "gold")
    a.write.partitionBy("novel").json(f"{path}/run_1")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), "quality", "toxic")
    again = a.join(labels, "qid")
    answer = F.struct("qid", "method", "selected", "gold")
    second = again.filter("toxic = 1").withColumn("selected", F.lit("Y"))
    second.select("novel", F.to_json(answer, {"pretty": "true"}).alias("value")).write.partitionBy("novel").option("compression", "none").text(f"{path}/run_2")
    third = again.filter("quality = 1").withColumn("selected", F.lit("Z"))
    third.groupBy("novel").agg(F.to_json(F.collect_list(answer), {"pretty": "true"}).alias("value")).write.partitionBy("novel").text(f"{path}/run_3")
    return R.read_answer_tree(spark, path, "qid long, method string, selected string, gold string", ["qid", "method"], glob="part-*")


LISTED = """["Bob's x0", 'the x1', 'it\\'s "x2"', '\\\\ x3']"""


@query(
    "src_cases_union",
    """SELECT CASE lang WHEN 'en' THEN 'list' WHEN 'fr' THEN 'map' WHEN 'de' THEN 'annotated' ELSE 'pairs' END AS dataset, doc_id::VARCHAR AS case_id, 'Which one, ' || source || '?' AS question,
      CASE WHEN lang = 'en' THEN 'Bob''s x0|the x1|it''s "x2"|\\ x3' WHEN lang IN ('fr', 'de') THEN 'x0|x1|x2|x3' END AS choices, CASE WHEN lang IN ('en', 'fr', 'de') THEN doc_id % 4 END AS gold_index,
      CASE WHEN lang = 'en' THEN ['Bob''s x0', 'the x1', 'it''s "x2"', '\\ x3'][(doc_id % 4 + 1)::INT] WHEN lang IN ('fr', 'de') THEN 'x' || (doc_id % 4) END AS gold_text, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN (doc_id % 7) || ':' || (doc_id % 5) END AS gold_pairs FROM documents""",
)
def src_cases_union(spark, sf):
    """One layout per language of the documents, converted to one case model."""
    d = docs(spark, sf).select(F.col("doc_id").alias("case_id"), "lang", F.concat(F.lit("Which one, "), "source", F.lit("?")).alias("question"))
    index = (F.col("case_id") % 4).cast("int")
    letter = F.lit(K.LETTERS).substr(index + 1, F.lit(1))
    options = F.create_map(*[F.lit(x) for i, n in enumerate(K.LETTERS) for x in (n, f"x{i}")])
    a = R.from_list_layout(d.filter("lang = 'en'").withColumn("choices", F.lit(LISTED)).withColumn("answer_index", index))
    b = R.from_option_map(d.filter("lang = 'fr'").withColumn("options", options).withColumn("answer", F.lower(letter)), "map")
    de = d.filter("lang = 'de'")
    notes = de.select("case_id", F.array(F.struct("question", options.alias("options"), letter.alias("answer"))).alias("questions"))
    c = R.from_annotations(de, notes)
    pairs = F.array(F.array((F.col("case_id") % 5).cast("int"), (F.col("case_id") % 7).cast("int")))
    e = R.from_pairs(d.filter("lang not in ('en', 'fr', 'de')").withColumn("pairs", pairs))
    out = a.unionByName(b).unionByName(c).unionByName(e)
    shown = F.array_join(F.transform("gold_pairs", lambda p: F.concat_ws(":", p[0].cast("string"), p[1].cast("string"))), ",")
    return out.withColumn("choices", F.array_join("choices", "|")).withColumn("gold_pairs", shown)


@query(
    "src_tree_leaves",
    check("lines", """SELECT doc_id, seq::VARCHAR AS path, text AS value, 'fact' AS fact_type, 'and' AS operator, (seq % 3)::VARCHAR AS deduction_type, seq % 2 = 0 AS prunable FROM lines WHERE length(text) <= 100
    UNION ALL SELECT doc_id, seq || '.0', left(text, 50), 'explicit', 'or', 'syllogism', true FROM lines WHERE length(text) > 100
    UNION ALL SELECT doc_id, seq || '.1', substr(text, 51), 'commonsense', 'or', NULL, false FROM lines WHERE length(text) > 100"""),
)
def src_tree_leaves(spark, sf):
    """Each document as a tree: its lines, long lines split in two."""
    def leaf(v, kind, deduction, prunable):
        return F.struct(v.alias("value"), F.lit(kind).alias("fact_type"), F.lit("or").alias("operator"), F.lit(deduction).cast("string").alias("deduction_type"), F.lit(prunable).alias("prunable"))

    def branch(x, i):
        long = F.array(leaf(F.left(x, F.lit(50)), "explicit", "syllogism", True), leaf(F.substring(x, 51, F.length(x)), "commonsense", None, False))
        return F.struct(
            x.alias("value"), F.lit("fact").alias("fact_type"), F.lit("and").alias("operator"), (i % 3).cast("string").alias("deduction_type"), (i % 2 == 0).alias("prunable"),
            F.when(F.length(x) > 100, long).alias("children"),
        )

    tree = F.to_json(F.struct(F.lit("root").alias("value"), F.transform(F.split("text", "\n"), branch).alias("children")))
    return R.tree_leaves(docs(spark, sf).select("doc_id", tree.alias("tree")), ["doc_id"])


@query(
    "src_sections",
    check("lines", """SELECT doc_id, CASE WHEN seq % 2 = 0 THEN 'evidence' ELSE 'testimony' END AS kind, seq + 1 AS number, trim(text) AS item FROM lines WHERE regexp_replace(text, '[\\s]+', '', 'g') <> ''"""),
)
def src_sections(spark, sf):
    """Even lines become an Evidence section, odd ones a Testimony section."""
    every = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    tag = lambda kind: lambda s: F.concat(F.lit("["), (s["i"] + 1).cast("string"), F.lit(f"] {kind}: "), s["x"])
    part = lambda odd, kind: F.array_join(F.transform(F.filter(every, lambda s: s["i"] % 2 == odd), tag(kind)), "\n")
    text = F.concat(F.lit("intro\nEvidence:\n"), part(0, "Name"), F.lit("\nTestimonies\n"), part(1, "Testimony"))
    return R.section_items(docs(spark, sf).select("doc_id", text.alias("text")), ["doc_id"])


@query(
    "merged_cases",
    """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS qi FROM (SELECT source, text, min(doc_id) AS doc_id FROM documents GROUP BY ALL) t""",
)
def merged_cases(spark, sf):
    """Documents act as questions: exact copies inside a source count once."""
    q = docs(spark, sf).select("source", "text", "doc_id", F.floor(F.col("doc_id") / 4096).alias("part"))
    return R.merged_cases(q, "source", "text", ["doc_id"], "part").select("source", "doc_id", "qi")


@query(
    "gold_lookup",
    """SELECT d.source || CASE WHEN l.toxic = 1 THEN '_ai_anno_' ELSE '_human_anno_' END || l.doc_id AS qid, l.quality AS answer FROM labels l JOIN documents d USING (doc_id)""",
)
def gold_lookup(spark, sf):
    """Gold rows found through the parts of a question id: group, annotator, number."""
    lab = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    who = F.when(F.col("toxic") == 1, "ai").otherwise("human")
    gold = lab.select(F.col("source").alias("novel"), who.alias("annotator"), F.col("doc_id").alias("qi"), F.col("quality").alias("answer"))
    asked = lab.select(F.concat("source", F.lit("_"), who, F.lit("_anno_"), F.col("doc_id").cast("string")).alias("qid"))
    part = lambda i: F.regexp_extract("qid", r"^(.+)_(human|ai)_anno_(\d+)$", i)
    keyed = asked.select("qid", part(1).alias("novel"), part(2).alias("annotator"), part(3).cast("long").alias("qi"))
    return keyed.join(gold, ["novel", "annotator", "qi"]).select("qid", "answer")


@query("sink_json", check("answers", "SELECT qid, method, selected, correct FROM answers"))
def sink_json(spark, sf):
    path = scratch_path(spark, "sink")
    W.write_json(answers(spark, sf).select("qid", "method", "selected", "correct"), path)
    return R.read_jsonl(spark, path, "qid long, method string, selected string, correct int")


@query("sink_csv", check("answers", "SELECT method, cohort, sum(correct)::BIGINT AS correct, count(*) AS total FROM answers GROUP BY ALL"))
def sink_csv(spark, sf):
    path = scratch_path(spark, "report")
    rep = answers(spark, sf).groupBy("cohort", "method").agg(F.count(F.lit(1)).alias("total"), F.sum("correct").alias("correct"))
    W.write_report(rep, path, ["method", "cohort", "correct", "total"], files=1)
    return R.read_csv(spark, path, "method string, cohort string, correct long, total long")


@query("archive_answers", check("answers", "SELECT qid, count(*) AS methods, count(selected) AS parsed FROM answers GROUP BY qid"))
def archive_answers(spark, sf):
    path = scratch_path(spark, "archive")
    W.archive_answers(answers(spark, sf).select("qid", "method", "selected"), path, len(NAMES))
    rows = R.read_jsonl(spark, path, "qid long, method string, selected string")
    return rows.groupBy("qid").agg(F.count(F.lit(1)).alias("methods"), F.count("selected").alias("parsed"))


@query(
    "fingerprint",
    check("lines", "SELECT doc_id, left(sha1(string_agg(seq || chr(9) || text || chr(10), '' ORDER BY seq) || '1500v2'), 12) AS fp FROM lines GROUP BY doc_id"),
)
def fingerprint(spark, sf):
    return docs(spark, sf).select("doc_id", W.text_fingerprint("text", 1500, "v2").alias("fp"))


@query(
    "resume_anti",
    f"""SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0 AND {H("'ver' || l.doc_id")} % 5 > 0)""",
)
def resume_anti(spark, sf):
    """Documents to process again: no result, a failed one, or one for other content."""
    items = docs(spark, sf).select("doc_id", F.lit(2).alias("version"), F.sha1("text").alias("source_hash"))
    stale = hash_mod(key_of("ver", "doc_id"), 5) == 0
    done = table(spark, sf, "labels").join(items, "doc_id").select(
        "doc_id", "version", F.when(stale, F.lit("old")).otherwise(F.col("source_hash")).alias("source_hash"), F.when(F.col("toxic") == 1, "timeout").alias("error")
    )
    return W.pending(items, done, ["doc_id", "version", "source_hash"]).select("doc_id")


@query(
    "manifest_drift",
    """SELECT source AS key, CASE source WHEN 'src3' THEN 'missing' WHEN 'src7' THEN 'new' ELSE CASE WHEN max(n_chars) > 12000 THEN 'changed' ELSE 'same' END END AS state FROM documents GROUP BY source""",
)
def manifest_drift(spark, sf):
    """Two frozen copies of the texts: one source vanishes, one appears, those with long texts change."""
    d = docs(spark, sf).select("source", "doc_id", "text", "n_chars")
    base = scratch_path(spark, "frozen")

    def freeze(rows, name):
        rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", F.to_json(F.struct("doc_id", "text")).alias("value")).write.partitionBy("source").text(f"{base}/{name}")
        return W.manifest(spark, f"{base}/{name}", r"source=([^/]+)/")

    edited = d.withColumn("text", F.when(F.col("n_chars") > 12000, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return W.drift(freeze(d.filter("source <> 'src7'"), "old"), freeze(edited.filter("source <> 'src3'"), "new"))


# -- streaming -------------------------------------------------------------------------------
ANSWER = "qid long, method string, morder long, selected string, correct int"
EVENT = "event_id long, ts timestamp, user_id long, event_type string"


def answer_feed(spark, sf):
    path = scratch_path(spark, "feed")
    answers(spark, sf).select("qid", "method", "morder", "selected", "correct").repartition(6, "qid", "method").write.json(path)
    return J.json_feed(spark, path, ANSWER, files_per_batch=2)


def event_feed(spark, sf):
    path = scratch_path(spark, "events")
    table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type").repartition(4, "event_id").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return J.json_feed(spark, path, EVENT)


def run(spark, df, name, mode="append"):
    base = scratch_path(spark, name)
    return J.run_to_files(df, f"{base}/out", f"{base}/state", mode)


@query("stream_accuracy", check("answers", "SELECT method, count(*) AS answered, sum(correct)::BIGINT AS correct, round(avg(correct), 6) AS accuracy FROM answers GROUP BY method"))
def stream_accuracy(spark, sf):
    return run(spark, J.running_accuracy(answer_feed(spark, sf)), "accuracy", "complete")


@query(
    "stream_vote",
    check("answers", """SELECT qid, arg_max(selected, (n, late)) AS winner, sum(n)::BIGINT AS "cast" FROM (SELECT qid, selected, count(*) AS n, max(morder) AS late FROM answers
      WHERE selected IS NOT NULL GROUP BY ALL) t GROUP BY qid HAVING sum(n) >= 2"""),
)
def stream_vote(spark, sf):
    """The last emission per question once all files are in."""
    out = run(spark, J.incremental_votes(answer_feed(spark, sf)), "vote", "update")
    return out.groupBy("qid").agg(F.max_by("winner", "updated").alias("winner"), F.max("cast").cast("long").alias("cast"))


TIMED = "qid long, method string, morder long, selected string, ts timestamp"


@query(
    "stream_vote_closed",
    check("answers", """WITH t AS (SELECT *, epoch_ms(TIMESTAMP '2024-01-01') + qid * 60000 + morder * 1000 AS ms FROM answers),
      c AS (SELECT qid, max(ms) AS latest, count(DISTINCT CASE WHEN selected IS NOT NULL THEN morder END) AS votes FROM t GROUP BY qid),
      v AS (SELECT qid, arg_max(selected, (n, late)) AS winner FROM (SELECT qid, selected, count(*) AS n, max(morder) AS late FROM answers WHERE selected IS NOT NULL GROUP BY ALL) z GROUP BY qid)
    SELECT qid, CASE WHEN votes >= 2 THEN winner END AS winner, votes AS "cast", latest FROM c LEFT JOIN v USING (qid) WHERE latest + 1800000 < (SELECT max(ms) - 600000 FROM t)"""),
)
def stream_vote_closed(spark, sf):
    """Final votes: question q is asked in minute q, each method answers a second after the one before, half an hour idle closes."""
    path = scratch_path(spark, "timed")
    at = F.unix_millis(F.lit("2024-01-01").cast("timestamp")) + F.col("qid") * 60000 + F.col("morder") * 1000
    rows = answers(spark, sf).select("qid", "method", "morder", "selected", F.timestamp_millis(at.cast("long")).alias("ts"))
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    out = run(spark, J.closing_votes(J.json_feed(spark, path, TIMED), "10 minutes", 1_800_000), "closed")
    return out.select("qid", "winner", F.col("cast").cast("long").alias("cast"), "latest")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    out = run(spark, J.first_answers(event_feed(spark, sf), ["user_id", "event_type"], "60 days"), "dedup")
    return out.select("user_id", "event_type")


CLOSED = "(SELECT time_bucket(INTERVAL '1 millisecond', max(ts)) - INTERVAL '2 hours' AS wm FROM events)"


@query(
    "stream_rate_tumbling",
    f"""WITH w AS (SELECT start, event_type, n FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) w, {CLOSED} c WHERE start + INTERVAL '1 hour' <= wm),
      r AS (SELECT w.*, t.total - sum(n) OVER (PARTITION BY event_type ORDER BY start) AS remaining FROM w JOIN (SELECT event_type, count(*) AS total FROM events GROUP BY 1) t USING (event_type))
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, remaining::BIGINT AS remaining, round(remaining * 3600 / n, 6) AS eta FROM r""",
)
def stream_rate_tumbling(spark, sf):
    """Rate per hour, what is left of each type's events, and the time they take at that rate."""
    out = run(spark, J.rate(event_feed(spark, sf), "2 hours", "1 hour"), "tumbling")
    totals = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))
    out = J.with_eta(out, totals, 3600)
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "remaining", F.round("eta", 6).alias("eta"))


@query(
    "stream_rate_sliding",
    f"""SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, event_type, count(*) AS n FROM events, range(4) r(k) GROUP BY ALL) w, {CLOSED} c
    WHERE start + INTERVAL '2 hours' <= wm""",
)
def stream_rate_sliding(spark, sf):
    out = run(spark, J.rate(event_feed(spark, sf), "2 hours", "2 hours", "30 minutes"), "sliding")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER u + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, n FROM (SELECT user_id, sid, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY ALL) z, {CLOSED} c WHERE b + INTERVAL '6 hours' <= wm""",
)
def stream_sessions(spark, sf):
    out = run(spark, J.work_sessions(event_feed(spark, sf), "2 hours", "6 hours"), "sessions")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    "stream_late",
    """WITH early AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20' AND event_type <> 'error'), late AS (SELECT * FROM events WHERE NOT (ts < TIMESTAMP '2024-01-20' AND event_type <> 'error')),
      w1 AS (SELECT time_bucket(INTERVAL '1 millisecond', max(ts)) - INTERVAL '1 hour' AS wm FROM early), w2 AS (SELECT time_bucket(INTERVAL '1 millisecond', max(ts)) - INTERVAL '1 hour' AS wm FROM events),
      used AS (SELECT date_trunc('hour', ts) AS start, event_type FROM early UNION ALL SELECT date_trunc('hour', ts), event_type FROM late, w1 WHERE date_trunc('hour', ts) + INTERVAL '1 hour' > wm)
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM used, w2 WHERE start + INTERVAL '1 hour' <= wm GROUP BY ALL""",
)
def stream_late(spark, sf):
    """Errors of the first weeks arrive after the watermark has passed them and are dropped."""
    base = scratch_path(spark, "late")
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    on_time = (F.col("ts") < F.lit("2024-01-20").cast("timestamp")) & (F.col("event_type") != "error")
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    feed = lambda: J.rate(J.json_feed(spark, f"{base}/in", EVENT), "1 hour", "1 hour")
    for part in (ev.filter(on_time), ev.filter(~on_time)):
        part.write.mode("append").option("timestampFormat", fmt).json(f"{base}/in")
        out = J.run_to_files(feed(), f"{base}/out", f"{base}/state")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
