"""Registered queries: scalar text functions, segmentation and story order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import cut_lineage, table
from ..functions import constants as K, text as T
from ..operators import segment as S
from .inputs import check, relation
from .registry import query

WS = r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NORM = lambda c: f"lower(trim(regexp_replace({c}, '{WS}', ' ', 'g')))"
TOKENS = f"regexp_extract_all(lower({{}}), '{K.TOKEN_PATTERN}')".format
STOP = ",".join(f"'{w}'" for w in K.STOP_WORDS)
DAY = r"TRY_CAST(nullif(regexp_extract(lower(trim(time_label)), '(?:day|d)\s*(\d+)', 1), '') AS INT)"
PERIOD = "CASE " + " ".join(f"WHEN contains(lower(time_label), '{p}') THEN '{p}'" for p in K.PERIODS) + " ELSE 'unknown' END"
RANK = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.PERIOD_RANK.items()) + " ELSE 0 END"
HOUR = "CASE period " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.PERIOD_HOUR.items()) + " END"
SPAN_H = "CASE period " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.PERIOD_DURATION.items()) + " END"


def docs(spark, sf):
    return table(spark, sf, "documents")


def doc_text(spark, sf, *keep):
    return docs(spark, sf).select("doc_id", *keep, "text")


@query("norm_text", f"SELECT doc_id, {NORM('text')} AS norm FROM documents")
def norm_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.norm_text("text").alias("norm"))


NAME = "trim(regexp_replace(regexp_replace({}, '^the\\s+', ''), '[^a-z0-9一-鿿]+', ' ', 'g'))".format


@query(
    "canonical_name",
    f"""SELECT 'doc' AS kind, doc_id AS id, {NAME(NORM('text'))} AS name FROM documents
    UNION ALL SELECT 'part', p_partkey, {NAME(NORM("'The ' || p_name || ' (' || p_brand || ')'"))} FROM part""",
)
def canonical_name(spark, sf):
    parts = table(spark, sf, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"),
        T.canonical_name(F.concat(F.lit("The "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"),
    )
    texts = docs(spark, sf).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), T.canonical_name("text").alias("name"))
    return texts.unionByName(parts)


@query(
    "squash_text",
    r"SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g')) AS squashed FROM documents",
)
def squash_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.squash_text("text").alias("squashed"))


@query(
    "time_label",
    check("spans", f"""SELECT doc_id, chunk_idx, day, period, {RANK.format('period')} AS period_rank
    FROM (SELECT doc_id, chunk_idx, {DAY} AS day, {PERIOD} AS period FROM spans) t"""),
)
def time_label(spark, sf):
    out = S.with_story_time(relation(spark, sf, "spans"))
    return out.select("doc_id", "chunk_idx", "day", "period", T.period_rank("period").alias("period_rank"))


@query("tokens", f"SELECT doc_id, array_to_string({TOKENS('text')}, ' ') AS tokens, len({TOKENS('text')}) AS n FROM documents")
def tokens(spark, sf):
    toks = T.tokenize("text")
    return docs(spark, sf).select("doc_id", F.array_join(toks, " ").alias("tokens"), F.size(toks).alias("n"))


@query(
    "content_tokens",
    f"""SELECT doc_id, coalesce(string_agg(tok, ' ' ORDER BY tok), '') AS terms, count(tok) AS n FROM (
      SELECT doc_id, tok FROM (SELECT DISTINCT doc_id, unnest({TOKENS('text')}) AS tok FROM documents) t
      WHERE length(tok) > 1 AND tok NOT IN ({STOP})
      UNION ALL SELECT doc_id, NULL FROM documents) u GROUP BY doc_id""",
)
def content_tokens(spark, sf):
    terms = F.array_sort(T.content_tokens("text"))
    return docs(spark, sf).select("doc_id", F.array_join(terms, " ").alias("terms"), F.size(terms).alias("n"))


@query(
    "text_windows",
    """SELECT d.doc_id, l.quality * 700 - 100 AS mask,
      CASE WHEN l.quality * 700 - 100 > 0 THEN left(text, l.quality * 700 - 100) ELSE text END AS visible,
      right(text, 500) AS tail_text,
      CASE WHEN length(text) > 1000 THEN left(text, 600) || chr(10) || '...' || chr(10) || right(text, 400) ELSE text END AS head_tail
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def text_windows(spark, sf):
    masks = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 700 - 100).alias("mask"))
    return docs(spark, sf).join(masks, "doc_id").select(
        "doc_id", "mask", T.visible_prefix("text", "mask").alias("visible"),
        T.tail_window("text", 500).alias("tail_text"), T.head_tail("text", 600, 400).alias("head_tail"),
    )


# -- segmentation ------------------------------------------------------------
@query("chunk_fixed", check("chunks", 'SELECT doc_id, chunk_idx, start, "end", text FROM chunks'))
def chunk_fixed(spark, sf):
    return S.chunk_fixed(doc_text(spark, sf)).select("doc_id", "chunk_idx", "start", "end", "text")


@query(
    "chunk_lines",
    check("lines", """WITH RECURSIVE packed(doc_id, seq, chunk_idx, used) AS (
      SELECT doc_id, seq, 0::BIGINT, length(text) + 1 FROM lines WHERE seq = 0
      UNION ALL
      SELECT l.doc_id, l.seq, CASE WHEN p.used + length(l.text) + 1 > 1500 THEN p.chunk_idx + 1 ELSE p.chunk_idx END,
        CASE WHEN p.used + length(l.text) + 1 > 1500 THEN length(l.text) + 1 ELSE p.used + length(l.text) + 1 END
      FROM packed p JOIN lines l ON l.doc_id = p.doc_id AND l.seq = p.seq + 1),
    grp AS (SELECT p.doc_id, p.chunk_idx, min(p.seq) AS first_line, max(p.seq) AS last_line,
        string_agg(l.text, chr(10) ORDER BY p.seq) AS text, sum(length(l.text) + 1) AS span
      FROM packed p JOIN lines l USING (doc_id, seq) GROUP BY p.doc_id, p.chunk_idx)
    SELECT doc_id, chunk_idx, first_line, last_line, start, start + length(text) AS "end", text FROM (
      SELECT *, cast(coalesce(sum(span) OVER (PARTITION BY doc_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM grp) g"""),
)
def chunk_lines(spark, sf):
    return S.chunk_lines(doc_text(spark, sf))


SENT_SQL = f"""SELECT doc_id, idx, start, "end", trim_text AS text FROM (
  SELECT doc_id, idx, lead + cast(coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, s,
    regexp_replace(s, '^{WS}|{WS}$', '', 'g') AS trim_text FROM (
    SELECT doc_id, length(regexp_extract(text, '^[.!?。！？]*')) AS lead,
      generate_subscripts(regexp_extract_all(text, '{S.SENTENCE}'), 1) - 1 AS idx,
      unnest(regexp_extract_all(text, '{S.SENTENCE}')) AS s FROM documents) a) b, LATERAL (SELECT start + length(s) AS "end") e
  WHERE length(trim_text) >= 1"""


@query("sentences", SENT_SQL)
def sentences(spark, sf):
    return S.sentence_spans(doc_text(spark, sf)).select("doc_id", "idx", "start", "end", "text")


LINE_OFF = """SELECT doc_id, seq, text, start, start + length(text) AS "end" FROM (
  SELECT doc_id, seq, text, cast(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines) o"""


@query("line_spans", check("lines", f"""SELECT doc_id, seq AS idx, text, start, "end" FROM ({LINE_OFF}) l WHERE trim(text) <> ''"""))
def line_spans(spark, sf):
    return S.line_spans(doc_text(spark, sf)).select("doc_id", "idx", "text", "start", "end")


def marked_docs(spark, sf):
    """Documents with a ``[n]`` marker in front of every line."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    return docs(spark, sf).select("doc_id", F.array_join(marked, "\n").alias("text"))


PARA_SQL = """SELECT doc_id, seq + 1 AS para_no, start, start + length(body) + has_next AS "end",
    body || CASE WHEN has_next = 1 THEN chr(10) ELSE '' END AS text, total AS n_chars FROM (
  SELECT doc_id, seq, body, cast(coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CASE WHEN lead(seq) OVER (PARTITION BY doc_id ORDER BY seq) IS NULL THEN 0 ELSE 1 END AS has_next,
    sum(length(body) + 1) OVER (PARTITION BY doc_id) - 1 AS total
  FROM (SELECT doc_id, seq, '[' || (seq + 1) || '] ' || text AS body FROM lines) m) p"""


@query("paragraphs", check("lines", f'SELECT doc_id, para_no, start, "end", text FROM ({PARA_SQL}) q'))
def paragraphs(spark, sf):
    return S.paragraphs(marked_docs(spark, sf)).select("doc_id", "para_no", "start", "end", "text")


@query(
    "mask_position",
    check("lines", f"""SELECT l.doc_id, p.para_no, p.start AS mask_char, round(p.start / n_chars, 6) AS mask_ratio
    FROM labels l JOIN ({PARA_SQL}) p ON l.doc_id = p.doc_id AND p.para_no = 1 + l.quality * 3 + l.toxic"""),
)
def mask_position(spark, sf):
    marked = marked_docs(spark, sf).withColumn("n_chars", F.length("text"))
    answers = table(spark, sf, "labels").select("doc_id", (1 + F.col("quality") * 3 + F.col("toxic")).alias("para_no"))
    out = S.mask_position(S.paragraphs(marked), answers)
    return out.withColumn("mask_ratio", F.round("mask_ratio", 6))


# -- story order -------------------------------------------------------------
STORY = f"""timed AS (SELECT doc_id, chunk_idx, span_idx, text, time_label, {DAY} AS day, {PERIOD} AS period FROM spans),
filled AS (SELECT *, cast(coalesce(day, last_value(day IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(day IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    chunk_idx) AS DOUBLE) AS day_filled FROM timed),
placed AS (SELECT f.*, CASE WHEN known = 0 THEN least(chunk_idx / cast(chunks AS DOUBLE), 1.0)
    WHEN hi = lo THEN 0.5 ELSE (day_filled - lo) / (hi - lo) END AS time_position,
    o.start / cast(d.n AS DOUBLE) AS text_position FROM filled f
  JOIN (SELECT doc_id, min(day_filled) lo, max(day_filled) hi, count(day) known, max(chunk_idx) + 1 chunks FROM filled GROUP BY doc_id) b USING (doc_id)
  JOIN ({LINE_OFF}) o ON o.doc_id = f.doc_id AND o.seq = f.chunk_idx
  JOIN (SELECT doc_id, greatest(length(text), 1) AS n FROM documents) d ON d.doc_id = f.doc_id),
hours AS (SELECT doc_id, chunk_idx, text_position, period, coalesce(sday, 1) * 24 + {HOUR} + {SPAN_H} *
    CASE WHEN max(text_position) OVER g > min(text_position) OVER g
      THEN (text_position - min(text_position) OVER g) / (max(text_position) OVER g - min(text_position) OVER g) ELSE 0.5 END AS hour
  FROM (SELECT *, coalesce(day, CASE WHEN day_filled <= 10 THEN cast(round_even(day_filled, 0) AS INT) END) AS sday FROM placed) p
  WINDOW g AS (PARTITION BY doc_id, sday, period)),
climb AS (SELECT doc_id, chunk_idx, text_position, hour, max(hour) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS top_hour FROM hours)"""


def timed_spans(spark, sf):
    return S.with_story_time(relation(spark, sf, "spans"))


def placed_spans(spark, sf):
    filled = S.story_positions(cut_lineage(S.day_fill(timed_spans(spark, sf), ["doc_id"])), ["doc_id"])
    n = docs(spark, sf).select("doc_id", F.greatest(F.length("text"), F.lit(1)).alias("n_text"))
    starts = S.line_spans(doc_text(spark, sf)).select("doc_id", F.col("idx").alias("chunk_idx"), "start")
    return (
        filled.join(starts, ["doc_id", "chunk_idx"]).join(n, "doc_id")
        .withColumn("text_position", F.col("start") / F.col("n_text")).drop("start", "n_text")
    )


def hour_spans(spark, sf):
    hours = cut_lineage(S.story_hours(cut_lineage(placed_spans(spark, sf)), ["doc_id"]))
    return cut_lineage(S.running_max(hours, ["doc_id"], "chunk_idx", "hour", "top_hour"))


@query(
    "span_dedup",
    check("spans", f"""SELECT doc_id, chunk_idx, span_idx, text FROM (SELECT *, row_number() OVER (
      PARTITION BY doc_id, {NORM('text')} ORDER BY chunk_idx, span_idx) AS rn FROM spans WHERE {NORM('text')} <> '') t WHERE rn = 1"""),
)
def span_dedup(spark, sf):
    return S.span_dedup(relation(spark, sf, "spans"), ["doc_id"]).select("doc_id", "chunk_idx", "span_idx", "text")


@query("day_fill", check("lines spans", f"WITH {STORY} SELECT doc_id, chunk_idx, day, day_filled FROM filled"))
def day_fill(spark, sf):
    return S.day_fill(timed_spans(spark, sf), ["doc_id"]).select("doc_id", "chunk_idx", "day", "day_filled")


@query(
    "story_positions",
    check("lines spans", f"WITH {STORY} SELECT doc_id, chunk_idx, round(time_position, 6) AS time_position, round(text_position, 6) AS text_position FROM placed"),
)
def story_positions(spark, sf):
    return placed_spans(spark, sf).select(
        "doc_id", "chunk_idx", F.round("time_position", 6).alias("time_position"), F.round("text_position", 6).alias("text_position")
    )


@query(
    "story_order",
    check("lines spans", f"""WITH {STORY} SELECT doc_id, chunk_idx, row_number() OVER (PARTITION BY doc_id
      ORDER BY day_filled, {RANK.format('period')}, chunk_idx, span_idx) - 1 AS seq FROM filled"""),
)
def story_order(spark, sf):
    filled = S.day_fill(timed_spans(spark, sf), ["doc_id"])
    return S.story_order(filled, ["doc_id"]).select("doc_id", "chunk_idx", "seq")


@query("story_hours", check("lines spans", f"WITH {STORY} SELECT doc_id, chunk_idx, round(hour, 6) AS hour FROM hours"))
def story_hours(spark, sf):
    return S.story_hours(placed_spans(spark, sf), ["doc_id"]).select("doc_id", "chunk_idx", F.round("hour", 6).alias("hour"))


@query("story_hours_cummax", check("lines spans", f"WITH {STORY} SELECT doc_id, chunk_idx, round(top_hour, 6) AS top_hour FROM climb"))
def story_hours_cummax(spark, sf):
    return hour_spans(spark, sf).select("doc_id", "chunk_idx", F.round("top_hour", 6).alias("top_hour"))


GRID = """SELECT doc_id, cell, round(1e-9 + CASE WHEN px IS NULL THEN ny WHEN nx IS NULL OR nx = px THEN py
    ELSE py + (ny - py) / (nx - px) * (gx - px) END, 6) AS value FROM (
  SELECT g.doc_id, g.cell, g.gx, p.text_position AS px, p.top_hour AS py, n.text_position AS nx, n.top_hour AS ny
  FROM (SELECT doc_id, cell, (cell + 0.5) / 60 AS gx FROM (SELECT DISTINCT doc_id FROM climb) d, range(60) r(cell)) g
  ASOF LEFT JOIN climb p ON g.doc_id = p.doc_id AND g.gx >= p.text_position
  ASOF LEFT JOIN climb n ON g.doc_id = n.doc_id AND g.gx < n.text_position) j"""


@query("interp_grid", check("lines spans", f"WITH {STORY} {GRID}"))
def interp_grid(spark, sf):
    grid = S.interp_grid(hour_spans(spark, sf), ["doc_id"], "text_position", "top_hour", 60)
    return grid.select("doc_id", "cell", F.round(F.col("value") + 1e-9, 6).alias("value"))


HOUR_AT = """, asked AS (SELECT doc_id, cast(unnest(range(cast(ceil(min(top_hour)) AS BIGINT), cast(floor(max(top_hour)) AS BIGINT) + 1)) AS DOUBLE) AS at_hour
    FROM climb GROUP BY doc_id),
  prev AS (SELECT a.doc_id, a.at_hour, max(struct_pack(x := top_hour, y := text_position)) AS p FROM asked a JOIN climb c
    ON a.doc_id = c.doc_id AND c.top_hour <= a.at_hour GROUP BY ALL),
  nxt AS (SELECT a.doc_id, a.at_hour, min(struct_pack(x := top_hour, y := text_position)) AS n FROM asked a JOIN climb c
    ON a.doc_id = c.doc_id AND c.top_hour > a.at_hour GROUP BY ALL)
  SELECT a.doc_id, a.at_hour, round(1e-9 + CASE WHEN p.p IS NULL THEN n.n.y WHEN n.n IS NULL THEN p.p.y
    ELSE p.p.y + (n.n.y - p.p.y) / (n.n.x - p.p.x) * (a.at_hour - p.p.x) END, 6) AS position
  FROM asked a LEFT JOIN prev p USING (doc_id, at_hour) LEFT JOIN nxt n USING (doc_id, at_hour)"""


@query("interp_hours", check("lines spans", f"WITH {STORY} {HOUR_AT}"))
def interp_hours(spark, sf):
    """Text position at which each whole story hour is reached."""
    climb = hour_spans(spark, sf)
    bounds = climb.groupBy("doc_id").agg(F.ceil(F.min("top_hour")).alias("a"), F.floor(F.max("top_hour")).alias("b"))
    asked = bounds.filter("a <= b").select("doc_id", F.explode(F.sequence("a", "b")).alias("at_hour"))
    out = S.interp_at(climb, asked, ["doc_id"], "top_hour", "text_position", "at_hour", block=240.0)
    return out.select("doc_id", "at_hour", F.round(F.col("value") + 1e-9, 6).alias("position"))


@query(
    "context_window",
    """SELECT a.conv_id, a.turn AS target_seq, b.turn AS seq, b.role, b.text FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'user'""",
)
def context_window(spark, sf):
    conv = table(spark, sf, "conversations").withColumnRenamed("turn", "seq")
    return S.context_window(conv, conv.filter("role = 'user'").select("conv_id", "seq"), ["conv_id"], 1)


@query(
    "name_batches",
    """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer),
    rest AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS pos FROM ranked WHERE rk > 4),
    size AS (SELECT c_nationkey, count(*) AS n FROM rest GROUP BY 1),
    bat AS (SELECT r.c_nationkey, r.c_custkey, cast(b AS BIGINT) AS batch FROM rest r JOIN size s USING (c_nationkey), LATERAL (SELECT unnest(range(0, s.n)) AS b) x
      WHERE r.pos >= b * 13 AND r.pos < b * 13 + 16 AND (b = 0 OR (b - 1) * 13 + 16 < s.n))
    SELECT c_nationkey AS graph_id, batch, c_custkey AS member, 'local' AS kind FROM bat
    UNION ALL SELECT b.c_nationkey, b.batch, r.c_custkey, 'anchor' FROM (SELECT DISTINCT c_nationkey, batch FROM bat) b
      JOIN ranked r ON b.c_nationkey = r.c_nationkey AND r.rk <= 4""",
)
def name_batches(spark, sf):
    """Overlapping batches of names per graph, each with the graph's four anchors."""
    people = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("graph_id"), F.col("c_custkey").alias("member"), "c_name", "c_acctbal"
    )
    return S.anchored_batches(people, "graph_id", "member", "c_name", "c_acctbal", anchors=4, size=16, step=13,
                              block=F.floor(F.col("member") / S.BLOCK))
