"""Registered queries: locating quotes, offsets and intervals in source text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..functions.text import hash_mod, norm_text
from ..operators import ground as G, segment as S
from .inputs import Dialect, check, relation
from .registry import query
from .text_queries import LINE_OFF, NORM, doc_text, docs

DUCK = Dialect(False)


def quoted_lines(spark, sf, norm: bool):
    """A quote per line that asks for its own line, the next one or line 0; ten lines share a record."""
    lines = relation(spark, sf, "lines").select("doc_id", "seq", "text", F.floor(F.col("seq") / 10).alias("group"))
    shape = norm_text if norm else F.col
    want = F.when(F.col("seq") % 3 == 0, F.col("seq")).when(F.col("seq") % 3 == 1, F.col("seq") + 1).otherwise(F.lit(0))
    quotes = lines.select(
        "doc_id", F.col("seq").alias("quote"), "group", want.alias("requested"),
        (norm_text(F.substring("text", 5, 30)) if norm else F.trim(F.substring("text", 5, 30))).alias("needle"),
    ).filter("needle <> ''")
    return quotes, lines.select("doc_id", "seq", "group", shape("text").alias("body"))


def relocate_sql(norm: bool):
    shape = NORM if norm else (lambda c: c)
    needle = NORM("substr(text, 5, 30)") if norm else "trim(substr(text, 5, 30))"
    return check("lines", f"""WITH l AS (SELECT doc_id, seq, seq // 10 AS grp, {shape('text')} AS body FROM lines),
    q AS (SELECT doc_id, seq AS quote, seq // 10 AS grp, CASE seq % 3 WHEN 0 THEN seq WHEN 1 THEN seq + 1 ELSE 0 END AS requested,
      {needle} AS needle FROM lines WHERE {needle} <> ''),
    d AS (SELECT q.doc_id, q.quote, q.requested AS seq FROM q JOIN l ON l.doc_id = q.doc_id AND l.seq = q.requested WHERE contains(l.body, q.needle)),
    m AS (SELECT q.doc_id, q.quote, min(l.seq) AS seq, count(*) AS n FROM q JOIN l ON l.doc_id = q.doc_id AND l.grp = q.grp AND contains(l.body, q.needle)
      WHERE (q.doc_id, q.quote) NOT IN (SELECT doc_id, quote FROM d) GROUP BY ALL HAVING count(*) = 1)
    SELECT q.doc_id, q.quote, coalesce(d.seq, m.seq) AS seq, CASE WHEN d.seq IS NOT NULL THEN false WHEN m.seq IS NOT NULL THEN true END AS relocated
    FROM q LEFT JOIN d USING (doc_id, quote) LEFT JOIN m USING (doc_id, quote)""")


@query("relocate_mentions", relocate_sql(norm=True))
def relocate_mentions(spark, sf):
    quotes, lines = quoted_lines(spark, sf, norm=True)
    return G.relocated(quotes, lines, ["doc_id"], ["quote"]).select("doc_id", "quote", "seq", "relocated")


@query("relocate_relations", relocate_sql(norm=False))
def relocate_relations(spark, sf):
    quotes, lines = quoted_lines(spark, sf, norm=False)
    return G.relocated(quotes, lines, ["doc_id"], ["quote"]).select("doc_id", "quote", "seq", "relocated")


@query(
    "evidence_to_line",
    check("lines", f"""WITH e AS (SELECT doc_id, seq AS ev, left({NORM('substr(text, 3, 60)')}, 40) AS head FROM lines),
      b AS (SELECT doc_id, seq, {NORM('text')} AS body FROM lines)
    SELECT e.doc_id, e.ev, min(b.seq) AS seq FROM e LEFT JOIN b ON e.doc_id = b.doc_id AND e.head <> '' AND contains(b.body, e.head) GROUP BY ALL"""),
)
def evidence_to_line(spark, sf):
    lines = relation(spark, sf, "lines").select("doc_id", "seq", "text")
    evidence = lines.select("doc_id", F.col("seq").alias("ev"), F.substring("text", 3, 60).alias("evidence"))
    return G.evidence_to_line(evidence, lines, ["doc_id"], ["ev"])


BENCH_SENT = f"""gold AS (SELECT item_id, idx, {NORM('s')} AS norm FROM (SELECT item_id,
    generate_subscripts(regexp_extract_all(text, '{S.SENTENCE}'), 1) - 1 AS idx, unnest(regexp_extract_all(text, '{S.SENTENCE}')) AS s FROM benchmark) t),
  gold_ok AS (SELECT * FROM gold WHERE length(norm) >= 5)"""


def gold_sentences(spark, sf):
    bench = table(spark, sf, "benchmark").select("item_id", "text")
    return S.sentence_spans(bench).select("item_id", "idx", norm_text("text").alias("norm"))


@query(
    "hit_ratio",
    f"""WITH {BENCH_SENT}, hay AS (SELECT doc_id, {NORM('text')} AS norm FROM documents WHERE length({NORM('text')}) >= 5),
    hit AS (SELECT DISTINCT item_id, idx FROM gold_ok g JOIN hay h ON contains(h.norm, g.norm) OR contains(g.norm, h.norm))
    SELECT g.item_id, count(*) AS n_gold, count(h.idx) AS n_hit, round(count(h.idx) / count(*), 6) AS ratio
    FROM (SELECT item_id, idx FROM gold WHERE length(norm) >= 1) g LEFT JOIN hit h USING (item_id, idx) GROUP BY g.item_id""",
)
def hit_ratio(spark, sf):
    gold = gold_sentences(spark, sf)
    hay = docs(spark, sf).select(F.col("doc_id").alias("unit"), norm_text("text").alias("norm"))
    hits = G.two_way_hits(gold, hay, [], ["item_id", "idx"]).select("item_id", "idx").distinct().withColumn("hit", F.lit(1))
    out = gold.join(hits, ["item_id", "idx"], "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("hit").alias("n_hit"))
    return out.withColumn("ratio", F.round(F.col("n_hit") / F.col("n_gold"), 6))


@query(
    "gold_nodes",
    check("lines", f"""WITH {BENCH_SENT}, hay AS (SELECT doc_id, seq, {NORM('text')} AS norm FROM lines WHERE length({NORM('text')}) >= 5)
    SELECT h.doc_id, h.seq, count(DISTINCT g.item_id) AS n_items, count(*) AS n_sentences
    FROM gold_ok g JOIN hay h ON contains(h.norm, g.norm) OR contains(g.norm, h.norm) GROUP BY h.doc_id, h.seq"""),
)
def gold_nodes(spark, sf):
    """Document lines that hold gold sentences, or lie inside one."""
    hay = relation(spark, sf, "lines").select(F.struct("doc_id", "seq").alias("unit"), norm_text("text").alias("norm"))
    pairs = G.two_way_hits(gold_sentences(spark, sf), hay, [], ["item_id", "idx"])
    return pairs.groupBy(F.col("unit.doc_id").alias("doc_id"), F.col("unit.seq").alias("seq")).agg(
        F.count_distinct("item_id").alias("n_items"), F.count(F.lit(1)).alias("n_sentences")
    )


def offsets(spark, sf):
    return S.line_spans(doc_text(spark, sf), keep_blank=True).withColumnRenamed("idx", "seq")


@query(
    "chunk_paragraph_overlap",
    check("lines chunks", f"""SELECT c.doc_id, c.chunk_idx, l.seq, least(c."end", l."end") - greatest(c.start, l.start) AS shared
    FROM chunks c JOIN ({LINE_OFF}) l ON c.doc_id = l.doc_id AND c.start < l."end" AND c."end" > l.start"""),
)
def chunk_paragraph_overlap(spark, sf):
    chunks = S.chunk_fixed(doc_text(spark, sf)).select("doc_id", "chunk_idx", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    lines = offsets(spark, sf).select("doc_id", "seq", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    out = G.interval_overlaps(chunks, lines, ["doc_id"], 1500)
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    return out.select("doc_id", "chunk_idx", "seq", shared.alias("shared"))


@query(
    "span_to_chunk",
    check("lines chunks", f"""SELECT l.doc_id, l.seq, max(c.chunk_idx) AS chunk_idx FROM ({LINE_OFF}) l
    LEFT JOIN chunks c ON c.doc_id = l.doc_id AND c.start <= l.start AND l.start < c."end" GROUP BY ALL"""),
)
def span_to_chunk(spark, sf):
    points = offsets(spark, sf).select("doc_id", "seq", F.col("start").alias("pos"))
    out = G.span_to_chunk(points, S.chunk_fixed(doc_text(spark, sf)), ["doc_id"], ["seq"])
    return out.select("doc_id", "seq", "chunk_idx")


@query(
    "evidence_to_chunks",
    check("lines chunks", f"""WITH l AS ({LINE_OFF}), hit AS (SELECT l.doc_id, l.seq, l."end" AS stop, arg_max(c.chunk_idx, c.start) AS k, 0 AS z
      FROM l JOIN chunks c ON c.doc_id = l.doc_id AND c.start <= l.start GROUP BY ALL)
    SELECT doc_id, seq, k AS chunk_idx FROM hit
    UNION ALL SELECT a.doc_id, a.seq, a.k + 1 FROM hit a JOIN chunks c ON c.doc_id = a.doc_id AND c.chunk_idx = a.k + 1 WHERE c.start <= a.stop"""),
)
def evidence_to_chunks(spark, sf):
    points = offsets(spark, sf).select("doc_id", "seq", F.col("start").alias("pos"), (F.col("end") - F.col("start")).alias("length"))
    chunks = S.chunk_fixed(doc_text(spark, sf)).select("doc_id", "chunk_idx", "start", "end")
    return G.evidence_chunks(points, chunks, ["doc_id"], ["seq"])


@query(
    "locate_nearest",
    f"""WITH base AS (SELECT doc_id, text, regexp_extract(lower(text), '[a-z]{{2,}}') AS span, {DUCK.h("'near' || doc_id")} % 1000 / 1000.0e0 AS near FROM documents),
    piece AS (SELECT doc_id, span, near, length(text) AS n, generate_subscripts(string_split(lower(text), span), 1) AS i,
      unnest(string_split(lower(text), span)) AS s FROM base WHERE span <> ''),
    occ AS (SELECT doc_id, near, n, i, cast(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * length(span) AS BIGINT) AS pos,
      count(*) OVER (PARTITION BY doc_id) AS pieces FROM piece),
    best AS (SELECT doc_id, min(pos) AS first_at, arg_min(pos, (abs(pos - greatest(0, least(n - 1, cast(trunc(near * n) AS BIGINT)))), pos)) AS near_at
      FROM occ WHERE i < pieces AND i <= 32 GROUP BY doc_id)
    SELECT b.doc_id, b.span, coalesce(first_at, -1) AS first_at, coalesce(near_at, -1) AS near_at FROM base b LEFT JOIN best USING (doc_id)""",
)
def locate_nearest(spark, sf):
    rows = docs(spark, sf).select(
        "doc_id", "text", F.regexp_extract(F.lower("text"), "[a-z]{2,}", 0).alias("span"),
        (hash_mod(F.concat(F.lit("near"), "doc_id"), 1000) / 1000).alias("near"),
    )
    out = G.locate_nearest(rows, "text", "span").withColumnRenamed("at", "first_at")
    return G.locate_nearest(out, "text", "span", near="near").select("doc_id", "span", "first_at", F.col("at").alias("near_at"))


@query(
    "ground_exact",
    check("lines", """SELECT doc_id, seq, contains(text, trim(substr(text, 2, 50))) AND trim(substr(text, 2, 50)) <> '' AND seq % 2 = 0 AS hit FROM lines"""),
)
def ground_exact(spark, sf):
    lines = relation(spark, sf, "lines").select("doc_id", "seq", "text")
    evidence = F.concat(F.lit(" "), F.substring("text", 2, 50), F.when(F.col("seq") % 2 == 1, " zzqq zzqq").otherwise(" "))
    out = G.grounded_evidence(lines.withColumn("evidence", evidence))
    return out.select("doc_id", "seq", F.col("grounded").isNotNull().alias("hit"))


TOKEN_SPAN = "(?is)[a-z0-9一-鿿](?:.*[a-z0-9一-鿿])?"


@query(
    "ground_repair",
    check("lines", f"""SELECT doc_id, seq, CASE WHEN e <> '' AND contains(text, e) THEN e
      WHEN length(regexp_replace(lower(e), '[^a-z0-9一-鿿]', '', 'g')) >= 12 THEN regexp_extract(text, '{TOKEN_SPAN}') END AS grounded,
      NOT (e <> '' AND contains(text, e)) AND length(regexp_replace(lower(e), '[^a-z0-9一-鿿]', '', 'g')) >= 12 AS repaired
    FROM (SELECT doc_id, seq, text, trim(replace(replace(text, ',', ' ;'), '.', ' !')) AS e FROM lines) t"""),
)
def ground_repair(spark, sf):
    """Evidence whose punctuation differs from the source line."""
    lines = relation(spark, sf, "lines").select("doc_id", "seq", "text")
    altered = F.replace(F.replace("text", F.lit(","), F.lit(" ;")), F.lit("."), F.lit(" !"))
    out = G.grounded_evidence(lines.withColumn("evidence", altered))
    return out.select("doc_id", "seq", "grounded", "repaired")
