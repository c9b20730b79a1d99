"""Grounding joins: containment, intervals, as-of and nearest occurrence, all as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType, StructField, StructType, BooleanType

from ..common import first_per_key, prefix_scan, top_k
from ..functions.text import norm_text


GRAMS = (9, 5, 3, 1)  # block sizes for needles of at least 17, 9, 5 and 1 characters
DIRECT = 4096  # pairs of one key that may be compared one by one


def aligned_grams(c: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct non-overlapping blocks of a text for each size, in linear passes."""
    each = [F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s).{{{g}}}"), F.lit(0))) for g in sizes]
    return F.concat(*each)


def lead_grams(c: Column, sizes: tuple[int, ...]) -> Column:
    """The g grams at offsets 0..g-1: one of them is a block of any text holding ``c``."""
    def cuts(g: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(g)), lambda i: c.substr(i, F.lit(g))))

    out = None
    for g in sorted(sizes):
        grams = cuts(g)
        out = grams if out is None else F.when(F.length(c) >= 2 * g - 1, grams).otherwise(out)
    return out


def contained_pairs(
    needles: DataFrame, hay: DataFrame, keys: list[str], needle: str, body: str, sizes: tuple[int, ...] = GRAMS
) -> DataFrame:
    """All (needle, hay) row pairs of one key whose needle text lies inside the hay text. Exact.

    Keys with few pairs are compared directly. For the others, and without keys, blocks decide:
    a needle of at least 2g-1 characters covers one whole block of the g-character grid of any
    text that holds it, so an equi-join on blocks finds every occurrence and ``contains``
    verifies it. Only ids travel with the blocks; texts join the surviving pairs. Hay rows are
    distinct in their non-text columns. Unless 1 is among ``sizes``, needles are at least
    2g-1 characters long for the smallest g.
    """
    hit = F.contains(F.col(body), F.col(needle))
    if not keys:
        return _block_pairs(needles, hay, keys, needle, body, sizes).filter(hit)
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    load = count(needles, "_n").join(count(hay, "_h"), keys)
    load = load.select(*keys, (F.col("_n") * F.col("_h") <= DIRECT).alias("_few"))
    tagged = needles.join(load, keys)
    few = tagged.filter("_few").drop("_few").join(hay, keys).filter(hit)
    many = hay.join(load.filter("not _few"), keys, "left_semi")
    rest = _block_pairs(tagged.filter("not _few").drop("_few"), many, keys, needle, body, sizes).filter(hit)
    return few.unionByName(rest)


def _block_pairs(needles: DataFrame, hay: DataFrame, keys: list[str], needle: str, body: str, sizes: tuple[int, ...]) -> DataFrame:
    """Pairs that share a block, with both texts attached."""
    ids = [c for c in hay.columns if c not in (*keys, body)] or [body]
    left = needles.withColumn("_g", F.explode(lead_grams(F.col(needle), sizes)))
    right = hay.select(*keys, *ids, F.explode(aligned_grams(F.col(body), sizes)).alias("_g"))
    pairs = left.join(right, [*keys, "_g"]).drop("_g").distinct()
    return pairs if ids == [body] else pairs.join(hay, [*keys, *ids])


def held_texts(needles: DataFrame, hay: DataFrame, keys: list[str], needle: str, body: str, smallest: tuple[str, int] | None = None) -> DataFrame:
    """(keys, needle, other columns of ``hay``) for each distinct needle text inside a hay text of its key. Exact.

    Needles neither start nor end with a space. Cut at spaces, a needle of m words lies in a text where m of its words
    in a row equal it, the first by its end and the last by its start. So each run of words, cut short at both ends, is
    looked up whole, and rows grow with the texts' words, not with pairs that share a common word. Needles of one
    word meet the distinct words. With ``smallest`` (column, k), the k smallest distinct values of that column are kept
    per needle, before they meet anything else.
    """
    def least(rows: DataFrame, text: str) -> DataFrame:
        if smallest is None:
            return rows.distinct()
        place = F.dense_rank().over(W.partitionBy(*keys, text).orderBy(smallest[0]))
        return rows.withColumn("_place", place).filter(F.col("_place") <= smallest[1]).drop("_place")

    units = [c for c in hay.columns if c not in (*keys, body)]
    wanted = needles.select(*keys, needle).distinct().withColumn("_w", F.split(needle, " ")).withColumn("_m", F.size("_w"))
    several = wanted.filter("_m > 1")
    words = hay.select(*keys, *units, F.split(body, " ").alias("_w"))
    fits = lambda m: F.when(F.size("_w") >= m, F.sequence(F.lit(1), F.size("_w") - m + 1)).otherwise(F.array().cast("array<int>"))
    inner = lambda m, i: F.concat(F.lit(" "), F.when(m > 2, F.concat(F.array_join(F.slice("_w", i + 1, m - 2), " "), F.lit(" "))).otherwise(F.lit("")))
    run = lambda m, i: F.struct(m.alias("_m"), F.element_at("_w", i).alias("_first"), inner(m, i).alias("_inner"), F.element_at("_w", i + m - 1).alias("_last"))
    runs = F.flatten(F.transform("_ms", lambda m: F.transform(fits(m), lambda i: run(m, i))))
    rows = words.join(several.groupBy(*keys).agg(F.collect_set("_m").alias("_ms")), keys).select(*keys, *units, F.inline(F.array_distinct(runs)))
    places = lambda c: F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))
    ends = F.transform(places("_first"), lambda i: F.substring("_first", i, F.length("_first")))
    starts = F.transform(places("_last"), lambda i: F.left("_last", i))
    heads = several.select(*keys, "_m", F.get("_w", F.lit(0)).alias("_end")).distinct()
    rows = rows.withColumn("_end", F.explode(ends)).join(heads, [*keys, "_m", "_end"], "left_semi")
    rows = rows.select(*keys, *units, F.explode(F.transform(starts, lambda x: F.concat("_end", "_inner", x))).alias(needle))
    long = rows.join(several.select(*keys, needle), [*keys, needle], "left_semi").select(*keys, needle, *units)
    lone = wanted.filter("_m = 1").select(*keys, needle)
    asked = words.join(lone.select(*keys).distinct(), keys, "left_semi")
    single = least(asked.select(*keys, *units, F.explode(F.array_distinct("_w")).alias("_word")), "_word")
    pairs = contained_pairs(lone, single.select(*keys, "_word").distinct(), keys, needle, "_word").select(*keys, needle, "_word")
    short = pairs.join(single, [*keys, "_word"]).select(*keys, needle, *units)
    return least(long, needle).unionByName(least(short, needle))


def relocated(
    quotes: DataFrame, lines: DataFrame, keys: list[str], quote_id: list[str], needle: str = "needle", body: str = "body"
) -> DataFrame:
    """Line of each quote: the requested one if it holds the quote, else the only allowed line that does.

    ``quotes`` carry ``requested`` and ``group``; ``lines`` carry ``seq`` and ``group`` (the allowed set).
    """
    asked = quotes.join(lines.select(*keys, F.col("seq").alias("requested"), body), [*keys, "requested"])
    direct = asked.filter(F.contains(body, needle)).select(*keys, *quote_id, F.col("requested").alias("seq"))
    todo = quotes.join(direct, [*keys, *quote_id], "left_anti")
    hits = contained_pairs(todo, lines, [*keys, "group"], needle, body).select(*keys, *quote_id, "seq").distinct()
    lone = hits.groupBy(*keys, *quote_id).agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("seq")).filter("_n = 1")
    moved = lone.select(*keys, *quote_id, "seq", F.lit(True).alias("relocated"))
    found = direct.withColumn("relocated", F.lit(False)).unionByName(moved)
    return quotes.join(found, [*keys, *quote_id], "left")


def evidence_to_line(evidence: DataFrame, lines: DataFrame, keys: list[str], ids: list[str], head: int = 40) -> DataFrame:
    """First line that holds the first ``head`` characters of the normalised evidence."""
    needles = evidence.select(*keys, *ids, F.left(norm_text("evidence"), F.lit(head)).alias("needle")).filter("needle <> ''")
    bodies = lines.select(*keys, "seq", norm_text("text").alias("body"))
    pairs = contained_pairs(needles, bodies, keys, "needle", "body")
    first = pairs.groupBy(*keys, *ids).agg(F.min("seq").alias("seq"))
    return evidence.select(*keys, *ids).join(first, [*keys, *ids], "left")


def two_way_hits(gold: DataFrame, corpus: DataFrame, keys: list[str], gold_id: list[str], min_chars: int = 5) -> DataFrame:
    """Pairs where the gold text lies in the corpus text or the other way round.

    Both sides carry ``norm``; corpus rows carry ``unit``.
    """
    g = gold.filter(F.length("norm") >= min_chars).select(*keys, *gold_id, F.col("norm").alias("gold_norm"))
    c = corpus.filter(F.length("norm") >= min_chars).select(*keys, "unit", F.col("norm").alias("unit_norm"))
    inside = contained_pairs(g, c, keys, "gold_norm", "unit_norm", (9, 5, 3)).select(*keys, *gold_id, "unit")
    short = c.filter(F.length("unit_norm") <= g.agg(F.max(F.length("gold_norm"))).scalar())
    around = contained_pairs(short, g, keys, "unit_norm", "gold_norm", (9, 5, 3)).select(*keys, *gold_id, "unit")
    return inside.unionByName(around).distinct()


def interval_overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of half-open intervals that overlap, met once in the bin where the overlap starts."""
    bins = lambda d, s, e: d.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width)))
    )
    lb, rb = bins(left, "l_start", "l_end"), bins(right, "r_start", "r_end")
    joined = lb.join(rb, [*keys, "_bin"]).filter("l_start < r_end and l_end > r_start")
    return joined.filter(F.col("_bin") == F.floor(F.greatest("l_start", "r_start") / width)).drop("_bin")


def span_to_chunk(points: DataFrame, chunks: DataFrame, keys: list[str], ids: list[str], width: int = 1500) -> DataFrame:
    """Last chunk whose interval contains an offset."""
    bins = chunks.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    ).select(*keys, "chunk_idx", "start", "end", "_bin")
    hits = points.withColumn("_bin", F.floor(F.col("pos") / width)).join(bins, [*keys, "_bin"]).filter("start <= pos and pos < end")
    last = hits.groupBy(*keys, *ids).agg(F.max("chunk_idx").alias("chunk_idx"))
    return points.join(last, [*keys, *ids], "left")


def asof_start(points: DataFrame, starts: DataFrame, keys: list[str], ids: list[str], block: int = 1 << 16) -> DataFrame:
    """Greatest start at or before each position: one ordered scan over both inputs."""
    known = starts.select(*keys, F.col("start").alias("_x"), F.lit(0).alias("_k"), F.struct("start", "chunk_idx").alias("_s"))
    asked = points.select(*keys, F.col("pos").alias("_x"), F.lit(1).alias("_k"), *ids)
    both = known.unionByName(asked, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_x") / block))
    near = prefix_scan(both, keys, ["_b"], ["_x", "_k"], {"_hit": ("last", "_s")})
    return near.filter("_k = 1").select(
        *keys, *ids, F.col("_x").alias("pos"), F.col("_hit.chunk_idx").alias("chunk_idx"), F.col("_hit.start").alias("start")
    )


def evidence_chunks(points: DataFrame, chunks: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Chunk holding each evidence start, plus the next chunk if it starts before the evidence ends."""
    at = asof_start(points.select(*keys, *ids, "pos"), chunks, keys, ids).drop("start")
    full = at.join(points.select(*keys, *ids, "length"), [*keys, *ids])
    both = full.withColumn("next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("chunk_idx", F.col("chunk_idx") + F.col("next"))
    out = both.join(chunks.select(*keys, "chunk_idx", "start"), [*keys, "chunk_idx"])
    return out.filter("next = 0 or start <= pos + length").select(*keys, *ids, "chunk_idx")


def occurrences(text: Column, span: Column, limit: int = 32) -> Column:
    """Offsets in the original text of up to ``limit`` non-overlapping matches of a span.

    Case and the amount of whitespace between words may differ. The text is cut at the
    matches, so offsets come from the lengths of pieces and matches.
    """
    return F.when(norm_text(span) != "", _occurrences(text, norm_text(span), limit))


def _occurrences(text: Column, span: Column, limit: int) -> Column:
    """The same for a normalised span that is not empty."""
    gap = r"\\E[\\s\\x1c-\\x1f]+\\Q"
    pattern = F.concat(F.lit(r"(?iuU)\Q"), F.regexp_replace(span, " ", gap), F.lit(r"\E"))
    cut = F.struct(F.split(text, pattern, limit + 1).alias("pieces"), F.slice(F.regexp_extract_all(text, pattern, F.lit(0)), 1, limit).alias("hits"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def places(c: Column) -> Column:
        pairs = F.zip_with(F.slice(c["pieces"], 1, F.size(c["hits"])), c["hits"], lambda p, h: F.struct(F.length(p).alias("p"), F.length(h).alias("h")))
        return F.aggregate(
            pairs, zero,
            lambda acc, x: F.struct((acc["at"] + x["p"] + x["h"]).alias("at"), F.array_append(acc["out"], acc["at"] + x["p"]).alias("out")),
            lambda acc: acc["out"],
        )

    # through an array of one, so that the text is searched once for all uses of what was found
    return F.get(F.transform(F.array(cut), places), F.lit(0))


def locate_nearest(rows: DataFrame, text: str, span: str, near: str | None = None, limit: int = 32) -> DataFrame:
    """Original offset of a span; with an expected position ratio, the occurrence closest to it."""
    out = rows.withColumn("_o", occurrences(F.col(text), F.col(span), limit))
    pick = F.get("_o", F.lit(0))
    if near:
        n = F.length(text)
        expected = F.greatest(F.lit(0), F.least(n - 1, (F.col(near) * n).cast("int")))
        closest = F.array_min(F.transform("_o", lambda p: F.struct(F.abs(p - expected).alias("d"), p.alias("p"))))["p"]
        pick = F.when(F.col(near).isNull(), pick).otherwise(closest)
    return out.withColumn("at", F.coalesce(pick, F.lit(-1))).drop("_o")


def locate_quotes(quotes: DataFrame, chunks: DataFrame, keys: list[str], ids: list[str], limit: int = 32) -> DataFrame:
    """Offset of each quote in the text that the chunks cut up: (keys, ids, pos, length); quotes not found are left out.

    ``quotes``: (keys, ids, quote, near); ``chunks``: (keys, chunk_idx, start, end, text). Quotes meet chunks by the block
    grams of their normalised text, so no quote carries the whole text; a quote that several ids share is looked for once. Of the first ``limit`` occurrences the one closest
    to ``near`` (a share of the text; null: the first) counts. A quote no longer than the overlap of chunks lies whole in one
    of them wherever it stands.
    """
    asked = quotes.select(*keys, *ids, "near", F.length("quote").alias("length"), norm_text("quote").alias("nq")).filter("nq <> ''")
    parts = chunks.select(*keys, "chunk_idx", norm_text("text").alias("nt"))
    met = contained_pairs(asked.select(*keys, "nq").distinct(), parts, keys, "nq", "nt").select(*keys, "nq", "chunk_idx")
    rows = met.join(chunks.select(*keys, "chunk_idx", "start", "text"), [*keys, "chunk_idx"])
    here = F.explode(_occurrences(F.col("text"), F.col("nq"), limit)).alias("at")
    places = rows.select(*keys, "nq", "start", here).select(*keys, "nq", (F.col("start") + F.col("at")).alias("pos"))
    size = chunks.groupBy(*keys).agg(F.max("end").alias("_n"))
    first = top_k(places.distinct(), [*keys, "nq"], [F.col("pos")], limit).groupBy(*keys, "nq").agg(F.collect_list("pos").alias("_at"))
    found = asked.join(first, [*keys, "nq"]).join(size, keys)
    expected = F.greatest(F.lit(0), F.least(F.col("_n") - 1, (F.col("near") * F.col("_n")).cast("int")))
    apart = lambda p: F.when(F.col("near").isNull(), F.lit(0)).otherwise(F.abs(p - expected))
    best = F.array_min(F.transform("_at", lambda p: F.struct(apart(p).alias("d"), p.alias("pos"), F.col("length").alias("length"))))
    return found.groupBy(*keys, *ids).agg(F.min(best).alias("b")).select(*keys, *ids, "b.pos", "b.length")


# -- evidence repair on misses ------------------------------------------------------
REPAIR = StructType([StructField("grounded", StringType()), StructField("repaired", BooleanType())])


def _repair(text: str, evidence: str) -> tuple[str | None, bool]:
    """Source text matching the evidence words in order, ignoring punctuation and ``...`` gaps."""
    import re

    words = lambda s: [(m.group().lower(), m.start(), m.end()) for m in re.finditer("[a-zA-Z0-9]+|[一-鿿]+", s)]
    pieces = [words(p) for p in re.split(r"\.\.\.|…", evidence) if p.strip()]
    sizes = [sum(len(w) for w, _, _ in p) for p in pieces]
    floor = 16 if re.search(r"\.\.\.|…", evidence) else 12
    if not pieces or sum(sizes) < floor or (len(pieces) > 1 and min(sizes) < 8):
        return None, False
    source, at, span = words(text), 0, []
    plain = [w for w, _, _ in source]
    for piece in pieces:
        want, cursor = [w for w, _, _ in piece], span[-1][1] if span else 0
        while at + len(want) <= len(plain) and (source[at][1] < cursor or plain[at : at + len(want)] != want):
            at += 1
        if not want or at + len(want) > len(plain):
            return None, False
        span.append((source[at][1], source[at + len(want) - 1][2]))
        at += len(want)
    return text[span[0][0] : span[-1][1]], True


@F.pandas_udf(REPAIR)
def repair_evidence(text, evidence):
    import pandas as pd

    return pd.DataFrame([_repair(t or "", (e or "").strip()) for t, e in zip(text, evidence)], columns=["grounded", "repaired"])


def grounded_evidence(rows: DataFrame, text: str = "text", evidence: str = "evidence") -> DataFrame:
    """Evidence as it stands in the source: exact substring in built-ins, the repair only on misses."""
    e = F.trim(evidence)
    tagged = rows.withColumn("_hit", (e != "") & F.contains(text, e))
    exact = tagged.filter("_hit").withColumn("grounded", e).withColumn("repaired", F.lit(False))
    missed = tagged.filter("not coalesce(_hit, false)").withColumn("_r", repair_evidence(F.col(text), F.col(evidence)))
    fixed = missed.withColumn("grounded", F.col("_r.grounded")).withColumn("repaired", F.coalesce("_r.repaired", F.lit(False)))
    return exact.drop("_hit").unionByName(fixed.drop("_hit", "_r"))
