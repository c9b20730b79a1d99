"""Cut texts into chunks, lines, sentences and paragraphs, and order story spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, LongType

from ..common import first_per_key, prefix_scan, top_k
from ..functions import constants as K
from ..functions.text import norm_text, period_duration, period_hour, period_rank, time_day, time_period

SENTENCE = "[^.!?。！？]+[.!?。！？]*"
BLOCK = 4096  # rows of one key that may share a task in ordered scans


def chunk_fixed(docs: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Overlapping chunks in closed form, one narrow projection; the last chunk ends at the text end."""
    step = max(size - overlap, 1)
    n = F.length("text")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    keep = [c for c in docs.columns if c != "text"]
    out = docs.select(*keep, "text", n.alias("_n"), F.explode(starts).alias("chunk_idx"))
    start = F.col("chunk_idx") * step
    return out.select(
        *keep, "chunk_idx", start.alias("start"), F.least(start + size, "_n").alias("end"),
        F.substring("text", start + 1, F.lit(size)).alias("text"),
    )


def chunk_lines(docs: DataFrame, size: int = K.CHUNK_SIZE) -> DataFrame:
    """Pack whole lines greedily; the fold keeps one entry per chunk, not per line."""
    keep = [c for c in docs.columns if c != "text"]
    lines = docs.select(*keep, F.split("text", "\n").alias("lines"))
    empty = F.array().cast("array<struct<line:int,pos:int>>")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("used"), F.lit(0).alias("pos"), empty.alias("cuts"))

    def add(acc: Column, line: Column) -> Column:
        need = F.length(line) + 1
        fresh = (acc["i"] == 0) | (acc["used"] + need > size)
        cut = F.struct(acc["i"].alias("line"), acc["pos"].alias("pos"))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(fresh, need).otherwise(acc["used"] + need).alias("used"),
            (acc["pos"] + need).alias("pos"),
            F.when(fresh, F.array_append(acc["cuts"], cut)).otherwise(acc["cuts"]).alias("cuts"),
        )

    cuts = lines.withColumn("cuts", F.aggregate("lines", zero, add, lambda a: a["cuts"]))
    out = cuts.select("*", F.posexplode("cuts").alias("chunk_idx", "cut"))
    stop = F.coalesce(F.get("cuts", F.col("chunk_idx") + 1)["line"], F.size("lines"))
    text = F.array_join(F.slice("lines", F.col("cut.line") + 1, stop - F.col("cut.line")), "\n")
    return out.select(
        *keep, "chunk_idx", F.col("cut.line").alias("first_line"), (stop - 1).alias("last_line"),
        F.col("cut.pos").alias("start"), (F.col("cut.pos") + F.length(text)).alias("end"), text.alias("text"),
    )


@F.pandas_udf(ArrayType(LongType()))
def running_starts(lengths: pd.Series) -> pd.Series:
    """Sum of all lengths before each one, per row."""
    return lengths.map(lambda n: None if n is None else np.cumsum(n) - n)


def cut_spans(docs: DataFrame, pieces: Column, gap: int = 0, base: Column | None = None) -> DataFrame:
    """One row per piece of a text with its character offsets: idx, text, start, end.

    One narrow pass: a text's pieces lie in one row anyway, and only their lengths go to Python.
    """
    keep = [c for c in docs.columns if c != "text"]
    first = F.lit(0) if base is None else base
    cut = docs.select(*keep, first.alias("_base"), pieces.alias("_pieces"))
    cut = cut.withColumn("_starts", running_starts(F.transform("_pieces", lambda x: F.length(x).cast("bigint") + gap)))
    rows = cut.select(*keep, "_base", F.posexplode(F.arrays_zip("_pieces", "_starts")).alias("idx", "_z"))
    start = F.col("_base") + F.col("_z._starts")
    return rows.select(*keep, "idx", F.col("_z._pieces").alias("text"), start.alias("start"), (start + F.length("_z._pieces")).alias("end"))


def line_spans(docs: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Lines with their character offsets; blank lines move the offset but are dropped."""
    out = cut_spans(docs, F.split("text", "\n"), gap=1)
    return out if keep_blank else out.filter(F.trim("text") != "")


def sentence_spans(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """Sentences with offsets. Matches are contiguous after leading terminators."""
    lead = F.length(F.regexp_extract("text", "^[.!?。！？]*", 0))
    out = cut_spans(docs, F.regexp_extract_all("text", F.lit(SENTENCE), 0), base=lead)
    clean = F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return out.withColumn("text", clean).filter(F.length("text") >= min_chars)


def paragraphs(docs: DataFrame) -> DataFrame:
    """Numbered ``[n]`` paragraphs: from each marker to the next one."""
    out = cut_spans(docs, F.split("text", r"(?m)(?=^\[\d+\])"))
    number = F.regexp_extract("text", r"^\[(\d+)\]", 1)
    return out.withColumn("para_no", F.when(number != "", number.try_cast("int"))).filter("para_no is not null")


def mask_position(paras: DataFrame, answers: DataFrame) -> DataFrame:
    """Offset of the paragraph that gives an answer away, and its share of the text."""
    joined = answers.join(paras, ["doc_id", "para_no"])
    return joined.select(
        *answers.columns, F.col("start").alias("mask_char"), (F.col("start") / F.col("n_chars")).alias("mask_ratio")
    )


def span_dedup(spans: DataFrame, keys: list[str]) -> DataFrame:
    """First span per normalised text in (chunk, span) order."""
    keyed = spans.withColumn("norm", norm_text("text")).filter("norm <> ''")
    return first_per_key(keyed, [*keys, "norm"], ["chunk_idx", "span_idx"]).drop("norm")


def with_story_time(spans: DataFrame) -> DataFrame:
    return spans.withColumn("day", time_day("time_label")).withColumn("period", time_period("time_label"))


def day_fill(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Carry the last known story day forward; leading gaps take the first known day."""
    blocked = spans.withColumn("_b", F.floor(F.col("chunk_idx") / BLOCK))
    out = prefix_scan(
        blocked, keys, ["_b"], ["chunk_idx", "span_idx"],
        {"_prev": ("last", "day"), "_next": ("next", "day")},
    )
    filled = F.coalesce("day", "_prev", "_next", "chunk_idx").cast("double")
    return out.withColumn("day_filled", filled).drop("_b", "_prev", "_next")


def story_positions(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Scale filled days to 0..1 per document: constant -> 0.5, no day at all -> chunk fraction."""
    bounds = spans.groupBy(*keys).agg(
        F.min("day_filled").alias("_lo"), F.max("day_filled").alias("_hi"),
        F.count("day").alias("_known"), (F.max("chunk_idx") + 1).alias("_chunks"),
    )
    pos = (
        F.when(F.col("_known") == 0, F.least(F.col("chunk_idx") / F.col("_chunks"), F.lit(1.0)))
        .when(F.col("_hi") == F.col("_lo"), 0.5)
        .otherwise((F.col("day_filled") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    )
    out = spans.join(bounds, keys).withColumn("time_position", pos)
    return out.drop("_lo", "_hi", "_known", "_chunks")


def story_order(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Number spans in story order: filled day, period, then text order."""
    ranked = (
        spans.withColumn("_day", F.coalesce("day_filled", F.lit(0.0)))
        .withColumn("_rank", period_rank("period"))
        .withColumn("_b", F.floor(F.col("chunk_idx") / BLOCK))
    )
    out = prefix_scan(ranked, keys, ["_day", "_rank", "_b"], ["chunk_idx", "span_idx"], {"seq": ("count", None)})
    return out.withColumn("seq", F.col("seq") - 1).drop("_day", "_rank", "_b")


def story_hours(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Hour on the story clock; spans of one (day, period) spread over its duration in text order."""
    near = F.when(F.col("day_filled") <= 10, F.bround("day_filled").cast("int"))
    spans = spans.withColumn("_day", F.coalesce("day", near))
    bounds = spans.groupBy(*keys, "_day", "period").agg(
        F.min("text_position").alias("_lo"), F.max("text_position").alias("_hi")
    )
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "_day", "period"]]
    joined = spans.alias("s").join(bounds.alias("b"), same).select("s.*", "_lo", "_hi")
    width = F.col("_hi") - F.col("_lo")
    inside = F.when(width > 0, (F.col("text_position") - F.col("_lo")) / width).otherwise(0.5)
    base = F.coalesce("_day", F.lit(1)) * 24 + period_hour("period")
    return joined.withColumn("hour", base + inside * period_duration("period")).drop("_lo", "_hi", "_day")


def running_max(rows: DataFrame, keys: list[str], order: str, col: str, name: str) -> DataFrame:
    """Largest value so far along an integer order."""
    blocked = rows.withColumn("_b", F.floor(F.col(order) / BLOCK))
    return prefix_scan(blocked, keys, ["_b"], [order], {name: ("max", col)}).drop("_b")


def _between(prev: Column, nxt: Column, at: Column) -> Column:
    """Value at ``at`` on the line between two (x, y) points; outside, the nearer point's."""
    slope = (nxt["y"] - prev["y"]) / F.nullif(nxt["x"] - prev["x"], F.lit(0.0))
    inside = prev["y"] + F.coalesce(slope * (at - prev["x"]), F.lit(0.0))
    return F.when(prev.isNull(), nxt["y"]).when(nxt.isNull(), prev["y"]).otherwise(inside)


def interp_grid(samples: DataFrame, keys: list[str], x: str, y: str, bins: int) -> DataFrame:
    """Linear interpolation of y(x) at the centres of ``bins`` equal cells of 0..1.

    Each sample is filed under the first centre at or after it. A centre needs only the
    last sample filed up to it and the first one filed later, so two extremes per cell
    survive the shuffle and the scan over a key sees at most ``bins`` + 1 rows.
    """
    cell = F.greatest(F.least(F.ceil(F.col(x) * bins - 0.5), F.lit(bins)), F.lit(0)).cast("int")
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = samples.groupBy(*keys, cell.alias("cell")).agg(F.min(point).alias("lo"), F.max(point).alias("hi"))
    spine = samples.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("cell")
    )
    w = W.partitionBy(*keys).orderBy("cell")
    near = spine.join(cells, [*keys, "cell"], "left").select(
        *keys, "cell", ((F.col("cell") + 0.5) / bins).alias("grid_x"),
        F.last("hi", True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_p"),
        F.first("lo", True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("_n"),
    )
    value = _between(F.col("_p"), F.col("_n"), F.col("grid_x"))
    return near.filter(F.col("cell") < bins).select(*keys, "cell", "grid_x", value.alias("value"))


def interp_at(
    samples: DataFrame, points: DataFrame, keys: list[str], x: str, y: str, at: str, block: float
) -> DataFrame:
    """Interpolate y(x) at arbitrary points: as-of on both sides by one ordered scan."""
    known = samples.select(
        *keys, F.col(x).cast("double").alias("_x"), F.lit(0).alias("_k"), F.col(y).cast("double").alias("_y"),
        F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("_s"),
    )
    asked = points.select(
        *keys, F.col(at).cast("double").alias("_x"), F.lit(1).alias("_k"), F.lit(None).cast("double").alias("_y"),
        F.lit(None).cast("struct<x:double,y:double>").alias("_s"),
    )
    both = known.unionByName(asked).withColumn("_b", F.floor(F.col("_x") / block))
    near = prefix_scan(both, keys, ["_b"], ["_x", "_k", "_y"], {"_p": ("last", "_s"), "_n": ("next", "_s")})
    value = _between(F.col("_p"), F.col("_n"), F.col("_x"))
    return near.filter("_k = 1").select(*keys, F.col("_x").alias(at), value.alias("value"))


def context_window(rows: DataFrame, targets: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Rows within ``radius`` of a target seq: explode the few offsets, then equi-join."""
    wanted = targets.select(
        *keys, F.col("seq").alias("target_seq"),
        F.explode(F.sequence(F.col("seq") - radius, F.col("seq") + radius)).alias("seq"),
    )
    return wanted.join(rows, [*keys, "seq"])


def batches(rows: DataFrame, keys: list[str], order: list[str], n: int, block: Column) -> DataFrame:
    """Consecutive batches of ``n`` ordered rows per key."""
    numbered = prefix_scan(rows.withColumn("_b", block), keys, ["_b"], order, {"pos": ("count", None)}).drop("_b")
    return numbered.withColumn("pos", F.col("pos") - 1).withColumn("batch", F.floor(F.col("pos") / n))


def overlapping_batches(numbered: DataFrame, size: int, step: int) -> DataFrame:
    """All batches [k*step, k*step+size) that hold a row; ``pos`` is its position in the key."""
    lo = F.greatest(F.ceil((F.col("pos") - size + 1) / step), F.lit(0)).cast("long")
    hi = F.floor(F.col("pos") / step).cast("long")
    return numbered.withColumn("batch", F.explode(F.sequence(lo, hi)))


def anchored_batches(
    people: DataFrame, key: str, member: str, name: str, weight: str, anchors: int, size: int, step: int, block: Column
) -> DataFrame:
    """Overlapping name batches per graph; the few top-weight anchors join every batch.

    ``block`` must order like ``name`` (for example a key prefix), so no graph is sorted in one task.
    """
    best = top_k(people, [key], [F.desc(weight), F.col(member)], anchors).select(key, member)
    rest = people.join(best, [key, member], "left_anti")
    numbered = batches(rest, [key], [name], 1, block).drop("batch")
    total = rest.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    local = overlapping_batches(numbered, size, step).join(total, key)
    local = local.filter((F.col("batch") == 0) | ((F.col("batch") - 1) * step + size < F.col("_n")))
    ids = local.select(key, "batch").distinct()
    return local.select(key, "batch", member, F.lit("local").alias("kind")).unionByName(
        ids.join(best, key).select(key, "batch", member, F.lit("anchor").alias("kind"))
    )
