"""Scores, intervals, paired tests, bootstraps, reports and histograms over result tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..common import prefix_scan, top_k
from ..functions import constants as K
from ..functions.text import hash_mod, norm_text


def accuracy(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Correct, total, parsed and micro accuracy."""
    return answers.groupBy(*keys).agg(
        F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("total"), F.count("selected").alias("parsed"), F.avg("correct").alias("accuracy")
    )


def macro_accuracy(answers: DataFrame, keys: list[str], group: str = "novel") -> DataFrame:
    """Mean over groups of the group accuracy."""
    per = answers.groupBy(*keys, group).agg(F.avg("correct").alias("a"))
    return per.groupBy(*keys).agg(F.avg("a").alias("macro"), F.count(F.lit(1)).alias("groups"))


def wilson(c, n, z: float = K.WILSON_Z) -> tuple[Column, Column]:
    """Wilson interval; nulls without rows."""
    c, n = (F.col(x) if isinstance(x, str) else x for x in (c, n))
    p = c / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    denom = 1 + z * z / n
    has = n > 0
    return F.when(has, (mid - half) / denom), F.when(has, (mid + half) / denom)


def log_factorial(n: Column) -> Column:
    """ln n!: exact up to 20, Stirling's series beyond."""
    exact = F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, exact).otherwise(series)


def exact_p(wins, losses) -> Column:
    """Two-sided exact McNemar p.

    The tail starts 60 * sqrt(n) + 60 below the smaller count: by Hoeffding's bound what lies further out
    is less than exp(-7200) of the whole, far below what a double can hold.
    """
    wins, losses = (F.col(x) if isinstance(x, str) else x for x in (wins, losses))
    n, k = wins + losses, F.least(wins, losses)
    low = F.greatest(F.lit(0), k - F.ceil(60 * F.sqrt(n)) - 60).cast("long")
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * 0.6931471805599453)
    tail = F.aggregate(F.sequence(low, k.cast("long")), F.lit(0.0), lambda a, i: a + term(i))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired(answers: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    """Wins, losses and exact p of every method against a baseline method on shared questions."""
    base = answers.filter(F.col("method") == baseline).select("qid", F.col("correct").alias("base"))
    rows = answers.filter(F.col("method") != baseline).join(base, "qid")
    out = rows.groupBy(*keys, "method").agg(
        F.count_if((F.col("correct") == 1) & (F.col("base") == 0)).alias("wins"), F.count_if((F.col("correct") == 0) & (F.col("base") == 1)).alias("losses"),
        F.avg(F.col("correct") - F.col("base")).alias("delta"),
    )
    return out.withColumn("p", exact_p("wins", "losses"))


def holm(tests: DataFrame, family: list[str], p: str = "p", tie: str = "method") -> DataFrame:
    """Holm-adjusted p inside a family of tests."""
    w = W.partitionBy(*family)
    step = w.orderBy(p, tie)
    rank, total = F.row_number().over(step), F.count(F.lit(1)).over(w)
    raw = tests.withColumn("_raw", F.least(F.lit(1.0), F.col(p) * (total - rank + 1)))
    return raw.withColumn("holm_p", F.max("_raw").over(step)).drop("_raw")


BLOCK = 4096  # rows of a group that one draw takes at a time


def cluster_index(clusters: DataFrame, name: str) -> DataFrame:
    """Dense 0-based index of clusters in the order of their hash, without a global sort."""
    h = clusters.withColumn("_h", F.md5(F.col(name).cast("string"))).withColumn("_b", F.substring("_h", 1, 2))
    return prefix_scan(h, [], ["_b"], ["_h"], {"idx": ("count", None)}).withColumn("idx", F.col("idx") - 1).drop("_h", "_b")


def draw_slots(spark, draws: int, slots: DataFrame) -> DataFrame:
    """(draw, slot, pick): every draw picks one of ``n_clusters`` per slot, by hash. Draws spread over the tasks."""
    each = spark.range(draws).select(F.col("id").alias("draw"), slots.select("n_clusters").scalar().alias("n_clusters"))
    rows = each.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_clusters") - 1)))
    return rows.withColumn("pick", hash_mod(F.concat_ws(":", F.lit("seed"), "draw", "slot"), F.col("n_clusters")))


def interval(values: DataFrame, draws: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Order statistics of the draws at floor(low*n) and min(floor(high*n), n-1)."""
    ranked = values.withColumn("i", F.row_number().over(W.orderBy("value", "draw")) - 1)
    at = lambda q: F.max(F.when(F.col("i") == min(int(q * draws), draws - 1), F.col("value")))
    return ranked.agg(at(low).alias("low"), at(high).alias("high"), F.count(F.lit(1)).alias("draws"))


def cluster_bootstrap(rows: DataFrame, group: str, draws: int) -> DataFrame:
    """Interval of mean(value) when whole groups are resampled. Groups are summed once, draws touch only sums."""
    sums = cluster_index(rows.groupBy(group).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")), group)
    picks = draw_slots(rows.sparkSession, draws, sums.agg(F.count(F.lit(1)).alias("n_clusters")))
    joined = picks.join(sums.select(F.col("idx").alias("pick"), "s", "n"), "pick")
    values = joined.groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("value"))
    return interval(values, draws)


_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_heads(words: list[np.ndarray | None]) -> np.ndarray:
    """Whole number of the first eight hex digits of the MD5 of many one-block messages at once.

    ``words``: the block's sixteen 32-bit words, an array each with a place per message; None where all are zero.
    """
    n = next(len(w) for w in words if w is not None)
    a, b, c, d = (np.full(n, x, np.uint32) for x in _STATE)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        if words[g] is not None:
            f += words[g]
        left = f << np.uint32(_SHIFTS[i])
        f >>= np.uint32(32 - _SHIFTS[i])
        f |= left
        f += b
        a, b, c, d = d, f, b, c
    return (a + np.uint32(_STATE[0])).byteswap().astype(np.int64)


def _row_hashes(draw: np.ndarray, slot: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``md5_heads`` of the texts row:draw:slot:j, all numbers of one number of digits in each place."""
    text, digits = [np.full(len(j), x, np.uint8) for x in b"row:"], lambda x: len(str(int(x[0])))
    for numbers in (draw, slot, j):
        n = digits(numbers)
        numbers = numbers.astype(np.uint32) if n < 10 else numbers  # divided much faster
        text += [(numbers // 10**p % 10 + 48).astype(np.uint8) for p in range(n - 1, -1, -1)] + [np.full(len(j), ord(":"), np.uint8)]
    size = len(text) - 1
    if size > 55:  # more than one block
        return np.array([int(hashlib.md5(f"row:{x}:{y}:{z}".encode()).hexdigest()[:8], 16) for x, y, z in zip(draw, slot, j)], np.int64)
    text[size] = np.full(len(j), 0x80, np.uint8)
    text += [np.zeros(len(j), np.uint8)] * (-len(text) % 4)
    words = [np.ascontiguousarray(np.stack(text[i : i + 4], axis=1)).view("<u4")[:, 0] for i in range(0, len(text), 4)]
    return md5_heads(words + [None] * (14 - len(words)) + [np.full(len(j), 8 * size, np.uint32), None])


HASHED = 1 << 16  # rows hashed at a time


def _sampled(batches):
    """Blocks (draw, slot, from, upto, n, neg, pos) to (draw, total, rows): the sum of the values drawn for the rows from ``from`` up to ``upto``."""
    for batch in batches:
        draw, slot, first, upto, n, neg, pos = (batch.column(c).to_numpy() for c in ("draw", "slot", "from", "upto", "n", "neg", "pos"))
        size = upto - first
        total = np.zeros(len(size), np.int64)
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + HASHED, side="right")))
            row = np.repeat(np.arange(lo, hi), size[lo:hi])
            j = np.arange(len(row)) - np.repeat(ends[lo:hi] - size[lo:hi] - (ends[lo] - size[lo]), size[lo:hi]) + first[row]
            places = [np.searchsorted(10 ** np.arange(1, 19), x, side="right") for x in (draw[row], slot[row], j)]
            kind = (places[0] * 20 + places[1]) * 20 + places[2]
            for k in np.unique(kind):
                at = np.flatnonzero(kind == k)
                r = row[at]
                hit = _row_hashes(draw[r], slot[r], j[at]) % n[r]
                value = np.where(hit < neg[r], -1, np.where(hit < neg[r] + pos[r], 1, 0))
                total += np.bincount(r, weights=value, minlength=len(size)).astype(np.int64)
            lo = hi
        yield pa.RecordBatch.from_arrays([pa.array(draw), pa.array(total), pa.array(size)], names=["draw", "total", "rows"])


def two_stage_bootstrap(rows: DataFrame, group: str, draws: int) -> DataFrame:
    """Resample groups, then rows inside each group. Values are -1, 0 or 1, so three counts describe a group.

    Every row of every draw is picked by the hash of its place. A large group is drawn in blocks, blocks are dealt over
    all tasks, and a task hashes many rows at once.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 0).alias("neg"), F.count_if(F.col("value") > 0).alias("pos")
    )
    sums = cluster_index(counts, group)
    picks = draw_slots(spark, draws, sums.agg(F.count(F.lit(1)).alias("n_clusters")))
    joined = picks.join(sums.select(F.col("idx").alias("pick"), "n", "neg", "pos"), "pick")
    blocks = joined.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))))
    blocks = blocks.select("draw", "slot", "from", F.least(F.col("from") + BLOCK, F.col("n")).alias("upto"), "n", "neg", "pos")
    # a number of parts of its own: few bytes, but much work, so they must not be put together again
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    drawn = blocks.repartition(parts, "draw", "slot", "from").mapInArrow(_sampled, "draw long, total long, rows long")
    values = drawn.groupBy("draw").agg((F.sum("total") / F.sum("rows")).alias("value"))
    return interval(values, draws)


def rescue(answers: DataFrame, control: str) -> DataFrame:
    """What each method does to the control's errors and successes."""
    base = answers.filter(F.col("method") == control).select("qid", F.col("correct").alias("base"))
    rows = answers.filter(F.col("method") != control).join(base, "qid")
    wrong, right = F.col("base") == 0, F.col("base") == 1
    out = rows.groupBy("method").agg(
        F.count_if(wrong).alias("hard"), F.count_if(wrong & (F.col("correct") == 1)).alias("rescued"), F.count_if(right).alias("easy"),
        F.count_if(right & (F.col("correct") == 1)).alias("preserved"), F.count(F.lit(1)).alias("total"),
    )
    return (
        out.withColumn("rescue_rate", F.coalesce(F.try_divide("rescued", "hard"), F.lit(0.0)))
        .withColumn("preservation_rate", F.coalesce(F.try_divide("preserved", "easy"), F.lit(0.0)))
        .withColumn("net_gain", (F.col("rescued") - (F.col("easy") - F.col("preserved"))) / F.col("total"))
    )


def correlation(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson r; null for fewer than three rows or no variance."""
    varies = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_pop(y), F.lit(0.0)) > 0)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= 3) & varies, F.corr(x, y)).alias("r"))


def average_ranks(rows: DataFrame, col: str, out: str, width: float) -> DataFrame:
    """Average rank per distinct value, from a value histogram scanned in blocks of ``width``."""
    hist = rows.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.floor(F.col("_v") / width))
    scan = prefix_scan(hist, [], ["_b"], ["_v"], {"_before": ("sum_before", "_c")})
    ranks = scan.select(F.col("_v").alias(col), (F.col("_before") + (F.col("_c") + 1) / 2).alias(out))
    return rows.join(ranks, col)


def spearman(rows: DataFrame, x: str, y: str, widths: tuple[float, float]) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    ranked = average_ranks(average_ranks(rows, x, "_rx", widths[0]), y, "_ry", widths[1])
    return correlation(ranked, [], "_rx", "_ry")


def histogram(rows: DataFrame, keys: list[str], x: str, bins: int, weight: str | None = None) -> DataFrame:
    """Counts (or weight sums) over ``bins`` equal cells of 0..1, right edge inside; empty cells are kept."""
    cell = F.greatest(F.least(F.floor(F.col(x) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    value = F.sum(weight) if weight else F.count(F.lit(1))
    got = rows.groupBy(*keys, cell.alias("bin")).agg(value.alias("value"))
    spine = rows.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(got, [*keys, "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def moving_average(series: DataFrame, keys: list[str], k: int, col: str = "value") -> DataFrame:
    """Centred mean over k bins, cut off at the ends. Series have as many rows as bins."""
    w = W.partitionBy(*keys).orderBy("bin").rowsBetween(-(k // 2), k // 2)
    return series.withColumn("smooth", F.avg(col).over(w))


def bin_flags(series: DataFrame, keys: list[str], sparse: int = 3, dense: int = 5) -> DataFrame:
    """First sparse bins (below 0.3 of the mean, not empty) and first dense bins (1.5 times the mean, at least 1)."""
    rows = series.withColumn("mean", F.avg("value").over(W.partitionBy(*keys)))
    thin = rows.filter((F.col("value") > 0) & (F.col("value") < 0.3 * F.col("mean")))
    thick = rows.filter(F.col("value") >= F.greatest(1.5 * F.col("mean"), F.lit(1.0)))
    part = lambda df, k, name: top_k(df, keys, [F.col("bin")], k).select(*keys, "bin", F.lit(name).alias("flag"), "value")
    return part(thin, sparse, "sparse").unionByName(part(thick, dense, "dense"))


def histogram2d(rows: DataFrame, keys: list[str], x: str, y: str, bins: int) -> DataFrame:
    """Counts over a bins x bins grid of the unit square, empty cells included."""
    cell = lambda c: F.greatest(F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    got = rows.groupBy(*keys, cell(x).alias("bx"), cell(y).alias("by")).agg(F.count(F.lit(1)).alias("n"))
    side = F.sequence(F.lit(0), F.lit(bins - 1))
    spine = rows.select(*keys).distinct().withColumn("bx", F.explode(side)).withColumn("by", F.explode(side))
    return spine.join(got, [*keys, "bx", "by"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def recall(found: DataFrame, gold: DataFrame, asked: DataFrame, variants: list[str]) -> DataFrame:
    """Recall of several retrieval variants against gold units.

    ``found``: (variant, qid, unit, chars); ``gold``: (qid, unit, kind); ``asked``: (qid).
    Gold is joined here only, after retrieval is fixed.
    """
    names = F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant")
    size = found.groupBy("variant", "qid").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").alias("chars"))
    hits = found.join(gold, ["qid", "unit"]).groupBy("variant", "qid").agg(
        F.lit(1).alias("any"), F.max((F.col("kind") == "answer").cast("int")).alias("answer"), F.count_distinct("unit", "kind").alias("hit")
    )
    want = gold.groupBy("qid").agg(F.count_distinct("unit", "kind").alias("want"))
    rows = asked.select("qid", names).join(size, ["variant", "qid"], "left").join(hits, ["variant", "qid"], "left").join(want, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("questions"), F.avg(zero("any")).alias("any_recall"), F.avg(zero("answer")).alias("answer_recall"),
        F.avg(F.when(F.col("want") > 0, zero("hit") / F.col("want"))).alias("unit_recall"), F.avg(zero("chunks")).alias("mean_chunks"), F.avg(zero("chars")).alias("mean_chars"),
    )


def leaf_coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each leaf of a row, whether its text, or each of its words over three letters, is in the context.

    ``rows``: (keys, context, leaves array of struct(fact_type, text)); everything stays in the row.
    """
    ctx = rows.withColumn("_c", norm_text("context"))

    def judge(leaf: Column) -> Column:
        words = F.filter(F.regexp_extract_all(norm_text(leaf["text"]), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) > 3)
        return F.struct(
            leaf["fact_type"].alias("fact_type"), F.contains(F.col("_c"), norm_text(leaf["text"])).alias("verbatim"),
            ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(F.col("_c"), w))).alias("all_words"),
        )

    return ctx.select(*keys, F.inline(F.transform("leaves", judge)))


def column_profile(df: DataFrame, text: list[str], categories: list[str]) -> DataFrame:
    """Length statistics of text columns and value counts of categorical ones, in two scans."""
    stats = [F.struct(F.lit(c).alias("column"), F.lit("length").alias("value"), F.count(c).alias("n"), F.min(F.length(c)).alias("low"), F.max(F.length(c)).alias("high"), F.avg(F.length(c)).alias("mean")) for c in text]
    lengths = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categories]))
    counts = df.select(pairs).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return lengths.unionByName(counts, allowMissingColumns=True)


def run_diagnostics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per run: answers, unparsed, mean elapsed, grounded, fallbacks, consistent and direct ones, by letter and by stage.

    ``rows``: (keys, selected, elapsed, stage) and the flags grounded, fallback, consistent, direct. One
    row per letter and stage meets after the first aggregate, whatever the size of a run.
    """
    flag = lambda c, n: F.count_if(F.col(c)).alias(n)
    flags = {"grounded": "grounded", "fallback": "fallbacks", "consistent": "consistent", "direct": "direct"}
    cells = rows.groupBy(*keys, F.coalesce("selected", F.lit("unparsed")).alias("letter"), F.col("stage").cast("string").alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("elapsed").alias("e"), F.count("elapsed").alias("timed"), *[flag(c, n) for c, n in flags.items()]
    )
    out = cells.groupBy(*keys).agg(
        F.sum("n").alias("answers"), F.sum(F.when(F.col("letter") == "unparsed", F.col("n")).otherwise(0)).alias("unparsed"),
        F.try_divide(F.sum("e"), F.sum("timed")).alias("mean_elapsed"), *[F.sum(n).alias(n) for n in flags.values()],
    )
    for name, column in (("letters", "letter"), ("stages", "stage")):
        counts = cells.groupBy(*keys, column).agg(F.sum("n").alias("n"))
        out = out.join(counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias(name)), keys)
    return out
