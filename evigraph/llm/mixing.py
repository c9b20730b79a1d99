"""Mixing sources to target weights by fitting subset sums on length counts.

Each source gets a share of the budget by weight, at most ``limit`` times its own size; what exceeds
that is shared again (water filling). A source takes each of its texts floor(target / size) times as a
whole; for the rest of its target a subset of the texts is chosen once more: texts are counted by exact
length, proportional counts are taken with the rounding carried on, and the words still missing are
fitted by a bounded-knapsack table over the lengths left. Which texts of a length are taken follows
from a seeded hash of the id.

Only counts by (source, length, hash slot) meet: a source or a length with a third of all rows is split
over ``SLOTS`` slots, and the table of the knapsack has at most ``DP_WORDS`` cells at any size.

Defined results: null texts and texts without words have size 0 and take 0 words; a null source is a
source of its own, last in order; repeated ids are texts of their own (equal rows are interchangeable);
an empty table gives an empty result. Columns beyond the named ones are kept by ``copies`` and ignored
by ``mix_plan``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from evigraph.common import cut_lineage

from .common import WORD

SLOTS = 1024
DP_WORDS = 1 << 16
BACK = 4


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, limit: float) -> DataFrame:
    """Rows (source, source_size, target) from (source, size): one small row per source.

    Sources in code-point order, null last, take the weights in turn. ``budget`` is relative to all sizes.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("w", w).withColumn("cap", limit * F.col("source_size"))
    # Sources fill up in order of cap / weight; the level that the others share is what is left over their weights.
    order = W.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").cast("binary"))
    everything = W.partitionBy()
    rows = rows.select(
        "*",
        (budget * F.sum("source_size").over(everything)).alias("total"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("open_w"),
    )
    level = (F.col("total") - F.col("before")) / F.col("open_w")
    rows = rows.withColumn("full", level * F.col("w") >= F.col("cap"))
    rows = rows.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), level.alias("v")))).over(everything)["v"])
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many texts of each length to take so that their words come as near ``budget`` as can be.

    The table gives the best sum not above what is missing; one more text is taken if that ends nearer.
    """
    order = np.argsort(-lengths, kind="stable")
    length, count = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    use = length > 0
    total = int((length * count)[use].sum())
    taken = np.zeros(len(length), np.int64)
    if budget >= total:
        taken[use] = count[use]
    elif budget > 0:
        missing = budget
        goal = 0.0
        for i in np.flatnonzero(use):
            goal += budget / total * float(length[i] * count[i])
            taken[i] = max(0, min(count[i], int(goal - (budget - missing)) // length[i], missing // length[i]))
            missing -= int(taken[i] * length[i])
        for i in np.flatnonzero(use):
            if missing <= dp_words:
                break
            more = min(count[i] - taken[i], missing // length[i])
            taken[i] += more
            missing -= int(more * length[i])
        # Some short texts go back, so that the table has lengths to choose from.
        for i in np.flatnonzero(use)[::-1]:
            back = int(max(0, min(taken[i], BACK, (dp_words - missing) // length[i])))
            taken[i] -= back
            missing += int(back * length[i])
        cells = min(missing, dp_words)
        reached = np.zeros(cells + 1, bool)
        reached[0] = True
        by = np.full(cells + 1, -1, np.int64)
        items: list[tuple[int, int]] = []
        for i in np.flatnonzero(use)[::-1]:
            left, k = int(min(count[i] - taken[i], cells // length[i])), 1
            while left > 0 and not reached[cells]:
                part = min(k, left)
                weight = int(part * length[i])
                new = np.flatnonzero(reached[: cells + 1 - weight] & ~reached[weight:]) + weight
                by[new] = len(items)
                reached[new] = True
                items.append((int(i), part))
                left -= part
                k *= 2
        at = int(np.flatnonzero(reached)[-1])
        missing -= at
        while at:
            i, part = items[by[at]]
            taken[i] += part
            at -= int(part * length[i])
        spare = np.flatnonzero(use & (taken < count))
        if missing and len(spare):
            i = spare[np.argmin(np.abs(length[spare] - missing))]
            if abs(int(length[i]) - missing) < missing:
                taken[i] += 1
    out = np.zeros(len(length), np.int64)
    out[order] = taken
    return out


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, limit: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Columns id, size, source_size, target, copies (how often the text is in the mix) and taken (words)."""
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))  # with the text: rows without id differ too
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.shiftrightunsigned(key, 8).alias("key"), F.pmod(key, F.lit(SLOTS)).cast("int").alias("slot"),
    )
    rows = cut_lineage(rows)
    aims = targets(rows, weights, budget, limit)
    slots = rows.groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("n"))
    lengths = slots.groupBy("source", "size").agg(F.sum("n").alias("n"))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(1)).cast("int")
    wanted = lengths.alias("l").join(aims.alias("a"), F.col("l.source").eqNullSafe(F.col("a.source"))).select(
        "l.source", "l.size", "l.n", (F.col("target") - whole * F.col("source_size")).alias("rest")
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pdf["rest"].iloc[0]
        pdf["extra"] = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), 0 if np.isnan(rest) else round(rest))
        return pdf[["source", "size", "extra"]]

    extra = wanted.groupBy("source").applyInPandas(fit, "source string, size long, extra long")
    # Slots are used up in turn; within the slot where the count ends, the smallest keys are taken.
    same = lambda a, b, *more: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = slots.withColumn("before", before).alias("s").join(extra.alias("e"), same("s", "e")).select("s.source", "s.size", "s.slot", (F.col("extra") - F.col("before")).alias("quota"))
    place = F.row_number().over(W.partitionBy("source", "size", "slot").orderBy("key", "id"))
    placed = rows.withColumn("place", place).alias("r").join(ends.alias("q"), same("r", "q") & (F.col("r.slot") == F.col("q.slot"))).select("r.id", "r.text_hash", "r.source", "r.size", (F.col("place") <= F.col("quota")).cast("int").alias("more"))
    joined = placed.alias("p").join(aims.alias("a"), F.col("p.source").eqNullSafe(F.col("a.source")))
    copies = whole + F.col("more")
    return joined.select(F.col("id").alias(id_col), "text_hash", "p.source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows are told apart by id, text and source. Rows alike in these are taken equally often, their mean count
    rounded.
    """
    id_col, text_col, source_col = (options.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    plan = mix_plan(docs, **options)
    plan = plan.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_text"), F.col("source").alias("_source")).agg(F.round(F.avg("copies")).cast("int").alias("_n")).filter("_n > 0")
    text = F.xxhash64(docs[text_col])
    rows = docs.join(plan, docs[id_col].eqNullSafe(F.col("_id")) & (text == F.col("_text")) & docs[source_col].cast("string").eqNullSafe(F.col("_source")))
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*[docs[c] for c in docs.columns])
