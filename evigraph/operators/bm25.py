"""BM25 over text units, keyed by scope (a document, a source or a graph).

Units: (scope, unit, text). Queries: (scope, qid, label, query). Every function scores all
queries of all scopes in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..common import cut_lineage, top_k
from ..functions import constants as K
from ..functions.text import tokenize

QUERY = ["scope", "qid", "label"]


@dataclass
class Index:
    """Postings (scope, term, unit, tf, dl), term table (scope, term, df, cf, idf), stats (scope, n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, prefix: str, buckets: int) -> None:
        """Tables bucketed by scope and term, so scoring joins need no shuffle of the postings."""
        for name in ("postings", "terms"):
            frame = getattr(self, name)
            frame.write.mode("overwrite").bucketBy(buckets, "scope", "term").sortBy("scope", "term").saveAsTable(f"{prefix}_{name}")
        self.stats.write.mode("overwrite").saveAsTable(f"{prefix}_stats")

    @classmethod
    def load(cls, spark, prefix: str) -> "Index":
        return cls(*[spark.table(f"{prefix}_{name}") for name in ("postings", "terms", "stats")])


#: Term of the row that each unit adds to the term counts, so that length statistics need no second pass over the texts.
UNIT_ROW = ""


def build_index(units: DataFrame, vocabulary: DataFrame | None = None) -> Index:
    """Index of all units, one row each; with a (scope, term) ``vocabulary``, postings hold only those terms.

    Terms and statistics are counted where the texts lie, and only a scope's terms with their counts are shuffled: postings
    move for those who read them, once. The vocabulary filter runs before that. Units may carry their scope's
    vocabulary in an array ``only``, if it is small; other terms then leave the row they stand in, with no join.
    """
    own = "only" in units.columns
    toks = units.select("scope", "unit", tokenize("text").alias("toks"), *["only"] * own).withColumn("dl", F.size("toks"))
    keep = F.lit(True)
    if own:  # hashes are compared much faster; those found are looked up as they are
        toks = toks.withColumn("hashes", F.transform("only", lambda t: F.xxhash64(t)))
        keep = F.array_contains("hashes", F.xxhash64("term")) & F.array_contains("only", F.col("term"))
    rows = toks.select("*", F.explode("toks").alias("term")).filter(keep).select("scope", "unit", "dl", "term")
    # in order, a term's first place is the one after another term; the unit's row comes before all and counts its length
    order = F.sort_array(F.concat(F.array(F.lit(UNIT_ROW)), "toks"))
    zipped = F.arrays_zip(order.alias("term"), F.concat(F.array(F.lit(None).cast("string")), order).alias("before"))
    seen = toks.select("*", F.inline(zipped).alias("term", "before")).filter("term IS NOT NULL").filter((F.col("term") == UNIT_ROW) | keep)
    seen = seen.select("scope", "term", (~F.col("term").eqNullSafe(F.col("before"))).cast("int").alias("df"), F.when(F.col("term") == UNIT_ROW, F.col("dl")).otherwise(1).alias("cf"))
    counts = seen.groupBy("scope", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    if vocabulary is not None and not own:
        rows = rows.join(vocabulary.select("scope", "term"), ["scope", "term"], "left_semi")
    postings = rows.groupBy("scope", "term", "unit", "dl").agg(F.count(F.lit(1)).alias("tf"))
    stats = counts.filter(F.col("term") == UNIT_ROW).select("scope", F.col("df").alias("n"), (F.col("cf") / F.col("df")).alias("avgdl"))
    wanted = counts.filter(F.col("term") != UNIT_ROW)
    if vocabulary is not None and not own:
        wanted = wanted.join(vocabulary.select("scope", "term"), ["scope", "term"], "left_semi")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    terms = wanted.join(stats.select("scope", "n"), "scope").select("scope", "term", "df", "cf", idf.alias("idf"))
    return Index(postings, terms, stats)


def weighted(index: Index) -> DataFrame:
    """Postings with what a query term adds to a unit's score: (scope, term, unit, weight)."""
    rows = index.postings.join(index.terms.select("scope", "term", "idf"), ["scope", "term"]).join(index.stats.select("scope", "avgdl"), "scope")
    return rows.select("scope", "term", "unit", saturated().alias("weight"))


def _counted(schema: pa.Schema):
    """Batches of (scope, unit, toks) to distinct terms and their counts, a batch's terms numbered and sorted at once."""

    def run(batches):
        for batch in batches:
            toks = batch.column("toks")
            size = pc.list_value_length(toks).to_numpy()
            coded = toks.flatten().dictionary_encode()
            n = max(len(coded.dictionary), 1)
            keys, tf = np.unique(np.repeat(np.arange(len(size)), size) * n + coded.indices.to_numpy(), return_counts=True)
            cuts = pa.array(np.append(0, np.cumsum(np.bincount(keys // n, minlength=len(size)))), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, x) for x in (coded.dictionary.take(pa.array(keys % n)), pa.array(tf, pa.int32()))]
            columns = [batch.column("scope"), batch.column("unit"), pa.array(size, pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


FEW_TERMS = 200_000  # of a vocabulary that is sent to every task


def text_weights(units: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``weighted(build_index(units, vocabulary))`` for texts that are dear to make: each is made and cut into terms once.

    The units' distinct terms and counts are written; terms of a scope and postings are read from there. The postings
    meet the vocabulary where they lie, if its number of terms is small, or else in the shuffle in which they meet the terms.
    """
    kinds = dict(units.dtypes)
    out = f"scope {kinds['scope']}, unit {kinds['unit']}, dl int, terms array<string>, tfs array<int>"
    schema = units.sparkSession.createDataFrame([], out).toArrow().schema
    bags = cut_lineage(units.select("scope", "unit", tokenize("text").alias("toks")).mapInArrow(_counted(schema), out))
    rows = bags.select("scope", "unit", "dl", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
    whole, asked = ("tinyint", "smallint", "int", "bigint"), dict(vocabulary.dtypes)["scope"]
    # whole numbers of two types would be shuffled by a cast of one, and once more by what follows
    scope = F.col("scope").try_cast(kinds["scope"]).alias("scope") if kinds["scope"] in whole and asked in whole else "scope"
    wanted = cut_lineage(vocabulary.select(scope, "term"))
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_TERMS else wanted
    stats = bags.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    counts = rows.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df")).join(wanted, ["scope", "term"], "left_semi")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    terms = counts.join(stats, "scope").select("scope", "term", idf.alias("idf"), "avgdl")
    postings = rows.join(wanted, ["scope", "term"], "left_semi").groupBy("scope", "term", "unit", "dl").agg(F.sum("tf").alias("tf"))
    return postings.join(terms, ["scope", "term"]).select("scope", "term", "unit", saturated().alias("weight"))


def text_vocabulary(queries: DataFrame) -> DataFrame:
    return queries.select("scope", F.explode(F.array_distinct(tokenize("query"))).alias("term")).distinct()


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms per query with their repeat count."""
    rows = queries.select(*QUERY, F.explode(tokenize("query")).alias("term"))
    return rows.groupBy(*QUERY, "term").agg(F.count(F.lit(1)).alias("qtf"))


def saturated(k1: float = K.BM25_K1, b: float = K.BM25_B) -> Column:
    tf = F.col("tf")
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def flat() -> Column:
    """No length normalisation; repeated query terms count each time."""
    return F.col("qtf") * F.col("idf") * F.col("tf") * 2.5 / (F.col("tf") + 1.5)


def score(index: Index, queries: DataFrame, formula: Column | None = None) -> DataFrame:
    """(scope, qid, label, unit, score) for every unit that shares a term with the query."""
    wanted = query_terms(queries).join(index.terms.drop("cf"), ["scope", "term"]).join(index.stats.select("scope", "avgdl"), "scope")
    hits = index.postings.join(wanted, ["scope", "term"])
    part = saturated() if formula is None else formula
    return hits.groupBy(*QUERY, "unit").agg(F.sum(part).alias("score"))


def score_text(units: DataFrame, queries: DataFrame, formula: Column | None = None) -> DataFrame:
    """Score raw units without a stored index."""
    return score(build_index(units, text_vocabulary(queries)), queries, formula)


def ranked(scores: DataFrame, k: int, keys: list[str] | None = None, unit: str = "unit") -> DataFrame:
    """Top ``k`` positive scores per query; ties by unit. Scores are rounded so that ties are stable."""
    keys = keys or QUERY
    even = scores.withColumn("score", F.round("score", 9)).filter("score > 0")
    return top_k(even, keys, [F.desc("score"), F.col(unit)], k)


#: What bounds allow for the order of sums and for scores rounded to nine places.
SLACK = 1e-6
#: Blocks of a term's postings per wanted rank.
BLOCKS = 4


def term_bounds(weights: DataFrame, k: int) -> DataFrame:
    """(scope, term, high, kth): the largest weight of a term, and a weight that at least ``k`` of its units reach (0 if unknown).

    Postings fall into ``BLOCKS * k`` blocks by unit. The k-th largest of the blocks' best weights belongs to
    k different units, so it bounds the k-th largest weight from below; blocks combine before the shuffle.
    """
    block = F.pmod(F.xxhash64("unit"), F.lit(BLOCKS * k))
    best = weights.groupBy("scope", "term", block.alias("block")).agg(F.max("weight").alias("weight"))
    tops = F.sort_array(F.collect_list("weight"), asc=False)
    return best.groupBy("scope", "term").agg(F.max("weight").alias("high"), F.coalesce(F.get(tops, F.lit(k - 1)), F.lit(0.0)).alias("kth"))


def top(weights: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The rows of ``ranked(score(...), k)``, from ``weighted`` postings, without scoring every hit of every query.

    A score is at least each of its parts, so the k-th best score of a query reaches the largest ``kth`` of
    its terms. Its terms of least ``high`` whose sum stays below that cannot lift a unit into the top k alone:
    only units that hold another of its terms are candidates. Those are scored by these other terms first; the
    k-th best of these sums raises the bound, and only units that can still reach it meet the terms left over.
    Such terms are the frequent ones, whose postings would make most of the rows.
    """
    wanted = query_terms(queries).join(term_bounds(weights, k), ["scope", "term"])
    own = W.partitionBy(*QUERY)
    upto = own.orderBy("high", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    plan = cut_lineage(wanted.select(*QUERY, "term", "high", (F.sum("high").over(upto) + SLACK < F.max("kth").over(own)).alias("minor")))
    minor = plan.filter("minor").select(*QUERY, "term")
    rest = plan.filter("minor").groupBy(*QUERY).agg(F.sum("high").alias("rest"))
    major = plan.filter("NOT minor").select(*QUERY, "term").join(weights, ["scope", "term"])
    parts = major.groupBy(*QUERY, "unit").agg(F.sum("weight").alias("part"))
    least = top_k(parts, QUERY, [F.desc("part"), F.col("unit")], k, "_r").groupBy(*QUERY).agg(F.min(F.when(F.col("_r") == k, F.col("part"))).alias("least"))
    bound = least.join(rest, QUERY, "left").select(*QUERY, (F.coalesce("least", F.lit(0.0)) - F.coalesce("rest", F.lit(0.0)) - SLACK).alias("need"))
    left = cut_lineage(parts.join(bound, QUERY).filter("part >= need").select(*QUERY, "unit", "part"))
    more = left.join(minor, QUERY).join(weights, ["scope", "term", "unit"]).select(*QUERY, "unit", F.col("weight").alias("part"))
    return ranked(left.unionByName(more).groupBy(*QUERY, "unit").agg(F.sum("part").alias("score")), k)


def top_text(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``top`` over raw units without a stored index; the postings of the query terms are written once."""
    return top(cut_lineage(weighted(build_index(units, text_vocabulary(queries)))), queries, k)


SLICE = 4_000_000  # postings of a scope that one task scores at a time
ASKED = 1 << 16  # queries that one task holds
STRIDE = 32  # units in a block whose largest weights bound their scores
LEAD = 6  # heaviest terms by which units are put next to units alike
FEW = 4  # times as many blocks as hold k units are scored first, to find what the k-th best reaches
FREQUENT = 8  # the bounds of a term in more than a block of this many are kept as a dense row


def _best_places(score: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best positive scores, at nine digits; the smaller unit wins a tie."""
    even = np.floor(score * 1e9 + 0.5)
    at = np.flatnonzero(even >= np.partition(even, len(even) - k)[len(even) - k]) if len(even) > k else np.arange(len(even))
    at = at[score[at] > 0]
    return at[np.lexsort((unit[at], -even[at]))[:k]]


class _Slice:
    """Postings of a slice by unit, in blocks of ``STRIDE`` units, with the largest weight of each term in each block.

    Units stand in the order of their heaviest terms, so that blocks hold units alike. A unit's score is at most the sum of
    its block's largest weights. The blocks of the largest sums are scored first; what their k-th best unit reaches rules out
    every block whose sum stays below it. All others are scored, so the k best are exact.
    """

    def __init__(self, unit: np.ndarray, code: np.ndarray, weight: np.ndarray, n_units: int, n_terms: int):
        order = np.lexsort((-weight, unit))
        first = np.searchsorted(unit[order], np.arange(n_units + 1))
        heads = [np.where(first[:-1] + j < first[1:], code[order[np.minimum(first[:-1] + j, len(order) - 1)]], -1) for j in range(LEAD)]
        self.by = np.lexsort(heads[::-1])
        place = np.empty(n_units, np.int64)
        place[self.by] = np.arange(n_units)
        at = place[unit]
        order = np.argsort(at, kind="stable")
        self.code, self.weight = code[order], weight[order]
        self.size = np.bincount(at, minlength=n_units)
        self.start = np.cumsum(self.size) - self.size
        self.blocks = -(-n_units // STRIDE)
        block = at // STRIDE
        order = np.lexsort((block, code))
        code, block = code[order], block[order]
        fresh = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
        self.block, self.high = block[fresh], np.maximum.reduceat(weight[order], fresh)
        self.cuts = np.searchsorted(code[fresh], np.arange(n_terms + 1)).tolist()
        self.wanted = np.zeros(n_terms)
        self.dense: dict[int, np.ndarray] = {}

    def bounds(self, terms: list[int], factors: list[float]) -> np.ndarray:
        out = np.zeros(self.blocks)
        for t, factor in zip(terms, factors):
            a, b = self.cuts[t], self.cuts[t + 1]
            if (b - a) * FREQUENT < self.blocks:
                out[self.block[a:b]] += self.high[a:b] * factor
                continue
            if t not in self.dense:
                self.dense[t] = np.zeros(self.blocks)
                self.dense[t][self.block[a:b]] = self.high[a:b]
            out += self.dense[t] * factor
        return out

    def scores(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all units of some blocks, in order, for the terms in ``wanted``."""
        at = (blocks[:, None] * STRIDE + np.arange(STRIDE)).ravel()
        at = at[at < len(self.by)]
        size = self.size[at]
        ends = np.cumsum(size)
        posts = np.arange(ends[-1]) + np.repeat(self.start[at] - ends + size, size)
        return at, np.add.reduceat(self.weight[posts] * self.wanted[self.code[posts]], ends - size)

    def best(self, terms: list[int], factors: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best units and their scores."""
        high = self.bounds(terms, factors)
        self.wanted[terms] = factors
        few, least = FEW * -(-k // STRIDE), 0.0
        if few * 4 < self.blocks:
            _, score = self.scores(np.sort(np.argpartition(high, self.blocks - few)[self.blocks - few :]))
            if len(score) >= k:
                least = np.partition(score, len(score) - k)[len(score) - k]
        blocks = np.flatnonzero(high >= least - SLACK) if least > SLACK else np.flatnonzero(high)
        unit, score = blocks, high[blocks]
        if len(blocks):
            at, score = self.scores(blocks)
            top = _best_places(score, self.by[at], k)
            unit, score = self.by[at[top]], score[top]
        self.wanted[terms] = 0.0
        return unit, score


def _slice_tops(k: int, schema: pa.Schema):
    """The task of one slice of units and one block of queries of a scope."""

    def run(posts: pa.Table, asked: pa.Table) -> pa.Table:
        if not posts.num_rows or not asked.num_rows:
            return schema.empty_table()
        posts = posts.combine_chunks()
        units = pc.unique(posts["unit"])
        units = units.take(pc.sort_indices(units))
        unit = pc.index_in(posts["unit"], value_set=units).combine_chunks().to_numpy()
        coded = pc.dictionary_encode(posts["term"]).combine_chunks()
        code, terms = coded.indices.to_numpy(), coded.dictionary
        part = _Slice(unit, code, posts["weight"].to_numpy(), len(units), len(terms))
        wanted = asked["terms"].combine_chunks()
        cuts = wanted.offsets.to_numpy()
        found = pc.index_in(wanted.values, value_set=terms).fill_null(-1).to_numpy()
        factors = asked["factors"].combine_chunks().values.to_numpy()
        rows, places, scores = [], [], []
        for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            held = found[lo:hi] >= 0
            at, score = part.best(found[lo:hi][held].tolist(), factors[lo:hi][held].tolist(), k)
            rows.append(np.full(len(at), i))
            places.append(at)
            scores.append(score)
        asked_at, unit_at = pa.array(np.concatenate(rows)), pa.array(np.concatenate(places))
        columns = [asked[c].combine_chunks().take(asked_at) for c in QUERY] + [units.take(unit_at), pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def best_units(weights: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Top ``k`` units per query by the sum of their weights, ranked as by ``ranked``, without a row per query and unit.

    ``weights``: (scope, term, unit, weight), a unit's terms distinct and weights not negative; ``asked``: (scope, qid,
    label, terms) with distinct terms and, if weights differ by query, ``factors`` that multiply them, place by place.
    A scope's units are dealt over slices of about ``SLICE`` postings; all postings of a unit share one. A task scores
    every query over its slice and hands on the slice's ``k`` best; the best of these are the best of the scope. Every unit
    is scored or lies in a block that cannot reach the ``k`` best (``_Slice``). What moves is the postings, once per ``ASKED``
    queries, the queries, once per slice, and ``k`` rows per query and slice.
    """
    spark = weights.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    deal = lambda c, n: F.pmod(F.xxhash64(*c), F.col(n))
    factors = F.col("factors") if "factors" in asked.columns else F.transform("terms", lambda t: F.lit(1.0))
    asked = asked.select(*QUERY, "terms", factors.alias("factors"))
    slices = weights.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"))
    sizes = cut_lineage(slices.join(asked.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("blocks")), "scope"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kinds = dict(asked.dtypes) | {"unit": dict(weights.dtypes)["unit"]}
    # both sides' scopes as one type: equal numbers of two types hash apart
    keys = [F.col("scope").cast(kinds["scope"]).alias("group"), "slice", "block"]
    left = weights.join(sizes, "scope").select("scope", "term", "unit", "weight", deal(["unit"], "slices").alias("slice"), upto("blocks").alias("block"))
    right = asked.join(sizes, "scope").select(*QUERY, "terms", "factors", deal(["qid", "label"], "blocks").alias("block"), upto("slices").alias("slice"))
    left = left.select(*keys, "term", "unit", "weight").repartition(parts, "group", "slice", "block")
    right = right.select(*keys, *QUERY, "terms", "factors").repartition(parts, "group", "slice", "block")
    out = ", ".join(f"{c} {kinds[c]}" for c in (*QUERY, "unit")) + ", score double"
    blank = spark.createDataFrame([], out).toArrow().schema
    tops = left.groupBy("group", "slice", "block").cogroup(right.groupBy("group", "slice", "block")).applyInArrow(_slice_tops(k, blank), out)
    return ranked(tops, k)


def best_of_text(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The rows of ``ranked(score_text(...), k)`` by ``best_units``; the postings of the query terms are written once."""
    weights = cut_lineage(text_weights(units, text_vocabulary(queries)))
    return best_units(weights, queries.select(*QUERY, F.array_distinct(tokenize("query")).alias("terms")).distinct(), k)


def normalized(scores: DataFrame) -> DataFrame:
    """Scores divided by the best score of their query."""
    best = scores.groupBy(*QUERY).agg(F.max("score").alias("best"))
    return scores.join(best, QUERY).withColumn("score", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0)).drop("best")
