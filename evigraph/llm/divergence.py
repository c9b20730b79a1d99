"""Divergence of sources: how far the sources of a language differ in their terms, and in which.

Chunk factorization. Texts are cut at ASCII white space, which no term holds. Chunks are counted per document
and summed per task and (lang, source); each globally distinct chunk meets in one place, where it is cut into
its terms once; the terms take over its counts. Occurrences are sums. The number of documents of a term lies
between that of its most frequent chunk and the sum over its chunks; only where these do not decide are the
documents themselves looked at again, each counted once however many of a term's chunks it holds. A bit table
of fixed size tells tasks which chunks are worth a row there; what it lets through in vain a join drops.

Counts move in packed rows: one row holds all chunks of a task that hash to one bucket, so a shuffled row is
hundreds of counts.

Results are exact: whole numbers throughout. Null lang, source and text count as empty. Rows are documents,
whatever their ids; repeated rows count each. A group without terms takes part; a language without kept terms
has pairs of value 0. An empty table gives no rows. Columns beside text, lang and source take no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evigraph.common import cut_lineage, top_k

#: Terms within the bytes of a chunk in which A-Z are lower-cased; no byte of a longer character is below 80.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000
ENTRIES = 400_000  # (lang, source, chunk) counts that a task holds before it passes them on
SLICE = 4 << 20  # bytes of text cut into chunks at a time
BITS = 26  # the table of chunks to look at again has 2^26 bits, 8 MB
SOURCES = 256  # sources in one side of a comparison
TERMS = 2048  # expected terms in one comparison

PACKED = pa.schema([
    ("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())),
    ("chunks", pa.list_(pa.string())), ("groups", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
])


def _inputs(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))


def _lists(cuts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


def _summed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of the columns over each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[starts], *(np.add.reduceat(c[order], starts) if len(key) else c for c in columns)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``SLICE`` bytes of text."""
    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // SLICE
    starts = np.flatnonzero(np.append(True, size[1:] != size[:-1])) if len(size) else size
    for a, z in zip(starts, np.append(starts[1:], len(size))):
        yield batch.slice(a, z - a)


def _chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Cut texts at ASCII white space: the text and the number of each chunk, and the distinct chunks."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.string()))
    coded = pc.dictionary_encode(parts.flatten())
    code = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    blank = pc.index(coded.dictionary, pa.scalar("")).as_py()  # beside white space at either end
    if blank >= 0:
        real = code != blank
        owner, code = owner[real], code[real]
    return owner, code, coded.dictionary.cast(pa.binary())


class _Held:
    """Counts per (lang, source, chunk) of a task, summed up whenever their rows exceed ``ENTRIES``."""

    def __init__(self):
        self.names: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        group = np.array([self.names.setdefault(g, len(self.names)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
        order = np.argsort(group, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner, code, chunks = _chunks(batch.column("text"))
        # by chunk, and inside by group: documents are numbered in the order of their groups
        key = np.sort(code * np.int64(len(order)) + place[owner])
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(starts, len(key)))
        code, group = key[starts] // len(order), group[order]
        here = group[key[starts] % len(order)]
        cuts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (here[1:] != here[:-1]))) if len(code) else starts
        n = np.add.reduceat(times, cuts) if len(cuts) else times
        docs = np.diff(np.append(cuts, len(code)))
        known, each = np.unique(group, return_counts=True)  # the empty chunk of each document
        chunks = pa.concat_arrays([chunks.take(pa.array(code[cuts])), pa.array([b""] * len(known), pa.binary())])
        self.parts.append((chunks, np.append(here[cuts], known), np.append(n, each), np.append(docs, each)))
        self.rows += len(chunks)

    def fold(self) -> None:
        if len(self.parts) > 1:
            coded = pc.dictionary_encode(pa.concat_arrays([x[0] for x in self.parts]))
            group, n, docs = (np.concatenate([x[i] for x in self.parts]) for i in (1, 2, 3))
            key, n, docs = _summed(coded.indices.to_numpy().astype(np.int64) * len(self.names) + group, n, docs)
            self.parts = [(coded.dictionary.take(pa.array(key // len(self.names))), key % len(self.names), n, docs)]
            self.rows = len(key)

    def pack(self, buckets: int) -> pa.RecordBatch:
        """One row per bucket with the counts of its chunks and the groups they belong to."""
        self.fold()
        names, (chunks, group, n, docs) = list(self.names), self.parts[0]
        bucket = np.fromiter(map(crc32, chunks.to_numpy(zero_copy_only=False)), np.uint32, len(chunks)) % np.uint32(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, group = bucket[order], group[order]
        here, starts = np.unique(bucket, return_index=True)
        cuts = np.append(starts, len(order))
        used, local = [], np.empty(len(order), np.int32)
        for a, b in zip(cuts[:-1], cuts[1:]):
            own, local[a:b] = np.unique(group[a:b], return_inverse=True)
            used.append([names[g] for g in own])
        columns = [
            pa.array(here.astype(np.int32)), pa.array([[x for x, _ in u] for u in used], pa.list_(pa.string())), pa.array([[x for _, x in u] for u in used], pa.list_(pa.string())),
            _lists(cuts, chunks.take(pa.array(order)).cast(pa.string())), _lists(cuts, pa.array(local)), _lists(cuts, pa.array(n[order])), _lists(cuts, pa.array(docs[order])),
        ]
        return pa.record_batch(columns, schema=PACKED)


def chunk_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed counts per (lang, source, chunk): occurrences and documents. The empty chunk stands for each document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for rows in _slices(batch):
                held.add(rows)
                if held.rows > ENTRIES:
                    held.fold()
                    if held.rows > ENTRIES // 2:
                        yield held.pack(buckets)
                        held = _Held()
        if held.parts:
            yield held.pack(buckets)

    kinds = {"int32": "int", "list<item: string>": "array<string>", "list<item: int32>": "array<int>", "list<item: int64>": "array<long>"}
    return _inputs(docs).mapInArrow(count, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in PACKED))


TERM_ROWS = "lang string, source string, chunk string, term string, n long"


def _terms_of_bucket(rows: list[dict]) -> pa.RecordBatch:
    """All counts of the chunks of one bucket, handed on to their terms."""
    at: dict[tuple[str, str], int] = {}
    group = np.concatenate([np.array([at.setdefault(g, len(at)) for g in zip(r["langs"].as_py(), r["sources"].as_py())], np.int64)[r["groups"].values.to_numpy()] for r in rows])
    n, docs = (np.concatenate([r[c].values.to_numpy() for r in rows]) for c in ("n", "docs"))
    coded = pa.concat_arrays([r["chunks"].values for r in rows]).dictionary_encode()
    chunk = coded.indices.to_numpy().astype(np.int64)
    names = list(at)
    langs = sorted({lang for lang, _ in names})
    lang_of = np.array([langs.index(lang) for lang, _ in names], np.int64)
    key, n, docs = _summed(chunk * len(names) + group, n, docs)
    chunk, group = key // len(names), key % len(names)
    wide, per_lang = _summed(chunk * len(langs) + lang_of[group], docs)

    owner, terms, times = [], [], []  # the terms of each distinct chunk, by chunk
    for i, text in enumerate(pc.ascii_lower(coded.dictionary).cast(pa.binary()).to_numpy(zero_copy_only=False)):
        found = TERM.findall(text)
        if len(found) > 1:
            found = Counter(found)
            owner += [i] * len(found)
            terms += found
            times += found.values()
        elif found:
            owner.append(i)
            terms += found
            times.append(1)
    owner, times, terms = np.array(owner, np.int64), np.array(times, np.int64), pa.array(terms, pa.binary()).cast(pa.string())
    many = np.bincount(owner, minlength=len(coded.dictionary))
    first = np.cumsum(many) - many

    def spread(chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of chunks: the row and the place of the term, for each of the chunk's terms."""
        row = np.repeat(np.arange(len(chunk)), many[chunk])
        inside = np.arange(len(row)) - np.repeat(np.cumsum(many[chunk]) - many[chunk], many[chunk])
        return row, first[chunk[row]] + inside

    pick = lambda values, places: pa.array(values, pa.string()).take(pa.array(places))
    none = lambda size: pa.nulls(size, pa.string())
    row, place = spread(chunk)
    parts = [[pick([x for x, _ in names], group[row]), pick([x for _, x in names], group[row]), none(len(row)), terms.take(pa.array(place)), pa.array(n[row] * times[place])]]
    row, place = spread(wide // len(langs))
    parts.append([pick(langs, wide[row] % len(langs)), none(len(row)), coded.dictionary.take(pa.array(wide[row] // len(langs))), terms.take(pa.array(place)), pa.array(per_lang[row])])
    here = group[chunk == pc.index(coded.dictionary, pa.scalar("")).as_py()]
    parts.append([pick([x for x, _ in names], here), pick([x for _, x in names], here), none(len(here)), none(len(here)), pa.array(np.zeros(len(here), np.int64))])
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], [f.split()[0] for f in TERM_ROWS.split(", ")])


def term_rows(packed: DataFrame, parts: int) -> DataFrame:
    """Rows of three kinds: (lang, source, term, n) occurrences; (lang, chunk, term, n) documents that hold the chunk, without a
    source; (lang, source) alone for each group."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                bucket = row["bucket"].as_py()
                if now is not None and bucket != now:
                    yield _terms_of_bucket(rows)
                    rows = []
                now = bucket
                rows.append(row)
        if rows:
            yield _terms_of_bucket(rows)

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(cut, TERM_ROWS)


def documents_with(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, term, docs) of ``wanted`` (lang, chunk, term): documents that hold any of a term's chunks."""
    place = F.shiftrightunsigned(F.crc32(F.col("chunk").cast("binary")), 32 - BITS)
    words = wanted.select(F.shiftright(place, 5).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2^BITS / 32 rows
    table = np.zeros(1 << (BITS - 5), np.uint32)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(table.astype("<u4").view(np.uint8))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                owner, code, chunks = _chunks(b.column("text"))
                place = np.fromiter(map(crc32, chunks.to_numpy(zero_copy_only=False)), np.int64, len(chunks)) >> (32 - BITS)
                marked = (shared.value[place >> 3] >> (place & 7) & 1).astype(bool)
                hit = marked[code]
                key = np.sort(code[hit] * np.int64(b.num_rows) + owner[hit])
                key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
                code, row = pa.array(key // b.num_rows), pa.array(key % b.num_rows)
                yield pa.record_batch([b.column("lang").take(row), chunks.take(code).cast(pa.string()), b.column("row").take(row)], ["lang", "chunk", "row"])

    rows = _inputs(docs).select("lang", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(find, "lang string, chunk string, row long")
    held = rows.join(wanted, ["lang", "chunk"]).select("lang", "term", "row").distinct()
    return held.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs"))


def kept_terms(docs: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """(lang, term) of all terms in at least ``least`` documents of the language, each document counted once."""
    chunks = rows.filter("source IS NULL")
    bounds = chunks.groupBy("lang", "term").agg(F.max("n").alias("lo"), F.sum("n").alias("hi"))
    bounds = cut_lineage(bounds.filter(F.col("hi") >= least))
    open_terms = bounds.filter(F.col("lo") < least).select("lang", "term")
    wanted = cut_lineage(chunks.join(open_terms, ["lang", "term"]).select("lang", "chunk", "term"))
    counted = documents_with(docs, wanted).filter(F.col("docs") >= least)
    return bounds.filter(F.col("lo") >= least).select("lang", "term").unionByName(counted.select("lang", "term"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / total) in decimals wide enough for any count."""
    return F.lit(1) + F.call_function("div", (n + 5).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


class Audit:
    """Tables of one run: ``groups`` (lang, source, n, v, total), ``langs`` (lang, n, v, total) and ``counts`` (lang, source, term, n)."""

    def __init__(self, docs: DataFrame, least: int = 30):
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = cut_lineage(term_rows(chunk_counts(docs, 4 * parts), parts))
        kept = cut_lineage(kept_terms(docs, rows, least))
        found = rows.filter("source IS NOT NULL AND term IS NOT NULL").join(kept, ["lang", "term"], "left_semi")
        self.counts = cut_lineage(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
        total = F.coalesce("n", F.lit(0)) + 5 * F.coalesce("v", F.lit(0))
        sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
        pick = [F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), total.alias("total")]
        here = rows.filter("source IS NOT NULL AND term IS NULL").select("lang", "source").distinct()
        here = here.join(self.counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(sizes, "lang", "left")
        self.groups = cut_lineage(here.select("lang", "source", *pick))
        langs = self.groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
        self.langs = langs.select("lang", *pick)

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) for all ordered pairs of sources of a language.

        Terms are dealt into blocks by hash and sources into tiles by number; one task compares two tiles over
        one block. Terms absent from both sources add the same each, so they are counted, not visited.
        """
        order = W.partitionBy("lang").orderBy("source")
        tiles = F.floor((F.row_number().over(order) - 1) / SOURCES).cast("int")
        groups = self.groups.withColumn("base", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"))).otherwise(0).cast("long")).withColumn("tile", tiles)
        groups = cut_lineage(groups)
        blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int")
        many = groups.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))
        groups = groups.join(many, "lang")
        rows = self.counts.join(groups, ["lang", "source"]).select(
            "lang", "source", "tile", "tiles", "base", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "term", share(self.counts["n"], F.col("total")).cast("long").alias("p")
        )
        marks = groups.select("lang", "source", "tile", "tiles", "base", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.col("base").alias("p"))
        rows = rows.unionByName(marks)
        # a tile meets every tile of its language, itself included: as the left one from its own number on, else as the right one
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        rows = rows.select("*", other).withColumn("left", F.least("tile", "other")).withColumn("right", F.greatest("tile", "other"))

        def compare(rows: pd.DataFrame) -> pd.DataFrame:
            lang = rows["lang"].iat[0]
            sources = rows.drop_duplicates("source").sort_values(["tile", "source"])  # one order in every block
            at = {s: i for i, s in enumerate(sources["source"])}
            base = sources["base"].to_numpy(np.int64)
            named = rows[rows["term"].notna()]
            codes, known = pd.factorize(named["term"])
            p = np.repeat(base[:, None], len(known), axis=1)
            p[named["source"].map(at).to_numpy(int), codes] = named["p"].to_numpy(np.int64)
            tile = sources["tile"].to_numpy()
            names = sources["source"].to_numpy()
            left = np.flatnonzero(tile == tile.min())
            right = np.flatnonzero(tile == tile.max())
            out = []
            for i in left:
                j = right[right > i] if tile.min() == tile.max() else right
                apart = np.abs(p[j] - p[i]).sum(axis=1) - len(known) * np.abs(base[j] - base[i])
                out += zip([lang] * len(j), [names[i]] * len(j), names[j], apart.tolist())
            return pd.DataFrame(out, columns=["lang", "a", "b", "part"])

        parts = rows.groupBy("lang", "left", "right", "block").applyInPandas(compare, "lang string, a string, b string, part long")
        sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
        side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("base").alias(f"{name}_base"), "v")
        sums = sums.join(side("a"), ["lang", "a"]).join(side("b").drop("v"), ["lang", "b"])
        value = F.col("part") + F.col("v") * F.abs(F.col("a_base") - F.col("b_base"))
        both = [F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))]
        return sums.select("lang", F.inline(F.array(*both)), value.alias("value"))

    def terms(self, top: int = 50) -> DataFrame:
        """(lang, source, item, value, rank): the terms a source has in excess of its language, at most ``top``."""
        whole = self.counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n")).join(self.langs.select("lang", F.col("total").alias("all_total")), "lang")
        rows = self.counts.join(self.groups.select("lang", "source", "total"), ["lang", "source"]).join(whole, ["lang", "term"])
        value = share(F.col("n"), F.col("total")) - share(F.col("all_n"), F.col("all_total"))
        rows = rows.select("lang", "source", F.col("term").alias("item"), value.cast("long").alias("value")).filter("value > 0")
        return top_k(rows, ["lang", "source"], [F.desc("value"), F.col("item")], top)


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, then the terms in excess."""
    run = Audit(docs, least)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item")))
    pairs = run.pairs().withColumn("rank", rank).withColumn("part", F.lit("pair"))
    terms = run.terms(top).withColumn("part", F.lit("term"))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return reduce(DataFrame.unionByName, [x.select(*cols) for x in (pairs, terms)])
