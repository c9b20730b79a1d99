"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A text is the set of its distinct ``words``-word shingles, as 64-bit hashes. Two sets of sizes a and b
reach the similarity only if they share at least ``t * max(a, b)`` shingles, so under any common order
of shingles the first ``s - ceil(t * s) + l`` of each set of size s share at least l. Small sets (size up
to a boundary) list all 2-subsets of that prefix for l = 2, large ones (size above ``t`` times the
boundary, so that mixed pairs meet too) list its shingles for l = 1. The boundary is the one of least
cost over the sizes found: subsets listed against postings and the sets they meet there.

The order puts frequent shingles last. They come from per-task counts of all texts, at most ``HEAVY``
of them (the proven bound of what is sent to tasks); which ones are known changes the time only. So a
passage in a third of all texts hardly enters any prefix.

Equal sets are one class. In each list of a key, the members are first held against its smallest one;
components of those links then leave pairs of different components, which pass two exact bounds (length
and place of the shared shingles; parity bitmaps, whose differing bits each need a differing shingle)
before their whole sets are compared. Long lists are cut into tiles. Every pair is linked already,
excluded by a bound, or compared over all its shingles: no link is lost, and none rests on a sketch.
Shingles are compared by 64-bit hashes of their words' 64-bit hashes, so unequal ones are taken as equal with a
chance of 2^-64 a pair.

Defined results: null and empty texts, and those without words, have no shingles and link with nothing;
texts of fewer words than a shingle are one shingle. Repeated rows repeat; rows that share an id count
as linked; a null id keeps a null component. Ids are whole numbers; others are refused by name. Columns beyond
id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evigraph.common import cut_lineage

from .common import chain, components, mix, signed, whole_id

HEAVY = 100_000
CHUNK = 2_000_000
OFTEN = 6
BITS, MOST_BITS = 1 << 10, 1 << 16
BROADCAST = 200_000
SEEN = 300_000
#: Cost of one met set relative to one posting.
MEET = 4.0


LOT = 1 << 20


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, each of its whole bytes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(texts: list[str], words: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted. A-Z are lower-cased; words are cut at ASCII white space."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        held: list[bytes] = []
        ends: list[int] = []
        size = 0
        while at < len(texts) and (not ends or size + len(texts[at]) <= LOT):
            held += texts[at].encode("utf-8", "surrogatepass").lower().split()
            ends.append(len(held))
            size += len(texts[at])
            at += 1
        w = word_hashes(held)
        every = chain([w[i : len(w) - words + 1 + i] for i in range(words)]) if len(w) >= words else w[:0]
        for lo, hi in zip([0, *ends], ends):
            if hi - lo >= words:
                out.append(np.unique(every[lo : hi - words + 1]))
            else:
                out.append(chain([w[i : i + 1] for i in range(lo, hi)]) if hi > lo else w[:0])
    return out


def least_shared(size: int, percent: int) -> int:
    """Shingles that a set must share with any partner."""
    return -(-percent * size // 100)


def boundary(sizes: dict[int, int], meets: float, percent: int) -> int:
    """Largest size of a small set: least cost of subset rows, postings and met sets."""
    prefix = lambda s: s - least_shared(s, percent)
    light = lambda s: comb(prefix(s) + 2, 2)
    heavy = lambda s: (prefix(s) + 1) * (1 + MEET * meets)
    best, at = None, 0
    for x in sorted({0, *sizes}):
        cost = sum(n * light(s) for s, n in sizes.items() if s <= x) + sum(n * heavy(s) for s, n in sizes.items() if 100 * s > percent * x)
        if best is None or cost < best:
            best, at = cost, x
    return at


def _survey(words: int):
    """Rows: 0 (id, size, hash, hash) per text; 1 (shingle, count) of shingles frequent in a chunk; 2 (postings, met) per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, total = set(), [], 0

        def counted():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= OFTEN
            rare = n[~often]
            yield _rows(1, signed(token[often]), n[often], 0, 0)
            yield _rows(2, np.array([int(rare.sum())]), np.array([int((rare * (rare - 1)).sum())]), 0, 0)

        for batch in batches:
            size, h1, h2 = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            maps, wide = [b""] * batch.num_rows, [b""] * batch.num_rows
            for i, s in enumerate(shingles(batch.column(1).to_pylist(), words)):
                size[i] = len(s)
                if len(s):
                    h1[i] = mix(s).sum(dtype=np.uint64)
                    h2[i] = xxhash.xxh3_64_intdigest(s.tobytes())
                    wide[i] = bitmap(s)
                    maps[i] = folded(np.frombuffer(wide[i], np.uint64)[None], BITS // 64).tobytes()
                    if int(h2[i]) not in seen:
                        seen.add(int(h2[i]))
                        held.append(s)
                        total += len(s)
                        if total > CHUNK:
                            yield from counted()
                            held, total = [], 0
            yield _rows(0, batch.column(0), size, signed(h1), signed(h2), maps, wide)
        if held:
            yield from counted()

    return run


def _rows(kind, a, n, h1, h2, maps=None, wide=None) -> pa.RecordBatch:
    full = lambda x: pa.array(np.full(len(a), x, np.int64) if isinstance(x, int) else x, pa.int64())
    bits = [pa.array(m if m else [None] * len(a), pa.binary()) for m in (maps, wide)]
    return pa.RecordBatch.from_arrays([full(kind), a if isinstance(a, pa.Array) else full(a), full(n), full(h1), full(h2), *bits], ["kind", "doc", "n", "h1", "h2", "bitmap", "wide"])


def bitmap(s: np.ndarray) -> bytes:
    """Parity of how many shingles fall on each place; two to four places for each shingle, from ``BITS`` to ``MOST_BITS``."""
    bits = min(MOST_BITS, max(BITS, 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1 == 1).tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows, words) as those of fewer places: parities of places that fall together add up."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def may_reach(apart: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with that many differing bits and that sum of sizes can reach the similarity."""
    return apart * (100 + percent) <= (100 - percent) * sizes


def prefix_keys(s: np.ndarray, heavy: np.ndarray, rank: np.ndarray, border: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set and the most it can share with another set whose first common shingles are those of the key."""
    n = len(s)
    at = np.searchsorted(heavy, s)
    at[at == len(heavy)] = 0
    is_heavy = heavy[at] == s if len(heavy) else np.zeros(n, bool)
    order = np.concatenate([s[~is_heavy], s[is_heavy][np.argsort(rank[at[is_heavy]], kind="stable")]]) if len(heavy) else s
    spare = n - least_shared(n, percent)
    keys, most = [], []
    if n <= border:
        p = order[: spare + 2]
        if len(p) == 1:
            p = np.append(p, np.uint64(0))  # a set of one shingle has no pair
        i, j = np.triu_indices(len(p), 1)
        keys.append(chain([p[i], p[j], np.full(len(i), 2, np.uint64)]))
        most.append(np.minimum(n - j + 1, n))
    if 100 * n > percent * border:
        p = order[: spare + 1]
        keys.append(p)
        most.append(n - np.arange(len(p)))
    return np.concatenate(keys), np.concatenate(most)


def _postings(words: int, heavy: np.ndarray, rank: np.ndarray, border: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            docs, keys, most, sizes = [], [], [], []
            for doc, s in zip(batch.column(0).to_pylist(), shingles(batch.column(1).to_pylist(), words)):
                if not len(s) or (mark := xxhash.xxh3_64_intdigest(s.tobytes())) in seen:
                    continue
                seen.add(mark)
                k, m = prefix_keys(s, heavy, rank, border, percent)
                keys.append(k)
                most.append(m)
                docs.append(np.full(len(k), doc, np.int64))
                sizes.append(np.full(len(k), len(s), np.int32))
            if keys:
                columns = [signed(np.concatenate(keys)), np.concatenate(docs), np.concatenate(sizes), np.concatenate(most).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc", "size", "most"])

    return run


def _heads(percent: int):
    """Rows of keys with several sets, in order of (key, doc): each with the key's first set, and whether both can reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # first row of the last key, and whether it was given out
        for batch in batches:
            key, doc, size, most = (batch.column(i).to_numpy() for i in range(4))
            out_before = False
            if head is not None:
                out_before = head[4]
                key, doc, size, most = (np.append(np.array([h], x.dtype), x) for h, x in zip(head, (key, doc, size, most)))
            first = np.append(True, key[1:] != key[:-1])
            start = np.flatnonzero(first)[np.cumsum(first) - 1]
            several = ~first
            several[start[~first]] = True
            last = int(start[-1])
            if head is not None and out_before:
                several[0] = False
            head = (key[last], doc[last], size[last], most[last], bool(several[last]) or (last == 0 and out_before))
            at = np.flatnonzero(several)
            if not len(at):
                continue
            lead = start[at]
            need = percent * (size[at].astype(np.int64) + size[lead])
            ok = (np.minimum(most[at], most[lead]).astype(np.int64) * (100 + percent) >= need) & (doc[at] != doc[lead])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at], doc[at], size[at], most[at], doc[lead], ok)], ["key", "doc", "size", "most", "head", "ok"])

    return run


def _screen(percent: int):
    """Pairs (a, b) that neither sizes nor bitmaps exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_numpy() for i in (2, 3))
            apart = np.zeros(len(x), np.int64)
            maps = [batch.column(i).to_pylist() for i in (4, 5)]
            sizes = np.array([[len(m) // 8 for m in side] for side in maps]).reshape(2, -1)
            for pair in np.unique(sizes, axis=1).T:
                rows = np.flatnonzero((sizes == pair[:, None]).all(0))
                one, two = (folded(np.frombuffer(b"".join([side[r] for r in rows]), np.uint64).reshape(len(rows), -1), int(pair.min())) for side in maps)
                apart[rows] = np.bitwise_count(one ^ two).sum(1)
            ok = may_reach(apart, x + y, percent) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            rows = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], ["a", "b"])

    return run


def screened(pairs: DataFrame, classes: DataFrame, percent: int, column: str) -> DataFrame:
    one = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col(column).alias("ma"))
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col(column).alias("mb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_screen(percent), "a long, b long")


def _compare(words: int, percent: int):
    """Linked pairs, from rows (head, slot, doc, text) in order; the row whose doc is the head comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            out = []
            for head, slot, doc, s in zip(*(batch.column(i).to_pylist() for i in range(3)), shingles(batch.column(3).to_pylist(), words)):
                if (head, slot) != at:
                    at, own = (head, slot), []
                if doc == head:
                    own.append(s)
                    continue
                for t in own:
                    where = np.searchsorted(t, s)
                    where[where == len(t)] = 0
                    both = int((t[where] == s).sum()) if len(t) else 0
                    if both and 100 * both >= percent * (len(s) + len(t) - both):
                        out.append((head, doc))
                        break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int, tile: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity. The pairs of one ``a`` are dealt into slots of about ``tile``."""
    slots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / tile).alias("slots"))
    members = pairs.join(slots, "a").select(F.col("a").alias("head"), F.pmod(F.xxhash64("b"), F.col("slots")).alias("slot"), F.col("b").alias("doc"))
    wanted = members.unionByName(members.select("head", "slot", F.col("head").alias("doc")).distinct())
    wanted = cut_lineage(wanted)
    if wanted.count() <= BROADCAST:  # checked: at most that many rows of 24 bytes; more meet the texts by a shuffle
        wanted = F.broadcast(wanted)
    rows = texts.join(wanted, "doc").select("head", "slot", "doc", "text")
    rows = rows.repartition("head", "slot").sortWithinPartitions("head", "slot", F.col("doc") != F.col("head"), "doc")
    return rows.mapInArrow(_compare(words, percent), "a long, b long")


def _differing(percent: int):
    """Pairs of different components within a key and pair of tiles that no bound excludes."""
    seen: set[tuple[int, int]] = set()

    def settle(cols) -> Iterator[pa.RecordBatch]:
        node, comp, size, most, maps, chunk, split = cols
        bits = np.frombuffer(b"".join(maps), np.uint64).reshape(len(node), -1)
        low, high = chunk == chunk.min(), chunk == chunk.max()
        a_rows, b_rows = np.flatnonzero(low), np.flatnonzero(high)
        if split[0] and low.all():
            return  # the other tile of this pair is empty
        for i in a_rows:
            b = b_rows if split[0] else b_rows[b_rows > i]
            total = percent * (size[i].astype(np.int64) + size[b])
            b = b[(comp[b] != comp[i]) & (np.minimum(most[b], most[i]).astype(np.int64) * (100 + percent) >= total) & (np.minimum(size[b], size[i]).astype(np.int64) * 100 >= percent * np.maximum(size[b], size[i]).astype(np.int64))]
            if len(b):
                apart = np.bitwise_count(bits[b] ^ bits[i]).sum(1).astype(np.int64)
                b = b[may_reach(apart, size[b].astype(np.int64) + size[i], percent)]
                if len(b):
                    x, y = np.minimum(node[b], node[i]), np.maximum(node[b], node[i])
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    def new_ones(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each pair once a task, as far as the memory of ``SEEN`` pairs goes; sets that share much meet under many keys."""
        for batch in pairs:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            both = list(zip(a.tolist(), b.tolist()))
            if len(seen) > SEEN:
                seen.clear()
            fresh = [p not in seen for p in both]
            seen.update(both)
            if any(fresh):
                yield batch.filter(pa.array(fresh))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen.clear()
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            keys = [rest[c].to_numpy() for c in ("key", "lo", "hi")]
            new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            starts = np.flatnonzero(new)
            for x, y in zip(starts[:-1], starts[1:]):
                yield from new_ones(settle(_columns(rest.slice(x, y - x))))
            rest = rest.slice(starts[-1]).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from new_ones(settle(_columns(rest)))

    def _columns(t: pa.Table):
        return (*(t[c].to_numpy() for c in ("node", "component", "size", "most")), t["bitmap"].to_pylist(), t["chunk"].to_numpy(), t["lo"].to_numpy() != t["hi"].to_numpy())

    return run


def near_sets(docs: DataFrame, words: int = 5, percent: int = 80, tile: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_shingles, component_id for every row; ``percent`` is the least similarity in hundredths."""
    texts = docs.select(whole_id(docs, id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = cut_lineage(texts.mapInArrow(_survey(words), "kind long, doc long, n long, h1 long, h2 long, bitmap binary, wide binary"))
    rows = found.filter("kind = 0").select("doc", "n", "h1", "h2")
    whole = found.filter("kind = 0 AND n > 0 AND doc IS NOT NULL")
    # Equal sets have equal sizes and bitmaps.
    classes = cut_lineage(whole.groupBy("h1", "h2").agg(F.min("doc").alias("node"), F.max("n").alias("n"), F.max("bitmap").alias("bitmap"), F.max("wide").alias("wide")))
    often = found.filter("kind = 1").groupBy("doc").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "doc").limit(HEAVY).toPandas()
    sizes = {r["n"]: r["count"] for r in classes.filter("n <= 400").groupBy("n").count().collect()}
    met = found.filter("kind = 2").agg(F.sum("doc"), F.sum("n")).first()
    border = boundary(sizes, (met[1] or 0) / max(1, met[0] or 0), percent)
    token = often["doc"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    heavy, rank = token[order], (len(token) - 1 - np.arange(len(token)))[order]

    postings = texts.filter("doc IS NOT NULL").mapInArrow(_postings(words, heavy, rank, border, percent), "key long, doc long, size int, most int")
    lists = cut_lineage(postings.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_heads(percent), "key long, doc long, size int, most int, head long, ok boolean"))
    members = rows.filter("n > 0 AND doc IS NOT NULL").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc", "node").distinct()
    by_doc = members.groupBy("doc").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    twins = members.join(by_doc.filter("node < other").select("doc", F.col("node").alias("low")), "doc").filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    # Only texts in lists matter from here on.
    listed = cut_lineage(lists.select("doc").distinct().join(by_doc.select("doc", "node"), "doc"))
    pairs = lists.filter("ok").select("head", "doc").distinct()
    pairs = pairs.join(listed.select("doc", F.col("node").alias("y")), "doc").join(listed.select(F.col("doc").alias("head"), F.col("node").alias("x")), "head")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()
    pairs = cut_lineage(screened(cut_lineage(screened(pairs, classes, percent, "bitmap")), classes, percent, "wide"))
    links = cut_lineage(linked(pairs, texts, words, percent, tile).unionByName(twins))
    labels = components(links)

    # The head of a list has met all others of it; what is left are pairs of the others.
    placed = lists.filter("doc <> head").join(listed, "doc").select("key", "node", "size", "most").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).filter("x < y").select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    open_ = placed.join(mixed, "key").join(classes.select("node", "bitmap"), "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    open_ = open_.select("key", "lo", "hi", "chunk", "node", "component", "size", "most", "bitmap").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    more = cut_lineage(open_.mapInArrow(_differing(percent), "a long, b long").distinct())
    more = cut_lineage(screened(more, classes, percent, "wide"))
    if not more.isEmpty():
        labels = components(links.unionByName(linked(more, texts, words, percent, tile)))
    out = rows.join(classes.select("h1", "h2", "node"), ["h1", "h2"], "left").join(labels, "node", "left")
    component = F.when(F.col("doc").isNull() | (F.col("n") == 0), F.col("doc")).otherwise(F.coalesce("component", "node"))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"))
