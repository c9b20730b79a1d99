"""Suffix-array dedup: remove every byte covered by a string of ``least`` bytes that also starts earlier.

Suffixes are indexed at synchronised places only: a place is an anchor if its ``GRAM`` bytes hash to the
minimum of all grams inside some window of ``least`` bytes. Each repeated string of that length holds an
anchor, and it is the same one in every copy, so the sparse suffix arrays (about one suffix in 35 bytes,
ordered by the fingerprint of their surroundings) miss no match.

Arrays form a logarithmic family (``Levels``): each new batch of anchors, in order of (document, place),
is scanned against the sorted levels and then becomes a level itself; levels of equal size class merge.
That happens twice: in each map task over its own documents, which shrinks passages that many documents
share before anything is shuffled, and in each shuffle partition, dealt by gram hash.

1. An anchor whose whole surroundings (``least`` - GRAM bytes before, ``least`` bytes from it on) occurred
   earlier is settled: every window over it repeats.
2. An anchor whose gram occurs with other surroundings too is open: its surroundings are fetched, and each
   of the windows over it is compared with those of all earlier ones, again through levels.
3. Spans join their texts by id and text hash.

Defined results: null texts count as empty; texts shorter than ``least`` lose nothing; a null id sorts
before all others; equal rows (same id, same text) are one document and get equal results; rows that
share an id (or have none) but not the text are documents of their own, in order of their text's hash.
Ids are whole numbers; others are refused by name. Columns beyond id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evigraph.common import cut_lineage

from .common import chain, Levels, mix, signed, whole_id

GRAM = 32
BLOCK = 1 << 18
HALO = 384
PAD = 192
ROOM = 4096
NO_ID = -(1 << 63)


def words_at(buffer: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number."""
    raw, n = buffer.tobytes(), len(buffer)
    out = np.zeros(n, np.uint64)
    for j in range(8):
        k = (n - j) // 8
        out[j : j + 8 * k : 8] = np.frombuffer(raw, "<u8", k, j)
    return out


def slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def anchors(parts: list[tuple], least: int) -> tuple[np.ndarray, ...]:
    """Anchors of text parts ((id, text hash), loaded bytes, place of the first, first and last place to report, text length as sixth).

    Returns the id, text hash, place, gram hash, surroundings hash, and the room before and after.
    """
    left = least - GRAM
    size = PAD + sum(len(p[1]) + PAD for p in parts)
    buffer, gram_ok, window_ok, own = np.zeros(size, np.uint8), np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
    shift, at = np.zeros(len(parts), np.int64), PAD
    bounds = []
    for i, (_, raw, first, lo, hi, n) in enumerate(parts):
        buffer[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
        shift[i] = first - at
        gram_ok[at : at + max(0, min(first + len(raw), n) - first - GRAM + 1)] = True
        window_ok[at : at + max(0, len(raw) - least + 1)] = True
        own[at + lo - first : at + hi - first] = True
        bounds.append(at)
        at += len(raw) + PAD
    w = words_at(buffer)
    cut = size - GRAM + 1
    g = chain([w[i : i + cut] for i in range(0, GRAM, 8)])
    g[~gram_ok[:cut]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = slide(g, left + 1, np.minimum)
    low[~window_ok[: len(low)]] = 0
    high = slide(np.concatenate([np.zeros(left, np.uint64), low]), left + 1, np.maximum)
    where = np.flatnonzero((high == g[: len(high)]) & own[: len(high)] & gram_ok[: len(high)])
    part = np.searchsorted(np.array(bounds), where, side="right") - 1
    place = where + shift[part]
    doc, row = np.array([p[0] for p in parts], np.int64).reshape(-1, 2)[part].T
    n = np.array([p[5] for p in parts], np.int64)[part]
    before, after = np.minimum(place, left), np.minimum(n - place, least)
    around = [w[where - left + 8 * i] for i in range((left + least) // 8)]
    tail = (left + least) % 8
    if tail:
        around.append(w[where + least - 8])
    return doc, row, place, g[where], chain([*around, (before * ROOM + after).astype(np.uint64)]), before, after


def text_parts(rows: Iterator[tuple[tuple[int, int], bytes]], least: int) -> Iterator[list[tuple]]:
    """Texts in lots of about ``BLOCK`` bytes; longer ones are cut into parts that overlap by ``HALO`` bytes each way."""
    lot, held = [], 0
    for doc, raw in rows:
        n = len(raw)
        if n < least:
            continue
        for lo in range(0, n, BLOCK):
            hi = min(lo + BLOCK, n)
            first, last = max(0, lo - HALO), min(n, hi + HALO)
            lot.append((doc, raw[first:last], first, lo, hi, n))
            held += last - first
            if held >= BLOCK:
                yield lot
                lot, held = [], 0
    if lot:
        yield lot


def united(start: np.ndarray, end: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join spans, sorted by (document, start), that touch; ``new`` marks a document's first. Gives starts, ends and the first rows."""
    # Ends may not be sorted: carry the largest so far, in keys that restart with each document.
    group = np.cumsum(new)
    span = np.int64(max(1, int(end.max(initial=0)) + 1))
    reach = np.maximum.accumulate(end + group * span) - group * span
    fresh = new.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return start[first], np.maximum.reduceat(end, first) if len(first) else end[:0], first


FOUND = "open boolean, doc long, row long, a long, b long, gram long, key long, fresh boolean"


def _frame(doc, row, a, b, gram, key, fresh, open_=None) -> pa.RecordBatch:
    n = len(doc)
    flags = np.zeros(n, bool) if open_ is None else open_
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (flags, doc, row, a, b, gram, key, fresh)], ["open", "doc", "row", "a", "b", "gram", "key", "fresh"])


def _index_texts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels()

        def rows():
            last = None
            for batch in batches:
                for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    if (doc, row) != last:
                        yield (doc, row), text.as_py().encode("utf-8", "surrogatepass")
                    last = (doc, row)

        for lot in text_parts(rows(), least):
            doc, row, place, gram, key, before, after = anchors(lot, least)
            seen = levels.find(key)
            _, first = np.unique(key, return_index=True)
            again = np.ones(len(key), bool)
            again[first] = False
            again |= seen
            fresh = np.flatnonzero(~again)
            levels.add(np.sort(key[fresh]))
            yield _frame(doc[fresh], row[fresh], place[fresh], (before * ROOM + after)[fresh], signed(gram[fresh]), signed(key[fresh]), np.ones(len(fresh), bool))
            old = np.flatnonzero(again)
            if len(old):
                new = np.ones(len(old), bool)
                new[1:] = (doc[old][1:] != doc[old][:-1]) | (row[old][1:] != row[old][:-1])
                a, b, at = united((place - before)[old], (place + after)[old], new)
                d, t = doc[old][at], row[old][at]
                yield _frame(d, t, a, b, signed(mix(d.astype(np.uint64) + t.astype(np.uint64) + a.astype(np.uint64))), np.zeros(len(d), np.int64), np.zeros(len(d), bool))

    return run


def _scan_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of some grams in order of (document, place): repeats become spans; grams with several surroundings come out open."""
    levels, last = Levels(), None
    for batch in batches:
        doc, row, a, b, gram, key, fresh = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 8))
        # The same place once more comes from an equal row in another task; it is no earlier one.
        same = np.zeros(len(doc), bool)
        same[1:] = (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (a[1:] == a[:-1]) & (key[1:] == key[:-1])
        same[0] = (doc[0], row[0], a[0], key[0]) == last
        last = (doc[-1], row[-1], a[-1], key[-1])
        if (same & fresh).any():
            doc, row, a, b, gram, key, fresh = (x[~(same & fresh)] for x in (doc, row, a, b, gram, key, fresh))
        spans = np.flatnonzero(~fresh)
        rest = np.flatnonzero(fresh)
        k = key[rest].view(np.uint64)
        order = np.argsort(k, kind="stable")
        first = np.ones(len(rest), bool)
        first[order[1:]] = k[order][1:] != k[order][:-1]
        found = levels.find(k)
        new = rest[first & ~found]
        by = new[np.argsort(key[new].view(np.uint64), kind="stable")]
        levels.add(key[by].view(np.uint64), gram[by], doc[by], row[by], a[by], b[by])
        old = rest[~(first & ~found)]
        a, b = a.copy(), b.copy()
        a[old], b[old] = a[old] - b[old] // ROOM, a[old] + b[old] % ROOM
        out = np.sort(np.concatenate([spans, old]))
        yield _frame(doc[out], row[out], a[out], b[out], gram[out], key[out], np.zeros(len(out), bool))
    if levels.runs:
        _, gram, doc, row, a, b = levels.merged()
        order = np.lexsort((a, row, doc, gram))
        g = gram[order]
        same = np.zeros(len(g) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        several = order[same[:-1] | same[1:]]
        for i in range(0, len(several), 20_000):
            at = several[i : i + 20_000]
            yield _frame(doc[at], row[at], a[at], b[at], gram[at], np.zeros(len(at), np.int64), np.zeros(len(at), bool), np.ones(len(at), bool))


def _windows(least: int):
    """Compare the windows over open anchors, in order of (document, place), with those of earlier ones; gives spans."""
    left = least - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels()
        last = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                doc, text, a, b, place, gram = (part.column(i).to_numpy(zero_copy_only=False) for i in range(6))
                around = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint8).reshape(len(doc), left + least)
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1])
                new[0] = (int(doc[0]), int(text[0]), int(place[0])) != last
                last = (int(doc[-1]), int(text[-1]), int(place[-1]))
                doc, text, a, b, place, gram, around = doc[new], text[new], a[new], b[new], place[new], gram[new], around[new]
                if not len(doc):
                    continue
                padded = np.zeros((len(doc), left + least + 8), np.uint8)
                padded[:, : left + least] = around
                w = np.zeros((len(doc), left + least + 1), np.uint64)
                for j in range(8):
                    w |= padded[:, j : j + left + least + 1].astype(np.uint64) << np.uint64(8 * j)
                starts = [*range(0, least - 7, 8), *([least - 8] if least % 8 else [])]
                # The anchor's offset belongs to the key: a periodic window holds the same gram at several places.
                where = gram.view(np.uint64)[:, None] + np.arange(left + 1, dtype=np.uint64)[None]
                key = chain([w[:, s : s + left + 1] for s in starts] + [where])
                start = place[:, None] - left + np.arange(left + 1)[None]
                ok = (start >= a[:, None]) & (start + least <= b[:, None])
                flat, row, begin = key[ok], np.nonzero(ok)[0], start[ok]
                hit = levels.find(flat)
                order = np.argsort(flat, kind="stable")
                again = np.zeros(len(flat), bool)
                again[order[1:]] = flat[order][1:] == flat[order][:-1]
                levels.add(np.sort(flat[~hit & ~again]))
                hit |= again
                if hit.any():
                    row, begin = row[hit], begin[hit]
                    edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array(doc[row[edge]]), pa.array(text[row[edge]]), pa.array(begin[edge]), pa.array(np.maximum.reduceat(begin, edge) + least)], ["doc", "row", "a", "b"])

    return run


def _fetch(least: int):
    """Surroundings of open anchors: ``least`` - GRAM bytes before and ``least`` bytes from the place on, zeros beyond the text."""
    left = least - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                place, room, gram = (wanted.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                around = [(b"\0" * max(0, left - p) + raw[max(0, p - left) : p + least]).ljust(left + least, b"\0") for p in place.tolist()]
                columns = [np.full(len(place), doc, np.int64), np.full(len(place), row, np.int64), place - room // ROOM, place + room % ROOM, place, gram]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(around, pa.binary())], ["doc", "row", "a", "b", "place", "gram", "around"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(whole_id(docs, id_col), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def repeated_spans(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, row, a, b), row the hash of the text: bytes [a, b) of it are covered by strings that also start earlier. Spans may overlap."""
    texts = _texts(docs, id_col, text_col)
    placed = texts.sortWithinPartitions("doc", "row").mapInArrow(_index_texts(least), FOUND)
    found = cut_lineage(placed.repartition("gram").sortWithinPartitions("doc", "row", "a", "key").mapInArrow(_scan_levels, FOUND))
    wanted = found.filter("open").groupBy("doc", "row").agg(F.collect_list(F.struct("a", "b", "gram")).alias("wanted"))
    around = texts.join(wanted, ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(_fetch(least), "doc long, row long, a long, b long, place long, gram long, around binary")
    more = around.repartition("gram").sortWithinPartitions("doc", "row", "place").mapInArrow(_windows(least), "doc long, row long, a long, b long")
    return found.filter("NOT open").select("doc", "row", "a", "b").unionByName(more)


def remove_repeats(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Columns id, n_bytes, n_removed, n_spans, kept (bytes) and those of ``keep`` for every row.

    With ``whole``, what a span leaves of a character it cuts is not among the kept bytes, which then
    are valid UTF-8; the numbers do not change.
    """
    others = [f"k{i}" for i in range(len(keep))]
    spans = repeated_spans(docs, least, id_col, text_col).groupBy("doc", "row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(whole_id(docs, id_col), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                if not spans.is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                a, b = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                order = np.argsort(a, kind="stable")
                new = np.zeros(len(a), bool)
                new[:1] = True
                a, b, _ = united(a[order], np.minimum(b[order], len(raw)), new)
                a, b = a[a < b], b[a < b]
                ends = np.concatenate([a, [len(raw)]]).tolist()
                parts = [raw[x:y] for x, y in zip([0, *b.tolist()], ends)]
                if whole:
                    parts = [p.decode("utf-8", "ignore").encode() for p in parts]
                out.append((len(raw), int((b - a).sum()), len(a), b"".join(parts)))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[3:]], ["id", "n_bytes", "n_removed", "n_spans", "kept", *others])

    joined = rows.join(spans, ["doc", "row"], "left").select("id", "text", "spans", *others)
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in others]
    out = joined.mapInArrow(run, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary", *kinds]))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", *[F.col(n).alias(c) for c, n in zip(keep, others)])

