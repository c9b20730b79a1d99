"""SentencePiece encoding and decoding: distinct segmentations by Gumbel top-k without replacement.

All segmentations of a text form a lattice; its backward sums turn piece weights into choices that
are normalised at each place, so a text's segmentations have probabilities that sum to 1. Giving every
segmentation its log-probability plus Gumbel noise and taking the ``k`` largest samples ``k`` of them
without replacement. A perturbed best-first (A-star) search finds them without listing the rest: a
region (a prefix, with some next pieces excluded) knows its exact mass and so the exact law of the
largest value in it. The best region gives a segmentation; what is left of it falls apart into one
region per place where another piece could have come. The value of the best region left after ``k``
is the threshold of the inclusion scores, 1 - exp(-exp(log_prob - threshold)).

No piece crosses the start of a word, so lattices are kept per word and shared by all texts of a task,
up to ``UNITS`` of them; draws of all texts in a lot run as numpy steps. Every draw hashes the row key,
the sample and the place, so results do not depend on batches, partitions or reruns.

Unigram models give log-probabilities; scores of BPE models are ranks, and weigh as a Zipf law,
-log(2 + rank). ``sharpness`` multiplies the log-weights.

Defined results: null and empty texts have one segmentation, the empty one (log_prob 0, inclusion 1); a
text with fewer than ``k`` segmentations gives all, each with inclusion 1; repeated rows give equal
samples; a null id is a key like others. Characters without a piece become byte pieces (or the unknown
piece where the model has none). Columns beyond id and text are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
#: Edges of word lattices that a task keeps, characters of a block of new words and of a lot of texts. They bound a
#: worker's memory and change no result; larger ones were slower, as their arrays leave the cache.
EDGES = 1_000_000
BLOCK = 1 << 16
LOT = 1 << 18
GATHER = 1 << 14
_U = np.uint64
_ALL = (1 << 64) - 1


class PieceModel:
    """Pieces of a model file: ids, log-weights, surfaces, and a trie over code points in an open-addressing table."""

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        # Ranks are whole numbers that count down; log-probabilities are not.
        ranked = all(float(scores[i]).is_integer() for i in plain[:2000])
        weigh = (lambda s: -math.log(2.0 + min(-s, n))) if ranked else float
        self.ids = {names[i]: i for i in plain}
        self.weights = {names[i]: sharpness * weigh(scores[i]) for i in plain}
        self.unknown = sp.unk_id()
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.low = sharpness * -math.log(2.0 + n)
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.surface: list[bytes] = [names[i].replace(MARK, " ").encode() if names[i] in self.ids else b"" for i in range(n)]
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        self.surface[self.unknown] = " ⁇ ".encode()
        self.blob = np.frombuffer(b"".join(self.surface), np.uint8)
        self.sizes = np.array([len(x) for x in self.surface], np.int32)
        self.offsets = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        #: Piece of an ASCII character without one of its own; -1 marks the others, see ``Lattices``.
        self.bare = np.array([self.bytes.get(c, self.unknown) for c in range(128)] + [-1], np.int32)
        self._trie()

    def _trie(self) -> None:
        steps: dict[int, int] = {}
        piece, weight = [-1], [0.0]
        for name, i in self.ids.items():
            state = 0
            for c in name:
                key = state << 21 | ord(c)
                if key not in steps:
                    steps[key] = len(piece)
                    piece.append(-1)
                    weight.append(0.0)
                state = steps[key]
            piece[state], weight[state] = i, self.weights[name]
        self.piece, self.weight = np.array(piece, np.int32), np.array(weight)
        self.shift = _U(64 - max(4, (4 * len(steps)).bit_length()))
        self.roots = np.full(1 << 16, -1, np.int32)
        for key, state in steps.items():
            if key < 1 << 16:
                self.roots[key] = state
        self.keys, self.next = np.full(1 << (64 - int(self.shift)), -1, np.int64), np.zeros(1 << (64 - int(self.shift)), np.int32)
        for key, state in steps.items():
            at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.next[at] = key, state

    def follow(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next trie states, -1 where no piece goes on like that."""
        key = state.astype(np.int64) << 21 | char
        at = (key.astype(np.uint64) * _U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        rows = np.arange(len(key))
        while len(rows):
            found = self.keys[at]
            hit = found == key
            out[rows[hit]] = self.next[at[hit]]
            on = ~hit & (found >= 0)
            rows, key, at = rows[on], key[on], (at[on] + 1) % len(self.keys)
        return out

    def byte_pieces(self, char: int) -> list[int]:
        """Pieces of a character without one of its own."""
        raw = chr(char).encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]

    def decode(self, ids: list[int]) -> str:
        """Text of an encoding; the space put before the first word goes."""
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """Texts of many encodings: bytes are gathered in numpy, in lots that stay in the cache."""
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        out: list = []
        row = at = 0
        bounds = np.cumsum(counts)
        while row < len(counts):
            to = max(row + 1, int(np.searchsorted(bounds, at + GATHER, side="right")))
            part = ids[at : int(bounds[to - 1])]
            sizes = self.sizes[part]
            ends = np.zeros(len(part) + 1, np.int32)
            np.cumsum(sizes, out=ends[1:])
            where = np.arange(ends[-1], dtype=np.int32)
            where += np.repeat(self.offsets[part] - ends[:-1], sizes)
            raw = self.blob[where].tobytes()
            cut = ends[np.r_[at, bounds[row:to]] - at].tolist()
            # the space put before the first word goes
            out += [raw[a + 1 : b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]
            row, at = to, int(bounds[to - 1])
        return pc.if_else(lists.is_valid(), pa.array(out, pa.string()), pa.scalar(None, pa.string()))

@lru_cache(maxsize=2)
def piece_model(path: str, sharpness: float = 1.0) -> PieceModel:
    """One model per worker process."""
    return PieceModel(path, sharpness)


class Lattices:
    """Lattices of words in flat arrays. Node: first edge and number of edges; edge: cumulative and log-probability, next node (-1 at the end), piece.

    A negative piece stands for the character -piece - 1, which has none.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if model.cuts else r"(?s).+").findall
        self.nodes = _Grown(np.int32, np.int32)
        self.edges = _Grown(np.float64, np.float64, np.int32, np.int32)
        self.reset()

    def reset(self) -> None:
        self.start: dict[str, int] = {}
        self.nodes.size = self.edges.size = 0

    def units(self, text: str) -> list[str]:
        """Words of a text with the mark before them; runs of marks stay together."""
        if not text:
            return []
        if self.model.cuts and "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
            return (MARK + text.replace(" ", " " + MARK)).split(" ")
        return self.split(MARK + text.replace(" ", MARK))

    def learn(self, units: list[str]) -> None:
        """Build the lattices of units that are not there yet, in blocks of bounded size."""
        block, held = [], 0
        for unit in set(units) - self.start.keys():
            block.append(unit)
            held += len(unit)
            if held > BLOCK:
                self.build(block)
                block, held = [], 0
        if block:
            self.build(block)

    def build(self, units: list[str]) -> None:
        model = self.model
        size = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n, unit = len(chars), np.repeat(np.arange(len(size)), size)
        end = np.cumsum(size)[unit]
        # All pieces at all places: trie states advance together, and few live on after some characters.
        at, state, length = np.arange(n), np.zeros(n, np.int32), 0
        found = []
        while len(at):
            char = chars[at + length]
            state = model.roots[char] if not length and n and int(chars.max()) < 1 << 16 else model.follow(state, char)
            length += 1
            on = state >= 0
            at, state = at[on], state[on]
            is_piece = model.piece[state] >= 0
            found.append((at[is_piece], length, model.piece[state[is_piece]], model.weight[state[is_piece]]))
            on = at + length < end[at]
            at, state = at[on], state[on]
        bare = np.ones(n, bool)
        bare[found[0][0]] = False
        bare = np.flatnonzero(bare)
        n_bytes = 1 + (chars[bare] > 0x7F).astype(np.int64) + (chars[bare] > 0x7FF) + (chars[bare] > 0xFFFF) if model.bytes else np.ones(len(bare), np.int64)
        found.append((bare, 1, model.bare[np.minimum(chars[bare], 128)] - np.where(chars[bare] < 128, 0, chars[bare]).astype(np.int32), model.low * n_bytes))
        # Edges lie by place, from the last place of all units to the first, long pieces first: counted, then filled in.
        counts = np.zeros(n, np.int64)
        for places, _, _, _ in found:
            counts[places] += 1
        level = end - np.arange(n)
        order = np.argsort(level.astype(np.int16) if int(level.max()) < 1 << 15 else level, kind="stable")
        counts, level = counts[order], level[order]
        group = np.cumsum(counts) - counts
        fill = np.empty(n, np.int64)
        fill[order] = group + counts - 1
        total = int(counts.sum())
        src, step, piece, weight = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total)
        for places, length, pieces, weights in found:
            slot = fill[places]
            src[slot], step[slot], piece[slot], weight[slot] = places, length, pieces, weights
            fill[places] = slot - 1
        cell = src + unit[src]
        mass = np.zeros(n + len(size))
        # Backward sums; each unit has a cell of its own for its end.
        cuts = np.searchsorted(level, np.arange(1, int(level[-1]) + 2)).tolist()
        logp = np.empty(len(src))
        bounds = np.append(group, len(src)).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            a, b = bounds[lo], bounds[hi]
            part = weight[a:b] + mass[cell[a:b] + step[a:b]]
            total = np.logaddexp.reduceat(part, group[lo:hi] - a)
            mass[cell[group[lo:hi]]] = total
            logp[a:b] = part - np.repeat(total, counts[lo:hi])
        np.minimum(logp, 0.0, out=logp)
        cum, left, sizes = np.exp(logp), group, counts
        for rank in range(1, int(counts.max())):
            keep = sizes > rank
            left, sizes = left[keep], sizes[keep]
            cum[left + rank] += cum[left + rank - 1]
        cum[group + counts - 1] = 2.0
        base, offset = self.nodes.size, self.edges.size
        first, number = np.empty(n, np.int64), np.empty(n, np.int64)
        first[src[group]], number[src[group]] = group + offset, counts
        self.nodes.extend(first, number)
        self.edges.extend(cum, logp, np.where(src + step < end[src], base + src + step, -1), piece)
        self.start.update(zip(units, (base + np.cumsum(size) - size).tolist()))

    def draw(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walk each unit from its node to its end; returns the edges, unit after unit, and how many each has."""
        first, _ = self.nodes.columns
        cum, _, after, _ = self.edges.columns
        counts = np.zeros(len(node), np.int64)
        steps = []
        rows, at, step = np.flatnonzero(node >= 0), node[node >= 0], 0
        while len(rows):
            u = uniform(key[rows] + _U(step))
            edge = first[at]
            far = np.flatnonzero(u > cum[edge])
            while len(far):
                edge[far] += 1
                far = far[u[far] > cum[edge[far]]]
            steps.append((rows, edge))
            counts[rows] += 1
            at = after[edge]
            on = at >= 0
            rows, at, step = rows[on], at[on], step + 1
        offset = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for s, (rows, edge) in enumerate(steps):
            out[offset[rows] + s] = edge
        return out, counts


class _Grown:
    """Columns that grow by half of their size at least."""

    def __init__(self, *kinds):
        self.size = 0
        self.columns = [np.zeros(1024, k) for k in kinds]

    def extend(self, *values) -> None:
        end = self.size + len(values[0])
        if end > len(self.columns[0]):
            self.columns = [np.concatenate([c, np.zeros(end - len(c) + len(c) // 2, c.dtype)]) for c in self.columns]
        for c, v in zip(self.columns, values):
            c[self.size : end] = v
        self.size = end


def one_uniform(key: int) -> float:
    """``uniform`` of one key."""
    x = (key * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & _ALL
    x ^= x >> 31
    x = x * 0x9E3779B97F4A7C15 & _ALL
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & _ALL
    return ((x >> 11) + 0.5) / float(1 << 53)


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    x = key * _U(0xD1342543DE82EF95) + _U(0x2545F4914F6CDD1D)
    x ^= x >> _U(31)
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x >>= _U(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 1.0 / (1 << 53)
    return out


def _key(row: int, sample: int, what: int) -> int:
    return (row + sample * 0x9E3779B97F4A7C15 + what * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF


class _Search:
    """Best-first search over one text: its units, regions, and the segmentations found."""

    __slots__ = ("row", "units", "queue", "found", "now", "options")

    def __init__(self, row: int, units: np.ndarray):
        self.row, self.units, self.found = row, units, []
        # Region: (log arrival time, order, parent path, parent counts, place, excluded edges)
        self.queue = [(math.log(-math.log(one_uniform(_key(row, 0, 1)))), 0, None, None, 0, ())]


def _lot(searches: list[_Search], lattices: Lattices, k: int) -> None:
    """Find up to ``k`` segmentations of each text of a lot; each round draws for all texts at once."""
    first, n_edges = lattices.nodes.columns
    _, logp, after, _ = lattices.edges.columns
    for sample in range(k):
        active, nodes, keys, heads = [], [], [], []
        for s in searches:
            if not s.queue:
                continue
            s.now = heapq.heappop(s.queue)
            _, _, path, counts, place, excluded = s.now
            spread = np.arange(len(s.units), dtype=np.uint64) * _U(0x100000001B3)
            key = _U(_key(s.row, sample, 2)) + spread * _U(64)
            if path is None:
                head, unit, start = np.zeros(0, np.int64), 0, s.units
            else:
                ends = np.cumsum(counts)
                unit = int(np.searchsorted(ends, place, side="right"))
                inside = int(place - (ends[unit] - counts[unit]))
                edge = path[place]
                node = s.units[unit] if inside == 0 else after[path[place - 1]]
                options = [e for e in range(first[node], first[node] + n_edges[node]) if e not in excluded]
                s.options = len(options)
                weight = np.exp(logp[options])
                u = one_uniform(_key(s.row, sample, 3))
                edge = options[min(int(np.searchsorted(np.cumsum(weight), u * weight.sum(), side="right")), len(options) - 1)]
                head = np.append(path[:place], edge)
                start = s.units[unit:].copy()
                start[0] = after[edge]
                key = key[unit:]
            active.append((s, unit, len(start)))
            heads.append(head)
            nodes.append(start)
            keys.append(key)
        if not active:
            return
        edges, counts = lattices.draw(np.concatenate(nodes), np.concatenate(keys))
        piece_at, unit_at = 0, 0
        for (s, unit, n), head in zip(active, heads):
            own = counts[unit_at : unit_at + n].copy()
            total = int(own.sum())
            path = np.concatenate([head, edges[piece_at : piece_at + total]])
            unit_at, piece_at = unit_at + n, piece_at + total
            if s.now[2] is not None:
                before = s.now[3][:unit].copy()
                own[0] += len(head) - int(before.sum())
                own = np.concatenate([before, own])
            time, _, parent, _, place, excluded = s.now
            lp = logp[path]
            reach = np.cumsum(lp) - lp
            s.found.append((path, float(lp.sum()), -time))
            # What is left of the region: another piece at any place from its own on.
            with np.errstate(divide="ignore"):
                mass = (reach + np.log(-np.expm1(lp)))[place:]
            if len(mass):
                if parent is not None:
                    gone = math.fsum(math.exp(x) for x in logp[[*excluded, int(path[place])]])
                    mass[0] = reach[place] + math.log(max(1.0 - gone, 1e-300)) if s.options > 1 else -math.inf
                noise = -np.log(uniform(_U(_key(s.row, sample, 4)) + np.arange(len(mass), dtype=np.uint64)))
                with np.errstate(divide="ignore"):
                    arrive = np.logaddexp(time, np.log(noise) - mass)
                wanted = k - sample  # segmentations still to come, and the threshold
                best = [int(arrive.argmin())] if wanted == 1 else np.argpartition(arrive, wanted - 1)[:wanted].tolist() if len(arrive) > wanted else range(len(arrive))
                for i in best:
                    if arrive[i] < math.inf:
                        e = int(path[place + i])
                        heapq.heappush(s.queue, (float(arrive[i]), (sample + 1) * (1 << 40) + i, path, own, place + i, (*excluded, e) if i == 0 and parent is not None else (e,)))


class Sampler:
    """Samples texts: rows (rank, piece ids, log_prob, inclusion) per text."""

    def __init__(self, model: PieceModel, k: int, seed: int):
        self.lattices, self.k, self.seed = Lattices(model), k, seed

    def __call__(self, keys: list, texts: list[str]) -> list[list[tuple[np.ndarray, float, float]]]:
        lattices = self.lattices
        if lattices.edges.size > EDGES:
            lattices.reset()
        split = [lattices.units(text) for text in texts]
        flat = [u for units in split for u in units]
        lattices.learn(flat)
        starts = np.fromiter(map(lattices.start.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum([len(units) for units in split]).tolist()
        searches = [
            _Search(xxhash.xxh3_64_intdigest(str(key).encode(), self.seed), starts[lo:hi]) for key, lo, hi in zip(keys, [0, *ends], ends)
        ]
        _lot(searches, lattices, self.k)
        return [self.rows(s) for s in searches]

    def rows(self, s: _Search) -> list[tuple[np.ndarray, float, float]]:
        piece = self.lattices.edges.columns[3]
        out = []
        cut = -s.queue[0][0] if s.queue else -math.inf
        for path, log_prob, _ in s.found:
            ids = piece[path]
            if (ids < 0).any():
                ids = np.array([y for x in ids.tolist() for y in ((x,) if x >= 0 else self.lattices.model.byte_pieces(-x - 1))], np.int64)
            inclusion = 1.0 if cut == -math.inf else -math.expm1(-math.exp(min(log_prob - cut, 700.0)))
            out.append((ids.astype(np.int32), log_prob, inclusion))
        return out


def sample_encodings(docs: DataFrame, path: str, k: int = 2, sharpness: float = 1.0, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, rank (from 1), ids (array), log_prob, inclusion: up to ``k`` distinct segmentations per row. ``path``: a .model file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(piece_model(path, sharpness), k, seed)

        def lot(ids, keys, texts):
            rows = sampler(keys, texts)
            flat = [(i, rank + 1, *r) for i, found in zip(ids, rows) for rank, r in enumerate(found)]
            offsets = np.cumsum([0, *(len(r[2]) for r in flat)]).astype(np.int32)
            values = np.concatenate([r[2] for r in flat]) if flat else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in flat], kind), pa.array([r[1] for r in flat], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array([r[3] for r in flat], pa.float64()), pa.array([r[4] for r in flat], pa.float64())],
                ["id", "rank", "ids", "log_prob", "inclusion"],
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            ids, texts, held = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_py()
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held > LOT:
                    yield lot(ids, ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield lot(ids, ids, texts)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, rank int, ids array<int>, log_prob double, inclusion double")
    return out.withColumnRenamed("id", id_col)


def decode(encodings: DataFrame, path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """``keep`` columns and the decoded text of each row; null ids give a null text."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], model.decode_lists(batch.column(len(names)))], [*names, "text"])

    rows = encodings.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(ids_col).alias("ids"))
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    out = rows.mapInArrow(run, ", ".join([*kinds, "text string"]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "text")


def decoded_digest(encodings: DataFrame, path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """``keep`` columns, the number of pieces, a hash of the ids, and length and crc32 of the decoded UTF-8 bytes."""
    ids = F.col(ids_col)
    text = decode(encodings.withColumn("n_pieces", F.size(ids)).withColumn("ids_hash", F.xxhash64(ids)), path, [*keep, "n_pieces", "ids_hash"], ids_col)
    return text.select(*keep, "n_pieces", "ids_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc"))
