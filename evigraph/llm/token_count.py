"""Token counts by byte-pair merging with a heap and a linked list; no identifier is ever made.

A piece of the pre-tokeniser starts as one symbol per byte. The heap gives the adjacent pair of
lowest rank (leftmost first); the linked list joins it and offers the two new neighbour pairs. The
count is the number of symbols minus the number of merges, in O(n log n) for a piece of n bytes, so
one endless word costs no more than its length. Counts of seen pieces are kept per task up to a
fixed number of characters.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows repeat; a special
token's string inside a text is that one token, as the library does by default. Columns beyond id and
text are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from operator import methodcaller

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The word pattern and the byte alphabet of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary."""
    other = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(other)}


class PairRanks:
    """Merge ranks of a vocabulary file: (left symbol, right symbol) to (rank, joined symbol)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        number: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            joined = number.setdefault(left + right, len(number))
            self.ranks.setdefault((number[left], number[right]), (rank, joined))

    def count(self, piece: bytes) -> int:
        """Symbols left of one piece: bytes minus merges."""
        n = len(piece)
        if n < 2:
            return n
        ranks = self.ranks
        symbol, after, before = list(piece), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, piece[i], piece[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((piece[i], piece[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two was joined meanwhile
            symbol[i], symbol[j] = joined, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((joined, symbol[k])):
                    heapq.heappush(heap, (r[0], i, joined, symbol[k], r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbol[h], joined))):
                heapq.heappush(heap, (r[0], h, symbol[h], joined, r[1]))
        return left


class PieceCounts(dict):
    """Counts by piece, computed when first asked for; emptied when it holds too many characters."""

    LIMIT = 24_000_000

    def __init__(self, ranks: PairRanks):
        self.ranks, self.held = ranks, 0

    def __missing__(self, piece: str) -> int:
        n = self.ranks.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) < 256:
            if self.held > self.LIMIT:
                self.clear()
                self.held = 0
            self[piece] = n
            self.held += len(piece) + 40
        return n


class TokenCounter:
    def __init__(self, path: str):
        import regex

        self.ranks = PairRanks(path)
        self.pieces = PieceCounts(self.ranks)
        self.find = regex.compile(PATTERN).finditer
        special = sorted(self.ranks.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __call__(self, text: str) -> int:
        parts = self.cut.split(text) if self.cut else [text]
        total = len(parts) - 1
        for part in parts:
            total += sum(map(self.pieces.__getitem__, map(methodcaller("group"), self.find(part))))
        return total


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_bytes, n_tokens, over_limit for every row. ``path``: a byte-level .json vocabulary on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            counts = pa.array([counter(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
