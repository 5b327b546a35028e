"""Byte-level BPE as a monoid: encode halves, join, decode up the tree.

A text is cut into pieces by the tokenizer's pattern, and every piece is
encoded on its own.  A piece is encoded by a balanced tree: short leaves by
plain rank-ordered merging, and two neighbours by ``join``, which re-encodes a
window of tokens around the seam and lets it grow until the tokens outside
provably stay.  The proof is local: a token sequence is the encoding of its
bytes exactly when every adjacent pair of tokens encodes back to that pair,
so tokens outside the window stay once the two pairs at the window's edges
do.  ``join`` is associative, so any shape of tree gives the same tokens.

Defined cases: a null text counts as empty; empty texts have no tokens;
repeated rows and rows without doc_id are encoded like any other; an empty
table gives an empty result; texts of any length are encoded whole (the tree
over a long piece is what bounds the work on it).
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm import words as W

LEAF = 24  # bytes that a leaf merges directly
KEEP_BYTES = 24 << 20  # memory of the pieces remembered in a worker, per generation (two are held)
KEEP_PAIRS = 1 << 16
DECODE_LEAF = 4096
_NONE = 1 << 62  # rank of what is no token


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeBPE:
    """Encoder and decoder for one vocabulary and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # pieces that are one token stay; other short pieces live in two generations, each bounded by its bytes
        self._young: dict[str, bytes] = {}
        for token, rank in ranks.items():
            try:
                self._young[token.decode()] = rank.to_bytes(4, sys.byteorder)
            except UnicodeDecodeError:
                pass
        self._single, self._old, self._size = dict(self._young), {}, 0
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
        if len(piece) > 8 * LEAF:
            return self.merge_long(piece)
        rank, none = self.ranks.get, _NONE
        parts = [piece[i:i + 1] for i in range(len(piece))]
        near = [rank(piece[i:i + 2], none) for i in range(len(piece) - 1)]
        while near and (low := min(near)) < none:
            at = near.index(low)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at:
                near[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(near):
                near[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges in O(n log n): a heap of (rank, position) over a linked list of parts."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # part that begins at i ends at end[i]; 0 once merged away
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] == n or end[end[i]] != stop:
                continue  # one of the two parts has changed meanwhile
            end[end[i]], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (q := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (q, i, end[stop]))
            if i and (q := ranks.get(piece[before[i]:stop])) is not None:
                heapq.heappush(heap, (q, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def stays(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side encode to themselves."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= KEEP_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the two halves' bytes from the halves' encodings."""
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        reach = 2
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            middle = self.merge(b"".join(map(self.tokens.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.stays(left[i - 1], middle[0])) and (j == len(right) or self.stays(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            reach *= 2

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Tokens of one piece, by the tree."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.encode_bytes(piece[:half]), self.encode_bytes(piece[half:]))

    def encode(self, text: str) -> array:
        """Token ids of a whole text as unsigned 32-bit integers."""
        pieces = self.split(text)
        out = list(map(self._young.get, pieces))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self._piece(pieces[i])
        return array("I", b"".join(out))

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the young generation may not hold, as bytes."""
        ids = self._young.get(piece)
        if ids is None:
            ids = self._old.get(piece)
            if ids is None:
                ids = array("I", self.encode_bytes(piece.encode())).tobytes()
            if len(piece) <= 64:
                if self._size >= KEEP_BYTES:  # the generation before goes, this one stays within reach
                    self._old, self._young, self._size = self._young, dict(self._single), 0
                self._young[piece] = ids
                self._size += 2 * len(piece) + len(ids) + 200  # two objects and a table entry
        return ids

    def decode(self, ids) -> bytes:
        """Bytes of the ids, concatenated up a balanced tree."""
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[str, TreeBPE] = {}


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text",
                 ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) per row.

    ``vocabulary`` is the path of a rank file on the driver; its bytes (about
    1 MB, fixed) are broadcast.  The digests are over the ids as little-endian
    unsigned 32-bit integers and over the bytes decoded from them; ``ids``
    holds the token ids.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks_file = spark.sparkContext.broadcast(f.read())
    name = hashlib.sha256(ranks_file.value + pattern.encode()).hexdigest()
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if ids else ""

    def run(batches):
        codec = _CODECS.get(name)
        if codec is None:
            lines = map(bytes.split, ranks_file.value.splitlines())
            codec = _CODECS[name] = TreeBPE({base64.b64decode(a): int(b) for a, b in lines}, pattern)
        for b in batches:
            n, sha, back, out = [], [], [], []
            for t in b.column(1):
                got = codec.encode(t.as_py())
                if sys.byteorder == "big":
                    got.byteswap()
                n.append(len(got))
                sha.append(hashlib.sha256(got.tobytes()).hexdigest())
                if sys.byteorder == "big":
                    got.byteswap()
                back.append(hashlib.sha256(codec.decode(got)).hexdigest())
                if ids:
                    out.append(got)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                flat = pa.array(np.frombuffer(b"".join(x.tobytes() for x in out), np.uint32).astype(np.int32))
                offs = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offs), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return W.map_batches(rows, run, schema)
