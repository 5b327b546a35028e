"""Cross-tokenizer alignment with corpus-wide pair counts behind minimal perfect hashes.

Two tokenizers encode a text; byte offsets where a token of each ends cut both
token sequences into groups, and within a group every A token is linked with
every B token.  How many documents hold an id pair linked is counted over the
whole corpus, and every document is scored by the counts of its own links.

1. First pass: documents are encoded and aligned; their tokens are written, and
   each task counts, per id pair, its documents (sorted runs).
2. The distinct pairs are dealt to shards by a hash; a task builds a minimal
   perfect hash of each of its shards (levels of bit arrays: a key whose bit
   nobody else wants is placed, the others go one level down) and writes it
   with the keys in hash order, so that every lookup verifies its key.
3. The runs become dense count vectors, indexed by the hash; the vectors of
   a shard are summed up a tree with ``FAN`` children a node.
4. Second pass: the tokens are aligned again, pairs are looked up.  A worker
   holds at most ``KEEP_SHARDS`` bytes of shards and reads others when needed,
   so the pair table may have any size.  The highest count of each A id is a
   vector as long as the vocabulary, which bounds what is broadcast.

Defined cases: texts that are null, empty, or whose tokens don't give back
space + text have no tokens, groups or links (zeros and an empty digest) and
count nowhere; texts of any length are worked on whole; repeated
rows count as documents of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
from collections import OrderedDict
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm import words as W
from estimark.llm.warc import _filesystem
from estimark.session import materialize, scratch_folder

SHARD_KEYS = 1 << 18  # expected pairs of a shard
FAN = 16  # runs of a leaf vector, vectors of a sum
RUN = 1 << 20  # pairs after which a task writes a run
KEEP_SHARDS = 192 << 20
BATCH_CHARS = 1 << 18

LONG = 1000
_LONG = re.compile(rf"\S{{{LONG}}}|\s{{{LONG}}}")


class Tokenizers:
    """Tokenizer A (byte-level BPE, a tokenizer file) and B (a sentence-piece model that adds a space)."""

    def __init__(self, a_json: bytes, b_model: bytes, pattern: str):
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = json.loads(a_json)
        plain = _byte_of_char()
        vocab = {t: i for t, i in model["model"]["vocab"].items() if all(c in plain for c in t)}
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        ranks = {bytes(plain[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.n_a = max([*model["model"]["vocab"].values(), *special.values()]) + 1
        self.a_bytes = [b""] * self.n_a
        for t, i in ranks.items():
            self.a_bytes[i] = t
        # ids are merge ranks, so the same merges can run on the ranks alone
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        order = [model["model"]["vocab"][x + y] for x, y in pairs]
        if order != sorted(order) or any(ranks.get(bytes([i]), 256) > 255 for i in range(256)):
            raise ValueError("tokenizer A's ids don't follow its merges")
        self._a = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._a_json, self._a_long = a_json.decode(), None
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.n_b = self._b.get_piece_size()
        form = proto.ModelProto.FromString(b_model)
        # pieces then spell space + text, unless the text holds the space's own mark or a character without a piece
        self.plain_b = (form.normalizer_spec.add_dummy_prefix and form.normalizer_spec.escape_whitespaces and not (
            form.normalizer_spec.precompiled_charsmap or form.normalizer_spec.remove_extra_whitespaces
            or form.trainer_spec.treat_whitespace_as_suffix))
        self.unknown = self._b.unk_id()
        self.b_bytes = []
        for i in range(self.n_b):
            p = self._b.id_to_piece(i)
            if self._b.is_byte(i):
                self.b_bytes.append(bytes([int(p[3:-1], 16)]))
            else:
                self.b_bytes.append(p.replace("▁", " ").encode())
        self.a_len = np.array([len(t) for t in self.a_bytes])
        self.b_len = np.array([len(t) for t in self.b_bytes])
        if max(self.n_a, self.n_b) > 1 << 16:
            raise ValueError("ids are stored as 16 bits")
        # decimal ids with what follows them inside a group (0) and at the end of the group's part (1)
        self.a_text, self.b_text = np.empty((2, self.n_a), object), np.empty((2, self.n_b), object)
        for text, end in ((self.a_text, b"|"), (self.b_text, b";")):
            for i in range(text.shape[1]):
                text[0, i], text[1, i] = b"%d," % i, b"%d" % i + end

    def a(self, text: str) -> list[int]:
        return self._a.encode_ordinary(" " + text)

    def a_long(self, text: str) -> list[int]:
        """The same for texts with very long runs without a break: their merges need a heap."""
        if self._a_long is None:
            from tokenizers import Tokenizer

            self._a_long = Tokenizer.from_str(self._a_json)
            self._a_long.encode_special_tokens = True
        return self._a_long.encode(" " + text, add_special_tokens=False).ids

    def b(self, texts: list[str]) -> list[list[int]]:
        return self._b.encode(texts, num_threads=1)  # adds the space itself


def _byte_of_char() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write for it: printable bytes stand for themselves, the
    others, in order, for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _align(tok: Tokenizers, a: np.ndarray, b: np.ndarray) -> tuple:
    """(byte offset where each group ends, A tokens' groups, B tokens' groups, A tokens a group, B tokens a group) of two
    token sequences over the same bytes."""
    a_end, b_end = np.cumsum(tok.a_len[a]), np.cumsum(tok.b_len[b])
    mark = np.zeros(int(a_end[-1]) + 1 if len(a) else 1, np.int8)
    mark[a_end] = 1
    mark[b_end] += 2
    ends = np.flatnonzero(mark == 3)
    group = np.cumsum(mark == 3, dtype=np.int64)
    a_group, b_group = group[a_end - 1], group[b_end - 1]
    return ends, a_group, b_group, np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))


def _linked(tok: Tokenizers, a, b, a_group, b_group, in_a, in_b):
    """Yields (group, pair code, times linked); a pair may come several times in a group."""
    small = in_a * in_b <= 4096
    take = small[a_group]
    each = in_b[a_group[take]]
    b_first = (np.cumsum(in_b) - in_b)[a_group[take]]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - b_first, each)
    yield np.repeat(a_group[take], each), np.repeat(a[take], each) * tok.n_b + b[at], None
    if not small.all():
        for g in np.flatnonzero(~small):  # long groups: by distinct ids
            x, nx = np.unique(a[np.searchsorted(a_group, g):np.searchsorted(a_group, g, "right")], return_counts=True)
            y, ny = np.unique(b[np.searchsorted(b_group, g):np.searchsorted(b_group, g, "right")], return_counts=True)
            for i in range(0, len(x), 256):
                code = (x[i:i + 256, None] * tok.n_b + y).ravel()
                yield np.full(len(code), g), code, (nx[i:i + 256, None] * ny).ravel()


class Aligned:
    """Texts with their tokens: per text whether it has any, the four counts, the group text and the tokens."""

    def __init__(self, tok: Tokenizers, texts: list[str]):
        n = len(texts)
        data = [(" " + t).encode() if t else b"" for t in texts]
        breaks = np.flatnonzero(np.diff(W.SPACE[np.frombuffer(b"".join(data) + b"a ", np.uint8)]))
        if np.diff(breaks, prepend=-1).max() > LONG:
            a = [(tok.a_long if _LONG.search(t) else tok.a)(t) if t else [] for t in texts]
        else:
            a = [tok.a(t) if t else [] for t in texts]
        b = tok.b(texts)
        self.ok = np.array([bool(t) for t in texts])
        if not tok.plain_b or any("▁" in t for t in texts) or any(tok.unknown in x for x in b):
            for i, x in enumerate(data):
                self.ok[i] &= b"".join(map(tok.b_bytes.__getitem__, b[i])) == x
        for i in np.flatnonzero(~self.ok).tolist():
            a[i], b[i], data[i] = [], [], b""
        self.tok = tok
        self.a = np.fromiter(chain.from_iterable(a), np.int64, sum(map(len, a)))
        self.b = np.fromiter(chain.from_iterable(b), np.int64, sum(map(len, b)))
        if tok.a_len[self.a].sum() != sum(map(len, data)) or tok.b_len[self.b].sum() != sum(map(len, data)):
            raise ValueError("tokens don't spell the texts")
        ends, a_group, b_group, in_a, in_b = self.groups = _align(tok, self.a, self.b)
        last = np.searchsorted(ends, np.cumsum(list(map(len, data))), "right")  # groups up to the end of a text
        total = np.cumsum(np.stack([in_a, in_b, np.ones_like(in_a), in_a * in_b], 1), 0)
        total = np.concatenate((np.zeros((1, 4), np.int64), total))[last]
        self.sums = np.diff(total, axis=0, prepend=0)
        self.text_of = np.repeat(np.arange(n), np.diff(last, prepend=0))  # of a group
        a_data, b_data = self.a.astype("<u2").tobytes(), self.b.astype("<u2").tobytes()
        cut = lambda held, at, width: [held[width * x:width * y] for x, y in zip([0] + at, at)]
        self.a_ids, self.b_ids = cut(a_data, total[:, 0].tolist(), 2), cut(b_data, total[:, 1].tolist(), 2)
        self.group_text = [b"".join(x)[:-1] for x in cut(self._texts(*self.groups[1:]), (total[:, 0] + total[:, 1]).tolist(), 1)]

    def _texts(self, a_group, b_group, in_a, in_b) -> list[bytes]:
        """`a1,` `a2|` `b1;` ... in the order of the groups."""
        out = np.empty(len(self.a) + len(self.b), object)
        a_last, b_last = np.zeros(len(self.a), np.int8), np.zeros(len(self.b), np.int8)
        a_last[np.cumsum(in_a) - 1] = 1
        b_last[np.cumsum(in_b) - 1] = 1
        out[np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[a_group]] = self.tok.a_text[a_last, self.a]
        out[np.arange(len(self.b)) + np.cumsum(in_a)[b_group]] = self.tok.b_text[b_last, self.b]
        return out.tolist()

    def pairs(self) -> np.ndarray:
        """The pair code of every pair that a text holds linked, once a text."""
        width = np.int64(self.tok.n_a) * self.tok.n_b
        found = [pd.unique(self.text_of[g] * width + code) for g, code, _ in _linked(self.tok, self.a, self.b, *self.groups[1:])]
        return (found[0] if len(found) == 1 else pd.unique(np.concatenate(found))) % width


def _spread(code: np.ndarray) -> np.ndarray:
    """16 bits that deal pairs to shards."""
    return (W.mix(code.astype(np.uint64)) >> np.uint64(48)).astype(np.int32)


class PerfectHash:
    """Minimal perfect hash of distinct pairs: levels of bit arrays, and the rank of the set bit as the index."""

    def __init__(self, words: list[np.ndarray], sizes: list[int]):
        self.words, self.sizes = words, sizes
        ones = [np.bitwise_count(w).astype(np.int64) for w in words]
        total = np.concatenate([[0], np.cumsum([o.sum() for o in ones])]).astype(np.int64)
        self.before = [total[i] + np.concatenate(([0], np.cumsum(o)[:-1])) for i, o in enumerate(ones)]
        self.n = int(total[-1])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        return (W.mix(W.mix(keys.astype(np.uint64) ^ salt)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        words, sizes, level = [], [], 0
        while len(keys):
            size = max(64, -(-2 * len(keys) // 64) * 64)
            place = cls._place(keys, level, size)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys, level = keys[~alone[place]], level + 1
        return cls(words, sizes)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; any number or -1 for keys that were not given."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (w, size, before) in enumerate(zip(self.words, self.sizes, self.before)):
            if not len(left):
                break
            place = self._place(keys[left], level, size)
            word, bit = w[place >> 6], np.uint64(1) << (place & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[left[hit]] = before[place[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1))).astype(np.int64)
            left = left[~hit]
        return out


def _write(folder: str, **arrays) -> str:
    """Store arrays under a name of this attempt; only reported names are read."""
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    name, held = uuid.uuid4().hex, io.BytesIO()
    np.savez(held, **arrays)
    with fs.open_output_stream(f"{base}/{name}") as out:
        out.write(held.getbuffer())
    return name


def _read(folder: str, name: str) -> dict:
    fs, base = _filesystem(folder)
    with fs.open_input_stream(f"{base}/{name}") as f:
        return dict(np.load(io.BytesIO(f.read())))


def _hash_of(arrays: dict) -> PerfectHash:
    sizes = arrays["sizes"].tolist()
    cut = np.cumsum([0] + [s // 64 for s in sizes])
    return PerfectHash([arrays["words"][cut[i]:cut[i + 1]] for i in range(len(sizes))], sizes)


class Counts:
    """Counts of pairs, read shard by shard from the shared folder."""

    def __init__(self, folder: str, hashes: list[str], vectors: list[str], highest: np.ndarray):
        self.folder, self.hashes, self.vectors, self.highest = folder, hashes, vectors, highest
        self.held: OrderedDict[int, tuple] = OrderedDict()
        self.bytes = 0

    def shard(self, s: int) -> tuple:
        if s not in self.held:
            a = _read(self.folder, self.hashes[s])
            got = (_hash_of(a), a["keys"], _read(self.folder, self.vectors[s])["n"])
            size = 17 * len(a["keys"])
            while self.held and self.bytes + size > KEEP_SHARDS:
                self.bytes -= 17 * len(self.held.popitem(last=False)[1][1])
            self.held[s] = got
            self.bytes += size
        self.held.move_to_end(s)
        return self.held[s]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The counts of distinct pair codes; every key is verified."""
        out = np.zeros(len(codes), np.int64)
        shard = _spread(codes) % len(self.hashes)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(len(self.hashes) + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            rows = order[cut[s]:cut[s + 1]]
            h, keys, n = self.shard(s)
            at = h.index(codes[rows])
            if (at < 0).any() or (keys[at] != codes[rows]).any():
                raise ValueError("a pair is not in the hash of its shard")
            out[rows] = n[at]
        return out


_HELD: dict[str, Tokenizers] = {}
_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _text_batches(batches):
    """(record batch, first row, texts) of about BATCH_CHARS characters."""
    for b in batches:
        texts, first, size = [], 0, 0
        for i, t in enumerate(b.column(1)):
            t = t.as_py() or ""
            texts.append(t)
            size += len(t)
            if size >= BATCH_CHARS:
                yield b, first, texts
                texts, first, size = [], i + 1, 0
        if texts:
            yield b, first, texts


class CrossTokens:
    """Alignment of two tokenizers over a corpus.

    ``a_path`` and ``b_path`` are files on the driver; their bytes (a few MB, fixed) are broadcast.  ``groups`` adds
    the groups themselves, as `a1,a2|b1;a3|b2,b3`, to the result."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, pattern: str, key: str = "doc_id", text: str = "text",
                 groups: bool = False):
        self.spark, self.key, self.groups = docs.sparkSession, key, groups
        self.rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
        self.kind = docs.schema[key].dataType.simpleString()
        with open(a_path, "rb") as fa, open(b_path, "rb") as fb:
            a, b = fa.read(), fb.read()
        name = hashlib.sha256(a + b + pattern.encode()).hexdigest()
        files = self.spark.sparkContext.broadcast((a, b))

        def tokenizers() -> Tokenizers:
            if name not in _HELD:
                _HELD[name] = Tokenizers(*files.value, pattern)
            return _HELD[name]

        self.tokenizers = tokenizers
        self.n_b = Tokenizers(a, b, pattern).n_b
        self.folder = scratch_folder(self.spark, "pairs")

    def first_pass(self) -> DataFrame:
        """Rows of two kinds, written to the shared folder: documents with what their own alignment tells and their
        tokens (16 bits an id), and sorted runs (spread, code, n) of how many of a task's documents hold a pair."""
        tokenizers, with_groups = self.tokenizers, self.groups

        def run(batches):
            codes, counts, held, kind = [], [], 0, None

            def merged():
                code, n = np.concatenate(codes), np.concatenate(counts)
                order = np.argsort(code, kind="stable")
                code, n = code[order], n[order]
                first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                return code[first], np.add.reduceat(n, first)

            def rows(count, **cols):
                return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(count, f.type)) for f in kind], schema=kind)

            def sorted_run():
                code, n = merged()
                for i in range(0, len(code), 1 << 16):
                    c = code[i:i + (1 << 16)]
                    yield rows(len(c), spread=pa.array(_spread(c)), code=pa.array(c), n=pa.array(n[i:i + (1 << 16)]))

            for b, first, texts in _text_batches(batches):
                kind = kind or pa.schema([("__key", b.schema.field(0).type), *((c, pa.int64()) for c in _COUNTS[:4]),
                                          ("groups_sha256", pa.string()), ("groups", pa.string()), ("a", pa.binary()),
                                          ("b", pa.binary()), ("spread", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])
                got = Aligned(tokenizers(), texts)
                yield rows(len(texts), __key=b.column(0).slice(first, len(texts)),
                           **{c: pa.array(got.sums[:, i]) for i, c in enumerate(_COUNTS[:4])},
                           groups_sha256=pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in got.group_text], pa.string()),
                           groups=pa.array([g.decode() if with_groups else None for g in got.group_text], pa.string()),
                           a=pa.array(got.a_ids, pa.binary()), b=pa.array(got.b_ids, pa.binary()))
                back, code = pd.factorize(got.pairs())
                if len(code):
                    codes.append(code)
                    counts.append(np.bincount(back))
                    held += len(code)
                if held >= 2 * RUN:
                    code, n = merged()
                    codes, counts, held = [code], [n], len(code)
                    if held >= RUN:
                        yield from sorted_run()
                        codes, counts, held = [], [], 0
            if codes:
                yield from sorted_run()

        schema = (f"__key {self.kind}, " + ", ".join(f"{c} long" for c in _COUNTS[:4])
                  + ", groups_sha256 string, groups string, a binary, b binary, spread int, code long, n long")
        return materialize(W.map_batches(self.rows, run, schema).withColumn("task", F.spark_partition_id()))

    @staticmethod
    def runs(first_pass: DataFrame) -> DataFrame:
        return first_pass.filter("code IS NOT NULL").select("task", "spread", "code", "n")

    def hashes(self, runs: DataFrame) -> list[str]:
        """A minimal perfect hash for each shard of the distinct pairs: file names by shard."""
        folder = self.folder
        keys = materialize(runs.select("spread", "code").distinct())
        shards = max(1, min(1 << 16, -(-keys.count() // SHARD_KEYS)))

        def run(batches):
            now, held = None, []

            def built():
                code = np.concatenate(held)
                h = PerfectHash.build(code)
                in_order = np.empty(len(code), np.int64)
                in_order[h.index(code)] = code
                name = _write(folder, words=np.concatenate(h.words), sizes=np.array(h.sizes), keys=in_order)
                return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "name": [name]})

            for b in batches:
                shard, code = b.column(0).to_numpy(), b.column(1).to_numpy()
                cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for i, j in zip(cut, cut[1:]):
                    if i < j:
                        if held and shard[i] != now:
                            yield built()
                            held = []
                        now = int(shard[i])
                        held.append(code[i:j])
            if held:
                yield built()

        by_shard = keys.select(F.pmod("spread", F.lit(shards)).alias("shard"), "code")
        by_shard = by_shard.repartition("shard").sortWithinPartitions("shard")
        names = [""] * shards  # a name a shard; shards are bounded by the two vocabularies
        for r in materialize(W.map_batches(by_shard, run, "shard int, name string")).collect():
            names[r["shard"]] = r["name"]
        return names

    def vectors(self, runs: DataFrame, hashes: list[str]) -> list[str]:
        """Dense count vectors by shard, summed up a tree: file names by shard."""
        folder, shards = self.folder, len(hashes)

        def leaf(batches):
            now, total, h = None, None, None
            for b in batches:
                shard, node, code, n = (b.column(i).to_numpy() for i in range(4))
                cut = [0, *(np.flatnonzero(np.diff(shard) | np.diff(node)) + 1).tolist(), len(shard)]
                for i, j in zip(cut, cut[1:]):
                    if i == j:
                        continue
                    if now != (shard[i], node[i]):
                        if now is not None:
                            yield vector(now, total)
                        if now is None or now[0] != shard[i]:
                            a = _read(folder, hashes[shard[i]])
                            h, keys = _hash_of(a), a["keys"]
                        now, total = (shard[i], node[i]), np.zeros(h.n, np.int64)
                    at = h.index(code[i:j])
                    if (at < 0).any() or (keys[at] != code[i:j]).any():
                        raise ValueError("a pair is not in the hash of its shard")
                    total += np.bincount(at, n[i:j], h.n).astype(np.int64)
            if now is not None:
                yield vector(now, total)

        def vector(now, total):
            name = _write(folder, n=total)
            return pa.RecordBatch.from_pydict({"shard": pa.array([now[0]], pa.int32()), "node": pa.array([now[1]], pa.int32()),
                                               "name": [name]})

        def add(batches):
            now, total = None, None
            for b in batches:
                for shard, node, name in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if now != (shard, node):
                        if now is not None:
                            yield vector(now, total)
                        now, total = (shard, node), 0
                    total = total + _read(folder, name)["n"]
            if now is not None:
                yield vector(now, total)

        schema = "shard int, node int, name string"
        up = lambda df: (df.select("shard", F.expr(f"int(node div {FAN})").alias("node"), *df.columns[2:])
                         .repartition("shard", "node").sortWithinPartitions("shard", "node"))
        rows = runs.select(F.pmod("spread", F.lit(shards)).alias("shard"), F.col("task").alias("node"), "code", "n")
        now = materialize(W.map_batches(up(rows), leaf, schema))
        while (now.agg(F.max("node")).first()[0] or 0) > 0:
            now = materialize(W.map_batches(up(now), add, schema))
        names = [""] * shards
        for r in now.collect():
            names[r["shard"]] = r["name"]
        return names

    def pair_counts(self, hashes: list[str], vectors: list[str]) -> DataFrame:
        """(a_id, b_id, n_docs) of every pair that some document holds linked."""
        folder, n_b = self.folder, self.n_b

        def run(batches):
            for b in batches:
                for s in b.column(0).to_pylist():
                    if hashes[s]:
                        keys, n = _read(folder, hashes[s])["keys"], _read(folder, vectors[s])["n"]
                        for i in range(0, len(keys), 1 << 16):
                            k = keys[i:i + (1 << 16)]
                            yield pa.RecordBatch.from_arrays([pa.array((k // n_b).astype(np.int32)), pa.array((k % n_b).astype(np.int32)),
                                                              pa.array(n[i:i + (1 << 16)])], ["a_id", "b_id", "n_docs"])

        shards = self.spark.range(0, len(hashes), 1, min(len(hashes), 10_000))
        return W.map_batches(shards, run, "a_id int, b_id int, n_docs long")

    def scored(self) -> DataFrame:
        """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every row: ``n_best``
        links have the highest count of their A id, ``count_sum`` adds the counts of all links."""
        first = self.first_pass()
        runs = self.runs(first)
        hashes = self.hashes(runs)
        vectors = self.vectors(runs, hashes)
        folder, tokenizers = self.folder, self.tokenizers
        best = self.pair_counts(hashes, vectors).groupBy("a_id").agg(F.max("n_docs").alias("n")).collect()  # a row an A id
        top = np.zeros(max([r["a_id"] for r in best], default=0) + 1, np.int64)
        for r in best:
            top[r["a_id"]] = r["n"]
        table = self.spark.sparkContext.broadcast((hashes, vectors, top))
        names = [self.key, *_COUNTS, "groups_sha256"] + ["groups"] * self.groups

        def run(batches):
            tok, counts = tokenizers(), Counts(folder, *table.value)
            for b in batches:
                a_data, a_offs = W.byte_view(b.column("a"))
                b_data, b_offs = W.byte_view(b.column("b"))
                score = np.zeros((b.num_rows, 2), np.int64)
                i = 0
                while i < b.num_rows:
                    j = max(i + 1, int(np.searchsorted(a_offs, a_offs[i] + 2 * BATCH_CHARS, "right")) - 1)
                    x = np.frombuffer(a_data[a_offs[i]:a_offs[j]].tobytes(), "<u2").astype(np.int64)
                    y = np.frombuffer(b_data[b_offs[i]:b_offs[j]].tobytes(), "<u2").astype(np.int64)
                    if len(x):
                        doc_of = np.repeat(np.arange(i, j), np.diff(a_offs[i:j + 1]) // 2)
                        _, a_group, b_group, in_a, in_b = _align(tok, x, y)
                        doc_of = doc_of[np.cumsum(in_a) - 1]  # of a group
                        for group, code, times in _linked(tok, x, y, a_group, b_group, in_a, in_b):
                            back, known = pd.factorize(code)
                            n = counts.of(known)
                            top_of = n == counts.highest[known // tok.n_b]
                            at = doc_of[group]
                            for c, value in ((0, top_of[back]), (1, n[back])):
                                value = value if times is None else value * times
                                total = np.concatenate(([0], np.cumsum(value, dtype=np.int64)))
                                cut = np.searchsorted(at, np.arange(i, j + 1))
                                score[i:j, c] += total[cut[1:]] - total[cut[:-1]]
                    i = j
                held = {c: b.column(c) for c in b.schema.names} | {"n_best": pa.array(score[:, 0]), "count_sum": pa.array(score[:, 1])}
                yield pa.RecordBatch.from_arrays([held[c] for c in names], names)

        schema = f"`{self.key}` {self.kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string"
        rows = first.filter("code IS NULL").select(F.col("__key").alias(self.key), *_COUNTS[:4], "groups_sha256", *["groups"] * self.groups, "a", "b")
        return W.map_batches(rows, run, schema + ", groups string" * self.groups)
