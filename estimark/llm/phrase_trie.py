"""Phrase collocations, counted in HAT-tries of word ids.

A word id is a 64-bit hash of language and word.  Each task counts phrases in
a HAT-trie: inner nodes lead from word to word and stay few, their children are
containers, hash-keyed tables that hold all phrases of a range of next words.
A container that grows beyond ``BURST`` phrases bursts: it splits at its middle
word, or, when all its phrases share that word, becomes a node one word deeper.
When a task holds more than ``HELD`` phrases, its largest subtrees are spilled
whole, as runs sorted by word ids.  Runs are merged by prefix partition: the
first two words of a phrase say where its counts are added up.

Phrases of k words are counted in pass k (single words and pairs by key, to be
spelt in the next pass if they are frequent), and only where both phrases of k - 1
words inside are frequent: a phrase is at least as rare as its parts, so no
frequent phrase is lost.  The frequent phrases of a pass reach the next one as
a bitmap of at most ``BITS`` bits; what it lets through by chance is counted
and then fails the threshold.  Counts, scores and ranks are exact, up to
equal 64-bit hashes of different words.

Defined cases: a null language is ``und``, a null or empty text has no words;
texts of any length are counted whole; repeated rows count again; ties in
score are ranked by count, then by the phrase's bytes; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estimark.llm import words as W
from estimark.session import materialize

BURST = 1 << 15  # phrases of a container
HELD = 1 << 20  # phrases of a task's trie
BITS = 1 << 27  # of the bitmap of frequent phrases, at most
GATHER = 1 << 18  # phrase occurrences put into the trie at once

_KIND = np.zeros(256, np.uint8)  # 0 word, 1 space, 2 break
_KIND[[0x20, 9]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


def cut_pieces(data: np.ndarray, offs: np.ndarray) -> tuple[W.Slice, np.ndarray]:
    """The words of a slice, and the number of the piece each one stands in."""
    n = len(data)
    kind = _KIND[data]
    word = kind == 0
    first = np.zeros(n + 1, bool)  # where a text begins
    first[offs[:-1]] = True
    starts = np.flatnonzero(word & (first[:n] | ~np.concatenate(([False], word[:-1]))[:n]))
    last = np.zeros(n + 1, bool)
    last[offs[1:]] = True
    ends = np.flatnonzero(word & (last[1:] | ~np.concatenate((word[1:], [False]))[:n])) + 1
    s = W.Slice(0, data, offs, starts, ends, np.searchsorted(starts, offs))
    if not len(starts):
        return s, np.empty(0, np.int64)
    breaks = np.concatenate(([0], np.cumsum(kind == 2)))
    doc = s.word_doc()
    new = np.concatenate(([True], (breaks[starts[1:]] > breaks[ends[:-1]]) | (doc[1:] != doc[:-1])))
    return s, np.cumsum(new)


def _merged(parts: list[tuple]) -> tuple:
    """Entries (key, words, n, label) with one row a key; only single words have labels."""
    key, words, n, label = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    one = order[first]
    return key[first], words[one], np.add.reduceat(n[order], first), label[one] if len(label) else label


class Container:
    """Phrases of a range of words at ``depth``: a table by phrase key, new entries waiting beside it."""

    def __init__(self, depth: int):
        self.depth, self.waiting, self.n = depth, [], 0  # waiting[0] is the table once compacted

    def insert(self, entries: tuple) -> None:
        self.waiting.append(entries)
        self.n += len(entries[0])

    def compact(self) -> None:
        if len(self.waiting) > 1:
            self.waiting = [_merged(self.waiting)]
            self.n = len(self.waiting[0][0])

    def take(self, rows) -> tuple:
        return tuple(x[rows] if len(x) else x for x in self.waiting[0])

    def burst(self) -> list[tuple[int, "Container | Node"]]:
        """(lowest word, child) of what takes the container's place; itself if it can't burst."""
        at = self.waiting[0][1][:, self.depth]
        words = np.unique(at)
        if len(words) > 1:
            middle = words[len(words) // 2]
            low, high = Container(self.depth), Container(self.depth)
            low.insert(self.take(at < middle))
            high.insert(self.take(at >= middle))
            return [(int(words[0]), low), (int(middle), high)]
        if self.depth + 1 < self.waiting[0][1].shape[1]:
            node = Node(self.depth + 1)
            node.insert(self.waiting[0])
            return [(int(words[0]), node)]
        return [(int(words[0]), self)]

    def entries(self) -> list[tuple]:
        return self.waiting


class Node:
    """Children by ranges of the word at ``depth``."""

    def __init__(self, depth: int):
        self.depth = depth
        self.bounds = np.array([np.iinfo(np.int64).min])
        self.children: list[Container | Node] = [Container(depth)]

    @property
    def n(self) -> int:
        return sum(c.n for c in self.children)

    def insert(self, entries: tuple) -> None:
        at = entries[1][:, self.depth]
        order = np.argsort(at, kind="stable")
        entries = tuple(x[order] if len(x) else x for x in entries)
        cut = np.searchsorted(at[order], self.bounds[1:]).tolist()
        for i, (a, b) in enumerate(zip([0, *cut], [*cut, len(order)])):
            if a < b:
                self.children[i].insert(tuple(x[a:b] if len(x) else x for x in entries))
        for i in range(len(self.children) - 1, -1, -1):
            self._burst(i)

    def _burst(self, i: int) -> None:
        c = self.children[i]
        if isinstance(c, Node) or c.n <= 2 * BURST:
            return
        c.compact()
        if c.n <= BURST:
            return
        new = c.burst()
        bounds = [int(self.bounds[i]), *(w for w, _ in new[1:])]
        self.children[i:i + 1] = [x for _, x in new]
        self.bounds = np.concatenate((self.bounds[:i], bounds, self.bounds[i + 1:])).astype(np.int64)
        if len(new) > 1:
            for j in range(len(new) - 1, -1, -1):
                self._burst(i + j)

    def compact(self) -> None:
        for c in self.children:
            c.compact()

    def entries(self) -> list[tuple]:
        return [e for c in self.children for e in c.entries()]


class HatTrie(Node):
    """The trie of one task."""

    def __init__(self):
        super().__init__(0)

    def spill(self, most: int):
        """Whole subtrees, largest first, as sorted runs, until at most ``most`` phrases are left."""
        while self.n > most:
            i = max(range(len(self.children)), key=lambda j: self.children[j].n)
            c = self.children[i]
            c.compact()
            if self.n > most:
                key, words, n, label = (np.concatenate(x) for x in zip(*c.entries()))
                order = np.lexsort(words.T[::-1])
                yield key[order], words[order], n[order], label[order] if len(label) else label
                self.children[i] = Container(0)


def _lang_ids(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def count_runs(rows: DataFrame, k: int, frequent=None) -> DataFrame:
    """Sorted runs of the phrases of ``k`` words whose parts ``frequent`` (broadcast bitmap) holds: (key, n, w1.., lang, word).

    Most words and pairs are rare, so those runs carry keys alone (w1 is null); the next pass, which knows the
    frequent ones, brings their words: with ``k`` of 2 or 3 there are also rows of the frequent phrases of one word
    less, and of single words their spelling."""
    width = k if k > 2 else k - 1  # words that a row has room for
    names = ["key", "n", *(f"w{i + 1}" for i in range(width)), "lang", "word"]
    schema = ", ".join(f"{c} long" for c in names[:-2]) + ", lang string, word string"

    def run(batches):
        bitmap = None if frequent is None else np.frombuffer(frequent.value, np.uint8)
        tries = {w: HatTrie() for w in ([k - 1, k] if k in (2, 3) else [k])}
        gathered, size, total = {w: [] for w in tries}, 0, {}

        def put():
            for w, parts in gathered.items():
                if parts:
                    tries[w].insert(_merged(parts))
                    parts.clear()

        def out(w, most):
            tries[w].compact()
            for key, words, n, label in tries[w].spill(most):
                spelt = w < k or k > 2
                for i in range(0, len(key), 1 << 16):
                    j = slice(i, i + (1 << 16))
                    none = pa.nulls(len(key[j]), pa.int64())
                    cols = [pa.array(key[j].view(np.int64)), pa.array(n[j])]
                    cols += [pa.array(words[j, c].copy()) if spelt and c < w else none for c in range(width)]
                    if len(label):
                        cols += [pa.array([x[c] for x in label[j]], pa.string()) for c in (0, 1)]
                    else:
                        cols += [pa.nulls(len(key[j]), pa.string())] * 2
                    yield pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            langs = b.column(0).to_pylist()
            lang_ids = _lang_ids(langs) if langs else None
            for whole in W.slices(b.column(1)):
                s, piece = cut_pieces(whole.data, whole.offs)
                doc = s.word_doc()
                if k == 1:
                    for d, n in enumerate(np.diff(s.word_offs).tolist()):
                        g = langs[whole.first + d]
                        total[g] = total.get(g, 0) + n
                with np.errstate(over="ignore"):
                    ids = W.mix(s.word_hashes(lower=True) ^ lang_ids[whole.first + doc])
                for w in tries:
                    if len(ids) < w:
                        continue
                    keys = W.window_hashes(ids, w)
                    take = piece[:len(ids) - w + 1] == piece[w - 1:]
                    if w < k:
                        take &= _has(bitmap, keys)
                    elif k > 1:
                        ok = _has(bitmap, W.window_hashes(ids, w - 1))
                        take &= ok[:-1] & ok[1:]
                    at = np.flatnonzero(take)
                    if not len(at):
                        continue
                    key, n, label = keys[at], np.ones(len(at), np.int64), np.empty(0, object)
                    if w == 1 < k:  # a word is spelt once a slice
                        key, first, n = np.unique(key, return_index=True, return_counts=True)
                        at = at[first]
                        low, label = s.data.tobytes().lower(), np.empty(len(key), object)
                        spans = zip(s.starts[at].tolist(), s.ends[at].tolist(), (whole.first + doc[at]).tolist())
                        for i, (x, y, d) in enumerate(spans):
                            label[i] = (langs[d], low[x:y].decode())
                    gathered[w].append((key, np.stack([ids[at + i] for i in range(w)], 1).view(np.int64), n, label))
                    size += len(key)
                if size >= GATHER:
                    put()
                    size = 0
                    for w, t in tries.items():
                        if t.n > 2 * HELD:
                            yield from out(w, HELD)
        put()
        for w in tries:
            yield from out(w, 0)
        if total:
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * len(total), pa.int64()), pa.array(list(total.values()), pa.int64()), pa.array(list(total), pa.string()),
                pa.nulls(len(total), pa.string())], names)

    return W.map_batches(rows, run, schema)


def _bitmap(frequent: DataFrame, n: int) -> bytes:
    """Bits of the frequent phrases' keys; at most BITS bits come to the driver, 4 KB a row."""
    bits = 1 << 15
    while bits < min(16 * n, BITS):
        bits *= 2
    at = F.expr(f"(key & {bits - 1}L) + 1")
    rows = (frequent.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        got = np.frombuffer(r["bits"], np.uint8)
        out[(r["b"] - 1) << 12:((r["b"] - 1) << 12) + len(got)] = got
    return out.tobytes()


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = 100,
                     max_words: int = 5) -> tuple[list[DataFrame], DataFrame]:
    """([words, pairs, triples, ...] with their counts of ``min_count`` and more, (lang, n) of all words)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out, totals, bitmap, last = [], None, None, max(max_words, 3)
    for k in range(1, last + 1):
        runs = count_runs(rows, k, bitmap)
        ids = [f"w{i + 1}" for i in range(k if k > 2 else k - 1)]
        spelling = ["lang", "word"] if k < 3 else []
        # runs meet by prefix (a key stands for a phrase without words), and each phrase is added up in its partition
        prefix = {1: ["key"], 2: [F.coalesce("w1", "key")]}.get(k, ["w1", "w2"])
        merged = runs.repartition(*prefix).groupBy(*ids, *spelling, "key").agg(F.sum("n").alias("n"))
        if k == 1:
            counted = materialize(merged.filter((F.col("n") >= min_count) | F.col("lang").isNotNull()))
            totals, now = counted.filter("lang IS NOT NULL").select("lang", "n"), counted.filter("lang IS NULL")
        else:
            counted = materialize(merged.filter(F.col("n") >= min_count))
            whole = {2: F.col("w1").isNull(), 3: F.col("w3").isNotNull()}.get(k, F.lit(True))
            now = counted.filter(whole)
            if k < 4:  # the phrases of one word less, now with their words
                out.append(counted.filter(~whole).select(*ids[:k - 1], *spelling, "key", "n"))
            if k > 2:
                out.append(now.select(*ids, "key", "n"))
        if k < last:
            n = now.count()
            if k > 2 and not n:
                break
            bitmap = spark.sparkContext.broadcast(_bitmap(now, n))
    return out[:max_words], totals


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = 100, max_words: int = 5,
                 top: int = 2000, cover: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the cut with the lowest score, ``n`` the
    language's words.  A phrase that stands inside a longer one with ``cover`` percent of its count is dropped."""
    levels, totals = frequent_phrases(docs, lang, text, min_count, max_words)
    phrase = lambda i: F.array(*[F.col(f"w{j + 1}") for j in range(i + 1)])
    every = [f.select(phrase(i).alias("ph"), F.col("n").alias("a")) for i, f in enumerate(levels)]
    words, counts = levels[0], every[0]
    for e in every[1:]:
        counts = counts.unionByName(e)
    found = counts.filter(F.size("ph") > 1)
    # a longer phrase that covers a phrase by two words or more holds one that covers it by one, with as high a count
    parts = F.explode(F.array(F.expr("slice(ph, 1, size(ph) - 1)"), F.expr("slice(ph, 2, size(ph) - 1)"))).alias("ph")
    longer = found.filter(F.size("ph") > 2).select(parts, F.col("a").alias("__b")).groupBy("ph").agg(F.max("__b").alias("__b"))
    covered = found.join(longer, "ph").filter(F.lit(100) * F.col("__b") >= F.lit(cover) * F.col("a")).select("ph")
    kept = found.join(covered, "ph", "left_anti")
    cuts = kept.select("ph", "a", F.explode(F.expr("sequence(1, size(ph) - 1)")).alias("__k"))
    cuts = cuts.select("*", F.expr("slice(ph, 1, __k)").alias("__left"), F.expr("slice(ph, __k + 1, size(ph) - __k)").alias("__right"))
    cuts = cuts.join(counts.select(F.col("ph").alias("__left"), F.col("a").alias("l")), "__left")
    cuts = cuts.join(counts.select(F.col("ph").alias("__right"), F.col("a").alias("r")), "__right")
    home = words.select(F.col("w1").alias("__w"), "lang").join(totals, "lang")
    cuts = cuts.withColumn("__w", F.col("ph")[0]).join(home, "__w")
    whole = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    cuts = cuts.withColumn("score", F.expr(f"CAST(1000 AS DECIMAL(4, 0)) * {whole('a')} * {whole('n')} DIV ({whole('l')} * {whole('r')})"))
    best = cuts.groupBy("ph").agg(F.min(F.struct("score", "__k", "l", "r", "a", "n", "lang")).alias("b"))
    best = best.select("ph", "b.lang", "b.a", "b.l", "b.r", "b.n", "b.score")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = best.withColumn("__rank", F.rank().over(by)).filter(F.col("__rank") <= top).drop("__rank")
    spelt = best.select("ph", F.posexplode("ph").alias("__i", "__w")).join(words.select(F.col("w1").alias("__w"), "word"), "__w")
    spelt = spelt.groupBy("ph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "word"))), lambda x: x["word"]), " ")
                                    .alias("phrase"))
    best = best.join(spelt, "ph")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
