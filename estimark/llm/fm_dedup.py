"""Removal of repeated passages with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one document.  Every word covered
by a window whose word sequence also starts in a document with a smaller
doc_id is removed; windows are judged on the input.

1. Shards are cut by content.  A window's anchor is its smallest gram of
   ``GRAM`` words in a fixed order: grams with a long word first, random
   otherwise.  A run of windows with the same anchor position is a segment.
   Equal windows have equal anchors, so they meet in the anchor's shard
   wherever they stand, and anchors that only one document has are dropped at
   once.
2. Equal segments are indexed once, for their smallest doc_id (aggregated
   before the shuffle): all other documents lose such a segment entirely.
3. A shard is a run of whole anchors of about ``SHARD`` words.  Its segments'
   words are renumbered, the suffix array gives the Burrows-Wheeler transform,
   and a wavelet matrix over packed bit vectors with rank counts is the index.
   The segments' documents are streamed against it: backward search yields
   every window's matching statistics up to the window length, where a match
   counts while its suffix interval holds a smaller doc_id (a range minimum),
   and runs of windows that reach the whole length are reported.
4. Reported runs go back to their documents, which drop the covered words.

An anchor with more than ``CROWD`` segments (the edge of a passage that very
many documents share) is dealt out by content once more: its segments fall
into single windows, salted by a hash of the window.

Defined cases: null and empty texts have no words and keep the empty text;
texts shorter than a window lose nothing; rows that repeat a doc_id are one
document's texts and do not remove each other; a row without doc_id counts as
later than all others; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm import words as W
from estimark.session import materialize

WINDOW, GRAM = 13, 3
LONG = 6  # bytes of a long word
SHARD = 1 << 17  # words of an index
CROWD = 20_000  # segments of an anchor
LAST = (1 << 63) - 1  # stands for a missing doc_id


class FMIndex:
    """FM-index of word sequences: wavelet matrix over the BWT, rank in packed bits.

    ``words`` are the sequences one after the other, ``lengths`` their lengths,
    ``owner`` a number per sequence whose minimum over a suffix interval can be
    asked."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owner: np.ndarray):
        self.alphabet, ids = np.unique(words, return_inverse=True)
        n_seq, n = len(lengths), len(words) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1  # where each sequence's terminator stands
        symbol = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbol[inside] = ids + 1
        self.symbol, self.begin = symbol, ends - lengths
        # suffixes by prefix doubling; terminators differ, so sequences end the comparison
        rank = np.where(inside, symbol + n_seq, 0)
        rank[ends] = np.arange(n_seq)
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = rank[step:] + 1
            pair = rank * (n + n_seq + 2) + ahead
            order = np.argsort(pair, kind="stable")
            sorted_pair = pair[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate(([0], sorted_pair[1:] != sorted_pair[:-1])))
            rank = new
            step *= 2
            if rank[order[-1]] == n - 1 or step >= n:
                break
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        self.n = n
        bwt = symbol[suffix - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbol, minlength=len(self.alphabet) + 1))))
        # wavelet matrix: a packed bit vector, its counts per 64 bits and its zeros per level
        self.levels, level = [], bwt
        for bit in range(max(1, int(len(self.alphabet)).bit_length()) - 1, -1, -1):
            ones = (level >> bit & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            packed = packed.view("<u8")
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1].astype(np.int32)
            self.levels.append((bit, packed, counts, n - int(ones.sum())))
            level = np.concatenate((level[~ones], level[ones]))
        self.base = self._down(np.arange(len(self.alphabet) + 1), np.zeros(len(self.alphabet) + 1, np.int64))
        own = np.repeat(owner, lengths + 1)[suffix]
        self.least = [own]
        while 2 << (len(self.least) - 1) <= n:
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[: len(last) - half], last[half:]))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, packed, counts, zeros in self.levels:
            at = i >> 6
            below = packed[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[at] + np.bitwise_count(below)
            i = np.where(c >> bit & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands in the first i places of the BWT."""
        return self._down(c, i) - self.base[c]

    def minimum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest owner of the suffixes lo..hi (at least one)."""
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), self.least[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << k)])
        return out

    def statistics(self, at: np.ndarray, length: int, below: np.ndarray) -> np.ndarray:
        """Matching statistics: how many of the ``length`` symbols that start at text positions ``at``, taken from the
        right, occur together in a sequence whose owner is smaller than ``below``."""
        reach, alive = np.zeros(len(at), np.int64), np.arange(len(at))
        lo = hi = None
        for t in range(length - 1, -1, -1):
            c = self.symbol[at[alive] + t]
            if lo is None:
                lo, hi = self.first[c], self.first[c + 1]
            else:
                lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            go = self.minimum(lo, hi) < below[alive]  # the sequence itself occurs, so the interval isn't empty
            alive, lo, hi = alive[go], lo[go], hi[go]
            reach[alive] += 1
            if not len(alive):
                break
        return reach


def _run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run h[start:end]; equal runs have equal hashes."""
    power, inverse = W._powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(W.mix(h) * power[: len(h)], out=sums[1:])
        return W.mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def segments(s: W.Slice, h: np.ndarray, k: int, q: int):
    """(text's index, first word, number of windows, anchor, content hash) of every segment."""
    first, doc, _ = W.windows(s, h, k)
    if not len(first):
        e = np.empty(0, np.int64)
        return e, e, e, e.astype(np.uint64), e.astype(np.uint64)
    short = np.lib.stride_tricks.sliding_window_view(s.ends - s.starts < LONG, q).all(1)
    gram = (W.window_hashes(h, q) >> np.uint64(1)) | (short.astype(np.uint64) << np.uint64(63))
    best, at = gram[first], first.copy()
    for j in range(1, k - q + 1):
        g = gram[first + j]
        less = g < best
        best = np.where(less, g, best)
        at[less] = first[less] + j
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    n = np.diff(np.append(cut, len(first)))
    return doc[cut], first[cut], n, best[cut], _run_hashes(h, first[cut], first[cut] + n + k - 1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


KEEP = 6  # bytes of a word's hash in a shard; a false match needs 13 words that all agree in them


def _binaries(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values[start:end] as KEEP bytes each, per entry."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEEP]).tobytes()
    return pa.array([raw[KEEP * a:KEEP * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())


def _words(blobs) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, KEEP)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :KEEP] = raw
    return out.view("<u8").reshape(-1).astype(np.uint64)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW, q: int = GRAM,
                      shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, kept_text) per row of ``docs``."""
    base = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    base = base.withColumn("did", F.coalesce("id", F.lit(LAST))).withColumn("th", F.pmod(F.xxhash64("t"), F.lit(1 << 20)).cast("int"))
    names = ["did", "place", "anchor", "seg"]

    def cut(batches):
        for b in batches:
            for s in W.slices(b.column(2)):
                doc, start, n, anchor, seg = segments(s, s.word_hashes(), k, q)
                if len(doc):
                    rows = pa.array(doc + s.first)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(rows), pa.array(b.column(1).to_numpy()[doc + s.first].astype(np.int64) << 43
                                                          | (start - s.word_offs[doc]) << 5 | n), _long(anchor), _long(seg)], names)

    # place: 20 bits that tell apart the texts of a repeated doc_id, first word, number of windows (k - q + 1 at most)
    cuts = W.map_batches(base.select("did", "th", "t"), cut, "did long, place long, anchor long, seg long")
    shared = (cuts.groupBy("anchor").agg(F.min("did").alias("a"), F.max("did").alias("z")).filter("a < z")
              .select("anchor"))
    # written first, so that a hot anchor's cuts meet a plain shuffle, which a skew join may split
    live = materialize(cuts.join(materialize(shared), "anchor"))

    # a segment's smallest document has it indexed if the anchor has another segment; the others lose it entirely
    firsts = materialize(live.groupBy("anchor", "seg").agg(F.min("did").alias("least")))
    many = materialize(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    th, start = F.shiftrightunsigned("place", 43).cast("int"), F.shiftrightunsigned("place", 5).bitwiseAND(F.lit((1 << 38) - 1)).cast("int")
    first = F.col("did") == F.col("least")
    owned = live.join(firsts, ["anchor", "seg"]).join(many, "anchor", "left").filter(~first | F.col("size").isNotNull())
    owned = materialize(owned.select("did", "place", F.when(first, F.col("anchor")).alias("anchor"), F.when(first, F.col("seg")).alias("seg"),
                                     F.when(first, F.ceil(F.col("size") / crowd)).cast("int").alias("parts")))
    owned = owned.select("did", th.alias("th"), start.alias("start"), F.col("place").bitwiseAND(F.lit(31)).cast("int").alias("n"),
                         "anchor", "seg", "parts")
    units = owned.filter("seg IS NOT NULL")
    by_doc = units.groupBy("did", "th").agg(F.collect_list(F.struct("start", "n", "anchor", "seg", "parts")).alias("want"))
    source = base.select("did", "th", "t").join(by_doc, ["did", "th"]).dropDuplicates(["did", "th"])

    def fetch(batches):
        out = ["key", "unit", "did", "n", "words", "seg", "off", "crowded"]
        for b in batches:
            lists = b.column(3)
            flat, lens = lists.flatten(), np.diff(lists.offsets.to_numpy())
            start, n, anchor, seg, parts = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            begin = np.concatenate(([0], np.cumsum(lens)))
            did = b.column(0).to_numpy()
            for s in W.slices(b.column(2)):
                h, lo, hi = s.word_hashes(), begin[s.first], begin[s.first + s.n]
                d = np.repeat(np.arange(s.n), lens[s.first:s.first + s.n])
                at = start[lo:hi] + s.word_offs[d]
                whole = parts[lo:hi] == 1
                w, m = at[whole], n[lo:hi][whole]
                if len(w):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[lo:hi][whole]), pa.array(seg[lo:hi][whole]), pa.array(did[s.first + d[whole]]),
                         pa.array(m), _binaries(h, w, w + m + k - 1), pa.array(seg[lo:hi][whole]),
                         pa.array(np.zeros(len(w), np.int32)), pa.array(np.zeros(len(w), bool))], out)
                if not whole.all():
                    m = n[lo:hi][~whole]
                    off = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    w = np.repeat(at[~whole], m) + off
                    unit = _run_hashes(h, w, w + k)
                    salt = unit % np.repeat(parts[lo:hi][~whole], m).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        salted = W.mix(np.repeat(anchor[lo:hi][~whole], m).view(np.uint64) + salt)
                    yield pa.RecordBatch.from_arrays(
                        [_long(salted), _long(unit), pa.array(np.repeat(did[s.first + d[~whole]], m)),
                         pa.array(np.ones(len(w), np.int32)), _binaries(h, w, w + k), pa.array(np.repeat(seg[lo:hi][~whole], m)),
                         pa.array(off.astype(np.int32)), pa.array(np.ones(len(w), bool))], out)

    fetched = W.map_batches(source, fetch, "key long, unit long, did long, n int, words binary, seg long, off int, crowded boolean")
    crowds = bool(many.filter(F.col("size") > crowd).limit(1).count())
    fetched = materialize(fetched) if crowds else fetched  # without a crowd it is read once
    pooled = fetched.filter("NOT crowded").select("key", "unit", "did", "n", "words")
    if crowds:
        dealt = (fetched.filter("crowded").groupBy("key", "unit")
                 .agg(F.min("did").alias("did"), F.first("n").alias("n"), F.first("words").alias("words")))
        pooled = pooled.unionByName(dealt)

    def search(batches):
        def solve(rows):
            key_, unit, did, n, words = zip(*rows)
            n, did = np.array(n), np.array(did)
            lengths = n + k - 1
            index = FMIndex(_words(words), lengths, did)
            seq = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
            hit = index.statistics(index.begin[seq] + off, k, did[seq]) == k
            start = hit & np.concatenate(([True], ~(hit[:-1] & (seq[1:] == seq[:-1]))))
            at = np.flatnonzero(start)
            if not len(at):
                return None
            run = np.add.reduceat(hit.astype(np.int64), at)  # hits up to the next start: one run each
            return pa.RecordBatch.from_arrays(
                [pa.array([unit[i] for i in seq[at].tolist()], pa.int64()), pa.array(off[at].astype(np.int32)),
                 pa.array(run.astype(np.int32))], ["unit", "off", "run"])

        now, group, held, size = None, [], [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if row[0] != now:
                    if len(group) > 1:
                        held += group
                        size += sum(len(r[4]) for r in group) // KEEP
                    if size >= shard:
                        if (got := solve(held)):
                            yield got
                        held, size = [], 0
                    now, group = row[0], []
                group.append(row)
        held += group if len(group) > 1 else []
        if held and (got := solve(held)):
            yield got

    spread = pooled.repartition("key").sortWithinPartitions("key")
    runs = materialize(W.map_batches(spread, search, "unit long, off int, run int"))

    # the smallest document of a segment loses the reported runs
    copies = owned.filter("seg IS NULL").select("did", "th", "start", "n")
    hits = runs.select(F.col("unit").alias("seg"), "off", "run")
    if crowds:  # a crowded segment's windows: met elsewhere, or owned by a smaller document
        windows = fetched.filter("crowded").select("unit", "seg", "off", "did")
        small = dealt.select(F.col("unit").alias("u"), F.col("did").alias("d"))
        met = (windows.join(small, F.col("unit") == F.col("u"))
               .join(runs.select(F.col("unit").alias("r")).distinct(), F.col("unit") == F.col("r"), "left"))
        met = met.filter("d < did OR r IS NOT NULL").select("seg", "off", F.lit(1).alias("run"))
        plain = fetched.filter("NOT crowded").select(F.col("unit").alias("seg")).distinct()
        hits = hits.join(plain, "seg").unionByName(met)
    reps = (units.join(hits, "seg")
            .select("did", "th", (F.col("start") + F.col("off")).alias("start"), F.col("run").alias("n")))
    gone = copies.unionByName(reps).groupBy("did", "th").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("gone"))
    joined = base.join(gone, ["did", "th"], "left").select("id", "t", "gone")

    def drop(batches):
        for b in batches:
            lists = b.column(2)
            n_words, n_gone, sha, texts = [], [], [], []
            for s in W.slices(b.column(1)):
                cover = np.zeros(len(s.starts) + 1, np.int64)
                for i in range(s.n):
                    runs_ = lists[s.first + i].as_py()
                    if runs_:
                        at = np.array([r["start"] for r in runs_]) + s.word_offs[i]
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + np.array([r["n"] for r in runs_]) + k - 1, -1)
                kept = np.cumsum(cover[:-1]) == 0
                for i in range(s.n):
                    lo, hi = s.word_offs[i], s.word_offs[i + 1]
                    keep = np.flatnonzero(kept[lo:hi]) + lo
                    raw = s.data[s.offs[i]:s.offs[i + 1]].tobytes()
                    if len(keep) == hi - lo:
                        out = b" ".join(raw.split())  # bytes.split() cuts at the same six characters
                    else:
                        out = b" ".join(s.data[a:e].tobytes() for a, e in zip(s.starts[keep].tolist(), s.ends[keep].tolist()))
                    n_words.append(hi - lo)
                    n_gone.append(hi - lo - len(keep))
                    sha.append(hashlib.sha256(out).hexdigest())
                    texts.append(out)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = W.map_batches(joined, drop, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumn("id", F.col("id").cast(docs.schema[key].dataType)).withColumnRenamed("id", key)
