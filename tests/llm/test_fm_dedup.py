import hashlib
import random
import re

import numpy as np
import pytest

from estimark.llm import fm_dedup as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    """Words removed per row position: windows that also start in a smaller doc_id (none counts as the largest)."""
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    ids = [D.LAST if i is None else i for i, _ in rows]
    for i, w in zip(ids, words):
        for p in range(len(w) - k + 1):
            g = tuple(w[p:p + k])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, w in zip(ids, words):
        gone = {p + j for p in range(len(w) - k + 1) if least[tuple(w[p:p + k])] < i for j in range(k)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, k):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "日本", "the", "of", "longword" * 3]
    passage = [[rnd.choice(vocab) for _ in range(rnd.randint(k - 2, 4 * k))] for _ in range(12)]
    rows = [(3, None), (4, ""), (5, "short text"), (None, " ".join(passage[0])), (2, " ".join(passage[0])), (2, "x " * 40)]
    for i in range(10, 110):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            parts += rnd.choice(passage) if rnd.random() < 0.5 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 60))]
            if parts and rnd.random() < 0.3:
                parts[rnd.randrange(len(parts))] = "edit"
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(parts)))
    return rows + [(200, rows[20][1]), (200, rows[20][1]), (201, "word " * 50), (1, "word " * 30)]


@pytest.mark.parametrize("seed,crowd,shard", [(1, 20_000, 1 << 17), (2, 3, 200)])
def test_equals_brute_force(spark, seed, crowd, shard):
    rows = corpus(seed, D.WINDOW)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' n_words")
    got = D.repeated_passages(df, crowd=crowd, shard=shard).collect()
    want = [(i, *w) for (i, _), w in zip(rows, brute(rows, D.WINDOW))]
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got))) == sorted(map(repr, want))
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_removed for r in got) > 1000


def test_index_counts_and_statistics():
    rng = np.random.default_rng(6)
    for size in (1, 5, 300):
        seqs = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) * np.uint64(7) for _ in range(size)]
        owner = rng.integers(0, 50, size)
        lengths = np.array([len(x) for x in seqs])
        index = D.FMIndex(np.concatenate(seqs), lengths, owner)
        # backward search over any pattern counts its occurrences
        for _ in range(20):
            s = seqs[rng.integers(size)]
            a = int(rng.integers(len(s)))
            pat = s[a:a + int(rng.integers(1, 6))]
            lo, hi = np.array([0]), np.array([index.n])
            for w in pat[::-1]:
                c = np.searchsorted(index.alphabet, [w]) + 1
                lo, hi = index.first[c] + index.rank(c, lo), index.first[c] + index.rank(c, hi)
            at = [(j, p) for j, x in enumerate(seqs) for p in range(len(x) - len(pat) + 1) if (x[p:p + len(pat)] == pat).all()]
            assert hi[0] - lo[0] == len(at)
            assert index.minimum(lo, hi)[0] == min(owner[j] for j, _ in at)
        k = 4
        seq = np.repeat(np.arange(size), np.maximum(lengths - k + 1, 0))
        off = np.concatenate([np.arange(max(n - k + 1, 0)) for n in lengths]).astype(int)
        reach = index.statistics(index.begin[seq] + off, k, owner[seq])
        for j, o, r in zip(seq, off, reach):
            best = 0
            for t in range(1, k + 1):
                pat = seqs[j][o + k - t:o + k]
                if any(owner[m] < owner[j] and any((x[p:p + t] == pat).all() for p in range(len(x) - t + 1)) for m, x in enumerate(seqs)):
                    best = t
                else:
                    break
            assert r == best


def test_empty(spark):
    assert D.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts(spark):
    """A passage deep inside texts of a million words is found; nothing else goes."""
    rnd = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    filler = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rows = [(1, " ".join(filler("a", 150_000) + passage + filler("b", 100))), (2, " ".join(filler("c", 200_000) + passage[5:50] + filler("d", 7)))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in D.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (150_160, 0), 2: (200_052, 45)}
