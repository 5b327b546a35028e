"""Phrase mining against plain loops; the trie under small limits; defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from estimark.llm import phrase_trie as P
from estimark.llm import words as W


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, min_count, top, max_words=5):
    out = []
    for lang in {r[0] or "und" if r[0] is None else r[0] for r in rows}:
        f, n = Counter(), 0
        for g, t in rows:
            if (g if g is not None else "und") == lang:
                for ws in pieces_of(t):
                    n += len(ws)
                    f.update(tuple(ws[i:i + k]) for k in range(1, max_words + 1) for i in range(len(ws) - k + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inside = lambda p, q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
        got = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and inside(p, q) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, ph.decode(), -a, l, r, n, -s) for i, (s, a, ph, l, r) in enumerate(sorted(got)[:top])]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    return sorted(map(tuple, P.collocations(df, **kw).collect()))


def corpus(n, seed, vocabulary=30):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(vocabulary)] + ["É", "日本", "New", "york", "a\x0bb", "x\x1cy"]
    text = lambda: "".join(rnd.choice(words[:max(2, int(rnd.paretovariate(0.7)) % len(words))]) + rnd.choice([" ", "  ", "\t", ". ", "\n", " "])
                           for _ in range(rnd.randrange(60)))
    return [(rnd.choice(["en", "de", None, "und", ""]), rnd.choice([text(), text() + " New York City, new york city", None, ""])) for _ in range(n)]


def test_equals_plain_loops(spark):
    rows = corpus(400, 1) + [("en", "of of of of of of of of")] * 30 + [("de", "one two three four five six seven")] * 25
    assert mined(spark, rows, min_count=12, top=40) == brute(rows, 12, 40)
    assert mined(spark, rows, min_count=5, top=10**6) == brute(rows, 5, 10**6)


def test_ties_at_the_end_of_the_list(spark):
    rows = [("en", f"{a} {b}") for a, b in ("pq", "ab", "xy", "cd", "ef") for _ in range(7)]
    assert [r[2] for r in mined(spark, rows, min_count=7, top=3)] == ["a b", "c d", "e f"]


def test_long_text_empty_table_and_clashing_columns(spark):
    rows = [("en", "hot word pair " * 200_000 + "end"), ("en", None)]
    assert mined(spark, rows, min_count=100, top=50) == brute(rows, 100, 50)
    assert mined(spark, []) == []
    df = spark.createDataFrame([("en", "a b. a b", 1, 2, "x")], "lang string, text string, n int, w1 int, key string")
    assert [tuple(r) for r in P.collocations(df, min_count=2).collect()] == [("en", 1, "a b", 2, 2, 2, 4, 2000)]


def test_products_beyond_64_bits(spark):
    counts = spark.sql("SELECT CAST(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(18,0)) DIV "
                       "(CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) AS BIGINT) FROM VALUES "
                       "(123456789012L, 98765432109876L, 123456789013L, 223456789012L) AS t(a, n, l, r)").first()[0]
    assert counts == 1000 * 123456789012 * 98765432109876 // (123456789013 * 223456789012)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_trie_bursts_and_spills_whole_sorted_subtrees(monkeypatch, k):
    monkeypatch.setattr(P, "BURST", 40)
    rnd = np.random.default_rng(k)
    trie, want, runs = P.HatTrie(), Counter(), []
    for _ in range(60):
        words = rnd.zipf(1.3, (200, k)).astype(np.int64) % 50 - 20
        if k > 1:
            words[:120, 0] = 7  # a hot first word
        n = rnd.integers(1, 5, 200)
        for w, m in zip(map(tuple, words.tolist()), n.tolist()):
            want[w] += m
        trie.insert(P._merged([(W.window_hashes(words.view(np.uint64).ravel(), k)[::k], words, n, np.empty(0, object))]))
        if trie.n > 600:
            trie.compact()
            runs += list(trie.spill(300))
            assert trie.n <= 300
    assert k == 1 or any(isinstance(c, P.Node) for c in trie.children) or len(trie.children) > 3
    trie.compact()
    runs += list(trie.spill(0))
    got = Counter()
    for _, words, n, _ in runs:
        rows = list(map(tuple, words.tolist()))
        assert rows == sorted(set(rows))
        for w, m in zip(rows, n.tolist()):
            got[w] += m
    assert got == want and trie.n == 0
