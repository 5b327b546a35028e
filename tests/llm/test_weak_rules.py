import random
import re

import numpy as np
import pytest

from estimark.llm import weak_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in wins:
        count[w] = count.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(wins) if count[w] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def texts():
    rnd = random.Random(5)
    vocab = ["a", "bé", "the#", "x|y", "ñandú", "Zwölf.", "日本", "w x", "<b>"]
    seps = [" ", "  ", "\n", "\t", "\r\n", "\x0b"]
    out = [None, "", " ", "\n\n", "one", "a b c d e a b c d e", "l 1\nl 1\n l 1\nl 1", "\x1c\x85 z"]
    for _ in range(120):
        out.append("".join(rnd.choice(vocab) + rnd.choice(seps) for _ in range(rnd.randint(1, 60))))
    return out + ["word " * 60000]


def test_measures_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in R.quality_votes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, chars, sym, dup, rep = brute(t)
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, sym, dup, rep), i
        assert g.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (g.base_failed and g.kept)


def test_em_equals_per_document_em():
    rnd = np.random.default_rng(3)
    good = rnd.random(500) < 0.8
    votes = np.zeros((500, 4), int)
    for j, (hit, alarm) in enumerate([(0.7, 0.01), (0.6, 0.0), (0.5, 0.02), (0.8, 0.01)]):
        bad_vote = rnd.random(500) < np.where(good, alarm, hit)
        votes[:, j] = np.where(rnd.random(500) < 0.2, 0, np.where(bad_vote, -1, 1))
    pats, counts = np.unique(votes, axis=0, return_counts=True)
    share, bad, post = R.fit_accuracies(pats, counts.astype(float))
    share1, bad1, post1 = R.fit_accuracies(votes, np.ones(500))  # every document its own pattern
    assert share == pytest.approx(share1, abs=1e-6) and np.allclose(bad, bad1, atol=1e-6)
    assert ((post1 >= 0.5) == good).mean() > 0.95
    assert (bad[0] >= bad[1]).all()


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept string, n_words string")
    assert R.quality_votes(df).count() == 0
    df = spark.createDataFrame([(None, "x " * 30, "k"), (1, None, None), (1, None, None)],
                               "doc_id long, text string, p_good string")
    assert R.quality_votes(df).count() == 3


def verdicts(texts, keep_at=0.5):
    """(p_good, kept) of every text: votes from plain loops, EM with every document on its own."""
    votes, failed = [], []
    for t in texts:
        t = t or ""
        n, _, sym, dup, rep = brute(t)
        words = WORD.findall(t)
        letter = lambda c: c.isascii() and c.isalpha() or ord(c) > 127
        plain = [letter(w[0]) and (letter(w[-1]) or (len(w) > 1 and w[-1] in ".,;:!?)\"'" and letter(w[-2]))) for w in words]
        # letters are counted by the first byte of longer characters from U+00C0 on, as the measure defines them
        letters = sum(c.isascii() and c.isalpha() or ord(c) >= 0xC0 for c in t)
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        pairs = [(sym, n, 0.05, 0.20), (n - sum(plain), n, 0.10, 0.40), (sum("A" <= c <= "Z" for c in t), letters, 0.15, 0.60),
                 (rep, n, 0.05, 0.20), (dup, lines, 0.10, 0.50), (n if n < 20 else 0, n, 0.0, 1.0)]
        votes.append([0 if not d else 1 if a / d <= good else -1 if a / d >= bad else 0 for a, d, good, bad in pairs])
        failed.append(n < 10 or 100 * rep > 20 * n)
    _, _, post = R.fit_accuracies(np.array(votes, float), np.ones(len(votes)))
    return [(p, not f and p >= keep_at) for p, f in zip(post, failed)]


def test_query_verdicts_equal_brute_force(spark):
    from estimark.llm.queries import QUERIES
    from estimark.sources.tables import read_table
    rows = read_table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text").collect()
    got = {r.doc_id: (r.p_good, r.kept) for r in QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.001").collect()}
    want = verdicts([r.text for r in rows])
    assert len(got) == len(rows)
    for r, (p, kept) in zip(rows, want):
        assert abs(got[r.doc_id][0] - p) < 1e-5 and got[r.doc_id][1] == kept, r.doc_id
