"""Cross-tokenizer alignment against both libraries and plain loops; the perfect hash; bounded tables."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from estimark.llm import cross_tokens as X
from estimark.llm.queries import QUERIES
from estimark.sources.tables import read_table

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HOSTILE = ["", None, " ", "  ", "\n", "a", " a", "a ", "foo  bar", "foo\n bar", "foo \n  bar\t x", "x\x1c y", "▁ a", "a▁b c", "<unk> <s> </s>",
           "<|endoftext|> a", "<0x41> b", "日本語のテキスト、 混ぜる", "naïve café  x", "\U0001F600\U0001F600 ok", "a b 　 c", "x" * 5000, " " * 3000,
           "ab" * 700 + " " + "\n" * 1200 + "z", "it's we'll they've 123 4567", "é ‍ ﻿", "tail \t", "A\r\nB\r\n C", "\x00 \x07x", "don't stop " * 300]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    a, b = libraries
    char = X._byte_of_char()
    a_bytes = {i: bytes(char[c] for c in t) if all(c in char for c in t) else t.encode() for t, i in a.get_vocab().items()}
    b_bytes = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in range(b.get_piece_size())]
    aligned, docs = [], Counter()
    for t in texts:
        t = t or ""
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if not t or b"".join(a_bytes[i] for i in x) != (" " + t).encode() or b"".join(b_bytes[i] for i in y) != (" " + t).encode():
            aligned.append([])
            continue
        x_end, y_end = np.cumsum([len(a_bytes[i]) for i in x]).tolist(), np.cumsum([len(b_bytes[i]) for i in y]).tolist()
        groups, i, j = [], 0, 0
        for stop in sorted(set(x_end) & set(y_end)):
            k, m = x_end.index(stop, i) + 1, y_end.index(stop, j) + 1
            groups.append((x[i:k], y[j:m]))
            i, j = k, m
        aligned.append(groups)
        docs.update({(p, q) for g in groups for p in set(g[0]) for q in set(g[1])})
    best = {}
    for (p, _), n in docs.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for groups in aligned:
        links = Counter()
        for g in groups:
            for p, n in Counter(g[0]).items():
                for q, m in Counter(g[1]).items():
                    links[p, q] += n * m
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
                    sum(n for k, n in links.items() if docs[k] == best[k[0]]), sum(n * docs[k] for k, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, docs


def scored(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: tuple(r)[1:] for r in X.CrossTokens(df, A, B, P.PATTERN).scored().collect()}
    return [rows[i] for i in range(len(texts))]


def test_hostile_texts(spark, libraries):
    texts = HOSTILE + ["the cat sat on the mat", "the cat sat on the mat", "the dog; the cat."] + HOSTILE[5:12]
    assert scored(spark, texts) == brute(texts, libraries)[0]


def test_bounded_tables_change_nothing(spark, libraries, monkeypatch):
    """Small runs, many shards and several tree levels."""
    texts = [r["text"] for r in read_table(spark, "/root/testdata/sf0.001", "documents", "text").collect()][:120]
    want, docs = brute(texts, libraries)
    for name, value in {"RUN": 500, "SHARD_KEYS": 700, "FAN": 2, "KEEP_SHARDS": 40_000, "BATCH_CHARS": 3000}.items():
        monkeypatch.setattr(X, name, value)
    rows = [(i, t) for i, t in enumerate(texts)]
    tok = X.Tokenizers(open(A, "rb").read(), open(B, "rb").read(), P.PATTERN)
    got = X.Aligned(tok, [t or "" for t in texts])
    assert [tuple(x) for x in got.sums.tolist()] == [w[:4] for w in want]
    assert Counter((k // tok.n_b, k % tok.n_b) for k in got.pairs().tolist()) == docs
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    c = X.CrossTokens(df, A, B, P.PATTERN)
    runs = c.runs(c.first_pass())
    assert runs.select("task").distinct().count() > 4
    hashes = c.hashes(runs)
    assert len(hashes) > 3
    vectors = c.vectors(runs, hashes)
    got = {(r["a_id"], r["b_id"]): r["n_docs"] for r in c.pair_counts(hashes, vectors).collect()}
    assert got == dict(docs)
    top = np.zeros(tok.n_a, np.int64)
    counts = X.Counts(c.folder, hashes, vectors, top)
    some = np.array(sorted(p * tok.n_b + q for p, q in docs)[::3])
    assert counts.of(some).tolist() == [docs[k // tok.n_b, k % tok.n_b] for k in some.tolist()]
    assert counts.bytes <= 40_000 or len(counts.held) == 1
    with pytest.raises(ValueError):
        counts.of(np.array([next(k for k in range(10**6) if (k // tok.n_b, k % tok.n_b) not in docs)]))


def test_perfect_hash_is_minimal_and_perfect():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rnd.integers(0, 1 << 40, n))
        h = X.PerfectHash.build(keys)
        assert h.n == len(keys) and sorted(h.index(keys).tolist()) == list(range(len(keys)))


def test_empty_table_and_clashing_columns(spark, libraries):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert X.CrossTokens(empty, A, B, P.PATTERN, groups=True).scored().collect() == []
    clash = spark.createDataFrame([(1, "a cat", 7, "x", 3)], "doc_id long, text string, n_a int, code string, __key int")
    got = [tuple(r)[1:8] for r in X.CrossTokens(clash, A, B, P.PATTERN, groups=True).scored().collect()]
    assert got == brute(["a cat"], libraries)[0]


def test_query_equals_brute_force(spark, libraries):
    rows = sorted(map(tuple, read_table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text").collect()))
    df = QUERIES["op12_cross_tokens"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, df.collect())) == [(r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows], libraries)[0])]
