import base64
import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
import tiktoken

from estimark.llm import bpe_tree as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks = B.read_ranks(PATH)
    return B.TreeBPE(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(7)
    out = ["", " ", "\n\n  \n", "a" * 5000, "ab" * 700, " " * 3000, "=" * 999 + "-" * 777, "é" * 1200, "日本語" * 300,
           "don't we'll I'M", "x\u0085y\x1c z", "0" * 2500, "<|endoftext|>", "aab" * 500, "thethethe" * 300, "\U0001F600" * 200]
    alpha = ["a", "e", "th", "ing", "é", " ", "  ", "\n", "9", "42", "ñ", "!", "'s", "日", " ", " ", "zz", "Q"]
    for _ in range(400):
        out.append("".join(rnd.choice(alpha[: rnd.randint(2, len(alpha))]) for _ in range(rnd.randint(1, 300))))
    for _ in range(60):
        out.append("".join(rnd.choice("abcdeonrst") for _ in range(rnd.randint(100, 1500))))
    return out


def test_equals_the_library_and_round_trips(pair):
    mine, ref = pair
    for t in texts():
        ids = mine.encode(t)
        assert list(ids) == ref.encode_ordinary(t), t[:60]
        assert mine.decode(ids) == t.encode()


def test_join_is_associative_with_the_whole(pair):
    mine, ref = pair
    rnd = random.Random(9)
    for _ in range(300):
        piece = "".join(rnd.choice("aeionrst") for _ in range(rnd.randint(3, 200))).encode()
        i, j = sorted(rnd.sample(range(len(piece) + 1), 2))
        a, b, c = (mine.encode_bytes(x) if x else [] for x in (piece[:i], piece[i:j], piece[j:]))
        assert mine.join(mine.join(a, b), c) == mine.join(a, mine.join(b, c)) == mine.merge(piece) == mine.merge_long(piece)


def test_query_rows(spark, pair):
    _, ref = pair
    rows = [(1, "hello world"), (2, None), (2, ""), (None, "ä" * 300), (3, "x" * 200000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' n_tokens")
    got = B.encode_texts(df, PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    want = sorted((hashlib.sha256(array("I", ref.encode_ordinary(t or "")).tobytes()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for _, t in rows)
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert B.encode_texts(df.limit(0), PATH, P.PATTERN).count() == 0
