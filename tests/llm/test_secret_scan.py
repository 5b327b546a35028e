import base64
import hashlib
import random
import re

import public_tokenizers as P
import tiktoken

from estimark.llm import secret_scan as S
from estimark.llm.bpe_tree import read_ranks

PATH = P.path("byte_bpe_50k.tiktoken")
PLAIN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    """The base kinds with the plain patterns over the text; ASCII letters only fold."""
    out = [("assign", m.start(), m.end()) for m in PLAIN.finditer(text) if len(m[2]) >= 8 and m[1].isascii()]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


def texts():
    rnd = random.Random(11)
    hx = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    b62 = lambda n: "".join(rnd.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(n))
    bits = [lambda: "token = \"" + hx(40) + '"', lambda: "AKIA" + b62(12).upper(), lambda: hx(31), lambda: hx(32),
            lambda: "Api_Key:" + b62(9), lambda: "passwd='short'", lambda: "SECRET = " + b62(8), lambda: "apikey==" + b62(12),
            lambda: "zé日", lambda: "AKIAAKIA" + b62(9).upper(), lambda: b62(40), lambda: "a plain sentence of words",
            lambda: "secretsecret: " + b62(7) + "." + b62(3), lambda: "token:token=" + b62(10), lambda: "tokeN'= \"x" + b62(8)]
    out = [None, "", "ſecret: abcdefghij", "toKen=abcdefghijk"]
    for _ in range(200):
        out.append(rnd.choice([" ", "\n", "", "|"]).join(rnd.choice(bits)() for _ in range(rnd.randint(1, 12))))
    return out + ["lorem ipsum " * 50000 + "AKIA" + "Z" * 14]


def test_base_spans_and_digest(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN).collect()}
    for i, t in rows:
        want, g = brute(t or ""), got[i]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == x[0] for x in want) for k in ("assign", "access", "hex"))
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert g.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in g.spans.split(",") if x and not x.startswith("token")] == (base.split(",") if base else [])


def test_token_efficiency_finds_random_strings_and_spares_known_ones():
    enc = tiktoken.Encoding("o", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    count = lambda s: len(enc.encode_ordinary(s))
    rnd = random.Random(2)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hits = 0
    for _ in range(300):
        key = "".join(rnd.choice(chars) for _ in range(40))
        hits += S.token_spans(f"see {key} now", [], count, S.MAX_CHARS_PER_TOKEN) == [(3, 4, 44)]
    assert hits >= 285
    for known in ("123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "2024-01-01/2025-12-31-0000",
                  "internationalization_of_things", "src/main/scala/org/apache/spark", "chachaulichengeheitheit",
                  "some_long_function_name_42", "-" * 40):
        assert S.token_spans(known, [], count, S.MAX_CHARS_PER_TOKEN) == [], known


def brute_tokens(text, count):
    """Token spans by trying every character: runs of key characters without those of base spans."""
    taken = [False] * (len(text) + 1)
    for _, s, e in brute(text):
        taken[s:e] = [True] * (e - s)
    key = [c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" for c in text]
    out, i = [], 0
    while i < len(text):
        if not key[i]:
            i += 1
            continue
        j = i
        while j < len(text) and key[j]:
            j += 1
        run = (i, j)
        s = i
        while s < j:
            if taken[s]:
                s += 1
                continue
            e = s
            while e < j and not taken[e]:
                e += 1
            a, b = s, e
            if (s, e) != run:
                while a < b and text[a] in "+/_=-":
                    a += 1
                while a < b and text[b - 1] in "+/_=-":
                    b -= 1
            part = text[a:b]
            known = re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9/_=+-]+", part) or (
                len(part) in (32, 40, 56, 64, 96, 128) and re.fullmatch("[0-9a-fA-F]+", part))
            few = sum(c.isdigit() for c in part) <= 2
            if b - a >= 20 and j - i >= 20 and not known and any(c.isalpha() for c in part) and b - a <= (2.0 if few else 2.1) * count(part):
                out.append(("token", a, b))
            s = e
        i = j
    return out


def test_query_spans_equal_brute_force(spark):
    """All spans of the query, base and token ones, over whole documents."""
    from estimark.llm.queries import QUERIES
    from estimark.sources.tables import read_table
    enc = tiktoken.Encoding("o", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    count = lambda s: len(enc.encode_ordinary(s))
    order = {"assign": 0, "access": 1, "hex": 2, "token": 3}
    want = lambda t: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(brute(t) + brute_tokens(t, count), key=lambda x: (x[1], order[x[0]], x[2])))
    got = {r.doc_id: r.spans for r in QUERIES["op2_secret_scans"](spark, "/root/testdata/sf0.001").collect()}
    for r in read_table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text").collect():
        assert got[r.doc_id] == want(r.text or ""), r.doc_id
    rows = list(enumerate(t or "" for t in texts()))
    for r in S.scan(spark.createDataFrame(rows + rows[:3], "doc_id long, text string"), PATH, P.PATTERN).collect():
        assert r.spans == want(rows[r.doc_id][1])


def test_parts_beside_base_spans_and_letter_keys():
    enc = tiktoken.Encoding("o", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    count = lambda s: len(enc.encode_ordinary(s))
    rnd = random.Random(7)
    b64 = lambda n, chars="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rnd.choice(chars) for _ in range(n))
    found = lambda t: S.token_spans(t, S.base_spans(t), count, S.MAX_CHARS_PER_TOKEN)
    hits = [0, 0, 0]
    for _ in range(100):
        t = f"AKIA{b64(16).upper()}/{b64(40)}"
        hits[0] += found(t) == [(3, 21, 61)]
        t = "".join(rnd.choice("0123456789abcdef") for _ in range(32)) + "-Z" + b64(38)
        hits[1] += found(t) == [(3, 33, 72)]
        t = b64(32, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
        hits[2] += found(t) == [(3, 0, 32)]
    assert min(hits) >= 95, hits
    assert found("AKIA" + "Z9" * 8 + "/a/path/of/plain/words/and/names") == []


def test_masking_removes_every_span(spark):
    t = 'x token = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638" y'
    df = spark.createDataFrame([(1, t, "k"), (2, "clean", None), (3, None, "k")], "doc_id long, text string, spans string")
    got = {r.doc_id: r.text for r in S.scan(df, PATH, P.PATTERN, mask=True).collect()}
    assert got == {1: 'x [SECRET]" y', 2: "clean", 3: None}
    assert S.scan(df.limit(0), PATH, P.PATTERN).count() == 0


def test_searches_find_what_the_patterns_find():
    """Runs and base spans by plain searches are those of the patterns, also where keys and runs touch or overlap."""
    bits = ["secret", "secretoken", "token", "PassWord", "passwd", "api_key", "APIkey", "=", ":", " ", '"', "AKIA", "0123456789abcdef", "deadbeef",
            "é", "K", "İ", "ſecret", "\n", "-", "_", "/", "+", ".", "XYZ09", "q8Zr7Lm", "abcdefghij", "🙂", "?", "ABCDEFGHIJKLMNOP"]
    rnd, runs = random.Random(11), 0
    for _ in range(5000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))
        found = S._runs(t.encode("ascii", "replace"))
        assert found == [m.span() for m in S.RUN.finditer(t)]
        runs += len(found)
        want = [(0, *m.span()) for m in S.ASSIGN.finditer(t) if len(m[2]) >= S.MIN_ASSIGN]
        want += [(1, *m.span()) for m in S.ACCESS.finditer(t) if len(m[0]) >= S.MIN_ACCESS]
        assert S.base_spans(t) == want + [(2, *m.span()) for m in S.HEX.finditer(t)]
    assert runs > 1000
