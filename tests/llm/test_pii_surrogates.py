import random
import re

import pytest

from estimark.llm import pii_surrogates as P

SCHEMA = "doc_id long, text string"


def luhn(d):
    t = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(t)) % 10 == 0


def run(spark, texts, key="k1"):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r.doc_id: r for r in P.pseudonymised(df, key).collect()}


def test_formats_and_coreference(spark):
    texts = ["Write to Ann.Lee22@mail3.example.com or ann.lee22@MAIL3.example.com!", "call +1 (361) 555-8283, +13615558283; or 361-555-8283",
             "card 4111 1111 1111 1111 and 4111111111111111 but 4111111111111112", "host 106.158.249.239.", "ssn 123-45-6789",
             "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013000", "Mr John Smith met Mrs Smith and Ms Anna Smith. Dr Smith too",
             "Господин Иван Петров и Госпожа Петров", None, "", "token = e7fbfec6a80404dc513b99d3fdbf2a6e53400638 v 1.2.3 at 12:30",
             "call +1 (361) 555-8283, +13615558283; or 361-555-8283"]
    got = run(spark, texts)
    t = {i: r.text for i, r in got.items()}
    a, b = re.findall(r"\S+@\S+\.com", t[0])
    assert a == b and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d\d@[a-z]{4}\d\.[a-z]{7}\.com", a) and "ann.lee22" not in a
    assert t[0].endswith("!") and t[0].startswith("Write to ")
    p = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}), \+1(\d{10}); or \d{3}-\d{3}-\d{4}", t[1])
    assert p and p[1] + p[2] + p[3] == p[4] != "3615558283"
    c = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}) but (\d{16})", t[2])
    assert c[1].replace(" ", "") == c[2] and luhn(c[2]) and not luhn("4111111111111112") and c[2] != c[3] and c[2][0] == "4"
    assert re.fullmatch(r"host \d+\.\d+\.\d+\.\d+\.", t[3]) and "106.158" not in t[3]
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", t[4]) and t[4] != texts[4]
    i = re.fullmatch(r"IBAN (DE\d\d( \d{4}){4} \d\d) and (DE\d{20})", t[5])
    assert i[1].replace(" ", "") == i[3]
    m = re.fullmatch(r"Mr (\w+rick) (\w+) met Mrs (\w+) and Ms (\w+lina) (\w+)\. Dr (\w+) too", t[6])
    assert m and m[2] == m[3] == m[5] == m[6] and "Smith" not in t[6]
    r = re.fullmatch(r"Господин (\w+слав) (\w+енко) и Госпожа (\w+енко)", t[7])
    assert r and r[2] == r[3]
    assert t[8] is None and t[9] == "" and t[10] == texts[10] and got[10].n_entities == 0
    assert t[11] == t[1] and got[1].n_entities == 3
    other = run(spark, texts, "k2")
    assert other[3].text != t[3] and run(spark, texts)[3].text == t[3]


def test_distinct_entities_stay_distinct(spark, monkeypatch):
    """In a space that is nearly full, every entity still gets a surrogate of its own that is no original."""
    originals = [f"a{i}@x.io" for i in range(10)] + [f"b{c}@x.io" for c in "abcdefgh"]
    got = run(spark, [f"see {o} now" for o in originals] * 2)
    new = [got[i].text.split()[1] for i in range(len(originals))]
    assert len(set(new)) == len(originals) and not set(new) & set(originals)
    assert all(got[i].text == got[i + len(originals)].text for i in range(len(originals)))


def test_collisions_draw_again(spark):
    """Two-digit hosts: 26 * 10 forms for 120 entities need more than one attempt."""
    rnd = random.Random(1)
    forms = sorted({f"{rnd.choice('abcdefghijklmnopqrstuvwxyz')}{rnd.randint(0, 9)}" for _ in range(160)})[:100]
    ents = spark.createDataFrame([("ssn", f"{f}") for f in forms], "kind string, norm string")
    rows = P.surrogates(ents, "key").collect()
    new = [r.surrogate for r in rows]
    assert len(rows) == len(forms) == len(set(new)) and not set(new) & set(forms)


def test_very_long_and_empty(spark):
    text = "x" * 300_000 + " " + "1" * 200_000 + " a@b.co " + "é " * 100_000
    got = run(spark, [text])
    assert got[0].n_entities == 1 and "a@b.co" not in got[0].text and len(got[0].text) == len(text)
    df = spark.createDataFrame([(1, "a@b.co", "e", "q")], "doc_id long, text string, n_entities string, md5 string")
    assert P.pseudonymised(df, "k").columns == ["doc_id", "text", "md5", "n_entities"]
    assert P.pseudonymised(df.limit(0), "k").count() == 0


def plain(texts, key):
    """The operator in one process: entities, keyed draws with collision rounds, mentions rewritten."""
    import hashlib

    import regex

    kinds = [(k, regex.compile(p)) for k, p in P.PATTERNS]
    any_entity, hint = regex.compile(P.ANY), regex.compile("[@0-9]")
    titles = [t for ts in P.TITLES.values() for t in ts]

    def entities(m, kind):
        if kind == "person":
            title = regex.match(r"\p{L}+", m)[0]
            given = "given_m" if title in P.TITLES["m"] else "given_f" if title in P.TITLES["f"] else "given_u"
            names = m.split(" ")[1:]
            return [("family" if i == len(names) - 1 else given, x.lower()) for i, x in enumerate(names)]
        norm = {"email": m.lower(), "ip": m, "phone": re.sub("[^0-9+]", "", m)}.get(kind, re.sub("[ -]", "", m))
        return [(kind, norm)]

    def surrogate(kind, norm, attempt):
        s = "".join(hashlib.sha256("\x1f".join([key, kind, norm, f"{attempt}.{i}"]).encode()).hexdigest() for i in range(4))
        byte = lambda i: int(s[i * 2 % 256:i * 2 % 256 + 2], 16)

        def shaped(x, kept):
            return "".join(c if i < kept else str(byte(i) % 10) if c in "0123456789" else chr(byte(i) % 26 + 97) if "a" <= c <= "z"
                           else chr(byte(i) % 26 + 65) if "A" <= c <= "Z" else c for i, c in enumerate(x))
        if kind == "email":
            local, domain = norm.split("@")[0], norm.split("@")[-1]
            top = "." + domain.split(".")[-1]
            return shaped(local + "@" + domain[:len(domain) - len(top)], 0) + top
        if kind == "ip":
            return ".".join(str(byte(i) % 254 + 1) for i in range(4))
        if kind == "card":
            drawn = shaped(norm, 1)
            return next(drawn[:-1] + c for c in "0123456789" if luhn(drawn[:-1] + c)) if luhn(norm) else drawn
        if kind in ("phone", "iban", "ssn"):
            return shaped(norm, 2 if kind == "iban" or kind == "phone" and norm.startswith("+") else 0)
        script = "cyrillic" if regex.search(r"\p{IsCyrillic}", norm) else "greek" if regex.search(r"\p{IsGreek}", norm) else "latin"
        return "".join(P.SYLLABLES[script][byte(i) % 16] for i in range(3 + attempt)) + P.ENDINGS[script][kind]

    def drawn(all_entities):
        left, done, attempt = set(all_entities), {}, 0
        while left:
            new = {e: surrogate(*e, attempt) for e in left}
            used = {(k, s) for (k, _), s in done.items()}
            good = {e: s for e, s in new.items() if (e[0], s) not in all_entities and (e[0], s) not in used
                    and e[1] == min(n for (k, n), t in new.items() if k == e[0] and t == s)}
            done, left, attempt = done | good, left - set(good), attempt + 1
        return done

    def written(m, kind, got):
        if kind == "person":
            return m.split(" ")[0] + " " + " ".join(x[:1].upper() + x[1:] for x in got)
        if kind == "email":
            return got[0].upper() if m == m.upper() else got[0]
        if kind == "ip":
            return got[0]
        signs, out, i = (lambda c: c in "0123456789+") if kind == "phone" else (lambda c: c not in " -"), "", 0
        for c in m:
            out, i = (out + got[0][i:i + 1], i + 1) if signs(c) else (out + c, i)
        return out

    found = [[m[0] for m in any_entity.finditer(t)] if t and (hint.search(t) or any(x in t for x in titles)) else [] for t in texts]
    kind_of = {m: next(k for k, p in kinds if p.fullmatch(m)) for ms in found for m in ms}
    table = drawn({e for m, k in kind_of.items() for e in entities(m, k)})
    new = {m: written(m, k, [table[e] for e in entities(m, k)]) for m, k in kind_of.items()}
    return [(any_entity.sub(lambda m: new[m[0]], t) if ms else t, len(ms)) for t, ms in zip(texts, found)]


def test_query_equals_one_process(spark):
    from estimark.llm.queries import QUERIES
    from estimark.sources.tables import read_table
    rows = read_table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, plain([r.text for r in rows], "estimark-production"))}
    got = {r.doc_id: (r.text, r.n_entities) for r in QUERIES["op3_pii_surrogates"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and sum(n for _, n in got.values()) > 20


def test_hand_made_texts_equal_one_process(spark):
    texts = [f"see a{i}@x.io, B{i}@X.IO and 10.0.0.{i}" for i in range(12)] + [
        "Mr John Smith met Mrs Anna-Lena O’Brien; Dr Smith. Господин Иван Петров, Κυρία Μαρία Παππά", "DE89 3704 0044 0532 0130 00 / +49 30 1234567",
        "4111-1111-1111-1111 4111111111111112 (361) 555-8283 361.555.8283 123-45-6789", None, "", "no entity at all"]
    got = run(spark, texts)
    assert [(got[i].text, got[i].n_entities) for i in range(len(texts))] == plain(texts, "k1")
