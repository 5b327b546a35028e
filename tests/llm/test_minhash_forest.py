import random
import re

import numpy as np
import pytest

from estimark.llm import components as C
from estimark.llm import minhash_forest as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 3 else frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2))


def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    edges = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1:]
             if s and t and 100 * len(s & t) >= 85 * len(s | t)]
    return components(edges)


def corpus(seed, n_bases=25, copies=6, rate=(0.0, 0.06)):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéz") for _ in range(rnd.randint(1, 6)))
    out = [None, "", " \n", "one", "One", "one two", "ONE  two", "one two three", "zwei", "É a", "é a"]
    for _ in range(n_bases):
        base = [word() for _ in range(rnd.randint(20, 200))]
        for _ in range(rnd.randint(1, copies)):
            p = rnd.uniform(*rate)
            w = [word() if rnd.random() < p else x for x in base]
            out.append(rnd.choice([" ", "\n", "  "]).join(w) if rnd.random() < 0.8 else " ".join(w).upper())
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,most", [(1, M.REGION), (2, 8)])
def test_equals_brute_force(spark, seed, most):
    rows = corpus(seed, rate=(0.0, 0.06) if most > 100 else (0.0, 0.012))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' component_id")
    got = {r.doc_id: r for r in M.near_duplicates(df, most=most).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].n_shingles == len(shingles(t))
        assert got[i].component_id == want.get(i, i), (i, t)
        assert got[i].kept == (want.get(i, i) == i)


def test_repeated_and_missing_ids(spark):
    a, b = "w1 w2 w3 w4 w5", "x1 x2 x3 x4 x5"
    rows = [(4, a), (4, b), (2, a), (3, b), (None, a), (9, None), (9, None)]
    got = sorted((repr(r.doc_id), r.component_id, r.kept) for r in
                 M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("4", 2, False), ("4", 2, False), ("2", 2, True), ("3", 2, False), ("None", None, True),
                          ("9", 9, True), ("9", 9, True)])
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_the_similarity():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.95, 0.85, 0.6):
        got = []
        for _ in range(40):
            other = rng.integers(1, 1 << 63, 1000, dtype=np.uint64)
            n = round(1000 * 2 * share / (1 + share))
            x = np.r_[base, base[:n], other[n:]]
            sig, _ = M._signatures(np.array([0, 1000]), x)
            got.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(got) - share) < 0.03


def test_components_on_paths_stars_and_cycles(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9), (9, 8)]
    edges += [(rnd.randint(1000, 1300), rnd.randint(1000, 1300)) for _ in range(250)]
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == components(edges)
    assert C.connected_components(spark.createDataFrame([(None, 1)], "u long, v long")).count() == 0


def changed(rnd, words, n, tag):
    """The words with ``n`` of them, three or more apart, replaced by new ones."""
    out, at = list(words), []
    while len(at) < n:
        p = rnd.randrange(2, len(words) - 2)
        if all(abs(p - q) > 2 for q in at):
            at.append(p)
            out[p] = f"{tag}x{n}x{len(at)}"
    return out


def test_a_star_of_distinct_variants(spark):
    """Over 2,000 variants that link with their base and not with one another, at the real REGION."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))] + [(k, " ".join(changed(rnd, base, 4, f"v{k}"))) for k in range(1, 2501)]
    sets = [shingles(t) for _, t in rows]
    assert all(100 * len(s & sets[0]) >= 85 * len(s | sets[0]) for s in sets)
    assert not any(100 * len(s & t) >= 85 * len(s | t) for s, t in zip(sets[1:], sets[2:]))
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.component_id != 0} == set()


def test_crowded_regions_keep_the_links(spark):
    """Links just above the threshold whose regions are crowded at every depth up to six values."""
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))] + [(k, " ".join(changed(rnd, base, 5, f"v{k}"))) for k in range(1, 601)]
    sets = [shingles(t) for _, t in rows]
    assert all(100 * len(s & sets[0]) >= 85 * len(s | sets[0]) for s in sets)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=200).collect()
    assert {r.doc_id for r in got if r.component_id != 0} == set()


def test_very_long_texts(spark):
    """Texts of millions of characters are compared whole: they differ at their ends only."""
    base = " ".join(f"w{i}" for i in range(250_000))
    rows = [(1, base), (2, base + " one more end"), (3, " ".join(f"w{i}" for i in range(100_000)) + " " + " ".join(f"x{i}" for i in range(150_000)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (249_998, 1), 2: (250_001, 1), 3: (249_998, 3)}


def test_walks_join_a_template_without_blocks(spark):
    """Variants of a template in one crowded region come out of the walk in one piece, whatever the block size."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(changed(rnd, base, 2, f"v{k}"))) for k in range(400)]
    nodes = M.signatures(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3).cache()
    placed = M.regions(nodes)
    crowded = placed.filter("n > 100")
    edges = M.walked(crowded, nodes.select("id", "n", "sig"), 85)
    whole = {r.node: r.component for r in C.connected_components(edges).collect()}
    inside = {r.id for r in crowded.select("id").distinct().collect()}
    assert inside and len({whole.get(i) for i in inside}) == 1
    assert edges.count() <= crowded.count()  # one edge a node and order at most
