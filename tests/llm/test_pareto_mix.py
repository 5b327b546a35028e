import random
from collections import defaultdict

from estimark.llm import pareto_mix as X


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by the rule read literally: share out, stop at the limit, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, room, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if most * sizes[s] < w[s] * room / total}
        if not over:
            for s in open_:
                target[s] = w[s] * room / total
            break
        for s in over:
            target[s] = most * sizes[s]
            room -= target[s]
        open_ -= over
    return target


def docs(seed, n=600):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        src = rnd.choice(["a", "b", "z", "é", "A", None, "b", "b", "b"])
        out.append((i, " ".join(["w"] * int(rnd.paretovariate(1.1))) if rnd.random() < 0.95 else None, src))
    return out + [(n, "w " * 20000, "a"), (n + 1, "", "empty"), (None, "x y", "a"), (n + 2, "r s t", "z"), (n + 2, "r s t", "z")]


def test_targets_and_taken(spark):
    rows = docs(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'k' size", "1 target")
    got = X.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    want = fill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1, s
    assert sorted(map(repr, got)) == sorted(map(repr, X.mix(df.repartition(5)).collect()))


def test_mixed_repeats_rows_as_taken(spark):
    df = spark.createDataFrame(docs(4, 200), "doc_id long, text string, source string")
    mixed = X.mixed(df)
    assert mixed.columns == df.columns
    got, want = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += len((r.text or "").split())
    for r in X.mix(df).collect():
        want[r.doc_id] += r.taken
    assert dict(got) == {k: v for k, v in want.items() if v}


def test_inclusion_follows_size(spark):
    """Documents of a size are included about as often as their odds say."""
    rows = [(i, " ".join(["w"] * (1 + i % 40)), "s") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hits = defaultdict(int)
    for r in X.mix(df, weights=(1,), share=0.5).collect():
        hits[r.size] += r.copies
    small, large = (sum(hits[s] for s in span) / (50 * len(span)) for span in (range(1, 11), range(31, 41)))
    assert small < 0.4 and 0.55 < large < 0.85


def test_empty_tables(spark):
    assert X.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    only = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in X.mix(only).collect()] == [(0, 0.0, 0)]
