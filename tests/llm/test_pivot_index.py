import numpy as np
import pytest

from estimark.llm import pivot_index as P

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.93):
    """(links, component) per row position."""
    ok = []
    for _, x, lab in rows:
        good = lab is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)
        ok.append(np.array(x, np.float32).astype(float) if good else None)
    n, links = len(rows), np.zeros(len(rows), int)
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                if ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= least:
                    links[i] += 1
                    links[j] += 1
                    up[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return links.tolist(), [None if rows[i][0] is None else low[find(i)] for i in range(n)]


def near(rng, x, cos):
    y = rng.normal(size=len(x))
    y -= (y @ x) * x
    return cos * x + np.sqrt(1 - cos * cos) * y / np.linalg.norm(y)


def sample(seed, n=150, d=64):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=d)
        x /= np.linalg.norm(x)
        lab = int(rng.integers(0, 3))
        rows.append((len(rows), x.tolist(), lab))
        for _ in range(int(rng.integers(0, 5))):
            rows.append((len(rows), near(rng, x, rng.uniform(0.95, 0.999)).tolist(), lab))
        if i % 10 == 0:
            rows.append((len(rows), x.tolist(), lab))
            rows.append((len(rows), (x * 3).tolist(), lab))
    return rows


@pytest.mark.parametrize("block,per_pivot", [(P.BLOCK, P.PER_PIVOT), (16, P.PER_PIVOT), (16, 4)])
def test_equals_brute_force(spark, block, per_pivot):
    rows = sample(1)
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0] * 63 + [float("inf")], [None] + [1.0] * 63]
    rows += [(1000 + i, x, 1) for i, x in enumerate(odd)] + [(2000, rows[0][1], None), (None, rows[0][1], rows[0][2])]
    rows += [(3000 + i, [-0.0, 1.0] + [0.0] * 62, 2) for i in range(40)]  # a vector that many rows repeat
    links, component = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L n_links")
    got = sorted(map(repr, (tuple(r) for r in P.near_vectors(df, block=block, per_pivot=per_pivot).collect())))
    want = [(rows[i][0], links[i], component[i], rows[i][0] is None or component[i] == rows[i][0]) for i in range(len(rows))]
    assert got == sorted(map(repr, want))


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, in a label of 4,000 vectors, are found."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(2000):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, near(rng, x, 0.9305).tolist(), 0)]
    got = {r.vec_id: r.component_id for r in P.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(got[2 * i + 1] == got[2 * i] for i in range(2000))
    print("recall", found / 2000)
    assert found >= 0.97 * 2000


def test_empty(spark):
    assert P.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    one = P.near_vectors(spark.createDataFrame([(5, None, None)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(5, 0, 5, True)]


def test_labels_of_two(spark):
    rows = [(i, [1.0, float(i % 2) / 10, 0.0], i // 2) for i in range(20)]
    got = P.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.n_links == 1 and r.component_id == r.vec_id - r.vec_id % 2 for r in got)


def test_labels_of_mixed_lengths(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in (8, 16, 32):
        for _ in range(20):
            x = rng.normal(size=d)
            x /= np.linalg.norm(x)
            rows += [(len(rows), x.tolist(), 0), (len(rows) + 1, near(rng, x, 0.97).tolist(), 0)]
    links, component = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in P.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: (links[i], component[i]) for i, r in enumerate(rows)}


def test_dense_group_of_a_third_of_a_label(spark):
    """Every link among 1,000 vectors around one centre (pairs at about 0.94), in a label of 3,000, is counted."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:1000] = [near(rng, x[0], 0.97) for _ in range(1000)]
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r.n_links for r in P.near_vectors(df).collect()}
    assert [got[i] for i in range(3000)] == want.tolist()


@pytest.mark.parametrize("dense,total,cos", [(20_000, 20_000, 0.966), (5_000, 30_000, 0.97), (3_000, 9_000, 0.966)])
def test_links_of_large_dense_groups_share_pivots(dense, total, cos):
    """Nearly all links inside a dense group of any size name a common pivot; descriptions stay short."""
    rng = np.random.default_rng(dense)
    x = rng.normal(size=(total, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=(dense, 64))
    noise -= (noise @ x[0])[:, None] * x[0]
    x[:dense] = cos * x[0] + np.sqrt(1 - cos * cos) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    pivots = x[rng.permutation(total)[: total // P.PER_PIVOT]]
    some = rng.choice(dense, 1000, replace=False)
    names = P.name_pivots(x[some] @ pivots.T, 0.93, P.NAMED)
    held = np.zeros((1000, max(int(v.max()) for v in names) + 1), np.float32)
    for i, v in enumerate(names):
        held[i, v] = 1
    links = np.triu(x[some] @ x[some].T >= 0.93, 1)
    recall = (links & (held @ held.T > 0)).sum() / links.sum()
    print("links", links.sum(), "recall", recall, "named", np.mean([len(v) for v in names]))
    assert recall >= 0.999 and max(map(len, names)) <= P.NAMED * 12
