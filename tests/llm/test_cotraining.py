import numpy as np
import pytest

from estimark.llm import cotraining as T
from estimark.llm import words as W
from estimark.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def test_fit_logistic_recovers_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))
    w = T.fit_logistic(x, (rng.random(4000) < p).astype(int), np.ones(4000), 1e-3)
    assert np.allclose(w, [2, -1, 0, 0.5], atol=0.2)


def over(ids, x, sure=0.95):
    """``surest`` by looking at all rows in this process."""
    return lambda models, given, want: [(v, label, int(ids[i]), (x[0][i], x[1][i]))
                                        for v, label, i in T.surest_rows(ids, x, models, given, want, sure)]


def whole(rows, told, rounds=5, handed=500):
    """The scores of every row, computed in one process from all rows at once."""
    import hashlib

    import pyarrow as pa
    (s,) = W.slices(pa.array([r[1] or "" for r in rows]))
    x = (T.content_features(s).astype(float), T.metadata_features(s, [r[2] for r in rows], [r[3] for r in rows]).astype(float))
    ids = np.array([r[0] for r in rows])
    seen = np.array([i for i in np.argsort(ids) if ids[i] in told])
    y = np.array([told[ids[i]] for i in seen])
    held = np.array([hashlib.md5(str(ids[i]).encode()).digest()[0] < 64 for i in seen])
    mean, scale = [v[seen].mean(0) for v in x], [v[seen].std(0) + 1e-3 for v in x]
    z = [np.clip((v - m) / d, -5, 5) for v, m, d in zip(x, mean, scale)]
    free = np.array([i for i in range(len(rows)) if ids[i] not in told])
    models = T.co_train((z[0][seen[~held]], z[1][seen[~held]]), y[~held], over(ids[free], (z[0][free], z[1][free])), rounds, handed)
    odds = np.stack([T.log_odds(v, m) for v, m in zip(z, models)], 1)
    ones = np.ones(held.sum())
    platt = [T.fit_logistic(odds[seen][held, i:i + 1], y[held], ones, 1e-2) for i in (0, 1)]
    c = np.stack([T.log_odds(odds[:, i:i + 1], platt[i]) for i in (0, 1)], 1)
    return dict(zip(ids.tolist(), 1 / (1 + np.exp(-np.clip(T.log_odds(c, T.fit_logistic(c[seen][held], y[held], ones, 1e-2)), -30, 30)))))


def small_corpus(n, seed):
    rng = np.random.default_rng(seed)
    good, bad = ["river", "stone", "the", "of", "green", "walks"], ["$$$", "buy", "NOW", "###", "click", "!!!"]
    rows, quality = [], {}
    for i in range(n):
        q = int(rng.random() < 0.6)
        words = rng.choice(good if q else bad, rng.integers(3, 12)).tolist() + rng.choice(good + bad, 2).tolist()
        rows.append((i, " ".join(words), "s%d" % (rng.random() < (0.8 if q else 0.3)), "en"))
        quality[i] = q
    return rows, quality


def test_equals_one_process_over_all_rows(spark):
    rows, quality = small_corpus(1500, 2)
    told = {i: q for i, q in quality.items() if i % 10 == 0}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    labels = spark.createDataFrame(list(told.items()), "doc_id long, quality int")
    got = {r.doc_id: r.score for r in T.quality_scores(df, labels, handed=60).collect()}
    want = whole(rows, told, handed=60)
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_all_unlabelled_documents_are_looked_through(spark):
    """The surest documents stand behind ten thousand others; every task brings forward its own."""
    rng = np.random.default_rng(4)
    n, ids = 12_000, np.arange(12_000)
    x = (rng.normal(size=(n, T.WIDTH + T.SHAPES + 3)).astype(np.float32), rng.normal(size=(n, T.META)).astype(np.float32))
    for v in x:
        v[11_950:, 0] = 40
    models = [np.r_[1.0, np.full(v.shape[1] - 1, 0.01), 0.0] for v in x]
    given, want = [set(), {11_999}], {1: 30, 0: 20}
    rows = [(int(i), bytearray(a.tobytes()), bytearray(b.tobytes())) for i, a, b in zip(ids, *x)]
    df = spark.createDataFrame(rows, "id long, content binary, meta binary").repartition(6)
    got = T.surest_of(df, models, given, want, lambda m, i: m, 0.95)
    mine = T.surest_rows(ids, tuple(v.astype(float) for v in x), models, given, want, 0.95)
    assert sorted(g[:3] for g in got) == sorted((v, label, int(ids[i])) for v, label, i in mine)
    assert {g[2] for g in got if g[1] == 1} <= set(range(11_950, 11_999 + 1)) and (0, 1, 11_999) not in [g[:3] for g in got]


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "s", "en"), (2, "short", "s", "en")], "doc_id long, text string, source string, lang string")
    got = T.quality_scores(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)


def test_views_teach_each_other():
    """Two independent views, few labels: exchanged pseudo-labels beat the labels alone."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 3000)
    make = lambda d: rng.normal(size=(3000, d)) + np.outer(2 * y - 1, np.full(d, 0.9 if d < 8 else 0.25))
    a, b = make(6), make(40)
    few, pool, test = np.r_[np.flatnonzero(y == 1)[:15], np.flatnonzero(y == 0)[:15]], slice(100, 2000), slice(2000, 3000)
    models = T.co_train((a[few], b[few]), y[few], over(np.arange(1900), (a[pool], b[pool])))
    alone = T.co_train((a[few], b[few]), y[few], lambda *_: [])
    good = lambda m: ((T.log_odds(b[test], m) > 0) == y[test]).mean()
    assert good(models[1]) > good(alone[1]) + 0.02


def test_held_out_accuracy(spark):
    docs = read_table(spark, SF, "documents", "doc_id", "text", "source", "lang")
    labels = read_table(spark, SF, "labels").select("doc_id", "quality")
    train, test = labels.filter("doc_id % 3 <> 0"), {r.doc_id: r.quality for r in labels.filter("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r for r in T.quality_scores(docs.selectExpr("*", "1 score"), train).collect()}
    assert len(got) == docs.count()
    right = np.mean([got[i].kept == bool(q) for i, q in test.items()])
    good = np.mean([got[i].kept for i, q in test.items() if q])
    print("accuracy", right, "good kept", good)
    assert right >= 0.9 and good >= 0.95
    again = {r.doc_id: r.score for r in T.quality_scores(docs.repartition(3), train).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (1, 0), (2, None), (None, 0), (77, 0)], [(1, 1), (2, 0), (3, 1)]])
def test_odd_tables(spark, labels):
    rows = [(1, "a b c", "s", "en"), (2, None, None, None), (2, "", "s", None), (None, "x " * 5000, "t", "de"), (3, "é\n\nü", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    got = T.quality_scores(docs, told).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert T.quality_scores(docs.limit(0), told).count() == 0


def test_features_do_not_depend_on_the_batch():
    import pyarrow as pa
    texts = ["", "One two\ntwo", "äö ||| !!", "\n\n\n", "x" * 3000]
    (whole,) = W.slices(pa.array(texts))
    for i, t in enumerate(texts):
        (one,) = W.slices(pa.array([t]))
        assert np.allclose(T.content_features(whole)[i], T.content_features(one)[0])
        assert np.allclose(T.metadata_features(whole, ["s"] * 5, [None] * 5)[i], T.metadata_features(one, ["s"], [None])[0])
