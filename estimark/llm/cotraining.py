"""Quality classifier by co-training two views of a document.

The content view sees the text (hashed words and character shapes), the
metadata view sees what a page carries beside its wording: source, language,
length and layout.  Each view has its own logistic model.  In every round both
models score all unlabelled documents, and each labels those it is most sure
of, in proportion to the classes, and hands them to the *other* model as
pseudo-labels; both are then fitted again.  Finally each view is calibrated on
held-out labelled documents (Platt scaling), and the two calibrated log-odds
are combined, with weights fitted on the held-out documents too, to score every
document.

Features (``WIDTH`` + ``SHAPES`` + 3 and ``META`` numbers) are computed once and
written.  Fitting uses at most ``max_labelled`` labelled documents, the first by
a digest of the doc_id (documented bound), and per round and view the
``handed`` surest of all unlabelled ones: every task brings forward its own
surest, and the surest of these are collected.  Scoring covers all documents.

Defined cases: a null or empty text has no words and its layout's features; texts
of any length are read whole; null source or language is a value of its own;
documents without a label are handed pseudo-labels, labels for an unknown
doc_id are ignored; rows without doc_id are scored only; repeated rows of a
doc_id are handed over once; repeated labels of a doc_id count as their mean rounded
up (quality 1 wins a tie); without labels of both classes every score is the
share of good labels (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estimark.llm import words as W
from estimark.session import materialize

WIDTH, SHAPES = 256, 12  # hashed word features; counts of character shapes
META = 40
_CLASSES = np.zeros(256, np.int64)  # byte classes of the shape features
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!",
                             b"#*$%&", b"|<>{}[]()/\\", b"'\"-_", b"@=+~^`"), 1):
    _CLASSES[list(_chars)] = _i
_CLASSES[128:] = 10
_CLASSES[W.SPACE] = 11


def content_features(s: W.Slice) -> np.ndarray:
    """(n, WIDTH + SHAPES + 3): log counts of hashed words, shares of byte classes, repetition, length of words."""
    n = s.n
    doc, h = s.word_doc(), s.word_hashes(lower=True)
    words = np.bincount(doc * WIDTH + (h % np.uint64(WIDTH)).astype(np.int64), minlength=n * WIDTH).reshape(n, WIDTH)
    count = np.maximum(np.diff(s.word_offs), 1)[:, None]
    at = np.repeat(np.arange(n), np.diff(s.offs))
    shapes = np.bincount(at * SHAPES + _CLASSES[s.data], minlength=n * SHAPES).reshape(n, SHAPES)
    size = np.maximum(np.diff(s.offs), 1)[:, None]
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    repeats = np.bincount(doc[order][same], minlength=n)[:, None] / count
    nearby = np.zeros(len(h), bool)
    nearby[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    twins = np.bincount(doc[nearby], minlength=n)[:, None] / count
    length = (size - shapes[:, 11:12]) / count
    return np.hstack([np.sqrt(words / count), np.sqrt(shapes / size), repeats, twins, np.log1p(length)]).astype(np.float32)


def metadata_features(s: W.Slice, source: list, lang: list) -> np.ndarray:
    """(n, META): hashed source and language, length, and layout (lines, blank lines, line lengths)."""
    n = s.n
    out = np.zeros((n, META), np.float32)
    for i in range(n):
        for at, v, m in ((0, source[i], 16), (16, lang[i], 8)):
            out[i, at + (hashlib.md5(repr(v).encode()).digest()[0] % m)] = 1
    size = np.diff(s.offs)
    breaks = np.concatenate(([0], np.cumsum(s.data == 10)))
    lines = breaks[s.offs[1:]] - breaks[s.offs[:-1]] + 1
    blank = np.zeros(len(s.data) + 1, np.int64)
    if len(s.data):
        pair = (s.data[1:] == 10) & (s.data[:-1] == 10)
        blank[2:] = np.cumsum(pair)
    words = np.diff(s.word_offs)
    log = np.log1p(size)
    bucket = np.clip(log.astype(int), 0, 11)
    out[np.arange(n), 24 + bucket] = 1
    out[:, 36] = log / 10
    out[:, 37] = np.log1p(words / lines)
    out[:, 38] = (blank[s.offs[1:]] - blank[s.offs[:-1]]) / lines
    out[:, 39] = np.log1p(lines) / 5
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression (last: intercept) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, surest, rounds: int = 5, handed: int = 500) -> list[np.ndarray]:
    """One model per view.  ``surest(models, given, want)`` looks through all unlabelled documents for those that each
    model is most sure of: rows (view, label, id, (content, meta)), at most ``want[label]`` per view and label, none
    that the other view has been given already (``given``, ids by view).  Every round each model hands its own on."""
    given: list[dict] = [{}, {}]  # per view: id to (label, features), as received from the other
    balance = np.where(y == 1, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (1 - y).sum(), 1))
    side = np.array([balance[y == 0].max(initial=1.0), balance[y == 1].max(initial=1.0)])
    want = {label: max(1, int(handed * share)) for label, share in ((1, y.mean()), (0, 1 - y.mean()))}

    def fit(v: int) -> np.ndarray:
        told = [given[v][i] for i in sorted(given[v])]
        z = np.array([label for label, _ in told], int)
        x = np.vstack([views[v], *(f[v][None, :] for _, f in told)])
        return fit_logistic(x, np.concatenate([y, z]), np.concatenate([balance, 0.5 * side[z]]))

    models = [fit(0), fit(1)]
    for _ in range(rounds):
        moved = surest(models, [set(g) for g in given], want)
        if not moved:
            break
        for v, label, i, both in moved:
            given[1 - v].setdefault(i, (label, both))
        models = [fit(0), fit(1)]
    return models


def surest_rows(ids, x: tuple[np.ndarray, np.ndarray], models, given, want, sure: float) -> list[tuple[int, int, int]]:
    """(view, label, row) of the rows that the models are surest of: by log-odds, then by id; each id once."""
    out = []
    for v in (0, 1):
        odds = log_odds(x[v], models[v])
        for label, sign in ((1, 1.0), (0, -1.0)):
            able = np.flatnonzero(sign * odds >= np.log(sure / (1 - sure)))
            taken: set = set()
            for i in able[np.lexsort((ids[able], -sign * odds[able]))].tolist():
                if len(taken) == want[label]:
                    break
                if ids[i] not in given[1 - v] and ids[i] not in taken:
                    taken.add(ids[i])
                    out.append((v, label, i))
    return out


def features(docs: DataFrame, key: str, text: str, source: str, lang: str) -> DataFrame:
    """(id, content, meta) per row."""
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"), F.col(source).cast("string"), F.col(lang).cast("string"))

    def run(batches):
        for b in batches:
            src, lng = b.column(2).to_pylist(), b.column(3).to_pylist()
            for s in W.slices(b.column(1)):
                at = slice(s.first, s.first + s.n)
                x, m = content_features(s), metadata_features(s, src[at], lng[at])
                blobs = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, m)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n), *blobs], ["id", "content", "meta"])

    return W.map_batches(rows, run, "id long, content binary, meta binary")


def _views(rows) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([np.frombuffer(r[c], np.float32) for r in rows]).reshape(len(rows), -1).astype(float)
                 for c in ("content", "meta"))


def surest_of(unlabelled: DataFrame, models, given, want, standard, sure: float) -> list:
    """``surest_rows`` over all of ``unlabelled`` (id, content, meta): every task brings forward its own, and Spark
    ranks those; (view, label, id, standardised features) of at most ``want`` rows a view and label come back."""

    def run(batches):
        held: list = []  # (view, label, odds, id, content, meta) so far

        def best(rows):
            rows, out, n = sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3])), [], {}
            for r in rows:
                if n.get(r[:2], 0) < want[r[1]] and (not out or out[-1][:4] != r[:4]):
                    n[r[:2]] = n.get(r[:2], 0) + 1
                    out.append(r)
            return out

        for b in batches:
            ids, content, meta = b.column(0).to_numpy(), b.column(1), b.column(2)
            x = [np.frombuffer(b"".join(c.to_pylist()), np.float32).reshape(len(ids), -1).astype(float) for c in (content, meta)]
            x = tuple(standard(m, i) for i, m in enumerate(x))
            odds = [log_odds(x[v], models[v]) for v in (0, 1)]
            held = best(held + [(v, label, float(odds[v][i] if label else -odds[v][i]), int(ids[i]), content[i].as_py(), meta[i].as_py())
                                for v, label, i in surest_rows(ids, x, models, given, want, sure)])
        if held:
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)],
                                             ["view", "label", "odds", "id", "content", "meta"])

    own = W.map_batches(unlabelled, run, "view int, label int, odds double, id long, content binary, meta binary")
    once = F.row_number().over(Window.partitionBy("view", "label", "id").orderBy(F.desc("odds"), "content", "meta"))
    own = own.withColumn("once", once).filter("once = 1")
    rank = F.row_number().over(Window.partitionBy("view", "label").orderBy(F.desc("odds"), "id"))
    rows = own.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("label") == 1, want[1]).otherwise(want[0]))
    rows = rows.orderBy("view", "label", "rank").collect()  # bounded by ``handed``
    x = _views(rows) if rows else ()
    x = tuple(standard(m, i) for i, m in enumerate(x))
    return [(r["view"], r["label"], r["id"], (x[0][k], x[1][k])) for k, r in enumerate(rows)]


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                   lang: str = "lang", label: str = "quality", max_labelled: int = 10_000, handed: int = 500,
                   rounds: int = 5, sure: float = 0.95, keep_at: float = 0.5) -> DataFrame:
    """(key, score, content_score, meta_score, kept) per row of ``docs``."""
    told = (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("__id"))
            .agg((F.avg(label) >= 0.5).cast("int").alias("y")))
    table = features(docs, key, text, source, lang)
    table = materialize(table.join(told, F.col("id") == F.col("__id"), "left").drop("__id"))
    seen = table.filter("y IS NOT NULL").select("id", "y").distinct().orderBy(F.xxhash64(F.lit("fit"), "id"), "id").limit(max_labelled)
    seen = table.join(F.broadcast(seen.select("id")), "id").dropDuplicates(["id"]).orderBy("id").collect()
    y = np.array([r["y"] for r in seen], int)
    kind = docs.schema[key].dataType
    if len(set(y.tolist())) < 2:
        score = F.lit(float(y.mean()) if len(y) else 0.5)
        return table.select(F.col("id").cast(kind).alias(key), score.alias("score"), score.alias("content_score"),
                            score.alias("meta_score"), (score >= keep_at).alias("kept"))
    views = _views(seen)
    held = np.array([hashlib.md5(str(r["id"]).encode()).digest()[0] < 64 for r in seen])  # a quarter calibrates
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.ones(len(y), bool)
        fit = held
    else:
        fit = ~held
    mean = [v.mean(0) for v in views]
    scale = [v.std(0) + 1e-3 for v in views]
    z = lambda v, i: np.clip((v - mean[i]) / scale[i], -5, 5)
    unlabelled = table.filter("y IS NULL AND id IS NOT NULL").select("id", "content", "meta")
    models = co_train(tuple(z(v[fit], i) for i, v in enumerate(views)), y[fit],
                      lambda m, given, want: surest_of(unlabelled, m, given, want, z, sure), rounds, handed)
    odds = np.stack([log_odds(z(v, i), models[i]) for i, v in enumerate(views)], 1)
    ones = np.ones(held.sum())
    platt = [fit_logistic(odds[held, i:i + 1], y[held], ones, 1e-2) for i in (0, 1)]
    calibrated = np.stack([log_odds(odds[:, i:i + 1], platt[i]) for i in (0, 1)], 1)
    both = fit_logistic(calibrated[held], y[held], ones, 1e-2)

    def run(batches):
        sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
        for b in batches:
            n = b.num_rows
            raw = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(n, -1) for c in (1, 2)]
            c = np.stack([log_odds(log_odds(z(x, i), models[i])[:, None], platt[i]) for i, x in enumerate(raw)], 1)
            cols = [sig(log_odds(c, both)), sig(c[:, 0]), sig(c[:, 1])]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols), pa.array(cols[0] >= keep_at)],
                                             [key, "score", "content_score", "meta_score", "kept"])

    out = W.map_batches(table.select("id", "content", "meta"), run,
                        f"`{key}` long, score double, content_score double, meta_score double, kept boolean")
    return out.withColumn(key, F.col(key).cast(kind))
