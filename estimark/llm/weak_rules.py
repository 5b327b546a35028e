"""Quality rules as weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a whole text.  A
generative model with one accuracy per rule and one share of good documents
is fitted by expectation-maximisation to the votes of *all* documents; a
document is kept when its posterior probability of being good is at least
``keep_at``.  EM only needs how often each combination of votes occurs: at
most 3 ** (number of rules) rows whatever the corpus, so that table is
gathered and the iterations run on it, while counting and scoring stay in
Spark.

Defined cases: a null or empty text has no words, fails the base rule and is
not kept; repeated rows and rows without doc_id are judged like any other;
an empty table gives an empty result; columns of the input are not needed
beyond the key and the text (``judge`` keeps them all, and replaces columns
of its own names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm import words as W
from estimark.session import materialize

WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUATION = (np.arange(256) & 0xC0) == 0x80
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xF5] = True  # lead bytes of longer characters
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?)\"'")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
            "n_distinct", "n_odd")

#: (name, numerator, denominator, good when at most, bad when at least): a ratio in between abstains, as does a text
#: without the denominator.
RULES = (
    ("symbols", "n_symbols", "n_words", 0.05, 0.20),
    ("odd_words", "n_odd", "n_words", 0.10, 0.40),
    ("shouting", "n_upper", "n_letters", 0.15, 0.60),
    ("repeats", "n_repeat_words", "n_words", 0.05, 0.20),
    ("dup_lines", "n_dup_lines", "n_lines", 0.10, 0.50),
    ("brevity", "brief", "n_words", 0.0, 1.0),
)


def _dups(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order that brings equal (doc, h) together, and a flag per sorted entry: equal to the entry before."""
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    d, x = doc[order], h[order]
    same[1:] = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
    return order, same


def measure_slice(s: W.Slice) -> dict[str, np.ndarray]:
    """The measures of each text of a slice, from its whole bytes."""
    n, data = s.n, s.data
    out = {k: np.zeros(n, np.int64) for k in MEASURES}
    out["n_words"] = np.diff(s.word_offs)
    if not len(data):
        return out

    def per_doc(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[s.offs[1:]] - c[s.offs[:-1]]

    out["word_chars"] = per_doc(~W.SPACE[data] & ~_CONTINUATION[data])
    out["n_symbols"] = per_doc(_SYMBOL[data])
    out["n_upper"] = per_doc(_UPPER[data])
    out["n_letters"] = per_doc(_LETTER[data])
    wd, h = s.word_doc(), s.word_hashes()
    # a word is odd unless it ends in a letter, or in one mark after a letter, and begins with a letter
    last, ahead = data[s.ends - 1], data[np.maximum(s.ends - 2, 0)]
    letter = _LETTER | _CONTINUATION
    plain = letter[data[s.starts]] & (letter[last] | (_MARK[last] & letter[ahead] & (s.ends - s.starts > 1)))
    out["n_odd"] = np.bincount(wd[~plain], minlength=n)
    order, same = _dups(wd, h)
    out["n_distinct"] = out["n_words"] - np.bincount(wd[order][same], minlength=n)
    # lines: cut at \n and at text ends; only those with a word count
    brk = np.flatnonzero(data == 10)
    ls = np.union1d(s.offs[:-1][s.offs[:-1] < len(data)], brk + 1)
    ls = ls[ls < len(data)]
    le = np.concatenate((ls[1:], [len(data)]))
    le = np.where(data[le - 1] == 10, le - 1, le)
    le = np.maximum(le, ls)
    has = np.searchsorted(s.starts, le) > np.searchsorted(s.starts, ls)
    ls, le = ls[has], le[has]
    ld = np.searchsorted(s.offs, ls, "right") - 1
    order, same = _dups(ld, W.span_hashes(data, ls, le))
    out["n_lines"] = np.bincount(ld, minlength=n)
    out["n_dup_lines"] = np.bincount(ld[order][same], minlength=n)
    # words in windows found twice or more
    first, doc, wh = W.windows(s, h, WINDOW)
    order, same = _dups(doc, wh)
    twice = same.copy()
    twice[:-1] |= same[1:]
    cover = np.zeros(len(s.starts) + 1, np.int64)
    at = first[order][twice]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    c = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    out["n_repeat_words"] = c[s.word_offs[1:]] - c[s.word_offs[:-1]]
    return out


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, MEASURES) per row, from whole texts in Arrow batches."""
    return _measured(docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text")), key, lambda b: b.column(1))


def _measured(rows: DataFrame, key: str, pick) -> DataFrame:
    """(key, MEASURES): the first column, and the measures of the texts that ``pick`` finds in a batch."""
    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)

    def run(batches):
        for b in batches:
            parts = [measure_slice(s) for s in W.slices(pick(b))]
            cols = [np.concatenate([p[m] for p in parts]) if parts else np.empty(0, np.int64) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], [key, *MEASURES])

    return W.map_batches(rows, run, schema)


def vote_columns() -> list:
    """One byte column per rule: 1 good, -1 bad, 0 abstains."""
    n = F.col("n_words")
    made = {
        "brief": F.when(n < 20, n).otherwise(0),
    }
    out = []
    for name, top, bottom, good, bad in RULES:
        ratio = made.get(top, F.col(top)) / F.col(bottom)
        vote = F.when(ratio <= good, 1).when(ratio >= bad, -1).otherwise(0)
        out.append(F.when(F.col(bottom) > 0, vote).otherwise(0).cast("int").alias(f"v_{name}"))
    return out


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, tol: float = 1e-10,
                   false_alarm: float = 0.02, praise: float = 2.0) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote combinations.

    ``patterns`` (p, r) in {-1, 0, 1}, ``counts`` (p,).  Given the true class
    the rules vote independently; when rule j does not abstain it calls a bad
    document bad with probability ``bad[0, j]`` and a good one with ``bad[1, j]``
    (its two error rates, estimated from all documents).  Two bounds state
    what rules are: a bad vote is a false alarm on at most ``false_alarm`` of
    the good documents, and, as each rule sees one kind of fault only, its good
    vote speaks for a document at most ``praise`` to one.  Both also keep the
    classes from swapping.  The start calls a document bad when any rule does.
    Returns (share of good documents, bad, posterior of good per pattern).
    """
    minus, plus = (patterns < 0).astype(float), (patterns > 0).astype(float)
    post = np.where(minus.any(1), 0.1, 0.9)
    share, bad = 0.9, np.tile([[0.5], [0.01]], patterns.shape[1])
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        votes_bad, votes = weight @ minus, weight @ (minus + plus)
        bad = (votes_bad + [[1.0], [0.01]]) / (votes + [[2.0], [1.0]])
        bad[1] = np.clip(bad[1], 1e-4, false_alarm)
        bad[0] = np.clip(bad[0], bad[1], 1 - (1 - bad[1]) / praise)
        share = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.5, 0.99))
        log_odds = np.log(share / (1 - share)) + minus @ np.log(bad[1] / bad[0]) + plus @ np.log((1 - bad[1]) / (1 - bad[0]))
        new = 1 / (1 + np.exp(-log_odds))
        moved = np.abs(new - post).max(initial=0)
        post = new
        if moved < tol:
            break
    return share, bad, post


VOTES = [f"v_{r[0]}" for r in RULES]


def posterior(voted: DataFrame) -> DataFrame:
    """(votes, p_good): EM over the counts of all vote combinations, at most 3 ** len(RULES) rows."""
    seen = voted.groupBy(*VOTES).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([[row[c] for c in VOTES] for row in seen], float).reshape(-1, len(VOTES))
    _, _, post = fit_accuracies(patterns, np.array([row["n"] for row in seen], float))
    return voted.sparkSession.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, post)],
                                              ", ".join(f"{c} int" for c in VOTES) + ", p_good double")


def judge(voted: DataFrame, post: DataFrame, keep_at: float, min_words: int, max_repeat: int) -> DataFrame:
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return (voted.join(F.broadcast(post), VOTES)  # bounded as above
            .withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at)))


def quality_votes(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_at: float = 0.5,
                  min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """Judge every row: measures, votes, ``base_failed``, ``p_good`` and ``kept``."""
    voted = materialize(measure(docs, key, text)).select("*", *vote_columns())
    return judge(voted, posterior(voted), keep_at, min_words, max_repeat)


def kept_documents(docs: DataFrame, text: str = "text", keep_at: float = 0.5, min_words: int = 10,
                   max_repeat: int = 20) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.  Texts are
    read twice (votes, then verdicts) and never shuffled."""
    votes = measure(docs.select(F.lit(0).alias("__k"), F.col(text).alias("__t")), "__k", "__t").select(*vote_columns())
    at = docs.columns.index(text)
    rows = _measured(docs.select(F.struct(*docs.columns).alias("__row")), "__row", lambda b: b.column(0).flatten()[at].cast(pa.string()))
    judged = judge(rows.select("*", *vote_columns()), posterior(votes), keep_at, min_words, max_repeat)
    return judged.filter("kept").select("__row.*")
