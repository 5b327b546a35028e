"""Near-duplicate vectors by a pivot-permutation index.

Vectors are compared within a label, each length for itself.  A label has a
reference point (pivot) for every ``PER_PIVOT`` of its vectors, and a vector is
described by its ``NAMED`` nearest pivots.  Vectors that name a pivot form its
inverted list; within a list every pair is verified by its cosine in double
precision, and taken in the list of the lowest pivot that both name, if they
share ``shared`` pivots at least.  Lists stay as long as NAMED * PER_PIVOT on
average whatever the size of the label, so the work grows with it.

Two vectors at the threshold have nearly the same nearest pivots when their
label is spread out.  Inside a dense group the nearest pivots are all members
and their order is noise; a vector whose named pivots are all links is
therefore also described among every second pivot, every fourth, and so on,
until its links no longer fill the description.  Dense groups of any size thus
come down to a few pivots that most members name; their lists are long, as are
their links.  Recall is measured in the tests (1.0 of pairs planted at 0.9305 in
a spread label, over 0.99 in dense groups).  A label small enough for all its
pivots to be named is one list, and exact.

Pivots are a bounded sample, ``PIVOTS`` of a label at most, the first by a
keyed digest; beyond PIVOTS * PER_PIVOT vectors in a label its lists grow.  A
list longer than ``BLOCK`` is cut into blocks, which meet in pairs, each its own
task group; a group reports a link count per vector and a spanning forest of
its links, never its pairs.

Equal vectors of a label are one node with a multiplicity before the index is
built, so a vector that a third of all rows repeat costs one entry.

Defined cases: vectors that are null, empty, zero, or that hold null
or non-finite components, and vectors without a label, link with nothing; rows that repeat a vec_id are vectors of
their own, each with the component of its own vector; a row without vec_id
gets no component and keeps its row (kept true), and counts as a link of
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estimark.llm import words as W
from estimark.llm.components import connected_components
from estimark.session import materialize

PIVOTS = 1 << 14  # reference points per label, at most
PER_PIVOT, NAMED = 32, 10
BLOCK = 1024
STREAM = 8192  # vectors of a label that one task group describes
LEAST = 0.93


def clean(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, x, ok): the vector, and whether it may link; vectors of one label and length share a label here."""
    zero = F.lit(0).cast(vectors.schema[vector].dataType.elementType)
    x = F.transform(F.col(vector), lambda v: F.when(v == 0, zero).otherwise(v))  # no negative zeros
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    nonzero = F.exists(x, lambda v: v != 0)
    ok = F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(x) > 0) & finite & nonzero
    group = F.concat_ws(":", F.size(x).cast("string"), F.col(label).cast("string"))
    return vectors.select(F.col(key).alias("id"), group.alias("label"), x.alias("x"),
                          F.coalesce(ok, F.lit(False)).alias("ok"))


def _unit(rows: list) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow of the squares."""
    m = np.array(rows, float)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def choose_pivots(nodes: DataFrame, sizes: DataFrame, per_pivot: int) -> DataFrame:
    """(label, r, x): a vector for every ``per_pivot`` of a label, PIVOTS at most, the first by a digest.

    A digest below a bound keeps a few more than are wanted, so no task sorts a label."""
    want = F.least(F.ceil(F.col("size") / per_pivot), F.lit(PIVOTS))
    spare = (want + 4 * F.sqrt(want) + 4) / F.col("size")
    draw = F.xxhash64(F.lit("pivot"), "node")
    drawn = nodes.join(sizes, "label").withColumn("d", draw).filter(F.pmod("d", F.lit(1 << 40)) / float(1 << 40) < spare)
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("d", F.lit(1 << 40)), "d")))
    return drawn.filter(F.col("r") <= want).select("label", "r", "x")


def name_pivots(cos: np.ndarray, least: float, named: int) -> list[np.ndarray]:
    """The pivots that describe each row, given its cosines to the label's pivots: the ``named`` nearest.

    Where all of them are links of the row, the row lies in a dense group, whose nearest pivots say little; it is then
    also described among every second pivot, and so on, until some of the nearest are no links or all are named.  A
    pivot's number holds its level."""
    out = [[] for _ in cos]
    at, level, n = np.arange(len(cos)), 0, cos.shape[1]
    while len(at):
        k = min(named, n)
        near = np.argpartition(-cos[at, :n], k - 1, 1)[:, :k] if k < n else np.tile(np.arange(n), (len(at), 1))
        for i, x in zip(at.tolist(), near):
            out[i].append(x + level * PIVOTS)
        if k == n:
            break
        at = at[np.take_along_axis(cos[at, :n], near, 1).min(1) >= least]
        level, n = level + 1, (n + 1) // 2
    return [np.concatenate(x).astype(np.int32) for x in out]


def describe(nodes: DataFrame, pivots: DataFrame, sizes: DataFrame, least: float, named: int) -> DataFrame:
    """(label, node, n, x, names) of every node: the numbers of the pivots that describe it.

    A label is dealt out in groups of about STREAM nodes; every group's stream begins with the label's pivots."""
    sized = sizes.withColumn("groups", F.ceil(F.col("size") / STREAM).cast("int")).select("label", "groups")
    mine = nodes.join(sized, "label").select("label", F.pmod("node", "groups").cast("int").alias("part"), F.lit(1).alias("kind"),
                                             "node", "n", "x")
    heads = pivots.join(sized, "label").select(
        "label", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("kind"),
        F.col("r").cast("long").alias("node"), F.lit(0).cast("long").alias("n"), "x")
    stream = heads.unionByName(mine).repartition("label", "part").sortWithinPartitions("label", "part", "kind", "node")
    element = nodes.schema["x"].dataType.elementType.simpleString()

    def run(batches):
        now, heads, own = None, [], None
        for b in batches:
            label, part, kind = (b.column(i).to_pylist() for i in range(3))
            rows = b.column(5).to_pylist()
            names, i = [], 0
            while i < len(rows):
                if (label[i], part[i]) != now:
                    now, heads, own = (label[i], part[i]), [], None
                if kind[i] == 0:
                    heads.append(rows[i])
                    i += 1
                    continue
                j = i
                while j < len(rows) and j < i + 256 and kind[j] == 1 and (label[j], part[j]) == now:
                    j += 1
                if own is None:
                    own = _unit(heads)
                names += name_pivots(_unit(rows[i:j]) @ own.T, least, named)
                i = j
            at = pa.array([k for k in range(len(rows)) if kind[k] == 1], pa.int64())
            cols = [b.column(k).take(at) for k in (0, 3, 4, 5)] + [pa.array(names, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["label", "node", "n", "x", "names"])

    return W.map_batches(stream, run, f"label string, node long, n long, x array<{element}>, names array<int>")


def _first_shared(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest pivot that both rows of each pair name, how many they share); rows of ``names`` end in distinct fillers."""
    low, count = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 14):
        a, b = names[i[k:k + (1 << 14)]], names[j[k:k + (1 << 14)]]
        same = (a[:, :, None] == b[:, None, :]).any(2)
        low[k:k + (1 << 14)] = np.where(same, a, np.iinfo(np.int32).max).min(1)
        count[k:k + (1 << 14)] = same.sum(1)
    return low, count


def _work(mult, unit, names, pivot, least, shared, split=None):
    """Link counts and a spanning forest of the links among the rows of a pivot's list (between two blocks when
    ``split`` says where the second begins).  A pair is taken in the list of the lowest pivot that it shares."""
    n = len(unit)
    width = max(map(len, names))
    table = np.empty((n, width), np.int64)
    for i, x in enumerate(names):
        table[i, :len(x)] = x
        table[i, len(x):] = -1 - i  # a filler that no other row has
    count, part, edges = np.zeros(n, np.int64), np.arange(n), []
    for i0 in range(0, n if split is None else split, 256):
        i1 = min(i0 + 256, n if split is None else split)
        j0 = i0 + 1 if split is None else split
        near = unit[i0:i1] @ unit[j0:].T >= least
        if split is None:
            near &= np.arange(j0, n)[None, :] > np.arange(i0, i1)[:, None]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        low, same = _first_shared(table, i + i0, j + j0)
        near[i, j] = (low == pivot) & (same >= shared)
        count[i0:i1] += near @ mult[j0:]
        count[j0:] += mult[i0:i1] @ near
        for i in np.flatnonzero(near.any(1)):
            at = np.flatnonzero(near[i]) + j0
            groups, first = np.unique(part[at], return_index=True)
            new = groups != part[i0 + i]
            if new.any():
                edges += [(int(i0 + i), int(j)) for j in at[first[new]]]
                part[np.isin(part, groups[new])] = part[i0 + i]
    return count, edges


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 least: float = LEAST, per_pivot: int = PER_PIVOT, named: int = NAMED, shared: int = 1, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) per row."""
    rows = clean(vectors, key, vector, label).withColumn("h", F.xxhash64("x"))
    rows = materialize(rows)
    usable = rows.filter("ok")
    # equal vectors of a label are one node; the node's number is a digest
    nodes = usable.groupBy("label", "h", "x").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    nodes = materialize(nodes.withColumn("node", F.xxhash64("label", "h", "x")))
    sizes = materialize(nodes.groupBy("label").agg(F.count(F.lit(1)).alias("size")))
    # a label whose pivots would all be named is one list
    large = F.col("size") > per_pivot * named
    whole = nodes.join(sizes.filter(~large), "label").select("label", "node", "n", "x", F.array(F.lit(0)).alias("names"))
    large = sizes.filter(large)
    index = describe(nodes.join(large, "label", "left_semi"), choose_pivots(nodes, large, per_pivot), large, least, named)
    index = materialize(index.unionByName(whole))

    # inverted lists; long ones are cut into blocks that meet two by two
    named_by = index.select("label", F.explode("names").alias("pivot"), "node")
    blocks = materialize(named_by.groupBy("label", "pivot").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"), F.count(F.lit(1)).alias("c"))
                         .filter("c > 1").drop("c"))
    lists = index.withColumn("pivot", F.explode("names")).join(blocks, ["label", "pivot"])
    lists = lists.withColumn("mine", F.pmod("node", "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lists = lists.select(
        F.xxhash64("label", "pivot", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "node", "n", "x", "names", "pivot",
        (F.col("mine") > F.col("other")).alias("late"), (F.col("mine") == F.col("other")).alias("same"))
    # a block pair (a, b): a's rows are not late, b's rows are late; (a, a) has its rows once, marked same
    spread = lists.repartition("g").sortWithinPartitions("g", "late", "node")

    def run(batches):
        def solve(held):
            g, ids, mult, x, names, pivot, late, same = held
            split = None if same[0] else sum(not v for v in late)
            if len(ids) < 2 or split == 0 or split == len(ids):
                return None
            count, edges = _work(np.array(mult), _unit(x), names, pivot[0], least, shared, split)
            at = np.flatnonzero(count)
            if not len(at):
                return None
            out = [(ids[i], None, int(count[i])) for i in at] + [(ids[i], ids[j], 0) for i, j in edges]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v", "links"])

        now, held = None, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if row[0] != now:
                    if held and (got := solve(held)):
                        yield got
                    now, held = row[0], [[] for _ in row]
                for h, v in zip(held, row):
                    h.append(v)
        if held and (got := solve(held)):
            yield got

    found = materialize(W.map_batches(spread, run, "u long, v long, links long"))
    links = found.filter("v IS NULL").groupBy("u").agg(F.sum("links").alias("links"))
    joined = found.filter("v IS NOT NULL").select("u", "v")
    groups = connected_components(joined)  # of node numbers
    nodes = nodes.join(groups, nodes["node"] == groups["node"], "left").select(
        nodes["node"], "label", "h", "n", "least", F.coalesce("component", nodes["node"]).alias("group"))
    low = nodes.groupBy("group").agg(F.min("least").alias("low"))
    nodes = nodes.join(low, "group").join(links, nodes["node"] == links["u"], "left").select(
        "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "low")

    out = rows.withColumn("__node", F.when(F.col("ok"), F.xxhash64("label", "h", "x")))
    out = out.join(nodes, out["__node"] == nodes["node"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("low", "id"))
    kind = vectors.schema[key].dataType
    return out.select(F.col("id").cast(kind).alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.cast("long").alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
