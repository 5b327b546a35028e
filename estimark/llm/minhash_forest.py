"""Near-duplicate texts by an LSH forest over MinHash signatures.

A text's set is its distinct shingles of ``SHINGLE`` words (lower-cased A-Z);
two texts link when 100 * |A & B| >= ``PERCENT`` * |A | B| on the full sets.

1. Texts with equal sets are one node (the smallest doc_id), by a grouping.
2. Every node has a signature of ``HASHES`` minima.  The forest's ``TREES``
   sorted orders are rotations of the signature.  A region is the nodes of an
   order that share a prefix; the shallowest regions share ``DEPTH`` values.
   Nodes whose signatures agree (``agree_at``: a margin of over four deviations
   below the threshold) are candidates if they share a region.
3. In a region of at most ``REGION`` nodes all meet.  A larger one is walked in
   its sorted order, where a node's neighbours are those with the longest
   common prefixes, however deep these are there: each node meets the
   ``WINDOW`` before it.  Regions and walks report spanning forests, never
   their pairs, and the forests' components say which nodes must meet.
   Where a large region is still in several components, nodes of different
   components meet in pairs of blocks, so that no candidate pair stays apart:
   what the walks have joined, templates with their variants above all, costs
   nothing there.
4. A node's full set is sent once to its component (to its regions, when the
   component has more than ``REGION`` nodes; those are worked on in pairs of
   blocks).  There candidate pairs that are not yet connected are checked on the
   full sets, those nearest to the middle of the group first, and a spanning
   forest of the true links is reported.  Their components are the answer.

A pair at the threshold shares a region in one order at least with
probability 1 - (1 - 0.85 ** 3) ** 16, over 0.999999 (0.99998 at 0.8), in
crowded regions as in thin ones; links inside a component need only one path.
Walks grow with the nodes.  What still grows with the square of a region is
step 3 where walks leave many components, and step 4 in components of more than
``REGION`` nodes that full sets keep apart.

Defined cases: null and empty texts have no set and link with nothing;
rows that repeat a doc_id are one document whose texts all link for it; a row
without doc_id is not linked (component_id null, kept true); an empty table
gives an empty result; texts of any length have one signature and one full set;
other columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm import words as W
from estimark.llm.components import connected_components
from estimark.session import materialize

SHINGLE, PERCENT = 3, 85
HASHES, TREES, STEP = 128, 16, 8
DEPTH = 3
REGION, WINDOW = 1024, 32
MARGIN = 4.2  # standard deviations of the estimate

_FACTORS = np.random.default_rng(85).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = [(np.arange(DEPTH) + t * STEP) % HASHES for t in range(TREES)]


def agree_at(percent: int) -> float:
    """Least share of equal one-byte signature values for a candidate."""
    j = percent / 100
    p = j + (1 - j) / 256
    return p - MARGIN * (p * (1 - p) / HASHES) ** 0.5


def shingle_sets(s: W.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, shingle hash), sorted and distinct; a shorter text is one shingle of all its words."""
    h = s.word_hashes(lower=True)
    _, doc, x = W.windows(s, h, k)
    counts = np.diff(s.word_offs)
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            whole = W.mix(W.window_hashes(h, m)[s.word_offs[short]] ^ np.uint64(m))
            doc, x = np.r_[doc, short], np.r_[x, whole]
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return doc[first], x[first]


def _fingerprints(s: W.Slice, k: int):
    """Per text with a set: (index, size, 16-byte fingerprint, starts in the set arrays), and the set hashes."""
    doc, x = shingle_sets(s, k)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
    size = np.diff(np.r_[starts, len(doc)])
    with np.errstate(over="ignore"):
        a = np.add.reduceat(W.mix(x ^ np.uint64(0x5851F42D4C957F2D)), starts) if len(starts) else x[:0]
        b = np.add.reduceat(W.mix(x ^ np.uint64(0x14057B7EF767814F)), starts) if len(starts) else x[:0]
    return doc[starts] if len(starts) else starts, size, np.stack([a, b], 1), starts, x


def _signatures(starts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one-byte signature, region keys per tree) of each set."""
    full = np.empty((len(starts), HASHES), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            full[:, j] = np.minimum.reduceat(x * _FACTORS[j], starts)
    full = W.mix(full)
    keys = np.empty((len(starts), TREES), np.uint64)
    with np.errstate(over="ignore"):
        for t, order in enumerate(_ORDERS):
            acc = np.full(len(starts), 0x9E37 + t, np.uint64)
            for d in order:
                acc = W.mix(acc ^ full[:, d])
            keys[:, t] = acc
    return (full >> np.uint64(56)).astype(np.uint8), keys


def _binary(rows: np.ndarray) -> pa.Array:
    """A row of bytes per entry."""
    rows = np.ascontiguousarray(rows)
    data, width = rows.view(np.uint8).reshape(len(rows), -1), rows.itemsize * rows.shape[1] if rows.ndim > 1 else rows.itemsize
    offs = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())])


def signatures(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, n, fp, sig, keys) of every row; keys by tree; n 0 and the rest null without a set."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))

    def run(batches):
        for b in batches:
            for s in W.slices(b.column(1)):
                at, size, fp, starts, x = _fingerprints(s, k)
                ids, n = b.column(0).slice(s.first, s.n), np.zeros(s.n, np.int64)
                n[at] = size
                names = ["id", "n", "fp", "sig", "keys"]
                if not len(at):
                    nulls = [pa.nulls(s.n, t) for t in (pa.binary(), pa.binary(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n), *nulls], names)
                    continue
                sig, keys = _signatures(starts, x)
                flat = pa.array(keys.reshape(-1).view(np.int64))
                offs = pa.array(np.arange(len(at) + 1, dtype=np.int32) * TREES)
                where = np.full(s.n, -1)
                where[at] = np.arange(len(at))
                take = pa.array(where, mask=where < 0)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n), *(c.take(take) for c in (_binary(fp), _binary(sig), pa.ListArray.from_arrays(offs, flat)))],
                    names)

    return W.map_batches(rows, run, "id long, n long, fp binary, sig binary, keys array<long>")


def regions(nodes: DataFrame) -> DataFrame:
    """(group, tree, id, n): the forest's regions with two nodes or more, and how many they hold."""
    keyed = nodes.select("id", F.posexplode("keys").alias("tree", "group"))
    counts = materialize(keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # a merge join at every size: the regions grow with the documents
    return materialize(keyed.join(counts.hint("merge"), "group").select("group", "tree", "id", "n"))


def block_pairs(groups: DataFrame, most: int) -> DataFrame:
    """(g, id, late, same, ...) of (group, id, n, ...): a group's blocks of about ``most`` nodes meet two by two.

    In a pair (a, b) the nodes of b are late; (a, a) has its nodes once, marked same."""
    dealt = groups.withColumn("blocks", F.ceil(F.col("n") / most).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    more = [c for c in groups.columns if c not in ("group", "id", "n", "tree")]
    return dealt.select(F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "id",
                        (F.col("mine") > F.col("other")).alias("late"), (F.col("mine") == F.col("other")).alias("same"), *more)


def walked(crowded: DataFrame, core: DataFrame, percent: int) -> DataFrame:
    """(u, v): in the sorted order of each large region, every node with its nearest candidate among the WINDOW nodes
    before it.  Ranges of the order are dealt to tasks, so a region of any size is walked by many."""
    cut = F.col("tree") * STEP
    turned = F.concat(F.expr(f"substring(sig, tree * {STEP} + 1, {HASHES})"), F.substring("sig", F.lit(1), cut))
    rows = crowded.select("group", "tree", "id").join(core, "id").withColumn("turned", turned)
    rows = rows.repartitionByRange("group", "turned").sortWithinPartitions("group", "turned", "id").select("group", "id", "n", "sig")
    least = agree_at(percent) * HASHES

    def run(batches):
        tail = None
        for b in batches:
            group, ids, n = (b.column(i).to_numpy() for i in range(3))
            sig = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, HASHES)
            if tail is not None:
                group, ids, n, sig = (np.concatenate(x) for x in zip(tail, (group, ids, n, sig)))
            before = len(ids) - b.num_rows
            tail = tuple(x[-WINDOW:] for x in (group, ids, n, sig))
            near = np.full(len(ids), -1)
            for d in range(1, min(WINDOW, len(ids) - 1) + 1):
                at = np.flatnonzero((near[d:] < 0) & (group[d:] == group[:-d])) + d
                at = at[at >= before]
                fit = 100 * np.minimum(n[at], n[at - d]) >= percent * np.maximum(n[at], n[at - d])
                at = at[fit & ((sig[at] == sig[at - d]).sum(1) >= least)]
                near[at] = at - d
            at = np.flatnonzero(near >= 0)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[near[at]])], ["u", "v"])

    return W.map_batches(rows, run, "u long, v long")


def _coded(sets: list) -> list:
    """The sets with small numbers for their values."""
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    return np.split(code, np.cumsum([len(x) for x in sets])[:-1])


def local_forest(sig: np.ndarray, n: np.ndarray, percent: int, split=None, sets=None, part=None) -> list[tuple[int, int]]:
    """A spanning forest of the candidate pairs, or of the true links when the sets are given, among the rows
    (between two blocks when ``split`` says where the second begins).  Rows of equal ``part`` are connected already."""
    part = np.arange(len(sig)) if part is None else part.copy()
    edges, least = [], agree_at(percent) * HASHES
    if sets is not None:
        sets = _coded(sets)
        has = np.zeros(max(int(x.max()) for x in sets) + 1, bool)
    # a template stands in the middle of its variants: begin there, and most pairs are soon connected
    middle = np.array([np.bincount(c, minlength=256).argmax() for c in sig.T], np.uint8)
    first = np.argsort(-(sig == middle).sum(1), kind="stable")
    if split is not None:
        first = first[first < split]
    done = np.zeros(len(sig), bool)
    second = np.arange(0 if split is None else split, len(sig))
    for i in first.tolist():
        done[i] = True
        near = second[part[second] != part[i]]
        if not len(near):
            if split is None or (part[:split] == part[i]).all():
                break
            continue
        near = near[~done[near]]
        near = near[100 * np.minimum(n[near], n[i]) >= percent * np.maximum(n[near], n[i])]
        near = near[(sig[near] == sig[i]).sum(1) >= least]
        if sets is not None and len(near):
            has[sets[i]] = True
            starts = np.cumsum([0] + [len(sets[j]) for j in near[:-1]])
            both = np.add.reduceat(has[np.concatenate([sets[j] for j in near])], starts, dtype=np.int64)
            has[sets[i]] = False
            near = near[100 * both >= percent * (n[near] + n[i] - both)]
        if len(near):
            groups, at = np.unique(part[near], return_index=True)
            edges += [(i, j) for j in near[at].tolist()]
            part[np.isin(part, groups)] = part[i]
    return edges


def _groups(batches, n_cols: int):
    """Column lists of each run of equal first values in a sorted stream."""
    key, held = None, [[] for _ in range(n_cols)]
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(n_cols)]
        for row in zip(*cols):
            if row[0] != key:
                if len(held[0]) > 1:
                    yield held
                key, held = row[0], [[] for _ in range(n_cols)]
            for h, x in zip(held, row):
                h.append(x)
    if len(held[0]) > 1:
        yield held


def _forest_of(group, percent: int, apart: bool = False):
    """The forest's edges, as ids, of one group: (g, id, sig, n, late, same), and with ``apart`` the components that
    the nodes are in, else the sets, if any."""
    _, ids, sigs, sizes, late, same, *more = group
    split = None if same[0] else late.count(False)
    if split in (0, len(ids)):
        return []
    sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), HASHES)
    part = np.unique(more[0], return_inverse=True)[1] if apart else None
    sets = [np.frombuffer(x, np.uint64) for x in more[0]] if more and not apart else None
    return [(ids[i], ids[j]) for i, j in local_forest(sig, np.array(sizes), percent, split, sets, part)]


def _edges_out(pairs) -> pa.RecordBatch:
    u, v = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def candidates(placed: DataFrame, core: DataFrame, percent: int, most: int) -> DataFrame:
    """(node, component) of the graph of all candidate pairs that share a region."""
    small, crowded = placed.filter(F.col("n") <= most), placed.filter(F.col("n") > most)

    def forests(pairs: DataFrame, *more: str) -> DataFrame:
        rows = pairs.join(core, "id").select("g", "id", "sig", "n", "late", "same", *more)

        def propose(batches):
            for g in _groups(batches, 6 + len(more)):
                if edges := _forest_of(g, percent, bool(more)):
                    yield _edges_out(edges)

        return W.map_batches(rows.repartition("g").sortWithinPartitions("g", "late", "id"), propose, "u long, v long")

    proposed = forests(block_pairs(small, most)).unionByName(walked(crowded, core, percent))
    meet = materialize(connected_components(proposed))
    # large regions that the walks have left in several components
    homes = crowded.join(meet, F.col("id") == F.col("node"), "left").select("group", "id", "n", F.coalesce("component", "id").alias("part"))
    parted = homes.groupBy("group").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("group")
    homes = materialize(homes.join(parted, "group", "left_semi"))
    if homes.isEmpty():
        return meet
    again = meet.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return materialize(connected_components(again.unionByName(forests(block_pairs(homes, most), "part"))))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE,
                    percent: int = PERCENT, most: int = REGION) -> DataFrame:
    """(key, n_shingles, component_id, kept) per row of ``docs``."""
    table = materialize(signatures(docs, key, text, k))
    nodes = (table.filter("id IS NOT NULL AND fp IS NOT NULL").groupBy("fp")
             .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    nodes = materialize(nodes)
    placed = regions(nodes)
    core = nodes.select("id", "fp", "n", "sig")

    meet = candidates(placed, core.drop("fp"), percent, most)

    # where the full sets meet: the candidate component, or the regions inside it when it is large
    size = meet.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    homes = meet.join(size, "component")
    near = homes.filter(F.col("size") <= most).select(F.col("component").alias("group"), F.col("node").alias("id"), F.col("size").alias("n"))
    far = (homes.filter(F.col("size") > most).join(placed, F.col("node") == placed["id"])
           .select(F.xxhash64("group", "component").alias("group"), "id"))
    sizes = far.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    homes = materialize(block_pairs(near.unionByName(far.join(sizes, "group").select("group", "id", "n")), most))

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    wanted = texts.join(homes.select("id").distinct(), "id", "left_semi")

    def sets_of(batches):
        for b in batches:
            for s in W.slices(b.column(1)):
                at, size_, fp, starts, x = _fingerprints(s, k)
                if len(at):
                    ends = np.r_[starts[1:], len(x)]
                    sets = [x[a:e].tobytes() for a, e in zip(starts, ends)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(at + s.first)), _binary(fp), pa.array(sets, pa.binary())], ["id", "fp", "set"])

    sets = W.map_batches(wanted, sets_of, "id long, fp binary, set binary").dropDuplicates(["id", "fp"])
    meeting = homes.join(core, "id").join(sets, ["id", "fp"]).select("g", "id", "sig", "n", "late", "same", "set")

    def verify(batches):
        for g in _groups(batches, 7):
            if edges := _forest_of(g, percent):
                yield _edges_out(edges)

    spread = meeting.repartition("g").sortWithinPartitions("g", "late", "id")
    links = W.map_batches(spread, verify, "u long, v long")
    # rows that repeat a doc_id are one document: its sets' nodes are linked through it
    reps = nodes.select(F.col("fp").alias("rfp"), F.col("id").alias("rep"))
    own = table.select("id", "n", "fp").join(reps, F.col("fp") == F.col("rfp"), "left")
    again = table.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id")
    tied = own.join(again, "id", "left_semi").select(F.col("id").alias("u"), F.coalesce("rep", "id").alias("v"))
    found = connected_components(links.unionByName(tied))

    at = F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))
    out = own.withColumn("at", at).join(found, F.col("at") == F.col("node"), "left")
    component = F.coalesce("component", "at")
    return out.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"),
                      component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with their own columns; rows that repeat doc_id and text stay once."""
    kept = near_duplicates(docs, key, text, k, percent).filter("kept").select(F.col(key).alias("__kept")).distinct()
    rows = docs.withColumn("__md5", F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    rows = rows.join(kept, F.col(key).eqNullSafe(F.col("__kept")), "left_semi")
    return rows.dropDuplicates([key, "__md5"]).select(*docs.columns)
