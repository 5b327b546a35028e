"""Mix sources to target weights by Pareto order sampling.

Sizes are words.  The sources' weights share ``share`` (150 %) of all sizes;
a target stops at ``most`` (2) times its source's size and the excess is
shared anew by weight among the others until none is above.

Within a source, a target of r times the source's size gives every document
``floor(r)`` certain copies.  What is left is filled by a Pareto order sample
of further whole copies: document i with inclusion odds p / (1 - p) and
random odds u / (1 - u) is ranked by the second divided by the first, and
documents are taken in that order until the words that are missing are
reached.  Inclusion is unequal: p is proportional to the square root of the
document's size (at most 1, then it comes first), so long documents are
rarely left to the end and the last copy, taken when that brings the total
nearer, overshoots or misses by little.  u comes from a keyed digest of the
doc_id, so reruns agree.

Ranking a source needs no task that holds it: the ranks fall into fine
buckets by p- and u-derived quantile, sizes are summed per (source, bucket),
the running sum over that small table says which buckets are in, out or cut,
and only the documents of each source's cut bucket are ordered.

Defined cases: null and empty texts have size 0 and are never taken; rows
without a source are a source of their own, last in order; rows without
doc_id draw like a document named by the empty string; rows that repeat a
doc_id share their draw and are ordered by size; an empty table gives an
empty result; other columns are ignored by ``mix``, ``mixed`` keeps them.
DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estimark.session import materialize

WEIGHTS = (5, 2, 1)
BUCKETS = 1024
SALTS = 128


def words_in(text: str):
    """Number of words of a text column; null counts none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The order of sources is numbered without a task that holds them all: a
    range partitioning by source, a count per partition, and positions inside.
    The water level rises round by round; a round gathers two sums."""
    n = len(weights)
    ordered = sizes.withColumn("__last", F.col("source").isNull())
    ordered = ordered.repartitionByRange("__last", "source").sortWithinPartitions("__last", "source")
    ordered = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = ordered.withColumn("__part", part).join(before, "__part").withColumn("__rank", place + F.col("__before"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % n + 1).cast("int"))
    table = materialize(ranked.select("source", "source_size", weight.cast("long").alias("weight")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    capped, level = F.lit(False), None
    limit = F.col("source_size") * most
    while True:
        held, open_weight = table.agg(F.sum(F.when(capped, limit).otherwise(0)),
                                      F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        if not open_weight:  # no source, or each at its limit
            return table.select("source", "source_size", limit.cast("double").alias("target"))
        left = share * total - held
        if (left, open_weight) == level:
            break
        level = (left, open_weight)
        capped = limit * F.lit(int(open_weight)) < F.col("weight") * F.lit(float(left))
    target = F.when(capped, limit.cast("double")).otherwise(F.col("weight") * F.lit(float(left)) / F.lit(int(open_weight)))
    return table.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1",
        weights=WEIGHTS, share: float = 1.5, most: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(key, size, source, source_size, target, taken, copies) per row of ``docs``."""
    rows = docs.select(F.col(key).alias("__key"), F.col(source).alias("source"), words_in(text).alias("size"))
    rows = materialize(rows)
    bias = F.floor(F.sqrt("size") * 1024).cast("decimal(19,0)")  # whole numbers, so sums don't depend on their order
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(bias * F.col("size").cast("decimal(19,0)")).cast("double").alias("__sq"))
    per_source = materialize(per_source)
    aims = targets(per_source.select("source", "source_size"), weights, share, most)
    aims = aims.select(F.col("source").alias("__source"), "target")
    plan = per_source.join(aims, F.col("source").eqNullSafe(F.col("__source"))).select(
        "source", "source_size", "target", "__sq",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("certain"))
    plan = materialize(plan.withColumn("missing", F.col("target") - F.col("certain") * F.col("source_size"))
                       .withColumnRenamed("source", "__source"))

    # a row per (source, bucket number): the salt that spreads a large source over the joins
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("__key").cast("string"), F.lit("")))), 1, 13),
                16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    drawn = rows.withColumn("u", u).withColumn("salt", F.floor(F.col("u") * SALTS).cast("int"))
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = drawn.join(salted, F.col("source").eqNullSafe(F.col("__source")) & (drawn["salt"] == salted["salt"]))
    # expected words of the sample are the missing ones: sum(p * size) = missing
    p = F.least(F.lit(1.0), F.when(F.col("__sq") > 0, bias.cast("double") * F.col("missing") / F.col("__sq")).otherwise(0.0))
    ranked = joined.withColumn("p", p).withColumn(
        "q", F.when(F.col("p") >= 1, 0.0).when(F.col("p") <= 0, F.lit(None))
        .otherwise((F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    ranked = ranked.filter("p > 0 AND size > 0 AND missing > 0")
    ranked = ranked.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * buckets).cast("int"))
    ranked = materialize(ranked.select("__key", "source", "size", "q", "u", "bucket", "missing"))

    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    running = Window.partitionBy("source").orderBy("bucket")  # at most ``buckets`` + 1 rows of a source
    upto = F.sum("words").over(running)
    edges = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    edges = edges.withColumn("state", F.when(F.col("upto") <= F.col("missing"), 1).when(F.col("before") >= F.col("missing"), 0)
                             .otherwise(2)).filter("state > 0")
    edges = edges.select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), "before", "state")
    chosen = ranked.join(edges, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("__bucket")))
    # only a source's cut bucket is put in order
    order = Window.partitionBy("source").orderBy("q", "size", "u", "__key")
    cut = chosen.filter("state = 2").withColumn("upto", F.col("before") + F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    taken = cut.filter(F.col("upto") - F.col("missing") <= F.col("missing") - (F.col("upto") - F.col("size")))
    extra = (chosen.filter("state = 1").select("__key", "source", "size")
             .unionByName(taken.select("__key", "source", "size")))
    # repeated rows: how many of them get the further copy
    extra = extra.groupBy("__key", "source", "size").agg(F.count(F.lit(1)).alias("n_extra"))
    extra = extra.select(F.col("__key").alias("k"), F.col("source").alias("s"), F.col("size").alias("z"), "n_extra")
    aimed = joined.select("__key", "source", "size", "source_size", "target", "certain")
    out = aimed.join(extra, F.col("__key").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s"))
                     & (F.col("size") == F.col("z")), "left")
    twin = Window.partitionBy("__key", "source", "size").orderBy(F.lit(0))
    more = F.when(F.col("n_extra").isNull(), 0).when(F.row_number().over(twin) <= F.col("n_extra"), 1).otherwise(0)
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + more).otherwise(0).cast("long"))
    return out.select(F.col("__key").alias(key), "size", F.col("source").alias(source), "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **kwargs) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it, with its own columns."""
    take = mix(docs, key, text, source, **kwargs).filter("copies > 0")
    take = take.groupBy(F.col(key).alias("__key"), F.col(source).alias("__source"), F.col("size").alias("__size")).agg(
        F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    rows = docs.withColumn("__n", words_in(text))
    rows = rows.join(take, rows[key].eqNullSafe(F.col("__key")) & rows[source].eqNullSafe(F.col("__source"))
                     & (F.col("__n") == F.col("__size")))
    # rows that share doc_id, source and size share their copies as evenly as they go
    twin = F.row_number().over(Window.partitionBy("__key", "__source", "__size").orderBy(F.xxhash64(F.col(text))))
    share = F.floor(F.col("__copies") / F.col("__rows")) + F.when(twin <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    rows = rows.withColumn("__share", share)
    return (rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__share").cast("int"))))
            .select(*[F.col(c) for c in docs.columns]))
