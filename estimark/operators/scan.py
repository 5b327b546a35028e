"""Running aggregates and ordinals that survive a hot partition key.

A plain ``Window.partitionBy(room).orderBy(ts)`` sends every row of one room to
one task.  With one room holding a third of the data that task becomes the
whole job.  Here the rows per key are counted first (a partial aggregation).
Where no key has more than ``CHUNK_ROWS`` rows the plain window is used.  For
the keys that do, boundaries in the order column are measured (approximate
percentiles of the rows themselves, so neither busy hours nor sparse ids
matter), and each such key is cut into chunks of about ``CHUNK_ROWS`` rows:

1. the running aggregate is computed inside each (key, chunk) - many tasks;
2. each chunk's total is computed by a (partial) aggregation - a small table;
3. the carry-in of a chunk is the running total of the chunks before it,
   a window over that small table (a row per chunk);
4. carry-in and local value are combined after an equi-join on (key, chunk).

The result equals the single-window form exactly.  A caller that knows a
monotone chunk column (a time bucket, ``id div K``) may pass it instead.  Rows
that tie in the order column stay in one chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estimark.session import materialize

CHUNK_ROWS = 1 << 20
MOST_CHUNKS = 4096  # boundaries measured for a key
_CHUNK = "__chunk"
_KEY = "__key"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def measured_chunks(df: DataFrame, keys: Sequence[str], by: Column, rows: int) -> DataFrame | None:
    """(__key, __bounds) of the keys with more than ``rows`` rows: boundaries in
    ``by`` that cut each into chunks of about ``rows``.  None if no key has."""
    narrow = df.select(F.struct(*keys).alias(_KEY), by.alias("__by"))
    hot = narrow.groupBy(_KEY).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows)
    most = hot.agg(F.max("__n")).first()[0]
    if most is None:
        return None
    parts = min(MOST_CHUNKS, math.ceil(most / rows))
    cuts = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    bounds = narrow.join(hot.select(_KEY), _KEY, "left_semi").groupBy(_KEY).agg(
        F.percentile_approx("__by", cuts, max(10_000, 20 * parts)).alias("__bounds"))
    return materialize(bounds)


def running(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column | None,
            aggs: dict[str, tuple[str, Column | str | None]], chunk_rows: int = CHUNK_ROWS,
            rows: int | None = None) -> DataFrame:
    """Add running aggregates ``{out: (kind, value)}`` with kind in count/sum/max,
    over rows of each ``keys`` group ordered by ``order`` (unbounded preceding
    to current row).  ``chunk`` must not decrease along ``order``; None measures
    (``order[0]`` must then be a number, date or time).  Measuring reads ``df``
    once more, so pass a table or something as cheap; ``rows``, the number of
    rows where it is known, spares it when no key can be too large."""
    # the keys travel as one struct column: a struct is never NULL and compares
    # NULL fields as equal, so NULL keys form one group (as in a window) and
    # the carry join stays a plain equi-join, co-partitioned with the windows
    ck = [_KEY, _CHUNK]
    d = df.withColumn(_KEY, F.struct(*keys))
    if chunk is None:
        small = rows is not None and rows <= chunk_rows
        bounds = None if small else measured_chunks(df, keys, _col(order[0]), chunk_rows)
        if bounds is None:
            whole = Window.partitionBy(_KEY).orderBy(*[_col(o) for o in order]).rowsBetween(
                Window.unboundedPreceding, Window.currentRow)
            of = {"count": F.sum, "sum": F.sum, "max": F.max}
            return d.select(*df.columns, *[of[kind](F.lit(1) if kind == "count" else _col(v)).over(whole).alias(out)
                                           for out, (kind, v) in aggs.items()])
        d = d.join(bounds, _KEY, "left").withColumn(_CHUNK, F.coalesce(F.size(F.filter(
            "__bounds", lambda b: b < _col(order[0]))), F.lit(0))).drop("__bounds")
    else:
        d = d.withColumn(_CHUNK, chunk)
    w_local = Window.partitionBy(*ck).orderBy(*[_col(o) for o in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    w_carry = Window.partitionBy(_KEY).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)

    local_cols, total_cols, carry_cols = [], [], []
    for out, (kind, val) in aggs.items():
        v = F.lit(1) if kind == "count" else _col(val)
        if kind in ("count", "sum"):
            local_cols.append(F.sum(v).over(w_local).alias(f"__l_{out}"))
            total_cols.append(F.sum(v).alias(f"__t_{out}"))
            carry_cols.append(F.sum(f"__t_{out}").over(w_carry).alias(f"__c_{out}"))
        elif kind == "max":
            local_cols.append(F.max(v).over(w_local).alias(f"__l_{out}"))
            total_cols.append(F.max(v).alias(f"__t_{out}"))
            carry_cols.append(F.max(f"__t_{out}").over(w_carry).alias(f"__c_{out}"))
        else:
            raise ValueError(kind)

    # The rows are shuffled once, by (keys, chunk), for the running window.
    # The chunk totals are a separate aggregation that Spark runs partially
    # before its shuffle (and prunes to the columns it needs), so only about
    # one row per chunk and input partition moves for them; the carries are a
    # window over that small table, which then meets the rows again.
    local = d.select("*", *local_cols)
    carry = d.groupBy(*ck).agg(*total_cols).select(*ck, *carry_cols)
    joined = local.join(carry, ck, "left")
    outs = []
    for out, (kind, _) in aggs.items():
        lo, ca = F.col(f"__l_{out}"), F.col(f"__c_{out}")
        if kind in ("count", "sum"):
            # NULL only when every value so far is NULL, as the window's sum
            outs.append(F.when(ca.isNull() & lo.isNull(), F.lit(None))
                        .otherwise(F.coalesce(ca, F.lit(0)) + F.coalesce(lo, F.lit(0))).alias(out))
        else:
            outs.append(F.greatest(ca, lo).alias(out))
    keep = [c for c in df.columns]
    return joined.select(*keep, *outs)


def id_chunk(col: str, width: int = 1 << 20) -> Column:
    """Chunk for an integer ordering column: ``col div width``."""
    return F.floor(F.col(col) / F.lit(width))


def time_chunk(col: str, unit: str = "hour") -> Column:
    """Chunk for a timestamp ordering column."""
    return F.date_trunc(unit, F.col(col))


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
            chunk: Column | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order) as INT, hot-key safe."""
    r = running(df, keys, order, chunk, {out: ("count", None)}, chunk_rows)
    return r.withColumn(out, F.col(out).cast("int"))
