"""Running totals and ranks over a global order, without one window over all rows.

A global `ORDER BY` window would put every row of a key into one task. Instead the order is cut
at approximate quantiles, rows are windowed within a bucket, and the few bucket totals are
accumulated and joined back. The cuts of at most `FEW` keys are collected once and become literals,
those of more keys are checkpointed in the shared folder and joined by a shuffle; either way every later
evaluation, also after a lost executor, uses the same buckets.
Any cuts give exact results; good ones only balance the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


FEW = 10_000        # keys whose cuts are collected and broadcast (5 MB at 64 buckets); offsets are `buckets` rows for each of them


def _bucketed(df: DataFrame, keys: list[str], order: str, buckets: int) -> tuple[DataFrame, bool]:
    """`df` with `_bucket`, the number of cut points below `order`, and whether the keys are few."""
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(F.col(order).cast("double"), shares, 2000)).alias("_cuts"))
    rows = cuts.limit(FEW + 1).collect()               # one short array per key
    few = len(rows) <= FEW
    if not keys:
        joined = df.withColumn("_cuts", F.array(*[F.lit(float(v)) for v in rows[0]["_cuts"] or []]).cast("array<double>"))
    elif few:
        joined = df.join(F.broadcast(df.sparkSession.createDataFrame(rows, cuts.schema)), keys)
    else:
        from diegrid.sources.tables import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        joined = df.join(cuts.checkpoint(), keys)      # fixed in the shared folder; many keys share the tasks of a shuffle
    return joined.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(order).cast("double")))).drop("_cuts"), few


def _small(df: DataFrame, few: bool) -> DataFrame:
    """Broadcast with few keys; a shuffle join, or what adaptive execution makes of it, else."""
    return F.broadcast(df) if few else df


def with_bucket(df: DataFrame, keys: list[str], order: str, buckets: int = 64) -> DataFrame:
    """Adds `_bucket`: the number of cut points below `order`; rows equal in `order` share it."""
    return _bucketed(df, keys, order, buckets)[0]


def running_totals(df: DataFrame, keys: list[str], order: str, measures: list[str],
                   descending: bool = False, buckets: int = 64) -> DataFrame:
    """For rows that are unique in (keys, order): adds run_<m>, the sum of m up to and including
    the row, and all_<m>, the sum over the key."""
    b, few = _bucketed(df, keys, order, buckets)
    by = F.desc(order) if descending else F.asc(order)
    step = F.desc("_bucket") if descending else F.asc("_bucket")
    local = Window.partitionBy(*keys, "_bucket").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    rows = b.select("*", *[F.sum(m).over(local).alias(f"run_{m}") for m in measures])
    sums = b.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"s_{m}") for m in measures])
    # at most `buckets` rows per key from here on
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    offsets = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(f"s_{m}").over(before), F.lit(0)).alias(f"off_{m}") for m in measures],
                          *[F.sum(f"s_{m}").over(whole).alias(f"all_{m}") for m in measures])
    out = rows.join(_small(offsets, few), [*keys, "_bucket"])
    return out.select(*df.columns, *[(F.col(f"run_{m}") + F.col(f"off_{m}")).alias(f"run_{m}") for m in measures],
                      *[f"all_{m}" for m in measures])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], buckets: int = 64) -> DataFrame:
    """Linearly interpolated quantiles q0, q1, .. of `value` per key.

    The built-in exact `percentile` holds all distinct values of a key in one aggregation buffer;
    here only running counts of distinct values cross tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    r = running_totals(counts, keys, value, ["_n"], buckets=buckets)
    h = [(F.col("all__n") - 1) * s for s in shares]
    picks = []
    for i, rank in enumerate(h):
        for side, at in (("lo", F.floor(rank + 1e-9)), ("hi", F.ceil(rank - 1e-9))):
            picks.append(F.min(F.when(F.col("run__n") > at, F.col(value))).alias(f"{side}{i}"))
    g = r.groupBy(*keys).agg(F.max("all__n").alias("all__n"), *picks)
    return g.select(*keys, *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (rank - F.floor(rank + 1e-9))).alias(f"q{i}")
                             for i, rank in enumerate(h)])


def keyed_median(df: DataFrame, keys: list[str], value: str, name: str = "median", buckets: int = 256) -> DataFrame:
    """Exact median of `value` per key, for keys of any size and number; null values and keys take no part, a key without
    others has no row.

    A histogram of each key, in equal steps between its ends, says which steps hold the middle ranks; only their distinct
    values are put in order. Nothing is collected, no buffer holds the values of a key, and the steps of one key are dealt
    to many tasks. Any steps give exact results.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ends = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    step = F.floor((F.col("_v").cast("double") - F.col("_lo")) / (F.col("_hi").cast("double") - F.col("_lo")) * buckets)
    steps = counts.join(ends, keys).withColumn("_bucket", F.when(F.col("_hi") > F.col("_lo"), F.least(step, F.lit(buckets - 1))).otherwise(F.lit(0)))
    through = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)        # `buckets` rows per key
    hist = steps.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_s"), F.max("_all").alias("_all")).withColumn("_upto", F.sum("_s").over(through))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = hist.where((F.col("_upto") > low) & (F.col("_upto") - F.col("_s") <= high)).select(*keys, "_bucket", (F.col("_upto") - F.col("_s")).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.join(middle, [*keys, "_bucket"]).withColumn("_upto", F.sum("_n").over(inside) + F.col("_before"))
    return ranked.groupBy(*keys).agg(((F.min(F.when(F.col("_upto") > low, F.col("_v"))) + F.min(F.when(F.col("_upto") > high, F.col("_v")))) / 2).alias(name))


def global_row_number(df: DataFrame, keys: list[str], order: str, tie: str, name: str = "rn", buckets: int = 64) -> DataFrame:
    """row_number() over (partition by keys order by order, tie) for keys of any size. `order` must
    be numeric and spread (an id or a hash), so that no single value fills a bucket."""
    b, few = _bucketed(df, keys, order, buckets)
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order, tie))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))     # `buckets` rows per key
    return (b.withColumn("_rn", local).join(_small(offsets, few), [*keys, "_bucket"])
            .select(*df.columns, (F.col("_rn") + F.col("_off")).alias(name)))


def dense_ids(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """(column, 0-based position in sort order) of the distinct values, of any type and number.

    The values are range-partitioned and written once; positions are partition offsets plus the
    position inside the partition.
    """
    from diegrid.sources.tables import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    v = (df.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
         .select(column, F.monotonically_increasing_id().alias("_m")).checkpoint())
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    v = v.select(column, part.alias("_p"), inside.alias("_i"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = v.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return v.join(F.broadcast(offsets), "_p").select(column, (F.col("_i") + F.col("_o")).alias(name))    # one row per partition


def global_lag(df: DataFrame, keys: list[str], order: str, column: str, name: str, buckets: int = 64) -> DataFrame:
    """lag(column) over (partition by keys order by order) for keys of any size: within buckets by
    a window, across them by the last value of the previous non-empty bucket."""
    b, few = _bucketed(df, keys, order, buckets)
    local = F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(*keys, "_bucket").orderBy(order))
    last = b.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(F.col(column).alias("v")), order).alias("_last"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket")
    edge = last.select(*keys, "_bucket", F.lag("_last").over(before).alias("_edge"))           # `buckets` rows per key
    return (b.withColumn("_lag", local).join(_small(edge, few), [*keys, "_bucket"])
            .select(*df.columns, F.coalesce("_lag", "_edge")["v"].alias(name),
                    F.coalesce("_lag", "_edge").isNotNull().alias(f"{name}_exists")))
