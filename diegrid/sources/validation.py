"""Input checks. Every check yields a reason column, so bad rows go to quarantine, not to an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from diegrid.constants import MAX_BATCH_DIES, MAX_BATCH_WAFERS, MAX_DIM


def validate_wafers(wafers: DataFrame, map_col: str = "wafer_map") -> DataFrame:
    """Adds `reason`: NULL for a valid map, else the first rule it breaks."""
    m = F.col(map_col)
    width = F.size(F.get(m, F.lit(0)))
    return wafers.withColumn("reason", (
        F.when(m.isNull() | (F.size(m) == 0), "empty")
        .when((F.size(m) > MAX_DIM) | (width > MAX_DIM), "too large")
        .when((width <= 0) | F.exists(m, lambda row: row.isNull() | (F.size(row) != width)), "not rectangular")
        .when(F.exists(m, lambda row: F.exists(row, lambda v: v.isNull() | ~v.isin(0, 1, 2))), "bad value")
        .when(~F.exists(m, lambda row: F.exists(row, lambda v: v > 0)), "no dies")))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid without the reason, quarantine with it)."""
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def validate_geometry(df: DataFrame) -> DataFrame:
    """Flags per geometry column; die sizes may be null."""
    d, e = F.col("wafer_diameter_mm"), F.col("edge_exclusion_mm")

    def size_ok(name: str):
        return F.col(name).isNull() | ((F.col(name) > 0) & (F.col(name) <= 100))

    return df.select("*", ((d > 0) & (d <= 450)).alias("diameter_ok"), ((e >= 0) & (e <= 20)).alias("exclusion_ok"),
                     size_ok("die_w_mm").alias("die_w_ok"), size_ok("die_h_mm").alias("die_h_ok"))


def limit_reason(max_wafers: int = MAX_BATCH_WAFERS, max_dies: int = MAX_BATCH_DIES) -> Column:
    """Of a batch's `wafers` and `grid_dies`: accepted or why not."""
    return F.when(F.col("wafers") > max_wafers, "too many wafers").when(F.col("grid_dies") > max_dies, "too many dies").otherwise("accepted")


def batch_limits(sizes: DataFrame, max_wafers: int = MAX_BATCH_WAFERS, max_dies: int = MAX_BATCH_DIES) -> DataFrame:
    """sizes(batch, height, width), one row per wafer -> accepted or why not."""
    g = sizes.groupBy("batch").agg(F.count("*").alias("wafers"), F.sum(F.col("height").cast("long") * F.col("width")).alias("grid_dies"))
    return g.withColumn("reason", limit_reason(max_wafers, max_dies))
