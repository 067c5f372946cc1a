"""Wafer-shaped views over the driver's general-purpose tables (FIXTURES.md, section B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from diegrid.constants import CLASSES
from diegrid.sources.tables import table


def dies(spark: SparkSession, sf: str) -> DataFrame:
    """One wafer per supplier. The three-column key is combined on the map side first, so a
    supplier that holds most of the rows still contributes at most 26 x 26 of them."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").cast("long").alias("wafer_id"),
                     (F.col("l_partkey") % 26).cast("int").alias("r"), (F.col("l_orderkey") % 26).cast("int").alias("c"))
            .agg(F.max(F.when(F.col("l_returnflag") == "R", 2).otherwise(1)).alias("state")))


def class_name(wafer_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (wafer_id % 9 + 1).cast("int"))


def wafer_classes(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("long").alias("wafer_id")).distinct()
            .select("wafer_id", class_name(F.col("wafer_id")).alias("cls")))


def activation(spark: SparkSession, sf: str) -> DataFrame:
    """A heavy-tailed positive value per die, standing in for a class-activation map."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").cast("long").alias("wafer_id"),
                     (F.col("l_partkey") % 26).cast("int").alias("r"), (F.col("l_orderkey") % 26).cast("int").alias("c"))
            .agg(F.max(F.col("l_extendedprice") * F.col("l_discount")).alias("cam")))


def batches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("wafer_id"), F.col("s_nationkey").alias("batch"))


def wafers(spark: SparkSession, sf: str) -> DataFrame:
    """Raw labelled wafers: dense map, lot, and the label as a nested array, empty for every 7th."""
    from diegrid.operators.dies import collect_die_map
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("wafer_id"), F.col("s_nationkey").cast("int").alias("lot_id"))
    empty = F.array().cast("array<array<string>>")
    return collect_die_map(dies(spark, sf)).join(sup, "wafer_id").select(
        "wafer_id", "lot_id", "wafer_map",
        F.when(F.col("wafer_id") % 7 == 0, empty).otherwise(F.array(F.array(class_name(F.col("wafer_id"))))).alias("failureType"))


def map_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """batch, height, width of the maps of `wafers`, from the last row and column of each, with no map put together: a task
    of the scan leaves one row for each wafer."""
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("wafer_id"), F.col("s_nationkey").cast("int").alias("batch"))
    place = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("long").alias("wafer_id"), (F.col("l_partkey") % 26).cast("int").alias("r"), (F.col("l_orderkey") % 26).cast("int").alias("c"))
    ends = place.where("r is not null and c is not null").groupBy("wafer_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    return ends.join(sup, "wafer_id").select("batch", "height", "width")


def _centroids(e: DataFrame, *keys: str) -> DataFrame:
    """Mean embedding per class (and key): class x dimension values."""
    long = e.select("label", *keys, F.posexplode("embedding").alias("i", "v"))
    mean = long.groupBy("label", *keys, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return mean.groupBy("label", *keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def _logits(embedding: Column, centroids: Column, skip: Column | None = None) -> Column:
    """10 x dot product with every class mean, 9 decimals; `skip` leaves out dimensions i % 8 = skip."""
    def product(c):
        terms = F.zip_with(embedding, c["centroid"], lambda x, y: x.cast("double") * y)
        if skip is not None:
            terms = F.transform(terms, lambda t, i: F.when(i % 8 == skip, 0.0).otherwise(t))
        return F.round(10 * F.aggregate(terms, F.lit(0.0), lambda s, t: s + t), 9)
    return F.transform(centroids, product)


def embeddings(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """`dealt` to all tasks where what follows multiplies the rows: the file can be one row group, which is one task."""
    from diegrid.operators.dies import by_wafer
    grp = F.floor(F.col("vec_id") / 4).cast("long")
    e = table(spark, sf, "embeddings")
    return (by_wafer(e, "vec_id") if dealt else e).select("vec_id", F.col("label").alias("y"), "label", "embedding",
                                                 grp.alias("grp"), (grp % 5).cast("int").alias("fold"))


N_CLASSES = 10


def preds(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """preds(vec_id, y, grp, fold, z ARRAY): logits of a nearest-class-mean model. The class means
    are one fixed-size value (classes x dimensions), read as a scalar subquery."""
    e = embeddings(spark, sf, dealt)
    c = _centroids(e).agg(F.array_sort(F.collect_list(F.struct("label", "centroid")))).scalar()
    return (e.select("vec_id", "y", "grp", "fold", "embedding", c.alias("cs"))
            .select("vec_id", "y", "grp", "fold", _logits(F.col("embedding"), F.col("cs")).alias("z")))


def probs(spark: SparkSession, sf: str) -> DataFrame:
    """preds with probabilities at 12 decimals, top class and confidence."""
    from diegrid.functions.arrays import argmax, softmax
    p = preds(spark, sf).withColumn("p", F.transform(softmax(F.col("z")), lambda x: F.round(x, 12)))
    return p.select("*", argmax(F.col("p")).alias("pred"), F.array_max("p").alias("conf"))


def member_preds(spark: SparkSession, sf: str, views: bool = False) -> DataFrame:
    """Five members, each with class means that leave one fold out; with `views`, eight partial
    views of the input each (one of eight dimension groups left out)."""
    e = embeddings(spark, sf, dealt=True)
    held_out = e.select(*e.columns, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("member")).where("fold <> member")
    c = _centroids(held_out, "member").groupBy("member").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("cs"))
    members = e.select(*e.columns, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("member"))
    out = members.join(F.broadcast(c), "member")       # five rows of class means: fixed size
    if views:
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("view"))
        return out.select("vec_id", "y", "grp", "fold", "member", "view", _logits(F.col("embedding"), F.col("cs"), F.col("view")).alias("z"))
    return out.select("vec_id", "y", "grp", "fold", "member", _logits(F.col("embedding"), F.col("cs")).alias("z"))


def process(spark: SparkSession, sf: str) -> DataFrame:
    """Process log, one row per wafer. Edge-Ring wafers are concentrated in chamber B and etched
    longer, Scratch wafers ran on a worn pad."""
    return process_columns(table(spark, sf, "events"))


def process_columns(events: DataFrame, *extra: str) -> DataFrame:
    """The process log's columns of an events table or stream."""
    t, i, u = F.col("event_type"), F.col("event_id"), F.col("user_id")
    return events.select(
        *extra, F.concat(F.lit("W"), i.cast("string")).alias("wafer_id"), i.alias("seq"), F.concat(F.lit("L"), (u % 7).cast("string")).alias("lot_id"),
        F.when(t == "view", "None").when(t == "click", "Edge-Ring").when(t == "error", "Scratch")
        .when(t == "signup", "Center").otherwise("Loc").alias("class"),
        F.when((t == "click") & (i % 3 == 0), "B").otherwise(
            F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (u % 3 + 1).cast("int"))).alias("chamber"),
        (F.col("value") + F.when(t == "click", 10.0).otherwise(0.0)).alias("etch_time_s"),
        ((i % 400) * 2 + F.when(t == "error", 120).otherwise(0)).alias("cmp_pad_cycles"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Exported image names: 700 sources, every 10th file with a plain name; class and palette."""
    d = table(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("plain_"), F.col("doc_id").cast("string"), F.lit(".png"))).otherwise(
        F.concat(F.lit("image_"), (F.col("doc_id") % 700).cast("string"), F.lit("_png_jpg.rf."), F.md5("text"), F.lit(".jpg")))
    return d.select("doc_id", name.alias("f"), "lang", "n_chars")


def _symmetry_of(wafer_id: Column, r: Column, c: Column, side: int) -> tuple[Column, Column]:
    """One of the eight symmetries of a side x side grid, chosen by the wafer id."""
    m, k = side - 1, wafer_id % 8
    rows = F.when(k == 0, r).when(k == 1, c).when(k == 2, m - r).when(k == 3, m - c).when(k == 4, r).when(k == 5, c).when(k == 6, m - r).otherwise(m - c)
    cols = F.when(k == 0, c).when(k == 1, m - r).when(k == 2, m - c).when(k == 3, r).when(k == 4, m - c).when(k == 5, r).when(k == 6, c).otherwise(m - r)
    return rows, cols


def image_dies(spark: SparkSession, sf: str) -> DataFrame:
    """Every wafer, an exact copy of it turned or mirrored (id + 1,000,000) and another copy with
    one die in 23 inverted (id + 2,000,000)."""
    d = dies(spark, sf)
    r, c = _symmetry_of(F.col("wafer_id"), F.col("r"), F.col("c"), 26)
    noisy = F.when((F.col("r") * 31 + F.col("c") * 17 + F.col("wafer_id")) % 23 == 0, 3 - F.col("state")).otherwise(F.col("state"))
    copies = [(0, F.col("r"), F.col("c"), F.col("state")), (1000000, r, c, F.col("state")), (2000000, r, c, noisy)]
    return d.select(F.inline(F.array(*[F.struct((F.col("wafer_id") + shift).alias("wafer_id"), y.alias("r"), x.alias("c"), state.alias("state"))
                                       for shift, y, x, state in copies])))


def images(spark: SparkSession, sf: str) -> DataFrame:
    """wafer_id, source, label, palette. Exact copies of even wafers keep their source, all other
    copies are renamed; the noisy copy of every 5th wafer has another label."""
    w = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("long").alias("w")).distinct()
    i = w.select("w", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    w_, k = F.col("w"), F.col("k")
    kept = (k == 0) | ((k == 1) & (w_ % 2 == 0))
    return i.select((w_ + k * 1000000).alias("wafer_id"),
                    F.concat(F.when(kept, "w").when(k == 1, "x").otherwise("n"), w_.cast("string")).alias("source"),
                    class_name(F.when((k == 2) & (w_ % 5 == 0), w_ + 1).otherwise(w_)).alias("label"),
                    F.when((w_ + k) % 6 == 0, "levels").otherwise("standard").alias("palette"))


# --- fixed values: colours of the standard render and of one with other levels (viridis .33, .67)
RENDERS = {"standard": [(68, 1, 84), (33, 145, 140), (253, 231, 37)], "other": [(68, 1, 84), (49, 104, 142), (53, 183, 121)]}


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Every wafer as a picture, each grid cell 4 x 4 pixels; every third image uses other colour
    levels, and one pixel in 29 shows the next state."""
    from diegrid.operators.dies import collect_die_map
    wide = F.flatten(F.transform("row", lambda v: F.array_repeat(v, 4)))
    px = (collect_die_map(dies(spark, sf)).select(F.col("wafer_id").alias("image"), F.posexplode("wafer_map").alias("r", "row"))
          .select("image", (F.col("r") * 4).alias("top"), wide.alias("line"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
          .select("image", (F.col("top") + F.col("i")).alias("y"), F.posexplode("line").alias("x", "state"))
          .select("image", "y", "x", F.col("state").cast("int").alias("state")))
    state = F.when((F.col("y") * 7 + F.col("x") * 13 + F.col("image")) % 29 == 0, (F.col("state") + 1) % 3).otherwise(F.col("state"))

    def channel(k: int) -> Column:
        other, std = (F.element_at(F.array(*[F.lit(c[k]) for c in RENDERS[n]]), F.col("s") + 1) for n in ("other", "standard"))
        return F.when(F.col("image") % 3 == 1, other).otherwise(std)

    return px.select("image", "y", "x", state.alias("s")).select("image", "y", "x", channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def die_px(spark: SparkSession, sf: str) -> DataFrame:
    """Die measurements: the line number is the pixel position inside the die."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").cast("long").alias("wafer_id"), (F.col("l_partkey") % 26).cast("int").alias("r"),
                     (F.col("l_orderkey") % 26).cast("int").alias("c"), F.col("l_linenumber").alias("px"))
            .agg(F.max("l_quantity").alias("value")))
