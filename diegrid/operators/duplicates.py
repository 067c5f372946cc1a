"""Duplicate wafers up to rotation and mirroring, and the leakage audit built on them.

Copies are handled at two levels. Maps that are equal after one of the eight symmetries share an
orbit and are represented by their smallest id, so a group of copies, however large, is one row
of the similarity search and never expands into its pairs; pair counts follow from
multiplicities. Distinct orbits meet through an exact search over blocks of cells (`mask_search`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from diegrid.constants import FINGERPRINT_SIZE
from diegrid.functions.prefix import dense_ids
from diegrid.operators.components import connected_nodes
from diegrid.operators.mask_search import candidate_pairs, packed, packed_dies, similar_pairs
from diegrid.sources.tables import stored

S = FINGERPRINT_SIZE


def fingerprint_cells(cells: DataFrame) -> DataFrame:
    """32 x 32 block means of the model input above one half: (wafer_id, y, x, fail, pass)."""
    g = cells.groupBy("wafer_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(
        F.sum("fn").alias("f"), F.sum("wn").alias("w"), F.max("s2").alias("s2"))
    fail, on = F.col("f") > 2 * F.col("s2"), F.col("w") > 2 * F.col("s2")
    return g.select("wafer_id", "y", "x", fail.alias("fail"), (on & ~fail).alias("pass")).where("fail OR pass")


def _words(g: DataFrame, keys: list[str]) -> DataFrame:
    def word(flag: str) -> Column:
        bit = F.expr("shiftleft(1L, x)")
        return F.coalesce(F.bit_or(F.when(F.col(flag), bit)), F.lit(0).cast("long"))
    return g.groupBy(*keys, "y").agg(word("fail").alias("fail_word"), word("pass").alias("pass_word"))


def fingerprint(cells: DataFrame) -> DataFrame:
    """Masks packed into one word per row."""
    return _words(fingerprint_cells(cells), ["wafer_id"])


def symmetric_cells(fp: DataFrame) -> DataFrame:
    """The eight rotations and mirrors by index arithmetic: adds v, moves y and x."""
    y, x, m = F.col("y"), F.col("x"), S - 1
    images = [(y, x), (x, m - y), (m - y, m - x), (m - x, y), (y, m - x), (x, y), (m - y, x), (m - x, m - y)]
    return fp.select("wafer_id", "fail", "pass", F.inline(F.array(*[
        F.struct(F.lit(v).alias("v"), a.alias("y"), b.alias("x")) for v, (a, b) in enumerate(images)])))


def dihedral_variants(cells: DataFrame) -> DataFrame:
    return _words(symmetric_cells(fingerprint_cells(cells)), ["wafer_id", "v"])


def orbits(masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wafer_id, rep) for every wafer that has both fails and passes, and (rep, canon): the smallest wafer of
    those that are equal under a symmetry, with their common smallest variant."""
    masks = stored(masks, "masks")                       # read by both results
    reps = masks.groupBy("canon").agg(F.min("wafer_id").alias("rep"))
    return masks.join(reps, "canon").select("wafer_id", "rep"), reps.select("rep", "canon")


def near_duplicates(cells: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Similar orbits (a < b, sim) and membership (wafer_id, rep). Both are read several times by what follows.

    Instead of resampled cells there may be dies(wafer_id, r, c, state): far fewer rows, resampled map by map."""
    members, reps = orbits(packed_dies(cells) if "state" in cells.columns else packed(fingerprint(cells)))
    members, reps = stored(members, "members"), stored(reps, "reps")
    return stored(similar_pairs(stored(candidate_pairs(reps, threshold), "candidate_pairs"), reps, threshold), "pairs"), members


def _with_self(pairs: DataFrame, members: DataFrame) -> DataFrame:
    own = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    return pairs.select("a", "b", "sim").union(own.select("rep", "rep", F.lit(1.0)))


def pair_counts(pairs: DataFrame, members: DataFrame, same: list[str] = []) -> DataFrame:
    """(a, b, pairs): image pairs between two orbits (inside one for a = b) that agree in `same`
    columns of members; from multiplicities, without listing them."""
    m = members.groupBy("rep", *same).agg(F.count("*").alias("n"))
    left, right = m.withColumnRenamed("rep", "a").withColumnRenamed("n", "n_a"), m.withColumnRenamed("rep", "b").withColumnRenamed("n", "n_b")
    n = F.when(F.col("a") == F.col("b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("long")
    return pairs.select("a", "b").join(left, "a").join(right, ["b", *same]).groupBy("a", "b").agg(F.sum(n).alias("pairs"))


def near_duplicate_pairs(cells: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Similar orbits with the number of image pairs they stand for; a = b are exact copies.
    Joining `members` on both ends lists the single pairs."""
    pairs, members = near_duplicates(cells, threshold)
    every = _with_self(pairs, members)
    return every.join(pair_counts(every, members), ["a", "b"])


def cross_source_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """members(wafer_id, rep, source): image pairs whose source ids differ."""
    every = _with_self(pairs, members)
    same = pair_counts(every, members, ["source"]).withColumnRenamed("pairs", "same")
    return (every.join(pair_counts(every, members), ["a", "b"]).join(same, ["a", "b"], "left")
            .select("a", "b", "sim", (F.col("pairs") - F.coalesce("same", F.lit(0))).alias("pairs")).where("pairs > 0"))


def leakage_groups(images: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """images(wafer_id, source) -> dense group ids joining equal sources and near duplicates.

    A source is a node (its smallest image id). An orbit links its sources to the smallest one, a
    similar pair of orbits links their smallest sources: the edge list is linear in the images.
    """
    node = images.groupBy("source").agg(F.min("wafer_id").alias("node"))
    placed = images.join(node, "source").select("wafer_id", "node")
    per = members.select("wafer_id", "rep").join(placed, "wafer_id").select("rep", "node").distinct()
    low = per.groupBy("rep").agg(F.min("node").alias("low"))
    edges = per.join(low, "rep").select(F.col("node").alias("a"), F.col("low").alias("b")).union(
        pairs.select("a", "b").join(low.toDF("a", "la"), "a").join(low.toDF("b", "lb"), "b").select("la", "lb"))
    roots = connected_nodes(edges).withColumnRenamed("node", "n")
    grouped = placed.join(roots, placed["node"] == roots["n"], "left").select("wafer_id", F.coalesce("root", "node").alias("root"))
    return grouped.join(dense_ids(grouped, "root", "grp"), "root").select("wafer_id", "grp")


def label_conflicts(images: DataFrame) -> DataFrame:
    """All sources that carry more than one label."""
    return (images.groupBy("source").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
            .select("source"))


def leakage_audit(images: DataFrame, groups: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row: images, sources, groups, cross-source pairs and those with differing labels.

    members carry source and label; differing-label pairs follow by inclusion and exclusion.
    """
    every = _with_self(pairs, members)
    counts = None
    for sign_cross, sign_label, same in ((1, 1, []), (-1, -1, ["source"]), (0, -1, ["label"]), (0, 1, ["source", "label"])):
        part = pair_counts(every, members, same).select((F.col("pairs") * sign_cross).alias("cross"), (F.col("pairs") * sign_label).alias("differ"))
        counts = part if counts is None else counts.union(part)
    totals = counts.agg(F.coalesce(F.sum("cross"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("differ"), F.lit(0)).alias("pairs_differing_labels"))
    return images.join(groups, "wafer_id").agg(
        F.count("*").alias("images"), F.count_distinct("source").alias("sources"), F.count_distinct("grp").alias("groups")).select(
        "*", totals.select("pairs").scalar().alias("pairs"), totals.select("pairs_differing_labels").scalar().alias("pairs_differing_labels"))


def audit_per_class(images: DataFrame, groups: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Per label: images, groups, images with a renamed copy, non-standard palettes.

    An image has a renamed copy when the smallest or largest source among its own and all similar
    orbits is not its own source.
    """
    span = members.groupBy("rep").agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
    near = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("rep", "other")
    reach = (span.union(near.join(span.toDF("other", "lo", "hi"), "other").select("rep", "lo", "hi"))
             .groupBy("rep").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    renamed = (members.join(reach, "rep").where((F.col("lo") != F.col("source")) | (F.col("hi") != F.col("source")))
               .select("wafer_id", F.lit(True).alias("renamed")))
    return (images.join(groups, "wafer_id").join(renamed, "wafer_id", "left").groupBy("label").agg(
        F.count("*").alias("images"), F.count_distinct("grp").alias("independent_wafers"),
        F.count("renamed").alias("images_with_renamed_copy"), F.count_if(F.col("palette") != "standard").alias("nonstandard_palette")))


def grid_shapes(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy(F.concat_ws("x", "height", "width").alias("shape")).agg(F.count("*").alias("n"))
