"""Operators on voxel grids: (image, x, y, z, value) with integer coordinates. Zero is background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def unravel(voxel: Column, shape: tuple[int, int, int]) -> list[Column]:
    return [F.floor(voxel / (shape[1] * shape[2])).cast("int"), (F.floor(voxel / shape[2]) % shape[1]).cast("int"), (voxel % shape[2]).cast("int")]


def bounding_box(cells: DataFrame, by: list[str]) -> DataFrame:
    """Smallest and largest coordinates of the non-zero voxels."""
    return cells.where("value <> 0").groupBy(*by).agg(*[f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "lo"), (F.max, "hi"))])


def collapse(cells: DataFrame, above: float | None = None) -> DataFrame:
    """All images in their common box, its corner at 0: the sum at each voxel, or 1 where it exceeds the threshold."""
    box = F.broadcast(cells.where("value <> 0").agg(*[F.min(a).alias(f"lo_{a}") for a in AXES]))
    shifted = cells.where("value <> 0").crossJoin(box).select(*[(F.col(a) - F.col(f"lo_{a}")).alias(a) for a in AXES], "value")
    total = shifted.groupBy(*AXES).agg(F.sum("value").alias("value"))
    return total if above is None else total.where(F.col("value") > above).withColumn("value", F.lit(1.0))


def resample_nearest(cells: DataFrame, factor: int) -> DataFrame:
    """Each voxel of the finer grid takes the value of the voxel that holds it; a coarser grid takes the first corner."""
    if factor >= 1:
        fine = cells
        for a in AXES:
            fine = fine.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn(a, F.col(a) * factor + F.col("_s")).drop("_s")
        return fine
    step = round(1 / factor)
    first = [F.pmod(F.col(a), F.lit(step)) == 0 for a in AXES]
    return cells.where(first[0] & first[1] & first[2]).select(*[c for c in cells.columns if c not in AXES], *[F.floor(F.col(a) / step).cast("int").alias(a) for a in AXES])


def downsample_mean(cells: DataFrame, step: int, by: list[str]) -> DataFrame:
    """Continuous resampling onto a coarser grid: the mean over each block."""
    return cells.groupBy(*by, *[F.floor(F.col(a) / step).cast("int").alias(a) for a in AXES]).agg(F.avg("value").alias("value"))


def flip(cells: DataFrame, axis: str, size: int) -> DataFrame:
    return cells.withColumn(axis, size - 1 - F.col(axis))


def spheres(centres: DataFrame, radius: float, kind: str = "plain") -> DataFrame:
    """Voxels (id, x, y, z, value) within the radius of centres (id, x, y, z): 1, or 1 - d / r for ``concentric``, or
    d / r for ``eccentric``. The cube around each centre is laid out, so nothing is joined."""
    r = int(radius)
    out = centres.select("id", *[F.col(a).alias("c" + a) for a in AXES])
    for a in AXES:
        out = out.withColumn(a, F.explode(F.sequence(F.floor("c" + a).cast("int") - r, F.ceil("c" + a).cast("int") + r)))
    d = F.sqrt(sum((F.col(a) - F.col("c" + a)) * (F.col(a) - F.col("c" + a)) for a in AXES))
    value = {"plain": F.lit(1.0), "concentric": 1 - d / radius, "eccentric": d / radius}[kind]
    return out.where(d <= radius).select("id", *AXES, value.alias("value"))


def box_sums(cells: DataFrame, size: int = 3) -> DataFrame:
    """The sum over the window of ``size`` voxels forward along each axis, at every non-zero voxel's reach; windows at
    the edge are cut off. Axes are summed one after another."""
    out = cells
    for a in AXES:
        spread = out.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn(a, F.col(a) - F.col("_s")).where(F.col(a) >= 0)
        out = spread.groupBy("image", *AXES).agg(F.sum("value").alias("value"))
    return out


def clusters(cells: DataFrame, above: float = 0.0, width: int = 16, full: bool = True) -> DataFrame:
    """image, x, y, z, value, cluster: connected voxels (26 neighbours, or 6) above the threshold carry their smallest
    place; labels settle by pointer jumping on written tables, in a number of rounds that grows with the logarithm."""
    on = cells.where(F.col("value") > above).select("image", *AXES, "value", (F.struct(*AXES)).alias("place"))
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0) and (full or abs(i) + abs(j) + abs(k) == 1)]
    offset = F.explode(F.array(*[F.struct(*[F.lit(v).alias("d" + a) for v, a in zip(s, AXES, strict=True)]) for s in steps]))
    near = on.select("image", F.col("place").alias("a"), offset.alias("d")).select("image", "a", F.struct(*[(F.col("a." + a) + F.col("d.d" + a)).alias(a) for a in AXES]).alias("b"))
    edges = near.join(on.select("image", F.col("place").alias("b")), ["image", "b"])
    label = label_components(edges, on.select("image", "place"))
    return on.join(label, ["image", "place"]).select("image", *AXES, "value", F.col("label").alias("cluster"))


def label_components(edges: DataFrame, nodes: DataFrame, most: int = 60) -> DataFrame:
    """(image, place, label): smallest place of the component of every node; edges are (image, a, b)."""
    from marram.operators.lineage import cut

    both = cut(edges.select("image", "a", "b").unionByName(edges.select("image", F.col("b").alias("a"), F.col("a").alias("b"))))
    now = cut(nodes.withColumn("label", F.col("place")))
    for _ in range(most):
        around = both.join(now.select("image", F.col("place").alias("b"), F.col("label").alias("m")), ["image", "b"]).groupBy("image", F.col("a").alias("place")).agg(F.min("m").alias("m"))
        least = now.join(around, ["image", "place"], "left").select("image", "place", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = least.select("image", F.col("place").alias("label"), F.col("label").alias("further"))
        moved = cut(least.join(jump, ["image", "label"], "left").select("image", "place", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        if moved.where("label <> old").isEmpty():
            return moved.select("image", "place", "label")
        now = moved.select("image", "place", "label")
    raise RuntimeError(f"labels did not settle in {most} rounds")


def large_clusters(labelled: DataFrame, least: int) -> DataFrame:
    """Voxels of clusters of at least that many voxels."""
    n = labelled.groupBy("image", "cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return labelled.join(n, ["image", "cluster"])


def tfce(labelled: DataFrame, step: float, extent: float = 0.5, height: float = 2.0) -> DataFrame:
    """Per voxel the sum over heights h of (voxels of its cluster at or above h)^extent h^height step.

    Clusters are those above 0. The heights a voxel reaches are laid out, and counts per cluster and height joined.
    """
    up = labelled.withColumn("_k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("value") / step + 1e-9).cast("int"))))).where(F.col("_k") * step <= F.col("value") + 1e-9)
    n = up.groupBy("image", "cluster", "_k").agg(F.count(F.lit(1)).alias("_n"))
    h = F.col("_k") * step
    return up.join(n, ["image", "cluster", "_k"]).groupBy("image", *AXES).agg(F.sum(F.pow(F.col("_n").cast("double"), F.lit(extent)) * F.pow(h, F.lit(height)) * step).alias("tfce"))


def atlas_groups(parcels: DataFrame, names: DataFrame, group: Column) -> DataFrame:
    """Voxels (x, y, z, index) of an atlas as 0/1 images of groups of its labels (index, name)."""
    return parcels.join(F.broadcast(names.withColumn("group", group)), "index").select("group", *AXES).distinct().withColumn("value", F.lit(1.0))


def coverage(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Per image and group the share of the group's voxels that the image covers."""
    size = regions.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    hit = images.where("value > 0").join(regions.select("group", *AXES), list(AXES)).groupBy("image", "group").agg(F.count(F.lit(1)).alias("_h"))
    return hit.join(size, "group").select("image", "group", (F.col("_h") / F.col("_n")).alias("share"))


def value_at(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Each point (id, x, y, z real) with the value of its nearest voxel; null outside."""
    p = points.select("id", *[F.floor(F.col(a) + 0.5).cast("int").alias(a) for a in AXES])
    return p.join(cells, list(AXES), "left").select("id", "value")


def dilate(cells: DataFrame, steps: int = 1) -> DataFrame:
    """Non-zero voxels grow by the cube of that reach; values are 1."""
    out = cells.where("value <> 0").select("image", *AXES)
    for a in AXES:
        out = out.withColumn("_s", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).withColumn(a, F.col(a) + F.col("_s")).drop("_s")
    return out.distinct().withColumn("value", F.lit(1.0))


def stack(images: DataFrame, order: str) -> DataFrame:
    """A fourth axis: the place of each image in the order."""
    frames = images.select("image", order).distinct()
    place = frames.withColumn("frame", F.row_number().over(Window.orderBy(order)) - 1)
    return images.join(F.broadcast(place.select("image", "frame")), "image")


def nearest_voxel(points: DataFrame, masks: DataFrame, reach: int = 8) -> DataFrame:
    """Each point (id, x, y, z) snapped to the nearest mask voxel within ``reach``; ties to the smallest place."""
    near = points.select("id", *[F.col(a).alias("p" + a) for a in AXES])
    for a in AXES:
        near = near.withColumn("g" + a, F.explode(F.sequence(F.floor((F.col("p" + a) - reach) / reach), F.floor((F.col("p" + a) + reach) / reach))))
    at = masks.select(*AXES, *[F.floor(F.col(a) / reach).alias("g" + a) for a in AXES])
    d = sum((F.col(a) - F.col("p" + a)) * (F.col(a) - F.col("p" + a)) for a in AXES)
    j = near.join(at, ["gx", "gy", "gz"]).withColumn("d", F.round(d, 9)).where(F.col("d") <= reach * reach)
    return j.groupBy("id").agg(F.min(F.struct("d", *AXES)).alias("m")).select("id", *[F.col("m." + a).alias(a) for a in AXES], F.sqrt("m.d").alias("distance"))
