"""Mixing sources to target weights.

Words are counted per source; a source's rate is its target over its size. Every document is emitted floor(rate)
times, and once more by a draw seeded by (seed, id, text) whose probability is the fraction of the rate. The draw
depends on nothing else, so it is the same for any partitioning and rerun. n rows that agree in id, text and source
share one draw u in [0, 1) and get floor(n * fraction + u) copies more, so that repeats come near the target too; for
n = 1 that is the single draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

SEED = "mix-2"
BROADCAST_SOURCES = 100_000  # rows of the table of sources that may be broadcast
RUN = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def draw(id_col: Column, hashed: Column, seed: str) -> Column:
    """Uniform in [0, 1): 32 bits of md5(seed:id:hash of the text)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), hashed)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """Target words of each source, from (source, source_size).

    Sources by code point, null last, take the weights in turn. A source takes min(max_repeat * size,
    weight * level), the one level at which all targets add up to all sizes: what capped sources leave is shared
    by weight among the rest until none is above its cap. The level is found in closed form: with the sources in
    the order of cap / weight, it is the first (all - caps before) / (weights from here) at or below its own ratio.
    """
    spread = Window.orderBy(F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    filling = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*map(F.lit, weights))
    ranked = (
        sizes.withColumn("_weight", F.element_at(cycle, (F.pmod(F.row_number().over(spread) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * F.lit(max_repeat))
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(whole))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(earlier), F.lit(0)))
        .withColumn("_left", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(earlier), F.lit(0)))
    )
    level = (F.col("_all") - F.col("_caps")).cast("double") / F.col("_left")
    levels = ranked.withColumn("_level", F.max(F.when(level <= F.col("_ratio"), level)).over(whole))
    target = F.least(F.col("_cap").cast("double"), F.col("_weight") * F.coalesce("_level", F.lit(0.0)))
    return levels.select("source", "source_size", target.alias("target"))


def groups(docs: DataFrame, weights: tuple[int, ...], max_repeat: int, id_col: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """Rows that agree in id, text and source (id, source, hash, size, n, source_size, target, base, extra), and the targets.

    ``base`` copies go to each of the n rows and ``extra`` of them get one more. Null text: size 0. Null source: a
    source of its own. A source without words has target 0 and rate 0. Rates never exceed ``max_repeat``. Equal rows
    are counted before the shuffle, so a row that a third of the table repeats stays one number. Texts are read once.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col("source").alias("source"), text_hash(F.col("text")).alias("hash"), word_count(F.col("text")).alias("size"))
    counted = cut(read.groupBy("id", "source", "hash").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n")))
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = cut(source_targets(totals, weights, max_repeat))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = with_target(counted, targets).withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long"))
    extra = F.floor(F.col("n") * (F.col("rate") - F.floor("rate")) + draw(F.col("id"), F.col("hash"), seed)).cast("long")
    return out.withColumn("extra", extra), targets


def with_target(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (with a column source) and their source's source_size and target; the table is broadcast if it is small."""
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    to = targets.select(F.col("source").alias("_of"), "source_size", "target")
    return rows.join(F.broadcast(to) if small else to, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = SEED) -> DataFrame:
    """What the mix takes of every document, by row. No rows give no rows."""
    got, _ = groups(docs, weights, max_repeat, "doc_id", seed)
    # Rows of a group are made again in runs, so that no array grows with a group.
    runs = got.withColumn("lo", F.explode(F.expr(f"sequence(1L, n, {RUN}L)")))
    rows = runs.withColumn("k", F.explode(F.expr(f"sequence(lo, least(n, lo + {RUN - 1}L))")))
    taken = F.col("base") + (F.col("k") <= F.col("extra")).cast("long")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * taken).alias("taken"), taken.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with, whatever their names.

    Texts stay where they are, unless the sources are too many to broadcast: each row gets its own copies beside its
    text. Only what groups of repeated rows get beyond that is taken from one row of each, by a join on their keys.
    """
    got, targets = groups(docs, weights, max_repeat, id_col, seed)
    many = cut(got.where("n > 1").select(F.struct("id", "source", "hash").alias("key"), "extra"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col(f"row.`{id_col}`").alias("id"), F.col("row.source").alias("source"), text_hash(F.col("row.text")).alias("hash"))
    rows = with_target(rows, targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(rate)).withColumn("one", F.floor(rate - F.floor(rate) + draw(F.col("id"), F.col("hash"), seed)))
    if many.isEmpty():
        return repeated(rows.withColumn("copies", F.col("base") + F.col("one"))).select("row.*")
    rows = rows.withColumn("key", F.struct("id", "source", "hash"))
    joined = rows.join(many, "key", "left")
    each = repeated(joined.withColumn("copies", F.col("base") + F.when(F.col("extra").isNull(), F.col("one")).otherwise(0))).select("row")
    lead = joined.where("extra > 0").groupBy("key").agg(F.first("row").alias("row"), F.first("extra").alias("copies"))
    return each.unionByName(repeated(lead).select("row")).select("row.*")


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its column copies says."""
    return rows.where("copies > 0").withColumn("lo", F.explode(F.expr(f"sequence(1L, copies, {RUN}L)"))).withColumn("_copy", F.explode(F.expr(f"sequence(lo, least(copies, lo + {RUN - 1}L))")))
