"""Consistent-hash sharding with virtual nodes and bounded loads.

The ring has ``RING`` slots. Every shard owns ``vnodes`` points on it; the slots up to a point form that point's
arc. A row hashes to a slot, hence to an arc, and all rows of an arc share one preference list: the shards met
clockwise from the arc's point. Loads are bounded by quotas that differ by at most one row, so overflowing rows of
an arc continue to the next shard of its list until one has room.

Only the row count of each arc (at most shards * vnodes numbers, whatever the input) reaches the driver, where the
bounded-load walk is planned; the plan returns to the rows as a constant lookup table. Rows are ranked inside
(arc, sub-arc) cells whose number grows with the input, so no window holds more than about ``CELL_ROWS`` rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

RING = 1 << 14
CELL_ROWS = 20_000


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, in ring order; a taken slot sends the point to the next free one."""
    if shards * vnodes > RING // 2:
        raise ValueError("too many virtual nodes for the ring")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            slot = int(hashlib.md5(f"{shard}#{v}".encode()).hexdigest()[:8], 16) % RING
            while slot in taken:
                slot = (slot + 1) % RING
            taken[slot] = shard
    return sorted(taken.items())


def arc_of_slot(points: list[tuple[int, int]]) -> list[int]:
    """For each slot the index of the first point at or after it, going around."""
    arcs, k = [], 0
    for slot in range(RING):
        while k < len(points) and points[k][0] < slot:
            k += 1
        arcs.append(k % len(points))
    return arcs


def preferences(points: list[tuple[int, int]], arc: int) -> list[int]:
    """The shards in the order in which they are met clockwise from the arc's point."""
    return list(dict.fromkeys(points[(arc + i) % len(points)][1] for i in range(len(points))))


def bounded_plan(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Per arc the pieces (from rank, to rank, shard, slot of the first, hops) that its rows fall into.

    In round r every arc offers what is left of it to the r-th shard of its list; a shard accepts in ring order
    until its quota is full. Quotas are total // shards, one more for the first total % shards of them.
    """
    total = sum(counts.values())
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    done = dict.fromkeys(counts, 0)
    pieces: dict[int, list[tuple[int, int, int, int, int]]] = {arc: [] for arc in counts}
    lists = {arc: preferences(points, arc) for arc in counts}
    for hop in range(shards):
        for arc in sorted(counts):
            shard = lists[arc][hop]
            take = min(counts[arc] - done[arc], quota[shard] - used[shard])
            if take > 0:
                pieces[arc].append((done[arc], done[arc] + take, shard, used[shard], hop))
                done[arc] += take
                used[shard] += take
    return pieces


def shard_documents(docs: DataFrame, shards: int = 8, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places every row in one of ``shards`` shards; row counts differ by at most one (law ``rows``).

    Returns id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot (gapless from 0 in each
    shard), grown_shard (null: the law promises balance, not independence of other rows), home_shard (the ring
    owner before overflow) and hops (shards passed over). A null text counts as empty. A null id hashes like a
    key of its own. Repeated rows are rows. No rows give no rows. Other columns are ignored.
    """
    points = ring(shards, vnodes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.lit("ring"), F.col(id_col))
    arcs = F.expr("cast(split('" + ",".join(map(str, arc_of_slot(points))) + "', ',') as array<int>)")
    arc = arcs[F.pmod(key, F.lit(RING)).cast("int")]
    narrow = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        arc.alias("_arc"),
        key.alias("_key"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # Texts are read once. Rows that agree in id and text may take each other's places, so the place where a row was
    # read may split a hot one over the cells without changing the result.
    narrow = cut(narrow)
    counts = {r["_arc"]: r["n"] for r in narrow.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = bounded_plan(points, counts, shards)
    cells = max(4, -(-sum(counts.values()) // (CELL_ROWS * len(points))), -(-max(counts.values(), default=0) // CELL_ROWS))
    rows = narrow.withColumn("_cell", F.pmod(F.xxhash64(F.lit("cell"), "_id", "text_crc32"), F.lit(cells)).cast("int"))
    hot = cut(rows.groupBy("_id", "text_crc32", "_arc").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CELL_ROWS).select(F.struct("_id", "text_crc32").alias("_pair"), F.lit(True).alias("_hot")))
    if not hot.isEmpty():  # few pairs can have so many rows
        rows = rows.withColumn("_pair", F.struct("_id", "text_crc32")).join(F.broadcast(hot), "_pair", "left").drop("_pair")
        rows = rows.withColumn("_cell", F.when(F.col("_hot"), F.pmod(F.xxhash64("_at"), F.lit(cells)).cast("int")).otherwise(F.col("_cell"))).drop("_hot")
    rows = rows.withColumnRenamed("_id", id_col).drop("_at")
    before = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_arc", "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_arc", "_cell").orderBy("_key", id_col, "text_crc32", "size")
    ranked = rows.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, ["_arc", "_cell"]).withColumn("_rank", F.col("_from") + F.col("_in"))
    pieces = docs.sparkSession.createDataFrame(
        [(arc, *piece) for arc, of in plan.items() for piece in of], "_place int, _lo long, _hi long, shard int, _slot long, hops int"
    )  # at most arcs * shards rows, whatever the input
    placed = ranked.join(F.broadcast(pieces), (F.col("_arc") == F.col("_place")) & (F.col("_lo") <= F.col("_rank")) & (F.col("_rank") < F.col("_hi")))
    owners = F.expr("cast(split('" + ",".join(str(s) for _, s in points) + "', ',') as array<int>)")
    return placed.select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        owners[F.col("_arc")].alias("home_shard"), "hops",
    )
