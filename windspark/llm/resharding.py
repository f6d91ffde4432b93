"""Resharding by minimum-cost flow.

Rows of an old shard are put in blocks by size class. A flow from blocks to new shards,
whose capacities are the new row counts, decides how many rows of every block stay and
where the others go; a row costs its block's mean bytes when it moves and nothing when
it stays. Blocks are ordered by size and the smallest rows of a split block leave, so a
shard loses its smallest rows and the flow moves the fewest bytes that the capacities
allow. Only counts reach the driver, at most (old shards) x ``CLASSES`` blocks; rows find
their place by ranks within a block.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, dropped, stored

#: Size classes: quarter powers of two, so one class spans less than 19 % in size.
CLASSES = 96


def row_size(text):
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def min_cost_flow(supply: list[tuple[int, int, float]], capacity: list[int]) -> list[tuple[int, int, int]]:
    """Transfers (block, new shard, rows) that move the fewest bytes.

    ``supply``: (home shard, rows, cost of moving one row) by block; staying home is
    free. All arcs out of a block cost the same, so the network reduces to home arcs and
    one common arc: successive cheapest paths push each shard's surplus out through its
    cheapest blocks, then fill the shards that have room in order.
    """
    room = list(capacity)
    staying = [0] * len(supply)
    by_home: dict[int, list[int]] = {}
    for k, (home, _, _) in enumerate(supply):
        by_home.setdefault(home, []).append(k)
    leaving: list[tuple[float, int, int]] = []
    for home, blocks in by_home.items():
        for k in sorted(blocks, key=lambda k: (-supply[k][2], k)):  # the dearest stay first
            free = room[home] if 0 <= home < len(room) else 0
            staying[k] = min(supply[k][1], free)
            if staying[k]:
                room[home] -= staying[k]
            if supply[k][1] > staying[k]:
                heapq.heappush(leaving, (supply[k][2], k, supply[k][1] - staying[k]))
    out = [(k, supply[k][0], n) for k, n in enumerate(staying) if n]
    open_shards = [j for j, r in enumerate(room) if r]
    while leaving:
        _, k, n = heapq.heappop(leaving)
        while n:
            if not open_shards:
                raise ValueError("the capacities are smaller than the rows")
            j = open_shards[-1]
            take = min(n, room[j])
            out.append((k, j, take))
            room[j] -= take
            n -= take
            if not room[j]:
                open_shards.pop()
    return out


def ranked(df: DataFrame, group: list[str], order: list, rank: str, slice_rows: int = 50_000, salt: list | None = None) -> DataFrame:
    """``df`` with a gapless rank from 0 within each group, also for groups of any size.

    A group is cut by hash into slices of about ``slice_rows``; a row's rank is its place
    in its slice plus the rows of earlier slices. ``salt`` (the order where not given) must
    tell equal rows apart, or they share a slice. Group columns are not null.
    """
    n = df.groupBy(*group).agg(F.ceil(F.count("*") / slice_rows).alias("_n"))
    keys = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    same = keys[0]
    for k in keys[1:]:
        same = same & k
    n = n.select(*[F.col(c).alias(f"_g_{c}") for c in group], "_n")
    cut = df.join(n, same).drop(*[f"_g_{c}" for c in group])
    cut = cut.withColumn("_slice", F.pmod(F.xxhash64(*(salt or order)), F.col("_n"))).drop("_n")
    counts = cut.groupBy(*group, "_slice").agg(F.count("*").alias("_c"))
    offsets = counts.select(
        *[F.col(c).alias(f"_g_{c}") for c in group], F.col("_slice").alias("_s"),
        (F.sum("_c").over(Window.partitionBy(*group).orderBy("_slice")) - F.col("_c")).alias("_from"),
    )
    place = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order)) - 1
    cut = cut.withColumn("_place", place).join(offsets, same & (F.col("_slice") == F.col("_s")))
    return cut.withColumn(rank, (F.col("_from") + F.col("_place")).cast("long")).drop(
        "_slice", "_s", "_from", "_place", *[f"_g_{c}" for c in group]
    )


def plan_transfers(sizes: DataFrame, shards: int) -> tuple[list[dict], list[int]]:
    """Transfers with block-wise row ranges, and the new capacities.

    ``sizes`` has (old_shard, size_class, size). Capacities are equal row counts, the
    remainder going to the shards that already hold most rows.
    """
    blocks = sizes.groupBy("old_shard", "size_class").agg(F.count("*").alias("n"), F.avg("size").alias("cost")).collect()
    blocks.sort(key=lambda b: (b.old_shard, b.size_class))
    total = sum(b.n for b in blocks)
    held = [0] * shards
    for b in blocks:
        if 0 <= b.old_shard < shards:
            held[b.old_shard] += b.n
    more = set(sorted(range(shards), key=lambda j: (-held[j], j))[: total % shards])
    capacity = [total // shards + (j in more) for j in range(shards)]
    at: dict[int, int] = {}
    out = []
    for k, j, n in min_cost_flow([(b.old_shard, b.n, b.cost) for b in blocks], capacity):
        b = blocks[k]
        out.append({"old_shard": b.old_shard, "size_class": b.size_class, "first": at.get(k, 0), "last": at.get(k, 0) + n - 1, "shard": j})
        at[k] = at.get(k, 0) + n
    return out, capacity


def reshard(docs: DataFrame, shards: int, old_shard, id_col: str = "doc_id", text_col: str = "text", row_key: str | None = None) -> DataFrame:
    """Law ``rows``: one row per row of ``docs`` with id, size, text_crc32, old_shard, shard, slot.

    ``old_shard`` is a column (null counts as 0; numbers past the new count empty out).
    New shards hold row counts at most one apart and are reached by moving the fewest
    bytes. Slots run from 0 without a gap in each shard. Texts stay where they are: only
    ids and sizes are shuffled, and a text equal to many others is one row like any
    other. Empty tables give empty results; repeated ids are rows of their own. ``row_key``
    names a stored key of ``docs`` (``row_keys``) to carry through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = row_size(F.col(text_col))
    own = F.monotonically_increasing_id() if row_key is None else F.col(row_key)
    short = stored(
        docs.select(
            F.col(id_col).alias("id"), size.alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
            F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"), own.alias("_key"),
        ).withColumn("size_class", F.least(F.floor(F.log2("size") * 4), F.lit(CLASSES - 1)).cast("int"))
    )
    spark = docs.sparkSession
    transfers, _ = plan_transfers(short, shards)
    if not transfers:
        transfers = [{"old_shard": -1, "size_class": -1, "first": 0, "last": -1, "shard": 0}]
    plan = spark.createDataFrame(transfers, "old_shard int, size_class int, first long, last long, shard int")
    plan = plan.groupBy("old_shard", "size_class").agg(F.array_sort(F.collect_list(F.struct("last", "shard"))).alias("to"))
    order = [F.col("id"), F.col("text_crc32"), F.col("size"), F.col("_key")]
    # ranks by falling size: rows of a larger size come first, those of one size follow the order
    block = ["old_shard", "size_class"]
    larger = short.groupBy(*block, "size").agg(F.count("*").alias("_same"))
    larger = larger.withColumn("_larger", F.sum("_same").over(Window.partitionBy(*block).orderBy(F.desc("size"))) - F.col("_same")).drop("_same")
    rows = ranked(short, [*block, "size"], order, "rank").join(larger, [*block, "size"]).withColumn("rank", F.col("rank") + F.col("_larger")).drop("_larger")
    # bounded: shards x size classes blocks, with at most that many transfers in all
    rows = rows.join(F.broadcast(plan), ["old_shard", "size_class"])
    rows = rows.withColumn("shard", F.expr("filter(to, x -> x.last >= rank)[0].shard")).drop("to", "rank", "size_class")
    return ranked(rows, ["shard"], order, "slot").select(
        F.col("id").alias(id_col), "size", "text_crc32", "old_shard", "shard", "slot", *([] if row_key is None else [F.col("_key").alias(row_key)])
    )


def rewrite_affected(placed: DataFrame, docs: DataFrame, path: str, id_col: str = "doc_id", row_key: str | None = None, file_bytes: int = 256 << 20) -> list[int]:
    """Write anew the shards of ``path`` that lose or gain rows; the folders of the others stay untouched.

    ``path`` holds a folder for each shard, as this function writes them, or nothing yet.
    ``docs`` may be what was read from there: the rows are stored before anything is
    replaced, and its columns ``shard`` and ``slot`` give way to the new ones. A shard that
    loses all rows loses its folder. Returns the shards affected. With the ``row_key`` that
    :func:`reshard` carried, every row finds its place; without one, ids that are null or
    repeated are an error. A shard is written by as many tasks as it has ``file_bytes``.
    """
    if row_key is None and not placed.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        raise ValueError(f"{id_col} is null or repeated: a row key is needed")
    on = row_key or id_col
    moved = placed.where("shard <> old_shard")
    touched = moved.select("shard").unionByName(moved.select(F.col("old_shard").alias("shard"))).distinct()
    shards = sorted(r.shard for r in touched.collect())  # shard numbers only
    if not shards:
        return shards
    own = placed.where(F.col("shard").isin(shards))
    sizes = {r.shard: r.n for r in own.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    rows = own.select(on, "shard", "slot").join(docs.drop("shard", "slot"), on)
    if row_key is not None:
        rows = rows.drop(row_key)
    tasks = max(len(sizes), math.ceil(sum(sizes.values()) / file_bytes))
    rows = stored(rows)
    dealt = rows.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for shard in set(shards) - set(sizes):
        delete(placed.sparkSession, f"{path}/shard={shard}")
    dropped(rows)
    return shards
