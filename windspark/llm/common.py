"""Shared pieces: stored intermediate tables, connected components, tile pairs."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Where that is unset, in local mode a temporary
    folder of this machine is set once and used from then on; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="windspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets this session's Arrow batches to at most ``rows`` rows, for jobs whose rows hold whole texts.

    It keeps the buffers of a task small beside those of the heap; results are the same.
    Spark reads it when a plan is run, so it is a matter of the job, not of an operator: the
    queries and the pipeline call it, the operators leave the session as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    It cuts the lineage, survives lost executors and gives the optimiser true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/windspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store Spark keeps it."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)


def row_keys(df: DataFrame, name: str = "_key") -> DataFrame:
    """``df`` stored once with a number for each row, so that null and repeated ids are no matter.

    A column of ``df`` with that name would be lost and is an error; give another ``name``.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{name} is a column already: name the row key otherwise")
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


def whole_rows(docs: DataFrame):
    """All columns of a row as one struct, safe from name clashes."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def filter_bits(n: int, max_bits: int = 1 << 27) -> int:
    """Size of a Bloom filter for ``n`` keys: 16 bits each, a power of two, bounded (16 MB)."""
    return min(max_bits, 1 << max(20, math.ceil(math.log2(16 * max(n, 1)))))


def _slots(key: str, bits: int) -> list:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) + 1 for k in (0, 1)]


def key_slots(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The two filter slots of every key, as (slot)."""
    return keys.select(F.explode(F.array(*_slots(key, bits))).alias("slot"))


def slot_bitmap(slots: DataFrame) -> DataFrame:
    """(bucket, bitmap) rows of 32,768 slots each; at most bits / 8 bytes in all."""
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )


def mark_in(df: DataFrame, key: str, filter_table: DataFrame, bits: int) -> DataFrame:
    """``df`` with ``_maybe``: false only if the key is surely not in the filter.

    The filter table is broadcast: at most ``bits`` / 8 bytes, whatever the input.
    """
    for k, slot in enumerate(_slots(key, bits)):
        bits_k = filter_table.select(F.col("bucket").alias(f"_b{k}"), F.col("bitmap").alias(f"_m{k}"))
        df = df.withColumn(f"_s{k}", slot).withColumn(f"_b{k}", F.bitmap_bucket_number(f"_s{k}"))
        df = df.join(F.broadcast(bits_k), f"_b{k}", "left")
        at = f"bitmap_bit_position(_s{k})"
        hit = F.expr(
            f"coalesce(shiftright(cast(conv(hex(substring(_m{k}, cast({at} div 8 as int) + 1, 1)), 16, 10)"
            f" as int), cast({at} % 8 as int)) & 1, 0) = 1"
        )
        df = df.withColumn(f"_h{k}", hit).drop(f"_s{k}", f"_b{k}", f"_m{k}")
    return df.withColumn("_maybe", F.col("_h0") & F.col("_h1")).drop("_h0", "_h1")


def likely_in(df: DataFrame, key: str, ids: DataFrame, max_bits: int = 1 << 27) -> DataFrame:
    """``df`` marked with ``_maybe`` for the keys in ``ids`` (same column name), before a join.

    So that wide rows are only shuffled for keys that are there: a join on the marked
    rows stays exact, the filter just spares the others the way.
    """
    bits = filter_bits(ids.count(), max_bits)
    return mark_in(df, key, stored(slot_bitmap(key_slots(ids, key, bits))), bits)


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has one neighbour or is named as neighbour only."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    roles = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table: (node, component).

    ``component`` is the smallest node reachable. Alternating large-star and
    small-star steps; every round is a few aggregations and joins on the node, so no
    node's neighbours are gathered in a list. Nodes without an edge to another node
    do not appear. Null ends and self-loops are ignored.
    """
    e = (
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = stored(e)
    for _ in range(max_rounds):
        if _stars(e):
            break
        old = e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that the many edges of one centre are a skewed join that can be split
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        e = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = (
            e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        e = stored(e)
        dropped(old, low)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def tile_pairs(df: DataFrame, tile: str, n_tiles: str) -> DataFrame:
    """Each row once for every tile pair (``tile_a`` <= ``tile_b``) its tile takes part in.

    A group cut into ``n`` tiles has n (n + 1) / 2 pairs; every pair of rows meets in
    exactly one of them, and no task ever holds more than two tiles.
    """
    return (
        df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(n_tiles) - 1)))
        .withColumn("tile_a", F.least(F.col(tile), F.col("_o")).cast("int"))
        .withColumn("tile_b", F.greatest(F.col(tile), F.col("_o")).cast("int"))
        .drop("_o")
    )


def forest(n: int, pairs) -> list[int]:
    """Roots by position after joining ``pairs`` of positions (small helper in tasks)."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def _column(col):
    """A column of a batch as a NumPy array: numbers as such, anything else as objects."""
    import numpy as np
    import pyarrow as pa

    if (pa.types.is_integer(col.type) or pa.types.is_floating(col.type)) and not col.null_count:
        return col.to_numpy(zero_copy_only=False)
    out = np.empty(len(col), object)
    out[:] = col.to_pylist()
    return out


def by_group(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``run(columns)`` for every group of ``keys``, as applyInPandas but cheap for tiny groups.

    Rows are shuffled by the keys, sorted and streamed through a worker; ``columns`` maps
    names to NumPy arrays of one group and ``run`` returns lists, one for each output
    column. Keys are non-null whole numbers. Only one group is held at a time, so callers
    bound the groups (tiles).
    """
    names = df.columns

    def stream(batches):
        import numpy as np
        import pyarrow as pa

        held: list[list] = []  # slices of the group that may go on in the next batch
        key = None
        fields = None

        def done(out):
            cols = {n: held[0][i] if len(held) == 1 else np.concatenate([h[i] for h in held]) for i, n in enumerate(names)}
            got = run(cols)
            for o, g in zip(out, got):
                o.extend(g)

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, fields)], schema=fields)

        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(kind)
        out = [[] for _ in fields]
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [_column(batch.column(i)) for i in range(len(names))]
            ks = [cols[names.index(k)] for k in keys]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for k in ks:
                change[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], batch.num_rows)
            for a, b in zip(starts.tolist(), ends.tolist()):
                now = tuple(k[a] for k in ks)
                if now != key and held:
                    done(out)
                    held = []
                key = now
                held.append([c[a:b] for c in cols])
            if len(out[0]) >= 5000:
                yield batch_of(out)
                out = [[] for _ in fields]
        if held:
            done(out)
        yield batch_of(out)

    kind = df.sparkSession.createDataFrame([], schema).schema
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)
