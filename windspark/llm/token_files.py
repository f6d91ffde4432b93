"""Token counts of flat, unindexed token files by a separator scan.

A token file is a row of ids of a fixed width with an end-of-document id after each document
and no index; here it is a table of blocks (file_id, block_no, ids). Each block is searched
for separators on its own, vectorised; a prefix scan in two levels, within spans of blocks
and over the sums of spans, then numbers the documents and stitches those that cross
block borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ranges import Ranges
from .pieces import Shared, codec, load_vocabulary

#: End of document: the model's </s>.
END = 2
BLOCK_TOKENS = 1 << 16
#: Blocks that one task of the first level orders.
SPAN = 256


def _kind(id_bytes: int) -> str:
    if id_bytes not in (1, 2, 4, 8):
        raise ValueError(f"ids of {id_bytes} bytes")
    return f"<u{id_bytes}"


def pack(docs: DataFrame, model_path: str, end: int = END, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 2) -> DataFrame:
    """One token file for each input partition, cut in blocks, and the order of its documents.

    Rows: (file_id, block_no, ids) for blocks, (file_id, doc_no, id) for documents; ids
    are little-endian and unsigned, of ``id_bytes`` bytes each, which must hold the
    vocabulary. A null text is an empty document. Store the result before use: file
    numbers are those of this run's partitions.
    """
    kind = _kind(id_bytes)
    vocabulary = load_vocabulary(model_path)
    if max(vocabulary["n"] - 1, end) > np.iinfo(kind).max:
        raise ValueError(f"ids up to {vocabulary['n'] - 1} do not fit in {id_bytes} bytes")
    shared = Shared(docs.sparkSession, vocabulary)
    id_kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file_id = TaskContext.get().partitionId()
        c = codec(shared)
        held, n_held, block_no, doc_no = [], 0, 0, 0

        def batch_of(ids, blocks):
            n = len(blocks)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file_id] * (n + len(ids)), pa.int32()),
                    pa.array([b for b, _ in blocks] + [None] * len(ids), pa.int64()),
                    pa.array([x for _, x in blocks] + [None] * len(ids), pa.binary()),
                    pa.array([None] * n + list(range(doc_no - len(ids), doc_no)), pa.int64()),
                    pa.concat_arrays([pa.nulls(n, ids.type), ids]),
                ],
                names=["file_id", "block_no", "ids", "doc_no", "id"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat, offsets = c.encode_all(part.column(1).to_pylist())
                held.append(np.insert(flat, offsets[1:], end).astype(kind))
                n_held += len(held[-1])
                doc_no += part.num_rows
                blocks = []
                if n_held >= block_tokens:
                    flat = np.concatenate(held)
                    full = len(flat) // block_tokens
                    for k in range(full):
                        blocks.append((block_no + k, flat[k * block_tokens : (k + 1) * block_tokens].tobytes()))
                    block_no += full
                    held = [flat[full * block_tokens :]]
                    n_held = len(held[0])
                yield batch_of(part.column(0), blocks)
        if n_held:
            yield batch_of(pa.nulls(0, batch.column(0).type), [(block_no, np.concatenate(held).tobytes())])

    schema = f"file_id int, block_no long, ids binary, doc_no long, id {id_kind}"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def read_blocks(spark, path: str, id_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of the raw token files under ``path``: (file_id, path, block_no, ids).

    Spark lists the files; the blocks are spread over tasks, and each reads its own byte
    range, so files may have any size. Count with the same ``id_bytes``.
    """
    size = block_tokens * np.dtype(_kind(id_bytes)).itemsize
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / size) - 1)).alias("block_no")
    blocks = files.select(F.xxhash64("path").alias("file_id"), "path", at).repartition("file_id", F.floor(F.col("block_no") / SPAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                raw = [files.read(p, k * size, size) for p, k in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=["file_id", "path", "block_no", "ids"])
        files.close()

    return blocks.mapInArrow(run, "file_id long, path string, block_no long, ids binary")


def count_tokens(blocks: DataFrame, end: int = END, id_bytes: int = 2) -> DataFrame:
    """(file_id, doc_no, n_tokens, closed) of every document in (file_id, block_no, ids).

    Counts leave the separator out. Tokens after a file's last separator are a document
    with closed = false; none is reported if the file ends with a separator. Empty
    documents count 0; null and empty blocks are allowed; an id cut in two by a block's end is
    an error. Spans of ``SPAN`` blocks are ordered by themselves, then the sums of spans, a few
    numbers each, by file.
    """
    kinds, kind = dict(blocks.dtypes), _kind(id_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(2).to_pylist():
                if len(raw or b"") % id_bytes:
                    raise ValueError(f"a block of {len(raw)} bytes does not hold whole ids of {id_bytes} bytes")
                ids = np.frombuffer(raw or b"", kind)
                at = np.flatnonzero(ids == end)
                if len(at):
                    rows.append((len(ids), len(at), int(at[0]), len(ids) - 1 - int(at[-1]), (np.diff(at) - 1).tolist()))
                else:
                    rows.append((len(ids), 0, len(ids), len(ids), []))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(cols[i], pa.int64()) for i in range(4)], pa.array(cols[4], pa.list_(pa.int64()))],
                names=["file_id", "block_no", "size", "n_sep", "head", "tail", "inner"],
            )

    schema = f"file_id {kinds['file_id']}, block_no {kinds['block_no']}, size long, n_sep long, head long, tail long, inner array<long>"
    s = blocks.select("file_id", "block_no", "ids").mapInArrow(scan, schema).withColumn("span", F.floor(F.col("block_no") / SPAN))
    order = Window.partitionBy("file_id", "span").orderBy("block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    # places are counted from the start of the span; open_from is where the last document of a block begins
    s = s.withColumns({"size_before": sum_before("size", before), "sep_before": sum_before("n_sep", before)})
    s = s.withColumn("open_from", F.when(F.col("n_sep") > 0, F.col("size_before") + F.col("size") - F.col("tail")))
    s = s.withColumn("opened", F.last("open_from", True).over(before))
    spans = s.groupBy("file_id", "span").agg(F.sum("size").alias("span_size"), F.sum("n_sep").alias("span_sep"), F.max("open_from").alias("span_open"))
    by_file = Window.partitionBy("file_id").orderBy("span")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"at": sum_before("span_size", earlier), "doc_at": sum_before("span_sep", earlier)})
    spans = spans.withColumn("open_at", F.coalesce(F.last(F.col("at") + F.col("span_open"), True).over(earlier), F.lit(0)))
    s = s.join(spans.select("file_id", "span", "at", "doc_at", "open_at"), ["file_id", "span"])
    carry = F.col("at") + F.col("size_before") - F.coalesce(F.col("at") + F.col("opened"), "open_at")
    counts = F.concat(F.array(carry + F.col("head")), "inner")
    done = s.where("n_sep > 0").select("file_id", (F.col("doc_at") + F.col("sep_before")).alias("first"), F.posexplode(counts).alias("k", "n_tokens")).select(
        "file_id", (F.col("first") + F.col("k")).alias("doc_no"), "n_tokens", F.lit(True).alias("closed")
    )
    ends = spans.groupBy("file_id").agg(F.sum("span_sep").alias("doc_no"), (F.sum("span_size") - F.coalesce(F.max(F.col("at") + F.col("span_open")), F.lit(0))).alias("n_tokens"))
    rest = ends.where("n_tokens > 0").select("file_id", "doc_no", "n_tokens", F.lit(False).alias("closed"))
    return done.unionByName(rest)
