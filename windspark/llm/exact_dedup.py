"""Exact dedup by two passes over a Bloom filter, DataFrame functions only.

Pass 1 sets, in a bit table of proven size, the slots that two or more rows hit.
Pass 2 tests every row against it: rows whose slots were hit once cannot have a copy
and pass straight through; only the rest ("possibly repeated") is shuffled by its hash
and grouped exactly, so a false positive of the filter costs time, never a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_bits, key_slots, mark_in, slot_bitmap, stored

#: Deleted before texts are compared: space and the five controls 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"


def text_key(text) -> tuple:
    """(sha-256 of the text without white space, code points of the text); null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.sha2(F.translate(text, SPACE, ""), 256), F.length(text).cast("long")


def repeated_slots(keys: DataFrame, key: str, max_bits: int = 1 << 27) -> tuple[DataFrame, int]:
    """(bucket, bitmap) of the filter slots hit at least twice, and the filter's size in bits.

    The size follows the row count, 16 bits a row, up to ``max_bits`` (2^27, 16 MB, enough
    for 8.4 million rows). With fewer bits a row the filter marks more single rows: 1.4 %
    at 16 bits, 5 % at 8, 15 % at 4, 40 % at 2, and all of them in the end. Then their
    hashes are shuffled, which is the plain method and still exact; raise ``max_bits``, whose
    eighth in bytes is broadcast, where executors can hold more. Only 8-byte slot numbers
    travel here.
    """
    bits = filter_bits(keys.count(), max_bits)
    twice = key_slots(keys, key, bits).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return slot_bitmap(twice), bits


def _order(n, id_col) -> list:
    """Smallest for the row that stays: most code points, then a non-null id before null, then the smallest id."""
    return [(-n).alias("less"), id_col.isNull().alias("no_id"), id_col.alias("keep_id")]


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 27) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty. The row
    with most code points in its original text stays, then the smallest id (null ids
    last). Rows that repeat id and text are copies too: exactly one row of a group is
    kept. Every text is read once; what is stored is one short row per document.
    Other columns of ``docs`` are ignored. Ids may have any type that can be ordered. An
    empty table gives an empty result.
    """
    sha, n = text_key(F.col(text_col))
    short = stored(docs.select(F.col(id_col).alias("id"), sha.alias("sha"), n.alias("n")))
    filter_table, bits = repeated_slots(short, "sha", max_bits)
    marked = mark_in(short, "sha", stored(filter_table), bits)
    alone = marked.where(~F.col("_maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha",
    )
    rows = stored(marked.where("_maybe").groupBy("id", "sha", "n").agg(F.count("*").alias("c")))
    groups = rows.groupBy("sha").agg(
        F.sum("c").alias("group_size"),
        F.min(F.struct(*_order(F.col("n"), F.col("id")))).alias("top"),
    )
    # stored, so that a hash with very many rows is a skewed join that can be split
    groups = stored(groups.select(
        "sha", "group_size", (-F.col("top.less")).alias("keep_n"), "top.keep_id"
    ))
    rest = (
        rows.join(groups, "sha")
        .withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
        .select(
            "id", "keep_id", "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")) & (F.col("k") == 1)).alias("kept"),
            "sha",
        )
    )
    return alone.unionByName(rest).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 27) -> DataFrame:
    """``docs`` with all its columns, one row of every group of equal texts.

    The same rule as :func:`copy_groups`; of rows with the same id and text any one stays.
    Rows the filter clears are not shuffled; of the others, map-side aggregation keeps one
    row per text and task before the shuffle. Columns may have any type, maps too.
    """
    names = docs.columns
    sha, n = text_key(F.col(text_col))
    keys = stored(docs.select(sha.alias("_sha")))
    filter_table, bits = repeated_slots(keys, "_sha", max_bits)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), sha.alias("_sha"), n.alias("_n"))
    marked = mark_in(wide, "_sha", stored(filter_table), bits)
    order = F.struct(*_order(F.col("_n"), F.col(f"_row.`{id_col}`")))
    kept = marked.where("_maybe").groupBy("_sha").agg(F.min_by("_row", order).alias("_row"))
    return (
        marked.where(~F.col("_maybe")).select("_row").unionByName(kept.select("_row"))
        .select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
    )
