"""Exact deduplication with counting quotient filters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import quotient_filter
from pathloom.llm.columns import ASCII_SPACE, packed, partitions, small
from pathloom.shared import save_table

#: Fingerprints that one task holds before it turns them into a filter.
BUFFER = 2_000_000

#: Rows of the input for which there is a range of fingerprints, which one task lists.
RANGE_ROWS = 2_000_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(text, ASCII_SPACE, "")


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """The 64-bit values of the only column, ``fp``, that occur more than once among ``rows`` rows.

    Each partition builds a counting quotient filter for each range of high bits. The filters
    of a range merge by their sorted remainders. A value that fills the table leaves each
    task as one entry with a count, so no task gets more than its range of distinct values, and
    ranges become more numerous as rows do.
    """
    bits = max(1, (max(partitions(fingerprints), rows // RANGE_ROWS) - 1).bit_length())

    def filters(batches):
        held, n = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            low = values & np.uint64((1 << (64 - bits)) - 1)
            bucket = (values >> np.uint64(64 - bits)).astype(np.int64)
            for b, at, end in runs(bucket):
                yield int(b), quotient_filter.pack(low[at:end], counts[at:end], 64 - bits)

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(held[-1])
            if n >= BUFFER:
                yield from as_batches(flush())
                held, n = [], 0
        if n:
            yield from as_batches(flush())

    def combine(table: pa.Table) -> pa.Table:
        high = np.uint64(table.column("bucket")[0].as_py() << (64 - bits))
        values, counts = quotient_filter.merged(table.column("filter").to_pylist())
        return pa.table({"fp": (values[counts > 1] | high).view(np.int64)})

    return (
        fingerprints.select("fp")
        .mapInArrow(filters, "bucket int, filter binary")
        .groupBy("bucket")
        .applyInArrow(combine, "fp long")
    )


def runs(keys: np.ndarray):
    """(key, start, end) of each run of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    for at, end in zip(starts, [*starts[1:], len(keys)]):
        yield keys[at], at, end


def as_batches(rows):
    """(bucket, filter) rows as Arrow batches."""
    rows = list(rows)
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "filter"])


def fingerprint(norm: Column) -> Column:
    """The 64-bit fingerprint of a normalised text."""
    return F.xxhash64(norm)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint: Callable[[Column], Column] = fingerprint) -> DataFrame:
    """Find documents whose texts are equal apart from ASCII white space.

    Returns ``row`` (the input row) and ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    Of equal texts the row with the most code points stays, then the one with the smallest id;
    a null id comes last.

    * a null text counts as empty; all empty texts are one group
    * rows that repeat an id and a text are rows of their own: all count, and exactly one of
      the whole group is kept
    * texts whose fingerprints clash are told apart by their bytes; digests decide nothing
    * an empty table gives an empty result; extra columns stay inside ``row``

    Plan: fingerprints alone go through the filters. The documents with a repeated fingerprint are
    grouped by fingerprint and whole text, so the aggregate itself compares bytes; it is partial
    before the exchange, where copies leave a task once. A fingerprint that stands for one text
    then names its group, and the group table, without texts, joins the documents by it; only
    texts whose fingerprints clash join by the text as well.
    """
    base = packed(docs, id_col, text_col).withColumn("norm", normalised(F.col("text")))
    base = base.withColumn("fp", fingerprint(F.col("norm")))
    prints = save_table(base.select("fp", "id", F.length("text").alias("n")), "fingerprints")
    repeated = save_table(repeated_fingerprints(prints, prints.count()), "repeated-fingerprints")
    n_repeated = repeated.count()

    candidates = base.join(small(repeated, n_repeated), "fp", "left_semi").select("fp", "norm", F.length("text").alias("n"), "id")
    # ~id falls as the id rises and cannot overflow; null sorts lowest in a struct.
    best = F.struct("n", F.bitwise_not("id").alias("rank"), "id")
    found = candidates.groupBy("fp", "norm").agg(F.count("*").alias("group_size"), F.max(best).alias("best"))
    found = found.select("fp", "norm", "group_size", F.col("best.id").alias("keep_id"), F.col("best.n").alias("keep_n"), F.lit(True).alias("found"))
    found = save_table(found, "duplicate-groups")
    clashing = found.groupBy("fp").agg(F.count("*").alias("texts")).where("texts > 1").select("fp")
    n_clashing = clashing.count()
    groups, n_groups = found.drop("norm"), found.count()
    shown = base.select("row", "id", F.length("text").alias("n"), "fp", "norm")
    if n_clashing:
        clashing = save_table(clashing, "clashing-fingerprints")
        apart = shown.join(small(clashing, n_clashing), "fp", "left_semi").join(found.join(clashing, "fp", "left_semi"), ["fp", "norm"], "left")
        shown, groups = shown.join(small(clashing, n_clashing), "fp", "left_anti"), groups.join(clashing, "fp", "left_anti")
        joined = shown.join(small(groups, n_groups), "fp", "left").unionByName(apart)
    else:
        joined = shown.join(small(groups, n_groups), "fp", "left")
    joined = joined.withColumn("sha", F.sha2("norm", 256))

    wins = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    joined = joined.withColumn("wins", F.coalesce(wins, F.lit(False)) | F.col("found").isNull())
    stay = prints.join(small(found.drop("norm"), n_groups), "fp").where("id <=> keep_id and n = keep_n").count()
    if stay > n_groups:
        # Rows that repeat the id and length of the row that stays: number them, keep the first.
        several = F.col("wins") & F.col("found").isNotNull()
        numbered = save_table(joined.where(several).withColumn("number", F.monotonically_increasing_id()), "tied-rows")
        first = save_table(numbered.groupBy("fp", "norm").agg(F.min("number").alias("first")), "first-rows")
        numbered = numbered.join(first, ["fp", "norm"]).withColumn("wins", F.col("number") == F.col("first"))
        joined = joined.where(~several).unionByName(numbered.select(joined.columns))
    single = F.col("found").isNull()
    return joined.select(
        "row",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("wins").alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
