"""Token ids in training order, in shards of fixed-stride records.

Every sequence (a document's next SEQUENCE ids) has a dense number; a keyed Feistel permutation
of those numbers is its slot in the training order. Shard s holds the slots from s * records on,
one record per slot in order, so a reader that has used k sequences goes on at record
k % records of shard k // records.

A record is a header (id, piece, number of ids, flags), SEQUENCE ids as unsigned numbers of 16 bits
(32 for vocabularies of more than 65,536 entries), zero-filled, and a trailer of four zero bytes.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.columns import BATCH_BYTES, packed, small
from pathloom.llm.tokens import END_ID, encoder
from pathloom.shared import delete_path, new_path, release

#: Ids in a record, and records in a shard.
SEQUENCE, SHARD_RECORDS = 256, 16_384

#: Shards are written in so many turns, each of which shuffles its share of the records only.
ROUNDS = 4

TRAILER = "\x00\x00\x00\x00"
_HEADER = struct.Struct("<qiHH")
_NULL_ID = 1  # flag: the document has no id


def stride(sequence: int = SEQUENCE, width: int = 2) -> int:
    """Bytes of a record whose ids take ``width`` bytes each."""
    return _HEADER.size + width * sequence + len(TRAILER)


# ---------------------------------------------------------------- the permutation


class Permutation:
    """A keyed bijection of the numbers below ``n``.

    A balanced Feistel network permutes the smallest even number of bits that covers ``n``;
    a result of ``n`` or more is permuted again until it is below (cycle walking), which takes
    fewer than four steps on average.
    """

    def __init__(self, n: int, key: str, rounds: int = 6):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        digests = [hashlib.sha256(f"{key}/{r}".encode()).digest() for r in range(rounds)]
        self.keys = [(np.uint64(int.from_bytes(d[:8], "little")), np.uint64(int.from_bytes(d[8:16], "little") | 1)) for d in digests]

    def _once(self, x: np.ndarray, backwards: bool = False) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for add, times in reversed(self.keys) if backwards else self.keys:
            turned = left if backwards else right
            mixed = (turned + add) * times
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(32))) & mask
            left, right = (right ^ mixed, left) if backwards else (right, left ^ mixed)
        return (left << half) | right

    def _walk(self, x, backwards):
        out = self._once(np.asarray(x, np.uint64), backwards)
        while (beyond := out >= np.uint64(self.n)).any():
            out[beyond] = self._once(out[beyond], backwards)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False) if len(numbers) else np.zeros(0, np.int64)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The inverse."""
        return self._walk(slots, True) if len(slots) else np.zeros(0, np.int64)


# ---------------------------------------------------------------- records


def packed_record(id_: int | None, piece: int, ids: np.ndarray) -> bytes:
    """The record of some ids, without padding and trailer."""
    return _HEADER.pack(id_ or 0, piece, len(ids), _NULL_ID if id_ is None else 0) + ids.tobytes()


def unpacked_record(raw: bytes, at: int, width: int = 2) -> tuple[int | None, int, int, bytes]:
    """(id, piece, number of ids, ids) of the record at an offset."""
    i, piece, n, flags = _HEADER.unpack_from(raw, at)
    at += _HEADER.size
    return None if flags & _NULL_ID else i, piece, n, raw[at : at + width * n]


# ---------------------------------------------------------------- writing


def records(docs: DataFrame, path: str, sequence: int, width: int) -> DataFrame:
    """(record) for every sequence of the packed ``docs``, without padding and trailer."""

    def run(batches):
        encode = encoder(path).ids
        for batch in batches:
            rows, size = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), END_ID], f"<u{width}")
                for k, at in enumerate(range(0, len(ids), sequence)):
                    rows.append(packed_record(i, k, ids[at : at + sequence]))
                    size += len(rows[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    return docs.select("id", "text").mapInArrow(run, "record binary")


def id_width(path: str) -> int:
    """Bytes of an id of the vocabulary."""
    return 2 if encoder(path).size <= 1 << 16 else 4


def dealt_shards(placed: DataFrame, shard_records: int, low: int, high: int) -> DataFrame:
    """The rows of shards ``low`` to ``high`` - 1 by ranges of shards, in order of their slots in each.

    Shards are equally large and their bounds are known, so a range of slots for each splits the
    rows evenly; nothing has to be sampled to find the bounds.
    """
    part = placed.withColumn("shard", F.floor(F.col("slot") / shard_records).cast("int")).where((F.col("shard") >= low) & (F.col("shard") < high))
    return part.repartitionById(high - low, F.col("shard") - low).sortWithinPartitions("shard", "slot")


def write_training_order(docs: DataFrame, path: str, out: str, key: str = "pathloom", sequence: int = SEQUENCE, shard_records: int = SHARD_RECORDS, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Tokenise, permute and write all sequences below ``out``; returns their number.

    * a null text counts as empty and is one sequence with the end id alone
    * repeated rows are sequences of their own; a null id is flagged in the record
    * an empty table writes nothing; extra columns are ignored

    Plan: tokenised sequences are saved once. A sequence's number is its row's place in its
    file plus the sequences of the files before, which needs counts per file only. Its slot
    is computed, so an exchange by ranges of shards and a sort inside it write every shard in one
    piece; turns over ranges of shards bound what is in the exchange at a time.
    """
    spark, width = docs.sparkSession, id_width(path)
    saved = new_path(spark, "sequences")
    records(packed(docs, id_col, text_col), path, sequence, width).write.option("compression", "zstd").parquet(saved)
    release(spark)
    table = spark.read.schema("record binary").parquet(saved)
    files = table.select(F.col("_metadata.file_path").alias("file")).groupBy("file").count().orderBy("file").collect()
    starts, total = [], 0
    for row in files:
        starts.append((row["file"], total))
        total += row["count"]
    if not total:
        return 0
    order = Permutation(total, key)
    shards = -(-total // shard_records)

    @F.arrow_udf("long")
    def slot_of(number: pa.Array) -> pa.Array:
        return pa.array(order.slots(number.to_numpy()))

    # One row per file that a task has written. Only numbers go to Python, the records do not.
    first = small(spark.createDataFrame(starts, "file string, first long"), len(starts))
    numbered = table.select("record", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = numbered.join(first, "file").select("record", slot_of(F.col("first") + F.col("row")).alias("slot"))
    per_round = -(-shards // ROUNDS)
    for low in range(0, shards, per_round):
        dealt = dealt_shards(placed, shard_records, low, min(low + per_round, shards))
        padded = F.rpad(F.col("record"), stride(sequence, width) - len(TRAILER), F.lit(b"\x00"))
        # The text writer puts the bytes of a string out as they are. A shard has to be one file.
        writer = dealt.select("shard", padded.cast("string").alias("value")).write.mode("append").partitionBy("shard")
        writer.option("lineSep", TRAILER).option("maxRecordsPerFile", 0).text(out)
        release(spark)
    delete_path(spark, saved)
    return total


# ---------------------------------------------------------------- reading


def read_training_order(spark: SparkSession, out: str, start: int = 0, sequence: int = SEQUENCE, shard_records: int = SHARD_RECORDS, width: int = 2) -> DataFrame:
    """(slot, id, piece, length, ids) of all sequences from slot ``start`` on, read back from the shards.

    Shards before the one that holds ``start`` are not opened. ``width`` is that of an id.
    """
    size = stride(sequence, width)

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_py()
                if len(raw) % size:
                    raise ValueError(f"shard {shard} is not made of whole records")
                rows = []
                for k in range(len(raw) // size):
                    slot = shard * shard_records + k
                    if slot >= start:
                        rows.append((slot, *unpacked_record(raw, k * size, width)))
                cols = list(zip(*rows)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["slot", "id", "piece", "length", "ids"])

    files = spark.read.format("binaryFile").load(out).where(F.col("shard") >= start // shard_records)
    return files.select("shard", "content").mapInArrow(run, "slot long, id long, piece int, length int, ids binary")
