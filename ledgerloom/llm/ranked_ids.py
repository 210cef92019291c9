"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file set is a Parquet table of blocks in ascending doc_id order, plus the table of ranks. A block holds consecutive
documents (about BLOCK_IDS ids; a longer document has a block of its own):

    part, seq     place of the block: part, then number of its first document in the part
    before        ids of the part before the block
    doc_ids       the documents (int64, null as a list entry)
    lengths       ids of each document, little-endian unsigned 64-bit
    control       two bits an id, four ids a byte, lowest bits first: bytes of the id's rank, less one
    data          the ranks, each in 1 to 4 little-endian bytes

Documents are encoded where they are read; only their ids, in two or four bytes each, are sorted by doc_id. Ranks go by
frequency over all documents, most frequent first, ties by id, so the frequent ids take one byte. Reading
needs no loop over ids: a numpy table turns each control byte into four lengths, running sums give the places, and each
rank is gathered from up to four bytes. Blocks are written by Spark's committer, so a lost executor leaves no torn file.

Edge cases: a null text counts as empty and has the end id alone; null doc_ids come first; ties of doc_id are ordered by
a checksum of the text; repeated rows are documents of their own; an empty table gives no block; other columns are ignored. The driver holds one row for each
vocabulary entry and one for each part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, prepare, stored, swept, text_of, work_path
from ledgerloom.llm.tokens import Encoder, slices

END_ID = 2
BLOCK_IDS = 1 << 18
#: Characters encoded at once, and pieces of text whose ids a worker remembers.
CHARS, REMEMBERED = 2_000_000, 400_000
#: Lengths of the four ids of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Ranks (uint16 or uint32) -> control bytes and data bytes."""
    width = ranks.dtype.itemsize
    more = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    used = np.ones((len(ranks), width), bool)
    for k in range(1, width):
        np.greater(ranks, (1 << (8 * k)) - 1, out=used[:, k])
        more[: len(ranks)] += used[:, k]
    quads = more.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, width)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """Inverse of encode_ranks, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    place = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = raw[place].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.nonzero(size > k)[0]
        if not len(more):
            break
        ranks[more] |= raw[place[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def tokenised(tokenizer: str):
    """(doc_id, tie, text) -> (doc_id, tie, ids); a last row of each part, with tie -1, has how often each id occurs, in 8
    bytes from id 0 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts, names = Encoder.of(tokenizer, REMEMBERED), np.zeros(0, np.int64), ["doc_id", "tie", "ids"]
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at, texts in slices(batch.column(2).to_pylist(), CHARS):
                ids = [x + end for x in encoder.encode(texts)]
                n = np.bincount(np.frombuffer(b"".join(ids), "<u4"))
                if len(n) > len(counts):
                    n, counts = counts, n
                counts[: len(n)] += n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), batch.column(1).slice(at, len(ids)), pa.array([narrow(x) for x in ids], pa.binary())], names=names)
        if len(counts):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1]), pa.array([counts.tobytes()], pa.binary())], names=names)

    return run


def narrow(ids: bytes) -> bytes:
    """A first byte of 2 or 4, then ids of so many bytes."""
    wide = np.frombuffer(ids, "<u4")
    return b"\4" + ids if wide.max() > 0xFFFF else b"\2" + wide.astype("<u2").tobytes()


def widen(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, f"<u{ids[0]}", offset=1)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0).to_pylist():
            n = np.frombuffer(x, np.int64)
            ids = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], names=["id", "n"])


def blocks_of(rank_of: np.ndarray):
    """(doc_id, ids), in order -> blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def block():
            control, data = encode_ranks(rank_of[np.concatenate(ids)])
            lengths = np.array([len(x) for x in ids], "<u8").tobytes()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "before": pa.array([before], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "lengths": [lengths], "control": [control], "data": [data]})

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), map(widen, batch.column(1).to_pylist())):
                if ids and held + len(x) > BLOCK_IDS:
                    yield block()
                    seq, before = seq + len(ids), before + held
                    doc_ids, ids, held = [], [], 0
                doc_ids.append(d), ids.append(x)
                held += len(x)
        if ids:
            yield block()

    return run


BLOCKS = "part int, seq long, before long, doc_ids array<long>, lengths binary, control binary, data binary"


def write_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str) -> None:
    """Writes the files of all documents under path: blocks and ranks."""
    prepare(spark)
    text = text_of()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text).alias("tie"), text.alias("text"))
    ids = stored(spark, slim.mapInArrow(tokenised(tokenizer), "doc_id long, tie long, ids binary"), "ids")
    counts = ids.where("tie = -1").select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = [r["id"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))]
    spark.createDataFrame([(by_rank,)], "ids array<long>").write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(by_rank, default=0) + 1, "<u2" if len(by_rank) <= 1 << 16 else "<u4")
    rank_of[by_rank] = np.arange(len(by_rank))
    ordered = ids.where("tie >= 0").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    with swept(spark):
        ordered.mapInArrow(blocks_of(rank_of), BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    discard(spark, ids)


def read_ids(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array]) of all documents, from the files."""
    prepare(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    ids = np.array(spark.read.schema("ids array<long>").parquet(f"{path}/ranks").first()["ids"], "<u4")

    def lengths(batches):
        for batch in batches:
            n = [int(np.frombuffer(x, "<u8").sum()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["part", "n"])

    totals = blocks.select("part", "lengths").mapInArrow(lengths, "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))
    starts, at = {}, 0
    for part, n in sorted(map(tuple, totals.collect())):
        starts[part], at = at, at + n

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["lengths"], "<u8").astype(np.int64)
                flat = ids[decode_ranks(row["control"], row["data"], int(n.sum()))]
                ends = np.cumsum(n)
                per = np.split(flat, ends[:-1])
                out = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(starts[row["part"]] + row["before"] + ends - n), "n_tokens": pa.array(n), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in per], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int64) for x in per], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.mapInArrow(decode, schema)


def ranked_ids(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    write_ids(spark, docs, tokenizer, path := work_path(spark, "ranked-ids"))
    return read_ids(spark, path)
