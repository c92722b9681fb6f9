"""Token ids in binary files: frequency-ranked, byte-aligned variable-length, control bytes apart.

An id is stored as its rank by corpus frequency in one to four little-endian bytes. Four ids share one
control byte (two bits each: bytes less one); control and data bytes are separate columns. A file row
is a block of whole documents in ascending doc_id order with the number of ids before it, so any block
decodes alone. Those numbers are two sums: over the parts before (one number a part, as many as the
write has tasks) and over the blocks before within the part, which its task counts as it goes. Decoding looks control bytes up in a table of code lengths and gathers with numpy.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import column, materialize, shared_dir, slices, utf8
from .ordered import dealt_by_id

END = 0
BLOCK_BYTES = 1 << 21
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


# --------------------------------------------------------------------------- the code
def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of non-negative ranks below 2**32."""
    ranks = ranks.astype(np.uint32)
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    bytes_ = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), bytes_[np.arange(4) < size[:, None]].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(size) - size
    body = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        use = np.flatnonzero(size > k)
        out[use] |= body[start[use] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --------------------------------------------------------------------------- writing
def _tokenize(path: str):
    def tokenize(batches):
        coder, press = bpe.load(path), zstandard.ZstdCompressor(level=3)
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, (data, offsets) = column(batch, "doc_id"), utf8(column(batch, "text"))
            rows = []
            for a, b in slices(offsets, BLOCK_BYTES):
                found, first = coder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                flat = np.insert(found, first[1:], END).astype(np.uint16 if coder.size <= 1 << 16 else np.uint32)  # the end id of each document
                rows.append((done, len(flat), np.diff(first) + 1, press.compress(flat.tobytes()), a, b))
                done += len(flat)
            if not rows:
                continue
            cuts = pa.array([r[4] for r in rows] + [rows[-1][5]], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(rows), pa.int32()),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.ListArray.from_arrays(cuts, ids),
                    pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([r[2] for r in rows]), pa.int64())),
                    pa.array([r[3] for r in rows], pa.binary()),
                ],
                ["part", "inside", "n", "doc_ids", "lengths", "ids"],
            )

    return tokenize


def _raw(packed: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint32 if wide else np.uint16)


def _count(size: int):
    def count(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for x in column(batch, "ids").to_pylist():
                total += np.bincount(_raw(x, size > 1 << 16), minlength=size + 1)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["id", "n"])

    return count


def _write(shared, wide: bool):
    def write(batches):
        rank = shared.value
        for batch in batches:
            coded = [encode(rank[_raw(x, wide)]) for x in column(batch, "ids").to_pylist()]
            kept = [column(batch, c) for c in ("first_id", "doc_ids", "lengths")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())], ["first_id", "doc_ids", "lengths", "control", "data"])

    return write


def _with_starts(raw: DataFrame) -> DataFrame:
    """Adds ``first_id``: the ids of all blocks before. One row a part meets in one place and is broadcast, never the blocks."""
    totals = raw.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("part", before.alias("before"))
    return raw.join(F.broadcast(starts), "part").withColumn("first_id", F.col("before") + F.col("inside"))


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> str:
    """Encode every text, end each document with id 0, and write files and a rank table under ``path``. The driver holds the vocabulary's ranks."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tickframe/tokens-{uuid.uuid4().hex}"
    size, kind = bpe.load(tokenizer_path).size, docs.schema["doc_id"].dataType.simpleString()
    block = f"part int, inside long, n long, doc_ids array<{kind}>, lengths array<bigint>"
    raw = materialize(dealt_by_id(docs).select("doc_id", "text").mapInArrow(_tokenize(tokenizer_path), f"{block}, ids binary"), "ids", "none")
    counts = raw.select("ids").mapInArrow(_count(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], np.int64)
    rank = np.zeros(size + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    coded = _with_starts(raw).select("first_id", "doc_ids", "lengths", "ids").mapInArrow(_write(spark.sparkContext.broadcast(rank), size > 1 << 16), f"first_id long, doc_ids array<{kind}>, lengths array<bigint>, control binary, data binary")
    coded.write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    return path


# --------------------------------------------------------------------------- reading
def _read(shared, keep_ids: bool):
    def read(batches):
        ids_of = shared.value
        for batch in batches:
            named = column(batch, "doc_ids")
            for i, (first, lengths, control, data) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("first_id", "lengths", "control", "data")))):
                sizes, docs = np.array(lengths, np.int64), named[i].values
                at = np.append(0, np.cumsum(sizes))
                ids = ids_of[decode(control, data, int(at[-1]))]
                own = [ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                out = [docs, pa.array(first + at[:-1], pa.int64()), pa.array(sizes), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                if keep_ids:
                    out.append(pa.array([x.tolist() for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return read


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # as many as the vocabulary has ids
    shared = spark.sparkContext.broadcast(np.array([r.id for r in ranks], "<u4"))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * keep_ids
    return blocks.mapInArrow(_read(shared, keep_ids), schema)


def token_store(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """Write the texts' ids and read them back.

    Ids are what the tokenizers library gives with its defaults and add_special_tokens=False: the string of
    an added token in a text is that token. Null and empty texts give the end id alone. Null doc_ids come
    first and rows of equal doc_id follow each other by the xxhash64 of their text, one result row each;
    doc_ids may be of any type that has an order. An empty table gives an empty result. Columns other than
    doc_id and text are left aside.
    """
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer_path), keep_ids)
