"""Token-id output: framed binary records in shards, each with a separate offset index for reads in any order.

A record is ``length (u64) | masked crc32 of the length (u32) | payload | masked crc32 of the payload (u32)``, all
little-endian; the payload is ``flags (u8: 1 has an id) | id width (u8) | doc_id (i64) | ids``. An index is the magic
bytes, then for each record ``flags | doc_id | byte offset | ids before it in the shard | number of ids``. A Parquet
manifest lists the shards; only shards it names count, so tasks that were repeated or lost leave no trace in a read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import encoder, in_batches, join_path, make_dirs, open_fs

#: Fixed values of the format.
MAGIC = b"LSTNIDX1"
MASK_ADD = 0xA282EAD8
INDEX = np.dtype([("flags", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("before", "<u8"), ("n", "<u4")])
HEAD, SERIAL = struct.Struct("<QI"), struct.Struct("<BBq")

MANIFEST = "shard long, path string, n_records long, n_ids long, bytes long"


def masked(crc: int) -> int:
    """A checksum of data that hold checksums is weak; so rotate it by 15 bits and add a constant."""
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(zlib.crc32(size))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))


def unframe(stream) -> Iterator[bytes]:
    """The payloads of a stream of records; ValueError on a torn or damaged one."""
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size:
            raise ValueError("torn record head")
        size, check = HEAD.unpack(head)
        if masked(zlib.crc32(head[:8])) != check:
            raise ValueError("damaged record length")
        body = stream.read(size + 4)
        if len(body) < size + 4:
            raise ValueError("torn record")
        payload = body[:-4]
        if masked(zlib.crc32(payload)) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("damaged record")
        yield payload


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return SERIAL.pack(doc_id is not None, width, doc_id or 0) + ids


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, width, doc_id = SERIAL.unpack_from(payload)
    return (doc_id if flags else None), np.frombuffer(payload, dtype=f"<u{width}", offset=SERIAL.size)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, spaced: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every whole text, with end_id after each, under path in ascending doc_id order; the manifest.

    Shards follow each other in doc_id order (null first, equal ids by text), each sorted within. A null text counts as
    empty. Repeated rows stay repeated. Other columns are ignored.
    """
    import pyarrow as pa

    make_dirs(f"{path}/shards")

    def write(batches):
        task = TaskContext.get()
        e = encoder(tokenizer, spaced)
        end = np.array([end_id], dtype=e.dtype).tobytes()
        shard, name = task.partitionId(), join_path(path, f"shards/shard-{task.partitionId():06d}-{task.taskAttemptId()}")
        index, at, before, n_records, out, sink = [], 0, 0, 0, None, None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if out is None:
                    system, place = open_fs(name)
                    out, sink = system.open_output_stream(f"{place}.rec", buffer_size=1 << 20), system.open_output_stream(f"{place}.idx", buffer_size=1 << 16)
                    sink.write(MAGIC)
                ids = e.encode(text or b"") + end
                record = frame(payload_of(doc_id, ids, e.width))
                out.write(record)
                n = len(ids) // e.width
                index.append((doc_id is not None, doc_id or 0, at, before, n))
                at, before, n_records = at + len(record), before + n, n_records + 1
            if out is not None:
                sink.write(np.array(index, dtype=INDEX).tobytes())
                index = []
        if out is None:
            return
        out.close()
        sink.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_records": [n_records], "n_ids": [before], "bytes": [at]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    in_batches(rows, write, MANIFEST).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with start: how many ids the shards before hold. One row for each shard, so one task orders them."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    w = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


def read_records(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record (and its ids), from the files; every checksum is verified.

    Null texts were written as empty ones, so they have their end id alone; null and repeated doc_ids come back as they
    were. Files of an empty table give no rows.
    """
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = open_fs(f"{name}.rec")
                got = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                with system.open_input_stream(place, buffer_size=1 << 20) as stream:
                    for payload in unframe(stream):
                        doc_id, ids = parse(payload)
                        wide = ids.astype("<u4")
                        for k, v in zip(got, (doc_id, start, len(ids), zlib.crc32(wide), wide.tolist() if with_ids else None)):
                            got[k].append(v)
                        start += len(ids)
                        if len(got["doc_id"]) >= (500 if with_ids else 20_000):
                            yield pa.RecordBatch.from_pydict(got, schema=kind)
                            got = {k: [] for k in got}
                yield pa.RecordBatch.from_pydict(got, schema=kind)

    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    rows = shards(spark, path).select("path", "start")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def fetch(shard_path: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records with these numbers of one shard, in that order, by seeks through its index: a shuffled read."""
    system, place = open_fs(shard_path)
    with system.open_input_file(f"{place}.idx") as f:
        data = f.read()
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not an index")
    index = np.frombuffer(data, dtype=INDEX, offset=len(MAGIC))
    out = []
    with system.open_input_file(f"{place}.rec") as f:
        for k in numbers:
            f.seek(int(index[k]["offset"]))
            out.append(parse(next(unframe(f))))
    return out
