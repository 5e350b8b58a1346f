"""WARC archives: one gzip member for each record, written in parallel and read back in splits.

The reader's tasks own byte ranges. A task looks for gzip magic from the start of its range, takes a candidate for a
member only if it decodes to WARC headers, and owns every record that starts inside its range, reading past the range's
end to finish the last one. A response carries an HTTP block; a revisit names the response that holds its payload.
"""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, join_path, make_dirs, open_fs

#: Fixed values of the formats.
GZIP = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS, CHUNK = 16, 1 << 16
MANIFEST = "path string, bytes long, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def roles(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages with payload (null: empty), its bytes and SHA-1, and refers_to for rows that revisit an equal payload.

    Of equal payloads of at least ``least`` bytes, the largest page_id responds; rows with that same page_id all do, and
    rows without a page_id revisit the group's largest, if it has any. Only digests of payloads that occur more than
    once are joined back, under salts: a payload that a third of all pages share is spread over 16 keys.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("payload_digest", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(groups, ["payload_digest", "salt"], "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("holder"))
    return rows.withColumn("refers_to", F.when(other, F.col("holder"))).drop("salt", "holder")


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {_clean(url)}"] if url else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is None:
        block = HTTP % len(payload) + payload
        lines += ["Content-Type: application/http; msgtype=response"]
    else:
        block = b""
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])).encode() + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, least: int = 1000, level: int = 3) -> DataFrame:
    """Writes an archive for each task under path; the manifest of the archives that count.

    A null html is an empty payload and a null url an empty one; pages without page_id never hold a payload for others.
    Equal pages each have a record. No pages give no archives.
    """
    import pyarrow as pa

    make_dirs(f"{path}/archives")

    def write(batches):
        task, out, at, n = TaskContext.get(), None, 0, 0
        name = join_path(path, f"archives/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz")
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    system, place = open_fs(name)
                    out = system.open_output_stream(place, compression=None, buffer_size=1 << 20)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(*row)) + packer.flush()
                out.write(member)
                at, n = at + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [at], "n_records": [n]})

    rows = roles(pages, least).select("page_id", "url", "payload", "payload_digest", "refers_to")
    in_batches(rows, write, MANIFEST).write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


class _Window:
    """A file read forward in chunks; keeps bytes from ``at`` on."""

    def __init__(self, stream, at: int):
        stream.seek(at)
        self.stream, self.at, self.data, self.over = stream, at, b"", False

    def more(self) -> bool:
        """Reads on, by as much as is held already: a member of any size is copied a constant number of times."""
        if not self.over:
            got = self.stream.read(max(CHUNK, len(self.data)))
            self.over = not got
            self.data += got
        return not self.over

    def drop(self, n: int) -> None:
        self.at, self.data = self.at + n, self.data[n:]


def _headers(data: bytes) -> dict[str, str] | None:
    """The headers of a decoded member, if they are whole and a WARC record's."""
    head, found, _ = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/\d\.\d", lines[0]):
        return None
    out = dict((k.strip().lower().decode("latin-1"), v.strip().decode("latin-1")) for k, _, v in (x.partition(b":") for x in lines[1:]))
    return out if "warc-type" in out and out.get("content-length", "").isdigit() else None


def _member(window: _Window) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and compressed length of the member at the window's start; None if there is none."""
    unpacker, out, used, checked = zlib.decompressobj(31), [], 0, False
    try:
        while not unpacker.eof:
            if used == len(window.data) and not window.more():
                return None
            out.append(unpacker.decompress(window.data[used:]))
            used = len(window.data) - len(unpacker.unused_data)
            if not checked and sum(map(len, out)) >= 9:
                if not re.match(rb"WARC/\d\.\d\r", b"".join(out)):
                    return None
                checked = True
    except zlib.error:
        return None
    data = b"".join(out)
    if (head := _headers(data)) is None:
        return None
    block = data.partition(b"\r\n\r\n")[2]
    return (head, block[: int(head["content-length"])], used) if len(block) >= int(head["content-length"]) else None


def records_of(stream, start: int, end: int):
    """(headers, block) of the records that start in [start, end) of an archive."""
    window = _Window(stream, start)
    while window.at < end:
        while len(window.data) < len(GZIP) and window.more():
            pass
        k = window.data.find(GZIP)
        if k < 0:
            window.drop(max(0, len(window.data) - len(GZIP) + 1))
            if not window.more():
                return
            continue
        window.drop(k)
        if window.at >= end:
            return
        if got := _member(window):
            yield got[0], got[1]
            window.drop(got[2])
        else:
            window.drop(1)


def _id(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """A row for each record of the archives (path, bytes): what its headers and payload say.

    The payload of a response is hashed and measured again; ValueError if it isn't what its headers promise. No archives
    give no rows.
    """
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            for name, start, end in zip(*(batch.column(k).to_pylist() for k in range(3))):
                system, place = open_fs(name)
                rows = []
                with system.open_input_file(place) as stream:
                    for head, block in records_of(stream, start, end):
                        digest, size, page = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]), _id(head["warc-record-id"])
                        if head["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"damaged record of page {page}")
                        rows.append((page, size, digest, head["warc-type"], _id(head.get("warc-refers-to"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    step = F.lit(split_bytes).cast("long")
    splits = archives.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return splits.select("path", "start", (F.col("start") + step).alias("end")).repartition(tasks).mapInArrow(read, RECORDS)
