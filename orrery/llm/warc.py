"""WARC archives compressed with Zstandard and a shared dictionary.

A ``.warc.zst`` file starts with a skippable frame that holds the dictionary; after it every
record is one Zstandard frame of its own, so a reader can seek to any record.  Files are written
by the executors into a folder of the shared store, each under a temporary name that is moved
into place when complete, and are read back through Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, stage

#: Fixed values of the formats: magic of the dictionary's skippable frame and of Zstandard frames.
SKIPPABLE_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Payload bytes after which a writer starts another file; bounds what a reader holds at once.
FILE_BYTES = 16 << 20
#: Rows whose payloads train the dictionary, bytes of each that it sees, and its largest size.
DICT_ROWS, DICT_ROW_BYTES, DICT_BYTES = 400, 16 << 10, 32 << 10
URN = "urn:page:"

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "record_id string, record_type string, refers_to string, target_uri string, date string, payload_digest string, "
    "payload_bytes long, content_length long, payload binary"
)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(record_id: str, uri: str | None, payload: bytes | None, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record.  With ``refers_to`` it is a revisit: HTTP headers only, which keep the full length."""
    payload = payload or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri:
        # A line break in a URL would end the header.
        head.insert(3, "WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        head.insert(4, f"WARC-Refers-To: <{refers_to}>")
        head.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """Parse and validate one record; raises ValueError where headers, lengths or digests disagree."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.1", "WARC/1.0"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    named = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"malformed header line: {line[:80]!r}")
        named[key.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if need not in named:
            raise ValueError(f"header missing: {need}")
    length = int(named["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest)} bytes does not match Content-Length {length}")
    if "warc-block-digest" in named and named["warc-block-digest"] != f"sha1:{digest32(block)}":
        raise ValueError("block digest does not match")
    http, sep, payload = block.partition(b"\r\n\r\n")
    full = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not sep or full is None:
        raise ValueError("HTTP headers without Content-Length")
    kind, digest = named["warc-type"], named["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != full or digest32(payload) != digest):
        raise ValueError("payload does not match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in named):
        raise ValueError("revisit with a payload or without WARC-Refers-To")
    return {
        "record_id": named["warc-record-id"].strip("<>"),
        "record_type": kind,
        "refers_to": named["warc-refers-to"].strip("<>") if "warc-refers-to" in named else None,
        "target_uri": named.get("warc-target-uri"),
        "date": named["warc-date"],
        "payload_digest": digest,
        "payload_bytes": full,
        "content_length": length,
        "payload": payload if kind == "response" else None,
    }


def train_dictionary(pages: DataFrame, payload: str) -> bytes:
    """A dictionary from at most ``DICT_ROWS`` payloads, those of smallest hash; empty if they are too few or too alike."""
    import zstandard

    # The hashes are picked first, so that no task sends payloads that are not used.
    hashed = pages.where(F.length(payload) > 0).select(F.xxhash64(payload).alias("h"), payload)
    picked = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(DICT_ROWS).collect()]
    sample = hashed.where(F.col("h") <= max(picked)) if picked else hashed.limit(0)
    rows = sample.groupBy("h").agg(F.min(F.substring(F.encode(payload, "utf-8"), 1, DICT_ROW_BYTES)).alias("b")).orderBy("h").collect()
    if len(rows) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, [bytes(r.b) for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def skippable_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive, one frame at a time."""
    import zstandard

    at, dictionary = 0, None
    view = memoryview(content)
    if len(view) >= 8 and struct.unpack_from("<I", view, 0)[0] == SKIPPABLE_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        if 8 + size > len(view):
            raise ValueError("dictionary frame is cut off")
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary, at = (zstandard.ZstdCompressionDict(raw) if raw else None), 8 + size
    engine = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        if len(view) - at < 8 or struct.unpack_from("<I", view, at)[0] != ZSTD_MAGIC:
            raise ValueError(f"no Zstandard frame at byte {at}")
        # The engine stops at the end of the frame and says how much it left.
        step, one, fed = 1 << 18, engine.decompressobj(), at
        parts = []
        while not one.eof:
            if fed >= len(view):
                raise ValueError("last frame is cut off")
            parts.append(one.decompress(view[fed : fed + step]))
            fed = min(fed + step, len(view))
        at = fed - len(one.unused_data)
        yield decode_record(b"".join(parts))


def write_archives(rows: DataFrame, folder: str, dictionary: bytes, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write (record_id, target_uri, payload, refers_to) rows to ``folder``; returns the manifest (path, records, bytes).

    Lazy: consume the manifest to write.  A task that runs again moves its own complete files
    into place under new names; only files named in the manifest are part of the result.
    """
    shared = rows.sparkSession.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        words = shared.value
        engine = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        out, done = None, []

        def close() -> None:
            out["file"].close()
            store.move(out["temp"], out["path"])
            done.append((out["uri"], out["n"], out["bytes"]))

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "target_uri", "payload", "refers_to")]
            for rid, uri, payload, refers in zip(*cols, strict=True):
                if out is None:
                    name = uuid.uuid4().hex
                    path = f"{root}/{name}.warc.zst"
                    out = {"temp": f"{root}/_{name}.tmp", "path": path, "uri": f"{folder}/{name}.warc.zst", "n": 0, "bytes": 0, "raw": 0}
                    out["file"] = store.open_output_stream(out["temp"])
                    out["file"].write(skippable_frame(words))
                raw = encode_record(rid.as_py(), uri.as_py(), payload.as_py(), refers.as_py(), date)
                frame = engine.compress(raw)
                out["file"].write(frame)
                out["n"] += 1
                out["raw"] += len(raw)
                out["bytes"] += len(frame)
                if out["raw"] >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
                names=["path", "records", "bytes"],
            )

    return rows.select("record_id", "target_uri", "payload", "refers_to").mapInArrow(write, MANIFEST)


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives in ``files`` (a ``content`` column, as ``binaryFile`` gives)."""
    schema = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        fields = [x.split(" ") for x in schema.split(", ")]
        shape = pa.schema([(n, types[t]) for n, t in fields])

        def flush(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{n: r[n] for n, _ in fields} for r in rows], schema=shape)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in read_archive(content.as_py()):
                    rows.append(record)
                    held += record["payload_bytes"] if with_payload else 100
                    if held > 4 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return files.select("content").mapInArrow(read, schema)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write one record per page to archives, read them back and return one row per record.

    Payloads are the ``html`` in UTF-8, null as empty.  Of equal payloads of at least
    ``min_revisit_bytes`` the row with the largest ``page_id`` is a response (all rows, if it
    repeats; null counts as smallest) and the others revisit it; smaller payloads are all
    responses.  Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    keyed = base.withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    groups = (
        keyed.where(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("sha")
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha", "last")
    )
    # Only payloads that repeat; Spark measures the table and broadcasts it where it is small.
    groups = stage(groups, "warc-groups")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    name = lambda c: F.concat(F.lit(URN), F.coalesce(c.cast("string"), F.lit("null")))
    rows = keyed.join(groups, "sha", "left").select(
        name(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.encode("html", "utf-8").alias("payload"),
        F.when(revisit, name(F.col("last"))).alias("refers_to"),
    )
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = stage(write_archives(rows, folder, train_dictionary(base, "html")), "warc-manifest")
    if manifest.isEmpty():
        files = spark.createDataFrame([], "path string, content binary")
    else:
        files = (
            spark.read.format("binaryFile")
            .load(folder)
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
            # Files of attempts that did not count are not in the manifest.
            .join(manifest.select(F.element_at(F.split("path", "/"), -1).alias("file")), "file", "left_semi")
        )
    return read_archives(files, with_payload=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def page(c: str):
        return F.substring(c, len(URN) + 1, 40).try_cast("long")

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
