"""WARC archives of pages, each file with its own dictionary frame and one Zstandard frame per record.

The dictionary is built from a bounded sample of the records. A file starts with a skippable frame that holds it,
so a reader needs nothing else; then every record is a frame of its own. A payload of at least `REVISIT_BYTES`
bytes that was archived with a smaller page_id is written as a `revisit`: headers only, no payload. Tasks
write files of their own; the manifest names those of finished tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from vacanta.llm.files import open_file, shared_folder
from vacanta.llm.sampling import bounded_sample
from vacanta.session import settle, skew_join

REVISIT_BYTES = 100
# The dictionary is built from about this many records of at most this many payload bytes.
SAMPLE_RECORDS, SAMPLE_BYTES = 400, 65_536
DICTIONARY = 32_768
LEVEL = 3
# Magic numbers of the skippable frame that carries a dictionary and of a dictionary.
SKIPPABLE = 0x184D2A5D
DATE = "2026-01-01T00:00:00Z"
# Records a file holds, about.
FILE_RECORDS = 8_192


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (`refers_to` given) carries the payload's length and digest, not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    heads = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>"]
    if url is not None:
        heads.append(f"WARC-Target-URI: {''.join(url.split())}")
    heads += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        heads += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; the digest of a payload that is there is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[15:]) for line in http.decode().split("\r\n") if line.lower().startswith("content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if version != "WARC/1.1" or (kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest)):
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    number = lambda name: int(fields[name][10:-1]) if name in fields and fields[name] != "<urn:page:none>" else None
    return {"page_id": number("warc-record-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to"), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; too little to learn from gives the samples themselves (raw content)."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)


def read_records(file) -> Iterator[bytes]:
    """The records of an archive, frame by frame; holds one record and one block of the file at a time."""
    magic, size = int.from_bytes(file.read(4), "little"), int.from_bytes(file.read(4), "little")
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    dictionary = file.read(size)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data = file.read(1 << 16)
    while data:
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or file.read(1 << 16)
                break
            data = file.read(1 << 16)
            if not data:
                raise ValueError("archive ends inside a record")
        yield b"".join(parts)


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes the archives of `pages(page_id, url, html, ...)`; returns the manifest `(file, records, bytes)`.

    A null html is an empty payload. A null page_id is archived without a number, and is referred to by none
    and refers to another's page. Rows that share a page_id are records of their own, response where the page_id is the
    smallest of the payload. Other columns are ignored; an empty table writes no record.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies")
    narrow = rows.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest")
    # Copies are looked up without their payloads, spread over salts; only the rows that refer to another page come back.
    revisits = settle(skew_join(narrow, settle(firsts), ["digest"], "inner").where("NOT page_id <=> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct())
    sample = bounded_sample(rows, F.col("page_id"), SAMPLE_RECORDS).where(F.col("size") <= SAMPLE_BYTES).collect()
    dictionary = build_dictionary([record(r.page_id, r.url, bytes(r.payload), r.digest, r.size, None) for r in sample])
    shared = spark.sparkContext.broadcast(dictionary)
    folder = shared_folder(spark, "warc")
    keyed = [F.coalesce(F.col("page_id"), F.lit(0)).alias("k"), F.col("page_id").isNull().alias("none")]
    joined = rows.select("*", *keyed).join(revisits.select(*keyed, "digest", "refers_to"), ["k", "none", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, done, out = _compressor(shared.value), [], None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for page_id, url, body, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns), strict=True):
                    if out is None:
                        name = f"{folder}/pages-{uuid.uuid4().hex}.warc.zst"
                        out = open_file(name, "wb")
                        out.write(SKIPPABLE.to_bytes(4, "little") + len(shared.value).to_bytes(4, "little") + shared.value)
                        records, size_out = 0, 8 + len(shared.value)
                    size_out += out.write(compressor.compress(record(page_id, url, body or b"", digest, size, refers_to)))
                    records += 1
                    if records >= FILE_RECORDS:
                        out.close()
                        done.append((name, records, size_out))
                        out = None
        if out is not None:
            out.close()
            done.append((name, records, size_out))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["file", "records", "bytes"])

    body = F.when(F.col("refers_to").isNull(), F.col("payload"))
    return settle(joined.select("page_id", "url", body.alias("payload"), "digest", "size", "refers_to").mapInArrow(write, "file string, records long, bytes long"))


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives: `(page_id, payload_bytes, payload_digest, record_type, refers_to[, url, payload])`."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * with_payload
    kinds = dict(zip([*names[:5], "url", "payload"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()], strict=False))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_file(name, "rb") as file:
                    group = []
                    for raw in read_records(file):
                        group.append(parse(raw))
                        if len(group) == 256:
                            yield _batch(group, names, kinds)
                            group = []
                    if group:
                        yield _batch(group, names, kinds)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    return manifest.select("file").repartition(max(1, min(manifest.count(), 4_096))).mapInArrow(read, schema)


def _batch(group: list[dict], names: list[str], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g[n] for g in group], kinds[n]) for n in names], names=names)
