"""WARC archives of records that a dictionary compresses one by one."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import new_folder, read_file, write_file
from textwarden.sources.checkpoints import cut_lineage

#: Payloads below this many bytes are never replaced by a reference.
MIN_PAYLOAD = 100
#: An archive is closed at this many bytes of records before compression.
ARCHIVE_BYTES = 32 << 20
#: The dictionary is built from an archive's records, dealt evenly over it, up to these bounds.
DICTIONARY_BYTES, TRAINING_BYTES, TRAINING_RECORD = 64 << 10, 4 << 20, 64 << 10
LEVEL = 6
#: Fixed values of the formats.
SKIPPABLE, ZSTD = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(page_id: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """One record; a revisit has the HTTP head of the full payload, but no payload."""
    # A target is one line; what is not allowed in it is escaped.
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP head and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] + "\r\n" != VERSION.decode():
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records dealt evenly over the archive; empty where they are too few."""
    step = max(1, sum(min(len(r), TRAINING_RECORD) for r in records) // TRAINING_BYTES)
    samples = [r[:TRAINING_RECORD] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes]) -> Iterator[bytes]:
    """A leading skippable frame with the dictionary, then a frame for each record."""
    shared = dictionary(records)
    if shared:
        yield struct.pack("<II", SKIPPABLE, len(shared)) + shared
    known = zstandard.ZstdCompressionDict(shared) if shared else None
    if known:
        known.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
    for raw in records:
        yield compressor.compress(raw)


def frame_end(raw: bytes, at: int) -> int:
    """Where the frame that starts at `at` ends, from its block headers."""
    view = raw[at : at + 18]
    checksum = zstandard.get_frame_parameters(view).has_checksum
    at += zstandard.frame_header_size(view)
    last = False
    while not last:
        header = int.from_bytes(raw[at : at + 3], "little")
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * checksum


def read_archive(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    at, known = 0, None
    while at < len(raw):
        (magic,) = struct.unpack_from("<I", raw, at)
        if magic == SKIPPABLE:
            (size,) = struct.unpack_from("<I", raw, at + 4)
            known = zstandard.ZstdCompressionDict(raw[at + 8 : at + 8 + size])
            at += 8 + size
            decompressor = zstandard.ZstdDecompressor(dict_data=known)
            continue
        if known is None:
            decompressor = zstandard.ZstdDecompressor()
            known = False
        end = frame_end(raw, at)
        yield decompressor.decompress(raw[at:end])
        at = end


def with_references(pages: DataFrame) -> DataFrame:
    """Add size, digest and refers_to; pages: page_id, url, payload.

    Only digests and ids are grouped, and only groups of several rows come back, so the join
    that adds them has a small right side, whatever the number of pages; AQE splits the
    left side where one payload has very many copies.
    """
    full = pages.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    first = (
        full.where(F.col("size") >= MIN_PAYLOAD)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    out = full.join(cut_lineage(first), "digest", "left")
    return out.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per row; return path and number of records of each archive.

    A task holds the records of one archive at a time, at most ARCHIVE_BYTES and one record.
    Each archive has a name of its own and is named in the returned, written list only if
    its task succeeded, so tasks may run again.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    ready = with_references(rows).select(
        F.col("page_id").cast("string").alias("page_id"), "url", "size", "digest", F.col("refers_to").cast("string").alias("refers_to"),
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0

        def flush() -> pd.DataFrame:
            path = f"{folder}/{uuid.uuid4()}.warc.zst"
            write_file(path, archive(held))
            return pd.DataFrame({"path": [path], "records": [len(held)]})

        for batch in batches:
            for row in batch.itertuples(index=False):
                held.append(record(row.page_id or "", row.url, row.payload, int(row.size), row.digest, row.refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return cut_lineage(ready.mapInPandas(run, "path string, records long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the archives.

    A response's digest is taken from its payload and must be the one that the record
    states; a revisit states both of the payload that it refers to.
    """
    spread = archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for raw in read_archive(read_file(path)):
                    fields, http, payload = parse(raw)
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if fields["WARC-Type"] == "response":
                        if hashlib.sha256(payload).hexdigest() != stated or len(payload) != size:
                            raise ValueError(f"{path}: a payload is not what its record states")
                    id_of = lambda name: fields.get(name, "<urn:page:>")[len("<urn:page:") : -1] or None
                    rows.append((id_of("WARC-Record-ID"), size, stated, fields["WARC-Type"], id_of("WARC-Refers-To")))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    read = spread.mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return read.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def archive_pages(pages: DataFrame, **columns: str) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back.

    Null or empty html is an empty payload; a null url is written as about:blank. Of
    equal payloads of at least MIN_PAYLOAD bytes the row with the smallest page_id is the
    response and rows of other ids revisit it; rows that repeat that id are responses too.
    A null page_id comes back null and is never referred to unless all copies lack an id,
    in which case all are responses. Other columns do not come along.
    """
    return read_archives(write_archives(pages, new_folder(pages.sparkSession, "warc"), **columns))


def op5(spark, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {MIN_PAYLOAD} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_PAYLOAD} AND page_id <> first THEN first END AS refers_to
FROM f
"""
