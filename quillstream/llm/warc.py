"""Operator 3, WARC archives compressed with zstandard and a shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record is one
frame made with it. The reader loads the dictionary from the leading frame, decodes a frame a record, and
validates the version line, the named headers, Content-Length against the block's length, and both digests.

Of records with equal payloads the one with the smallest page_id is a response, the others are revisits that
refer to it and carry no payload.

Scale: payload digests are computed where pages are read; one row a digest (combined before the shuffle, so
a hot payload costs one row a task) is joined back on the digest, where large partitions can be split.
Each task writes one archive; nothing else moves html. The dictionary is trained on a bounded sample of
pages (`DICTIONARY_PAGES`), which affects sizes only.

Defined results: null html is an empty payload; a null url is an empty target; pages with a null page_id
count as larger than all others and keep a null id, and where all ids of a payload are null one of its pages is
the response; repeated page_ids keep their rows (the copies revisit
the first); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import materialize, new_path
from quillstream.llm.zstd_frames import EMPTY_FRAME, FRAME_MAGIC, frames, read_files, skippable, write_rows

DICTIONARY = 0x184D2A5D
DICTIONARY_PAGES = 256
DICTIONARY_BYTES = 16_384
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; ValueError if it is malformed."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError(f"no header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"{name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length doesn't fit the block")
    return headers, rest[:-4]


def _dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample; none where there is too little to train on."""
    sample = [(r.html or "").encode("utf-8", "surrogatepass")[:8192] for r in pages.select("html").limit(DICTIONARY_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def _clean(value) -> str:
    """A header value can't hold line breaks."""
    return " ".join((value or "").split())


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    spark = pages.sparkSession
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = src.select("page_id", "url", "html", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"))
    # Pages without an id are numbered in a table, so that a number stays with its row.
    marked, unnamed = marked.withColumn("row", F.lit(None).cast("long")), marked.where("page_id is null")
    if unnamed.select("page_id").head(1):
        unnamed, _ = materialize(unnamed.withColumn("row", F.monotonically_increasing_id()), "warc-null-ids")
        marked = marked.where("page_id is not null").unionByName(unnamed)
    first = marked.where(F.col("size") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.min("row").alias("first_row"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first, _ = materialize(first, "warc-copies")
    dictionary = _dictionary(src)

    def pack(batches):
        z, began, done = None, False, set()
        for b in batches:
            out = []
            if not began:
                began = True
                out.append(skippable(dictionary, DICTIONARY))
                d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
                z = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True, write_content_size=True)
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "refers")]
            for page, url, html, first_id, refers in zip(*cols):
                body = html.encode("utf-8", "surrogatepass") if html else b""
                digest = sha1_base32(body)
                heads = [
                    ("WARC-Type", "revisit" if refers else "response"),
                    ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
                    ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("WARC-Target-URI", _clean(url)),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                block = http if refers else http + body
                if refers:
                    heads += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{'' if first_id is None else first_id}>")]
                out.append(z.compress(record([*heads, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")], block)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    # Copies join their digest's row (small: only digests that occur more than once).
    joined = marked.join(first, "sha1", "left").select(
        "page_id", "url", "html", "first_id",
        (F.col("copies").isNotNull() & ~F.coalesce(F.when(F.col("first_id").isNull(), F.col("row") == F.col("first_row")).otherwise(F.col("page_id") == F.col("first_id")), F.lit(False))).alias("refers"),
    )
    write_rows(joined.mapInArrow(pack, "frame binary"), "frame", path, EMPTY_FRAME)


def read_archive(data: bytes):
    """(headers, block) of each record of an archive, in order; ValueError on anything malformed."""
    z = zstandard.ZstdDecompressor()
    for n, (magic, start, end) in enumerate(frames(data)):
        if magic == DICTIONARY and n == 0:
            if end - start > 8:
                z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[start + 8 : end]))
        elif magic == FRAME_MAGIC:
            yield parse_record(z.decompress(data[start:end]))


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"

    def rows_of(data):
        for heads, block in read_archive(data):
            if (b := heads.get("warc-block-digest")) and b != f"sha1:{sha1_base32(block)}":
                raise ValueError("a block doesn't fit its digest")
            http, _, body = block.partition(b"\r\n\r\n")
            size = int(http.rpartition(b"Content-Length: ")[2])
            digest = heads["warc-payload-digest"].removeprefix("sha1:")
            kind = heads["warc-type"]
            if kind == "response" and (len(body) != size or sha1_base32(body) != digest):
                raise ValueError("a payload doesn't fit its length or digest")
            yield _page(heads["warc-record-id"]), heads.get("warc-target-uri", ""), size, digest, kind, _page(heads["warc-refers-to"]) if kind == "revisit" else None, body.decode("utf-8", "surrogatepass") if kind == "response" else None

    def read(batches):
        for b in batches:
            for data in b.column("content").to_pylist():
                some = []
                for row in rows_of(data):
                    some.append(row)
                    if len(some) == 2000:
                        yield _batch(some)
                        some = []
                if some:
                    yield _batch(some)

    def _batch(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return read_files(spark, path).mapInArrow(read, schema)


def archives(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives of pages and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit_bytes)
    return read_archives(pages.sparkSession, path)
