"""Overlapping chunks of segments that end at sentence ends where one lies in the second half of a window."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T

_ENDS = "。！？；.!?\n"
CHUNK = "struct<start_pos:int,end_pos:int,content:string>"


def _cut(content, start, size: int) -> Column:
    """End of the window at `start` (0-based): after the last sentence end of its second half, if any."""
    half = size // 2
    window = F.substr(content, start + 1 + half, F.lit(size - half))
    kept = F.length(F.regexp_extract(window, rf"\A[\s\S]*[{_ENDS}]", 0))
    return start + F.when(kept > 0, half + kept).otherwise(size)


def sliding_chunks(content, size: int, overlap: int) -> Column:
    """Native form: an array of start_pos, end_pos, content (stripped; positions are of the unstripped text)."""
    overlap = min(overlap, size // 2)
    least_step = size // 2 + 1 - overlap
    n = F.length(content)
    start = F.struct(F.array().cast(f"array<{CHUNK}>").alias("done"), F.lit(0).alias("at"), F.lit(False).alias("ended"))

    def step(a, _):
        stop = F.when(a.at + size >= n, n).otherwise(_cut(content, a.at, size))
        one = F.struct(a.at.alias("start_pos"), stop.alias("end_pos"), T.strip(F.substr(content, a.at + 1, stop - a.at)).alias("content"))
        return F.when(a.ended, a).otherwise(F.struct(F.concat(a.done, F.array(one)).alias("done"), (stop - overlap).alias("at"), (stop >= n).alias("ended")))

    rounds = F.sequence(F.lit(0), (n / least_step).cast("int"))
    return F.when(n == 0, F.array().cast(f"array<{CHUNK}>")).otherwise(F.aggregate(rounds, start, step, lambda a: a.done))


def chunk_text(content: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """Plain form of sliding_chunks()."""
    overlap, out, at, n = min(overlap, size // 2), [], 0, len(content)
    while at < n:
        end = min(at + size, n)
        if end < n:
            last = max(content.rfind(c, at + size // 2, end) for c in _ENDS)
            end = last + 1 if last >= 0 and last + 1 > at + size // 2 else end
        out.append((at, end, content[at:end].strip()))
        if end >= n:
            break
        at = end - overlap
    return out


def chunk_segments(segments: DataFrame, size: int, overlap: int) -> DataFrame:
    """segments: doc_id, segment_id, content, tag. One row a chunk, in Arrow batches: doc_id, segment_id,
    local_id, tag, start_pos, end_pos, content. A segment of at most `size` characters is one chunk, as it
    stands; a blank one has none. Linear in the text for any overlap."""
    names = ["doc_id", "segment_id", "local_id", "tag", "start_pos", "end_pos", "content"]

    def run(batches):
        for b in batches:
            rows = []
            for d, s, t, c in zip(*(b.column(x).to_pylist() for x in ("doc_id", "segment_id", "tag", "content"))):
                if c and c.strip():
                    for k, (x, y, piece) in enumerate([(0, len(c), c)] if len(c) <= size else chunk_text(c, size, overlap)):
                        rows.append((d, s, k + 1, t, x, y, piece))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            cols = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    src = segments.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("segment_id").cast("int").alias("segment_id"), F.col("tag").cast("string").alias("tag"), "content")
    return src.mapInArrow(run, "doc_id long, segment_id int, local_id int, tag string, start_pos int, end_pos int, content string")


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id: 1..n over all segments of a document, in order."""
    w = Window.partitionBy("doc_id").orderBy("segment_id", "local_id")
    return chunks.withColumn("chunk_id", F.row_number().over(w)).drop("local_id")


def locate_chunks(response, content) -> Column:
    """Chunks that a backend named, found in order: each from where its first 50 characters stand, or from
    the end of the one before; the whole content if there are none."""
    items = F.from_json(F.regexp_extract(response, r"\[[\s\S]*\]", 0), "array<struct<content:string>>")
    texts = F.filter(F.transform(items, lambda x: T.strip(F.coalesce(x.content, F.lit("")))), lambda x: x != "")
    start = F.struct(F.array().cast(f"array<{CHUNK}>").alias("done"), F.lit(0).alias("at"))

    def step(a, x):
        found = F.call_function("locate", F.substring(x, 1, 50), content, a.at + 1)
        s = F.when(found > 0, found - 1).otherwise(a.at)
        e = s + F.length(x)
        return F.struct(F.concat(a.done, F.array(F.struct(s.alias("start_pos"), e.alias("end_pos"), x.alias("content")))).alias("done"), e.alias("at"))

    whole = F.array(F.struct(F.lit(0).alias("start_pos"), F.length(content).alias("end_pos"), content.alias("content")))
    got = F.aggregate(texts, start, step, lambda a: a.done)
    return F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, got).otherwise(whole)


def semantic_chunks(segments: DataFrame, backend, size: int) -> DataFrame:
    """As chunk_segments(), for long segments cut by a backend: backend(content, target) returns texts, or
    raises, and then windows with an overlap of a tenth are cut."""

    def pieces(c: str):
        try:
            texts = [t.strip() for t in backend(c, max(2, len(c) // size))]
        except Exception:
            return chunk_text(c, size, size // 10)
        out, at = [], 0
        for t in filter(None, texts):
            s = c.find(t[:50], at)
            s = at if s < 0 else s
            at = s + len(t)
            out.append((s, at, t))
        return out or [(0, len(c), c)]

    def run(batches):
        for b in batches:
            rows = []
            for d, s, t, c in zip(*(b.column(x).to_pylist() for x in ("doc_id", "segment_id", "tag", "content"))):
                if c and c.strip():
                    for k, (x, y, p) in enumerate([(0, len(c), c)] if len(c) <= size else pieces(c)):
                        rows.append({"doc_id": d, "segment_id": s, "local_id": k + 1, "tag": t, "start_pos": x, "end_pos": y, "content": p})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    src = segments.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("segment_id").cast("int").alias("segment_id"), F.col("tag").cast("string").alias("tag"), "content")
    return src.mapInArrow(run, "doc_id long, segment_id int, local_id int, tag string, start_pos int, end_pos int, content string")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("segment_id", pa.int32()), ("local_id", pa.int32()), ("tag", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("content", pa.string())])


def parse_chunk_texts(response: str) -> list[str]:
    """Texts of a backend's JSON array of objects with a content."""
    m = re.search(r"\[[\s\S]*\]", response)
    return [str(x.get("content", "")) for x in json.loads(m.group())] if m else []
