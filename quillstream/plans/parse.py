"""Parsing documents from input to nested result, with validated options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import vocabulary as V
from quillstream.operators import assemble, chunks, labels, packing
from quillstream.sources import documents

BUSINESS_LINES = None  # any: it has no effect on results
MODES, SEGMENT_MODES, CHUNK_METHODS = ("separate", "unified"), ("rule", "semantic"), ("sliding", "semantic")


@dataclass(frozen=True)
class Options:
    mode: str = "separate"
    segment_mode: str = "rule"
    chunk_size: int = 0
    overlap: int = 0
    chunk_method: str = "sliding"
    version: str = "v1"
    business_line: str = ""

    def __post_init__(self):
        if self.version == "v2":
            raise NotImplementedError("v2 is not offered yet")
        for value, known, name in ((self.version, ("v1",), "version"), (self.mode, MODES, "mode"), (self.segment_mode, SEGMENT_MODES, "segment_mode"), (self.chunk_method, CHUNK_METHODS, "chunk_method")):
            if value not in known:
                raise ValueError(f"{name} must be one of {known}")
        if self.chunk_size and self.chunk_size < 50:
            raise ValueError("chunk_size must be at least 50")
        if self.chunk_size and not 0 <= self.overlap < self.chunk_size:
            raise ValueError("overlap must be at least 0 and less than chunk_size")


def segments_of(texts: DataFrame, options: Options, planner: Callable[[list[str]], str] | None = None) -> DataFrame:
    """doc_id, segment_id, content from doc_id, text. Semantic segmentation asks `planner` for plans of at
    most SENTENCE_BATCH sentences; without one, or where it fails, short sentences are merged."""
    if options.mode == "unified":
        joined = texts.select("doc_id", packing.join_lines(T.strip(F.col("text")), "unified").alias("text"))
        arrays = joined.select("doc_id", F.when(F.length("text") > V.UNIFIED_BLOCK, packing.unified_blocks(F.col("text"))).otherwise(packing.paragraphs(F.col("text"))).alias("segments"))
    elif options.segment_mode == "rule":
        arrays = texts.select("doc_id", packing.rule_segments(F.col("text")).alias("segments"))
    else:
        joined = texts.select("doc_id", packing.join_lines(T.strip(F.col("text")), "semantic").alias("text"))
        if planner is None:
            merged = packing.fallback_merge(packing.presegment(F.col("text")))
        else:
            joined = _plans(joined.withColumn("s", packing.presegment(F.col("text"))), planner)
            batches = F.transform(F.col("p"), lambda p, i: F.struct(p.alias("p"), F.slice("s", i * V.SENTENCE_BATCH + 1, F.lit(V.SENTENCE_BATCH)).alias("s")))
            merged = F.flatten(F.transform(batches, lambda b: F.when(b.p == "", packing.fallback_merge(b.s)).otherwise(labels.apply_plan(b.s, b.p))))
            merged = packing.merge_neighbours(merged)
        arrays = joined.select("doc_id", F.when(F.length("text") < 200, F.filter(F.array("text"), lambda x: x != "")).otherwise(merged).alias("segments"))
    return packing.explode_segments(arrays)


def _plans(sentences: DataFrame, planner: Callable[[list[str]], str]) -> DataFrame:
    """Adds p to doc_id, text, s: the planner's answer to each run of SENTENCE_BATCH sentences, empty where it failed."""

    def ask(some: list[str]) -> str:
        try:
            return planner(some) or ""
        except Exception:  # any failure of the caller's planner means merging instead
            return ""

    def run(batches):
        for b in batches:
            p = [[ask(s[at : at + V.SENTENCE_BATCH]) for at in range(0, len(s or []), V.SENTENCE_BATCH)] for s in b.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("s"), pa.array(p, pa.list_(pa.string()))], names=["doc_id", "text", "s", "p"])

    src = sentences.select("doc_id", "text", "s")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string, s array<string>, p array<string>")


def parse(rows: DataFrame, options: Options | None = None, backend=labels.KeywordBackend, planner=None, remote=None, chunker=None) -> DataFrame:
    """rows: doc_id, text, filename, content. One nested row a document; failures have status 'error'.

    Defined results: a document without segments (page marks only, for one) has status 'success' and no segments;
    null and blank texts without a file are errors; rows that share a doc_id are read as one document, so ids have to
    be unique; other columns are ignored. The labelled segments feed several parts of the result, so they are kept
    (memory, then disk) until spark.catalog.clearCache() or the session's end; a lost part is worked out again.
    Semantic chunks of chunk_size need `chunker`, called as chunker(content, how many chunks) for a list of texts."""
    options = options or Options()
    if options.chunk_size and options.chunk_method == "semantic" and chunker is None:
        raise ValueError("chunk_method 'semantic' needs a chunker")
    got = documents.inputs(rows, remote)
    good, bad = got.where("error is null"), got.where("error is not null")
    tagged = labels.label_segments(segments_of(good, options, planner), backend)
    tagged = labels.merge_same_tag(tagged) if options.mode == "unified" else labels.smooth(tagged)
    tagged = tagged.withColumn("confidence", F.round("confidence", 2)).persist(StorageLevel.MEMORY_AND_DISK)
    pages = good.where("pages is not null").select("doc_id", "pages")
    tagged = tagged.join(pages, "doc_id", "left").withColumn("page_idx", F.when(F.col("pages").isNotNull(), assemble.page_of(F.col("content"), F.col("pages")))).drop("pages")
    heads, rest = assemble.title_abstract(tagged)
    body = rest.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "content"))), lambda x: x.content), "\n").alias("body"))
    heads = heads.join(body, "doc_id", "left").select("doc_id", "title", F.coalesce("abstract", assemble.default_abstract(F.col("body"))).alias("abstract"))
    if options.chunk_size:
        semantic = options.chunk_method == "semantic"
        cut = chunks.semantic_chunks(rest, chunker, options.chunk_size) if semantic else chunks.chunk_segments(rest, options.chunk_size, options.overlap)
        pieces = chunks.number_chunks(cut)
        rest = assemble.attach_chunks(rest, pieces, options.chunk_size, options.overlap, options.chunk_method)
    out = assemble.nest(good.select("doc_id").distinct().join(heads, "doc_id", "left"), rest)
    empty = out.schema["segments"].dataType
    failed = bad.select("doc_id", F.lit("error").alias("status"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("abstract"), F.array().cast(empty).alias("segments"), F.col("error").alias("error_message"))
    return out.unionByName(failed)


def health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("healthy", V.SERVICE_VERSION, "quillstream")], "status string, version string, service string")


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, t, V.VERSION) for i, t in enumerate(V.TAGS)], "tag_order int, tag string, version string")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, V.MAX_UPLOAD_MB) for f in V.FORMATS], "suffix string, max_mb int")
