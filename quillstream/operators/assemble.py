"""From labelled segments to parsed documents: title, abstract, pages, numbering, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import vocabulary as V


def title_abstract(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, rest). heads: doc_id, title (first title segment), abstract (abstract segments joined).
    rest: the other segments, later titles with the fallback tag, numbered from 1; if nothing is left the
    consumed ones come back with the fallback tag."""
    w = Window.partitionBy("doc_id").orderBy("segment_id")
    title_no = F.sum(F.when(F.col("tag") == V.TITLE, 1).otherwise(0)).over(w)
    used = ((F.col("tag") == V.TITLE) & (title_no == 1)) | (F.col("tag") == V.ABSTRACT)
    marked = segments.withColumn("_used", F.coalesce(used, F.lit(False)))
    texts = F.array_sort(F.collect_list(F.when(F.col("tag") == V.ABSTRACT, F.struct("segment_id", T.strip(F.col("content")).alias("content")))))
    heads = marked.groupBy("doc_id").agg(
        F.min_by(F.when(F.col("tag") == V.TITLE, T.strip(F.col("content"))), F.when(F.col("tag") == V.TITLE, F.col("segment_id"))).alias("title"), texts.alias("_texts")
    )
    heads = heads.select("doc_id", "title", F.when(F.size("_texts") > 0, F.array_join(F.transform("_texts", lambda x: x.content), "\n")).alias("abstract"))
    left = F.sum(F.when(F.col("_used"), 0).otherwise(1)).over(Window.partitionBy("doc_id"))
    kept = marked.withColumn("_left", left).where(~F.col("_used") | (F.col("_left") == 0))
    kept = kept.withColumn("tag", F.when(F.col("_used") | (F.col("tag") == V.TITLE), V.OTHER).otherwise(F.col("tag")))
    return heads, renumber(kept.drop("_used", "_left"))


def leftover(full_text, title, abstract) -> Column:
    """The text without the first occurrences of title, then abstract; null if nothing is left."""

    def without(c, part):
        at = F.call_function("locate", part, c)
        return F.when(part.isNotNull() & (part != "") & (at > 0), F.concat(F.substr(c, F.lit(1), at - 1), F.substr(c, at + F.length(part)))).otherwise(c)

    rest = T.strip(without(without(full_text, title), abstract))
    return F.when(rest != "", rest)


def default_abstract(text, most: int = 500) -> Column:
    """Without a backend: the leading sentences."""
    return T.truncate_sentence(T.strip(text), most)


def renumber(segments: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("segment_id")
    return segments.withColumn("segment_id", F.row_number().over(w))


def tag_numbers(segments: DataFrame) -> DataFrame:
    """tag becomes tag_Segment{n}, n counting within document and tag."""
    w = Window.partitionBy("doc_id", "tag").orderBy("segment_id")
    return segments.withColumn("tag", F.concat("tag", F.lit("_Segment"), F.row_number().over(w).cast("string")))


def page_of(content, pages) -> Column:
    """1-based index of the first page that holds the first 60, else the first 30, characters of a segment
    (white space aside); null for none."""
    flat = F.transform(pages, lambda p: F.regexp_replace(p, T.W, ""))

    def at(n):
        s = T.sample(content, n)
        hit = F.array_position(F.transform(flat, lambda p: F.contains(p, s)), True)
        return F.when((s != "") & (hit > 0), hit.cast("int"))

    return F.coalesce(at(60), at(30))


def page_numbers(layouts: DataFrame) -> DataFrame:
    """layouts: doc_id, seq, type, text, page_num. Without headers, footers and page numbers; texts of a page
    joined; page_idx counts the pages that have text (a missing or bad page number is page 0)."""
    page = F.greatest(F.coalesce(F.col("page_num").try_cast("int"), F.lit(0)), F.lit(0))
    kept = layouts.where(~F.coalesce(F.lower("type"), F.lit("")).isin(V.SKIPPED_LAYOUTS) & (T.strip(F.coalesce("text", F.lit(""))) != ""))
    pages = kept.groupBy("doc_id", page.alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", T.strip(F.col("text")).alias("text")))), lambda x: x.text), "\n\n").alias("page_text")
    )
    return pages.withColumn("page_idx", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page")))


def attach_chunks(segments: DataFrame, chunks: DataFrame, size: int, overlap: int, method: str, strict: bool = False) -> DataFrame:
    """Each segment's chunks as an array, chunk_info on every row; a segment without chunks has null. strict
    drops page_idx, as the service does."""
    per = chunks.groupBy("doc_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "segment_id", "content", "tag", "start_pos", "end_pos"))).alias("chunks"))
    out = segments.join(per, ["doc_id", "segment_id"], "left").withColumn("chunk_info", F.struct(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("overlap"), F.lit(method).alias("method")))
    return out.withColumn("page_idx", F.lit(None).cast("int")) if strict and "page_idx" in out.columns else out


def chunk_total(segments: DataFrame) -> DataFrame:
    return segments.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(F.col("chunks").isNotNull(), F.size("chunks"))), F.lit(0)).alias("n_chunks"))


def nest(heads: DataFrame, segments: DataFrame) -> DataFrame:
    """One row a document: status, title, abstract, segments (array of structs)."""
    cols = [c for c in ("segment_id", "content", "tag", "confidence", "page_idx", "chunks") if c in segments.columns]
    per = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("segments"))
    return heads.join(per, "doc_id", "left").select("doc_id", F.lit("success").alias("status"), "title", "abstract", F.coalesce("segments", F.array().cast(per.schema["segments"].dataType)).alias("segments"), F.lit(None).cast("string").alias("error_message"))
