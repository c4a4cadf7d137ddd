"""Labels: backends, parsers of their responses, smoothing, merging and plans."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import vocabulary as V

_TAGGED = "struct<tag:string,confidence:double>"


class Backend(Protocol):
    """A classifier. Made once a partition by a factory; label() gets at most LABEL_BATCH texts."""

    def label(self, texts: list[str]) -> list[tuple[str, float]]: ...


class KeywordBackend:
    """Needs no service: the first tag whose keyword a text contains."""

    def __init__(self, confidence: float = 0.6):
        self.confidence = confidence

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for t in texts:
            whole = t.lower()
            tag = next((tag for tag, words in V.TAG_KEYWORDS if any(w in whole for w in words)), None)
            out.append((tag or V.OTHER, self.confidence if tag else 0.5))
        return out


def label_segments(segments: DataFrame, factory: Callable[[], Backend] = KeywordBackend, per_call: int = V.LABEL_BATCH) -> DataFrame:
    """Adds tag and confidence. Segments are labelled in runs of `per_call`; a run that fails is labelled one
    by one; a blank or failing segment gets the fallback with 0."""
    names = [f.name for f in segments.schema.fields if f.name not in ("tag", "confidence")]
    src = segments.select(*names)

    def one(backend, t):
        try:
            return backend.label([t])[0]
        except Exception:
            return (V.OTHER, 0.0)

    def run(batches):
        backend = factory()
        for b in batches:
            texts = b.column("content").to_pylist()
            out = [(V.OTHER, 0.0)] * len(texts)
            full = [i for i, t in enumerate(texts) if t and t.strip()]
            for at in range(0, len(full), per_call):
                some = full[at : at + per_call]
                try:
                    got = backend.label([texts[i] for i in some])
                    if len(got) != len(some):
                        raise ValueError("labels are missing")
                except Exception:
                    got = [one(backend, texts[i]) for i in some]
                for i, g in zip(some, got):
                    out[i] = g
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t for t, _ in out]), pa.array([float(c) for _, c in out], pa.float64())], names=[*b.schema.names, "tag", "confidence"])

    from pyspark.sql import types as ST

    schema = ST.StructType([*src.schema.fields, ST.StructField("tag", ST.StringType()), ST.StructField("confidence", ST.DoubleType())])
    return src.mapInArrow(run, schema)


# Responses


def parse_single(response, variant: str = "rule") -> Column:
    """The first object without inner braces; else the first tag that the response contains."""
    found = F.regexp_extract(response, r"\{[^}]+\}", 0)
    ok = F.try_parse_json(found).isNotNull() & (found != "")
    raw = F.get_json_object(found, "$.confidence")
    conf = raw.try_cast("double")
    ok = ok & (raw.isNull() | conf.isNotNull())
    tag = T.valid_tag(F.coalesce(F.get_json_object(found, "$.tag"), F.lit(V.OTHER)), variant)
    return F.when(ok, F.struct(tag.alias("tag"), T.clamp(F.coalesce(conf, F.lit(0.5))).alias("confidence"))).otherwise(T.tag_scan(response))


def _items(found, fields: str) -> Column:
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), F.from_json(found, f"array<struct<{fields}>>"))


def parse_batch(response, expected) -> Column:
    """Labels by position; another number than expected: line by line (fallback_lines)."""
    items = _items(F.regexp_extract(response, r"\[[\s\S]*\]", 0), "tag:string,confidence:string")
    good = F.transform(
        items,
        lambda x: F.struct(T.valid_tag(F.coalesce(x.tag, F.lit(V.OTHER))).alias("tag"), T.clamp(F.coalesce(x.confidence, F.lit("0.5")).try_cast("double")).alias("confidence")),
    )
    sound = (F.size(good) == expected) & ~F.exists(good, lambda x: x.confidence.isNull())
    return F.when(F.coalesce(sound, F.lit(False)), good.cast(f"array<{_TAGGED}>")).otherwise(fallback_lines(response, expected))


def fallback_lines(response, expected) -> Column:
    """For each index the first of three forms that names a tag: exact 0.7, by keyword 0.6, else fallback 0.5."""

    def one(i):
        n = i.cast("string")
        pick = lambda p, g: F.call_function("regexp_extract", response, p, F.lit(g))
        # The three line forms of a response.
        forms = [
            pick(F.concat(F.lit("段落"), n, F.lit(rf"[：:]{T.W}*({T.NOT_W}+)")), 1),
            pick(F.concat(F.lit(rf'"id"{T.W}*:{T.W}*'), n, F.lit(rf'[^}}]*"tag"{T.W}*:{T.W}*"([^"]+)"')), 1),
            pick(F.concat(n, F.lit(rf"\.{T.W}*({T.NOT_W}+)")), 1),
        ]
        out = None
        for f in forms:
            fuzzy = T.fuzzy_tag(f)
            exact, near = (f != "") & f.isin(V.TAGS), (f != "") & (fuzzy != V.OTHER)
            out = F.when(exact, F.struct(f.alias("tag"), F.lit(0.7).alias("confidence"))) if out is None else out.when(exact, F.struct(f.alias("tag"), F.lit(0.7).alias("confidence")))
            out = out.when(near, F.struct(fuzzy.alias("tag"), F.lit(0.6).alias("confidence")))
        return out.otherwise(F.struct(F.lit(V.OTHER).alias("tag"), F.lit(0.5).alias("confidence")))

    return F.transform(F.when(expected > 0, F.sequence(F.lit(1), expected)).otherwise(F.array().cast("array<int>")), one).cast(f"array<{_TAGGED}>")


def parse_unified(response) -> Column:
    """Segments of an object with "segments": content, tag, confidence; null where there are none to be had."""
    found = F.regexp_extract(response, r'\{[\s\S]*"segments"[\s\S]*\}', 0)
    items = F.when(F.try_parse_json(found).isNotNull(), F.from_json(found, "segments array<struct<content:string,tag:string,confidence:string>>").segments)
    good = F.transform(
        F.filter(items, lambda x: T.strip(F.coalesce(x.content, F.lit(""))) != ""),
        lambda x: F.struct(
            T.strip(x.content).alias("content"), T.valid_tag(F.coalesce(x.tag, F.lit(V.OTHER)), "unified").alias("tag"),
            T.clamp(F.coalesce(x.confidence, F.lit("0.5")).try_cast("double")).alias("confidence"),
        ),
    )
    return F.when(F.size(good) > 0, good)


def apply_plan(sentences, plan) -> Column:
    """Sentences grouped as {"segments": [[1, 2], [3]]} says: first use counts, what is out of range or used
    before is passed over, unused sentences follow one by one; anything else leaves the sentences alone."""
    found = F.regexp_extract(plan, r"\{[\s\S]*\}", 0)
    groups = F.when(F.try_parse_json(found).isNotNull(), F.from_json(found, "segments array<string>").segments)
    groups = F.transform(groups, lambda g: F.from_json(g, "array<int>"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<int>").alias("used"))

    def step(a, g):
        fresh = F.array_distinct(F.filter(F.coalesce(g, F.array().cast("array<int>")), lambda i: i.isNotNull() & (i >= 1) & (i <= F.size(sentences)) & ~F.array_contains(a.used, i)))
        text = F.array_join(F.transform(fresh, lambda i: F.element_at(sentences, i)), "\n")
        return F.struct(F.when(F.size(fresh) > 0, F.concat(a.done, F.array(text))).otherwise(a.done).alias("done"), F.concat(a.used, fresh).alias("used"))

    rest = lambda a: F.transform(F.filter(F.sequence(F.lit(1), F.size(sentences)), lambda i: ~F.array_contains(a.used, i)), lambda i: F.element_at(sentences, i))
    return F.when(groups.isNull() | (F.size(sentences) == 0), sentences).otherwise(F.aggregate(groups, start, step, lambda a: F.concat(a.done, rest(a))))


# Neighbours


def smooth(segments: DataFrame, below: float = V.SMOOTH_BELOW) -> DataFrame:
    """An uncertain label between two equal others takes theirs, at nine tenths of its confidence; on the
    labels as given, so a change never leads to another. First and last rows stay."""
    w = Window.partitionBy("doc_id").orderBy("segment_id")
    before, after = F.lag("tag").over(w), F.lead("tag").over(w)
    take = (F.col("confidence") < below) & (before == after) & (before != F.col("tag"))
    return segments.withColumns({"_take": F.coalesce(take, F.lit(False)), "_tag": before}).select(
        *[c for c in segments.columns if c not in ("tag", "confidence")],
        F.when(F.col("_take"), F.col("_tag")).otherwise(F.col("tag")).alias("tag"),
        F.when(F.col("_take"), F.col("confidence") * 0.9).otherwise(F.col("confidence")).alias("confidence"),
    )


def merge_same_tag(segments: DataFrame) -> DataFrame:
    """Joins a segment to the one before if that has the same tag and doesn't end its sentence; the least
    confidence counts."""
    w = Window.partitionBy("doc_id").orderBy("segment_id")
    joins = (F.lag("tag").over(w) == F.col("tag")) & ~T.is_terminated(F.lag("content").over(w), "unified")
    marked = segments.withColumn("_start", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_group", F.sum("_start").over(w))
    return (
        marked.groupBy("doc_id", "_group")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "content"))), lambda x: x.content), "\n").alias("content"), F.first("tag").alias("tag"), F.min("confidence").alias("confidence"))
        .withColumnRenamed("_group", "segment_id")
    )


PROMPTS = {
    "single": "Name the one tag of this list that fits the text, as JSON with tag and confidence. Tags: {tags}\nText: {text}",
    "batch": "For each numbered text give one tag of the list, as a JSON array of id, tag and confidence, in order. Tags: {tags}\n{text}",
    "plan": 'Group the numbered sentences that belong together, in order, as JSON {{"segments": [[1, 2], [3]]}}.\n{text}',
    "unified": 'Cut the text into segments and tag each, as JSON {{"segments": [{{"content", "tag", "confidence"}}]}}. Tags: {tags}\n{text}',
    "chunks": "Cut the text into about {count} parts that each make sense, as a JSON array of objects with content.\n{text}",
    "abstract": "Sum up the text in at most {count} characters.\n{text}",
}


def prompt(kind: str, text: str, count: int = 0) -> str:
    return PROMPTS[kind].format(tags=", ".join(V.TAGS), text=text, count=count)
