"""Operator 2, benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each row of its table is a segment, holding the terms of a run of
documents and, for every term, the ascending positions at which it occurs (documents are laid end to end
with gaps). To find a phrase, the posting lists of its terms are shifted by the terms' offsets and
intersected, beginning with the rarest term of that segment. Exact phrases and proximity matches (all terms
within a window) are answered alike.

Scale: building and searching are maps over documents and segments; no posting is shuffled. Segments hold
about `SEGMENT_BYTES` of text (a longer document has one of its own). Words are numbered as they are read, so a
worker holds four bytes a word and the segment's terms. Phrases are a stated query set: they are read in blocks
of at most `BLOCK_WORDS` words, each block is broadcast, and answers of several blocks are merged per document
by a shuffle of hit documents only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased.

Defined results: null or empty texts have no words and no hits; an item without words has no window;
repeated items of the same id count once; repeated documents each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import bound_batches, drop, fold_words, materialize, tidy

WINDOW = 13
GAP = 64
SEGMENT_BYTES = 6 << 20
BLOCK_WORDS = 400_000
#: Windows looked up at a time.
ROWS_AT_ONCE = 1 << 16
#: Rows are a few MB each, so the writer is to look at a row group's size after every second row.
INDEX_OPTIONS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "2", "parquet.block.size.row.check.max": "2"}

INDEX_SCHEMA = "docs array<long>, marks array<long>, lengths array<long>, terms binary, term_ends binary, freqs binary, positions binary"


class Segment:
    """Postings of a run of documents."""

    def __init__(self, docs, marks, lengths, terms: list[bytes], freqs: np.ndarray, positions: np.ndarray):
        self.docs, self.marks, self.lengths = docs, marks, np.asarray(lengths, np.int64)
        self.starts = _starts(self.lengths)
        self.number = dict(zip(terms, range(len(terms))))
        self.freqs = freqs
        self.ends = np.cumsum(freqs, dtype=np.int64)
        self.positions = positions

    def postings(self, term: int) -> np.ndarray:
        end = self.ends[term]
        return self.positions[end - self.freqs[term] : end]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions at which a phrase (term numbers) starts: offset-adjusted lists, the rarest first."""
        found = None
        for k in np.argsort(self.freqs[terms], kind="stable"):
            if found is None:
                found = self.postings(terms[k]) - k
                continue
            listed = self.postings(terms[k])
            at = np.searchsorted(listed, found + k)
            found = found[(at < len(listed)) & (listed[np.minimum(at, len(listed) - 1)] == found + k)]
            if not len(found):
                break
        return found

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most `slop` words away; slop < GAP."""
        order = np.argsort(self.freqs[terms], kind="stable")
        found = self.postings(terms[order[0]])
        for k in order[1:]:
            listed = self.postings(terms[k])
            at = np.searchsorted(listed, found - slop)
            found = found[(at < len(listed)) & (listed[np.minimum(at, len(listed) - 1)] <= found + slop)]
        return found

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Which document of the segment each position lies in."""
        return np.searchsorted(self.starts, positions, side="right") - 1


class _Numbers(dict):
    """Numbers terms from 0 in the order in which they are first asked for."""

    def __missing__(self, term):
        n = self[term] = len(self)
        return n


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Where each document begins when they are laid end to end with gaps."""
    ends = np.cumsum(lengths + GAP)
    return ends - lengths - GAP


def _segment_batch(docs: list, marks: list, parts: list[np.ndarray], terms: list[bytes]) -> pa.RecordBatch:
    """The index row of documents given as arrays of term numbers."""
    lengths = np.array([len(p) for p in parts], np.int64)
    ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
    parts.clear()
    last = int(lengths.sum()) + GAP * len(lengths)
    where = np.arange(len(ids), dtype="<i8" if last >= 2**31 else "<i4")
    where += np.repeat(_starts(lengths) - (np.cumsum(lengths) - lengths), lengths).astype(where.dtype)
    freqs = np.bincount(ids, minlength=len(terms)).astype("<i4")
    positions = where[np.argsort(ids, kind="stable")]
    del where, ids
    # Differences compress well; each term's first position stands as it is.
    first = np.cumsum(freqs, dtype=np.int64) - freqs
    heads = positions[first]
    positions[1:] -= positions[:-1].copy()
    positions[first] = heads
    ends = np.cumsum(np.fromiter(map(len, terms), np.int64, len(terms)), dtype="<i8")
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([docs], longs), pa.array([marks], longs), pa.array([lengths], longs), pa.array([b"".join(terms)], pa.binary()),
            pa.array([ends.tobytes()], pa.binary()), pa.array([freqs.tobytes()], pa.binary()), pa.array([positions.tobytes()], pa.binary()),
        ],
        names=["docs", "marks", "lengths", "terms", "term_ends", "freqs", "positions"],
    )


def _load(row: dict) -> Segment:
    freqs = np.frombuffer(row["freqs"], "<i4")
    total = int(freqs.sum(dtype=np.int64))
    raw = row["positions"]
    gaps = np.frombuffer(raw, "<i8" if total and len(raw) == 8 * total else "<i4")
    first = np.cumsum(freqs, dtype=np.int64) - freqs
    # A term's positions are running sums of its differences: take away what the terms before add up to.
    positions = np.cumsum(gaps, dtype=np.int64)
    if total:
        positions -= np.repeat(np.where(first > 0, positions[first - 1], 0), freqs)
    text = row["terms"]
    ends = np.frombuffer(row["term_ends"], "<i8").tolist()
    terms = [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    return Segment(row["docs"], row["marks"], row["lengths"], terms, freqs, positions.astype(np.int32) if total and positions.max() < 2**31 - GAP else positions)


def _segments(batch: pa.RecordBatch, names: list[str]):
    """The rows of a batch one at a time; the others stay in the batch's buffers."""
    for k in range(batch.num_rows):
        yield {n: batch.column(n)[k].as_py() for n in names}


_PARTS = ["docs", "marks", "lengths", "terms", "term_ends", "freqs", "positions"]


def build_index(docs: DataFrame) -> DataFrame:
    """The index of (doc_id, text) as a table in the shared folder: a row a segment. A column `mark` (long), if
    there is one, goes along with the id."""
    return _build(docs)[0]


def _build(docs: DataFrame) -> tuple[DataFrame, str]:
    bound_batches(docs.sparkSession)

    def run(batches):
        ids, marks, parts, number, size = [], [], [], _Numbers(), 0
        for b in batches:
            texts = b.column("text")
            for k, (i, m) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist())):
                words = fold_words(texts[k].as_py())
                ids.append(i)
                marks.append(m)
                parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                size += sum(map(len, words)) + len(words)
                if size >= SEGMENT_BYTES:
                    yield _segment_batch(ids, marks, parts, list(number))
                    ids, marks, parts, number, size = [], [], [], _Numbers(), 0
        if ids:
            yield _segment_batch(ids, marks, parts, list(number))

    mark = F.col("mark").cast("long") if "mark" in docs.columns else F.lit(None).cast("long")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), F.col("text").cast("string").alias("text"))
    return materialize(src.mapInArrow(tidy(run), INDEX_SCHEMA), "postings", **INDEX_OPTIONS)


class PhraseBlock:
    """Windows of a block of items: distinct word sequences, and the items each belongs to."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        number = _Numbers()
        rows, owner = [], []
        for i, words in items:
            if words:
                ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                if len(ids) < window:
                    ids = np.concatenate([ids, np.full(window - len(ids), -1, np.int32)])
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
                owner.append(np.full(len(rows[-1]), i, np.int64))
        self.terms = list(number)
        #: term numbers, by window; -1 past the end of a short one
        self.matrix = np.empty((0, window), np.int32)
        self.owner = self.owner_ends = np.empty(0, np.int64)
        if rows:
            self.matrix, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner)]), axis=1)
            self.owner, self.owner_ends = pairs[1], np.cumsum(np.bincount(pairs[0], minlength=len(self.matrix)))

    def owners(self, r: int) -> list[int]:
        """The items that a window belongs to."""
        return self.owner[self.owner_ends[r - 1] if r else 0 : self.owner_ends[r]].tolist()

    def search(self, seg: Segment):
        """(start, words, window number) of each occurrence in a segment."""
        here = np.array([seg.number.get(t, -1) for t in self.terms] + [-2], np.int64)  # -1 of the matrix picks the last
        for at in range(0, len(self.matrix), ROWS_AT_ONCE):
            m = here[self.matrix[at : at + ROWS_AT_ONCE]]
            for r in np.flatnonzero((m != -1).all(axis=1)).tolist():
                row = m[r]
                row = row[row >= 0]
                for s in seg.phrase(row).tolist():
                    yield s, len(row), at + r


def phrase_blocks(items: DataFrame, window: int, block_words: int):
    """Blocks of the items, of at most block_words words (or one item) each; the driver holds one at a time."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        words = fold_words(r.text)
        if r.item_id is not None and words:
            if held and size + len(words) > block_words:
                yield PhraseBlock(held, window)
                held, size = [], 0
            held.append((r.item_id, words))
            size += len(words)
    if held:
        yield PhraseBlock(held, window)


_FOUND = "segment long, place long, doc_id long, mark long, n_words long, spans array<struct<start:long,stop:long>>, items array<long>"


def _search(index: DataFrame, block: PhraseBlock | None) -> DataFrame:
    """For each document of the index: merged spans of hit words and the items that occur. `segment` and
    `place`, the segment's number and the place in it, tell documents apart where ids repeat."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(block)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.int64())]

    def run(batches):
        block = shared.value
        for b in batches:
            for row in _segments(b, ["segment", *_PARTS]):
                seg = _load(row)
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[int]] = {}
                if block is not None:
                    hits = sorted(block.search(seg))
                    owners = seg.owner(np.array([h[0] for h in hits], np.int64)).tolist()
                    for (start, size, r), d in zip(hits, owners):
                        at = start - int(seg.starts[d])
                        got = spans.setdefault(d, [])
                        if got and got[-1][1] >= at:
                            got[-1] = (got[-1][0], max(got[-1][1], at + size))
                        else:
                            got.append((at, at + size))
                        items.setdefault(d, set()).update(block.owners(r))
                count = len(seg.docs)
                cols = [
                    [row["segment"]] * count, list(range(count)), seg.docs, seg.marks, seg.lengths.tolist(),
                    [[{"start": a, "stop": z} for a, z in spans.get(d, ())] for d in range(count)],
                    [sorted(items.get(d, ())) for d in range(count)],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["segment", "place", "doc_id", "mark", "n_words", "spans", "items"])

    return index.mapInArrow(tidy(run), _FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, mark (as build_index()), n_words, spans (merged runs of hit words, half open), items (ids with an
    occurring window).

    With several blocks of items, spans of a document may overlap; n_hit() counts their union."""
    return _decontaminate(docs, benchmark, window, block_words)[0]


def _decontaminate(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> tuple[DataFrame, str]:
    """decontaminate(), and the path of its index."""
    index, path = _build(docs)
    # The number holds the partition in its upper bits, so no arithmetic is done with it.
    index = index.withColumn("segment", F.monotonically_increasing_id())
    blocks = phrase_blocks(benchmark, window, block_words)
    first = next(blocks, None)
    found, several = _search(index, first), False
    for block in blocks:
        several = True
        found = found.unionByName(_search(index, block).where(F.size("items") > 0))
    if several:
        found = found.groupBy("segment", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    return found.drop("segment", "place"), path


def n_hit(spans):
    """How many words the union of spans covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto"))
    step = lambda acc, s: F.struct(
        (acc.n + F.greatest(s.stop - F.greatest(s.start, acc.upto), F.lit(0).cast("long"))).alias("n"), F.greatest(acc.upto, s.stop).alias("upto")
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc.n)


def verdicts(found: DataFrame) -> DataFrame:
    """The digest of decontaminate(): n_hit, n_items, items_sha256 and contaminated (a twentieth or more is hit)."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = found.select("doc_id", "n_words", n_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return out.withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))


def _contaminated(hit, words):
    return (hit > 0) & (20 * hit >= words)


def phrase_matches(index: DataFrame, phrases: list[tuple[int, str]], slop: int | None = None) -> DataFrame:
    """(phrase_id, doc_id, position) of exact phrases, or with a slop of the rarest word of each place where
    all words of a phrase lie at most that many words from it. The list of phrases is the caller's."""
    if slop is not None and not 0 <= slop < GAP:
        raise ValueError(f"slop must be at least 0 and less than {GAP}")
    bound_batches(index.sparkSession)
    listed = [(i, fold_words(t)) for i, t in phrases]

    def run(batches):
        for b in batches:
            for row in _segments(b, _PARTS):
                seg = _load(row)
                out = []
                for i, words in listed:
                    terms = np.array([seg.number.get(w, -1) for w in words], np.int64)
                    if len(terms) and (terms >= 0).all():
                        at = seg.phrase(terms) if slop is None else seg.near(terms, slop)
                        out += [(i, seg.docs[d], int(p - seg.starts[d])) for p, d in zip(at, seg.owner(at))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["phrase_id", "doc_id", "position"])

    return index.mapInArrow(tidy(run), T.StructType([T.StructField(n, T.LongType()) for n in ("phrase_id", "doc_id", "position")]))


def items_digest(items) -> str:
    """What items_sha256 holds, for a list of item ids."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that verdicts() doesn't call contaminated. Rows with a null
    doc_id are judged by their text like the others, rows that repeat a doc_id each on its own text."""
    # 128 bits tell texts apart whatever their ids are; only those of contaminated ones are joined back.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low, high = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    found, path = _decontaminate(docs.select(low.alias("doc_id"), high.alias("mark"), "text"), benchmark, WINDOW, BLOCK_WORDS)
    bad = found.where(_contaminated(n_hit(F.col("spans")), F.col("n_words"))).select(F.col("doc_id").alias("low"), F.col("mark").alias("high")).distinct()
    bad, _ = materialize(bad, "contaminated")
    drop(docs.sparkSession, path)
    return docs.join(bad, (low == bad["low"]) & (high == bad["high"]), "left_anti")
