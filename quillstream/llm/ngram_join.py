"""Operator 10, n-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased; a text's n-grams are its runs of five
words (a shorter text that has words has one n-gram, all of them). Texts with equal n-gram sets form a class.
Two classes are linked when the Jaccard similarity of their sets is at least the threshold.

1. A map over whole texts gives each document its class and the keys of its bands. Bands and rows are chosen
   as the fewest hashes that find a pair at the threshold with the target recall.
2. Classes of one representative each (least doc_id) are shuffled on band keys. In each bucket the members are
   compared with the least one, its head, so a bucket of k gives k - 1 comparisons, never its pairs. A member is
   joined to the head from a similarity of 2t - 1 on (t is the threshold): Jaccard distance is a metric, so
   two texts that are linked to each other cannot be parted by a head that one of them is linked to. Heads and what
   is linked to them leave the bucket, what is left gets a new head, for ROUNDS rounds; what is left then
   is joined without a comparison. So texts of a chance collision don't hang together.
3. Components of these edges are candidate groups. A group is verified in full, so pairs without a common
   band are also found. Groups beyond a bounded size are dealt into blocks by hash and every pair of blocks is
   a task of its own: no task holds an unbounded group. Within a task intersections are counted by matrix
   products over n-grams that occur twice or more; what leaves a task are link counts per class and a
   spanning forest of the links, not the pairs.
4. Components of the verified links are the duplicate groups.

Defined results: null or empty texts, and texts without words, have no n-grams, no links, and are their own
group; rows with a null doc_id are left out; rows that repeat a doc_id with the same text count once, with
another text the least class counts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import bound_batches, drop, fold_words, materialize, tidy
from quillstream.llm.components import connected_components

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Rounds of comparing buckets with their heads.
ROUNDS = 3
#: A verification task holds at most two blocks of about this many classes and n-grams.
BLOCK_CLASSES = 512
BLOCK_GRAMS = 1_000_000
SET_OPTIONS = {"parquet.block.size": str(32 << 20)}
#: A Python worker remembers the hashes of at most this many words, and forgets them when its task ends.
KEPT_WORDS = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, most_rows: int = 8) -> tuple[int, int]:
    """(bands, rows): the fewest hashes among the choices of up to most_rows rows that find a pair at the
    threshold with the target recall, and a pair at half the threshold with a probability of at most a quarter."""
    best = None
    for r in range(1, most_rows + 1):
        b = math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))
        if 1 - (1 - (threshold / 2) ** r) ** b <= 0.25 and (best is None or b * r < best[0] * best[1]):
            best = (b, r)
    if best is None:
        raise ValueError("no choice of bands meets the target")
    return best


def grams(text: str | None, n: int = N) -> np.ndarray:
    """The set of a text's n-grams as sorted distinct 64-bit hashes."""
    words = fold_words(text)
    if not words:
        return np.empty(0, np.uint64)
    held = _WORDS
    if len(held) > KEPT_WORDS:
        held.clear()
    h = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
    if len(h) <= n:
        out = h[:1].copy()
        for w in h[1:]:
            out = (out * _ODD) ^ w
        return _mix(out + np.uint64(len(h) if len(h) < n else 0))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out * _ODD) ^ h[k : len(h) - n + 1 + k]
    return np.unique(_mix(out))


class _Hashes(dict):
    def __missing__(self, word):
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


_WORDS = _Hashes()


def _forget() -> None:
    _WORDS.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Bands:
    def __init__(self, threshold: float, recall: float, seed: int = 7):
        self.bands, self.rows = choose_bands(threshold, recall)
        g = np.random.default_rng(seed)
        k = self.bands * self.rows
        self.a = (g.integers(1, 2**32, k, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = g.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)
        self.salt = _mix(np.arange(1, self.bands + 1, dtype=np.uint64) * _ODD)

    def keys(self, gram_set: np.ndarray) -> list[int]:
        """One 64-bit key a band."""
        low, high = gram_set.astype(np.uint32), (gram_set >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 4096):  # long texts in slices
            h = low[at : at + 4096, None] * self.a
            h ^= high[at : at + 4096, None]
            h *= np.uint32(0x85EBCA6B)
            h += self.b
            np.minimum(least, h.min(axis=0), out=least)
        out = self.salt.copy()
        sig = least.astype(np.uint64).reshape(self.bands, self.rows)
        for r in range(self.rows):
            out = _mix((out ^ sig[:, r]) * _ODD)
        return out.view(np.int64).tolist()


def _class_key(gram_set: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(gram_set.tobytes()) if len(gram_set) else None


_SIGNED = "doc_id long, class_key binary, n_grams long, keys array<long>"


def _signatures(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    def run(batches):
        bands = Bands(threshold, recall)
        for b in batches:
            keys, size, marks = [], [], []
            for t in b.column("text").to_pylist():
                g = grams(t, n)
                size.append(len(g))
                marks.append(_class_key(g))
                keys.append(bands.keys(g) if len(g) else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(marks, pa.binary()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "class_key", "n_grams", "keys"])

    return docs.mapInArrow(tidy(run, _forget), _SIGNED)


def _forest(links: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean link matrix's graph, towards the least id of each tree."""
    n = len(ids)
    left = np.ones(n, bool)
    out = []
    for start in np.argsort(ids):
        if not left[start]:
            continue
        left[start] = False
        edge = np.array([start])
        while len(edge):
            reached = np.flatnonzero(links[edge].any(axis=0) & left)
            left[reached] = False
            out += [(int(ids[x]), int(ids[start])) for x in reached]
            edge = reached
    return out


def _ratio(threshold: float) -> tuple[int, int]:
    """The threshold as a ratio of whole numbers, so that comparisons are exact: common * den >= num * union."""
    return round(threshold * 10_000), 10_000


def _link_matrix(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of each set of a with each set of b is at least the threshold."""
    sizes = [np.array([len(x) for x in s], np.int64) for s in (a, b)]
    ids, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    mark = np.zeros(len(ids), np.int8)
    cut = int(sizes[0].sum())
    mark[place[:cut]] |= 1
    mark[place[cut:]] |= 2
    shared = np.cumsum(mark == 3) - 1  # only n-grams on both sides count
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    cols = [shared[place[:cut]], shared[place[cut:]]]
    keep = [mark[place[:cut]] == 3, mark[place[cut:]] == 3]
    rows, cols = [r[k] for r, k in zip(rows, keep)], [c[k] for c, k in zip(cols, keep)]
    order = [np.argsort(c, kind="stable") for c in cols]
    rows, cols = [r[o] for r, o in zip(rows, order)], [c[o] for c, o in zip(cols, order)]
    both = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int((mark == 3).sum()), 2048):
        part = []
        for r, c, s in zip(rows, cols, sizes):
            lo, hi = np.searchsorted(c, [at, at + 2048])
            m = np.zeros((len(s), 2048), np.float32)
            m[r[lo:hi], c[lo:hi] - at] = 1
            part.append(m)
        both += part[0] @ part[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    num, den = _ratio(threshold)
    return both.astype(np.int64) * den >= num * union.astype(np.int64)


_VERIFIED = "kind string, a long, b long, n long, m long"


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """rows, sorted by task: task, left block, right block, side, rep, copies, grams. Gives for each task
    ('count', rep, null, linked classes, linked documents) and ('edge', rep, rep, null, null)."""

    def emit(group):
        sets = {s: [(rep, copies, np.frombuffer(g, np.uint64)) for side, rep, copies, g in group if side == s] for s in (0, 1)}
        one = not sets[1]
        a = sets[0]
        b = a if one else sets[1]
        if not a or not b:
            return []
        links = _link_matrix([x[2] for x in a], [x[2] for x in b], threshold)
        if one:
            np.fill_diagonal(links, False)
        out = []
        for side, other, m in ((a, b, links),) if one else ((a, b, links), (b, a, links.T)):
            copies = np.array([x[1] for x in other], np.int64)
            for (rep, _, _), k, w in zip(side, m.sum(axis=1).tolist(), (m @ copies).tolist()):
                if k:
                    out.append(("count", rep, None, k, w))
        if one:
            ids, square = np.array([x[0] for x in a], np.int64), links
        else:
            ids = np.array([x[0] for x in [*a, *b]], np.int64)
            square = np.zeros((len(ids), len(ids)), bool)
            square[: len(a), len(a) :] = links
            square[len(a) :, : len(a)] = links.T
        return out + [("edge", x, y, None, None) for x, y in _forest(square, ids)]

    def run(batches):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["kind", "a", "b", "n", "m"]
        task, group, out = None, [], []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("component", "i", "j", "side", "rep", "copies", "grams")]
            for c, i, j, side, rep, copies, t in zip(*cols):
                if (c, i, j) != task:
                    out += emit(group)
                    task, group = (c, i, j), []
                    if len(out) > 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
                        out = []
                group.append((side, rep, copies, t))
        out += emit(group)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(tidy(run, _forget), _VERIFIED)


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """rep, class_key and grams (the n-gram set, 8 bytes each) of (rep, text)."""

    def run(batches):
        for b in batches:
            got = [grams(t, n) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), pa.array(list(map(_class_key, got)), pa.binary()), pa.array([g.tobytes() for g in got], pa.binary())], names=["rep", "class_key", "grams"]
            )

    return texts.select("rep", "text").mapInArrow(tidy(run, _forget), "rep long, class_key binary, grams binary")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """rep, head, joined (similarity of at least 2 * threshold - 1) and linked (at least the threshold)."""
    num, den = _ratio(threshold)

    def run(batches):
        for b in batches:
            a, z = (b.column(c).to_pylist() for c in ("grams", "head_grams"))
            joined, linked = [], []
            for x, y in zip(a, z):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                linked.append(both * den >= num * union)
                joined.append(both * den >= (2 * num - den) * union)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("head"), pa.array(joined, pa.bool_()), pa.array(linked, pa.bool_())], names=["rep", "head", "joined", "linked"])

    both = pairs.join(sets.select("rep", "grams"), "rep").join(sets.select(F.col("rep").alias("head"), F.col("grams").alias("head_grams")), "head")
    # Sets whose sizes differ too much need no comparison: the smaller is all they can share.
    size, other = F.octet_length("grams"), F.octet_length("head_grams")
    alike = F.least(size, other) * den >= (2 * num - den) * F.greatest(size, other)
    return both.where(alike).select("rep", "head", "grams", "head_grams").mapInArrow(tidy(run), "rep long, head long, joined boolean, linked boolean")


def _group_edges(buckets: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """buckets: key, rep. Edges a, b that hold all texts together which are linked and share a bucket."""
    spark = buckets.sparkSession
    left, path, out = buckets, None, []
    for _ in range(ROUNDS):
        heads, p1 = materialize(left.groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "head"), "heads")
        member, p2 = materialize(left.join(heads, "key").where("rep <> head"), "bucket-members")
        if not member.head(1):
            left = member.select("key", "rep")
            break
        judged, _ = materialize(_similar(member.select("rep", "head").distinct(), sets, threshold), "judged")
        out.append(judged.where("joined").select(F.col("rep").alias("a"), F.col("head").alias("b")))
        rest, held = materialize(member.join(judged.where("linked").select("rep", "head"), ["rep", "head"], "left_anti").select("key", "rep"), "buckets-left")
        for p in (path, p1, p2):
            if p:
                drop(spark, p)
        left, path = rest, held
    heads = left.groupBy("key").agg(F.min("rep").alias("head"))
    out.append(left.join(heads, "key").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")))
    edges = out[0]
    for e in out[1:]:
        edges = edges.unionByName(e)
    return edges.distinct()


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """For every document: doc_id, rep_id (least doc_id with the same n-gram set), class_id (least doc_id of
    its group of linked documents), n_copies (documents of its n-gram set), n_links (other documents with
    similarity of at least the threshold, copies included), n_class_links (other n-gram sets linked)."""
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed, _ = materialize(_signatures(src, n, threshold, recall), "signatures")

    # Classes. A document that repeats has its least class; the counts are combined before the shuffle.
    one = signed.groupBy("doc_id").agg(F.min("class_key").alias("class_key"))
    member, _ = materialize(one, "members")
    classes, _ = materialize(member.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")

    # Buckets of two and more, and the n-gram sets of their members; of an id's texts the one of its class counts.
    reps = signed.select(F.col("doc_id").alias("rep"), "class_key", "n_grams", "keys").join(classes, ["rep", "class_key"], "left_semi").dropDuplicates(["rep"])
    reps, p0 = materialize(reps, "representatives")
    bucketed, p1 = materialize(reps.select("rep", F.explode("keys").alias("key")), "buckets")
    full = bucketed.groupBy("key").count().where("count > 1").select("key")
    bucketed, p2 = materialize(bucketed.join(full, "key", "left_semi"), "full-buckets")
    wanted, p3 = materialize(bucketed.select("rep").distinct(), "wanted")
    texts = src.withColumnRenamed("doc_id", "rep").join(wanted, "rep", "left_semi")
    sets, p4 = materialize(_sets(texts, n).join(classes, ["rep", "class_key"], "left_semi").dropDuplicates(["rep"]).select("rep", "grams"), "sets", **SET_OPTIONS)
    group = connected_components(_group_edges(bucketed, sets, threshold))

    # Groups and their blocks.
    sized, p5 = materialize(
        group.join(reps.select(F.col("rep").alias("node"), "n_grams"), "node").join(classes.select(F.col("rep").alias("node"), "copies"), "node"), "candidates"
    )
    blocks = sized.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n_grams").alias("g")).select(
        "component", F.greatest(F.ceil(F.col("k") / BLOCK_CLASSES), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int").alias("blocks")
    )
    blocks, p6 = materialize(blocks, "blocks")
    dealt = sized.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = F.struct(F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"))
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")),
        lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j"), F.when(F.col("block") < x, 0).otherwise(1).alias("side")),
    )
    tasks, p7 = materialize(dealt.select(F.col("node").alias("rep"), "copies", "component", F.explode(F.concat(F.array(own), pairs)).alias("t")).select("rep", "copies", "component", "t.*"), "tasks")
    rows = tasks.join(sets, "rep").repartition(F.col("component"), F.col("i"), F.col("j")).sortWithinPartitions("component", "i", "j", "side", "rep")
    verified, _ = materialize(_verify(rows, threshold), "verified")
    for path in (p0, p1, p2, p3, p4, p5, p6, p7):
        drop(spark, path)
    counts = verified.where("kind = 'count'").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_class_links"), F.sum("m").alias("linked"))
    final = connected_components(verified.where("kind = 'edge'").select("a", "b")).withColumnRenamed("node", "rep")

    facts, _ = materialize(classes.join(counts, "rep", "left").join(final, "rep", "left"), "facts")
    zero = F.lit(0).cast("long")
    return member.join(facts, "class_key", "left").select(
        "doc_id", F.coalesce("rep", "doc_id").alias("rep_id"), F.coalesce("component", "rep", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
        (F.coalesce("linked", zero) + F.coalesce(F.col("copies") - 1, zero)).alias("n_links"), F.coalesce("n_class_links", zero).alias("n_class_links"),
    )


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs, one document of each group: the one of least doc_id. Rows with a null doc_id stay;
    texts that share a doc_id are judged one by one, so of these one stays only where they are equal or linked."""
    key = F.col("doc_id").cast("long")
    if not docs.where(key.isNotNull()).groupBy(key).count().where("count > 1").head(1):
        joined = ngram_join(docs, n, threshold, recall)
        gone, _ = materialize(joined.where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")), "gone")
        return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    # An id and a text's digest are numbered in the order of ids, so the least number has the least id.
    pair = ["_id", "_digest"]
    named = docs.withColumn("_id", key).withColumn("_digest", F.coalesce(F.sha2(F.col("text").cast("string").cast("binary"), 256), F.lit("null")))
    numbered = named.where("_id is not null").groupBy(*pair).agg(F.count(F.lit(1)).alias("_rows")).orderBy(*pair).withColumn("_n", F.monotonically_increasing_id())
    numbered, _ = materialize(numbered, "numbered")
    joined = ngram_join(named.join(numbered, pair).select(F.col("_n").alias("doc_id"), "text"), n, threshold, recall)
    gone, _ = materialize(joined.where("doc_id <> class_id").select(F.col("doc_id").alias("_n")).join(numbered, "_n").select(*pair), "gone")
    kept = named.join(gone, pair, "left_anti")
    again = numbered.where("_rows > 1").select(*pair)
    return kept.join(again, pair, "left_anti").unionByName(kept.join(again, pair, "left_semi").dropDuplicates(pair)).select(*[F.col(f"`{c}`") for c in docs.columns])
