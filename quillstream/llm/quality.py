"""Operator 1, quality: Bradley-Terry ranking of documents from preference pairs.

A document's strength is linear in statistics of its whole text (character classes, words, lines,
repetition). Of each pair of a good and a bad labelled document the good one is preferred; the weights
minimise the logistic loss on the differences of the two documents' features, with a small ridge, by
Newton's method. The strength at the score quantile that divides the labelled rows best is the threshold; a
score is the logistic of the strength, moved and scaled so that this threshold has the score CUT.

Labels, language, source and doc_id are never inputs of a score. Learning uses at most `LEARN_ROWS` labelled
rows, chosen by a hash of their id, and at most `LEARN_PAIRS` pairs of them.

Scale: learning broadcasts the bounded sample's ids and reads texts once; scoring is a map.

Defined results: null and empty texts are scored like any other text (all statistics are 0 or their neutral
value); without labels of both kinds every score is the smoothed share of good labels; repeated rows and
null ids keep their rows; other columns are ignored (score) or kept (keep_good).
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import bound_batches, crc_mod, keep_rows, labelled_sample, learning_rows, tidy

CUT = 0.7
LEARN_ROWS = 20_000
LEARN_PAIRS = 200_000
HELD_MOD, HELD_REST = 4, 2

_CLASSES = [
    bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" ", b"\n", b".,;:", b"!?", b"#*$%&", b"|<>", b"/\\_=-+~^@", b"\"'()[]{}`",
    bytes(range(128, 256)), b"\t\r" + bytes(range(0, 9)),
]


def statistics(text: str | None) -> list[float]:
    """The statistics of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    bins = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    share = [float(bins[list(c)].sum()) / (n + 1) for c in _CLASSES]
    p = bins[bins > 0] / max(n, 1)
    entropy = float(-(p * np.log(p)).sum())
    words = (text or "").split()
    w = len(words)
    kinds = Counter(words)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    line_kinds = len(set(lines))
    same = sum(map(str.__eq__, words, words[1:]))
    triples = Counter(zip(words, words[1:], words[2:]))
    again = sum(c for c in triples.values() if c > 1)
    caps = sum(map(str.isupper, kinds.elements())) if w < 50 else sum(c for k, c in kinds.items() if k.isupper())
    marked = sum(c for k, c in kinds.items() if not k[-1].isalnum())
    bare = sum(c for k, c in kinds.items() if not any(map(str.isalnum, k)))
    most = kinds.most_common(1)[0][1] if w else 0
    return [
        *share,
        *(math.sqrt(s) for s in share),
        entropy,
        math.log1p(n), math.log1p(w),
        sum(map(len, words)) / (w + 1),
        math.log1p(max(map(len, words), default=0)),
        math.log(len(kinds) + 1) / math.log(w + 2),
        same / (w + 1), again / (w + 1), most / (w + 20), caps / (w + 1), marked / (w + 1), bare / (w + 1),
        math.log1p(len(lines)), 1 - line_kinds / (len(lines) or 1), math.log1p(w / (len(lines) or 1)),
        float(bool(n)),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(statistics(None)))


class BradleyTerry:
    """score() of texts; fit() from statistics and labels."""

    def __init__(self, centre, scale, weights, shift: float, gain: float, flat: float | None = None):
        self.centre, self.scale, self.weights, self.shift, self.gain, self.flat = centre, scale, weights, shift, gain, flat

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pairs: int = LEARN_PAIRS, ridge: float = 1e-3, seed: int = 11) -> "BradleyTerry":
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return cls(None, None, None, 0.0, 0.0, (len(good) + 1) / (len(y) + 2))
        centre = np.median(x, axis=0)
        scale = x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.clip((x - centre) / scale, -8, 8)
        g = np.random.default_rng(seed)
        m = min(pairs, 4 * len(good) * len(bad))
        d = z[g.choice(good, m)] - z[g.choice(bad, m)]
        w = cls.weights_of(d, ridge)
        s = z @ w
        shift = cls._threshold(s, y)
        # The logistic's gain fits the labelled rows; its value at the threshold is CUT.
        base, gain = math.log(CUT / (1 - CUT)), 1.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(gain * (s - shift) + base, -30, 30)))
            t = s - shift
            first, second = float(((y - p) * t).mean()) - 1e-3 * gain, float((p * (1 - p) * t * t).mean()) + 1e-3
            gain = min(max(gain + max(min(first / second, 1.0), -1.0), 0.05), 20.0)
        return cls(centre, scale, w, shift, gain)

    @staticmethod
    def weights_of(d: np.ndarray, ridge: float) -> np.ndarray:
        """The weights that minimise the mean logistic loss on differences (the preferred one's features less the
        other's) with a ridge, by Newton's method with bounded steps."""
        w = np.zeros(d.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the other one wins
            grad = d.T @ p / len(d) - ridge * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = w + step / max(1.0, np.linalg.norm(step) / 5)
            if np.abs(step).max() < 1e-6:
                break
        return w

    @staticmethod
    def _threshold(s: np.ndarray, y: np.ndarray) -> float:
        """The score at the quantile, of a grid of thousandths, that gives most right labels; of equal ones
        the middle. Bad rows weigh no more than good ones, as clean documents are to be kept."""
        order = np.sort(s)
        best, at = None, []
        for q in np.arange(0, 1.0005, 0.001):
            cut = float(np.quantile(order, q))
            right = int(((s >= cut) == (y == 1)).sum())
            if best is None or right > best:
                best, at = right, [cut]
            elif right == best:
                at.append(cut)
        return float(np.mean([at[0], at[-1]])) if len(at) > 1 else at[0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(texts), self.flat)
        z = np.clip((matrix(texts) - self.centre) / self.scale, -8, 8)
        e = self.gain * (z @ self.weights - self.shift) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(e, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, limit: int = LEARN_ROWS) -> BradleyTerry:
    """Fit on labelled documents whose crc32(doc_id) mod 4 is not 2."""
    bound_batches(docs.sparkSession)
    sample = labelled_sample(labels, "quality", HELD_MOD, HELD_REST, limit)

    def run(batches):
        for b in batches:
            x = matrix(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = learning_rows(docs, sample).select("doc_id", "y", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, y int, x array<double>").orderBy("doc_id").collect() if sample else []
    return BradleyTerry.fit(np.array([r.x for r in rows], np.float64).reshape(len(rows), len(statistics(None))), np.array([r.y for r in rows], np.int64))


def score(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            s = model.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", HELD_MOD) == HELD_REST).alias("held_out"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are predicted to be good."""
    model = learn(docs, labels)
    return keep_rows(docs, lambda texts: model.score(texts) >= CUT)
