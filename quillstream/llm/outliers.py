"""Operator 8, quality rules with robust multivariate outliers.

Each text gives counts (words, characters in words, symbols, repeated lines, words in repeated three-word
windows). Texts that fail the base rules are out. For the others a vector of transformed shares is compared
with its language and source: location and scatter come from the minimum-covariance-determinant method, and
a vector whose squared Mahalanobis distance is beyond a chi-square quantile is rejected.

The estimate is deterministic: concentration steps run from three starts (medians with quartile spreads; means with
the scatter of all rows; medians with equal scatter). A step refits means and scatter to the three quarters of a
group's rows that are nearest, which never raises the scatter's determinant; steps go on until no start's
determinant falls any more, and the start with the least one counts. The core is exact in groups of up to
EXACT rows (the rank of its edge is off by a 1/EXACT of the rows at most in larger ones). `FLOOR` is added to the
variances (as in the regularised form of the method), since most texts have no symbol or repetition at all and a
scatter without it would be singular. Then a group of n rows keeps n / (n + SHRINK_MEANS) of its own means and
n / (n + SHRINK_SCATTER) of its own scatter, the rest comes from all groups' rows, so a small group is judged
by the others' scatter and a large one by its own. Distances are scaled so that half of a group's rows lie
within the chi-square median of as many degrees as there are statistics with scatter of their own.

Scale: one map over texts writes vectors of a few numbers; a concentration step is two aggregations over these,
combined before their shuffles. Models have a row a group and start: they are counted, and broadcast up to
BROADCAST_ROWS; beyond it Spark splits the large partitions of their joins.

Defined results: null and empty texts have no words and fail the base rules; null languages and sources are
groups of their own; repeated rows and null ids keep their rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import bound_batches, drop, materialize, tidy

D = 4
#: Standard deviations below which a statistic's spread is not taken to lie: log mean word length, and the
#: square roots of the shares of symbols, repeated lines and repeated words.
#: Symbols and word length have what keeps the scatter invertible; repetition has more, as prose repeats by chance.
FLOOR = (0.005, 0.01, 0.05, 0.05)
#: Chi-square medians of 1 to D degrees.
MEDIANS = (0.4549364, 1.3862944, 2.3659739, 3.3566940)
CORE = 0.75
STEPS = 20
QUANTILE = 0.9999
SHRINK_MEANS, SHRINK_SCATTER = 5, 40
EXACT = 100_000
BROADCAST_ROWS = 20_000
_SYMBOLS = b"#*$%&|<>"
_SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection on the closed form for even k, exp(-x/2) * sum (x/2)^i / i!."""
    if k % 2:
        raise ValueError("k must be even")
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        x = (lo + hi) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
        lo, hi = (x, hi) if 1 - tail < p else (lo, x)
    return x


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    again = 0
    if n > 3:
        number: dict[bytes, int] = {}
        put = number.setdefault
        ids = np.fromiter((put(w, len(number)) for w in words), np.int64, n)
        bits = max(1, len(number).bit_length())
        if 3 * bits <= 63:
            keys = (ids[:-2] << 2 * bits) | (ids[1:-1] << bits) | ids[2:]
        else:
            pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
            keys = pairs[:-1] * len(number) + ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        hit = np.zeros(n, bool)
        twice = np.concatenate([order[1:][same], order[:-1][same]])
        for k in range(3):
            hit[twice + k] = True
        again = int(hit.sum())
    return n, len(text.translate(_SPACE)), symbols, dup, again


def vector(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, n_lines: int) -> list[float]:
    w = max(n_words, 1)
    return [math.log((word_chars + 5) / (w + 1)), math.sqrt(n_symbols / max(word_chars, 1)), math.sqrt(n_dup_lines / max(n_lines, 1)), math.sqrt(n_repeat_words / w)]


def base_table(docs: DataFrame) -> DataFrame:
    """doc_id, group, the base counts, base_failed and the vector x0.. of every row."""
    names = ["doc_id", "grp", *_BASE, "base_failed", *(f"x{i}" for i in range(D))]
    schema = "doc_id long, grp string, " + ", ".join(f"{n} long" for n in _BASE) + ", base_failed boolean, " + ", ".join(f"x{i} double" for i in range(D))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            counts = [base_counts(t) for t in texts]
            xs = [vector(*c, sum(1 for x in (t or "").split("\n") if x.strip())) for c, t in zip(counts, texts)]
            failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)] + [pa.array(failed, pa.bool_())] + [pa.array([x[i] for x in xs], pa.float64()) for i in range(D)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grp"), *cols], names=names)

    src = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.to_json(F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))).alias("grp"),
        F.col("text").cast("string").alias("text"),
    )
    return src.mapInArrow(tidy(run), schema)


_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_MEANS, _SCATTER, _INVERSE = [f"m{i}" for i in range(D)], [f"c{i}{j}" for i, j in _PAIRS], [f"v{i}{j}" for i, j in _PAIRS]


def _matrix(row: dict, floor: bool = True) -> np.ndarray:
    c = np.diag(np.array(FLOOR) ** 2) if floor else np.zeros((D, D))
    for (i, j), name in zip(_PAIRS, _SCATTER):
        c[i, j] += row[name] or 0.0
        if i != j:
            c[j, i] = c[i, j]
    return c


def _invert(moments: DataFrame) -> DataFrame:
    """Adds to rows of means m0.. and covariances c00.. the inverse v00.. of the floored scatter, the logarithm of its
    determinant and the number of statistics whose own scatter is above the floor."""
    kept = [f.name for f in moments.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.schema.fields)

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            full = [_matrix(r) for r in rows]
            inv = [np.linalg.inv(c) for c in full]
            cols = [pa.array([float(x[i, j]) for x in inv], pa.float64()) for i, j in _PAIRS]
            logdet = pa.array([float(np.linalg.slogdet(c)[1]) for c in full], pa.float64())
            dims = pa.array([int((np.diag(c) > 2 * np.array(FLOOR) ** 2).sum()) for c in full], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, *cols, logdet, dims], names=[*kept, *_INVERSE, "logdet", "dims"])

    return moments.mapInArrow(run, schema + ", " + ", ".join(f"{n} double" for n in _INVERSE) + ", logdet double, dims int")


def _small(df: DataFrame) -> DataFrame:
    """A table of models, marked for broadcast if it has at most BROADCAST_ROWS rows (of some 30 numbers)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _distance():
    """Squared Mahalanobis distance of x0.. from the joined model."""
    z = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(D)]
    terms = [F.col(f"v{i}{j}") * z[i] * z[j] * (1 if i == j else 2) for i in range(D) for j in range(i, D)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _starts(rows: DataFrame) -> DataFrame:
    """Rows of grp, start, means and covariances: where the concentration steps begin."""
    x = [f"x{i}" for i in range(D)]
    mid = [F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i, c in enumerate(x)]
    facts = rows.groupBy("grp").agg(*mid, *(F.avg(c).alias(f"a{i}") for i, c in enumerate(x)), *(F.covar_pop(x[i], x[j]).alias(f"s{i}{j}") for i, j in _PAIRS))
    middle = [F.col(f"p{i}")[1] for i in range(D)]
    spread = [F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) for i in range(D)]
    diagonal = lambda values: [values[i] if i == j else F.lit(0.0) for i, j in _PAIRS]
    starts = [
        (middle, diagonal(spread)),
        ([F.col(f"a{i}") for i in range(D)], [F.col(f"s{i}{j}") for i, j in _PAIRS]),
        (middle, diagonal([F.lit(1.0)] * D)),
    ]
    made = [F.struct(F.lit(k).alias("start"), *(m.alias(n) for m, n in zip(means, _MEANS)), *(c.alias(n) for c, n in zip(scatter, _SCATTER))) for k, (means, scatter) in enumerate(starts)]
    return facts.select("grp", F.explode(F.array(*made)).alias("s")).select("grp", "s.*")


def mcd(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """rows: grp and x0... The minimum-covariance-determinant estimate of each group: means m0.., covariances c00..
    of its core, logdet and dims (see _invert())."""
    spark = rows.sparkSession
    x = [f"x{i}" for i in range(D)]
    model, path = materialize(_invert(_starts(rows)), "mcd")
    best = None
    for _ in range(steps):
        far = rows.join(_small(model.select("grp", "start", *_MEANS, *_INVERSE)), "grp").select("grp", "start", *x, _distance().alias("d2"))
        edge, p1 = materialize(far.groupBy("grp", "start").agg(F.percentile_approx("d2", CORE, EXACT).alias("edge")), "mcd-edge")
        core = far.join(_small(edge), ["grp", "start"]).where("d2 <= edge")
        moments = core.groupBy("grp", "start").agg(
            *(F.avg(c).alias(n) for c, n in zip(x, _MEANS)), *(F.covar_pop(x[i], x[j]).alias(n) for (i, j), n in zip(_PAIRS, _SCATTER))
        )
        new, p2 = materialize(_invert(moments), "mcd")
        drop(spark, path)
        drop(spark, p1)
        model, path = new, p2
        now = model.agg(F.sum("logdet")).first()[0]
        if now is None or best is not None and best - now < 1e-9:
            break
        best = now
    return model.groupBy("grp").agg(*(F.min_by(n, F.struct("logdet", "start")).alias(n) for n in [*_MEANS, *_SCATTER, "logdet", "dims"]))


def fit(rows: DataFrame) -> DataFrame:
    """rows: grp and x0... Returns a model row a group: means, inverse scatter and `unit`, which divides squared
    distances."""
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"))
    own, _ = materialize(mcd(rows).drop("logdet", "dims").join(sizes, "grp"), "mcd-groups")
    # All groups' rows: means and scatter within groups, weighted by rows.
    share = F.col("rows").cast("double")
    pooled = own.agg(*((F.sum(F.col(n) * share) / F.sum(share)).alias(n) for n in [*_MEANS, *_SCATTER])).first()
    mixed = lambda n, k: ((F.col("rows") * F.col(n) + k * F.lit(pooled[n]).cast("double")) / (F.col("rows") + k)).alias(n)
    shrunk = own.select("grp", *(mixed(n, SHRINK_MEANS) for n in _MEANS), *(mixed(n, SHRINK_SCATTER) for n in _SCATTER))
    model, _ = materialize(_invert(shrunk), "mcd-models")
    model = model.select("grp", *_MEANS, *_INVERSE, "dims")
    # The core's scatter is too small for all rows: half of the rows are to lie within the median distance.
    half = rows.join(_small(model), "grp").select("grp", _distance().alias("d2")).groupBy("grp").agg(F.percentile_approx("d2", 0.5, EXACT).alias("half"))
    median = F.element_at(F.array(*(F.lit(m) for m in MEDIANS)), F.greatest(F.col("dims"), F.lit(1)))
    return model.join(half, "grp").withColumn("unit", F.greatest(F.lit(1.0), F.col("half") / median)).drop("half", "dims")


def quality_rules(docs: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, the base counts, base_failed, distance2 (null where the base rules fail) and kept for every row."""
    bound_batches(docs.sparkSession)
    table, _ = materialize(base_table(docs), "rules")
    model, _ = materialize(fit(table.where("not base_failed")), "mcd-final")
    judged = table.join(_small(model), "grp", "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance() / F.col("unit")))
    kept = ~F.col("base_failed") & (F.col("distance2").isNull() | (F.col("distance2") <= chi_square_quantile(quantile, D)))
    return judged.select("doc_id", *_BASE, "base_failed", "distance2", kept.alias("kept"))
