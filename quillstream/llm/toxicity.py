"""Operator 9, toxicity by weak supervision.

Voters: lexicons and patterns, each voting toxic, clean or nothing on a text. Besides fixed voters (insults in four
languages, insults with emphasis, phrases of address) lexicons of words and of word beginnings are induced from the
rows that may be learnt from and dealt into several voters each. A generative label model, fitted to the votes by
expectation-maximisation, estimates each voter's rates of votes in either class. Voters whose votes agree beyond
what the classes explain are correlated: they form groups, and the model has a table of a group's joint votes in
place of a product of rates. Its posteriors are the labels on which a logistic classifier over words and word
beginnings is trained; only features that go with the posteriors are kept, so long clean texts gather no noise.

Labels, language, source and doc_id are never inputs of a score. Learning uses at most `LEARN_ROWS` labelled
rows, chosen by a hash of their id.

Scale: learning broadcasts the bounded sample's ids and reads texts once; scoring is a map whose model is a
table of a few thousand features.

Defined results: null and empty texts have no features and get the classifier's base score; without labels of
both kinds every score is the smoothed share of toxic labels; repeated rows and null ids keep their rows;
other columns are ignored (score) or kept (keep_clean).
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import bound_batches, crc_mod, keep_rows, labelled_sample, learning_rows, tidy

CUT = 0.7
LEARN_ROWS = 6_000
HELD_MOD, HELD_REST = 3, 1
MAX_FEATURES = 4_000
#: Insults and contempt in English, German, French and Spanish, a lexicon each.
LEXICONS = [
    [
        "idiot", "moron", "loser", "scum", "trash", "pathetic", "stupid", "worthless", "disgusting", "clown", "imbecile", "dumb", "fool", "filth", "garbage", "vermin",
        "jerk", "creep", "coward", "parasite", "pig", "rat", "ugly", "hate",
    ],
    ["dummkopf", "abschaum", "trottel", "versager", "ekelhaft", "widerlich", "erbärmlich", "wertlos", "blödmann", "schwachkopf", "ungeziefer", "feigling"],
    ["imbécile", "crétin", "ordure", "racaille", "minable", "pourriture", "dégoûtant", "abruti", "débile", "lâche", "pitoyable", "salaud"],
    ["imbécil", "estúpido", "basura", "escoria", "patético", "asqueroso", "inútil", "cobarde", "payaso", "despreciable", "miserable", "cretino"],
]
INSULTS = [w for words in LEXICONS for w in words]
_ANY = "(?:" + "|".join(INSULTS) + r")\b"
#: Phrases of address in the four languages, before an insult.
ADDRESS = re.compile(
    r"\b(?:(?:you|they|he|she) (?:are|is)(?: \w+)?|(?:du|ihr|er|sie) (?:bist|seid|ist|sind)(?: \w+)?|(?:tu|vous|il|elle) (?:es|êtes|est)(?: \w+)?|(?:eres|es|sois|son)(?: \w+)?) " + _ANY
)
SHOUT = re.compile(r"\b" + _ANY + r"\s*!", re.I)
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
VOTERS_EACH = 6
#: Steps of the classifier's training, and their rate.
ROUNDS, RATE = 300, 0.3
#: Voters of one group, at most, and the correlation beyond the classes' that makes two voters a group; larger groups take up rows that clean texts share.
GROUP, LINKED = 2, 0.2
#: Where expectation-maximisation starts: the probability of class 1 without a vote for it, with one and with more.
START = (0.02, 0.2, 0.9)
#: Rows that a group's table takes from the product of its voters' rates.
SMOOTH = 3.0


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    """A word and its beginnings (marked, as they are not words)."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def _likeness(text: str | None):
    """Equal for copies that differ in few words: the three least hashes of a text's longer words."""
    held = sorted(zlib.crc32(w.encode()) for w in words_of(text) if len(w) > 6)
    return tuple(held[:3]) if len(held) >= 12 else text


class Bags:
    """Which features each of a sample's texts holds: aligned arrays of rows and feature numbers."""

    def __init__(self, texts: list[str | None]):
        number: dict[str, int] = {}
        put = number.setdefault
        words: dict[str, np.ndarray] = {}
        keys = []
        for r, t in enumerate(texts):
            parts = []
            for w in words_of(t):
                f = words.get(w)
                if f is None:
                    f = words[w] = np.array([put(x, len(number)) for x in features_of(w)], np.int64)
                parts.append(f)
            if parts:
                keys.append(np.unique(np.concatenate(parts)) + (r << 32))
        all_ = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.n, self.names = len(texts), list(number)
        self.row, self.feature = all_ >> 32, all_ & 0xFFFFFFFF

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """For each feature, the sum of the weights of the rows that hold it."""
        return np.bincount(self.feature, weights[self.row], len(self.names))

    def holds(self, voter_of: np.ndarray, voters: int) -> np.ndarray:
        """Row by voter: whether the row holds a feature of that voter (-1: of none)."""
        v = voter_of[self.feature]
        out = np.zeros((self.n, voters), bool)
        out[self.row[v >= 0], v[v >= 0]] = True
        return out


def least_rows(total: float) -> float:
    """In how many toxic rows a feature must occur: a hundredth of them, five at least."""
    return max(5.0, 0.01 * total)


def votes(texts: list[str | None], bags: Bags, y: np.ndarray) -> np.ndarray:
    """A column a voter: 1 toxic, -1 clean, 0 nothing. The induced lexicons are words and beginnings that
    toxic rows hold much oftener than clean ones."""
    pos, neg = bags.counts(y.astype(np.float64)), bags.counts(1.0 - y)
    n1, n0 = y.sum() + 1, (1 - y).sum() + 1
    strong = np.flatnonzero((pos >= least_rows(y.sum())) & (pos / n1 > 12 * (neg + 0.5) / n0))
    voter_of = np.full(len(bags.names), -1, np.int64)
    for f in strong:
        name = bags.names[f]
        voter_of[f] = VOTERS_EACH * name.endswith("*") + zlib.crc32(name.encode()) % VOTERS_EACH
    induced = bags.holds(voter_of, 2 * VOTERS_EACH)
    place = {w: 3 * at + k % 3 for at, words in enumerate(LEXICONS) for k, w in enumerate(words)}
    fixed = bags.holds(np.array([place.get(n, -1) for n in bags.names] or [-1], np.int64), 3 * len(LEXICONS))
    found = [[bool(ADDRESS.search((t or "").lower())), bool(SHOUT.search(t or ""))] for t in texts]
    toxic = np.concatenate([induced, fixed, np.array(found, bool).reshape(len(texts), 2)], axis=1)
    toxic = toxic[:, toxic.any(axis=0)]
    return np.concatenate([toxic.astype(np.int8), -(~toxic.any(axis=1)).astype(np.int8)[:, None]], axis=1)


class LabelModel:
    """P(votes, class) = P(class) * product over groups of voters of P(the group's votes | class), fitted by
    expectation-maximisation. `groups` lists voters; `tables[class][group]` has the probability of each joint vote, a
    number in base 3 with a digit (vote + 1) a voter, the first one lowest."""

    def __init__(self, prior: float, rounds: int = 60):
        self.prior, self.rounds = prior, rounds

    def fit(self, v: np.ndarray) -> "LabelModel":
        q = np.choose(np.minimum((v == 1).sum(axis=1), 2), START)
        self.groups = [[k] for k in range(v.shape[1])]
        for step in range(self.rounds):
            if step in (5, 15):
                self.groups = self._groups(v, q)
            self.tables = [self._tables(v, w) for w in (1 - q, q)]
            new = self.posterior(v)
            done = np.abs(new - q).max() < 1e-6 and step > 16
            q = new
            if done:
                break
        return self

    @staticmethod
    def _groups(v: np.ndarray, q: np.ndarray) -> list[list[int]]:
        """Voters joined, the most correlated first, into groups of at most GROUP."""
        x = v.astype(np.float64)
        m1, m0 = q @ x / (q.sum() + 1e-9), (1 - q) @ x / ((1 - q).sum() + 1e-9)
        rest = x - q[:, None] * m1 - (1 - q)[:, None] * m0
        c = rest.T @ rest / max(len(x), 1)
        d = np.sqrt(np.maximum(np.diag(c), 1e-9))
        c = c / d[:, None] / d[None, :]
        of = {k: [k] for k in range(v.shape[1])}
        pairs = sorted((-abs(c[i, j]), i, j) for i in range(len(c)) for j in range(i) if abs(c[i, j]) > LINKED)
        for _, i, j in pairs:
            if of[i] is not of[j] and len(of[i]) + len(of[j]) <= GROUP:
                joined = sorted(of[i] + of[j])
                for k in joined:
                    of[k] = joined
        return [g for k, g in sorted(of.items()) if g[0] == k]

    @staticmethod
    def _codes(v: np.ndarray, group: list[int]) -> np.ndarray:
        return sum((v[:, k].astype(np.int64) + 1) * 3**at for at, k in enumerate(group))

    def _tables(self, v: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        total, out = weights.sum(), []
        for g in self.groups:
            own = np.ones(1)
            for k in reversed(g):
                rates = (np.bincount(v[:, k].astype(np.int64) + 1, weights, 3) + 0.1) / (total + 0.3)
                own = (own[:, None] * rates).ravel()
            out.append((np.bincount(self._codes(v, g), weights, len(own)) + SMOOTH * own) / (total + SMOOTH) if len(g) > 1 else own)
        return out

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The probability of class 1 given the votes of each row."""
        e = np.full(len(v), math.log(self.prior / (1 - self.prior)))
        for g, p0, p1 in zip(self.groups, *self.tables):
            e += np.log(p1 / p0)[self._codes(v, g)]
        return 1 / (1 + np.exp(-np.clip(e, -30, 30)))


class ToxicityModel:
    """Weights of word and beginning features; score() of texts."""

    def __init__(self, weights: dict[str, float], bias: float, flat: float | None = None):
        self.weights, self.bias, self.flat = weights, bias, flat
        self.known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    @classmethod
    def fit(cls, texts: list[str | None], y: np.ndarray) -> "ToxicityModel":
        if not len(y) or y.min() == y.max():
            return cls({}, 0.0, (float(y.sum()) + 1) / (len(y) + 2))
        # Exact and near copies of one text would count as many witnesses.
        first = {_likeness(t): r for r, t in reversed(list(enumerate(texts)))}
        at = sorted(first.values())
        texts, y = [texts[r] for r in at], y[at]
        bags = Bags(texts)
        v = votes(texts, bags, y)
        soft = LabelModel(min(max(float(y.mean()), 0.01), 0.99)).fit(v).posterior(v)
        chosen = cls._choose(bags, soft)
        place = np.full(len(bags.names), -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        cols = place[bags.feature]
        rows, cols = bags.row[cols >= 0], cols[cols >= 0]
        chosen = [bags.names[f] for f in chosen]
        w, bias = np.zeros(len(chosen)), math.log(soft.mean() / (1 - soft.mean()))
        hw, hb = np.full(len(chosen), 1e-8), 1e-8
        for _ in range(ROUNDS):  # full-batch AdaGrad on logistic loss against the posteriors
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, w[cols], len(soft)), -30, 30)))
            g = (p - soft) / len(soft)
            gw, gb = np.bincount(cols, g[rows], len(chosen)) + 2e-5 * w, g.sum()
            hw += gw * gw
            hb += gb * gb
            w -= RATE * gw / np.sqrt(hw)
            bias -= 0.1 * gb / math.sqrt(hb)
        return cls({f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-4}, float(bias))

    @staticmethod
    def _choose(bags: Bags, soft: np.ndarray) -> list[int]:
        """The features that go with the posteriors, strongest first."""
        a, n, base = bags.counts(soft), bags.counts(np.ones(len(soft))), float(soft.mean())
        good = np.flatnonzero((a >= least_rows(soft.sum())) & (a / n > max(3 * base, 0.6)))
        rated = sorted((-a[f] * math.log(a[f] / n[f] / base), bags.names[f], int(f)) for f in good)
        return [f for _, _, f in rated[:MAX_FEATURES]]

    def _of(self, word: str) -> tuple[str, ...]:
        if len(self.known) > 200_000:
            self.known.clear()
        got = self.known[word] = tuple(f for f in features_of(word) if f in self.weights)
        return got

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(texts), self.flat)
        known, out = self.known, np.full(len(texts), self.bias)
        for r, t in enumerate(texts):
            held: set[str] = set()
            for w in words_of(t):
                got = known.get(w)
                if got is None:
                    got = self._of(w)
                if got:
                    held.update(got)
            out[r] += sum(self.weights[f] for f in held)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, limit: int = LEARN_ROWS) -> ToxicityModel:
    """Fit on labelled documents whose crc32(doc_id) mod 3 is not 1. The driver holds the words of the
    sample's rows, not their texts' length."""
    bound_batches(docs.sparkSession)
    sample = labelled_sample(labels, "toxic", HELD_MOD, HELD_REST, limit)
    if not sample:
        return ToxicityModel.fit([], np.zeros(0, np.int64))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            short = []
            for t in texts:  # distinct words, and a match of each pattern, as votes() looks for them
                found = (ADDRESS.search((t or "").lower()), SHOUT.search(t or ""))
                short.append(" ".join([*sorted(words_of(t)), *(m.group(0) for m in found if m)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(short, pa.string())], names=["doc_id", "y", "text"])

    rows = learning_rows(docs, sample).select("doc_id", "y", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, y int, text string").orderBy("doc_id").collect()
    return ToxicityModel.fit([r.text for r in rows], np.array([r.y for r in rows], np.int64))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            s = model.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", HELD_MOD) == HELD_REST).alias("held_out"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted to be toxic."""
    model = learn(docs, labels)
    return keep_rows(docs, lambda texts: model.score(texts) < CUT)
