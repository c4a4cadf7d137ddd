"""Operator 5, token counts: prefix dynamic programming over a byte-level BPE vocabulary.

For every prefix of a text the exact number of tokens is known after one pass and kept: `prefix_deltas` holds, for
each character, by how much the count of the prefix that ends with it differs from the one before, a signed byte
each (four bytes each in a text where one doesn't fit). Truncation to a budget and the count of any prefix are
answered from these, without the vocabulary. Counts equal those of the tokenizers library for the same
file (no special tokens are added; special strings inside a text are one token).

Scale: a map over documents; no shuffle. Each worker loads the vocabulary once and remembers the counts
of the stretches between spaces that it has met (bounded, then emptied).

Defined results: null counts as an empty text (0 bytes, 0 tokens, not over the limit, no deltas); repeated rows
give repeated results; a null doc_id is kept; other columns of the input are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.bpe import MergeLattice, byte_symbols
from quillstream.llm.common import bound_batches, tidy

_BY_FILE: dict[str, "PrefixCounter"] = {}


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes."""

    def __init__(self, path: str, keep: int = 1_200_000):
        spec = json.load(open(path, encoding="utf-8"))
        ranks = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ", 1)
            ranks.setdefault((a, b), i)
        symbols = byte_symbols()
        self.table = dict(enumerate(symbols))
        self.lattice = MergeLattice(list(spec["model"]["vocab"]), lambda a, b: ranks.get((a, b)))
        special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_mark = min((s[:2] for s in special), default=None)
        import public_tokenizers

        self.words = regex.compile(public_tokenizers.PATTERN)
        #: A space between two characters that aren't white space always starts a word.
        self.cut = regex.compile(r"(?<=\S)(?= \S)")
        self.gaps = regex.compile(r"\s\s")
        self.space = regex.compile(r"\s+")
        self.keep = keep
        self.seen: dict[str, tuple[int, bytes | None]] = {}

    def symbols(self, text: str) -> str:
        return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)

    def _stretch(self, text: str) -> int:
        return sum(self.lattice.prefix_counts(self.symbols(w))[-1] for w in self.words.findall(text))

    def _parts(self, text: str) -> list[str]:
        """A text cut where a word starts in the text and in each of its prefixes."""
        if self.gaps.search(text):
            return self.cut.split(text)
        parts = text.split(" ")
        parts[1:] = [" " + p for p in parts[1:]]
        return parts

    def _plain(self, text: str) -> tuple[int, tuple[bytes, ...] | None]:
        """Token count and the deltas of the parts (None where one doesn't fit a byte)."""
        seen, got = self.seen, []
        for p in self._parts(text):
            x = seen.get(p)
            if x is None:
                x = self._part(p)
                if len(p) < 200:
                    if len(seen) >= self.keep:
                        seen.clear()
                    seen[p] = x
            got.append(x)
        counts, deltas = zip(*got)
        return sum(counts), None if None in deltas else deltas

    def _part(self, p: str) -> tuple[int, bytes | None]:
        """Token count and deltas of one part. Letters after a space or none are one word, and so is each of their
        prefixes; a full stop or comma after them is one more."""
        letters = p[1:] if p[:1] == " " else p
        if letters.isascii():
            if letters.isalpha():
                counts = self.lattice.prefix_counts(self.symbols(p))
                return counts[-1], packed(counts)
            if letters[-1:] in (".", ",") and letters[:-1].isalpha():
                n, deltas = self.seen.get(p[:-1]) or self._part(p[:-1])
                return n + 1, None if deltas is None else deltas + b"\1"
        counts = self._prefixes(p)
        return counts[-1], packed(counts)

    def measure(self, text: str | None) -> tuple[int, bytes]:
        """Token count and deltas of a text."""
        if not text:
            return 0, b""
        if self.special is None or self.special_mark not in text:
            total, parts = self._plain(text)
            if parts is not None:
                return total, b"".join(parts)
        counts = self.prefix_counts(text)
        short = packed(counts)
        return counts[-1], np.diff(np.array(counts, "<i4")).tobytes() if short is None else short

    def count(self, text: str | None) -> int:
        return self.measure(text)[0]

    def prefix_counts(self, text: str) -> list[int]:
        """For each prefix of 0..len(text) characters: the tokens of that prefix, encoded on its own.

        White space at a prefix's end, an unfinished special string or an unfinished contraction is
        counted as the library would count that prefix alone."""
        out = [0]
        spans = [m.span() for m in self.special.finditer(text)] if self.special else []
        base, at = 0, 0
        for a, b in [*spans, (len(text), len(text))]:
            out += [base + n for n in self._prefixes(text[at:a])[1:]]
            if b > a:
                out += [base + n for n in self._prefixes(text[at:b])[a - at + 1 : -1]]
                base = base + self._plain(text[at:a])[0] + 1 if a > at else base + 1
                out.append(base)
            at = b
        return out

    def _prefixes(self, text: str) -> list[int]:
        counts, done = [0] * (len(text) + 1), 0
        for m in self.words.finditer(text):
            s, e = m.span()
            by_byte = self.lattice.prefix_counts(self.symbols(text[s:e]))
            at = 0
            for i in range(s, e):
                at += len(text[i].encode("utf-8", "surrogatepass"))
                counts[i + 1] = done + by_byte[at]
            if text[s] == "'":  # a prefix that ends inside a contraction has no contraction
                for i in range(s + 1, e):
                    counts[i] = done + self._stretch(text[s:i])
            done += by_byte[-1]
        for m in self.space.finditer(text):  # white space at a prefix's end is one word
            s, e = m.span()
            by_byte, at = self.lattice.prefix_counts(self.symbols(text[s:e])), 0
            for i in range(s, e):
                at += len(text[i].encode())
                counts[i + 1] = counts[s] + by_byte[at]
        return counts


def packed(counts: list[int]) -> bytes | None:
    """The differences of neighbouring counts, a signed byte each; None where one doesn't fit."""
    steps = [y - x for x, y in zip(counts, counts[1:])]
    if steps and (max(steps) > 127 or min(steps) < -128):
        return None
    return bytes(d & 255 for d in steps)


def counts_of(deltas: bytes, n_chars: int) -> np.ndarray:
    """The token count of every prefix of 0..n_chars characters."""
    steps = np.frombuffer(deltas, np.int8 if len(deltas) == n_chars else "<i4")
    if len(steps) != n_chars:
        raise ValueError("the deltas belong to another text")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def longest_prefix(deltas: bytes, n_chars: int, budget: int) -> int:
    """The characters of the longest prefix of at most `budget` tokens (none for a negative budget)."""
    within = np.flatnonzero(counts_of(deltas, n_chars) <= budget)
    return int(within[-1]) if len(within) else 0


def counter(path: str) -> PrefixCounter:
    if path not in _BY_FILE:
        _BY_FILE[path] = PrefixCounter(path)
    return _BY_FILE[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_chars and prefix_deltas of every row of docs,
    and text where asked for."""
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chars long, prefix_deltas binary" + ", text string" * keep_text
    names = [f.split()[0] for f in schema.split(", ")]
    bound_batches(docs.sparkSession)

    def run(batches):
        c = counter(vocabulary)
        for b in batches:
            texts = b.column("text").to_pylist()
            got = [c.measure(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            cols = [
                b.column("doc_id"), pa.array(size, pa.int64()), pa.array([n for n, _ in got], pa.int64()), pa.array([n > limit for n, _ in got], pa.bool_()),
                pa.array([len(t or "") for t in texts], pa.int64()), pa.array([d for _, d in got], pa.binary()), b.column("text"),
            ]
            yield pa.RecordBatch.from_arrays(cols[: len(names)], names=names)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(tidy(run), schema)


def prefix_tokens(counted: DataFrame, n_chars) -> DataFrame:
    """doc_id and the token count of each text's prefix of n_chars (a column or number; cut to the text's
    length), from token_counts() alone."""

    @F.arrow_udf("long")
    def at(deltas: pa.Array, size: pa.Array, want: pa.Array) -> pa.Array:
        rows = zip(deltas.to_pylist(), size.to_pylist(), want.to_pylist())
        return pa.array([None if k is None else int(counts_of(d, n)[min(max(k, 0), n)]) for d, n, k in rows], pa.int64())

    want = n_chars if isinstance(n_chars, Column) else F.lit(n_chars)
    return counted.select("doc_id", at("prefix_deltas", "n_chars", want.cast("long")).alias("n_tokens"))


def truncations(counted: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_chars and, where token_counts() kept it, text of the longest prefix of each text that fits a token
    budget; nothing is encoded again."""

    @F.arrow_udf("long")
    def cut(deltas: pa.Array, size: pa.Array) -> pa.Array:
        return pa.array([longest_prefix(d, n, budget) for d, n in zip(deltas.to_pylist(), size.to_pylist())], pa.int64())

    out = counted.select("doc_id", cut("prefix_deltas", "n_chars").alias("n_chars"), *(["text"] if "text" in counted.columns else []))
    if "text" in out.columns:
        out = out.withColumn("text", F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.col("n_chars").cast("int")))
    return out
