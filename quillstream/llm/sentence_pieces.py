"""Operator 4, SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary merges pairs (a BPE model with byte fallback), so the lattice of a text has its tokens as
states, the weight minus one on a step from a token to one that may follow it (see bpe.py) and minus
infinity on any other. Exactly one path crosses the lattice: the library's encoding.

A giant text is split into chunks. A chunk's transfer matrix holds, for each token that may straddle its left
border and each that may straddle its right border, the best weight of a path between them; matrices combine
by (max, +), which is associative. Once the states at the borders are known each chunk is traced back on its
own. A border between characters that no token holds side by side (before a space, for one) has the single
state "no token straddles it", so its row of the matrix is all there is; borders are put there where one is
near, and elsewhere where there is none. A chunk between two such borders is traced back when it is scanned, the
others once their states are known. Inside a chunk the same borders cut the lattice into words whose paths are
remembered (bounded; words are forgotten when a task ends, the table of pairs stays, as workers outlive tasks and later stages need the memory).

Scale: texts of at most CHUNK characters are encoded where they are read. Only chunks of longer ones are
shuffled, dealt by text and chunk; combining takes a few numbers a chunk.

Defined results: null counts as an empty text (no tokens); a null doc_id and repeated rows are kept; other
columns are ignored; an empty table gives an empty result. Decoding gives the text back with U+2581 as a
space (the vocabulary's own stand-in); `round_trip` says so for each row.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.bpe import MergeLattice
from quillstream.llm.common import bound_batches, materialize, tidy

CHUNK = 32_768
#: How far a border may move to find characters that no token holds side by side.
REACH = 2_048
SPACE = "▁"
NO_TOKEN = (-1, 0)
_BY_FILE: dict[str, "Pieces"] = {}

State = tuple[int, int]  # a token, and how many of its characters lie beyond the border


class Pieces:
    def __init__(self, path: str, keep: int = 150_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        scores = {p: -sp.get_score(i) for i, p in enumerate(names) if plain[i]}
        self.size = n
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        # Characters that only stand inside tokens are symbols too; alone they fall back to bytes.
        inner = sorted({c for p in scores for c in p} - scores.keys())
        self.lattice = MergeLattice([p if ok else "" for p, ok in zip(names, plain)] + inner, lambda a, b: scores.get(a + b))
        self.symbols = {c for p in scores for c in p}
        self.beside = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if not plain[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.line_alone = "\n" not in self.symbols
        line = "\n" if self.line_alone else ""
        self.starts = re.compile(f"[{SPACE}{line}]")
        self.words = re.compile(rf"{SPACE}+[^{SPACE}{line}]*" + (rf"|\n[^{SPACE}\n]*" if line else ""))
        letter = re.compile(r"[^\W\d_]")
        apart = all(a == SPACE or bool(letter.match(a)) == bool(letter.match(b)) for a, b in self.beside)
        self.runs = re.compile(rf"{SPACE}*(?:[^\W\d_]+|[\W\d_]+)" if apart else ".+", re.S)
        self.short: dict[str, bytes] = {}
        #: Remembered words, ids as 32-bit integers. Where there are `keep` they become the older ones, whose
        #: words come back when they are met again; the older ones before are forgotten.
        self.keep = keep
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def free(self, a: str, b: str) -> bool:
        """Whether no token holds characters a and b side by side."""
        return a + b not in self.beside

    def ids(self, tokens: list[int]) -> list[int]:
        if max(tokens, default=0) < self.size:
            return tokens
        out: list[int] = []
        for t in tokens:
            if t < self.size:
                out.append(t)
            else:
                out += [self.byte[x] for x in self.lattice.pieces[t].encode("utf-8", "surrogatepass")]
        return out

    def stretch(self, key: str) -> bytes:
        """Ids of a word, packed. A key with a line feed first (where that is no symbol) stands for itself, any
        other for a space and itself."""
        packed = self.older.get(key)
        if packed is None:
            packed = self.literal(key if self.line_alone and key[:1] == "\n" else SPACE + key)
        if len(key) < 100:
            if len(self.seen) >= self.keep:
                self.older, self.seen = self.seen, {}
            self.seen[key] = packed
        return packed

    def literal(self, s: str) -> bytes:
        """Ids of a stretch between free borders, packed: cut where letters meet other characters, and at every
        free border where a run holds a character that is no symbol."""
        out, runs = [], self.runs.findall(s)
        for run in runs:
            if len(runs) > 1 and run[0] == SPACE and (got := self.seen.get(run[1:]) or self.older.get(run[1:])):
                out.append(got)
            elif len(run) == 1 or self.symbols.issuperset(run):
                out.append(self.run(run))
            else:
                at = 0
                for e in [*(i for i in range(1, len(run)) if self.free(run[i - 1], run[i])), len(run)]:
                    out.append(self.run(run[at:e]))
                    at = e
        return out[0] if len(out) == 1 else b"".join(out)

    def run(self, s: str) -> bytes:
        """Ids of a run of symbols or of one character, packed; short ones are remembered."""
        if len(s) > 4:
            return self.part(s)
        got = self.short.get(s)
        if got is None:
            if len(self.short) >= self.keep // 8:
                self.short.clear()
            got = self.short[s] = self.part(s)
        return got

    def part(self, s: str) -> bytes:
        """Ids of symbols, or of one character, between free borders, packed."""
        one = self.lattice.number.get(s, self.size)
        if one < self.size and self.lattice.is_token(one):
            return array("i", (one,)).tobytes()
        if len(s) == 1 and s not in self.symbols:
            return array("i", [self.byte[x] for x in s.encode("utf-8", "surrogatepass")]).tobytes()
        return array("i", self.ids(self.lattice.encode(s))).tobytes()

    def between(self, s: str) -> array:
        """Ids of a stretch of normalised text between free borders."""
        first = self.starts.search(s)
        at = first.start() if first else len(s)
        seen, stretch = self.seen, self.stretch
        keys = [w[1:] if w[0] == SPACE else w for w in self.words.findall(s, at)]
        return array("i", b"".join([self.literal(s[:at]) if at else b"", *[seen.get(k) or stretch(k) for k in keys]]))

    def whole(self, text: str) -> array:
        """Ids of a text that is not empty."""
        if "  " in text or SPACE in text or text[0] == " ":
            return self.between(self.normal(text))
        if self.line_alone:
            text = text.replace("\n", " \n")
        seen, stretch = self.seen, self.stretch
        return array("i", b"".join([seen.get(k) or stretch(k) for k in text.split(" ")]))

    # Chunks

    def borders(self, s: str, chunk: int = CHUNK, reach: int = REACH) -> list[tuple[int, bool]]:
        """(position, free) of each border of a normalised text, ends included."""
        out, at = [(0, True)], 0
        while len(s) - at > chunk + reach:
            want = at + chunk
            for p in range(want, want - max(reach, 1), -1):
                if self.free(s[p - 1], s[p]):
                    out.append((p, True))
                    break
            else:
                out.append((want, False))
            at = out[-1][0]
        return [*out, (len(s), True)]

    def chunks(self, text: str, chunk: int = CHUNK, reach: int = REACH) -> list[dict]:
        """A text's chunks with what they need of their neighbours."""
        s, wide = self.normal(text), self.lattice.longest - 1
        b = self.borders(s, chunk, reach)
        return [
            {"before": "" if lf else s[max(0, x - wide - 1) : x], "body": s[x:y], "after": "" if rf else s[y : y + wide], "left_free": lf, "right_free": rf}
            for (x, lf), (y, rf) in zip(b, b[1:])
        ]

    def _entries(self, c: dict) -> list[State]:
        if c["left_free"]:
            return [NO_TOKEN]
        near, cut = c["before"] + c["body"][: self.lattice.longest], len(c["before"])
        found = [(i, e + 1 - cut) for e, (size, i) in self.lattice.ends.iter(near) if e + 1 - size < cut <= e + 1 and self.lattice.is_token(i)]
        return found

    def _paths(self, c: dict, entry: State):
        """The scan from an entry state, with positions from the border on."""
        token, beyond = entry
        s = c["body"] + c["after"]
        out, counts = self.lattice.scan(s[beyond:], token)
        return s, beyond, out, counts

    def _parts(self, c: dict) -> list[dict]:
        """A chunk as up to three: to its first free border inside, between free borders, from its last."""
        s = c["body"]
        n = len(s)
        lo = 0 if c["left_free"] else next((p for p in range(1, n) if self.free(s[p - 1], s[p])), None)
        hi = n if c["right_free"] else next((p for p in range(n - 1, 0, -1) if self.free(s[p - 1], s[p])), None)
        if lo is None or hi is None:
            return [c]
        head = [{"before": c["before"], "body": s[:lo], "after": "", "left_free": False, "right_free": True}] if lo else []
        mid = [{"before": "", "body": s[lo:hi], "after": "", "left_free": True, "right_free": True}] if lo < hi else []
        tail = [{"before": "", "body": s[hi:], "after": c["after"], "left_free": True, "right_free": False}] if hi < n else []
        return [*head, *mid, *tail]

    def transfer(self, c: dict) -> list[tuple[State, State, int]]:
        """The finite entries of a chunk's transfer matrix: entry state, exit state, weight."""
        parts = self._parts(c)
        got = self._transfer(parts[0])
        for p in parts[1:]:
            got = combine(got, self._transfer(p))
        return got

    def _transfer(self, c: dict) -> list[tuple[State, State, int]]:
        n = len(c["body"])
        if c["left_free"] and c["right_free"]:
            return [(NO_TOKEN, NO_TOKEN, -len(self.between(c["body"])))]
        got = []
        for entry in self._entries(c):
            s, beyond, out, counts = self._paths(c, entry)
            for e in range(n, n + 1 if c["right_free"] else len(s) + 1):
                t = out[e - beyond] if e >= beyond else None
                if t is not None and e - (len(self.lattice.pieces[t]) if t >= 0 else 0) < n + (t < 0):
                    got.append((entry, NO_TOKEN if c["right_free"] else (t, e - n), -counts[e - beyond]))
        return got

    def crossed(self, c: dict) -> tuple[list[tuple[State, State, int]], array | None]:
        """A chunk's transfer matrix, and its ids where both borders are free: one state at each leaves no choice,
        so the path found by the scan is traced at once."""
        if c["left_free"] and c["right_free"]:
            ids = self.between(c["body"])
            return [(NO_TOKEN, NO_TOKEN, -len(ids))], ids
        return self.transfer(c), None

    def trace(self, c: dict, entry: State, exit_: State) -> list[int]:
        """Ids of the tokens that start in a chunk, given the states at its borders."""
        parts = self._parts(c)
        states = [entry, *[NO_TOKEN] * (len(parts) - 1), exit_]
        out: list[int] = []
        for p, a, z in zip(parts, states, states[1:]):
            if p["left_free"] and p["right_free"]:
                out += self.between(p["body"])
            else:
                s, beyond, last, _ = self._paths(p, a)
                out += self.ids(self.lattice.path(s[beyond:], last, len(p["body"]) + z[1] - beyond))
        return out

    def codes(self, text: str | None, chunk: int = CHUNK, reach: int = REACH) -> array:
        if not text:
            return array("i")
        if len(text) <= chunk:
            return self.whole(text)
        parts = self.chunks(text, chunk, reach)
        crossed = [self.crossed(c) for c in parts]
        states = border_states([m for m, _ in crossed])
        out = array("i")
        for c, (_, ids), a, b in zip(parts, crossed, states, states[1:]):
            out.extend(self.trace(c, a, b) if ids is None else ids)
        return out

    def encode(self, text: str | None, chunk: int = CHUNK, reach: int = REACH) -> list[int]:
        return self.codes(text, chunk, reach).tolist()

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def combine(a, b):
    """Max-plus product of two transfer matrices."""
    by_entry: dict[State, list[tuple[State, int]]] = {}
    for entry, exit_, w in b:
        by_entry.setdefault(entry, []).append((exit_, w))
    best: dict[tuple[State, State], int] = {}
    for entry, mid, w in a:
        for exit_, v in by_entry.get(mid, ()):
            if best.get((entry, exit_), w + v - 1) < w + v:
                best[entry, exit_] = w + v
    return [(x, y, w) for (x, y), w in best.items()]


def border_states(matrices) -> list[State]:
    """The state at each border of the best path from the first to the last (both NO_TOKEN): products from
    the left, halved recursively as the product is associative."""

    def split(lo: int, hi: int, entry: State, exit_: State, out: list):
        if hi - lo == 1:
            return
        mid = (lo + hi) // 2
        left = {m: w for e, m, w in products[lo, mid] if e == entry}
        w, m = max((left[m] + w, m) for m, x, w in products[mid, hi] if x == exit_ and m in left)
        out[mid] = m
        split(lo, mid, entry, m, out)
        split(mid, hi, m, exit_, out)

    products: dict[tuple[int, int], list] = {}

    def build(lo: int, hi: int):
        if hi - lo == 1:
            products[lo, hi] = matrices[lo]
        else:
            mid = (lo + hi) // 2
            products[lo, hi] = combine(build(lo, mid), build(mid, hi))
        return products[lo, hi]

    out: list = [NO_TOKEN] * (len(matrices) + 1)
    if matrices:
        build(0, len(matrices))
        split(0, len(matrices), NO_TOKEN, NO_TOKEN, out)
    return out


def pieces(path: str) -> Pieces:
    if path not in _BY_FILE:
        _BY_FILE[path] = Pieces(path)
    return _BY_FILE[path]


def _forget() -> None:
    for p in _BY_FILE.values():
        p.seen, p.older, p.short = {}, {}, {}


_ENCODED = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"
_CHUNKS = "row long, chunk int, free boolean, part string"


def _out(p: Pieces, doc_ids: pa.Array, texts, ids) -> pa.RecordBatch:
    """ids: an array or list of integers a text."""
    flat = np.frombuffer(b"".join([array("i", i).tobytes() for i in ids]), np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))
    same = [p.decode(i) == (t or "").replace(SPACE, " ") for t, i in zip(texts, ids)]
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(list(map(len, ids)), pa.int64()), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"]
    )


def encode(docs: DataFrame, vocabulary: str, chunk: int = CHUNK, reach: int = REACH) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every row of docs."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def small(batches):
        p = pieces(vocabulary)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield _out(p, b.column("doc_id"), texts, [p.codes(t, chunk, reach) for t in texts])

    def cut(batches):
        p = pieces(vocabulary)
        for b in batches:
            for row, t in zip(*(b.column(c).to_pylist() for c in ("row", "text"))):
                parts = p.chunks(t, chunk, reach)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int32()), pa.array([c["left_free"] and c["right_free"] for c in some]), pa.array([json.dumps(c) for c in some])],
                        names=["row", "chunk", "free", "part"],
                    )

    def transfers(batches):
        p = pieces(vocabulary)
        for b in batches:
            got = [p.crossed(json.loads(x)) for x in b.column("part").to_pylist()]
            ids = pa.array([None if i is None else np.frombuffer(i, np.int32) for _, i in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk"), pa.array([json.dumps(m) for m, _ in got]), ids], names=["row", "chunk", "matrix", "ids"])

    def joined(key, table):
        rows = sorted(zip(table["chunk"].to_pylist(), table["matrix"].to_pylist()))
        states = border_states([[((*a,), (*b,), w) for a, b, w in json.loads(m)] for _, m in rows])
        at = [json.dumps([a, b]) for a, b in zip(states, states[1:])]
        return pa.table({"row": pa.array([key[0].as_py()] * len(rows), pa.int64()), "chunk": pa.array([c for c, _ in rows], pa.int32()), "states": pa.array(at)})

    def traced(batches):
        p = pieces(vocabulary)
        for b in batches:
            ids = []
            for part, st in zip(b.column("part").to_pylist(), b.column("states").to_pylist()):
                a, z = json.loads(st)
                ids.append(p.trace(json.loads(part), (*a,), (*z,)))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk"), pa.array(ids, pa.list_(pa.int32()))], names=["row", "chunk", "ids"])

    def finish(batches):
        p = pieces(vocabulary)
        for b in batches:
            yield _out(p, b.column("doc_id"), b.column("text").to_pylist(), b.column("ids").to_pylist())

    short = src.where(F.length(F.coalesce("text", F.lit(""))) <= chunk).mapInArrow(tidy(small, _forget), _ENCODED)
    long = src.where(F.length("text") > chunk)
    # Numbered once and written, so that a row keeps its number when a task runs again.
    long, _ = materialize(long.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "giants")
    if not long.head(1):
        return short
    parts, _ = materialize(long.select("row", "text").mapInArrow(tidy(cut, _forget), _CHUNKS).repartition("row", "chunk"), "chunks")
    crossed, _ = materialize(parts.select("row", "chunk", "part").mapInArrow(tidy(transfers, _forget), "row long, chunk int, matrix string, ids array<int>"), "matrices")
    states, _ = materialize(crossed.select("row", "chunk", "matrix").groupBy("row").applyInArrow(joined, "row long, chunk int, states string"), "states")
    straddled = parts.where(~F.col("free")).join(states, ["row", "chunk"]).select("row", "chunk", "part", "states").mapInArrow(tidy(traced, _forget), "row long, chunk int, ids array<int>")
    pieces_of = crossed.where(F.col("ids").isNotNull()).select("row", "chunk", "ids").unionByName(straddled)
    whole = pieces_of.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x.ids)).alias("ids"))
    giants = whole.join(long, "row").select("doc_id", "text", "ids").mapInArrow(tidy(finish, _forget), _ENCODED)
    return short.unionByName(giants)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""

    def run(batches):
        p = pieces(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([p.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run, _forget), "doc_id long, text string")


