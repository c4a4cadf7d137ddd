"""Byte-pair merges as a lattice: which token may follow which, and prefix dynamic programming over it.

A token sequence is the encoding of its text exactly when each token encodes itself and each adjacent
pair of tokens encodes the text of that pair. So for every prefix there is one last token, found from
the last tokens of shorter prefixes, and the encoding of all prefixes takes one pass.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick

_INF = float("inf")


def byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable ones stand for
    themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class MergeLattice:
    """pieces: the texts that are tokens, single symbols among them. rank(a, b): priority of merging two
    adjacent tokens (smaller first), None where they don't merge. Tokens are known by their number in
    pieces. Texts must consist of symbols that are pieces; others never merge, so callers cut there."""

    def __init__(self, pieces: list[str], rank: Callable[[str, str], float | None], keep: int = 400_000):
        self.rank = rank
        self.keep = keep
        self.pieces = pieces
        self.number = {p: i for i, p in enumerate(pieces) if p}
        self.longest = max(map(len, pieces), default=1)
        #: 1 a token, 0 none (its text is encoded otherwise), 2 not looked at yet
        self.kind = bytearray(1 if len(p) == 1 else 2 for p in pieces)
        self.made: dict[str, tuple[float, str, str]] = {}
        self.pair: dict[int, bool] = {}
        self.ends = ahocorasick.Automaton()
        for p, i in self.number.items():
            self.ends.add_word(p, (len(p), i))
        self.ends.make_automaton()

    def forget(self) -> None:
        """Empty the table of pairs looked at so far."""
        self.pair.clear()

    def merge(self, text: str) -> tuple[list[str], tuple[float, str, str] | None]:
        """The encoding by repeated best merge, and the last merge made; for short texts."""
        parts, made = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            made = (best, parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, made

    def is_token(self, i: int) -> bool:
        """Whether a piece is encoded as one token. Notes the merge that makes it, for follows()."""
        k = self.kind[i]
        if k == 2:
            piece = self.pieces[i]
            parts, made = self.merge(piece)
            k = self.kind[i] = len(parts) == 1
            if k:
                self.made[piece] = made
                self.is_token(self.number[made[1]])
                self.is_token(self.number[made[2]])
        return bool(k)

    def follows(self, i: int, j: int) -> bool:
        """Whether tokens i and j stay two tokens when they are adjacent.

        Goes back in time from the finished tokens: at each moment the symbols that touch at the border
        are x and y. If those two would have merged before the next merge that takes one of them, the
        border doesn't hold. Of equal ranks the left one comes first."""
        key = i << 32 | j
        ok = self.pair.get(key)
        if ok is None:
            if len(self.pair) >= self.keep:
                self.pair.clear()
            x, y, ok = self.pieces[i], self.pieces[j], True
            until, also = _INF, False
            while True:
                r = self.rank(x, y)
                if r is not None and (r < until or also and r == until):
                    ok = False
                    break
                mx, my = self.made.get(x), self.made.get(y)
                if mx is None and my is None:
                    break
                if my is None or mx is not None and mx[0] > my[0]:
                    until, also, x = mx[0], False, mx[2]
                else:
                    until, also, y = my[0], True, my[1]
            self.pair[key] = ok
        return ok

    def scan(self, text: str, before: int = -1) -> tuple[list[int | None], list[int]]:
        """For each prefix end 0..n: the last token of the prefix's encoding, and how many tokens it has,
        given that the token `before` precedes the text (-1: none). A last token is None where no
        encoding of that prefix goes on from `before`."""
        n = len(text)
        out: list[int | None] = [None] * (n + 1)
        counts = [0] * (n + 1)
        kind, pair = self.kind, self.pair
        out[0] = before
        for e, (size, i) in self.ends.iter(text):
            e += 1
            if out[e] is None and (prev := out[e - size]) is not None and kind[i]:
                if kind[i] == 2 and not self.is_token(i):
                    continue
                if prev >= 0:
                    ok = pair.get(prev << 32 | i)
                    if ok is None:
                        ok = self.follows(prev, i)
                    if not ok:
                        continue
                out[e] = i
                counts[e] = counts[e - size] + 1
        return out, counts

    def path(self, text: str, last: list[int | None], end: int) -> list[int]:
        """The tokens that lead to a prefix end, traced back through the last tokens."""
        out: list[int] = []
        while end > 0:
            out.append(last[end])
            end -= len(self.pieces[last[end]])
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        """The tokens of a text: scan() without its counts, traced back."""
        last: list[int | None] = [None] * (len(text) + 1)
        kind, pair = self.kind, self.pair
        last[0] = -1
        for e, (size, i) in self.ends.iter(text):
            e += 1
            if last[e] is None and (prev := last[e - size]) is not None and (k := kind[i]):
                if k == 2 and not self.is_token(i):
                    continue
                if prev >= 0:
                    ok = pair.get(prev << 32 | i)
                    if ok is None:
                        ok = self.follows(prev, i)
                    if not ok:
                        continue
                last[e] = i
        return self.path(text, last, len(text))

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of the encoding of every prefix, 0..n symbols."""
        return self.scan(text)[1]
