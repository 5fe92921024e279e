"""Places of many terms in texts: an index of hashes, in array operations on code points.

A span's hash is a polynomial of its code points, from sums over a stretch of text. The hash of a term's first characters tells the places
where it can stand, by a table of bits and then exactly; there the hashes of whole spans are looked up, one for each length that terms with
this beginning have. What is found is compared with the term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Characters at a term's front that lead to it, bits of the table, and characters of text looked at together.
SEED = 4
TABLE = 20
STEP = 1 << 17

_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_MIX = _U(0xD6E8FEB86659FD93)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Terms:
    """Distinct terms, none empty, to look for in texts."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.sizes = np.array([len(t) for t in terms], dtype=np.int64)
        self.longest = int(self.sizes.max(initial=0))
        self.powers = _powers(_R, STEP + self.longest + 1), _powers(pow(_R, -1, 2**64), STEP + self.longest + 1)
        whole = [self._hash(t) for t in terms]
        self.hashes, self.ids = np.unique(np.array(whole, dtype=_U), return_index=True)
        self.alike = sorted({*range(len(terms))} - {*self.ids.tolist()})  # whose hash is another one's too: looked for by themselves
        sizes: dict[int, dict[int, set[int]]] = {}  # by length of the beginning, its hash: the lengths of its terms
        for t, h in zip(terms, whole, strict=True):
            n = min(SEED, len(t))
            sizes.setdefault(n, {}).setdefault(self._hash(t[:n]) if len(t) > n else h, set()).add(len(t))
        self.seeds = []
        for n, of in sorted(sizes.items()):
            known = np.array(sorted(of), dtype=_U)
            lengths = [sorted(of[int(h)]) for h in known]
            table = np.zeros(1 << TABLE, dtype=bool)
            table[self._slot(known)] = True
            self.seeds.append((n, known, table, np.cumsum([0, *map(len, lengths)]), np.array([x for xs in lengths for x in xs], dtype=np.int64)))

    def _hash(self, term: str) -> int:
        return int((_codes(term) * self.powers[0][: len(term)]).sum(dtype=_U))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * _MIX >> _U(64 - TABLE)).astype(np.int64)

    def spans(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, start and term of the occurrences, in parts of whole texts."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= STEP or i + 1 == len(texts):
                yield self._of(texts[first : i + 1], first)
                first, size = i + 1, 0

    def _of(self, texts: list[str | None], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [t or "" for t in texts]
        ends = np.cumsum([len(t) for t in own])
        joined = "".join(own)
        codes = _codes(joined)
        parts = [(found, np.full(len(found), i)) for i in self.alike for found in [np.flatnonzero([joined.startswith(self.terms[i], k) for k in range(len(joined))])]]
        parts += [self._places(codes[at : at + STEP + self.longest], at, min(STEP, len(codes) - at)) for at in range(0, len(codes), STEP)] if self.terms else []
        at, term = (np.concatenate(x) if parts else np.zeros(0, dtype=np.int64) for x in (zip(*parts, strict=True) if parts else ((), ())))
        row = np.searchsorted(ends, at, side="right")
        fits = at + self.sizes[term] <= ends[row]  # a span is of one text
        at, term, row = at[fits], term[fits], row[fits]
        same = np.fromiter((joined.startswith(self.terms[t], a) for a, t in zip(at.tolist(), term.tolist(), strict=True)), dtype=bool, count=len(at))
        order = np.lexsort((at[same], term[same], row[same]))
        at, term, row = (x[same][order] for x in (at, term, row))
        kept = self._apart(at, term, row)
        return row[kept] + first, (at - np.concatenate(([0], ends))[row])[kept], term[kept]

    def _apart(self, at: np.ndarray, term: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of the spans of a term in a text, in order, those that a scan from the left takes."""
        kept = np.ones(len(at), dtype=bool)
        touching = (at[1:] < at[:-1] + self.sizes[term[1:]]) & (term[1:] == term[:-1]) & (row[1:] == row[:-1])
        until, last = -1, -2
        for i in (np.flatnonzero(touching) + 1).tolist():
            if i != last + 1:  # a run of spans each of which overlaps the one before
                until = int(at[i - 1] + self.sizes[term[i]])
            kept[i] = at[i] >= until
            if kept[i]:
                until = int(at[i] + self.sizes[term[i]])
            last = i
        return kept

    def _places(self, codes: np.ndarray, since: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (below ``most``, given from ``since`` on) and terms by the hashes in a stretch of text."""
        total = np.zeros(len(codes) + 1, dtype=_U)
        np.cumsum(codes * self.powers[0][: len(codes)], out=total[1:])
        found_at, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for n, known, table, begin, lengths in self.seeds:
            count = min(most, len(codes) - n + 1)
            if count <= 0:
                continue
            h = (total[n : n + count] - total[:count]) * self.powers[1][:count]
            at = np.flatnonzero(table[self._slot(h)])
            seed = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            hit = known[seed] == h[at]
            at, seed = at[hit], seed[hit]
            width = begin[seed + 1] - begin[seed]
            of = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begin[seed], width)
            at, size = np.repeat(at, width), lengths[of]
            inside = at + size <= len(codes)
            at, size = at[inside], size[inside]
            h = (total[at + size] - total[at]) * self.powers[1][at]
            i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[i] == h
            at, term, size = at[hit], self.ids[i[hit]], size[hit]
            right = self.sizes[term] == size
            found_at.append(at[right] + since)
            found.append(term[right])
        return np.concatenate(found_at), np.concatenate(found)


_INDEX: dict[str, Terms] = {}


def lexicon_index(name: str, terms: Callable[[], list[str]]) -> Terms:
    """The worker's index of a block of terms, built once; it holds one at a time."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Terms(terms())
    return _INDEX[name]
