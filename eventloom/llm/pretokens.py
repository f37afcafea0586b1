"""Pre-tokens of byte-level BPE: cut whole texts, and solve each distinct one once.

The cut is that of the pattern below, made on arrays of code points instead of by a
regular-expression engine, since it meets every character of the corpus.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex

from .textops import CHUNK, chunked, distinct, utf8

#: Fixed value: the split of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens whose values a worker keeps, their bytes, and the values.
KEPT, KEPT_BYTES, KEPT_VALUES = 800_000, 32 << 20, 16 << 20
#: Characters after which a long text is cut at the next safe place.
PIECE = 1 << 18
_OTHER, _LETTER, _NUMBER, _SPACE, _EDGE = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, as the tokenizers library's own expressions see it.

    The regex module proposes letters and numbers; those that the library's edition of
    Unicode doesn't know yet are left out.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        proposed = "".join(regex.findall(pattern, every))
        code = np.frombuffer(proposed.encode("utf-32-le"), np.uint32)
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(proposed):
            out[code[a:b]] = kind
    return out


def starts(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in texts laid end to end; matches leave no gap."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[code]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = _EDGE, kind[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = _EDGE
    space = kind == _SPACE
    start = space & (before != _SPACE)
    turn = np.flatnonzero(~space & (kind != before))
    after_space = before[turn] == _SPACE
    start[turn[after_space] - 1] = True  # the last white space of a run stands apart, or joins what follows
    start[turn[~after_space | (code[turn - 1] != 0x20)]] = True
    quote = np.flatnonzero(start & (code == 0x27))
    if len(quote):
        end = bounds[np.searchsorted(bounds, quote, "right")]
        padded = np.r_[code, np.zeros(3, code.dtype)]
        a, b = padded[quote + 1], padded[quote + 2]
        one = (quote + 1 < end) & np.isin(a, [ord(x) for x in "stmd"])
        two = (quote + 2 < end) & np.logical_or.reduce([(a == ord(x)) & (b == ord(y)) for x, y in ("re", "ve", "ll")])
        start[quote[one | two] + 1] = False
        rest = np.where(one, quote + 2, quote + 3)
        start[rest[(one | two) & (rest < end)]] = True
    return np.flatnonzero(start)


def safe_cuts(text: str, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of a text, in order and without gaps, whose pre-tokens together are those of the text.

    A cut stands where a match begins and no white space comes before it, so no look-ahead
    crosses it; it is the first such place after ``most`` characters. Characters that are
    neither letter, number nor white space count as such within ASCII only, since a later
    edition of Unicode may class others anew. A single match longer than that stays whole.
    """
    n, lo = len(text), 0
    while n - lo > most:
        at, window = lo + most, 1 << 12
        while at < n:
            a = at - 1
            code = np.frombuffer(text[a : at + window].encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = _classes()[code]
            # a turn between classes but from white space; a space before the turn belongs to what follows
            sure = (kind != _OTHER) | (code < 0x80)
            good = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) & (code[:-1] != 0x27) & sure[1:] & sure[:-1]) + 1
            if len(good):
                at = a + int(good[0])
                break
            at, window = at + len(code) - 1, min(window * 4, 1 << 20)
        if at >= n:
            break
        yield lo, at
        lo = at
    yield lo, n


class Pretokens:
    """Values of texts' pre-tokens as flat arrays.

    ``solve`` maps a list of distinct pre-tokens to an array of all their values and the
    number of values of each; ``special`` maps special strings to their one value. A
    chunk's pre-tokens are dictionary-encoded by their bytes, and the values of distinct ones
    are kept under the bytes themselves, so no two pre-tokens are ever taken for one; all are
    dropped when there are over ``KEPT`` or they take too much memory.
    """

    def __init__(self, special: dict[str, int], solve: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.solve = solve
        self.special = special
        self.find_special = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))).finditer if special else None
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.used, self.bytes = np.zeros(1 << 16, np.int64), 0, 0

    def _keep(self, tokens: list[bytes]) -> None:
        values, size = self.solve([t.decode() for t in tokens])
        while self.used + len(values) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        self.pool = self.pool.astype(values.dtype, copy=False)
        self.pool[self.used : self.used + len(values)] = values
        first, n = len(self.number), len(tokens)
        while first + n > len(self.at):
            self.at, self.size = np.r_[self.at, np.zeros_like(self.at)], np.r_[self.size, np.zeros_like(self.size)]
        self.at[first : first + n] = self.used + np.cumsum(size) - size
        self.size[first : first + n] = size
        self.number.update(zip(tokens, range(first, first + n), strict=True))
        self.used += len(values)
        self.bytes += sum(map(len, tokens))

    def chunks(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hi, values, bounds) over a string column: the values of rows lo to hi and where each row's begin.

        A row longer than a chunk comes as several chunks with the same lo and hi = lo + 1,
        of which the earlier ones have one bound only.
        """
        data, offsets = utf8(column)
        for lo, hi in chunked(offsets):
            raw = data[offsets[lo] : offsets[hi]]
            if len(raw) > CHUNK and hi == lo + 1:
                text = raw.tobytes().decode()
                for a, b in self.cuts(text):
                    values, bounds = self._values(text[a:b], np.array([0, b - a]))
                    yield lo, hi, values, bounds[:1]
                yield lo, hi, np.zeros(0, np.int64), np.zeros(2, np.int64)
            else:
                place = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets[lo : hi + 1] - offsets[lo]]
                yield lo, hi, *self._values(raw.tobytes().decode(), place)

    def cuts(self, text: str) -> Iterator[tuple[int, int]]:
        """Safe cuts that no special string spans."""
        held = 0
        spans = [m.span() for m in self.find_special(text)] if self.find_special is not None else []
        for lo, hi in safe_cuts(text):
            i = bisect(spans, (hi, -1)) - 1
            if hi < len(text) and i >= 0 and spans[i][0] < hi < spans[i][1]:
                continue
            yield held, hi
            held = hi
        if held < len(text):
            yield held, len(text)

    def _values(self, text: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        spans = [m.span() for m in self.find_special(text)] if self.find_special is not None and any(x in text for x in self.special) else []
        spans = [(a, b) for a, b in spans if np.searchsorted(rows, a, "right") == np.searchsorted(rows, b - 1, "right")]
        bounds = np.unique(np.r_[rows, np.array(spans, np.int64).ravel()])
        start = starts(code, bounds)
        inner = np.ones(len(start), bool)
        for a, b in spans:
            x, y = np.searchsorted(start, (a, b))
            inner[x + 1 : y] = False
        start = start[inner]
        raw = np.frombuffer(text.encode(), np.uint8)
        edge = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]
        number, own = distinct(raw, np.diff(np.r_[edge[start], len(raw)]))
        if len(self.number) > KEPT or self.bytes > KEPT_BYTES or self.used > KEPT_VALUES:
            self.forget()
        place = np.fromiter(map(self.number.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.number), len(self.number) + len(new))
            self._keep(own[new].tolist())
        place = place[number]
        size, place = self.size[place], self.at[place]
        if spans:  # a special string's bytes may be those of the same ordinary text
            x = np.searchsorted(start, [a for a, _ in spans])
            size[x] = 1
        total = np.r_[0, np.cumsum(size)]
        values = self.pool[np.repeat(place - total[:-1], size) + np.arange(total[-1])]
        for a, b in spans:
            values[total[np.searchsorted(start, a)]] = self.special[text[a:b]]
        return values, total[np.searchsorted(start, rows)]
