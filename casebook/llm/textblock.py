"""Vectorised views of a batch of texts: code points, runs, words and their 64-bit hashes.

A batch of texts becomes one array of code points; classes, boundaries and polynomial hashes are computed for the
whole batch, so no Python object is made per word. Work and memory are linear in the batch's characters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, SPECIAL = 0, 1, 2, 3, 4
#: A value above all code points: stands for one special token.
SPECIAL_CP = 0x110000
_U = np.uint64
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: White space as Unicode's White_Space property lists it.
WHITE_SPACE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point by Unicode category, and of SPECIAL_CP."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return np.append(out, np.uint8(SPECIAL))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("b")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in (("b", _BASE), ("i", _BASE_INV)):
            a = np.full(size, base, _U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["b"][:n], _powers["i"][:n]


@lru_cache(4)
def _mixed(seed: int) -> np.ndarray:
    return mix(np.arange(SPECIAL_CP + 1, dtype=_U) + _U(0x632BE59BD9B4E019 + seed))


class Hasher:
    """Hashes of slices of one code-point array by prefix sums modulo 2^64."""

    def __init__(self, cps: np.ndarray, seed: int = 0):
        up, self.down = _power(len(cps) + 1)
        self.sums = np.zeros(len(cps) + 1, _U)
        np.cumsum(_mixed(seed)[cps] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, and where each text starts (one more for the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


@lru_cache(1)
def folds() -> np.ndarray:
    """Every code point's lower case, where that is one code point."""
    return np.fromiter((ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)


class Words:
    """Words of a batch: maximal runs of letters, digits and combining marks, lower-cased; positions are per text."""

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        cps, at = code_points(self.texts)
        inside = _word_class()[cps] if len(cps) else np.zeros(0, bool)
        edge = np.zeros(len(cps) + 1, np.int8)
        edge[:-1] += inside
        edge[1:] -= inside
        begin, stop = edge > 0, edge < 0
        cut = at[1:-1]
        cut = cut[(cut > 0) & (cut < len(cps))]
        joined = cut[inside[cut - 1] & inside[cut]] if len(cut) else cut
        begin[joined] = True
        stop[joined] = True
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop)
        self.hasher = Hasher(folds()[cps])
        self.cps, self.at = cps, at
        self.hash = self.hasher.of(self.start, self.end)
        #: Words of text i are first[i]:first[i+1].
        self.first = np.searchsorted(self.start, at)


@lru_cache(1)
def _word_class() -> np.ndarray:
    kinds = classes()
    marks = np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)
    out = (kinds == LETTER) | (kinds == NUMBER)
    out[:0x110000] |= marks
    return out


def byte_bpe_pieces(texts: list[str | None], special: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """Split texts as the byte-level pre-tokenizer does: contractions, then runs of letters, numbers or others with one
    leading blank, then white space. Occurrences of the special token are pieces of their own.

    Returns hash of each piece, its start and end in the joined text, the first piece of each text (one more for the
    end), and the joined text. In the joined text a special token is one NUL; its piece has SPECIAL_CP's hash.
    """
    parts, of_text, is_special = [], [], []
    for i, t in enumerate(texts):
        t = t or ""
        if special in t:
            for k, p in enumerate(t.split(special)):
                if k:
                    parts.append("\0"), of_text.append(i), is_special.append(True)
                parts.append(p), of_text.append(i), is_special.append(False)
        else:
            parts.append(t), of_text.append(i), is_special.append(False)
    cps, at = code_points(parts)
    n = len(cps)
    lone = np.asarray(is_special, bool)
    if lone.any():
        cps = cps.copy()
        cps[at[:-1][lone]] = SPECIAL_CP
    kind = classes()[cps] if n else np.zeros(0, np.uint8)
    bound = np.zeros(n + 1, bool)
    bound[at] = True
    change = np.empty(n, bool)
    if n:
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        change |= bound[:-1]
    solid = kind != SPACE
    after_space = np.zeros(n, bool)
    if n:
        after_space[1:] = ~solid[:-1]
        after_space &= change & solid & ~bound[:-1] & (kind != SPECIAL)
    blank_before = np.zeros(n, bool)
    blank_before[1:] = cps[:-1] == 0x20
    start = change & ~(after_space & blank_before)
    start[np.flatnonzero(after_space) - 1] = True
    quote = np.flatnonzero((cps == 39) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[~bound[quote + 1]]
    if len(quote):
        one = cps[quote + 1]
        two_at = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~bound[quote + 2], cps[two_at], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        hit = short | long
        q, size = quote[hit], np.where(short, 2, 3)[hit]
        start[q + 1] = False
        stop = q + size
        start[stop[stop < n]] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n) if len(begin) else begin
    own = np.searchsorted(np.asarray(of_text, np.int64), np.arange(len(texts) + 1))
    first = np.searchsorted(begin, at[own])
    hasher, check = Hasher(cps), Hasher(cps, 0x5851F42D4C957F2D)
    return np.stack([hasher.of(begin, end), check.of(begin, end)]), begin, end, first, "".join(parts)


def distinct_pieces(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, joined: str, special: str) -> tuple[list[str], np.ndarray]:
    """The distinct pieces of a batch, by first occurrence, and the slot of each piece among them; two 64-bit hashes must
    agree."""
    if not len(begin):
        return [], np.zeros(0, np.uint32)
    _, where, slot = np.unique(hashes[0], return_index=True, return_inverse=True)
    blank = special_hash()
    if not (hashes[1][where][slot] == hashes[1]).all():  # two words share the first hash: go by the words themselves
        known: dict[tuple[int, str], int] = {}
        slot = np.fromiter((known.setdefault((int(h == blank), joined[b:e]), len(known)) for h, b, e in zip(hashes[0], begin, end)), np.int64, len(begin))
        return [special if s else w for s, w in known], slot.astype(np.uint32)
    order = np.argsort(where)
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    where = where[order]
    words = [joined[b:e] for b, e in zip(begin[where].tolist(), end[where].tolist())]
    for k in np.flatnonzero(hashes[0][where] == blank):
        words[k] = special
    return words, rank[slot.reshape(-1)]


@lru_cache(1)
def special_hash() -> np.uint64:
    return Hasher(np.array([SPECIAL_CP], np.uint32)).of(np.array([0]), np.array([1]))[0]


def ragged(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenate values[first[i]:first[i]+size[i]] for all i."""
    total = int(size.sum())
    if not total:
        return values[:0]
    out = np.ones(total, np.int64)
    keep = size > 0
    first, size = first[keep], size[keep]
    heads = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=heads[1:])
    out[0] = first[0]
    out[heads[1:]] = first[1:] - (first[:-1] + size[:-1] - 1)
    return values[np.cumsum(out)]


def batches(texts: list, rows: list, limit: int):
    """Parts of a batch with about ``limit`` characters each (at least one text)."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= limit:
            yield texts[at : i + 1], rows[at : i + 1]
            at, total = i + 1, 0
    if at < len(texts):
        yield texts[at:], rows[at:]
