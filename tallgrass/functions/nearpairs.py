"""Similar pairs among groups of texts, without scoring pairs that can't be similar.

Every pair of a group is looked at, a whole group at once: the letters that two texts share, counted with what
they have of each, bound any similarity here. What is left meets the similarity itself, bit-parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np

from tallgrass.functions.similarity import WORD_BITS, scores

#: Letters that are counted apart (all others of a batch as one), and how many of each.
KINDS, LEVELS = 32, 4
#: Pairs looked at and pairs scored at a time.
SLAB, STEP = 1 << 19, 1 << 13
#: Metrics that :func:`near` knows.
NEAR = ("jaro_winkler", "token_set_ratio")

_ONES, _ZERO, _ONE = np.uint64(np.iinfo(np.uint64).max), np.uint64(0), np.uint64(1)

#: (first, end, other, other end): a group's rows; ``other`` is None where they meet among themselves.
Group = tuple[int, int, int | None, int | None]


class Letters:
    """Texts as rows of letter codes, with bits of their counted letters; ``size`` counts all letters."""

    def __init__(self, texts: Sequence[str]):
        self.n = len(texts)
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=self.n)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        counted = np.bincount(points, minlength=1)
        used = np.flatnonzero(counted)
        order = used[np.argsort(-counted[used], kind="stable")]
        code_of = np.zeros(len(counted), dtype=np.int32)
        code_of[order] = np.arange(len(order))
        self.n_letters = len(order)
        text = np.repeat(np.arange(self.n), self.size)
        at = np.arange(len(points)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        code = code_of[points] if len(points) else np.empty(0, np.int32)
        self.first = np.full(self.n, -1, dtype=np.int32)
        self.first[text[at == 0]] = code[at == 0]
        self._count(text, code)
        near = at < WORD_BITS
        self._places = text[near], at[near], code[near]

    def _count(self, text: np.ndarray, code: np.ndarray) -> None:
        have = np.bincount(text * KINDS + np.minimum(code, KINDS - 1), minlength=self.n * KINDS).reshape(self.n, KINDS)
        kept = np.minimum(have, LEVELS)
        self.excess = (have - kept).sum(axis=1).astype(np.int32)
        levels = np.arange(LEVELS)[None, :, None] < kept[:, None, :]  # text, level, kind
        self.bits = np.ascontiguousarray(np.packbits(levels.reshape(self.n, KINDS * LEVELS), axis=1).view(np.uint64).T)

    def common(self, x: slice, y: slice) -> np.ndarray:
        """At least as many letters as the texts of ``x`` and ``y`` have in common."""
        n = np.bitwise_count(self.bits[0, x, None] & self.bits[0, None, y])
        for b in self.bits[1:]:
            n += np.bitwise_count(b[x, None] & b[None, y])
        if self.excess[x].any() and self.excess[y].any():
            return n + np.minimum(self.excess[x, None], self.excess[None, y])
        return n

    def placed(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes, bits): where in ``bits`` the letter at each place has its row, and the places of each letter in each text, a row a letter."""
        text, at, code = self._places
        codes = np.full((WORD_BITS, self.n), self.n_letters * self.n, dtype=np.int64)
        codes[at, text] = code.astype(np.int64) * self.n
        bits = np.zeros((self.n_letters + 1, self.n), dtype=np.uint64)
        np.bitwise_or.at(bits, (code, text), _ONE << at.astype(np.uint64))
        return codes, bits.ravel()


def _looked_at(groups: Iterable[Group], kept: Callable[[slice, slice], np.ndarray]):
    """(i, j): places of the pairs that ``kept`` leaves of each group, each once."""
    for first, end, other, other_end in groups:
        own = other is None
        last = end if own else other_end
        start = first
        while start < end:
            low = start if own else other
            stop = min(end, start + max(1, SLAB // max(1, last - low)))
            if last > low:
                i, j = np.nonzero(kept(slice(start, stop), slice(low, last)))
                if own:
                    later = j > i
                    i, j = i[later], j[later]
                if len(i):
                    yield i + start, j + low
            start = stop


def _gathered(found: Iterable[tuple[np.ndarray, np.ndarray]]):
    waiting, n = [], 0
    for i, j in found:
        waiting.append((i, j))
        n += len(i)
        if n >= STEP:
            i, j = (np.concatenate(x) for x in zip(*waiting))
            yield from ((i[k : k + STEP], j[k : k + STEP]) for k in range(0, n, STEP))
            waiting, n = [], 0
    if waiting:
        yield tuple(np.concatenate(x) for x in zip(*waiting))


def near(name: str, texts: Sequence[str], groups: Iterable[Group], least: float, veto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score): the pairs of different texts of a group whose similarity by ``name`` is at least ``least``, texts[i] the smaller.

    Pairs whose entries in ``veto`` differ, neither of them 0, are left out.
    """
    if name not in NEAR:
        raise ValueError(f"near knows {', '.join(NEAR)}, not {name!r}")
    letters = Letters(texts)
    rank = np.empty(len(texts), dtype=np.int64)
    rank[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    bound = _may_jaro_winkler(letters, least) if name == "jaro_winkler" else _may_token_set(letters, texts, least)

    def kept(x: slice, y: slice) -> np.ndarray:
        found = bound(x, y)
        if veto is not None and veto[x].any() and veto[y].any():
            found &= (veto[x, None] == veto[None, y]) | (veto[x, None] == 0) | (veto[None, y] == 0)
        return found

    out: list[tuple] = []
    placed = letters.placed() if name == "jaro_winkler" else None
    for i, j in _gathered(_looked_at(groups, kept)):
        i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
        short = (letters.size[i] <= WORD_BITS) & (letters.size[j] <= WORD_BITS) if name == "jaro_winkler" else np.zeros(len(i), dtype=bool)
        if short.any():
            out.append(_jaro_winkler(letters, *placed, i[short], j[short], least))
        if not short.all():
            i, j = i[~short], j[~short]
            score = scores(name, [texts[k] for k in i], [texts[k] for k in j])
            out.append((i[score >= least], j[score >= least], score[score >= least]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _needed(least: float) -> np.ndarray:
    """The Jaro similarity that ``least`` asks for, by the letters of the common beginning."""
    return np.array([least if least <= 0.7 else max(0.7, (least - 0.1 * p) / (1 - 0.1 * p)) for p in range(5)])


def _may_jaro_winkler(letters: Letters, least: float) -> Callable[[slice, slice], np.ndarray]:
    need = (3 * _needed(least) - 1 - 1e-4).astype(np.float32)
    inverse = (1 / np.maximum(1, letters.size)).astype(np.float32)

    def may(x: slice, y: slice) -> np.ndarray:
        # The met letters count by either length, and count fully if none is moved.
        chance = (inverse[x, None] + inverse[None, y]) * letters.common(x, y)
        found = chance >= need[4]
        return found & ((chance >= need[0]) | (letters.first[x, None] == letters.first[None, y]))

    return may


#: The places (bits) that a letter at each place may meet, by how far it may lie off.
_REACHED = np.array([[sum(1 << p for p in range(max(0, k - r), min(WORD_BITS, k + r + 1))) for r in range(WORD_BITS // 2)] for k in range(WORD_BITS)], dtype=np.uint64)


def _jaro_winkler(letters: Letters, codes: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The near ones of the pairs (i, j) of texts of at most WORD_BITS letters, with their scores.

    ``codes`` has, by place and text, where in ``bits`` (of all letters and texts, flat) the letter's row begins.
    """
    least_sum = 3 * _needed(least) - 1e-9
    la, lb = letters.size[i], letters.size[j]
    prefix, same = np.zeros(len(i), dtype=np.int64), np.ones(len(i), dtype=bool)
    for k in range(4):
        same &= (codes[k].take(i) == codes[k].take(j)) & (k < la)
        prefix += same
    asked = (least_sum[prefix] - 1) / (1 / np.maximum(1, la) + 1 / np.maximum(1, lb)) - 1e-6
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    free = np.full(len(i), _ONES)
    taken = np.empty((int(la.max(initial=0)), len(i)), dtype=np.uint64)
    for k, hit in enumerate(taken):
        bits.take(codes[k].take(i) + j, out=hit, mode="clip")
        hit &= _REACHED[k].take(reach)
        hit &= free
        hit &= np.negative(hit)
        free ^= hit
    met = np.bitwise_count(~free).astype(np.int64)
    kept = np.flatnonzero((met >= asked) & (met > 0))
    i, j, la, lb, prefix, rest, met = (x.take(kept) for x in (i, j, la, lb, prefix, ~free, met))
    most = 2 * np.floor(met * (met / la + met / lb + 1 - least_sum[prefix]) + 1e-6) + 1
    moved = np.zeros(len(i), dtype=np.int64)
    for k, hits in enumerate(taken):
        if k and k % 4 == 0:  # pairs of which too many letters have moved go
            stay = np.flatnonzero(moved <= most)
            if len(stay) < 0.8 * len(i):
                kept, i, j, la, lb, prefix, rest, met, most, moved = (x.take(stay) for x in (kept, i, j, la, lb, prefix, rest, met, most, moved))
        here = hits.take(kept) != 0
        step = rest & np.negative(rest)
        step *= here
        rest ^= step
        step &= bits.take(codes[k].take(i) + j)
        moved += here & (step == 0)
    jaro = (met / la + met / lb + (met - moved // 2) / met) / 3
    score = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
    stay = score >= least
    return i[stay], j[stay], score[stay]


def _may_token_set(letters: Letters, texts: Sequence[str], least: float) -> Callable[[slice, slice], np.ndarray]:
    words = [sorted(set(t.split())) for t in texts]
    by_words = Letters([" ".join(w) for w in words])
    length = by_words.size.astype(np.float32)

    def may(x: slice, y: slice) -> np.ndarray:
        common = by_words.common(x, y).astype(np.float32)
        both = 2 * common >= np.float32(least - 1e-4) * (length[x, None] + length[None, y])
        shared = _shared(words[x], words[y])  # letters of the shared words, with blanks between them
        one = 2 * shared >= np.float32(least - 1e-4) * (shared + np.minimum(length[x, None], length[None, y]))
        return (both | one & (shared > 0)) & (length[x, None] > 0) & (length[None, y] > 0)

    return may


def _shared(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Letters of the words that two texts share, joined by blanks; at most 0 if there are none."""
    known = {w for t in left for w in t}
    place: dict[str, int] = {}
    at_right = [(n, place.setdefault(w, len(place))) for n, t in enumerate(right) for w in t if w in known]
    if not place:
        return np.zeros((len(left), len(right)), dtype=np.float32)
    at_left = [(n, place[w]) for n, t in enumerate(left) for w in t if w in place]
    has, had = np.zeros((len(left), len(place)), dtype=np.float32), np.zeros((len(right), len(place)), dtype=np.float32)
    has[tuple(zip(*at_left))] = 1
    had[tuple(zip(*at_right))] = 1
    return (has * np.array([len(w) + 1 for w in place], dtype=np.float32)) @ had.T - 1
