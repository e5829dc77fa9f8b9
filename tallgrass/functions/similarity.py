"""Similarities of texts and vectors.

``ratio`` is the normalised indel similarity, 2 * LCS / (length a + length b), with the longest common
subsequence found bit-parallel. The Arrow functions score a whole batch of pairs at a time: as many machine
words of bits a pair as its left text needs, one step a letter of its right one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one machine word of bits per text, a step per letter of ``b``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 1.0 if total == 0 else 2.0 * lcs_length(a, b) / total


def sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort(a: str, b: str) -> float:
    return indel_ratio(sorted_words(a), sorted_words(b))


def token_set(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words with either side's rest."""
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    shared = " ".join(sorted(wa & wb))
    with_a = " ".join(x for x in (shared, " ".join(sorted(wa - wb))) if x)
    with_b = " ".join(x for x in (shared, " ".join(sorted(wb - wa))) if x)
    if shared and (wa <= wb or wb <= wa):
        return 1.0
    best = indel_ratio(with_a, with_b)
    return max(best, indel_ratio(shared, with_a), indel_ratio(shared, with_b)) if shared else best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a prefix bonus of 0.1 a letter, up to four, where it exceeds 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    met: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                met.append(c)
                break
    if not met:
        return 0.0
    other = [c for c, open_ in zip(b, free) if not open_]
    moved = sum(x != y for x, y in zip(met, other)) // 2
    n = len(met)
    jaro = (n / len(a) + n / len(b) + (n - moved) / n) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


METRICS: dict[str, Callable[[str, str], float]] = {"ratio": indel_ratio, "token_sort_ratio": token_sort, "token_set_ratio": token_set, "jaro_winkler": jaro_winkler}


WORD_BITS = 64
CHUNK = 8_192


class Batch:
    """Pairs of texts as rows of letter codes; ``left`` and ``right`` say which text stands in each pair."""

    def __init__(self, left: list[str], right: list[str]):
        texts: dict[str, int] = {}
        self.left = np.array([texts.setdefault(t, len(texts)) for t in left])
        self.right = np.array([texts.setdefault(t, len(texts)) for t in right])
        self.texts = list(texts)
        self.sizes = np.array([len(t) for t in self.texts])
        letters: dict[str, int] = {}
        self.codes = np.full((len(self.texts), max(1, int(self.sizes.max(initial=0)))), -1, dtype=np.int32)
        for i, t in enumerate(self.texts):
            self.codes[i, : len(t)] = [letters.setdefault(c, len(letters)) for c in t]
        self.n_letters = len(letters)

    def lcs(self) -> np.ndarray:
        """Lengths of the longest common subsequences."""
        words = max(1, -(-int(self.sizes[self.left].max(initial=0)) // WORD_BITS))
        where = np.zeros((len(self.texts), self.n_letters + 1, words), dtype=np.uint64)
        row, at = np.nonzero(self.codes >= 0)
        fits = at < words * WORD_BITS
        row, at = row[fits], at[fits]
        np.bitwise_or.at(where, (row, self.codes[row, at], at // WORD_BITS), np.uint64(1) << (at % WORD_BITS).astype(np.uint64))
        l, r = self.left, self.right  # noqa: E741
        state = np.full((words, len(l)), np.iinfo(np.uint64).max, dtype=np.uint64)
        for k in range(int(self.sizes[r].max(initial=0))):
            hits = where[l, self.codes[r, k]]  # the code of padding is the last, empty column
            carry = np.zeros(len(l), dtype=np.uint64)
            for w in range(words):
                hit = state[w] & hits[:, w]
                low = state[w] + hit
                full = low + carry
                carry = ((low < hit) | (full < low)).astype(np.uint64)
                state[w] = full | (state[w] - hit)
        out = np.zeros(len(l), dtype=np.int64)
        for w in range(words):
            bits = np.clip(self.sizes[l] - w * WORD_BITS, 0, WORD_BITS)
            kept = np.where(bits >= WORD_BITS, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(~state[w] & kept)
        return out

    def jaro_winkler(self) -> np.ndarray:
        return self._jaro_winkler(self.left, self.right)

    def _jaro_winkler(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
        la, lb = self.sizes[l], self.sizes[r]
        a, b = self.codes[l, : max(1, la.max(initial=0))], self.codes[r, : max(1, lb.max(initial=0))]
        b = np.where(b < 0, -2, b)
        reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
        free, met = np.ones(b.shape, dtype=bool), np.zeros(a.shape, dtype=bool)
        rows = np.arange(len(l))
        place = np.arange(b.shape[1])
        for i in range(a.shape[1]):
            near = (b == a[:, i : i + 1]) & free & (np.abs(place - i) <= reach[:, None])
            first = near.argmax(axis=1)
            hit = near[rows, first]
            free[rows[hit], first[hit]] = False
            met[:, i] = hit
        taken = ~free
        n = met.sum(axis=1)
        # The met letters of either side in their order, side by side.
        width = int(n.max(initial=0))
        x = np.take_along_axis(a, np.argsort(~met, axis=1, kind="stable")[:, :width], axis=1)
        y = np.take_along_axis(b, np.argsort(~taken, axis=1, kind="stable")[:, :width], axis=1)
        moved = ((x != y) & (np.arange(width) < n[:, None])).sum(axis=1) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(n > 0, (n / la + n / lb + (n - moved) / n) / 3, 0.0)
        head = min(4, a.shape[1], b.shape[1])
        prefix = np.cumprod(a[:, :head] == b[:, :head], axis=1).sum(axis=1) if head else 0
        score = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
        return np.where(l == r, 1.0, score)


def _batches(left: list[str], right: list[str]):
    """(places, batch): pairs of like size together, in batches whose arrays stay small however long texts are."""
    longest = np.array([max(len(a), len(b)) for a, b in zip(left, right)])
    order = np.argsort(longest, kind="stable")
    start = 0
    while start < len(order):
        step = CHUNK
        while step > 1 and step * longest[order[min(start + step, len(order)) - 1]] > CHUNK * WORD_BITS:
            step //= 2
        at = order[start : start + step]
        yield at, Batch([left[i] for i in at], [right[i] for i in at])
        start += step


def jaro_winkler_near(first: list[str], second: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score): the pairs first[i] < second[j] whose Jaro-Winkler similarity is at least ``least``, above 0.5.

    Each text of ``first`` meets all of ``second`` behind it at once, bit-parallel: five steps a letter count the met
    letters, which bound the similarity, then the moved ones are counted where that leaves a chance. What is left
    is scored as any pair is. Texts of ``second`` of more than WORD_BITS letters are scored without a bound.
    """
    if least <= 0.5:
        raise ValueError("the bound of met letters says nothing at or below 0.5")
    order = np.array(sorted(range(len(second)), key=second.__getitem__), dtype=np.int64)
    ordered = [second[j] for j in order]
    starts = [bisect_right(ordered, a) for a in first]
    sizes = np.array([len(t) for t in ordered], dtype=np.int64)
    letters: dict[str, int] = {}
    codes = np.array([letters.setdefault(c, len(letters)) for t in ordered for c in t[:WORD_BITS]], dtype=np.int64)
    cut = np.minimum(sizes, WORD_BITS)
    text, at = np.repeat(np.arange(len(ordered)), cut), np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
    bits = np.zeros((len(letters) + 1, len(ordered)), dtype=np.uint64)  # the last row is of letters that none has
    np.bitwise_or.at(bits, (codes, text), np.uint64(1) << at.astype(np.uint64))
    heads = np.full((4, len(ordered)), -1, dtype=np.int64)
    heads[at[at < 4], text[at < 4]] = codes[at < 4]
    ones, zero = np.uint64(np.iinfo(np.uint64).max), np.uint64(0)
    short, inverse = sizes <= WORD_BITS, 1.0 / np.maximum(1, sizes)
    need = np.array([least if least <= 0.7 else max(0.7, (least - 0.1 * p) / (1 - 0.1 * p)) for p in range(5)])
    free_, hit_ = np.empty(len(ordered), dtype=np.uint64), np.empty(len(ordered), dtype=np.uint64)
    long_ = np.flatnonzero(~short)
    left, right = [], []
    waiting: list[tuple] = []

    def count_moved() -> None:
        """Of the pairs that wait, all with as long a left text, keep those whose moved letters leave a chance."""
        if not waiting:
            return
        i, place, n, prefix, rest, low, bit = (np.concatenate(x, axis=-1) for x in zip(*waiting))
        waiting.clear()
        moved = np.zeros(len(i), dtype=np.int64)
        for k in range(len(low)):
            taken = low[k] != 0
            step = np.where(taken, rest & (~rest + np.uint64(1)), zero)
            moved += taken & (bit[k] & step == 0)
            rest ^= step
        jaro = (n / len(low) + n * inverse[place] + (n - moved // 2) / n) / 3
        kept = jaro >= need[prefix] - 1e-9
        left.append(i[kept])
        right.append(order[place[kept]])

    by_size: dict[int, list[int]] = {}
    for i, a in enumerate(first):
        by_size.setdefault(len(a), []).append(i)
    for size, members in by_size.items():
        reach = np.maximum(0, np.maximum(size, sizes) // 2 - 1)
        low, window = np.empty((size, len(ordered)), dtype=np.uint64), np.empty((size, len(ordered)), dtype=np.uint64)
        for k in range(size):
            begin, end = np.maximum(0, k - reach), np.minimum(WORD_BITS, k + reach + 1)
            window[k] = np.where(begin < WORD_BITS, ones << np.minimum(begin, WORD_BITS - 1).astype(np.uint64), zero) & (ones >> (WORD_BITS - end).astype(np.uint64))
        n_waiting = 0
        for i in members:
            start = starts[i]
            if start == len(ordered) or not size:
                continue
            free, hit = free_[start:], hit_[start:]
            free[:] = ones
            of = [letters.get(c, len(letters)) for c in first[i]]
            for k, c in enumerate(of):
                now = low[k, start:]
                np.bitwise_and(bits[c, start:], window[k, start:], out=hit)
                np.bitwise_and(hit, free, out=hit)
                np.negative(hit, out=now)
                np.bitwise_and(hit, now, out=now)
                np.bitwise_xor(free, now, out=free)
            np.invert(free, out=free)
            met = np.bitwise_count(free)
            # The least that any common beginning asks for, then what theirs does.
            some = np.flatnonzero((met * inverse[start:] >= 3 * need[4] - 1 - 1e-9 - met / size) & short[start:] & (met > 0))
            same, prefix = np.ones(len(some), dtype=bool), np.zeros(len(some), dtype=np.int64)
            for k, c in enumerate(of[:4]):
                same &= heads[k, start + some] == c
                prefix += same
            n = met[some].astype(np.float64)
            chance = n / size + n * inverse[start + some] >= 3 * need[prefix] - 1 - 1e-9
            some, prefix, n = some[chance], prefix[chance], n[chance]
            place = start + some
            if len(some):
                waiting.append((np.full(len(some), i), place, n, prefix, free[some], low[:, place], bits[np.array(of)[:, None], place]))
                n_waiting += len(some)
                if n_waiting > CHUNK:
                    count_moved()
                    n_waiting = 0
            if len(long_):
                behind = long_[long_ >= start]
                left.append(np.full(len(behind), i))
                right.append(order[behind])
        count_moved()
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    i, j = np.concatenate(left), np.concatenate(right)
    score = scores("jaro_winkler", [first[x] for x in i], [second[x] for x in j])
    return i[score >= least], j[score >= least], score[score >= least]


def _ratios(left: list[str], right: list[str]) -> np.ndarray:
    out = np.empty(len(left))
    for at, batch in _batches(left, right):
        total = batch.sizes[batch.left] + batch.sizes[batch.right]
        out[at] = np.where(total == 0, 1.0, 2.0 * batch.lcs() / np.maximum(total, 1))
    return out


def _token_sets(left: list[str], right: list[str]) -> np.ndarray:
    words = {t: set(t.split()) for t in {*left, *right}}
    shared, with_a, with_b = [], [], []
    for a, b in zip(left, right):
        x, y = words[a], words[b]
        both = " ".join(sorted(x & y))
        shared.append(both)
        with_a.append(" ".join(p for p in (both, " ".join(sorted(x - y))) if p))
        with_b.append(" ".join(p for p in (both, " ".join(sorted(y - x))) if p))
    has = np.array([bool(x) for x in shared])
    some = np.maximum(_ratios(shared, with_a), _ratios(shared, with_b))
    best = np.maximum(_ratios(with_a, with_b), np.where(has, some, 0.0))
    within = np.array([words[a] <= words[b] or words[b] <= words[a] for a, b in zip(left, right)])
    none = np.array([not words[a] or not words[b] for a, b in zip(left, right)])
    return np.where(none, 0.0, np.where(has & within, 1.0, best))


def scores(name: str, left: list[str], right: list[str]) -> np.ndarray:
    """Similarities of pairs of texts; as METRICS[name] of each pair."""
    if not left:
        return np.empty(0)
    if name == "token_set_ratio":
        return _token_sets(left, right)
    if name == "jaro_winkler":
        out = np.empty(len(left))
        for at, batch in _batches(left, right):
            out[at] = batch.jaro_winkler()
        return out
    if name == "token_sort_ratio":
        sort = {t: sorted_words(t) for t in {*left, *right}}
        left, right = [sort[t] for t in left], [sort[t] for t in right]
    return _ratios(left, right)


def metric(name: str) -> Callable[[Column, Column], Column]:
    """An Arrow function for one of :data:`METRICS`; other names raise ValueError. Null if either text is."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")

    @F.pandas_udf(T.DoubleType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        known = (left.notna() & right.notna()).to_numpy()
        out = pd.Series(np.nan, index=left.index, dtype="float64").astype(object).where(known, None)
        if known.any():
            out[known] = scores(name, left[known].tolist(), right[known].tolist())
        return out.astype("Float64")

    return run


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors as a JVM expression, within [-1, 1]; a zero vector gives 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = lambda v: F.sqrt(dot(v, v))
    scale = F.when(size(a) * size(b) == 0, 1.0).otherwise(size(a) * size(b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale))


def register(spark) -> None:
    """Make the metrics callable from SQL under their names."""
    for name in METRICS:
        spark.udf.register(name, metric(name))
