"""Signatures of universal hash minima, and the bucket keys of their bands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIME = (1 << 31) - 1


def universal(k: int, seed: int = 20_24) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from the token hashes of several sets, one after another, and the sets' sizes (above 0) to a row of ``k`` minima a set.

    Token hashes are reduced to the field of PRIME; each of the ``k`` functions is a * x + b mod PRIME with a
    and b drawn once from ``seed``. The lowest 16 bits of each minimum are kept.
    """
    rng = np.random.default_rng(seed)
    a = rng.integers(1, PRIME, k, dtype=np.uint64)
    b = rng.integers(0, PRIME, k, dtype=np.uint64)

    def minima(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        x = hashes.view(np.uint64) % np.uint64(PRIME)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out = np.empty((len(sizes), k), dtype=np.uint16)
        for j in range(k):
            out[:, j] = np.minimum.reduceat((a[j] * x + b[j]) % np.uint64(PRIME), at).astype(np.uint16)
        return out

    return minima


def signer(k: int, seed: int = 20_24) -> Callable[[Column], Column]:
    """A column function from an array of token hashes to their ``k`` minima (see :func:`universal`), in order, as binary. An empty array gives null."""
    minima = universal(k, seed)

    @F.pandas_udf(T.BinaryType())
    def sign(tokens: pd.Series) -> pd.Series:
        out: list = [None] * len(tokens)
        step = 4_096
        for start in range(0, len(tokens), step):
            chunk = tokens.iloc[start : start + step]
            sizes = np.array([0 if x is None else len(x) for x in chunk])
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            rows = minima(np.concatenate([np.asarray(chunk.iloc[i], dtype=np.int64) for i in full]), sizes[full])
            for r, i in enumerate(full):
                out[start + i] = rows[r].tobytes()
        return pd.Series(out, dtype=object)

    return sign


#: Pairs whose signatures are compared at a time.
STEP = 65_536


def banded_pairs(place: np.ndarray, minima: np.ndarray, bands: int, rows: int, worth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, likeness): the pairs of rows of one ``place`` that agree in a band, each once, of which one at least is ``worth`` it.

    Every band is sorted by its minima, rows that are worth it first in their bucket, and each of these meets all behind it.
    """
    split = minima.reshape(len(minima), bands, rows)
    for band in range(bands):
        order = np.lexsort((~worth, *split[:, band].T, place))
        key = np.column_stack([place[order], split[order, band].astype(np.int64)])
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]).any(axis=1)
        starts = np.flatnonzero(fresh)
        sizes = np.diff([*starts, len(order)])
        ends = np.repeat(starts + sizes, sizes)
        far = 1
        at = np.flatnonzero(worth[order] & (np.arange(len(order)) + far < ends))
        while len(at):
            for some in np.array_split(at, -(-len(at) // STEP)):
                i, j = order[some], order[some + far]
                same = minima[i] == minima[j]
                first = same.reshape(len(i), bands, rows).all(axis=2)[:, :band].any(axis=1)  # met in an earlier band
                if not first.all():
                    yield i[~first], j[~first], same[~first].mean(axis=1)
            far += 1
            at = at[at + far < ends[at]]


def band_keys(minima: Column, bands: int, rows: int, place: Column) -> Column:
    """The bucket keys of a signature: hashes of ``place``, the band's number and its ``rows`` minima."""
    part = lambda i: F.substring(minima, i * (2 * rows) + 1, F.lit(2 * rows))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(place, i, part(i)))


@F.pandas_udf(T.DoubleType())
def agreement(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of equal packed minima of two signatures: the estimate of the sets' Jaccard similarity."""
    return pd.Series([float(np.mean(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16))) for x, y in zip(left, right)], dtype=float)
