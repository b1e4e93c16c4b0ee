"""String similarity of title keys; the library's one function that runs in Python, on whole Arrow batches of padded code points."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import title_key

# The function travels by value, so executors need no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters that the shorter or the longer string begins with and that always count, and what each adds of what lacks to 1.
PREFIX, BOOST = 4, 0.1
#: Cells of the tables of letters that are worked on together.
CELLS = 1 << 22


def _padded(words: list[str], other: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word, padded with a number that no letter has, and the lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), int(sizes.max(initial=0))), other, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<i4")
    return out, sizes


def _in_order(letters: np.ndarray, chosen: np.ndarray, filler: int) -> np.ndarray:
    """Each row's chosen letters moved to its beginning."""
    out = np.full(letters.shape, filler, np.int32)
    row, col = np.nonzero(chosen)
    out[row, (np.cumsum(chosen, axis=1) - 1)[row, col]] = letters[row, col]
    return out


def _block(a: list[str], b: list[str]) -> np.ndarray:
    """Scores of pairs of strings that are not empty."""
    (x, nx), (y, ny) = _padded(a, -1), _padded(b, -2)
    reach = np.maximum(np.maximum(nx, ny) // 2 - 1, 0)
    rows, cols = np.arange(len(a)), np.arange(y.shape[1])
    free, left = np.ones(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        low, high = max(i - int(reach.max()), 0), min(i + int(reach.max()) + 1, y.shape[1])
        fits = (y[:, low:high] == x[:, i : i + 1]) & free[:, low:high] & (np.abs(cols[low:high] - i) <= reach[:, None])
        if fits.shape[1]:
            at = fits.argmax(axis=1)
            hit = fits[rows, at]
            left[hit, i] = True
            free[rows[hit], at[hit] + low] = False
    m = left.sum(axis=1)
    width = min(x.shape[1], y.shape[1])
    differ = _in_order(x, left, -1)[:, :width] != _in_order(y, ~free, -1)[:, :width]
    swaps = differ.sum(axis=1) / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        jaro = np.where(m > 0, (m / nx + m / ny + (m - swaps) / m) / 3, 0.0)
    head = min(PREFIX, width)
    prefix = np.cumprod(x[:, :head] == y[:, :head], axis=1).sum(axis=1)
    return np.where(m > 0, jaro + prefix * BOOST * (1 - jaro), 0.0)


def _bound(a: list[str], b: list[str]) -> np.ndarray:
    """What no pair's score is above: as if all letters that both have matched in order. Letters are counted by 32 classes."""

    def counts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.array([w[:PREFIX].ljust(PREFIX, "\0") for w in words], f"<U{PREFIX}").view("<u4").reshape(len(words), PREFIX)
        return np.bincount(np.repeat(np.arange(len(words)) * 32, sizes) + points % 32, minlength=32 * len(words)).reshape(-1, 32), sizes, first

    (x, nx, hx), (y, ny, hy) = counts(a), counts(b)
    m = np.minimum(x, y).sum(axis=1)
    prefix = np.cumprod((hx == hy) & (hx != 0), axis=1).sum(axis=1)
    jaro = np.where(m > 0, (m / nx + m / ny + 1) / 3, 0.0)
    return jaro + prefix * BOOST * (1 - jaro)


def similarities(a: list[str | None], b: list[str | None], at_least: float = 0.0) -> np.ndarray:
    """Jaro-Winkler of each pair: matches within half the longer length less one; half the transpositions, not rounded; the prefix always counts.

    Equal strings have 1, a null or empty one 0 with any other. A pair that cannot reach at_least, by its lengths and common letters, is not compared and has 0.
    """
    out = np.array([float(x is not None and x == y) for x, y in zip(a, b, strict=True)])
    todo = np.array([i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and x != y], np.int64)
    if at_least > 0 and len(todo):
        todo = todo[_bound([a[i] for i in todo], [b[i] for i in todo]) >= at_least - 1e-9]
    todo = todo[np.argsort([max(len(a[i]), len(b[i])) for i in todo], kind="stable")] if len(todo) else todo
    low = 0
    while low < len(todo):
        high = low + 1
        while high < len(todo) and (high - low + 1) * max(len(a[todo[high]]), len(b[todo[high]])) <= CELLS // 8 and len(a[todo[high]]) + len(b[todo[high]]) <= 2 * (len(a[todo[low]]) + len(b[todo[low]])) + 8:
            high += 1
        part = todo[low:high]
        out[part] = _block([a[i] for i in part], [b[i] for i in part])
        low = high
    return out


def jaro_winkler(a: str | None, b: str | None) -> float:
    return float(similarities([a], [b])[0])


def key_similarity(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Similarity of title keys; 0 where it cannot reach at_least."""

    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(similarities(x.tolist(), y.tolist(), at_least), dtype="float64")

    return F.pandas_udf(scores, "double")(a, b)


def title_similarity(a: Column, b: Column) -> Column:
    return key_similarity(title_key(a), title_key(b))
