"""Measures of the characters of many strings at once: an Arrow-batched function in numpy.

The measures need counts of characters, of their neighbours and of windows, for
which built-in functions would search each array once for every item of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of a window whose entropy is taken.
WINDOW = 8


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of places at which all keys stay the same."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, n))


def entropies(items: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shannon entropy, in bits, of the items of each of n owners, and how many different items each has."""
    order = np.lexsort((items, owner))
    start, count = _runs(items[order], owner[order])
    of = owner[order][start]
    share = count / np.bincount(owner, minlength=n)[of]
    return np.bincount(of, -share * np.log2(share), minlength=n), np.bincount(of, minlength=n)


def measured(texts: list[str]) -> dict[str, np.ndarray]:
    """n_distinct, longest_run, entropies of one, two and three characters, and the evenness of windows of each text."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    out = {}
    for width in (1, 2, 3):
        places = max(0, len(points) - width + 1)
        whole = np.flatnonzero(owner[:places] == owner[width - 1 :][:places])
        gram = np.zeros(len(whole), np.uint64)
        for k in range(width):
            gram = gram << np.uint64(21) | points[whole + k]
        out[f"entropy{width}"], distinct = entropies(gram, owner[whole], n)
        if width == 1:
            out["n_distinct"] = distinct
    start, length = _runs(points, owner)
    out["longest_run"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_run"], owner[start], length)
    places = max(0, len(points) - WINDOW + 1)
    whole = np.flatnonzero(owner[:places] == owner[WINDOW - 1 :][:places])
    inside = np.sort(points[whole[:, None] + np.arange(WINDOW)], axis=1)
    start, length = _runs(inside.ravel(), np.repeat(np.arange(len(whole)), WINDOW))
    local = np.round(np.bincount(start // WINDOW, -length / WINDOW * np.log2(length / WINDOW), minlength=len(whole)), 12)
    of = owner[whole]
    count = np.maximum(1, np.bincount(of, minlength=n))
    mean = np.bincount(of, local, minlength=n) / count
    spread = np.sqrt(np.bincount(of, (local - mean[of]) ** 2, minlength=n) / count)
    even = ((1 - np.minimum(1, spread / 2)) + np.minimum(1, mean / 4)) / 2
    out["evenness"] = np.where(sizes < WINDOW, 0.0, even)
    return out


def shape(s: Column) -> Column:
    """A struct of the measures of a string that is not null."""

    @F.pandas_udf("n_distinct long, longest_run long, entropy1 double, entropy2 double, entropy3 double, evenness double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = measured(part.tolist())
            yield pd.DataFrame({c: found[c] for c in ("n_distinct", "longest_run", "entropy1", "entropy2", "entropy3", "evenness")})

    return of(s)
