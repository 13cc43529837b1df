"""Embedding of chunks: prefixes, token windows, pooled unit vectors, and a deterministic provider."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import unit

PASSAGE, QUERY, WINDOW_TOKENS = "passage: ", "query: ", 512


def windows_by_characters(text: Column, prefix: str, limit: int) -> Column:
    """Windows of a text whose tokens are its characters: cut greedily to limit less the prefix, each with the prefix before it."""
    step = limit - len(prefix)
    if step < 1:
        raise ValueError("the prefix leaves no room")
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    return F.transform(starts, lambda i: F.concat(F.lit(prefix), F.substring(text, i, F.lit(step))))


def split_windows(prefix: str, text: str, limit: int, count: Callable[[str], int]) -> list[str]:
    """Longest pieces of a text that fit `limit` tokens with the prefix; together they are the text. Text that fits is one piece."""
    if count(prefix + text) <= limit:
        return [prefix + text]
    out, at = [], 0
    while at < len(text):
        low, high = 0, min(len(text) - at, 4 * limit)
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if count(prefix + text[at : at + half]) <= limit else (low, half - 1)
        if low == 0:
            raise ValueError("one character doesn't fit")
        out.append(prefix + text[at : at + low])
        at += low
    return out


def windows(text: Column, prefix: str, limit: int, count: Callable[[str], int]) -> Column:
    """split_windows() over a column, with the provider's token count."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_windows(prefix, t or "", limit, count))

    return run(text)


def mean_pool(vectors: DataFrame, key: str) -> DataFrame:
    """Mean of the vectors (key, embedding) of each key, of length 1; a key with one vector keeps its direction. A key's lengths must agree."""
    parts = vectors.select(key, F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x")).groupBy(key, "d").agg(F.avg("x").alias("x"))
    pooled = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
    return pooled.select(key, unit(F.transform("v", lambda p: p["x"])).alias("embedding"))


def vector_error(v: Column, dim: int) -> Column:
    """Why a vector can't be stored; null if it can."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    return F.when(v.isNull(), "missing").when(F.size(v) != dim, "dimensions").when(odd, "not finite").when(norm == 0, "zero")


#: Providers that this Python worker has loaded, by name.
_LOADED: dict[str, Callable[[list[str]], object]] = {}


def _loaded(name: str, load: Callable[[], Callable[[list[str]], object]]) -> Callable[[list[str]], object]:
    """The worker's own provider; a UDF would take a copy of the module's names along."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def batches(sizes: list[int], budget: int) -> list[list[int]]:
    """Places of windows in batches of at most `budget` tokens, padding counted: those of like size go together. A window over the budget is a batch of its own."""
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        if out and (len(out[-1]) + 1) * sizes[i] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _pooled(texts: pd.Series, model, prefix: str, limit: int, count: Callable[[str], int], budget: int, dim: int) -> pd.Series:
    there = texts[texts.notna()]
    cut = [split_windows(prefix, t, limit, count) for t in there]
    flat = [w for windows_of in cut for w in windows_of]
    got = np.zeros((len(flat), dim))
    for places in batches([count(w) for w in flat], budget):
        v = np.asarray(model([flat[i] for i in places]), dtype=np.float64)
        if v.shape != (len(places), dim):
            raise ValueError(f"the provider gave {v.shape}, not {(len(places), dim)}")
        got[places] = v
    if not np.isfinite(got).all() or not got.any(axis=1).all():
        raise ValueError("the provider gave a zero vector or one that isn't finite")
    of = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    total = np.zeros((len(cut), dim))
    np.add.at(total, of, got)
    several = np.bincount(of, minlength=len(cut))[:, None]
    norm = np.linalg.norm(total / several, axis=1, keepdims=True)
    if not norm.all():
        raise ValueError("windows of a text cancel each other")
    out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
    out[there.index] = pd.Series(list((total / several / norm).astype("f4")), index=there.index, dtype=object)
    return out


def provided(name: str, load: Callable[[], Callable[[list[str]], object]], dim: int, prefix: str = PASSAGE, limit: int = WINDOW_TOKENS, count: Callable[[str], int] = len, budget: int = 8192):
    """A column function from texts to unit vectors by a provider that load() makes, once in each Python worker, whatever the number of its tasks.

    A text is cut in windows of `limit` tokens with the prefix, windows go to the provider in batches of at most `budget` tokens, padding counted, and the mean of a text's windows is brought to length 1. Null texts have null vectors.
    A provider that gives too few vectors, or wrong, zero or non-finite ones, is an error. `name` tells providers apart. It serves as `embed` of ranking.retrieve and of ingestion.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(name, load)
        for texts in parts:
            yield _pooled(texts, model, prefix, limit, count, budget, dim)

    return run


def hashed_words(dim: int = 64):
    """A deterministic provider for tests: signed counts of hashed words, of length 1."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        slots: dict[str, int] = {}  # of the batch's words: the place, dim more for those that count down

        def slot(w: str) -> int:
            h = zlib.crc32(w.encode())
            return slots.setdefault(w, h % dim + (0 if h & (1 << 20) else dim))

        def one(t: str | None) -> list[float]:
            words = (t or "").lower().split()
            n = np.bincount([slots[w] if w in slots else slot(w) for w in words], minlength=2 * dim) if words else np.zeros(2 * dim)
            v = (n[:dim] - n[dim:]).astype("f8")
            n = np.linalg.norm(v)
            return (v / n if n else np.eye(dim)[0]).astype("f4").tolist()

        return texts.map(one)

    return run
