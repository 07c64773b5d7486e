"""Vector expressions over array columns: pooling, normalising, cosine, and the default hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TOKEN, let


def doubled(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Of unit length; a zero vector stays as it is."""
    return let(v, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubled(v))))


def cosine(a: Column, b: Column) -> Column:
    """Null where a length is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(v: Column) -> Column:
    """Of unit length; null for a vector without length, or with a component that is missing or no finite number."""
    return let(v, lambda v: let(norm(v), lambda n: F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n))))


def pooled(m: Column, how: str = "mean", mask: Column | None = None) -> Column:
    """An array of vectors as one: its first ("cls"), or the mean or the maximum of each component.

    mask: an array of 0 and 1; vectors at 0 (padding) count in no mean and no maximum.  Where none is left a mean is zeros.
    """
    if how == "cls":
        return F.element_at(m, 1)
    if how not in ("mean", "max"):
        raise ValueError(f"unknown pooling {how!r}: cls, mean or max")
    kept = m if mask is None else F.filter(m, lambda v, i: F.get(mask, i) == 1)
    first = F.element_at(m, 1)
    if how == "max":
        return let(kept, lambda k: F.when(F.size(k) > 0, F.aggregate(F.slice(k, 2, F.greatest(F.size(k), F.lit(1))), F.get(k, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: F.greatest(x, y)))))
    total = lambda k: F.aggregate(k, F.transform(first, lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return let(kept, lambda k: F.transform(total(k), lambda x: x / F.greatest(F.size(k), F.lit(1))))


#: Widest hashing embedder; tokens whose buckets a worker remembers.
_WIDEST, _REMEMBERED = 20_800, 200_000
_TOKEN = re.compile(TOKEN, re.ASCII)


def hash_embedding(text: Column, dimensions: int = 64) -> Column:
    """Feature hashing (Weinberger et al. 2009): counts of lower-cased tokens by md5 bucket, of unit length, at any width.

    Tokens are counted in Arrow batches; a worker keeps the buckets of those that it has met.
    """
    if not 0 < dimensions <= _WIDEST:
        raise ValueError(f"1 to {_WIDEST} dimensions")

    @F.pandas_udf("array<double>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                v = np.zeros(dimensions)
                for token, n in Counter(_TOKEN.findall(t)).items():
                    at = known.get(token)
                    if at is None:
                        at = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimensions
                        if len(known) < _REMEMBERED and len(token) <= 32:
                            known[token] = at
                    v[at] += n
                out.append(v)
            yield pd.Series(out, index=texts.index, dtype=object)

    return normalised(counts(F.lower(text)))
