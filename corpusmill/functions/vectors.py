"""Column functions for vectors, and the hash embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64


#: Texts whose tokens are held at once: a batch may have 10,000 long ones.
AT_ONCE = 256
#: Tokens whose bucket a Python worker remembers.
REMEMBERED = 1 << 18


class TokenCodes(dict):
    """Codes of tokens, looked up or made."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = code = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
        return code


def hash_embedding(text: Column, dimensions: int = DIMENSIONS, unit: bool = False) -> Column:
    """Signed token counts by hash bucket, of unit length if asked for: an embedder that needs no model.

    AT_ONCE texts are one array of token codes, counted at once; null gives null. Counts are whole, so that their length is exact in any order.
    """

    @F.arrow_udf("array<double>")
    def counts(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token, known = re.compile("[a-z0-9']+"), TokenCodes()
        for texts in it:
            parts = []
            for a in range(0, len(texts), AT_ONCE):
                found = [token.findall(t) if t is not None else [] for t in texts[a : a + AT_ONCE].to_pylist()]
                codes = np.array([known[t] for ts in found for t in ts], np.int64)
                rows = np.repeat(np.arange(len(found)), [len(ts) for ts in found])
                signs = 1.0 - 2.0 * (codes // dimensions % 2)
                table = np.bincount(rows * dimensions + codes % dimensions, weights=signs, minlength=len(found) * dimensions).astype(float, copy=False).reshape(len(found), dimensions)  # whole numbers where there is no token
                if unit:
                    n = np.sqrt((table * table).sum(axis=1, keepdims=True))
                    table = np.divide(table, n, out=table, where=n > 0)
                parts.append(table.ravel())
            flat = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimensions), pa.array(flat), mask=texts.is_null() if texts.null_count else None)

    return counts(F.lower(text))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Of unit length; a zero vector stays as it is."""
    return F.get(F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["n"])).otherwise(F.transform(s["v"], lambda x: x.cast("double")))), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)

