"""UDF1, VEC9, VEC10: the embedding port. A deterministic hashing embedder stands in where no model is supplied."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = regex.compile(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*")
EmbedFn = Callable[[list[str]], list[np.ndarray]]


def hashing(texts: list[str], dim: int = 64) -> list[np.ndarray]:
    """Unit vector of hashed words and word pairs; independent of the batch. A text without words gives the first axis."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        w = _WORD.findall(t.lower())
        for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
            h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            v[h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else np.eye(1, dim)[0]).astype(np.float32))
    return out


def embed(rows: DataFrame, text: str, fn: EmbedFn = hashing) -> DataFrame:
    """The rows with ``embedding``; equal texts are embedded once (VEC10), null texts get null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(fn(t.tolist()), dtype=object)

    memo = rows.where(F.col(text).isNotNull()).select(text).distinct().withColumn("embedding", run(text))
    return rows.join(memo, text, "left")
