"""Texts to vectors of length one, by any model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

Model = Callable[[list[str]], np.ndarray]


def embedder(load: Callable[[], Model]) -> Callable:
    """A function of a text column. `load` gives a model (texts to rows of numbers), once for each task; a row without a
    direction stays zero. A null text is empty."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows = np.asarray(model(["" if t is None else t for t in texts]), np.float64)
            length = np.sqrt(np.einsum("ij,ij->i", rows, rows)) if len(rows) else np.zeros(0)
            yield pd.Series(list((rows / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)) if len(rows) else [], dtype=object)

    return run


def hashed(size: int = 64, token: str = r"[^\W_]+") -> Callable[[], Model]:
    """The stand-in where no model is plugged in: signed counts of hashed words, in lower case. A text whose words cancel
    each other out gets their plain counts, so that only one without a word is zero."""
    def load() -> Model:
        words = re.compile(token)

        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for i, text in enumerate(texts):
                hashes = [crc32(w.lower().encode()) for w in words.findall(text)]
                for h in hashes:
                    out[i, h % size] += 1.0 if h & 0x80000000 else -1.0
                if hashes and not out[i].any():
                    for h in hashes:
                        out[i, h % size] += 1.0
            return out

        return model

    return load
