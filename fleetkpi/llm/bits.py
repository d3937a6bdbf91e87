"""A filter of ids with a fixed size, for skipping rows before work is done on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

#: 2**23 bits, 1 MB at the driver and in each task, whatever the number of ids.
LOG_BITS = 23


class IdFilter:
    """Which ids may be wanted. Never wrong about a wanted id; lets some others pass."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def load(self) -> Callable[[np.ndarray], np.ndarray]:
        words = self.words

        def wanted(ids: np.ndarray) -> np.ndarray:
            at = mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - LOG_BITS)
            word = words[(at >> np.uint64(6)).astype(np.int64)]
            return (word >> (at & np.uint64(63))) & np.uint64(1) == 1

        return wanted


def id_filter(ids: DataFrame) -> IdFilter:
    """The filter of a column `id` of distinct ids; a table of at most 2**17 words comes to the driver."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = mix(batch["id"].to_numpy(np.int64).view(np.uint64)) >> np.uint64(64 - LOG_BITS)
            word = (at >> np.uint64(6)).astype(np.int32)
            bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pd.DataFrame({"word": word, "bit": bit})

    rows = ids.mapInPandas(places, "word int, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = rows.toPandas()
    words = np.zeros(1 << (LOG_BITS - 6), np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return IdFilter(words)
