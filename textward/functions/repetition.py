"""Whether a block of ten characters or more stands eleven times in a row, within a line and whatever the case.

As a back-reference this costs the product of text length and block lengths in a regex engine. Here each place gets the distance
to the next place where the same ten characters stand, from one sort: within a repetition of period p that distance is p all
along, so one pass over the runs of equal distances tells, in n log n steps whatever the periods are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

SHORTEST, COPIES = 10, 11
_FACTORS = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, SHORTEST + 1, dtype=np.uint64)


def repeats(text: str) -> bool:
    low = text.lower()
    n = len(low)
    if n < SHORTEST * COPIES:
        return False
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(points == 10)
    points[ends] = 0x110000 + np.arange(len(ends), dtype=np.uint64)  # no two line ends are alike, so none is in a repetition
    m = n - SHORTEST + 1
    grams = np.zeros(m, np.uint64)
    for k in range(SHORTEST):
        grams += (points[k : k + m] ^ (points[k : k + m] << np.uint64(25))) * _FACTORS[k]
    order = np.argsort(grams, kind="stable")
    again = grams[order[1:]] == grams[order[:-1]]
    if again.sum() <= SHORTEST * (COPIES - 2):
        return False  # of a repetition, the places but those of the last block and less stand again
    distance = np.zeros(m, np.int64)
    distance[order[:-1][again]] = order[1:][again] - order[:-1][again]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(distance)) + 1])
    lengths = np.diff(np.append(starts, m))
    period = distance[starts]
    block = period * -(-SHORTEST // np.maximum(period, 1))
    # equal distances at r places: that many characters and nine more equal those a period further
    for k in np.flatnonzero((period > 0) & (lengths + SHORTEST - 1 + period >= block * COPIES)).tolist():
        a, p, span = starts[k], period[k], int(lengths[k] + SHORTEST - 1)
        if (points[a : a + span] == points[a + p : a + p + span]).all():  # not a collision of hashes
            return True
    return False


def repetition():
    """The Arrow function; a null text gives a null."""

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([repeats(t) if t is not None else None for t in texts], dtype="object")

    # called nondeterministic, so that the optimizer neither repeats it nor moves it into the expressions that use it
    return found.asNondeterministic()
