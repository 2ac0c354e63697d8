"""The few scalar functions that Spark has no expression for, over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as ST

ALIGNMENT = ST.StructType([ST.StructField(n, ST.IntegerType()) for n in ("distance", "start", "end")])


@F.pandas_udf(ST.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition."""
    return text.str.normalize("NFC")


def fitting_alignment(quote: str, window: str) -> tuple[int, int, int, list[int]]:
    """(distance, start, end, place of each character) of the stretch of ``window`` that ``quote`` as a whole is nearest to: the first of the
    earliest-ending ones; in tracing back a substitution comes before a dropped character."""
    import numpy as np

    m, n = len(quote), len(window)
    letters = np.array([ord(c) for c in window], np.int32)
    steps = np.arange(n + 1)
    table = np.zeros((m + 1, n + 1), np.int32)
    table[:, 0] = np.arange(m + 1)
    for i in range(1, m + 1):
        row = np.empty(n + 1, np.int32)
        row[0] = i
        row[1:] = np.minimum(table[i - 1, :-1] + (letters != ord(quote[i - 1])), table[i - 1, 1:] + 1)
        table[i] = np.minimum.accumulate(row - steps) + steps
    j = int(table[m].argmin())
    end, i, places = j, m, [0] * m + [j]
    while i:
        if j and table[i, j] == table[i - 1, j - 1] + (quote[i - 1] != window[j - 1]):
            i, j = i - 1, j - 1
            places[i] = j
        elif table[i, j] == table[i - 1, j] + 1:
            i -= 1
            places[i] = j
        else:
            j -= 1
    return int(table[m, end]), j, end, places


@F.pandas_udf(ALIGNMENT)
def aligned(quote: pd.Series, window: pd.Series) -> pd.DataFrame:
    """Edit distance of a text to the nearest stretch of another, with the stretch."""
    rows = [fitting_alignment(q, w)[:3] if q is not None and w is not None else (None, None, None) for q, w in zip(quote, window, strict=True)]
    return pd.DataFrame(rows, columns=["distance", "start", "end"])
