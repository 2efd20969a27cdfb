"""Ratcliff-Obershelp similarity; Spark has no built-in with these results (Levenshtein differs)."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity_to(candidate: str, text: Column, threshold: float) -> Column:
    """The ratio of ``candidate`` and ``text``, or null where it is below ``threshold`` (two upper bounds go first)."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for value in batch:
                if value is None:
                    out.append(None)
                elif value == candidate:
                    out.append(1.0)
                else:
                    m = SequenceMatcher(None, candidate, value)
                    near = m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold
                    got = m.ratio() if near else 0.0
                    out.append(got if got >= threshold else None)
            yield pd.Series(out, dtype="float64")

    return ratio(text)
