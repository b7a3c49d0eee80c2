"""Phred arithmetic as Column expressions.

Quality is logarithmic, so every mean goes through error probabilities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from runqc.functions.common import col_of

MAX_Q = 60.0
PHRED_OFFSET = 33


def error_prob(q: Column | str) -> Column:
    return F.pow(F.lit(10.0), -col_of(q) / F.lit(10.0))


def to_qscore(p: Column | str, max_q: float = MAX_Q) -> Column:
    """-10 log10 p, capped; non-positive probabilities give the cap, NULL stays NULL."""
    p = col_of(p)
    return F.when(p <= 0, F.lit(max_q)).when(
        p.isNotNull(), F.least(F.lit(-10.0) * F.log10(p), F.lit(max_q))
    )


def accuracy_pct(q: Column | str) -> Column:
    return (F.lit(1.0) - error_prob(q)) * 100


def mean_q(q: Column | str, max_q: float = MAX_Q) -> Column:
    """Aggregate: Phred mean, 0 for an empty group."""
    return F.coalesce(to_qscore(F.avg(error_prob(q)), max_q), F.lit(0.0))


def weighted_mean_q(q: Column | str, weight: Column | str, max_q: float = MAX_Q) -> Column:
    """Aggregate: Phred mean weighted by e.g. bases; 0 when the weights do not sum above 0."""
    w = F.when(col_of(q).isNotNull(), col_of(weight).cast("double"))
    total = F.sum(w)
    p = F.try_divide(F.sum(error_prob(q) * w), total)
    return F.when(total > 0, to_qscore(p, max_q)).otherwise(F.lit(0.0))


def quality_values(qual: Column | str) -> Column:
    """Phred+33 string to an array of integer qualities."""
    return F.transform(F.split(col_of(qual), ""), lambda c: F.ascii(c) - PHRED_OFFSET)


def string_mean_q(qual: Column | str, max_q: float = MAX_Q) -> Column:
    """Mean quality of one read from its Phred+33 string, 0 for an empty one.

    One pass over the characters of a batch with a table of the 94 printable qualities; NULL where others occur.
    """
    qual = col_of(qual)
    total = _error_sum()(qual)
    return F.when(F.length(qual) > 0, to_qscore(total / F.length(qual), max_q)).otherwise(F.lit(0.0))


def _error_sum():
    """Arrow UDF (qual) -> sum of the error probabilities, added up in the order of the string."""

    @F.pandas_udf("double")
    def run(quals: pd.Series) -> pd.Series:
        texts = [t or "" for t in quals]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) - PHRED_OFFSET
        table = np.append(10.0 ** (-np.arange(94) / 10.0), np.nan)
        weights = table[np.where((codes < 0) | (codes > 93), 94, codes)]
        return pd.Series(np.bincount(np.repeat(np.arange(len(texts)), lengths), weights, len(texts)))

    return run


def edit_quality(distance: Column | str, ref_length: Column | str) -> Column:
    """Quality implied by an edit distance, the rate kept inside [1/L^2, 1]; 0 when L is 0."""
    ed, length = col_of(distance).cast("double"), col_of(ref_length).cast("double")
    safe = F.when(length > 0, length)
    rate = F.least(F.greatest(F.lit(1.0) / (safe * safe), ed / safe), F.lit(1.0))
    return (
        F.when(length == 0, F.lit(0.0))
        .when(ed.isNotNull(), F.lit(-10.0) * F.log10(rate))
    )
