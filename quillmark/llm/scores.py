"""Monotone score bins; usable (system, query, item, score) rows come from the core."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.operators.lists import exploded, list_sizes, pair_rows, system_scores

__all__ = ["exploded", "list_sizes", "pair_rows", "score_bin", "system_scores"]

#: Bins per factor of two in the distance from zero.
BINS_PER_OCTAVE = 16


def score_bin(score: Column, per_octave: int = BINS_PER_OCTAVE) -> Column:
    """Number of the bin of a score; never falls when the score rises.

    The bins are logarithmic on both sides of zero and need no minimum or maximum of the data, so one pass
    does and every scale gets the same relative width. Scores closer to zero than 2**-40 share bin 0; infinite
    scores take the outermost bins.
    """
    size = F.least(F.abs(score), F.lit(1e290))
    steps = F.floor(F.log2(F.lit(1.0) + size * F.lit(float(2**40))) * F.lit(float(per_octave)))
    return F.when(score < 0, -steps).otherwise(steps).cast("int")
