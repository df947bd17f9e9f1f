"""Learning-rate schedules as functions of the step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(step: Column, warm: int, total: int, cycles: float = 0.5) -> Column:
    """The factor at a step: rising over `warm` steps, then `cycles` waves of a cosine down to 0 at `total`."""
    progress = (step - warm) / float(max(1, total - warm))
    wave = 0.5 * (1 + F.cos(F.pi() * 2.0 * cycles * progress))
    return F.when(step < warm, step / float(max(1, warm))).otherwise(F.greatest(F.lit(0.0), wave))
