"""Statistics as expressions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, n: Column, upper: bool = False) -> Column:
    """A bound of the 95 % Wilson interval of a share, within [0, 1]; 0 without cases."""
    z2 = F.lit(Z * Z)
    p = hits / F.nullif(n, F.lit(0))
    half = F.lit(Z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    centre = p + z2 / (2 * n)
    bound = (centre + half if upper else centre - half) / (1 + z2 / n)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound)), F.lit(0.0))


def index_percentile(values: Column, q: float) -> Column:
    """The value at index min(floor(n * q), n - 1) of the sorted array."""
    n = F.size(values)
    return F.element_at(F.sort_array(values), F.least(F.floor(n * F.lit(q)), n - 1).cast("int") + 1)
