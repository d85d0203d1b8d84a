"""Engine-independent rounding.

``round`` on a double rounds the decimal rendering half-up in Spark but the
binary value in many SQL engines, so a value printed as ...5 can round apart.
``half_up`` computes floor(x * 10^d + 0.5) / 10^d with plain IEEE operations,
which every engine evaluates identically.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column | str, digits: int) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    s = float(10 ** digits)
    return F.floor(c * F.lit(s) + F.lit(0.5)).cast("double") / F.lit(s)
