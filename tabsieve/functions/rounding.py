"""Half-up rounding of figures that already left Spark."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal


def half_up(value: float | None, digits: int) -> float | None:
    """As round() of Spark SQL: decimal digits of the shortest spelling, half up."""
    if value is None or math.isnan(value) or math.isinf(value):
        return None
    return float(Decimal(repr(float(value))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
