"""Shot geometry on a full court, coordinates in tenths of a foot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Basket positions on a 94 x 50 ft court, arc distance, corner rule.
BASKETS = ((52.5, 250.0), (887.5, 250.0))
ARC_FT = 22.15
CORNER_OFFSET_FT = 17.0
# Shot ranges in feet, lower bound included.
RANGES = (("d0_3", 0.0, 3.0), ("d3_10", 3.0, 10.0), ("d10_16", 10.0, 16.0),
          ("d16_arc", 16.0, ARC_FT), ("d_three", ARC_FT, 999.0))


def shot_distance_ft(x, y) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.least(*[F.hypot(x - bx, y - by) for bx, by in BASKETS]) / 10.0


def lateral_offset_ft(y) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return F.abs(y - 250.0) / 10.0


def in_range(distance: Column, lo: float, hi: float) -> Column:
    return (distance >= lo) & (distance < hi)


def is_corner_three(distance: Column, y) -> Column:
    return (distance >= ARC_FT) & (lateral_offset_ft(y) >= CORNER_OFFSET_FT)
