"""Congestion metric expressions: load, percent, grade, colour.

Rounding is done in integers so that every engine agrees (half away from
zero on non-negative values):

* ``load(x) = round(x / 19)`` for ``x >= 0``  ->  ``(2x + 19) div 38``
  (x/19 never lands on .5, so there are no ties to break);
* ``pct1(a, b) = round(100 a / b, 1)``         ->  ``((2000a + b) div 2b) / 10``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from odspark.constants import (COLOR_ANCHORS, DISTANCE_BANDS, DISTANCE_TOP, GRADE_BANDS,
                               GRADE_TOP, MARKER_MIN_RADIUS, MARKER_PCT_STEP, SERVICE_HOURS,
                               TEXT_WHITE_ABOVE_PCT)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """Integer division of longs (no detour over doubles)."""
    return F.call_function("div", _c(a).cast("long"), _c(b).cast("long"))


def hourly_load(onboard) -> Column:
    """Negative on-board counts are 0; otherwise the mean per service hour,
    rounded half up. NULL stays NULL."""
    x = _c(onboard).cast("long")
    return (F.when(x < 0, F.lit(0).cast("long"))
            .otherwise(div(x * 2 + SERVICE_HOURS, F.lit(2 * SERVICE_HOURS))))


def pct1(num, den) -> Column:
    """``round(num * 100 / den, 1)`` half up for ``num >= 0, den > 0``;
    NULL when ``den`` is 0 or NULL."""
    a = _c(num).cast("long")
    b = F.nullif(_c(den).cast("long"), F.lit(0).cast("long"))
    return div(a * 2000 + b, b * 2) / F.lit(10.0)


def grade(pct) -> Column:
    p = _c(pct)
    expr = None
    for bound, label in GRADE_BANDS:
        expr = F.when(p < bound, label) if expr is None else expr.when(p < bound, label)
    return expr.otherwise(GRADE_TOP)


def gradient_color(pct) -> Column:
    """Five-anchor colour ramp over 0..100 %, channels truncated, ``#RRGGBB``."""
    ratio = F.greatest(F.lit(0.0), F.least(_c(pct).cast("double") / F.lit(100.0), F.lit(1.0)))
    scaled = ratio * F.lit(4.0)
    idx = F.floor(F.least(scaled, F.lit(3.0))).cast("int")
    t = scaled - idx
    chans = []
    for ch in range(3):
        arr = F.array(*[F.lit(a[ch]) for a in COLOR_ANCHORS])
        lo = F.element_at(arr, idx + 1)
        hi = F.element_at(arr, idx + 2)
        chans.append(F.floor(lo + (hi - lo) * t).cast("int"))
    return F.format_string("#%02X%02X%02X", *chans)


def text_color(pct) -> Column:
    return F.when(_c(pct) > TEXT_WHITE_ABOVE_PCT, "white").otherwise("black")


def marker_radius(pct) -> Column:
    return F.greatest(F.lit(MARKER_MIN_RADIUS),
                      (F.floor(_c(pct) / MARKER_PCT_STEP) + MARKER_MIN_RADIUS).cast("int"))


def distance_band(dist) -> Column:
    d = _c(dist)
    expr = None
    for bound, label in DISTANCE_BANDS:
        expr = F.when(d < bound, label) if expr is None else expr.when(d < bound, label)
    return expr.otherwise(DISTANCE_TOP)  # NULL distance lands here, as in SQL CASE
