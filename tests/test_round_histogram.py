"""Histograms with round edges against a search over all steps."""

import math
import random

import pytest
from conftest import rows

from tillwright.operators.histograms import round_histogram


def plain(values, most):
    lo, hi = min(values), max(values)
    steps = sorted(m / 10**-e if e < 0 else float(m * 10**e) for m in (1, 2, 5) for e in range(-12, 14))
    step = next(s for s in steps if math.floor(hi / s) - math.floor(lo / s) + 1 <= most) if hi > lo else 1.0
    first, last = math.floor(lo / step), math.floor(hi / step)
    return [(p - first, p * step, (p + 1) * step, sum(math.floor(v / step) == p for v in values)) for p in range(first, last + 1)]


@pytest.mark.parametrize(("low", "high", "digits", "most"), [(0, 50, 0, 20), (-3, 4, 2, 80), (1e5, 1.00001e5, 3, 12), (-1e9, 1e9, 0, 3), (0.001, 0.0017, 6, 7), (5, 5, 0, 10)])
def test_round_edges(spark, low, high, digits, most):
    rng = random.Random(1)
    values = [float(low), float(high), *[round(rng.uniform(low, high), digits) for _ in range(300)]]
    got = rows(round_histogram(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v", most))
    want = plain(values, most)
    assert [r[0] for r in got] == [r[0] for r in want] and [r[3] for r in got] == [r[3] for r in want]
    assert [r[1:3] for r in got] == [pytest.approx(r[1:3]) for r in want] and len(got) <= most


def test_nothing_to_count(spark):
    assert rows(round_histogram(spark.createDataFrame([(None,)], "v double"), "v", 5)) == []
    with pytest.raises(ValueError, match="three bins"):
        round_histogram(spark.createDataFrame([(1.0,)], "v double"), "v", 2)
