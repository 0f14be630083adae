"""Tables over schedules are made from the figures that the grid publishes, as their SQL makes them.

The SQL itself answers a mean that ends on half a digit either way from run to
run, so the expected values are worked out in decimals here.
"""

from decimal import ROUND_HALF_UP, Decimal
from statistics import mean, stdev

import pytest

import __spark_entry__ as entry

SOURCE = "/root/testdata/sf0.01"
MEASURES = ("annualised_return", "sharpe_ratio", "maximum_drawdown")


def _six(value):
    return float(value.quantize(Decimal("1e-6"), ROUND_HALF_UP))


@pytest.fixture(scope="module")
def published(spark):
    return [r.asDict() for r in entry.queries()["robustness_grid"](spark, SOURCE).collect()]


def _figures(rows):
    out = {"offsets": len(rows)}
    for m in MEASURES:
        values = [Decimal(str(r[m])) for r in rows]
        out |= {f"mean_{m}": _six(mean(values)), f"min_{m}": _six(min(values)), f"max_{m}": _six(max(values))}
        out[f"std_{m}"] = _six(stdev(values)) if len(values) > 1 else None
    return out


def test_offset_sensitivity_is_made_from_published_figures(spark, published):
    got = entry.queries()["offset_sensitivity"](spark, SOURCE).collect()
    assert len(got) == 40
    for row in got:
        own = [r for r in published if (r["book"], r["frequency"], r["cost_bps"]) == (row.book, row.frequency, row.cost_bps)]
        assert {k: row[k] for k in _figures(own)} == _figures(own)


def test_candidate_scorecard_is_made_from_published_figures(spark, published):
    got = entry.queries()["candidate_scorecard"](spark, SOURCE).collect()
    assert len(got) == 2
    for row in got:
        frequency = {"Momentum": 21, "Volatility": 10}[row.book]
        own = [r for r in published if (r["book"], r["frequency"], r["cost_bps"]) == (row.book, frequency, 10.0)]
        assert {k: row[k] for k in _figures(own)} == _figures(own)
        first = next(Decimal(str(r["annualised_return"])) for r in own if r["offset"] == 0)
        gap = first - mean(Decimal(str(r["annualised_return"])) for r in own)
        assert row.headline_minus_mean_return == _six(gap)
