"""Published figures of a monetary panel, from public monthly series that the repository doesn't hold.

MACRO_DATA_DIR names a folder with fred_macro_monthly.csv, shocks_fed_jk_m.csv and shocks_fed_jk_t.csv; without it
these tests are skipped.
"""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import calendar, kernels, scores
from strandline.session import settled
from strandline.sources import scan

FOLDER = os.environ.get("MACRO_DATA_DIR", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="MACRO_DATA_DIR is not set")

#: The three largest amplifications of each target, to six decimals.
LARGEST = {
    "plain": {"2019-06-01": 2.190934, "2019-07-01": 2.183938, "2019-09-01": 2.167086},
    "filtered": {"2019-10-01": 1.514343, "2020-01-01": 1.506849, "2019-09-01": 1.504631},
    "signature": {"2020-03-01": 1.775551, "2020-02-01": 1.761110, "2020-01-01": 1.658789},
}
#: Their correlations over common months.
CORRELATIONS = {("plain", "filtered"): 0.736188287, ("plain", "signature"): 0.742027267, ("filtered", "signature"): 0.987511240}
OUTCOMES = ["ip", "cpi", "unrate", "gs2", "baa10y"]


@pytest.fixture(scope="module")
def taus(spark):
    macro = scan.read_csv(spark, f"{FOLDER}/fred_macro_monthly.csv", "date date, ip double, cpi double, unrate double, gs2 double, baa10y double")
    shocks = scan.read_csv(spark, f"{FOLDER}/shocks_fed_jk_m.csv", "year int, month int, pc1_hf double, SP500_hf double, MP_pm double, CBI_pm double, MP_median double, CBI_median double")
    shocks = shocks.select(F.make_date("year", "month", F.lit(1)).alias("date"), F.coalesce("MP_median", "MP_pm").alias("shock"), F.coalesce("CBI_median", "CBI_pm").alias("control"))
    panel = macro.join(shocks, "date", "left").filter("date >= DATE'1991-10-01'").dropna(subset=OUTCOMES)
    for name in ("ip", "cpi"):
        panel = panel.withColumn(name, 100 * F.log(name))
    panel = settled(calendar.indexed(calendar.complete_months(panel).withColumn("variant", F.lit("headline")), ["variant"]))
    psi = kernels.ridge_scores(scores.design(panel, OUTCOMES, "shock", "control", 24, 12), 24, 5)
    vectors = kernels.score_vectors(settled(psi)).cache()
    dates = panel.select("t", F.col("date").cast("string").alias("date"))
    made = {"plain": kernels.tau_resolvent(vectors), "filtered": kernels.hac_target(vectors, 12), "signature": kernels.volterra_target(vectors, 12, 5, 2)}
    return {k: {r.date: r.tau for r in v.join(dates, "t").collect()} for k, v in made.items()}


@pytest.mark.parametrize("target", list(LARGEST))
def test_largest_months(taus, target):
    got = sorted(taus[target].items(), key=lambda x: -x[1])[:3]
    assert {d: round(x, 6) for d, x in got} == LARGEST[target]


def test_correlations(taus):
    for (a, b), want in CORRELATIONS.items():
        common = sorted(set(taus[a]) & set(taus[b]))
        assert abs(np.corrcoef([taus[a][d] for d in common], [taus[b][d] for d in common])[0, 1] - want) < 1e-7


def test_events_by_month(spark):
    kinds = "start string, pc1 double, SP500 double, MP_pm double, CBI_pm double, MP_median double, CBI_median double"
    events = scan.read_csv(spark, f"{FOLDER}/shocks_fed_jk_t.csv", kinds).withColumn("ts", F.to_timestamp("start"))
    rows = calendar.events_by_month(events, "ts", "MP_median", "MP_pm").collect()
    assert sum(r.n_events for r in rows) == 309 and sum(r.missing_events for r in rows) == 4
    assert sum(r.fallback_event for r in rows) == 4 and sum(r.mixed_events for r in rows) == 3
    assert sum(r.n_events == 0 for r in rows) == 126 and sum(r.n_events > 1 for r in rows) == 21
