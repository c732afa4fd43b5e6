import pytest
from pyspark.sql import functions as F

from seriesloom.operators import describe as D
from seriesloom.operators import quality as Q
from seriesloom.operators import stats as S
from seriesloom.functions import distributions as X
from tests.conftest import panel_of, seasonal


def test_decomposition_adds_up(panel):
    out = D.decompose(panel, 12)
    gap = F.abs(F.col("value") - F.col("trend") - F.col("season") - F.col("remainder"))
    assert out.agg(F.max(gap)).first()[0] < 1e-9


def test_impute_restores_a_smooth_series(spark):
    full = seasonal(72)
    holed = [v if k not in (20, 21, 40) else None for k, v in enumerate(full)]
    df = panel_of(spark, {"a": holed}).where("value IS NOT NULL")
    out = Q.impute(df, "month", 12).orderBy("date").collect()
    assert len(out) == 72 and sum(r["imputed"] for r in out) == 3
    for k in (20, 21, 40):
        assert out[k]["value"] == pytest.approx(full[k], rel=0.03)


def test_anomaly_is_found_and_cleaned(spark):
    values = [v + 0.3 * ((k * 37) % 11 - 5) for k, v in enumerate(seasonal(96))]
    values[50] += 400
    df = panel_of(spark, {"a": values})
    out = Q.detect_anomalies(df, 12, 0.05, 0.2)
    flagged = {r["date"]: r for r in out.where("anomaly = 'Yes'").collect()}
    when = df.orderBy("date").collect()[50]["date"]
    assert when in flagged and flagged[when]["anomaly_direction"] == 1
    clean = Q.clean_anomalies(df, out).where(F.col("date") == when).first()["value"]
    assert abs(clean - seasonal(96)[50]) < 150
    capped = Q.detect_anomalies(df, 12, 5.0, 0.05).where("anomaly = 'Yes'").count()
    assert capped <= 4


def test_pacf_of_an_autoregression(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = [0.0]
    for _ in range(1999):
        x.append(0.7 * x[-1] + rng.normal())
    import datetime

    start = datetime.datetime(2000, 1, 1)
    df = spark.createDataFrame([("a", start + datetime.timedelta(days=k), float(v)) for k, v in enumerate(x)],
                               "id string, date timestamp_ntz, value double")
    out = {r["lag"]: r for r in D.autocorrelation(df, 5).collect()}
    assert out[1]["pacf"] == pytest.approx(0.7, abs=0.06) and abs(out[2]["pacf"]) < 0.08
    assert out[2]["acf"] == pytest.approx(0.49, abs=0.08)
    tests = {r["test"]: r for r in S.test_battery(df).collect()}
    assert len(tests) == 7
    assert tests["Augmented Dickey-Fuller"]["p_value"] <= 0.01 and tests["Ljung-Box"]["p_value"] < 0.001
    assert tests["Jarque-Bera"]["p_value"] > 0.01 and tests["Phillips-Perron"]["p_value"] <= 0.01


def test_tails():
    assert X.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert X.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert X.chi2_tail(24.995790, 15) == pytest.approx(0.05, abs=1e-6)
    import numpy as np

    # published example: W = 0.79, p = 0.004 for these 11 weights
    w, p = X.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.003)


def test_frequency_and_profile(panel):
    row = D.series_profile(panel).where("id = 'a'").first()
    assert (row["frequency"], row["horizon"], row["n_assess"], row["acf_lags"]) == (12, 12, 17, 48)
