"""Headline workloads, timed: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from seriesloom.session import local_session


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    from seriesloom.catalog import QUERIES, models, registry
    from seriesloom.constants import default_params
    from seriesloom.operators import describe, features as FX, frames, importance as IM, quality as Q, stats
    from seriesloom.operators.models import arima, smoothing
    from seriesloom.operators.models.registry import fit_predict
    from seriesloom.plans import forecast as FC, tuning

    ctx = frames.Context(12)

    def ship_frame():
        return models.frame_of(registry.ship_monthly(spark, sf), 6, 6)

    def accuracy_and_levels():
        panel = FX.append_future(registry.ship_monthly(spark, sf), 6, "month")
        levels = [0.05 * k for k in range(1, 20)] + [0.99]
        result = FC.forecast(panel, ["Naive", "Seasonal Naive", "Rolling Average", "ETS", "Theta"], ctx, 6, 6, levels)
        return result.oos_forecast

    from pyspark.sql import functions as F

    features = frames.Context(12, ("trend", "month", "year"))

    def orders_panel():
        panel = FX.append_future(registry.orders_monthly(spark, sf), 12, "month")
        return panel.withColumns({"trend": F.row_number().over(registry.P.by_date()).cast("double"),
                                  "month": F.month("date").cast("double"), "year": F.year("date").cast("double")})

    def fitted(method):
        return lambda: fit_predict(frames.model_frame(orders_panel(), frames.standard_runs(12, 12)), method, features)

    params = FX.FeatureParams(calendar=True, fourier_periods=[12], lags=[12, 24], rolls=[3, 6])
    work = {
        "daily_panel": lambda: registry.orders_daily(spark, sf),
        "parts_panel": lambda: registry.ship_monthly(spark, sf),
        "feature_frame": lambda: FX.feature_frame(registry.ship_monthly(spark, sf), params, 12, "month"),
        "impute_grid": lambda: Q.impute(registry.ship_monthly(spark, sf), "month", 12),
        "anomalies": lambda: Q.detect_anomalies(registry.ship_monthly(spark, sf), 12, 0.05, 0.2),
        "acf": lambda: describe.autocorrelation(registry.ship_monthly(spark, sf), 24),
        "hypothesis_tests": lambda: stats.test_battery(registry.ship_monthly(spark, sf)),
        "ets_grid": lambda: smoothing.ets(ship_frame(), ctx, default_params("ETS")),
        "theta": lambda: smoothing.theta(ship_frame(), ctx, {}),
        "arima": lambda: arima.sarima(ship_frame(), ctx, default_params("SARIMA")),
        "five_models_20_levels": accuracy_and_levels,
        **{name: fitted(method) for name, method in {
            "random_forest_1000": "Random Forest", "boosted_trees_1000": "Boosted Trees", "rule_model": "Cubist",
            "support_vector": "SVM", "neighbours": "KNN", "hinges": "MARS"}.items()},
        "importance_all": lambda: IM.importance(orders_panel().where("NOT is_future"), IM.METHODS, list(features.features)),
        "tune_elastic_net": lambda: tuning.tune(orders_panel(), "Elastic Net", features, 12),
        "scenario_aggregate": lambda: QUERIES["scenario_aggregate"](spark, sf),
    }
    registry.ship_monthly(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name, build in work.items():
        started = time.time()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
