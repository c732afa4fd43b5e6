"""Names, labels and default values shared by all modules."""

ID, DATE, VALUE = "id", "date", "value"

# Frequency labels and their number of observations per season.
FREQUENCY_LABELS = {
    "Auto": None,
    "Year (1)": 1,
    "Semester (2)": 2,
    "Quarter (4)": 4,
    "Month (12)": 12,
    "Week (52)": 52,
    "Bus-day (5)": 5,
    "Day (7)": 7,
    "Hour (24)": 24,
    "Half-hour (48)": 48,
}

# Default forecast horizon by frequency.
DEFAULT_HORIZON = {1: 6, 2: 6, 4: 8, 12: 12, 13: 13, 52: 13, 5: 60, 7: 90, 24: 168, 48: 336}

# Number of autocorrelation lags as a multiple of the horizon.
ACF_LAG_MULTIPLE = {1: 2, 2: 2, 4: 3, 12: 4, 13: 4, 52: 4, 5: 1, 7: 1, 24: 1, 48: 1}

# Order in which transformations are applied.
TRANSFORMATIONS = [
    "Multiply by -1",
    "Add 1",
    "Log",
    "Box-Cox",
    "Log-Interval",
    "Min-Max",
    "Standardization",
    "Differencing",
    "Seasonal Differencing",
]

METRICS = ["mae", "mape", "mase", "smape", "rmse", "rmspe"]
AGGREGATIONS = ["sum", "mean", "median"]

# Methods by family.
METHODS = {
    "ts": ["Naive", "Seasonal Naive", "Rolling Average", "ETS", "Theta", "SARIMA", "TBATS", "STLM", "Prophet"],
    "ml": ["Linear Regression", "Elastic Net", "MARS", "KNN", "SVM", "Random Forest", "Boosted Trees", "Cubist"],
    "dl": ["Feed-Forward"],
    "mix": ["Feed-Forward AR", "ARIMA-Boost", "Prophet-Boost"],
    "aml": ["H2O AutoML"],
    "ens": ["Average", "Weighted Average", "Median"],
    "stk": ["Linear Regression", "Elastic Net", "Boosted Trees"],
    "tune": [
        "Elastic Net", "MARS", "KNN", "SVM", "Random Forest", "Boosted Trees", "Cubist",
        "Feed-Forward", "Feed-Forward AR", "ARIMA-Boost", "Prophet-Boost",
    ],
}

# Parameters of each method with their defaults.
METHOD_DEFAULTS = {
    "Naive": {},
    "Seasonal Naive": {},
    "Rolling Average": {"window_size": 12},
    "ETS": {
        "auto_ets": True, "error": "additive", "trend": "none", "season": "none",
        "damping": "none", "smooth_level": 0.1, "smooth_trend": 0.0, "smooth_season": 0.0,
    },
    "Theta": {},
    "SARIMA": {
        "auto_arima": True, "non_seasonal_ar": 0, "non_seasonal_differences": 0, "non_seasonal_ma": 0,
        "seasonal_ar": 0, "seasonal_differences": 0, "seasonal_ma": 0,
    },
    "TBATS": {
        "auto_tbats": True, "tbats_seasonal_period_1": 12, "tbats_seasonal_period_2": 0,
        "tbats_seasonal_period_3": 0,
    },
    "STLM": {
        "auto_stlm": True, "trend_model": "ETS", "stlm_seasonal_period_1": 12,
        "stlm_seasonal_period_2": 0, "stlm_seasonal_period_3": 0,
    },
    "Prophet": {
        "auto_prophet": True, "growth": "linear", "logistic_cap": 0.0, "logistic_floor": 0.0,
        "changepoint_num": 25, "changepoint_range": 0.8, "prophet_season": "additive",
        "seasonality_yearly": True, "seasonality_weekly": False, "seasonality_daily": False,
        "prior_scale_changepoints": 0.5, "prior_scale_seasonality": 10.0, "prior_scale_holidays": 10.0,
    },
    "Linear Regression": {},
    "Elastic Net": {"penalty": 1.0, "mixture": 0.5},
    "MARS": {"num_terms": 20, "prod_degree": 1, "prune_method": "backward"},
    "KNN": {"neighbors": 5},
    "SVM": {"boundary": "Linear", "cost": 1.0, "margin": 0.1, "rbf_sigma": 0.02},
    "Random Forest": {"rf_mtry": 5, "rf_trees": 1000, "rf_min_n": 5},
    "Boosted Trees": {
        "boost_method": "XGBoost", "boost_mtry": 5, "boost_trees": 1000, "boost_min_n": 1,
        "boost_tree_depth": 6, "boost_learn_rate": 0.3, "boost_loss_reduction": 0.0, "boost_sample_size": 1.0,
    },
    "Cubist": {"committees": 1, "cub_neighbors": 0, "max_rules": 20},
    "Feed-Forward": {"ff_hidden_units": 10, "ff_penalty": 0.0, "ff_epochs": 100},
    "Feed-Forward AR": {
        "ffar_non_seasonal_ar": 1, "ffar_seasonal_ar": 0, "ffar_hidden_units": 10,
        "ffar_penalty": 0.0, "ffar_epochs": 100, "ffar_num_networks": 20,
    },
    "ARIMA-Boost": {
        "arima_boost_mtry": 5, "arima_boost_trees": 100, "arima_boost_min_n": 1,
        "arima_boost_tree_depth": 6, "arima_boost_learn_rate": 0.3,
        "arima_boost_loss_reduction": 0.0, "arima_boost_sample_size": 1.0,
    },
    "Prophet-Boost": {
        "prophet_boost_mtry": 5, "prophet_boost_trees": 100, "prophet_boost_min_n": 1,
        "prophet_boost_tree_depth": 6, "prophet_boost_learn_rate": 0.3,
        "prophet_boost_loss_reduction": 0.0, "prophet_boost_sample_size": 1.0,
    },
    "H2O AutoML": {"h2o_max_time": 30, "h2o_max_time_model": 15, "h2o_nfolds": 5, "h2o_metric": "RMSE"},
}

SEED = 1992


def method_family(method: str) -> str:
    """Family code (ts, ml, dl, mix, aml, ens, stk) a method belongs to."""
    for family, methods in METHODS.items():
        if method in methods:
            return family
    raise ValueError(f"unknown method {method!r}")


# Settings of other engines that have no counterpart here: the nets and the trend model are solved in closed form, the search
# runs over a fixed list of candidates. Any value but the default is refused rather than ignored.
WITHOUT_EFFECT = {"ff_epochs", "ffar_epochs", "auto_prophet", "boost_method", "h2o_max_time", "h2o_max_time_model",
                  "h2o_nfolds"}


def default_params(method: str, overrides: dict | None = None) -> dict:
    """Defaults of a method, with overrides checked against its parameter names."""
    if method not in METHOD_DEFAULTS:
        raise ValueError(f"unknown method {method!r}")
    params = dict(METHOD_DEFAULTS[method])
    unknown = set(overrides or {}) - set(params)
    if unknown:
        raise ValueError(f"{method} has no parameters {sorted(unknown)}")
    idle = sorted(k for k, v in (overrides or {}).items() if k in WITHOUT_EFFECT and v != params[k])
    if idle:
        raise ValueError(f"{method} cannot change {idle}")
    params.update(overrides or {})
    return params
