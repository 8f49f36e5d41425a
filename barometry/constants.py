"""Fixed values. These must equal the published settings, or results differ."""

# Macro series id -> column name, and the macro columns joined to bars.
MACRO_NAMES = {
    "VIXCLS": "vix",
    "T10Y2Y": "yield_curve_slope",
    "BAMLH0A0HYM2": "hy_spread",
    "DGS10": "rate_10y",
    "DGS2": "rate_2y",
}
MACRO_JOINED = [
    "vix", "yield_curve_slope", "hy_spread",
    "vix_term_slope", "vix_zscore", "yc_inverted", "hy_spread_zscore",
]

# Windows, in bars.
RV_WINDOWS = [5, 21, 63]
MOMENTUM_WINDOWS = [5, 21, 63]
RSI_PERIOD = 14
ATR_PERIOD = 14
TSI_SLOW, TSI_FAST, TSI_SIGNAL = 25, 13, 7
TREND_WINDOW = 21
ZSCORE_WINDOW = 252
ZSCORE_CLIP = 4.0
MACRO_TERM_LAG = 20
TRADING_DAYS = 252

# Columns never z-scored, columns that are not features, features used as they are.
ZSCORE_SKIP = [
    "time", "ticker", "rsi_norm", "tsi", "tsi_signal", "rv_ratio", "put_call_ratio",
    "yc_inverted", "trend_r", "vix_zscore", "hy_spread_zscore", "rv_21d_zscore",
]
NOT_FEATURES = [
    "time", "ticker", "open", "high", "low", "close", "volume", "log_return", "vwap", "source",
]
PASS_THROUGH = [
    "rsi_norm", "tsi", "rv_ratio", "put_call_ratio",
    "trend_r", "yc_inverted", "vix_zscore", "hy_spread_zscore",
]
MIN_FEATURE_SHARE = 0.8

# Model inputs, in order.
HMM_FEATURES = [
    "rv_21d_zscore", "rv_ratio", "rsi_norm", "tsi", "trend_r",
    "vix_zscore", "hy_spread_zscore", "mom_21d", "atr_pct", "yield_curve_slope",
]
SEQUENCE_FEATURES = [
    "rv_5d_z", "rv_21d_z", "rv_63d_z", "rv_ratio", "atr_pct_z", "rv_21d_zscore",
    "rsi_norm", "tsi", "trend_r", "mom_5d_z", "mom_21d_z", "mom_63d_z",
    "vix_zscore", "hy_spread_zscore", "yc_inverted",
    "iv_skew_proxy", "put_call_ratio", "gex_proxy",
]

# Model settings.
N_STATES = 4
HMM_ITERATIONS = 200
LOOKBACK = 60
TRAIN_SPLIT = 0.8
TRAIN_START = "2010-01-01"
MIN_LABEL_CONFIDENCE = 0.6
HMM_WEIGHT, SEQUENCE_WEIGHT = 0.4, 0.6
REGIME_NAMES = ["trending", "mean_reverting", "choppy", "high_vol"]

# Alerting, caching and storage.
LOW_CONFIDENCE = 0.5
VOL_SPIKE_LEVEL = 1.5
SIGNAL_TTL_SECONDS = 3600
FLUSH_SECONDS = 30
RETENTION_YEARS = {"bars": 2, "features": 5, "signals": 5}
DURATION_BUCKETS = [0.1, 0.5, 1.0, 5.0, 10.0, 30.0]
OHLCV_SOURCES = ["yfinance", "polygon"]
MACRO_SOURCES = ["fred", "yfinance"]
