"""Fixed schemas; nothing is inferred."""
CANDLES = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double, ingested_at timestamp_ntz"
FEATURES = "symbol string, timeframe string, ts timestamp_ntz, returns double, log_returns double, hurst double, garch_vol double, spread double, regime string, regime_conf double, computed_at timestamp_ntz"
NEWS = "id string, source string, url string, title string, body string, published_at timestamp_ntz, symbols array<string>, injection_flag boolean, injection_score double, ingested_at timestamp_ntz"
CLUSTERS = "id string, source string, published_at timestamp_ntz, cluster_id int, cluster_label string, is_noise boolean, trust_score double, computed_at timestamp_ntz"
SIGNALS = "symbol string, ts timestamp_ntz, regime string, regime_conf double, returns_1h double, returns_24h double, spread double, computed_at timestamp_ntz"
ORDERS = "order_id string, run_id string, symbol string, action string, quantity double, price double, status string, filled_at timestamp_ntz, cost_usd double, fee_usd double"
SIGNAL_LOG = "run_id string, model string, symbol string, direction string, confidence double, raw_probability double, size_usd double, created_at timestamp_ntz"
LEDGER = "model_id string, decision_date timestamp_ntz, is_rebalance boolean, universe array<struct<symbol: string, p: double, close: double>>, weights map<string, double>, prices map<string, double>"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
KLINES = "symbol string, open_time long, open double, high double, low double, close double, volume double, quote_volume double, n_trades long"
