"""Row-level rules as column expressions: parsing, regimes, sizing, modulation, scoring."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE = 1e-9  # decides halves the same way on every engine

# Regime names and thresholds, taxonomy words, source weights.
REGIME_NAMES = {"trending": "trending", "mean_reverting": "mean-reverting", "random_walk": "volatile"}
BULLISH = ("protocol_upgrade", "listing", "adoption", "partnership")
BEARISH = ("regulatory", "hack")
TAXONOMY = (
    ("hack", ("hack", "exploit", "breach", "stolen", "drain")),
    ("regulatory", ("sec", "regulation", "lawsuit", "ban", "cftc", "doj")),
    ("protocol_upgrade", ("upgrade", "fork", "hard fork", "merge", "eip", "bip")),
    ("listing", ("listing", "listed", "exchange add", "now trading")),
    ("partnership", ("partnership", "partner", "collaboration")),
    ("adoption", ("adopt", "accept", "integrate")),
    ("whale_movement", ("whale", "transfer", "wallet", "on-chain", "accumulat")),
    ("macro", ("fed", "interest rate", "cpi", "inflation", "gdp", "macro")),
)
OTHER_LABEL = "market_sentiment"
SOURCE_WEIGHTS = {"whale_alert": 1.0, "cryptopanic": 0.7, "coindesk_rss": 0.6, "cointelegraph_rss": 0.6, "decrypt_rss": 0.6}
SYMBOL_NAMES = {"BTC": "bitcoin", "ETH": "ethereum", "SOL": "solana", "BNB": "binance", "AVAX": "avalanche", "MATIC": "polygon"}


def lookup(col: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Map lookup of a small fixed table; the column itself when no default is given."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col), col if default is None else F.lit(default))


# ---- parsing -----------------------------------------------------------------------------------
def epoch_to_ts(x: Column) -> Column:
    """Milliseconds, or microseconds from 1e14 on, to a naive UTC timestamp."""
    ms = F.when(x >= 10**14, F.floor(x / 1000)).otherwise(x)
    return F.timestamp_millis(ms.cast("long")).cast("timestamp_ntz")


def parse_time(text: Column, fallback: Column) -> Column:
    """ISO, RFC 822 or epoch-seconds text to naive UTC; anything else becomes the fallback. ISO
    text with an offset keeps its own wall clock, as does RFC 822 text."""
    iso = F.regexp_replace(F.regexp_replace(text, "T", " "), r"(Z|[+-]\d\d:?\d\d)$", "")
    rfc = F.trim(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s*([A-Z]{2,4}|[+-]\d{4})$", ""))
    epoch = F.when(text.rlike(r"^\d+$"), F.timestamp_seconds(text.try_cast("long")))
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), iso.try_cast("timestamp_ntz")),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz"),
        epoch.cast("timestamp_ntz"),
        fallback,
    )


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Named entities decoded without leaving the JVM (numeric ones are handled by rule).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_html(text: Column) -> Column:
    """Tags and comments out, entities decoded, white space collapsed, over the whole text."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->|<[^>]*>", "")
    for name, ch in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(ch))
    return squash(x)


def infer_symbols(text: Column, watch: Sequence[str]) -> Column:
    """Tickers whose base or full name occurs in the text, in watch-list order."""
    low = F.lower(text)
    hits = []
    for s in watch:
        base = s.split("/")[0].upper()
        hit = low.contains(base.lower())
        if base in SYMBOL_NAMES:
            hit = hit | low.contains(SYMBOL_NAMES[base])
        hits.append(F.when(hit, F.lit(base)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def topic(text: Column, word_boundary: bool = False) -> Column:
    """First matching class of the taxonomy, in its order."""
    low = F.lower(text)
    out = None
    for label, words in TAXONOMY:
        body = "|".join(words)
        hit = low.rlike(rf"\b({body})\b" if word_boundary else body)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(OTHER_LABEL)


def sentiment(label: Column, bullish: Sequence[str] = BULLISH, bearish: Sequence[str] = BEARISH) -> Column:
    return F.when(label.isin(*bullish), 0.6).when(label.isin(*bearish), -0.4).otherwise(0.0)


# ---- market rules ----------------------------------------------------------------------------
def regime(h: Column) -> Column:
    """Struct (label, confidence) from the Hurst exponent."""
    name = F.when(h > 0.55, "trending").when(h < 0.45, "mean_reverting").when(h.isNotNull(), "random_walk")
    conf = F.when(h > 0.55, (h - 0.55) / 0.45).when(h < 0.45, (0.45 - h) / 0.45).otherwise(1 - F.abs(h - 0.5) / 0.05)
    return F.struct(name.alias("label"), F.round(conf, 3).alias("confidence"))


def range_ratio(high: Column, low: Column, close: Column) -> Column:
    return (high - low) / F.nullif(close, F.lit(0.0))


def weekday(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def pay_day(ts: Column, days: Sequence[int] = (1, 2, 3, 14, 15, 16, 17)) -> Column:
    return F.dayofmonth(ts).isin(*days).cast("int")


def from_probability(p: Column, buy: float = 0.65, sell: float = 0.25) -> Column:
    side = F.when(p > buy, "BUY").when(p <= sell, "SELL").otherwise("HOLD")
    return F.struct(side.alias("direction"), (2 * F.abs(p - 0.5)).alias("confidence"))


def to_probability(direction: Column, confidence: Column) -> Column:
    return F.when(direction == "BUY", 0.5 + confidence / 2).when(direction == "SELL", 0.5 - confidence / 2).otherwise(0.5)


def kelly_size(conf: Column, capital: float, fraction: float | Column, vol: Column) -> Column:
    scale = F.when(vol > 0, F.least(F.lit(1.0), 0.01 / F.nullif(vol, F.lit(0.0)))).otherwise(1.0)
    return capital * conf * fraction * scale


def var_ok(vol: Column, size: Column, capital: float, limit: float | Column, hours: int = 24) -> Column:
    """Two-sigma loss over the horizon within the limit; unknown vol passes."""
    return F.coalesce(size * vol * 2 * (hours ** 0.5) <= capital * limit, F.lit(True))


def news_modulate(conf: Column, action: Column, label: Column, trust: Column,
                  bullish: Sequence[str] = ("protocol_upgrade", "listing")) -> Column:
    """x1.2 when the news agrees, x0.6 when it contradicts, another x0.7 on low trust; at most 1,
    3 decimals. Only actionable signals with a directional label are touched."""
    lean = F.when(label.isin(*bullish), "BUY").when(label.isin(*BEARISH), "SELL")
    k = F.when(lean == action, 1.2).otherwise(0.6) * F.when(trust < 0.5, 0.7).otherwise(1.0)
    return F.when(action.isin("BUY", "SELL") & lean.isNotNull(), F.round(F.least(F.lit(1.0), conf * k) + TIE, 3)).otherwise(conf)


def gated_signal(label: Column, conf: Column, h: Column, ret_1h: Column, ret_24h: Column, vol: Column) -> Column:
    """Five gates to (action, confidence): regime, Hurst, minimum move (24h follows a trend, 1h is
    faded in a reverting market), volatility, minimum confidence."""
    trend = (label == "trending") & ~F.coalesce(h < 0.52, F.lit(False))
    revert = (label == "mean-reverting") & ~F.coalesce(h > 0.48, F.lit(False))
    v = F.when(vol > 0, vol).otherwise(0.0)
    side = (F.when(trend & (ret_24h > 0.002), "BUY").when(trend & (ret_24h < -0.002), "SELL")
            .when(revert & (ret_1h < -0.002), "BUY").when(revert & (ret_1h > 0.002), "SELL"))
    raw = conf * F.when(trend, 0.8).otherwise(0.6) * (1 - 0.5 * F.least(v / 0.08, F.lit(1.0)))
    go = side.isNotNull() & (v <= 0.08) & (raw >= 0.25)
    return F.struct(F.when(go, side).otherwise("HOLD").alias("action"),
                    F.when(go, F.round(F.least(raw, F.lit(0.95)) + TIE, 3)).otherwise(0.0).alias("confidence"))


def short_confirmed(direction: Column, conf: Column, h: Column, ret_24h: Column) -> Column:
    """A short needs confidence, persistence and a falling day; otherwise it becomes HOLD."""
    ok = (conf >= 0.5) & (h >= 0.5) & (ret_24h < 0)
    return F.when((direction == "SELL") & ~F.coalesce(ok, F.lit(False)), "HOLD").otherwise(direction)


def compound_fx(r: Column, fx: Column) -> Column:
    return (1 + r) * (1 + F.coalesce(fx, F.lit(0.0))) - 1


def logistic_score(model: Mapping, features: Mapping[str, Column] | None = None) -> Column:
    """Frozen logistic model as one expression: 1/(1+exp(-(b + sum coef*(x-mean)/scale)))."""
    z = F.lit(float(model["intercept"]))
    for f, w, m, s in zip(model["features"], model["coef"], model["mean"], model["scale"], strict=True):
        x = features[f] if features else F.col(f)
        z = z + float(w) * (x - float(m)) / float(s)
    return 1 / (1 + F.exp(-z))


def attribution(model: Mapping, top: int | None = None) -> Column:
    """Per-row linear contributions, largest magnitude first."""
    items = F.array(*[
        F.struct((-F.abs(float(w) * (F.col(f) - float(m)) / float(s))).alias("k"), F.lit(f).alias("feature"),
                 (float(w) * (F.col(f) - float(m)) / float(s)).alias("contribution"))
        for f, w, m, s in zip(model["features"], model["coef"], model["mean"], model["scale"], strict=True)])
    out = F.array_sort(items)
    return F.slice(out, 1, top) if top else out


def period_index(ts: Column, anchor: Column, days: int = 28) -> Column:
    return F.floor(F.datediff(F.to_date(ts), F.to_date(anchor)) / days)


def round_step(qty: Column, step: Column) -> Column:
    return F.floor(qty / step + 1e-9) * step


def taker_imbalance(taker: Column, volume: Column) -> Column:
    return F.when(volume > 0, taker / F.nullif(volume, F.lit(0.0)) - 0.5)


def quote_pocket(pair: Column) -> Column:
    """'btc_mxn' or 'BTC/MXN' to 'MXN'."""
    return F.upper(F.element_at(F.split(pair, "[_/]"), -1))


def contract_name(base: Column, quote: str = "USDT") -> Column:
    return F.concat(F.upper(F.element_at(F.split(base, "[_/]"), 1)), F.lit(quote))


def safe_name(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("/"), F.lit("_"))


def multiscale_vote(past_returns: Sequence[Column]) -> Column:
    """Sign votes of several look-backs: struct (direction, confidence, votes, valid). A zero
    return counts as valid but casts no vote."""
    valid = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in past_returns[1:]), F.when(past_returns[0].isNotNull(), 1).otherwise(0))
    votes = sum((F.coalesce(F.signum(r), F.lit(0.0)) for r in past_returns[1:]), F.coalesce(F.signum(past_returns[0]), F.lit(0.0)))
    side = F.when(votes > 0, "BUY").when(votes < 0, "SELL").otherwise("HOLD")
    conf = F.least(F.abs(votes) / F.nullif(valid, F.lit(0)), F.lit(0.95))
    return F.struct(side.alias("direction"), F.coalesce(conf, F.lit(0.0)).alias("confidence"),
                    votes.cast("long").alias("votes"), valid.cast("long").alias("valid"))
