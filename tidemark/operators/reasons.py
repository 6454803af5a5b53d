"""Texts of reasons: how a feature's value reads, and a short text of what speaks for a label and what against it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest text of a reason.
MOST_CHARS = 200
NOTHING = "No dominant signal; score near universe median."

# Name, short label and text of each feature; a text's number in braces, by sign, digits and unit.
FORMATS = """
rsi_14 | RSI | RSI {.0f}
rsi_2 | short-term RSI | 2d RSI {.0f}
adx_14 | trend strength | ADX {.0f}
bollinger_z | Bollinger position | {+.1f}σ vs 20d mean
momentum_12_1 | 12-1 momentum | 12m momentum {+.0%}
momentum_60d | 3m momentum | 3m momentum {+.0%}
momentum_120d | 6m momentum | 6m momentum {+.0%}
ret_1d | 1d return | 1d {+.1%}
ret_5d | 5d return | 5d {+.1%}
ret_20d | 1m return | 1m {+.1%}
reversal_5d | 5d reversal | 5d reversal {-+.1%}
vol_20d | volatility | 20d vol {.1%}
vol_ratio_5_20 | volatility regime | vol regime {.2f}x
idio_vol_60d | idiosyncratic vol | idio vol {.1%}
beta_60d | beta | beta {.2f}
atr_pct | ATR | ATR {.1%}
px_to_sma_20 | price vs 20d SMA | {+.1%} vs 20d SMA
px_to_sma_50 | price vs 50d SMA | {+.1%} vs 50d SMA
px_to_sma_200 | price vs 200d SMA | {+.1%} vs 200d SMA
range_position_52w | 52w range position | {.0%} of 52w range
pct_from_52w_high | distance from 52w high | {+.1%} from 52w high
pct_from_52w_low | distance from 52w low | {+.1%} above 52w low
volume_zscore_20 | volume | volume {+.1f}σ
volume_ratio_20 | volume ratio | volume {.1f}x avg
delivery_pct | delivery | delivery {.0%}
delivery_pct_z20 | delivery vs norm | delivery {+.1f}σ
delivery_pct_ma20 | avg delivery | 20d delivery {.0%}
delivery_pct_trend | delivery trend | delivery trend {.2f}x
delivery_volume_conviction | delivery conviction | delivery-volume conviction {.2f}
avg_trade_size | trade size | log trade size {.1f}
avg_trade_size_z20 | trade size vs norm | trade size {+.1f}σ
n_trades_z20 | trade count | trade count {+.1f}σ
excess_ret_5d | excess return | {+.1%} vs market 5d
vs_sector_ret_5d | sector-relative return | {+.1%} vs sector 5d
market_breadth | market breadth | breadth {.0%}
days_to_expiry | F&O expiry | {.0f}d to expiry
overnight_gap | overnight gap | gap {+.1%}
close_position_in_range | close in range | closed {.0%} of range
ret_2d | 2d return | 2d {+.1%}
ret_3d | 3d return | 3d {+.1%}
ret_10d | 2w return | 2w {+.1%}
ret_60d | 3m return | 3m {+.1%}
log_ret_1d | 1d log return | 1d {+.1%}
reversal_1d | 1d reversal | 1d reversal {-+.1%}
intraday_ret | intraday move | intraday {+.1%}
vol_5d | 5d volatility | 5d vol {.1%}
vol_60d | 3m volatility | 3m vol {.1%}
vol_ratio_20_60 | vol trend | vol trend {.2f}x
vol_of_vol | vol instability | vol-of-vol {.1%}
parkinson_vol_20 | range volatility | range vol {.1%}
atr_14 | ATR | ATR {.2f}
daily_range_pct | daily range | range {.1%}
gap_vs_range | gap vs range | gap {.2f}x range
px_to_sma_5 | price vs 5d SMA | {+.1%} vs 5d SMA
sma_5_20_cross | 5/20 SMA cross | 5v20 SMA {+.1%}
sma_20_50_cross | 20/50 SMA cross | 20v50 SMA {+.1%}
macd_hist | MACD | MACD {+.2%}
di_plus_14 | upward pressure | +DI {.0f}
di_minus_14 | downward pressure | -DI {.0f}
volume_trend_5_20 | volume trend | volume trend {.2f}x
dollar_volume | traded value | log traded value {.1f}
signed_volume_20 | signed volume | signed volume {+.2f}
turnover_z20 | turnover | turnover {+.1f}σ
delivery_pct_chg | delivery change | delivery {+.1%} d/d
market_ret_1d | market move | market {+.1%} 1d
market_ret_5d | market move | market {+.1%} 5d
excess_ret_1d | excess return | {+.1%} vs market 1d
sector_ret_1d | sector move | sector {+.1%} 1d
sector_ret_5d | sector move | sector {+.1%} 5d
vs_sector_ret_1d | sector-relative return | {+.1%} vs sector 1d
sector_rank_ret_5d | rank in sector | {.0%}ile in sector
day_of_month | day of month | day {.0f} of month
"""
# Labels and words of features that aren't read as one number.
WORDED = {"amihud_illiq": "illiquidity", "is_expiry_week": "expiry week", "day_of_week": "weekday", "month": "month"}
WEEK = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
YEAR = ("", "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Features whose contributions count somewhat more when signals are ranked.
FAVOURED, FAVOUR = ("delivery", "avg_trade_size", "n_trades", "days_to_expiry", "xs_rank_delivery", "xs_z_delivery"), 1.15
#: Labels that rising contributions support; all others are supported by falling ones.
BUYING = ("STRONG BUY", "BUY")
TABLE = {name: (label, text) for name, label, text in (map(str.strip, line.split("|")) for line in FORMATS.strip().splitlines())}
_NUMBER = re.compile(r"\{(-?)(\+?)\.(\d)([f%])\}")


def number_text(text: str, value: Column) -> Column:
    """A text whose number in braces is filled with ``value``: turned round by ``-``, with its sign by ``+``, in percent by ``%``."""
    found = _NUMBER.search(text)
    turned, signed, digits, unit = found.groups()
    shown = f"%{signed}.{digits}f" + ("%%" if unit == "%" else "")
    scale = (-1.0 if turned else 1.0) * (100.0 if unit == "%" else 1.0)
    head, tail = (part.replace("%", "%%") for part in (text[: found.start()], text[found.end() :]))
    return F.format_string(head + shown + tail, value * scale)


def three_digits(value: Column) -> Column:
    """Three significant digits without trailing zeros; powers of ten below a ten-thousandth."""
    size = F.floor(F.log10(F.abs(value)))
    small = F.regexp_replace(F.format_string("%.2e", value), r"\.?0+e", "e")
    plain = F.format_string("%.6f", value)
    for d in range(2, 7):
        plain = F.when(size == 2 - d, F.format_string(f"%.{d}f", value)).otherwise(plain)
    stripped = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value == 0, F.lit("0")).when(size < -4, small).otherwise(stripped)


def general_text(name: Column, value: Column) -> Column:
    """A feature without a format: its name in words, with as many digits as its size needs."""
    said, size = F.replace(name, F.lit("_"), F.lit(" ")), F.abs(value)
    fill = lambda shown, x: F.concat(said, F.lit(" "), F.format_string(shown, x))
    return (
        F.when(size == 0, F.concat(said, F.lit(" ~0"))).when(size < 0.01, fill("%+.3f%%", value * 100)).when(size < 1, fill("%+.2f", value))
        .when(size < 1000, fill("%.1f", value)).otherwise(fill("%,.0f", value))
    )


def label_of(name: str) -> str:
    return TABLE[name][0] if name in TABLE else WORDED.get(name, name.replace("_", " "))


def feature_text(names: tuple[str, ...], name: Column, value: Column) -> Column:
    """How the value of one of ``names`` reads: its place or deviation among all names for ``xs_`` features, else by its format."""
    out = None
    for n in names:
        if n.startswith("xs_rank_"):
            text = number_text(f"{label_of(n.removeprefix('xs_rank_'))} in {{.0%}}ile of universe", value)
        elif n.startswith("xs_z_"):
            text = number_text(f"{label_of(n.removeprefix('xs_z_'))} {{+.1f}}σ vs universe", value)
        elif n in TABLE:
            text = number_text(TABLE[n][1], value)
        elif n == "amihud_illiq":
            text = F.concat(F.lit("illiquidity "), F.when(F.abs(value) < 1, three_digits(value)).otherwise(F.format_string("%.2f", value)))
        elif n == "is_expiry_week":
            text = F.when(value >= 0.5, "in F&O expiry week").otherwise("outside expiry week")
        elif n in ("day_of_week", "month"):
            words = WEEK if n == "day_of_week" else YEAR
            text = F.get(F.array(*map(F.lit, words)), F.pmod(value.cast("int"), F.lit(len(words))))
        else:
            text = general_text(name, value)
        out = F.when(name == n, text) if out is None else out.when(name == n, text)
    return out


def signals(names: tuple[str, ...], parts: tuple[str, ...], n: int = 3) -> Column:
    """The ``n`` features of the largest contributions (columns ``parts``), as ``(feature, value, part)``; favoured ones count
    more, equal ones keep the order of names, and what isn't finite is left out."""
    every = []
    for i, (name, part) in enumerate(zip(names, parts, strict=True)):
        weight = F.abs(F.col(part).cast("double")) * (FAVOUR if name.startswith(FAVOURED) else 1.0)
        every.append(F.struct((-weight).alias("w"), F.lit(i).alias("at"), F.lit(name).alias("feature"), F.col(name).cast("double").alias("value"), F.col(part).cast("double").alias("part")))
    held = F.filter(F.array(*every), lambda s: (F.abs(s["value"]) < float("inf")) & (F.abs(s["part"]) < float("inf")))
    return F.transform(F.slice(F.array_sort(held), 1, n), lambda s: F.struct(s["feature"], s["value"], s["part"]))


def reason(names: tuple[str, ...], found: Column, label: Column, most: int = MOST_CHARS) -> Column:
    """A text of the signals ``found``: those that support the label, or all where none does, and one that doesn't if there
    is room; cut to ``most`` characters."""
    with_label = label.isin(*BUYING)
    texts = F.transform(found, lambda s: F.struct(feature_text(names, s["feature"], s["value"]).alias("text"), ((s["part"] > 0) == with_label).alias("supports")))
    said = lambda kept: F.transform(kept, lambda t: t["text"])
    supporting, opposing = F.filter(texts, lambda t: t["supports"]), F.filter(texts, lambda t: ~t["supports"])
    lead = F.when(F.size(supporting) > 0, said(supporting)).otherwise(said(texts))
    text = F.array_join(F.slice(lead, 1, 3), "; ")
    offset = F.concat(text, F.lit(". Offset by "), F.get(said(opposing), F.lit(0)), F.lit("."))
    whole = F.when((F.size(supporting) > 0) & (F.size(opposing) > 0) & (F.length(offset) <= most), offset).otherwise(F.concat(text, F.lit(".")))
    cut = F.concat(F.regexp_replace(F.substring(whole, 1, most - 1), r"[ ;,]+$", ""), F.lit("."))
    return F.when(F.size(found) == 0, NOTHING).when(F.length(whole) > most, cut).otherwise(whole)


def with_reasons(rows: DataFrame, names: tuple[str, ...], parts: tuple[str, ...], label: Column) -> DataFrame:
    """``rows`` with their ``signals`` and ``reason``."""
    return rows.withColumn("signals", signals(names, parts)).withColumn("reason", reason(names, F.col("signals"), label))


def broken_explanations(rows: DataFrame) -> DataFrame:
    """Rows whose explanation breaks its contract: no or too long a text, over three signals, a label that isn't one, or a
    confidence outside 0 to 1."""
    from tidemark.operators.labels import CLASS_NAMES

    text, share = F.col("reason"), F.col("confidence")
    good = text.isNotNull() & F.length(text).between(1, MOST_CHARS) & (F.size("signals") <= 3) & F.col("label").isin(*CLASS_NAMES) & share.between(0, 1)
    return rows.where(~F.coalesce(good, F.lit(False)))
