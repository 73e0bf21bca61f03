"""Candle features: lags, rolling statistics, oscillators, microstructure and order flow.

All of them are computed over position blocks with a halo, in one shuffle and one sort per call.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.blocks import BLOCK_ROWS, block_window, ema, full, with_halo, with_position
from tidemark.tables import HOUR

# Look-backs and indicator settings.
LAGS = range(1, 25)
ROLLING = (6, 12, 36, 144)
RSI_N = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BAND_N, BAND_SD = 20, 2
ATR_N = 14
OBV_N = 36

# Rows copied in front of a block. 768 rows shrink the start value of the slowest mean by 1e-25.
EMA_HALO = 768
KEYS = ["symbol"]


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), NULL where it is not defined."""
    return F.when((a > 0) & (b > 0), F.log(a / b))


def blocked(bars: DataFrame, before: int, after: int = 0, interval_us: int = HOUR) -> DataFrame:
    """Bars with ``pos``, ``blk``, ``own``, the row index ``idx`` in the block and its first position ``start``."""
    d = bars if "pos" in bars.columns else with_position(bars, KEYS, "t", interval_us * BLOCK_ROWS)
    first = F.col("blk") * BLOCK_ROWS - before
    return with_halo(d, "pos", before, after).withColumns(
        {"idx": (F.col("pos") - first).cast("double"), "start": F.greatest(first, F.lit(0))}
    )


def owned(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter("own").select(*cols)


def ret_col(w) -> Column:
    return log_ratio(F.col("close"), F.lag("close").over(w))


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def clock_cols() -> dict[str, Column]:
    """Hour of day (with minutes) and day of week (Monday = 0) as points on a circle."""
    hs, hc = cyclical(F.hour("ts") + F.minute("ts") / F.lit(60.0), 24)
    ds, dc = cyclical(F.weekday("ts").cast("double"), 7)
    return {"hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc}


def lag_cols(w) -> dict[str, Column]:
    out = {}
    for k in LAGS:
        out[f"ret_lag_{k}"] = F.lag("ret", k).over(w)
        out[f"vol_lag_{k}"] = F.lag("volume", k).over(w)
    return out


def rolling_cols(w, windows: Sequence[int] = ROLLING) -> dict[str, Column]:
    out = {}
    for n in windows:
        for short, src in (("ret", "ret"), ("vol", "volume")):
            for name, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                out[f"{short}_{name}_{n}"] = full(F.col(src), agg, w, n)
    return out


def change_cols(w) -> dict[str, Column]:
    """First-stage columns other features are built on."""
    prev = F.lag("close").over(w)
    step = F.col("close") - prev
    rng = F.col("high") - F.col("low")
    return {
        "ret": ret_col(w),
        "step": step,
        "up": F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0)),
        "down": F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0)),
        "tr": F.greatest(rng, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
        "signed_volume": F.signum(step) * F.col("volume"),
    }


def rsi_col(w) -> Column:
    up, down = ema(F.col("up"), 1 / RSI_N, w), ema(F.col("down"), 1 / RSI_N, w)
    value = F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))
    return F.when(F.col("pos") >= RSI_N - 1, value)


def macd_line(w) -> Column:
    c = F.col("close")
    line = ema(c, 2 / (MACD_FAST + 1), w) - ema(c, 2 / (MACD_SLOW + 1), w)
    return F.when(F.col("pos") >= MACD_SLOW - 1, line)


def macd_signal(w) -> Column:
    """Mean of the line, started at its first defined row."""
    value = ema(F.col("macd"), 2 / (MACD_SIGNAL + 1), w, seed=MACD_SLOW - 1)
    return F.when(F.col("pos") >= MACD_SLOW + MACD_SIGNAL - 2, value)


def band_width(w) -> Column:
    c = F.col("close")
    return 2 * BAND_SD * full(c, F.stddev_pop, w, BAND_N) / full(c, F.avg, w, BAND_N)


def atr_col(w) -> Column:
    """Average true range: 0 while warming up, then a plain mean continued recursively.

    Every true range up to the first full window counts 1/n at the seed row, the later ones 1/n at
    their own row, hence the exponent never falls below the seed row's index.
    """
    a, d = 1.0 / ATR_N, 1.0 - 1.0 / ATR_N
    idx, pos = F.col("idx"), F.col("pos")
    at = idx + F.greatest(F.lit(ATR_N - 1) - pos, F.lit(0))
    share = F.when((pos > 0) & (pos == F.col("start")), F.lit(1.0)).otherwise(F.lit(a))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.col("tr") * share * F.pow(F.lit(d), -at)).over(run)
    return F.when(pos < ATR_N - 1, F.lit(0.0)).otherwise(F.pow(F.lit(d), idx) * total)


def obv_col(w) -> Column:
    up = full(F.col("signed_volume"), F.sum, w, OBV_N)
    return up / F.nullif(full(F.col("volume"), F.sum, w, OBV_N), F.lit(0.0))


FEATURES = (
    [f"{x}_lag_{k}" for k in LAGS for x in ("ret", "vol")]
    + [f"{x}_{s}_{n}" for n in ROLLING for x in ("ret", "vol") for s in ("mean", "std", "min", "max")]
    + ["rsi", "macd", "macd_signal", "macd_diff", "bb_width", "atr", f"obv_roc_{OBV_N}"]
    + ["ret_sq", "ret_atr_norm", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
)


def add_features(blocks: DataFrame) -> DataFrame:
    """All 93 candle features on a frame made by ``blocked(bars, EMA_HALO, ...)``."""
    w = block_window(KEYS, "t")
    d = blocks.withColumns(change_cols(w))
    d = d.withColumns(
        {
            **lag_cols(w),
            **rolling_cols(w),
            "rsi": rsi_col(w),
            "macd": macd_line(w),
            "bb_width": band_width(w),
            "atr": atr_col(w),
            f"obv_roc_{OBV_N}": obv_col(w),
            "ret_sq": F.col("ret") * F.col("ret"),
            **clock_cols(),
        }
    )
    d = d.withColumn("macd_signal", macd_signal(w))
    return d.withColumns(
        {
            "macd_diff": F.col("macd") - F.col("macd_signal"),
            "ret_atr_norm": F.col("ret") / F.nullif(F.col("atr"), F.lit(0.0)),
        }
    )


def features(bars: DataFrame, interval_us: int = HOUR) -> DataFrame:
    """Bars plus every feature column; warm-up rows keep NULLs."""
    d = add_features(blocked(bars, EMA_HALO, interval_us=interval_us))
    return owned(d, [*bars.columns, "ret", *FEATURES])


def base_return(bars: DataFrame, base: str, interval_us: int = HOUR) -> DataFrame:
    """(t, base_ret) of the base symbol: log return from its previous row."""
    d = blocked(bars.filter(F.col("symbol") == base), 1, interval_us=interval_us)
    d = d.withColumn("base_ret", ret_col(block_window(KEYS, "t")))
    return owned(d, ["t", "base_ret"])


def cross_asset(bars: DataFrame, base: str, interval_us: int = HOUR) -> DataFrame:
    """Other symbols' bars with the base symbol's return at exactly the same time, NULL on a gap."""
    others = bars.filter(F.col("symbol") != base)
    return others.join(base_return(bars, base, interval_us), "t", "left")


MICRO = ["amihud_12", "amihud_36", "gk_vol_36", "body_frac_12", "clv_12", "clv_36", "signed_vol_12"]


def microstructure(bars: DataFrame, interval_us: int = HOUR) -> DataFrame:
    """Price-impact, range-volatility and close-location features of the bars alone."""
    w = block_window(KEYS, "t")
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    zero = F.lit(0.0)
    rng = F.nullif(h - l, zero)
    d = blocked(bars, 72, interval_us=interval_us).withColumn("ret", ret_col(w))
    hl, co = log_ratio(h, l), log_ratio(c, o)
    d = d.withColumns(
        {
            "amihud": F.abs(F.col("ret")) / F.nullif(v * c, zero),
            "gk": 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co,
            "body": F.abs(c - o) / rng,
            "clv": ((c - l) - (h - c)) / rng,
            "sv": F.signum("ret") * v / F.nullif(full(v, F.avg, w, 12), zero),
        }
    )
    d = d.withColumns(
        {
            "amihud_12": full(F.col("amihud"), F.avg, w, 12),
            "amihud_36": full(F.col("amihud"), F.avg, w, 36),
            "gk_vol_36": full(F.col("gk"), F.avg, w, 36),
            "body_frac_12": full(F.col("body"), F.avg, w, 12),
            "clv_12": full(F.col("clv"), F.avg, w, 12),
            "clv_36": full(F.col("clv"), F.avg, w, 36),
            "signed_vol_12": full(F.col("sv"), F.avg, w, 12),
        }
    )
    return owned(d, [*bars.columns, *MICRO])


OFI = [
    "ofi_vol_lag1", "ofi_cnt_lag1", "ofi_large_lag1", "ofi_vol_roll12", "ofi_vol_roll36",
    "ofi_cnt_roll12", "trade_intensity_lag1", "avg_trade_size_z_lag1",
]


def ofi_ratios(ofi: DataFrame) -> DataFrame:
    def ratio(a, b):
        return (F.col(a) - F.col(b)) / F.nullif((F.col(a) + F.col(b)).cast("double"), F.lit(0.0))

    return ofi.withColumns(
        {
            "ofi_vol": ratio("buy_vol", "sell_vol"),
            "ofi_cnt": ratio("buy_cnt", "sell_cnt"),
            "ofi_large": ratio("large_buy_vol", "large_sell_vol"),
            "avg_trade_size": F.col("total_vol") / F.nullif(F.col("n_trades").cast("double"), F.lit(0.0)),
        }
    )


def ofi_features(ofi: DataFrame, interval_us: int = HOUR, z_rows: int = 288) -> DataFrame:
    """Order-flow features; every one is shifted one bar after its rolling step."""
    w = block_window(KEYS, "t")
    d = blocked(ofi_ratios(ofi), z_rows + 1, interval_us=interval_us)
    n, s = F.col("n_trades").cast("double"), F.col("avg_trade_size")
    d = d.withColumns(
        {
            "_v12": full(F.col("ofi_vol"), F.avg, w, 12),
            "_v36": full(F.col("ofi_vol"), F.avg, w, 36),
            "_c12": full(F.col("ofi_cnt"), F.avg, w, 12),
            "_i": n / F.nullif(full(n, F.avg, w, 36), F.lit(0.0)),
            "_z": (s - full(s, F.avg, w, z_rows)) / F.nullif(full(s, F.stddev_samp, w, z_rows), F.lit(0.0)),
        }
    )
    src = ["ofi_vol", "ofi_cnt", "ofi_large", "_v12", "_v36", "_c12", "_i", "_z"]
    d = d.withColumns({name: F.lag(s).over(w) for name, s in zip(OFI, src)})
    return owned(d, [*ofi.columns, *OFI])
