"""Bar cleaning, rolling windows, weeks and as-of joins over (code, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, pct_gap, ratio, rnd

#: Bars a code needs before it has factors, and before it has a timing state.
FACTOR_HISTORY, TIMING_HISTORY = 80, 120


def by_date(*, code: str = "code", date: str = "date"):
    return Window.partitionBy(code).orderBy(date)


def clean_bars(raw: DataFrame, as_of: str | None = None) -> DataFrame:
    """Bars with a date and a positive finite close, up to ``as_of``; of a (code, date) the last ingested wins.

    Numbers that are missing, not a number or infinite become null. ``raw`` has ``ingest_seq``.
    """
    cols = [c for c in ("open", "high", "low", "close", "volume") if c in raw.columns]
    ok = raw.withColumns({c: finite(F.col(c)) for c in cols}).withColumn("date", F.col("date").try_cast("date"))
    ok = ok.where((F.col("close") > 0) & F.col("date").isNotNull())
    if as_of is not None:
        ok = ok.where(F.col("date") <= F.lit(as_of).cast("date"))
    last = F.max_by(F.struct(*[c for c in raw.columns if c not in ("code", "date")]), "ingest_seq")
    return ok.groupBy("code", "date").agg(last.alias("b")).select("code", "date", "b.*")


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, strict: bool = False, prefix: str = "r_") -> DataFrame:
    """Each left row with the last right row at or before it (before it, if strict), by key.

    Both sides are put in one sequence by time and the last right row is carried forward: one
    shuffle on the key, no pairs.
    """
    fields = [c for c in right.columns if c != key]
    l_cols = [c for c in left.columns if c != key]
    one = left.select(F.col(key), F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.struct(*l_cols).alias("__l"), F.lit(None).cast(_struct(right, fields)).alias("__r"))
    two = right.select(F.col(key), F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(_struct(left, l_cols)).alias("__l"), F.struct(*fields).alias("__r"))
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = one.unionByName(two).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__l IS NOT NULL")
    return both.select(key, *[F.col(f"__l.{c}").alias(c) for c in l_cols], *[F.col(f"__r.{c}").alias(prefix + c) for c in fields])


def asof_days(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, prefix: str = "r_") -> DataFrame:
    """``asof`` for left sides with many rows a key and day: distinct (key, day) pairs are looked up and joined back by equality.

    What one task holds of a key is its days, however many rows there are; rows without a key stay, with nothing found.
    """
    days = left.select(key, left_time).where(F.col(key).isNotNull()).distinct()
    return left.join(asof(days, right, key, left_time, right_time, prefix=prefix), [key, left_time], "left")


def _struct(df: DataFrame, cols: list[str]):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in cols])


def drawdown(prices: Column) -> Column:
    """Worst fall from a running peak over an array of prices, percent, 0 at most."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))
    step = lambda a, x: F.struct(F.greatest(a["peak"], x).alias("peak"), F.least(a["worst"], x / F.greatest(a["peak"], x) - 1.0).alias("worst"))
    return F.aggregate(prices, start, step, lambda a: a["worst"] * 100)


def windows(bars: DataFrame) -> DataFrame:
    """Rolling measures of every bar, unguarded but for their own frames; ``rn`` counts bars from 1."""
    w = by_date()
    rows = lambda a, b=0: w.rowsBetween(a, b)
    lagged = lambda n: (F.col("close") / F.lag("close", n).over(w) - 1) * 100
    out = bars.withColumns({
        "rn": F.row_number().over(w), "ret1": F.col("close") / F.lag("close").over(w) - 1, "r5": lagged(5), "r20": lagged(20), "r60": lagged(60),
        "s20": F.avg("close").over(rows(-19)), "s60": F.avg("close").over(rows(-59)), "s20_10": F.avg("close").over(rows(-29, -10)),
        "seen": F.count("volume").over(w.rowsBetween(Window.unboundedPreceding, 0)), "closes60": F.collect_list("close").over(rows(-59)),
    })
    # means over the last volumes that exist: a range over their running number skips the missing ones
    have = Window.partitionBy("code").orderBy("seen")
    mean = lambda n: F.when(F.col("seen") >= n, F.avg("volume").over(have.rangeBetween(-(n - 1), 0)))
    return out.withColumns({"sd20": F.stddev_samp("ret1").over(rows(-19)) * F.sqrt(F.lit(252.0)) * 100, "v20": mean(20), "v60": mean(60), "mdd60": drawdown(F.col("closes60"))}).drop("closes60")


def features(bars: DataFrame, benchmark_of: Column | None = None) -> DataFrame:
    """The factor vector of every bar with FACTOR_HISTORY bars behind it, six places.

    One pass of windows serves every decision date: a factor at a date reads only bars up to it.
    Relative strength is own return less the benchmark's as of the same day, by position.
    """
    seen = windows(bars)
    bench = F.when(F.col("role") == "stock", F.col("sector")).when(F.col("role") == "sector", F.lit("MKT")) if benchmark_of is None else benchmark_of
    asked = seen.where(F.col("rn") >= FACTOR_HISTORY).withColumn("bcode", bench)
    marks = seen.where("role <> 'stock'").select(F.col("code").alias("bcode"), F.col("date").alias("bdate"), F.when(F.col("rn") > 20, F.col("r20")).alias("b20"), F.when(F.col("rn") > 60, F.col("r60")).alias("b60"))
    j = asof_days(asked, marks, "bcode", "date", "bdate", prefix="")
    r = lambda c: rnd(c, 6)
    return j.select(
        "role", "code", "sector", "date", F.col("rn").cast("long").alias("history_count"), r(F.col("close")).alias("close"), r(F.col("r5")).alias("return_5d_pct"), r(F.col("r20")).alias("return_20d_pct"), r(F.col("r60")).alias("return_60d_pct"),
        r(pct_gap(F.col("close"), F.col("s20"))).alias("ma20_gap_pct"), r(pct_gap(F.col("s20"), F.col("s60"))).alias("ma20_vs_ma60_pct"), r(pct_gap(F.col("s20"), F.col("s20_10"))).alias("ma20_slope_10d_pct"),
        r(ratio(F.col("v20"), F.col("v60"))).alias("volume_20d_vs_60d"), r(F.col("sd20")).alias("volatility_20d_annualized_pct"), r(F.col("mdd60")).alias("max_drawdown_60d_pct"),
        r(F.col("r20") - F.col("b20")).alias("relative_20d_pct"), r(F.col("r60") - F.col("b60")).alias("relative_60d_pct"), F.col("s20").alias("raw_ma20"), F.col("s60").alias("raw_ma60"),
    )


def weekly(bars: DataFrame) -> DataFrame:
    """ISO weeks of (code): first open, highest high, lowest low, last close, summed volume, sessions."""
    return bars.groupBy("code", F.extract(F.lit("YEAROFWEEK"), F.col("date")).cast("int").alias("iso_year"), F.weekofyear("date").alias("iso_week")).agg(
        F.max("date").alias("date"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("sessions"),
    )


def trend(close: Column, fast: Column, slow: Column, slope: Column, enough: Column) -> Column:
    up = (close > fast) & (fast > slow) & (slope > 0)
    down = (close < fast) & (fast < slow) & (slope < 0)
    return F.when(~F.coalesce(enough, F.lit(False)) | slope.isNull(), "insufficient_data").when(up, "bullish").when(down, "bearish").otherwise("mixed")
