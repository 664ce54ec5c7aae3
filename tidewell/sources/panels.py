"""Market tables derived from the warehouse tables.

Daily bars come from order lines: the lines of a brand on a day move a deterministic walk by
their discounts and taxes. Counts, sums and maxima by (brand, day) are all it needs, so sectors
and the market are rolled up from that small aggregate in one expansion, and the panel is cut, so
the lines are read once whatever reads the panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..plans.cuts import cut

SECTORS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _walk(daily: DataFrame) -> DataFrame:
    """Prices of (code, date, n, ds, ts, dm, tm, volume) by whole-number accumulation, so any engine agrees."""
    w = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bp = F.floor(4000.0 * (F.col("ds") / (100.0 * F.col("n")) - 0.05)).cast("long")
    p = daily.withColumn("bp", bp).withColumn("cb", F.sum("bp").over(w))
    close = rnd(100.0 * F.exp(F.col("cb") / 10000.0), 4)
    open_ = rnd(100.0 * F.exp((F.col("cb") - F.col("bp")) / 10000.0) * (1.0 + 0.2 * (F.col("ts") / (100.0 * F.col("n")) - 0.04)), 4)
    p = p.withColumn("close", close).withColumn("open", open_)
    return p.select(
        "code", "date", "open", (F.greatest("open", "close") * (1.0 + F.col("tm") / 2000.0)).alias("high"),
        (F.least("open", "close") * (1.0 - F.col("dm") / 2000.0)).alias("low"), "close", F.col("volume").cast("double").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(role, code, sector, date, open, high, low, close, volume): 25 brands, 5 sectors, the market."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_discount", "l_tax", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    day = (
        lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(F.col("p_brand").alias("brand"), F.to_date("l_shipdate").alias("date"))
        .agg(
            F.count("*").alias("n"), F.sum(F.round(100.0 * F.col("l_discount")).cast("long")).alias("ds"), F.sum(F.round(100.0 * F.col("l_tax")).cast("long")).alias("ts"),
            F.max(F.round(100.0 * F.col("l_discount")).cast("long")).alias("dm"), F.max(F.round(100.0 * F.col("l_tax")).cast("long")).alias("tm"), F.sum(F.col("l_quantity").cast("long")).alias("volume"),
        )
    )
    sector = F.concat(F.lit("S"), F.pmod(F.regexp_extract("brand", r"(\d+)", 1).try_cast("int"), F.lit(SECTORS)).cast("string"))
    day = day.withColumn("sector", sector)
    up = [F.sum(c).alias(c) for c in ("n", "ds", "ts")] + [F.max(c).alias(c) for c in ("dm", "tm")] + [F.sum("volume").alias("volume")]
    daily = day.withColumn("code", F.explode(F.array("brand", "sector", F.lit("MKT")))).groupBy("code", "date").agg(*up)
    # role and sector follow from the code, so they ride along instead of joining back
    role = F.when(F.col("code") == "MKT", "market").when(F.col("code").startswith("S"), "sector").otherwise("stock")
    number = F.pmod(F.regexp_extract("code", r"(\d+)", 1).try_cast("int"), F.lit(SECTORS)).cast("string")
    panel = _walk(daily).select(role.alias("role"), "code", F.when(F.col("code") != "MKT", F.concat(F.lit("S"), number)).alias("sector"), "date", "open", "high", "low", "close", "volume")
    return cut(panel)  # days times codes


def foreign_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of two foreign markets: peers are nations, benchmarks all nations of a market, moved by order keys."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    market = F.when(F.col("r_name").isin("AMERICA", "AFRICA"), "us").otherwise("kr")
    rows = (
        o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
        .groupBy(market.alias("market"), F.col("n_name").alias("nation"), F.to_date("o_orderdate").alias("date"))
        .agg(F.count("*").alias("n"), F.sum(F.pmod("o_orderkey", F.lit(11))).alias("ds"))
    )
    whole = rows.groupBy("market", "date").agg(F.sum("n").alias("n"), F.sum("ds").alias("ds")).select("market", F.concat(F.lit("IDX_"), "market").alias("symbol"), "date", "n", "ds")
    daily = rows.select("market", F.col("nation").alias("symbol"), "date", "n", "ds").unionByName(whole)
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bp = F.floor(4000.0 * (F.col("ds") / (100.0 * F.col("n")) - 0.05)).cast("long")
    return daily.withColumn("cb", F.sum(bp).over(w)).select("market", "symbol", "date", rnd(100.0 * F.exp(F.col("cb") / 10000.0), 4).alias("close"))


def news_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, code, event_date, direction, stage): orders as news about a brand."""
    o = table(spark, sf_dir, "orders")
    direction = F.when(F.col("o_orderstatus") == "O", "positive").when(F.col("o_orderstatus") == "F", "negative").otherwise("mixed")
    stages = F.array(*[F.lit(s) for s in ("rumor", "proposal", "draft", "announced", "approved", "effective", "enforced", "result", "unknown")])
    return o.select(
        F.col("o_orderkey").alias("event_id"), F.concat(F.lit("Brand#"), (F.pmod("o_custkey", F.lit(25)) + 1).cast("string")).alias("code"),
        F.to_date("o_orderdate").alias("event_date"), direction.alias("direction"), F.get(stages, F.pmod("o_orderkey", F.lit(9)).cast("int")).alias("stage"),
    )
