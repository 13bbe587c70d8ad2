"""Finance rows from order tables: a profit-and-loss row, and series, per region, nation or segment.

The fact table is read once, with only the columns used, and summed per order before it meets anything larger than the price
list; dimensions are broadcast when Spark finds that their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How an entity is named.
ENTITIES = {"region": "r_name", "nation": "n_name", "segment": "c_mktsegment"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _total(c: str) -> Column:
    """An exact sum of ten-thousandths, wide enough for any table, as a double."""
    return F.sum(F.col(c).cast("decimal(18,0)")).cast("double") / 10_000


def orders_with_amounts(spark: SparkSession, sf_dir: str, entity: str = "region", goods: bool = True) -> DataFrame:
    """A row per order: entity, month, year, and the sums of its line items.

    Amounts are in ten-thousandths: products of two-digit decimals are exact there, so totals do not depend on the order of rows.
    Line items are summed per order first. Their files are clustered by order, so the map-side sums shrink the one large shuffle,
    and the join with orders reuses its partitioning. Only the cost of goods needs the price list; without ``goods`` it is not
    read, which for a price list too large to broadcast saves a shuffle of all line items.
    """
    t = lambda name: table(spark, sf_dir, name)
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = customers.select("c_custkey", F.col(ENTITIES[entity]).alias("entity"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(owners, F.col("o_custkey") == F.col("c_custkey"))
    items, sums = t("lineitem"), {}
    if goods:
        prices = t("part").select("p_partkey", "p_retailprice")
        items = items.join(prices, F.col("l_partkey") == F.col("p_partkey"))
        sums["cogs"] = F.sum(_hundredths("l_quantity") * _hundredths("p_retailprice"))
    per_order = items.groupBy("l_orderkey").agg(
        F.sum(_hundredths("l_extendedprice") * (100 - _hundredths("l_discount"))).alias("revenue"),
        *[total.alias(name) for name, total in sums.items()],
        F.sum(_hundredths("l_extendedprice") * _hundredths("l_tax")).alias("opex"),
        F.sum(F.unix_date(F.col("l_shipdate").cast("date")).cast("long")).alias("shipped"),
        F.count("l_shipdate").alias("n"),
    )
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    return per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "entity", F.date_trunc("month", "o_orderdate").alias("month"), F.year("o_orderdate").alias("year"), "revenue", *sums, "opex", (F.col("shipped") - F.col("n") * day).alias("days"), "n"
    )


def profit_and_loss(spark: SparkSession, sf_dir: str, entity: str = "region") -> DataFrame:
    """(entity, revenue, cogs, opex, receivable_days, payable_days, inventory)."""
    days = (F.sum("days") / F.sum("n")).alias("receivable_days")
    sums = orders_with_amounts(spark, sf_dir, entity).groupBy("entity").agg(*[_total(c).alias(c) for c in ("revenue", "cogs", "opex")], days)
    return sums.select("*", F.lit(45.0).alias("payable_days"), (F.col("cogs") * 0.125).alias("inventory"))


def series(spark: SparkSession, sf_dir: str, entity: str = "region", period: str = "year", measures: tuple[str, ...] = ("value", "cogs", "opex")) -> DataFrame:
    """(entity, t, measures...): by period, ``value`` being revenue and ``t`` counting an entity's periods from 0."""
    sums = [_total({"value": "revenue"}.get(m, m)).alias(m) for m in measures]
    rows = orders_with_amounts(spark, sf_dir, entity, "cogs" in measures).groupBy("entity", period).agg(*sums)
    return rows.select("entity", (F.expr(f"row_number() OVER (PARTITION BY entity ORDER BY {period})") - 1).alias("t"), *measures)


# The same as SQL, for checks: ENTITY and PERIOD are put in by the caller.
_H = "CAST(round({} * 100) AS BIGINT)".format
LINES_SQL = f"""SELECT {{entity}} AS entity, date_trunc('month', o_orderdate) AS month, year(o_orderdate) AS year, {_H("l_extendedprice")} * (100 - {_H("l_discount")}) AS revenue,
    {_H("l_quantity")} * {_H("p_retailprice")} AS cogs, {_H("l_extendedprice")} * {_H("l_tax")} AS opex, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_SUM = "CAST(sum({0}) AS DOUBLE) / 10000 AS {1}".format


def profit_and_loss_sql(entity: str = "region") -> str:
    return f"""SELECT *, 45.0::DOUBLE AS payable_days, cogs * 0.125::DOUBLE AS inventory FROM (SELECT entity, {_SUM("revenue", "revenue")}, {_SUM("cogs", "cogs")},
        {_SUM("opex", "opex")}, sum(days) / count(days)::DOUBLE AS receivable_days FROM ({LINES_SQL.format(entity=ENTITIES[entity])}) GROUP BY entity)"""


def series_sql(entity: str = "region", period: str = "year") -> str:
    return f"""SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY {period}) - 1 AS t, value, cogs, opex FROM (SELECT entity, {period},
        {_SUM("revenue", "value")}, {_SUM("cogs", "cogs")}, {_SUM("opex", "opex")} FROM ({LINES_SQL.format(entity=ENTITIES[entity])}) GROUP BY entity, {period})"""
