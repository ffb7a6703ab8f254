"""Shop sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import in_months
from tidemark.functions.ratios import total
from tidemark.functions.timekeys import month_key, month_start
from tidemark.operators.joins import with_region
from tidemark.operators.reshape import melt


def shop_sales(
    orders: DataFrame,
    shop: str = "pickup_shop_name",
    amount: str = "payment_amount",
    user: str = "user_id",
) -> DataFrame:
    """Per shop: ``sales`` and ``pu``, the number of distinct payers.

    Spark first reduces to (shop, user) and shuffles on both, so a shop with a
    large part of all orders is spread over the tasks.
    """
    named = orders.filter(F.col(shop).isNotNull())
    return named.groupBy(shop).agg(total(amount).alias("sales"), F.count_distinct(user).alias("pu"))


def shop_sales_by_month(
    orders: DataFrame,
    shop: str = "pickup_shop_name",
    amount: str = "payment_amount",
    date: str = "order_date",
) -> DataFrame:
    """Sales per month and shop, one column per measure."""
    dated = orders.filter(F.col(shop).isNotNull() & F.col(date).isNotNull())
    sums = dated.groupBy(month_start(date).alias("month"), shop).agg(total(amount).alias(amount))
    return sums.select(month_key("month").alias("order_year_month"), shop, amount)


def shop_sales_monthly(
    orders: DataFrame,
    shop: str = "pickup_shop_name",
    amount: str = "payment_amount",
    date: str = "order_date",
) -> DataFrame:
    """Long form of :func:`shop_sales_by_month`: one ``variable``/``value`` row per measure."""
    return melt(shop_sales_by_month(orders, shop, amount, date), ["order_year_month", shop], [amount])


def shop_sales_located(sales: DataFrame, shops: DataFrame, shop: str = "pickup_shop_name") -> DataFrame:
    """Attach the shop dimension to a table that already has few rows per shop."""
    return sales.join(shops, shop, "left")


def shop_region_sales_pivot(
    orders: DataFrame,
    user_region: DataFrame,
    regions: Sequence[str],
    month: str | None = None,
    fill_zero: bool = False,
    shop: str = "pickup_shop_name",
    amount: str = "payment_amount",
    date: str = "order_date",
    user: str = "user_id",
    region: str = "region",
    rest: str | None = "other",
) -> DataFrame:
    """Sales per month and shop with a column per region of the payer.

    The column ``rest`` holds the sales to all other payers, of a region that is
    not listed or not known, so that a row adds up to the shop's sales; None
    leaves it out.  A cell is null, or 0 with ``fill_zero``, where nothing was sold.  Orders meet
    the region table as they are: a sum per payer, shop and month before would
    reduce little and cost a shuffle more.  A payer with many orders is split.
    """
    dated = orders.filter(F.col(date).isNotNull() & F.col(shop).isNotNull() & F.col(user).isNotNull())
    if month is not None:
        dated = dated.filter(in_months(date, month, month))
    sold = dated.select(user, shop, month_start(date).alias("month"), F.col(amount).alias("paid"))
    listed = F.when(F.col(region).isin(list(regions)), F.col(region)).otherwise(F.lit(rest))
    located = with_region(sold, user_region, user, region, splittable=True).withColumn(region, listed)
    columns = list(regions) if rest is None or rest in regions else [*regions, rest]
    wide = located.groupBy("month", shop).pivot(region, columns).agg(F.sum("paid"))
    named = wide.select(month_key("month").alias("order_year_month"), shop, *[F.col(f"`{c}`") for c in columns])
    return named.na.fill(0, columns) if fill_zero else named
