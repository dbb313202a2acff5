"""An inverted index of orders by product, for event selections.

Orders are numbered per store; for each product the numbers of its orders are a bitmap, in buckets of 32,768 orders
(``bitmap_construct_agg``).  Any selection or group of products gives its orders by ``bitmap_or_agg`` over a few
bitmaps, without going back to the lines: the index is built once and answers every selection.

A bitmap is 4 kB; a product has one per bucket that holds an order of it.  Orders in a bucket follow one another
by date, so a date range touches few buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.config import DeltaConfig
from tillsight.functions.numbering import dense_numbers
from tillsight.operators import delta
from tillsight.operators._common import STORE
from tillsight.sources.bindings import written

BUCKET = 4096 * 8  # bits of Spark's bitmaps


def numbered_orders(lines: DataFrame, cfg: DeltaConfig) -> DataFrame:
    """Orders (date, id, revenue, units) with ``order_no`` from 1 in each store, by date and id."""
    dl = delta.delta_lines(lines, cfg)
    orders = dl.groupBy(STORE, "date", "order_id").agg(
        F.round(F.sum("total_raw"), 2).alias("revenue"), F.round(F.sum("quantity"), 2).alias("units"))
    return dense_numbers(orders, [STORE], [F.col("date"), F.col("order_id")], "order_no", start=1)


def build(lines: DataFrame, cfg: DeltaConfig) -> tuple[DataFrame, DataFrame]:
    """(orders, index): :func:`numbered_orders` with their bucket and bit, and (store, product, bucket, bits)."""
    orders = written(numbered_orders(lines, cfg).withColumns({
        "bucket": F.bitmap_bucket_number("order_no"), "bit": F.bitmap_bit_position("order_no")}), "orders")
    held = delta.delta_lines(lines, cfg).select(STORE, "date", "order_id", "product").distinct()
    index = (held.join(orders.select(STORE, "date", "order_id", "bucket", "bit"), [STORE, "date", "order_id"])
             .groupBy(STORE, "product", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    return orders, written(index, "order-index")


def _has(bits, bit):
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2.0)) == 1


def select(index: DataFrame, selection: DataFrame) -> DataFrame:
    """(store, name, bucket, bits): the orders that hold any product of each named selection.

    ``selection`` has (name, product), and ``store_id`` if it isn't for all stores.
    """
    on = [c for c in (STORE, "product") if c in selection.columns]
    return (index.join(selection, on).groupBy(STORE, "name", "bucket")
            .agg(F.bitmap_or_agg("bits").alias("bits")))


def counts(selected: DataFrame) -> DataFrame:
    """(store, name, orders): how many orders each selection has, from the bitmaps alone."""
    return selected.groupBy(STORE, "name").agg(F.sum(F.bitmap_count("bits")).alias("orders"))


def orders_of(orders: DataFrame, selected: DataFrame) -> DataFrame:
    """The orders of each selection, with their measures."""
    held = orders.join(selected, [STORE, "bucket"])
    return held.where(_has(F.col("bits"), F.col("bit"))).drop("bits", "bucket", "bit")
