"""Connected components of items that share keys.

Items are contracted to their keys: an item links its first key to its others, and what is worked
on is the set of distinct links between 64-bit hashes of keys, whatever the number of items.  Two
keys with one hash (not to be expected below billions of keys) would join their components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import gone, written


def key_labels(lists: DataFrame) -> DataFrame:
    """lists (keys array<long>) -> key, label (the least key it is connected with), for keys that
    are linked to a lesser one; any other key is its own label.

    Rounds of large and small stars (a node's greater neighbours, then its lesser ones, move to the
    least) on written tables of links, until every component is one star; long chains take few rounds."""
    pairs = lists.select(F.col("keys")[0].alias("a"), F.explode("keys").alias("b")).filter("a != b")
    links = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty():
            return links.select(F.col("u").alias("key"), F.col("v").alias("label"))
        least = F.min("v").over(Window.partitionBy("u"))
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", least)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v")
        step = written(small.distinct(), "links")
        gone(links)
        links = step


def hashed(keys):
    """Hashes of an array's keys, nulls left out."""
    return F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: F.xxhash64(k))


def components(items: DataFrame) -> DataFrame:
    """items (item, keys array) -> item, component (its least item).

    An item without keys is a component by itself."""
    rows = written(items.select("item", hashed(F.col("keys")).alias("keys")), "items")
    linked = rows.filter("size(keys) > 0").select("item", F.col("keys")[0].alias("first")).join(key_labels(rows.select("keys")), F.col("first") == F.col("key"), "left").select("item", F.coalesce("label", "first").alias("label"))
    least = linked.groupBy(F.col("label").alias("l_label")).agg(F.min("item").alias("component"))
    named = linked.join(least, F.col("label") == F.col("l_label")).select("item", "component")
    return named.unionByName(rows.filter("size(keys) <= 0 or keys is null").select("item", F.col("item").alias("component")))
