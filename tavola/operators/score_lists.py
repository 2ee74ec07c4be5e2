"""Top products by score without scoring every product.

A recommender's score of a product is the sum of two parts.  One depends on the
product's *zone* only: its category and the pairing targets that its name contains.
The other, the boost of the mined rules, depends on its *name* only.  So for each
distinct set of query words there is one list of names by boost, and per zone the best
products are found by going down that list: a threshold search, which looks at the
next names only where the boost of the names not yet seen could still change a zone's
best.  Neither a (basket, product) nor a (basket, name, category) table is formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tavola.session import cut_lineage

FIRST_NAMES = 4          # names looked at in the first step; each step looks at four times as many
BOOST = "decimal(20,10)"


def zone_tables(catalog: DataFrame, pairings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes and zones of a catalogue (product_id, product_name, category_id).

    ``pairings``: (keyword, pos, category_id, target_name, ...).  Returns (category_id, product_name, zone_id,
    first_id, class_size) and (zone_id, category_id, zone_size, targets: array of (keyword, pos))."""
    classes = catalog.groupBy("category_id", "product_name").agg(
        F.min("product_id").alias("first_id"), F.count(F.lit(1)).alias("class_size"))
    named = pairings.where("target_name IS NOT NULL").select("category_id", "target_name", F.struct("keyword", "pos").alias("target"))
    hits = (classes.select("category_id", "product_name").join(named, "category_id")
            .where(F.lower("product_name").contains(F.lower("target_name")))
            .groupBy("category_id", "product_name").agg(F.sort_array(F.collect_set("target")).alias("targets")))
    none = F.expr("CAST(array() AS array<struct<keyword:string,pos:int>>)")
    classes = (classes.join(hits, ["category_id", "product_name"], "left")
               .withColumn("targets", F.coalesce("targets", none))
               .withColumn("zone_id", F.concat_ws(":", "category_id", F.to_json("targets"))))
    zones = classes.groupBy("zone_id", "category_id", "targets").agg(F.sum("class_size").alias("zone_size"))
    return classes.drop("targets"), zones


def rank_in(df: DataFrame, keys: list[str], order: list, name: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key with their rank; tasks send no more than that of a key."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= most)


def zone_lists(boosts: DataFrame, wanted: DataFrame, catalog: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_id, zone_id, product_id, product_name, boost, reached): per wanted (set_id,
    zone_id, m, every) the first m products of the zone by boost, then product_id.

    ``boosts``: (set_id, product_name, boost > 0), the names reached by a set.  Without
    ``every`` only products of reached names count."""
    wanted = cut_lineage(wanted)
    most = wanted.agg(F.max("m")).first()[0]
    name_key = ["category_id", "product_name"]
    products = rank_in(catalog.select("product_id", *name_key), name_key, ["product_id"], "_in_class", most)
    products = cut_lineage(products)
    by_boost = Window.partitionBy("set_id").orderBy(F.desc("boost"), "product_name")
    names = cut_lineage(boosts.select("set_id", "product_name", "boost").withColumn("_rank", F.row_number().over(by_boost)))
    of_pair = ["set_id", "zone_id"]
    order = [F.desc("boost"), F.asc("product_id")]

    def expanded(rows: DataFrame) -> DataFrame:
        return (rows.join(products, name_key).where("_in_class <= m")
                .select(*of_pair, "m", "every", "product_id", "product_name", "boost"))

    pending, looked, done, short = wanted, FIRST_NAMES, [], None
    while True:
        seen = names.where(F.col("_rank") <= looked).select("set_id", "product_name", "boost")
        bound = names.where(F.col("_rank") == looked + 1).select("set_id", F.col("boost").alias("_bound"))
        rows = expanded(pending.join(seen, "set_id").join(classes.select("zone_id", *name_key), ["zone_id", "product_name"]))
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*of_pair).orderBy(*order))).where("_r <= m")
        rows = cut_lineage(rows.join(bound, "set_id", "left"))
        # nothing unseen can enter: m products above the bound, or no name left
        sure = F.col("_bound").isNull() | (F.col("boost") > F.col("_bound"))
        status = rows.groupBy(*of_pair).agg(F.sum(sure.cast("int")).alias("n"))
        status = cut_lineage(pending.join(status, of_pair, "left").join(bound, "set_id", "left")
                             .select(*of_pair, "m", "every", F.coalesce("n", F.lit(0)).alias("n"), F.col("_bound").isNull().alias("over")))
        settled = status.where("n >= m OR over").select(*of_pair)
        done.append(rows.join(settled, of_pair, "left_semi").select(*of_pair, "product_id", "product_name", "boost"))
        less = status.where("over AND n < m AND every").select(*of_pair, "m", "every", "n")
        short = less if short is None else short.unionByName(less)
        pending = status.where("n < m AND NOT over").select(*of_pair, "m", "every")
        if pending.isEmpty():
            break
        looked *= 4
    # zones with too few reached products go on with the others by id; of their first classes fewer than m are reached
    first = rank_in(classes.select("zone_id", *name_key, "first_id"), ["zone_id"], ["first_id"], "_in_zone", 2 * most)
    more = short.join(first, "zone_id").where("_in_zone <= 2 * m").join(names.select("set_id", "product_name"),
                                                                       ["set_id", "product_name"], "left_anti")
    more = expanded(more.withColumn("boost", F.lit(0).cast(BOOST)).withColumn("m", F.col("m") - F.col("n")))
    more = (more.withColumn("_r", F.row_number().over(Window.partitionBy(*of_pair).orderBy("product_id"))).where("_r <= m")
            .select(*of_pair, "product_id", "product_name", "boost"))
    found = reduce(DataFrame.unionByName, [*done, more])
    return found.withColumn("reached", F.col("boost") > 0)
