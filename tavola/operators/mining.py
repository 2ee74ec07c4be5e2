"""Association-rule mining.

Frequent itemsets are counted level by level, as partial sums a task (MLlib's FP-Growth
sends every basket once per group of items and keeps their trees in the heap).  Rules
with any split of an itemset are produced here: each frequent itemset of size >= 2 is expanded to
all its proper non-empty subsets level by level (generators inside the task, no
shuffle), then antecedent and consequent supports are attached with two
equi-joins on the sorted item array.  The itemset table is the only thing
joined and it is itself bounded by ``min_support``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.session import cut_lineage, reuse


@dataclass(frozen=True)
class RulePreset:
    min_support: float
    max_support: float
    min_confidence: float
    min_lift: float
    suggest_confidence: float


# The two threshold sets of the source (service and batch).
SERVICE = RulePreset(min_support=0.05, max_support=0.60, min_confidence=0.40, min_lift=1.5,
                     suggest_confidence=0.55)
BATCH = RulePreset(min_support=0.01, max_support=0.60, min_confidence=0.10, min_lift=1.05,
                   suggest_confidence=0.10)

INF = float("inf")


def baskets(items: DataFrame, products: DataFrame, label: str) -> DataFrame:
    """One row per order that has items: the sorted set of labels bought.
    The set is bounded by the order's own line count."""
    return (items.join(products.select("product_id", label), "product_id")
                 .groupBy(F.col("order_id").alias("basket_id"))
                 .agg(F.array_sort(F.collect_set(label)).alias("items")))


def frequent_itemsets(basket_df: DataFrame, min_support: float) -> DataFrame:
    """M1: every itemset with support >= min_support, any size.

    Level by level: a basket sends each of its sets of k items whose first k - 1 items
    are frequent, and tasks add up the sets they meet before anything is shuffled.  The
    frequent items and the frequent sets of a level are bounded by ``min_support``.

    Returns (items sorted, freq, support, length)."""
    rows = reuse(basket_df.select(F.array_sort("items").alias("items")))    # read by every level
    n = rows.count()
    least = max(1, ceil(min_support * rows.where("items IS NOT NULL").count()))
    level = reuse(rows.select(F.explode("items").alias("i1")).where("i1 IS NOT NULL").groupBy("i1")
                  .agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least))
    frequent = [r.i1 for r in level.select("i1").collect()]
    found, more = [level.select(F.array("i1").alias("items"), "freq")], bool(frequent)

    def longer(sets: DataFrame, names: list[str], name: str) -> DataFrame:
        return sets.select(*names, "_rest", F.posexplode("_rest").alias("_at", name)).select(
            *names, name, F.slice("_rest", F.col("_at") + 2, F.size("_rest")).alias("_rest"))

    # of frequent items only, so the sets of one item need no look at their level
    kept = reuse(rows.select(F.filter("items", lambda x: x.isin(frequent)).alias("_rest")).where(F.size("_rest") > 1))
    sets, names = longer(kept, [], "i1"), ["i1"]
    while more:
        if len(names) > 1:
            sets = sets.join(level.drop("freq"), names, "left_semi")
        sets, names = longer(sets, names, f"i{len(names) + 1}"), [*names, f"i{len(names) + 1}"]
        level = reuse(sets.groupBy(*names).agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least))
        found.append(level.select(F.array(*names).alias("items"), "freq"))
        more = level.count() > 0
    fi = (reduce(DataFrame.unionByName, found)
          .withColumn("support", F.col("freq") / F.lit(float(n)))
          .withColumn("length", F.size("items"))
          .withColumn("n_baskets", F.lit(n).cast("long")))
    # The itemset table is referenced several times by the rule step; it is
    # bounded by min_support, so it is written once to the shared checkpoint
    # folder instead of counting again per reference.
    return cut_lineage(fi.repartition("items"))


def drop_too_frequent(itemsets: DataFrame, max_support: float) -> DataFrame:
    """M2: itemsets above max_support are removed (from the output table)."""
    return itemsets.filter(F.col("support") <= max_support)


def rule_candidates(itemsets: DataFrame) -> DataFrame:
    """Every (antecedent, consequent) split of every itemset of size >= 2.

    Antecedents are made level by level: each row drops one more item, at or
    after the place where the last one was dropped, which makes every subset
    once.  A row yields as many rows as it has items left, never 2^n at once."""
    level = itemsets.filter(F.col("length") >= 2).select(
        "items", "freq", "n_baskets", F.col("items").alias("antecedent"), F.lit(0).alias("start"))
    longest = itemsets.agg(F.max("length")).first()[0] or 0
    levels = [level.filter(F.lit(False))]
    left = F.size("antecedent")
    for _ in range(longest - 1):
        drop = level.filter((left > 1) & (F.col("start") < left)).withColumn(
            "start", F.explode(F.sequence(F.col("start"), left - 1)))
        level = drop.withColumn("antecedent", F.concat(
            F.slice("antecedent", F.lit(1), F.col("start")),
            F.slice("antecedent", F.col("start") + 2, F.greatest(left - F.col("start") - 1, F.lit(0)))))
        level = cut_lineage(level)          # written once, not made again for each later level
        levels.append(level)
    split = reduce(lambda a, b: a.unionByName(b), levels)
    return split.drop("start").withColumn("consequent", F.array_except("items", "antecedent"))


def association_rules(itemsets: DataFrame, preset: RulePreset) -> DataFrame:
    """M3-M5: rules with metrics, confidence and lift filters, lift order.

    Metrics use the full itemset table (D13); then rules whose union,
    antecedent or consequent support is above max_support are dropped."""
    sup = itemsets.select("items", "freq")
    cand = rule_candidates(itemsets)
    a = sup.select(F.col("items").alias("antecedent"), F.col("freq").alias("freq_a"))
    c = sup.select(F.col("items").alias("consequent"), F.col("freq").alias("freq_c"))
    r = cand.join(a, "antecedent").join(c, "consequent")
    n = F.col("n_baskets").cast("double")
    support = F.col("freq") / n
    sa, sc = F.col("freq_a") / n, F.col("freq_c") / n
    conf = F.col("freq") / F.col("freq_a")
    rules = r.select(
        "antecedent", "consequent",
        support.alias("support"), sa.alias("antecedent_support"), sc.alias("consequent_support"),
        conf.alias("confidence"))
    rules = rules.select(
        "*",
        (F.col("confidence") / F.col("consequent_support")).alias("lift"),
        (F.col("support") - F.col("antecedent_support") * F.col("consequent_support")).alias("leverage"),
        F.when(F.col("confidence") == 1.0, F.lit(INF))
         .otherwise((1 - F.col("consequent_support")) / (1 - F.col("confidence"))).alias("conviction"))
    mx = preset.max_support
    return (rules.filter((F.col("confidence") >= preset.min_confidence)
                         & (F.col("lift") >= preset.min_lift)
                         & (F.col("support") <= mx) & (F.col("antecedent_support") <= mx)
                         & (F.col("consequent_support") <= mx))
                 .withColumn("antecedent_text", F.array_join("antecedent", ", "))
                 .withColumn("consequent_text", F.array_join("consequent", ", ")))


def sorted_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("lift"), "antecedent_text", "consequent_text")


def round_to(col, digits: int):
    """Round to ``digits`` decimals in plain double arithmetic, ties to even;
    infinity passes through."""
    scale = float(10 ** digits)
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.abs(c) == INF, c).otherwise(F.rint(c * scale) / scale)


def rules_file_rows(rules: DataFrame) -> DataFrame:
    """The rules file (texts and metrics rounded to 4)."""
    return rules.select(
        F.col("antecedent_text").alias("antecedent"), F.col("consequent_text").alias("consequent"),
        *[round_to(m, 4).alias(m) for m in ("support", "confidence", "lift", "leverage", "conviction")])


def suggestions(rules: DataFrame, preset: RulePreset) -> DataFrame:
    """Suggestion rows with message and truncated percent."""
    r = rules.filter(F.col("confidence") >= preset.suggest_confidence)
    pct = (F.col("confidence") * 100).cast("int")
    return r.select(
        F.col("antecedent_text").alias("tetikleyici"), F.col("consequent_text").alias("oneri"),
        round_to("confidence", 3).alias("confidence"), round_to("lift", 3).alias("lift"),
        round_to("support", 3).alias("support"),
        F.format_string("'%s' ile birlikte '%s' de ekleyin? (%%%d müşteri tercih etti)",
                        F.col("antecedent_text"), F.col("consequent_text"), pct).alias("oneri_metni"))


def rule_stats(suggestion_df: DataFrame) -> DataFrame:
    """Total, confidence >= .7, lift >= 2, and the best rule (highest
    lift, then smallest texts)."""
    best = F.struct((-F.col("lift")).alias("l"), F.col("tetikleyici"), F.col("oneri"))
    return suggestion_df.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if(F.col("confidence") >= 0.7).alias("high_confidence"),
        F.count_if(F.col("lift") >= 2).alias("strong_lift"),
        F.min_by(F.concat_ws(" -> ", "tetikleyici", "oneri"), best).alias("best_rule"))
