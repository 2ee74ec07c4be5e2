"""Association-rule queries.  The oracle enumerates every subset of every
basket by bit mask (brute force, exact) and counts them; Spark uses FP-Growth."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from tavola.operators import mining as M
from tavola.plans.registry import register
from tavola.session import scratch_path
from tavola.sources import files
from tavola.sources.fixtures import Fixtures, with_views

# Label per basket: brand for pair rules, type for larger itemsets (the lift
# bound is lowered for types, whose pairs are all near independence).
BRAND = ("basket_label", M.BATCH)
TYPE = ("basket_type", replace(M.BATCH, min_lift=0.9))


def mining_ctes(label: str, preset: M.RulePreset) -> dict[str, str]:
    mx = preset.max_support
    return {
        "lbasket": f"""
 SELECT i.order_id AS basket_id, list_sort(list_distinct(list(p.{label}))) AS items
 FROM order_item_f i JOIN product_f p ON p.product_id = i.product_id GROUP BY i.order_id""",
        "nb": "SELECT COUNT(*) AS n FROM lbasket",
        "subsets": """
 SELECT list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS items FROM (
  SELECT items, unnest(range(1, (CAST(1 AS BIGINT) << len(items)))) AS m FROM lbasket)""",
        "fi_all": f"""
 SELECT s.items, COUNT(*) AS freq, COUNT(*) / nb.n AS support, len(s.items) AS length, nb.n AS n_baskets
 FROM subsets s, nb GROUP BY s.items, nb.n HAVING COUNT(*) >= ceil({preset.min_support} * nb.n)""",
        "cand": """
 SELECT items, freq, n_baskets,
  list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS antecedent,
  list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 0) AS consequent
 FROM (SELECT items, freq, n_baskets, unnest(range(1, (CAST(1 AS BIGINT) << length) - 1)) AS m
       FROM fi_all WHERE length >= 2)""",
        "r0": """
 SELECT c.antecedent, c.consequent, c.freq / c.n_baskets AS support,
  a.freq / c.n_baskets AS antecedent_support, b.freq / c.n_baskets AS consequent_support,
  c.freq / a.freq AS confidence
 FROM cand c JOIN fi_all a ON a.items = c.antecedent JOIN fi_all b ON b.items = c.consequent""",
        "rules": f"""
 SELECT antecedent, consequent, support, antecedent_support, consequent_support, confidence,
  confidence / consequent_support AS lift,
  support - antecedent_support * consequent_support AS leverage,
  CASE WHEN confidence = 1.0 THEN 'inf'::DOUBLE ELSE (1 - consequent_support) / (1 - confidence) END AS conviction,
  array_to_string(antecedent, ', ') AS antecedent_text, array_to_string(consequent, ', ') AS consequent_text
 FROM r0 WHERE confidence >= {preset.min_confidence} AND confidence / consequent_support >= {preset.min_lift}
  AND support <= {mx} AND antecedent_support <= {mx} AND consequent_support <= {mx}""",
        "sugg": f"""
 SELECT antecedent_text AS tetikleyici, consequent_text AS oneri,
  round_even(confidence * 1000.0, 0) / 1000.0 AS confidence, round_even(lift * 1000.0, 0) / 1000.0 AS lift,
  round_even(support * 1000.0, 0) / 1000.0 AS support,
  '''' || antecedent_text || ''' ile birlikte ''' || consequent_text || ''' de ekleyin? (%'
   || CAST(CAST(trunc(confidence * 100) AS INTEGER) AS VARCHAR) || ' müşteri tercih etti)' AS oneri_metni
 FROM rules WHERE confidence >= {preset.suggest_confidence}""",
    }


def mining_sql(body: str, label_preset) -> str:
    return with_views(body, "order_item_f", "product_f", extra=mining_ctes(*label_preset))


def _itemsets(spark, sf, label_preset):
    label, preset = label_preset
    fx = Fixtures(spark, sf)
    b = M.baskets(fx.order_item_f, fx.product_f, label)
    return M.frequent_itemsets(b, preset.min_support)


def rules_for(spark, sf, label_preset):
    label, preset = label_preset
    return M.association_rules(_itemsets(spark, sf, label_preset), preset)


RULE_COLS = ["antecedent", "consequent", "support", "antecedent_support", "consequent_support",
             "confidence", "lift", "leverage", "conviction", "antecedent_text", "consequent_text"]


@register("frequent_itemsets", mining_sql(
    f"SELECT items, freq, support, length FROM fi_all WHERE support <= {TYPE[1].max_support}", TYPE))
def frequent_itemsets(spark, sf):
    fi = _itemsets(spark, sf, TYPE)
    return M.drop_too_frequent(fi, TYPE[1].max_support).select("items", "freq", "support", "length")


@register("assoc_rules", mining_sql("SELECT * FROM rules", BRAND))
def assoc_rules(spark, sf):
    return M.sorted_rules(rules_for(spark, sf, BRAND)).select(*RULE_COLS)


@register("assoc_rules_multi", mining_sql("SELECT * FROM rules", TYPE))
def assoc_rules_multi(spark, sf):
    """Rules by product type: itemsets of size 3+ give multi-item sides."""
    return M.sorted_rules(rules_for(spark, sf, TYPE)).select(*RULE_COLS)


@register("rules_file", mining_sql("""
SELECT antecedent_text AS antecedent, consequent_text AS consequent,
 round_even(support * 10000.0, 0) / 10000.0 AS support, round_even(confidence * 10000.0, 0) / 10000.0 AS confidence,
 round_even(lift * 10000.0, 0) / 10000.0 AS lift, round_even(leverage * 10000.0, 0) / 10000.0 AS leverage,
 CASE WHEN conviction = 'inf'::DOUBLE THEN conviction ELSE round_even(conviction * 10000.0, 0) / 10000.0 END AS conviction
FROM rules""", BRAND))
def rules_file(spark, sf):
    """The rules file, written as CSV and read back."""
    path = scratch_path(spark, f"rules/{uuid.uuid4().hex}")
    files.write_csv(M.rules_file_rows(rules_for(spark, sf, BRAND)), path)
    return files.read_csv(spark, path, files.RULES_SCHEMA)


@register("suggestions", mining_sql("SELECT * FROM sugg", BRAND))
def suggestions(spark, sf):
    """The suggestions, written as JSON arrays and read back."""
    path = scratch_path(spark, f"suggestions/{uuid.uuid4().hex}")
    files.write_json_array(M.suggestions(rules_for(spark, sf, BRAND), BRAND[1]), path, ["tetikleyici", "oneri"])
    return files.read_json(spark, path, files.SUGGESTION_SCHEMA, multiline=True)


SERVICE = ("basket_type", M.SERVICE)


@register("service_rules", mining_sql("""
SELECT (SELECT COUNT(*) FROM fi_all) AS itemsets, (SELECT COUNT(*) FROM r0) AS candidates,
 (SELECT COUNT(*) FROM rules) AS rules, (SELECT COUNT(*) FROM sugg) AS suggestions,
 (SELECT COUNT(*) FROM r0 WHERE confidence >= 0.40) AS confident""", SERVICE))
def service_rules(spark, sf):
    """M6: what the service's thresholds leave: itemsets, rules before any filter, rules
    of enough confidence, rules that pass all thresholds, suggestions."""
    preset = SERVICE[1]
    fi = _itemsets(spark, sf, SERVICE)
    every = M.association_rules(fi, replace(preset, max_support=1.0, min_confidence=0.0, min_lift=0.0))
    rules = M.association_rules(fi, preset)
    counts = {"itemsets": fi, "candidates": every, "rules": rules, "suggestions": M.suggestions(rules, preset),
              "confident": every.where(F.col("confidence") >= preset.min_confidence)}
    one = spark.range(1)
    return one.select(*[df.select(F.count(F.lit(1))).scalar().alias(name) for name, df in counts.items()])


@register("rule_stats", mining_sql("""
SELECT COUNT(*) AS total_rules, count_if(confidence >= 0.7) AS high_confidence,
 count_if(lift >= 2) AS strong_lift,
 arg_min(tetikleyici || ' -> ' || oneri, (-lift, tetikleyici, oneri)) AS best_rule
FROM sugg""", BRAND))
def rule_stats(spark, sf):
    return M.rule_stats(M.suggestions(rules_for(spark, sf, BRAND), BRAND[1]))


def suggestion_table(spark, sf):
    """Rules in the suggestion format, as input for the recommenders."""
    return M.suggestions(rules_for(spark, sf, BRAND), BRAND[1]).withColumn(
        "rule_id", F.xxhash64("tetikleyici", "oneri"))
