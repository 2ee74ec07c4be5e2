"""Association rules on hand-made baskets (golden values)."""
import math

from tavola.operators import mining as M


def _baskets(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["a", "c"]), (4, ["b", "c"]), (5, ["a", "b", "c"]),
            (6, ["d"]), (7, ["a", "d"]), (8, ["b"]), (9, ["a", "b"]), (10, ["c", "d"])]
    return spark.createDataFrame(rows, "basket_id long, items array<string>")


def test_itemsets_and_rules(spark):
    fi = M.frequent_itemsets(_baskets(spark), 0.2)
    sup = {tuple(r["items"]): r["freq"] for r in fi.collect()}
    assert sup[("a",)] == 6 and sup[("a", "b")] == 4 and sup[("a", "b", "c")] == 2
    preset = M.RulePreset(0.2, 1.0, 0.0, 0.0, 0.0)
    rules = {(tuple(r["antecedent"]), tuple(r["consequent"])): r
             for r in M.association_rules(fi, preset).collect()}
    r = rules[(("a",), ("b",))]
    assert math.isclose(r["support"], 0.4) and math.isclose(r["confidence"], 4 / 6)
    assert math.isclose(r["lift"], (4 / 6) / 0.6)
    assert math.isclose(r["leverage"], 0.4 - 0.6 * 0.6)
    assert math.isclose(r["conviction"], (1 - 0.6) / (1 - 4 / 6))
    # multi-item consequent from a 3-itemset
    assert (("a",), ("b", "c")) in rules
    assert math.isclose(rules[(("a",), ("b", "c"))]["confidence"], 2 / 6)


def test_conviction_infinite_at_confidence_one(spark):
    rows = [(1, ["x", "y"]), (2, ["x", "y"]), (3, ["y"]), (4, ["z"])]
    fi = M.frequent_itemsets(spark.createDataFrame(rows, "basket_id long, items array<string>"), 0.25)
    rules = M.association_rules(fi, M.RulePreset(0.25, 1.0, 0.0, 0.0, 0.0))
    r = [x for x in rules.collect() if x["antecedent"] == ["x"]][0]
    assert r["confidence"] == 1.0 and math.isinf(r["conviction"])


def test_suggestion_text_golden(spark):
    """The stored suggestions: confidence >= .55 keeps 3 of the 4 stored
    rules; message percents are truncated (94, 100, 100)."""
    rows = [("Kola / Fanta / Sprite", "Patates Kızartması", 0.0936, 0.548, 5.5399),
            ("Patates Kızartması", "Kola / Fanta / Sprite", 0.0936, 0.9461, 5.5399),
            ("Hızlı Kahvaltı Tabağı", "Sıcak Çay", 0.0577, 1.0, 4.2599),
            ("Menemen", "Sıcak Çay", 0.0513, 1.0, 4.2599)]
    df = spark.createDataFrame(rows, "antecedent_text string, consequent_text string, support double, "
                                     "confidence double, lift double")
    out = M.suggestions(df, M.SERVICE).collect()
    assert len(out) == 3
    pct = sorted(int(r["oneri_metni"].split("(%")[1].split(" ")[0]) for r in out)
    assert pct == [94, 100, 100]
    assert out[0]["oneri_metni"].startswith("'")


def test_splits_of_long_itemsets(spark):
    from pyspark.sql import functions as F
    from tavola.operators.mining import rule_candidates
    sets = [[f"i{k:02d}" for k in range(n)] for n in (1, 2, 3, 14)]
    df = spark.createDataFrame([(s, 5, 10, len(s)) for s in sets], "items array<string>, freq long, n_baskets long, length int")
    got = rule_candidates(df)
    counts = {len(r["items"]): (r["n"], r["d"]) for r in got.groupBy("items").agg(
        F.count("*").alias("n"), F.countDistinct("antecedent").alias("d")).collect()}
    assert counts == {n: (2 ** n - 2,) * 2 for n in (2, 3, 14)}
    bad = got.filter((F.size("antecedent") == 0) | (F.size("consequent") == 0)
                     | (F.size("antecedent") + F.size("consequent") != F.size("items")))
    assert bad.count() == 0
    assert rule_candidates(df.limit(0)).count() == 0
