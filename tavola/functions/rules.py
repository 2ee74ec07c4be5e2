"""Rule tables (complements, pairings, aliases, campaigns) as small DataFrames.

Rules are data: every operator takes them as DataFrames, so the same
operator runs with the source's restaurant rules or with rules over another
vocabulary.  All tables here have a fixed size and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values of the source (restaurant vocabulary).
# ---------------------------------------------------------------------------

# category id -> [(complement category id, weight)], in list order.
CATEGORY_COMPLEMENTS = {
    1: [(7, 0.9), (3, 0.7), (4, 0.7), (5, 0.6)],
    2: [(7, 0.9), (1, 0.7), (8, 0.5)],
    3: [(1, 0.95), (7, 0.9), (8, 0.6), (2, 0.4)],
    4: [(2, 0.85), (7, 0.9), (8, 0.5), (1, 0.6)],
    5: [(1, 0.85), (7, 0.9), (8, 0.6), (2, 0.5)],
    6: [(2, 0.85), (7, 0.9), (8, 0.5), (1, 0.5)],
    7: [(8, 0.85), (1, 0.6)],
    8: [(7, 0.9)],
}

# keyword -> [(target category id, target name or None, boost)], in list order.
SMART_PAIRINGS = {
    "burger": [(1, "Patates Kızartması", 0.95), (1, "Soğan Halkası", 0.80), (7, None, 0.85)],
    "cheeseburger": [(1, "Patates Kızartması", 0.95), (1, "Soğan Halkası", 0.80), (7, None, 0.85)],
    "smash": [(1, "Patates Kızartması", 0.95), (1, "Soğan Halkası", 0.80), (7, None, 0.85)],
    "pizza": [(2, None, 0.80), (7, None, 0.85)],
    "margherita": [(2, None, 0.80), (7, None, 0.85)],
    "pepperoni": [(2, None, 0.80), (7, None, 0.85)],
    "köfte": [(1, "Patates Kızartması", 0.85), (7, None, 0.80), (2, None, 0.6)],
    "kebap": [(1, None, 0.80), (7, "Şalgam", 0.90), (7, None, 0.75)],
    "antrikot": [(2, None, 0.80), (7, None, 0.85), (1, "Patates Kızartması", 0.75)],
    "wrap": [(7, None, 0.80), (1, "Patates Kızartması", 0.75)],
    "makarna": [(2, None, 0.80), (7, None, 0.75)],
    "spagetti": [(2, None, 0.80), (7, None, 0.75)],
    "fettuccine": [(2, None, 0.80), (7, None, 0.75)],
    "penne": [(2, None, 0.80), (7, None, 0.75)],
    "salata": [(7, None, 0.80), (8, None, 0.50)],
    "çorba": [(3, None, 0.70), (5, None, 0.70), (7, None, 0.60)],
    "kahve": [(8, None, 0.90)],
    "latte": [(8, None, 0.90)],
    "cappuccino": [(8, None, 0.90)],
    "çay": [(8, None, 0.85)],
    "limonata": [(8, None, 0.75), (1, None, 0.50)],
    "cheesecake": [(7, "Türk Kahvesi", 0.85), (7, None, 0.80)],
    "sütlaç": [(7, "Türk Kahvesi", 0.80), (7, None, 0.75)],
    "tiramisu": [(7, "Latte", 0.85), (7, None, 0.80)],
    "brownie": [(7, None, 0.80)],
    "waffle": [(7, None, 0.80)],
}

# Alias groups used by the basket rule match (R2): key -> aliases.
BASKET_ALIASES = {
    "burger": ["hamburger", "cheeseburger", "smash"],
    "hamburger": ["burger", "cheeseburger", "smash"],
    "pizza": ["margherita", "pepperoni"],
    "kola": ["cola", "coca"],
    "çay": ["tea"],
    "kahve": ["coffee", "latte", "cappuccino", "espresso"],
    "patates": ["fries", "kızartma"],
    "salata": ["sezar", "akdeniz", "yunan"],
    "kebap": ["kebab", "adana", "urfa", "iskender"],
    "makarna": ["spagetti", "fettuccine", "penne", "bolonez"],
    "tavuk": ["chicken", "kanat"],
    "soğan halkası": ["onion ring"],
}

# Alias groups used by the smart basket's rule boost.
SMART_ALIASES = {
    "burger": ["hamburger", "cheeseburger", "smash"],
    "hamburger": ["burger", "cheeseburger", "smash"],
    "pizza": ["margherita", "pepperoni"],
    "kahve": ["coffee", "latte", "cappuccino", "espresso"],
    "patates": ["fries", "kızartma"],
    "salata": ["sezar", "akdeniz", "yunan"],
    "makarna": ["spagetti", "fettuccine", "penne", "bolonez"],
    "tavuk": ["chicken", "kanat"],
}

# word -> canonical keyword, used by the dashboard list.
CANONICAL_KEYWORD = {
    "burger": "burger", "hamburger": "burger", "cheeseburger": "burger", "smash": "burger",
    "pizza": "pizza", "margherita": "pizza", "pepperoni": "pizza",
    "kahve": "kahve", "coffee": "kahve", "espresso": "kahve",
    "patates": "patates", "fries": "patates", "kızartma": "patates",
    "salata": "salata", "sezar": "salata", "akdeniz": "salata", "yunan": "salata",
    "makarna": "makarna", "spagetti": "makarna", "fettuccine": "makarna", "penne": "makarna",
    "bolonez": "makarna",
    "tavuk": "tavuk", "chicken": "tavuk", "kanat": "tavuk",
}

# Meal categories (burgers, pizzas, mains, pasta) and the full category set.
MEAL_CATEGORIES = [3, 4, 5, 6]
ALL_CATEGORIES = [1, 2, 3, 4, 5, 6, 7, 8]

# Campaign target name fragment -> category id (substring match, C6).
CAMPAIGN_CATEGORY_IDS = [
    ("Başlangıç", 1), ("Salata", 2), ("Burger", 3), ("Pizza", 4), ("Ana Yemek", 5),
    ("Makarna", 6), ("İçecek", 7), ("Tatlı", 8), ("Kahvaltı", 9), ("Çorba", 1),
    ("Hamur İşi", 6), ("Kebap", 5), ("İçecek - Soğuk", 7), ("İçecek - Sıcak", 7),
]

# ---------------------------------------------------------------------------
# Rules over the test-data vocabulary (product names such as "small ring").
# The source's keywords never occur in those names, so the registered
# queries pass these instead; the operators are the same.
# ---------------------------------------------------------------------------
TEST_PAIRINGS = {
    "widget": [(3, "gear", 0.9), (7, None, 0.8)],
    "gizmo": [(3, "gear", 0.9), (7, None, 0.8)],
    "plate": [(2, None, 0.8), (8, "ring", 0.7)],
    "bolt": [(1, "rod", 0.85), (7, None, 0.75)],
    "anvil": [(5, None, 0.7), (1, "plate", 0.6)],
    "ring": [(8, None, 0.5)],
}
TEST_ALIASES = {
    "widget": ["gizmo"],
    "bolt": ["rod", "gear"],
    "plate": ["anvil"],
}
TEST_CANONICAL = {"widget": "widget", "gizmo": "widget", "bolt": "bolt", "rod": "bolt",
                  "gear": "bolt", "plate": "plate", "anvil": "plate", "ring": "ring"}


def complements_df(spark: SparkSession, table=None) -> DataFrame:
    table = CATEGORY_COMPLEMENTS if table is None else table
    rows = [(src, pos, dst, w) for src, lst in table.items() for pos, (dst, w) in enumerate(lst)]
    return spark.createDataFrame(rows, "src_category int, pos int, category_id int, weight double")


def pairings_df(spark: SparkSession, table=None) -> DataFrame:
    table = SMART_PAIRINGS if table is None else table
    rows = [(kw, pos, cat, name, boost) for kw, lst in table.items()
            for pos, (cat, name, boost) in enumerate(lst)]
    return spark.createDataFrame(
        rows, "keyword string, pos int, category_id int, target_name string, boost double")


def alias_pairs_df(spark: SparkSession, table=None) -> DataFrame:
    """(word, keyword): a word that is a key or one of its aliases brings the
    key and all its aliases.  Words always bring themselves (added by the
    operator)."""
    table = BASKET_ALIASES if table is None else table
    rows = set()
    for key, aliases in table.items():
        group = [key] + list(aliases)
        for member in group:
            for kw in group:
                rows.add((member, kw))
    return spark.createDataFrame(sorted(rows), "word string, keyword string")


def canonical_df(spark: SparkSession, table=None) -> DataFrame:
    table = CANONICAL_KEYWORD if table is None else table
    return spark.createDataFrame(sorted(table.items()), "word string, canonical string")


def campaign_category_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMPAIGN_CATEGORY_IDS, "fragment string, category_id int")
