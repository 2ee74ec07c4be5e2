"""Recommender queries over every basket / product.  The rules they use are
mined by Spark from the baskets themselves (product-name baskets, batch
thresholds); the oracle recomputes those rules in SQL and then scores every
(basket, candidate) pair by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola.functions import rules as RU
from tavola.operators import mining as M
from tavola.operators import recommend as RC
from tavola.plans.mining import mining_ctes
from tavola.plans.registry import register
from tavola.sources.fixtures import Fixtures, with_views

# Product-name baskets: name pairs are rare (64 names), so the support bound
# is lower than the batch preset and the lift bound higher (166 rules at sf0.01).
NAME = ("product_name", M.RulePreset(min_support=0.003, max_support=0.60, min_confidence=0.01,
                                     min_lift=1.2, suggest_confidence=0.01))


def rules_by_name(spark, sf):
    label, preset = NAME
    fx = Fixtures(spark, sf)
    fi = M.frequent_itemsets(M.baskets(fx.order_item_f, fx.product_f, label), preset.min_support)
    sugg = M.suggestions(M.association_rules(fi, preset), preset)
    return sugg.withColumn("rule_id", F.xxhash64("tetikleyici", "oneri"))


# ----------------------------------------------------------------- SQL pieces
def sql_words(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(trim(lower(replace({x}, '-', ' '))), '\\s+'), "
            f"lambda t: regexp_replace(t, ',+$', '')), lambda t: NOT regexp_full_match(t, '[[:punct:]]*'))")


def sql_values(rows, cols) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(cols)})"


def alias_rows(table):
    out = set()
    for key, aliases in table.items():
        g = [key] + list(aliases)
        for m in g:
            for k in g:
                out.add((m, k))
    return sorted(out)


def kw_cte(src: str, keys: str, text: str) -> str:
    """Keywords (words plus alias expansions) of ``text`` per ``keys``."""
    return f"""
 SELECT DISTINCT {keys}, keyword FROM (
  SELECT {keys}, w AS keyword FROM (SELECT {keys}, unnest({sql_words(text)}) AS w FROM {src})
  UNION ALL
  SELECT {keys}, a.keyword FROM (SELECT {keys}, unnest({sql_words(text)}) AS w FROM {src}) s
  JOIN alias_pairs a ON a.word = s.w)"""


REC_BASE = {
    **mining_ctes(*NAME),
    "alias_pairs": sql_values(alias_rows(RU.TEST_ALIASES), ["word", "keyword"]),
    "pk": kw_cte("product_f", "product_id", "product_name"),
    "bk": "SELECT DISTINCT b.basket_id, pk.keyword FROM basket_f b JOIN pk ON pk.product_id = b.product_id",
    "tk": kw_cte("sugg", "tetikleyici, oneri", "tetikleyici"),
    "rk": kw_cte("sugg", "tetikleyici, oneri", "oneri"),
    "trig": "SELECT DISTINCT bk.basket_id, tk.tetikleyici, tk.oneri FROM bk JOIN tk ON tk.keyword = bk.keyword",
    "incart": "SELECT DISTINCT bk.basket_id, rk.tetikleyici, rk.oneri FROM bk JOIN rk ON rk.keyword = bk.keyword",
    "rel": """SELECT t.* FROM trig t WHERE NOT EXISTS (SELECT 1 FROM incart c WHERE c.basket_id = t.basket_id
  AND c.tetikleyici = t.tetikleyici AND c.oneri = t.oneri)""",
}


def rec_sql(body: str, extra: dict) -> str:
    return with_views(body, "order_item_f", "product_f", "basket_f", extra={**REC_BASE, **extra})


# ----------------------------------------------------------------- R1
@register("product_recommendations", rec_sql("""
SELECT query, rank, trigger, recommendation, confidence, lift, message FROM (
 SELECT q.product_name AS query, s.tetikleyici AS trigger, s.oneri AS recommendation, s.confidence, s.lift,
  s.oneri_metni AS message,
  row_number() OVER (PARTITION BY q.product_name ORDER BY s.confidence DESC, -s.lift, s.tetikleyici, s.oneri) AS rank
 FROM (SELECT DISTINCT product_name FROM product_f) q JOIN sugg s ON contains(lower(s.tetikleyici), lower(q.product_name)))
WHERE rank <= 5""", {}))
def product_recommendations(spark, sf):
    fx = Fixtures(spark, sf)
    q = fx.product_f.select(F.col("product_name").alias("query"))
    return RC.product_recommendations(q, rules_by_name(spark, sf), 5)


# ----------------------------------------------------------------- R2
@register("basket_recommendations", rec_sql("""
SELECT basket_id, rank, tetikleyici AS trigger, oneri AS recommendation, confidence, lift, oneri_metni AS message
FROM (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY -lift, tetikleyici, oneri) AS rank FROM (
  SELECT r.basket_id, s.*, row_number() OVER (PARTITION BY r.basket_id, lower(s.oneri)
    ORDER BY -s.lift, s.tetikleyici, s.oneri) AS first_rn
  FROM rel r JOIN sugg s ON s.tetikleyici = r.tetikleyici AND s.oneri = r.oneri) WHERE first_rn = 1)
WHERE rank <= 5""", {}))
def basket_recommendations(spark, sf):
    fx = Fixtures(spark, sf)
    aliases = RU.alias_pairs_df(spark, RU.TEST_ALIASES)
    return RC.basket_recommendations(fx.basket_f, fx.product_f, rules_by_name(spark, sf), aliases, 5)


# ----------------------------------------------------------------- R3
def complement_rows():
    return [(s, pos, d, w) for s, lst in RU.CATEGORY_COMPLEMENTS.items() for pos, (d, w) in enumerate(lst)]


def pairing_rows(table):
    return [(kw, pos, c, n, b) for kw, lst in table.items() for pos, (c, n, b) in enumerate(lst)]


SMART_CTES = {
    "comp": sql_values(complement_rows(), ["src_category", "pos", "category_id", "weight"]),
    "pair": sql_values(pairing_rows(RU.TEST_PAIRINGS), ["keyword", "pos", "category_id", "target_name", "boost"]),
    "cat": "SELECT product_id, product_name, category_id, price FROM product_f WHERE is_active AND is_available",
    "cart": """SELECT DISTINCT b.basket_id, p.product_id, p.product_name AS item_name, p.category_id AS item_category
 FROM basket_f b JOIN product_f p ON p.product_id = b.product_id""",
    "bcand": """SELECT bs.basket_id, c.* FROM (SELECT DISTINCT basket_id FROM cart) bs CROSS JOIN cat c
 ANTI JOIN cart x ON x.basket_id = bs.basket_id AND x.product_id = c.product_id""",
    "ckw": kw_cte("cat", "product_id", "product_name"),
    "contrib": f"""
 SELECT ca.basket_id, ca.product_id, CAST(CAST(co.weight AS DECIMAL(20,10)) * 0.5 AS DECIMAL(20,10)) AS score,
  'complement-to-' || ct.item_name AS reason,
  1 AS ph, ct.product_id AS a, co.pos AS b, 0 AS c, 0.0 AS l, '' AS t, '' AS o
 FROM cart ct JOIN comp co ON co.src_category = ct.item_category
 JOIN bcand ca ON ca.basket_id = ct.basket_id AND ca.category_id = co.category_id
 UNION ALL
 SELECT ca.basket_id, ca.product_id, CAST(CAST(pr.boost AS DECIMAL(20,10)) * 0.7 AS DECIMAL(20,10)), 'pairs-with-' || w.word, 2, w.product_id, w.word_pos - 1, pr.pos,
  0.0, '', ''
 FROM (SELECT basket_id, product_id, unnest({sql_words('item_name')}) AS word,
        generate_subscripts({sql_words('item_name')}, 1) AS word_pos FROM cart) w
 JOIN pair pr ON pr.keyword = w.word
 JOIN bcand ca ON ca.basket_id = w.basket_id AND ca.category_id = pr.category_id
  AND (pr.target_name IS NULL OR contains(lower(ca.product_name), lower(pr.target_name)))
 UNION ALL
 SELECT DISTINCT r.basket_id, ca.product_id, CAST(CAST(s.confidence AS DECIMAL(20,10)) * 0.8 AS DECIMAL(20,10)), 'apriori:' || s.tetikleyici, 3, 0, 0, 0,
  -s.lift, s.tetikleyici, s.oneri
 FROM rel r JOIN sugg s ON s.tetikleyici = r.tetikleyici AND s.oneri = r.oneri
 JOIN rk ON rk.tetikleyici = s.tetikleyici AND rk.oneri = s.oneri
 JOIN ckw ON ckw.keyword = rk.keyword
 JOIN bcand ca ON ca.basket_id = r.basket_id AND ca.product_id = ckw.product_id""",
    "scored": """SELECT basket_id, product_id, CAST(SUM(score) AS DECIMAL(20,10)) AS score, arg_min(reason, (ph, a, b, c, l, t, o)) AS reason
 FROM contrib GROUP BY basket_id, product_id""",
    "nsc": "SELECT basket_id, COUNT(*) AS n FROM scored GROUP BY basket_id",
    "cart_cats": "SELECT DISTINCT basket_id, item_category AS category_id FROM cart",
    "has_meal": "SELECT basket_id, bool_or(item_category IN (3, 4, 5, 6)) AS has_meal FROM cart GROUP BY basket_id",
    "fill": """SELECT ca.basket_id, ca.product_id, CAST(0.15 AS DECIMAL(20,10)) AS score, 'popular-fill' AS reason FROM bcand ca
 LEFT JOIN nsc ON nsc.basket_id = ca.basket_id
 ANTI JOIN cart_cats cc ON cc.basket_id = ca.basket_id AND cc.category_id = ca.category_id
 ANTI JOIN scored s ON s.basket_id = ca.basket_id AND s.product_id = ca.product_id
 WHERE coalesce(nsc.n, 0) < 6""",
    "allsc": """SELECT a.basket_id, a.product_id, c.product_name, c.category_id, c.price,
  CAST(a.score * CASE WHEN c.category_id IN (3, 4, 5, 6) AND cc.category_id IS NOT NULL THEN 0.1
   WHEN c.category_id IN (3, 4, 5, 6) AND coalesce(hm.has_meal, false) THEN 0.25 ELSE 1.0 END AS DECIMAL(20,10)) AS score,
  a.reason
 FROM (SELECT * FROM scored UNION ALL SELECT * FROM fill) a JOIN cat c ON c.product_id = a.product_id
 LEFT JOIN cart_cats cc ON cc.basket_id = a.basket_id AND cc.category_id = c.category_id
 LEFT JOIN has_meal hm ON hm.basket_id = a.basket_id""",
    "ranked": """SELECT *, max(score) OVER (PARTITION BY basket_id) AS mx,
  row_number() OVER (PARTITION BY basket_id, category_id ORDER BY score DESC, product_id) AS cat_rank FROM allsc""",
    "top": """SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY score DESC, product_id) AS rank
 FROM ranked WHERE cat_rank <= 2""",
}
