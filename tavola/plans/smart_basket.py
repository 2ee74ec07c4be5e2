"""Smart basket with campaign flags over every basket.  Two oracles: the registered one
scores (basket, category, name), which DuckDB can do on whole tables; the brute-force one
scores every (basket, product) and is run by the tests on the smallest tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola.functions import rules as RU
from tavola.operators import campaigns as C
from tavola.operators import recommend as RC
from tavola.plans.campaigns import CTX_CTES, FRAG_SQL, SEED, order_contexts
from tavola.plans.recommend import REC_BASE, SMART_CTES, kw_cte, rules_by_name, sql_words
from tavola.plans.registry import register
from tavola.sources.fixtures import Fixtures, with_views

CAMPAIGN_CTES = {
    **{k: CTX_CTES[k] for k in ("camp", "ctx", "cands")},
    "top_campaign": CTX_CTES["top"],
    "frag": FRAG_SQL,
    "campaign": """SELECT t.context_id AS basket_id, any_value(t.title) AS campaign_title,
  coalesce(list(DISTINCT f.category_id) FILTER (f.category_id IS NOT NULL), []) AS target_ids
 FROM (SELECT context_id, title, unnest(CASE WHEN len(target_categories) = 0 THEN [''] ELSE target_categories END) AS target
       FROM top_campaign) t
 LEFT JOIN frag f ON contains(lower(t.target), lower(f.fragment)) GROUP BY t.context_id""",
}

FLAGGED = """
SELECT t.basket_id, t.rank, t.product_id, t.product_name, t.price, t.category_id,
 round_even(least(0.95, greatest(0.50, CAST(t.score AS DOUBLE) / greatest(CAST(t.mx AS DOUBLE), 0.01) * 0.95))
  * 100, 0) / 100 AS confidence, t.reason,
 coalesce(list_contains(c.target_ids, t.category_id), false) AS has_campaign,
 CASE WHEN list_contains(c.target_ids, t.category_id) THEN c.campaign_title END AS campaign_title
FROM top t LEFT JOIN campaign c ON c.basket_id = t.basket_id WHERE t.rank <= 6"""

FACTOR = """CASE WHEN {0}.category_id IN (3, 4, 5, 6) AND cc.category_id IS NOT NULL THEN 0.1
   WHEN {0}.category_id IN (3, 4, 5, 6) AND coalesce(hm.has_meal, false) THEN 0.25 ELSE 1.0 END"""

# Contributions per category, per pairing target and per name, joined per (basket, category, name).
BY_NAME_CTES = {
    **{k: SMART_CTES[k] for k in ("comp", "pair", "cat", "cart", "cart_cats", "has_meal")},
    "cls": """SELECT category_id, product_name, min(product_id) AS first_id, COUNT(*) AS class_size
 FROM cat GROUP BY category_id, product_name""",
    "own": """SELECT c.basket_id, p.category_id, p.product_name, COUNT(*) AS n_own
 FROM cart c JOIN cat p ON p.product_id = c.product_id GROUP BY c.basket_id, p.category_id, p.product_name""",
    "own_cat": "SELECT basket_id, category_id, SUM(n_own) AS n_own FROM own GROUP BY basket_id, category_id",
    "cart_words": f"""SELECT basket_id, product_id, unnest({sql_words('item_name')}) AS word,
  generate_subscripts({sql_words('item_name')}, 1) AS word_pos FROM cart""",
    "by_cat": """SELECT basket_id, category_id, SUM(score) AS score, arg_min(reason, (ph, a, b, c)) AS reason, min((ph, a, b, c)) AS k FROM (
  SELECT ct.basket_id, co.category_id, CAST(CAST(co.weight AS DECIMAL(20,10)) * 0.5 AS DECIMAL(20,10)) AS score,
   'complement-to-' || ct.item_name AS reason, 1 AS ph, ct.product_id AS a, co.pos AS b, 0 AS c
  FROM cart ct JOIN comp co ON co.src_category = ct.item_category
  UNION ALL
  SELECT w.basket_id, pr.category_id, CAST(CAST(pr.boost AS DECIMAL(20,10)) * 0.7 AS DECIMAL(20,10)), 'pairs-with-' || w.word,
   2, w.product_id, w.word_pos - 1, pr.pos FROM cart_words w JOIN pair pr ON pr.keyword = w.word AND pr.target_name IS NULL)
 GROUP BY basket_id, category_id""",
    "by_target": """SELECT w.basket_id, cl.category_id, cl.product_name,
  SUM(CAST(CAST(pr.boost AS DECIMAL(20,10)) * 0.7 AS DECIMAL(20,10))) AS score,
  arg_min('pairs-with-' || w.word, (2, w.product_id, w.word_pos - 1, pr.pos)) AS reason,
  min((2, w.product_id, w.word_pos - 1, pr.pos)) AS k
 FROM cart_words w JOIN pair pr ON pr.keyword = w.word
 JOIN cls cl ON cl.category_id = pr.category_id AND contains(lower(cl.product_name), lower(pr.target_name))
 GROUP BY w.basket_id, cl.category_id, cl.product_name""",
    "name_kw": kw_cte("(SELECT DISTINCT product_name FROM cat)", "product_name", "product_name"),
    "reach": """SELECT DISTINCT rk.tetikleyici, rk.oneri, n.product_name FROM rk JOIN name_kw n ON n.keyword = rk.keyword""",
    "by_name": """SELECT r.basket_id, re.product_name, SUM(CAST(CAST(s.confidence AS DECIMAL(20,10)) * 0.8 AS DECIMAL(20,10))) AS score,
  arg_min('apriori:' || s.tetikleyici, (-s.lift, s.tetikleyici, s.oneri)) AS reason
 FROM rel r JOIN sugg s ON s.tetikleyici = r.tetikleyici AND s.oneri = r.oneri
 JOIN reach re ON re.tetikleyici = s.tetikleyici AND re.oneri = s.oneri GROUP BY r.basket_id, re.product_name""",
    "sc": """SELECT b.basket_id, cl.category_id, cl.product_name, cl.first_id, cl.class_size, coalesce(o.n_own, 0) AS n_own,
  coalesce(d.score, 0) + coalesce(t.score, 0) + coalesce(n.score, 0) AS score,
  d.score IS NOT NULL OR t.score IS NOT NULL OR n.score IS NOT NULL AS is_scored,
  CASE WHEN d.k IS NOT NULL AND (t.k IS NULL OR d.k < t.k) THEN d.reason WHEN t.k IS NOT NULL THEN t.reason ELSE n.reason END AS reason
 FROM (SELECT DISTINCT basket_id FROM cart) b CROSS JOIN cls cl
 LEFT JOIN by_cat d ON d.basket_id = b.basket_id AND d.category_id = cl.category_id
 LEFT JOIN by_target t ON t.basket_id = b.basket_id AND t.category_id = cl.category_id AND t.product_name = cl.product_name
 LEFT JOIN by_name n ON n.basket_id = b.basket_id AND n.product_name = cl.product_name
 LEFT JOIN own o ON o.basket_id = b.basket_id AND o.category_id = cl.category_id AND o.product_name = cl.product_name""",
    "nsc": "SELECT basket_id, SUM(CASE WHEN is_scored THEN class_size - n_own ELSE 0 END) AS n FROM sc GROUP BY basket_id",
    "kept": f"""SELECT s.basket_id, s.category_id, s.product_name, s.first_id, s.n_own,
  CASE WHEN is_scored THEN s.reason ELSE 'popular-fill' END AS reason,
  CAST(CASE WHEN is_scored THEN s.score ELSE 0.15 END * {FACTOR.format('s')} AS DECIMAL(20,10)) AS score
 FROM sc s JOIN nsc ON nsc.basket_id = s.basket_id
 LEFT JOIN cart_cats cc ON cc.basket_id = s.basket_id AND cc.category_id = s.category_id
 LEFT JOIN has_meal hm ON hm.basket_id = s.basket_id
 WHERE is_scored OR (nsc.n < 6 AND s.category_id BETWEEN 1 AND 8 AND cc.category_id IS NULL)""",
    "near": """SELECT k.* FROM (SELECT *, row_number() OVER (PARTITION BY basket_id, category_id ORDER BY score DESC, first_id) AS r FROM kept) k
 LEFT JOIN own_cat oc ON oc.basket_id = k.basket_id AND oc.category_id = k.category_id WHERE k.r <= 2 + coalesce(oc.n_own, 0)""",
    "nth": "SELECT *, row_number() OVER (PARTITION BY category_id, product_name ORDER BY product_id) AS nth FROM cat",
    "ranked": """SELECT n.basket_id, p.product_id, p.product_name, p.category_id, p.price, n.score, n.reason,
  max(n.score) OVER (PARTITION BY n.basket_id) AS mx,
  row_number() OVER (PARTITION BY n.basket_id, p.category_id ORDER BY n.score DESC, p.product_id) AS cat_rank
 FROM near n JOIN nth p ON p.category_id = n.category_id AND p.product_name = n.product_name AND p.nth <= 2 + n.n_own
 ANTI JOIN cart c ON c.basket_id = n.basket_id AND c.product_id = p.product_id""",
    "top": SMART_CTES["top"],
}

VIEWS = "order_item_f", "product_f", "basket_f", "order_f"
SMART_BASKET_BRUTE_FORCE_SQL = with_views(FLAGGED, *VIEWS, extra={**REC_BASE, **SMART_CTES, **CAMPAIGN_CTES})


def basket_campaigns(spark, fx: Fixtures):
    """(basket_id, target_ids, campaign_title): the top campaign in the context of each basket's order."""
    top = C.top_campaign(C.campaign_candidates(order_contexts(fx), spark, SEED))
    ids = F.broadcast(C.target_category_ids(C.all_campaigns(spark), spark))         # a row a campaign of the fixed tables
    return (top.join(ids, "campaign_id")
            .select(F.col("context_id").alias("basket_id"), "target_ids", F.col("title").alias("campaign_title")))


@register("smart_basket", with_views(FLAGGED, *VIEWS, extra={**REC_BASE, **BY_NAME_CTES, **CAMPAIGN_CTES}))
def smart_basket(spark, sf):
    fx = Fixtures(spark, sf)
    return RC.smart_basket(
        fx.basket_f, fx.product_f, RU.complements_df(spark), RU.pairings_df(spark, RU.TEST_PAIRINGS),
        RU.alias_pairs_df(spark, RU.TEST_ALIASES), rules_by_name(spark, sf), limit=6,
        campaigns=basket_campaigns(spark, fx))
