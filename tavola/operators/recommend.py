"""Recommenders (R1-R8) for many baskets / products at once.

Matching is done with equi-joins, never with a product of baskets and catalogue:

* keyword overlap (R2, R3c) explodes words and joins on the word;
* "name contains text" (R1, R4) looks needles up by their first letters
  (``text_match``);
* candidate scoring (R3, R4) scores zones of the catalogue and lists of names
  (``score_lists``); a threshold search takes the best products of each zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tavola.functions import rules as RU
from tavola.operators.basket_top import ZoneTables, best_of_basket, zone_scores
from tavola.operators.numbering import numbered
from tavola.operators.text_match import contained
from tavola.operators.score_lists import rank_in, zone_lists, zone_tables
from tavola.session import cut_lineage, reuse


# ---------------------------------------------------------------------------
# token helpers
# ---------------------------------------------------------------------------
def words(text: Column) -> Column:
    """Lower-case, '-' -> blank, split on blanks; trailing commas stripped and
    punctuation-only tokens dropped (D12)."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(text), "-", " ")), r"\s+")
    parts = F.transform(parts, lambda t: F.regexp_replace(t, ",+$", ""))
    return F.filter(parts, lambda t: ~t.rlike(r"^\p{Punct}*$"))


def keywords(df: DataFrame, keys: list[str], text: str, alias_pairs: DataFrame | None) -> DataFrame:
    """(keys, keyword): the words of ``text`` plus their alias expansions."""
    w = df.select(*keys, F.explode(words(F.col(text))).alias("word"))
    own = w.select(*keys, F.col("word").alias("keyword"))
    if alias_pairs is None:
        return own.distinct()
    more = w.join(alias_pairs, "word").select(*keys, "keyword")
    return own.unionByName(more).distinct()


# Scores are summed as decimals so that equal scores are exactly equal
# (ties then fall to the product id, independent of summation order).
SCORE = "decimal(20,10)"


def dec(x) -> Column:
    return (F.lit(x) if isinstance(x, (int, float)) else (F.col(x) if isinstance(x, str) else x)).cast(SCORE)


def times(a, b) -> Column:
    return (dec(a) * dec(b)).cast(SCORE)


def rule_order(rules: DataFrame) -> DataFrame:
    """Rules in the source's list order: lift desc, then texts (an explicit
    key instead of file position)."""
    return rules.withColumn("rule_key", F.struct((-F.col("lift")).alias("l"), "tetikleyici", "oneri"))


def loop_key(phase: int, a=None, b=None, c=None) -> Column:
    """Position of a contribution in the source's loop order, compared field by
    field: phase, cart item id, word position, list position."""
    def lng(x):
        return (F.lit(0) if x is None else (F.col(x) if isinstance(x, str) else x)).cast("long")
    return F.struct(F.lit(phase).alias("ph"), lng(a).alias("a"), lng(b).alias("b"), lng(c).alias("c")).alias("key")


# ---------------------------------------------------------------------------
# By product name
# ---------------------------------------------------------------------------
def product_recommendations(queries: DataFrame, rules: DataFrame, limit: int = 5) -> DataFrame:
    """For each query text: rules whose trigger contains it (ignoring case),
    by confidence, first ``limit``.  ``queries`` has column ``query``."""
    triggers = rules.select("rule_id", F.lower("tetikleyici").alias("trigger_text"))
    asked = queries.select("query").distinct().withColumn("needle", F.lower("query"))
    hits = (asked.join(contained(triggers, "trigger_text", asked, "needle"), "needle").join(triggers, "trigger_text")
            .select("query", "rule_id").join(rule_order(rules), "rule_id"))
    w = Window.partitionBy("query").orderBy(F.desc("confidence"), F.col("rule_key"))
    return (hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
                .select("query", "rank", F.col("tetikleyici").alias("trigger"),
                        F.col("oneri").alias("recommendation"), "confidence", "lift",
                        F.col("oneri_metni").alias("message")))


# ---------------------------------------------------------------------------
# R2: by basket
# ---------------------------------------------------------------------------
def product_words(products: DataFrame, alias_pairs: DataFrame | None) -> DataFrame:
    """(product_id, keys): the keywords of each product that has any."""
    return (keywords(products.select("product_id", "product_name"), ["product_id"], "product_name", alias_pairs)
            .groupBy("product_id").agg(F.sort_array(F.collect_set("keyword")).alias("keys")))


def rule_words(rules: DataFrame, alias_pairs: DataFrame | None) -> DataFrame:
    """(rule_id, trigger_words, result_words): the keywords of both sides of each rule."""
    def of(text: str, name: str) -> DataFrame:
        return keywords(rules, ["rule_id"], text, alias_pairs).groupBy("rule_id").agg(F.collect_set("keyword").alias(name))
    return (rules.select("rule_id").join(of("tetikleyici", "trigger_words"), "rule_id")
            .join(of("oneri", "result_words"), "rule_id", "left")
            .withColumn("result_words", F.coalesce("result_words", F.expr("CAST(array() AS array<string>)"))))


def relevant_rules(sets: DataFrame, rules: DataFrame, alias_pairs: DataFrame | None) -> DataFrame:
    """(set_id, rule_id) of word sets (set_id, words) and the rules whose trigger
    keywords meet the set and whose result keywords do not (J11, U3).

    A pair is kept at the smallest word that both have, so no pair is made twice
    and none has to be made distinct."""
    by_word = rule_words(rules, alias_pairs).withColumn("word", F.explode("trigger_words"))
    first = F.array_min(F.array_intersect("words", "trigger_words")) == F.col("word")
    return (sets.select("set_id", "words", F.explode("words").alias("word")).join(by_word, "word")
            .where(first & ~F.arrays_overlap("words", "result_words")).select("set_id", "rule_id"))


def word_sets(baskets: DataFrame, products: DataFrame, alias_pairs: DataFrame | None) -> DataFrame:
    """(basket_id, set_id, words): the sorted keywords of each basket; set_id is their md5.
    A basket line brings its product's keywords as one array."""
    return (baskets.select("basket_id", "product_id").join(product_words(products, alias_pairs), "product_id")
            .groupBy("basket_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("words"))
            .withColumn("set_id", F.md5(F.to_json("words"))))


def basket_recommendations(baskets: DataFrame, products: DataFrame, rules: DataFrame,
                           alias_pairs: DataFrame | None, limit: int = 5) -> DataFrame:
    """The first ``limit`` rules of each basket in rule order.

    What a basket gets depends only on its set of keywords, so the rules are
    matched once per distinct set (its key is an md5 of the sorted words) and
    the few rows of each set are joined back to its baskets."""
    rules = reuse(rules)
    words_of = reuse(word_sets(baskets, products, alias_pairs))
    sets = words_of.select("set_id", "words").distinct()
    m = relevant_rules(sets, rules, alias_pairs).join(rule_order(rules), "rule_id")
    # First rule per result name (ignoring case) in rule order
    first = m.groupBy("set_id", F.lower("oneri").alias("_rec")).agg(
        F.min_by(F.struct("tetikleyici", "oneri", "confidence", "lift", "oneri_metni", "rule_key"),
                 F.col("rule_key")).alias("r")).select("set_id", "r.*")
    w = Window.partitionBy("set_id").orderBy("rule_key")
    top = (first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
                .select("set_id", "rank", F.col("tetikleyici").alias("trigger"),
                        F.col("oneri").alias("recommendation"), "confidence", "lift",
                        F.col("oneri_metni").alias("message")))
    return words_of.select("basket_id", "set_id").join(top, "set_id").drop("set_id")


# ---------------------------------------------------------------------------
# Smart basket
# ---------------------------------------------------------------------------
CATEGORY_CAP = 2
FILL_UNITS = 15 * 10 ** 8           # 0.15


def smart_basket(baskets: DataFrame, products: DataFrame, complements: DataFrame,
                 pairings: DataFrame, alias_pairs: DataFrame | None, rules: DataFrame,
                 limit: int = 6, campaigns: DataFrame | None = None,
                 meal_categories=tuple(RU.MEAL_CATEGORIES), all_categories=tuple(RU.ALL_CATEGORIES)) -> DataFrame:
    """Top ``limit`` candidates per basket (R3a-R3f, R8, W5, W7, W10).

    ``baskets``: (basket_id, product_id).  ``products``: catalogue with
    product_name, category_id, price, is_active, is_available.
    ``campaigns``: optional (basket_id, target_ids array<int>, campaign_title).

    Rules boost names, once per distinct set of cart words; the lists of a set's best
    products by zone (``score_lists``) are shared by all its baskets.  A basket stays one
    row with its items as an array: complements and pairings, fixed rule tables, score its
    zones, it takes from its set's list what its own items leave (``basket_top``), and only its
    ``limit`` rows are made of it.  No (basket, candidate) table is written, sorted or shuffled."""
    catalog = reuse(products.filter(F.col("is_active") & F.col("is_available"))
                            .select("product_id", "product_name", "category_id", "price"))
    classes, zones = zone_tables(catalog, pairings)
    classes, zones = cut_lineage(classes), cut_lineage(zones)
    rules = reuse(rules)
    fixed = sorted(zones.collect(), key=lambda z: z.zone_id)                # of fixed rule tables
    units = lambda score: (score * 10 ** 10).cast("long")                   # noqa: E731  SCORE as a whole number

    # Category complement per cart item, keyword pairing per word of each item
    complement, pairing = {}, {}
    for r in complements.withColumn("u", units(times("weight", 0.5))).collect():
        for z in (z for z in fixed if z.category_id == r.category_id):
            per = complement.setdefault(r.src_category, {})
            per[z.zone_id] = per.get(z.zone_id, 0) + r.u
    for r in pairings.withColumn("u", units(times("boost", 0.7))).collect():
        for z in fixed:
            if (r.keyword, r.pos) in {tuple(t) for t in z.targets} if r.target_name is not None else z.category_id == r.category_id:
                per = pairing.setdefault(r.keyword, {})
                per[z.zone_id] = per.get(z.zone_id, 0) + r.u
    paired_words = sorted(pairing)
    scores = lambda per: [per.get(z.zone_id) for z in fixed]               # noqa: E731
    tables = ZoneTables([z.category_id for z in fixed], [z.zone_size for z in fixed],
                        {k: scores(per) for k, per in complement.items()}, [scores(pairing[w]) for w in paired_words])

    def code(x: Column, of: list) -> Column:
        """Place of a text in a list of the rule tables."""
        return F.try_element_at(F.create_map(*[F.lit(v) for i, k in enumerate(of) for v in (k, i)]), x) if of else F.lit(None).cast("int")

    zone = code(F.col("zone_id"), [z.zone_id for z in fixed])
    no_codes = F.expr("CAST(array() AS array<int>)")

    # a row a basket
    in_zone = catalog.join(classes.select("category_id", "product_name", "zone_id"), ["category_id", "product_name"])
    own_zones = in_zone.groupBy("product_id").agg(F.collect_list(zone).alias("own"))
    paired = F.transform(F.filter(words(F.col("product_name")), lambda w: w.isin(*paired_words)), lambda w: code(w, paired_words))
    about = (products.select("product_id", F.col("product_name").alias("item_name"), F.col("category_id").alias("item_category"),
                             F.coalesce(paired, no_codes).alias("paired"))
             .join(product_words(products, alias_pairs).withColumn("keys", F.array_join("keys", "\n")), "product_id", "left")
             .join(own_zones, "product_id", "left").withColumn("own", F.coalesce("own", no_codes)))
    item = F.struct("product_id", "item_name", "item_category", "paired", "keys", "own")
    carts = (baskets.select("basket_id", "product_id").distinct().join(about, "product_id").groupBy("basket_id")
             .agg(F.sort_array(F.collect_list(item)).alias("items"))
             .withColumn("words", F.array_join("items.keys", "\n")).where("words <> ''")       # no word holds a line break
             .withColumn("words", F.sort_array(F.array_distinct(F.split("words", "\n"))))
             .select("basket_id", F.md5(F.array_join("words", "\n")).alias("set_id"), "words", F.col("items.product_id").alias("item_ids"),
                     F.col("items.item_name").alias("item_names"), F.col("items.item_category").alias("item_categories"),
                     F.flatten("items.paired").alias("word_codes"), F.flatten("items.own").alias("own")))
    flags = [] if campaigns is None else ["target_ids", "campaign_title"]
    if flags:           # here, where the baskets lie by their id
        carts = carts.join(campaigns.select("basket_id", *flags), "basket_id", "left")
    scored = carts.withColumn("_z", zone_scores(tables)(F.col("item_categories"), F.col("word_codes"), F.col("own")))
    scored = reuse(scored.select("*", "_z.*").drop("_z", "own"))
    sets = scored.select("set_id", "words").distinct()
    scored = scored.drop("words")

    # Rules boost names, once per distinct set of words
    rel = relevant_rules(sets, rules, alias_pairs)
    result_words = keywords(rules.select("oneri").distinct(), ["oneri"], "oneri", alias_pairs)
    names = keywords(classes.select("product_name").distinct(), ["product_name"], "product_name", alias_pairs)
    reaches = result_words.join(names, "keyword").select("oneri", "product_name").distinct()
    per_text = (rel.join(rule_order(rules).select("rule_id", "oneri", "confidence", "tetikleyici", "rule_key"), "rule_id")
                   .groupBy("set_id", "oneri").agg(F.sum(times("confidence", 0.8)).cast(SCORE).alias("boost"),
                                                   F.min("rule_key").alias("rule_key")))
    boosts = cut_lineage(per_text.join(reaches, "oneri").groupBy("set_id", "product_name").agg(
        F.sum("boost").cast(SCORE).alias("boost"), F.min("rule_key").alias("rule_key")))

    # the best products by set and zone; a basket's own items are left out of them later
    places = range(len(fixed))
    at_most = [F.max(F.get("n_own", F.lit(k))).alias(f"n{k}") for k in places] + [F.max(F.get("base", F.lit(k)).isNotNull()).alias(f"e{k}") for k in places]
    per_zone = [F.struct(F.lit(z.zone_id).alias("zone_id"), (F.lit(CATEGORY_CAP) + F.col(f"n{k}")).cast("int").alias("m"), F.col(f"e{k}").alias("every"))
                for k, z in enumerate(fixed)] or [F.lit(None).cast("struct<zone_id:string,m:int,every:boolean>")]
    wanted = (scored.groupBy("set_id").agg(F.count(F.lit(1)).alias("_n"), *at_most)
              .select("set_id", F.explode(F.array(*per_zone)).alias("z")).select("set_id", "z.*").where("zone_id IS NOT NULL"))
    lists = zone_lists(boosts, wanted, catalog, classes)
    prices = catalog.groupBy("product_id").agg(F.collect_list(F.struct("price")).alias("prices"))
    by_rule = boosts.select("set_id", "product_name", F.concat(F.lit("apriori:"), "rule_key.tetikleyici").alias("reason"))
    # in the order of equal scores
    text = F.struct("product_id", "category_id", "z", "product_name", "reason", "prices").alias("text")
    candidate = F.struct(text, units(F.col("boost")).alias("u"), "reached")
    listed = (lists.join(by_rule, ["set_id", "product_name"], "left").join(zones.select("zone_id", "category_id"), "zone_id")
              .join(prices, "product_id").withColumn("z", zone).groupBy("set_id").agg(F.sort_array(F.collect_list(candidate)).alias("list"))
              .select("set_id", "list.text", "list.u", "list.reached", F.col("list.text.z").alias("z"), F.col("list.text.product_id").alias("ids")))

    # R3d: fill when fewer than `limit` products are scored
    of_text = listed.schema["text"].dataType
    least = scored.agg(F.min("n_zone")).first()[0]
    if least is None or least >= limit:
        whole = scored.withColumn("fill", F.lit(None).cast(of_text))
    else:
        few = reuse(scored.where(F.col("n_zone") < limit))
        fill = basket_fill(few, boosts, classes, in_zone, prices, [z.zone_id for z in fixed], limit, all_categories)
        fill = fill.groupBy("basket_id").agg(F.sort_array(F.collect_list(text)).cast(of_text).alias("fill"))
        whole = (scored.where(F.col("n_zone") >= limit).withColumn("fill", F.lit(None).cast(of_text))
                 .unionByName(few.join(fill, "basket_id", "left")))
    whole = whole.select("basket_id", "set_id", "item_ids", "item_names", "item_categories", "word_codes", "fill", *flags)

    # what the basket's own items leave, R3e, R3f
    ranked = best_of_basket(tables, meal_categories, all_categories, CATEGORY_CAP, limit, FILL_UNITS)
    whole = whole.join(listed, "set_id", "left")
    # an empty list, not null: Spark's Arrow writer goes over all nulls of a list column again with each row of a batch
    lists_of = {c: F.coalesce(F.col(c), F.array().cast(whole.select(c).schema[0].dataType))
                for c in ("ids", "z", "u", "reached", "fill.product_id", "fill.category_id")}
    top = ranked(F.col("item_ids"), F.col("item_categories"), F.col("word_codes"), *lists_of.values())
    rows = whole.withColumn("_top", top)
    out = rows.select("basket_id", "item_names", "text", "fill", *flags, F.posexplode("_top").alias("_at", "c"))
    why = (F.when(F.col("c.item") >= 0, F.concat(F.lit("complement-to-"), F.get("item_names", F.col("c.item"))))
           .when(F.col("c.word") >= 0, F.concat(F.lit("pairs-with-"), F.get(F.array(*[F.lit(w) for w in paired_words] or [F.lit("")]), F.col("c.word")))))
    of_list = F.when(F.col("c.at") >= 0, F.get("text", F.col("c.at"))).otherwise(F.get("fill", -1 - F.col("c.at")))
    out = out.select("basket_id", (F.col("_at") + 1).alias("rank"), of_list.alias("t"), "c.confidence", why.alias("_why"), *flags)
    out = out.select("basket_id", "rank", "t.product_id", "t.product_name", F.explode("t.prices").alias("p"), "t.category_id", "confidence",
                     F.coalesce("_why", "t.reason").alias("reason"), *flags)
    flag = F.coalesce(F.array_contains("target_ids", F.col("category_id")), F.lit(False)) if flags else F.lit(False)
    title = F.when(flag, F.col("campaign_title")) if flags else F.lit(None).cast("string")
    return out.select("basket_id", "rank", "product_id", "product_name", "p.price", "category_id", "confidence", "reason",
                      flag.alias("has_campaign"), title.alias("campaign_title"))


def basket_fill(few: DataFrame, boosts: DataFrame, classes: DataFrame, in_zone: DataFrame, prices: DataFrame,
                zone_ids: list[str], limit: int, all_categories) -> DataFrame:
    """R3d: (basket_id, category_id, product_id, product_name, z, reason, prices): the first products of
    the categories that a basket lacks, for those of ``few`` whose scored products are fewer than ``limit``."""
    cart = few.select("basket_id", F.explode(F.arrays_zip("item_ids", "item_categories")).alias("x")).select(
        "basket_id", F.col("x.item_ids").alias("product_id"), F.col("x.item_categories").alias("category_id"))
    ids = F.array(*[F.lit(z) for z in zone_ids]).cast("array<string>").alias("zone_id")
    in_base = (few.select("basket_id", F.explode(F.arrays_zip(ids, "base")).alias("z"))
               .where("z.base IS NOT NULL").select("basket_id", "z.zone_id"))
    few_sets = few.select("basket_id", "set_id", "n_zone")
    more = (few_sets.join(boosts.select("set_id", "product_name"), "set_id").join(classes, "product_name")
            .join(in_base, ["basket_id", "zone_id"], "left_anti"))
    taken = (few_sets.join(boosts.select("set_id", "product_name"), "set_id")
             .join(cart.select("basket_id", "product_id"), "basket_id").join(in_zone, ["product_id", "product_name"])
             .join(in_base, ["basket_id", "zone_id"], "left_anti")
             .groupBy("basket_id").agg(F.count(F.lit(1)).alias("n_taken")))
    reached = more.groupBy("basket_id").agg(F.sum("class_size").alias("n_reached"))
    needs = (few_sets.join(reached, "basket_id", "left").join(taken, "basket_id", "left")
             .where(F.col("n_zone") + F.coalesce("n_reached", F.lit(0)) - F.coalesce("n_taken", F.lit(0)) < limit)
             .select("basket_id", "set_id"))
    first = rank_in(in_zone.drop("price"), ["category_id"], ["product_id"], "_nth", CATEGORY_CAP + limit)
    return (needs.withColumn("category_id", F.explode(F.array(*[F.lit(c) for c in all_categories])))
            .join(cart.select("basket_id", "category_id"), ["basket_id", "category_id"], "left_anti").join(first, "category_id")
            .join(in_base, ["basket_id", "zone_id"], "left_anti")
            .join(boosts.select("set_id", "product_name"), ["set_id", "product_name"], "left_anti").join(prices, "product_id")
            .withColumns({"z": F.lit(-1), "reason": F.lit("popular-fill")}))


def rule_name_matches(rules: DataFrame, names: DataFrame) -> DataFrame:
    """(rule_id, product_name) where a result name rn of the rule (comma list) and the
    product name n satisfy: rn in n, or n in rn, or a word of rn longer than 3 letters
    is in n (all lower case)."""
    rn = rules.select("rule_id", F.explode(F.transform(F.split("oneri", ","),
                                                       lambda x: F.lower(F.trim(x)))).alias("rn"))
    names = names.select("product_name").distinct().withColumn("name", F.lower("product_name"))
    terms = rn.unionByName(
        rn.select("rule_id", F.explode(F.filter(F.split("rn", " "), lambda w: F.length(w) > 3)).alias("rn")))
    hits = (contained(names, "name", terms, "rn").unionByName(contained(rn, "rn", names, "name").select("name", "rn"))).distinct()
    return (terms.distinct().join(hits, "rn").join(names, "name").select("rule_id", "product_name").distinct())


# ---------------------------------------------------------------------------
# Per-product dashboard list
# ---------------------------------------------------------------------------
def dashboard_recommendations(products: DataFrame, complements: DataFrame, pairings: DataFrame,
                              canonical: DataFrame, rules: DataFrame, limit: int = 8,
                              all_categories=tuple(RU.ALL_CATEGORIES)) -> DataFrame:
    """For every catalogue product: ``limit`` other products by score
    (complement x .5; pairing x .6 on a name match else x .3; rule x .4 once
    per rule; fill .05 from other categories), score capped at 1.

    Complements and pairings score zones, for each (category, name) that asks; rules
    boost names, for each distinct set of asking words.  The best products by zone come
    from the sets' lists (``score_lists``); no name meets every other name."""
    catalog = reuse(products.filter(F.col("is_active") & F.col("is_available"))
                            .select("product_id", "product_name", "category_id", "price"))
    classes, zones = zone_tables(catalog, pairings)
    classes, zones = cut_lineage(classes), cut_lineage(zones)
    rules = reuse(rule_order(rules))
    q = reuse(classes.select(F.col("category_id").alias("q_cat"), F.col("product_name").alias("q_name")))
    qkey = ["q_cat", "q_name"]
    of_zone = zones.select("zone_id", "category_id", "targets")
    # phase 1
    p1 = (q.join(complements, q.q_cat == complements.src_category).join(of_zone, "category_id")
           .select(*qkey, "zone_id", times("weight", 0.5).alias("score"),
                   F.lit("Kategori tamamlayıcı").alias("reason"), loop_key(1, "pos")))
    # phase 2: canonical keyword first, the word itself when the canonical has no pairing
    qw = reuse(q.select("q_name").distinct().select("q_name", F.posexplode(words(F.col("q_name"))).alias("word_pos", "word")))
    known = pairings.select(F.col("keyword").alias("canonical")).distinct().withColumn("_has", F.lit(True))
    by_key = (qw.join(canonical, "word", "left").withColumn("canonical", F.coalesce("canonical", "word"))
              .join(known, "canonical", "left").withColumn("keyword", F.when(F.col("_has"), F.col("canonical")).otherwise(F.col("word"))))
    match = F.col("target_name").isNotNull() & F.array_contains("targets", F.struct("keyword", "pos"))
    p2 = (by_key.join(pairings, "keyword").join(of_zone, "category_id").join(q, "q_name")
          .select(*qkey, "zone_id", times("boost", F.when(match, dec(0.6)).otherwise(dec(0.3))).alias("score"),
                  F.when(match, F.concat(F.lit("'"), F.col("q_name"), F.lit("' ile eşleşme")))
                  .otherwise(F.lit("Akıllı eşleştirme")).alias("reason"), loop_key(2, "word_pos", "pos")))
    base = reuse(p1.unionByName(p2).groupBy(*qkey, "zone_id").agg(
        F.sum("score").cast(SCORE).alias("score"), F.min_by("reason", "key").alias("reason")))
    # phase 3: an asking word (> 2 letters) inside the trigger; result names vs candidate name
    asking = (qw.where(F.length("word") > 2).groupBy("q_name").agg(F.sort_array(F.collect_set("word")).alias("words"))
              .withColumn("set_id", F.md5(F.to_json("words"))))
    none = F.md5(F.lit("[]"))
    set_of = reuse(q.select("q_name").distinct().join(asking, "q_name", "left").withColumn("set_id", F.coalesce("set_id", none)))
    sets = set_of.select("set_id", F.explode("words").alias("word")).distinct()
    triggers = rules.select("rule_id", F.lower("tetikleyici").alias("trigger_text"))
    asked = (sets.join(contained(triggers, "trigger_text", sets, "word"), "word").join(triggers, "trigger_text")
             .select("set_id", "rule_id").distinct())
    reach = rule_name_matches(rules, classes)
    boosts = cut_lineage(asked.join(reach, "rule_id").join(rules.select("rule_id", "confidence", "rule_key"), "rule_id")
                         .groupBy("set_id", "product_name").agg(
                             F.sum(times("confidence", 0.4)).cast(SCORE).alias("boost"),
                             F.min_by("confidence", "rule_key").alias("first_confidence")))
    # the best of each zone; one place more, because the product itself may be among them
    zone_ids = F.array(*[F.lit(r.zone_id) for r in zones.select("zone_id").collect()])      # of fixed rule tables
    scored_zone = base.join(set_of.select("q_name", "set_id"), "q_name").select("set_id", "zone_id").distinct().withColumn("every", F.lit(True))
    wanted = (set_of.select("set_id").distinct().withColumn("zone_id", F.explode(zone_ids))
              .join(scored_zone, ["set_id", "zone_id"], "left")
              .select("set_id", "zone_id", F.lit(limit + 1).alias("m"), F.coalesce("every", F.lit(False)).alias("every")))
    lists = zone_lists(boosts, wanted, catalog, classes)
    qset = reuse(q.join(set_of.select("q_name", "set_id"), "q_name"))
    by_rule = boosts.select("set_id", "product_name", F.format_string(
        "Apriori (güven: %%%d)", (F.col("first_confidence") * 100).cast("int")).alias("_rule"))
    cand = (qset.join(lists, "set_id").join(base, [*qkey, "zone_id"], "left").where("reached OR score IS NOT NULL")
            .join(by_rule, ["set_id", "product_name"], "left")
            .select(*qkey, "product_id", (F.coalesce("score", dec(0)) + F.col("boost")).cast(SCORE).alias("score"),
                    F.coalesce("reason", "_rule").alias("reason")))
    # phase 4: fill from other categories when fewer than `limit` are scored
    own = classes.select(F.col("category_id").alias("q_cat"), F.col("product_name").alias("q_name"), "zone_id").withColumn("_own", F.lit(1))
    sizes = (base.join(zones.select("zone_id", "zone_size"), "zone_id").join(own, [*qkey, "zone_id"], "left")
             .groupBy(*qkey).agg(F.sum(F.col("zone_size") - F.coalesce("_own", F.lit(0))).alias("n_zone")))
    few = (qset.join(sizes, qkey, "left").withColumn("n_zone", F.coalesce("n_zone", F.lit(0))).where(F.col("n_zone") < limit))
    reached = (few.join(boosts.select("set_id", "product_name"), "set_id").join(classes, "product_name")
               .join(base.select(*qkey, "zone_id"), [*qkey, "zone_id"], "left_anti")
               .withColumn("_self", ((F.col("category_id") == F.col("q_cat")) & (F.col("product_name") == F.col("q_name"))).cast("int"))
               .groupBy(*qkey).agg(F.sum(F.col("class_size") - F.col("_self")).alias("n_reached")))
    needs = few.join(reached, qkey, "left").where(F.col("n_zone") + F.coalesce("n_reached", F.lit(0)) < limit).select(*qkey, "set_id")
    in_zone = catalog.join(classes.select("category_id", "product_name", "zone_id"), ["category_id", "product_name"]).drop("price")
    first = rank_in(in_zone, ["category_id"], ["product_id"], "_nth", 2 * limit + 1)
    fill = (needs.withColumn("category_id", F.explode(F.array(*[F.lit(c) for c in all_categories])))
            .where("category_id <> q_cat").join(first, "category_id")
            .join(base.select(*qkey, "zone_id"), [*qkey, "zone_id"], "left_anti")
            .join(boosts.select("set_id", "product_name"), ["set_id", "product_name"], "left_anti")
            .select(*qkey, "product_id", dec(0.05).alias("score"), F.lit("Popüler ürün").alias("reason")))
    best = rank_in(cand.unionByName(fill), qkey, [F.desc("score"), F.asc("product_id")], "_r", limit + 1)
    recs = best.join(catalog, "product_id").select(
        *qkey, F.col("product_id").alias("rec_id"), F.col("product_name").alias("rec_name"),
        F.col("category_id").alias("rec_category"), "price", "score", "reason")
    # dealt by product first: each asks for its own rows in the task that ranks them
    asking_products = catalog.select("product_id", F.col("category_id").alias("q_cat"), F.col("product_name").alias("q_name")).repartition("product_id")
    out = asking_products.join(recs, qkey).filter(F.col("rec_id") != F.col("product_id"))
    out = out.withColumn("rank", F.row_number().over(
        Window.partitionBy("product_id").orderBy(F.desc("score"), "rec_id"))).filter(F.col("rank") <= limit)
    conf = F.least(F.col("score").cast("double"), F.lit(1.0))
    return out.select("product_id", "rank", "rec_id", "rec_name", "rec_category", "price",
                      (F.rint(conf * 1000) / 1000).alias("confidence"), "reason")


# ---------------------------------------------------------------------------
# Meal wizard (seeded hash order instead of an unseeded shuffle)
# ---------------------------------------------------------------------------
# Hunger level -> category ids; drink keyword lists.
HUNGER_CATEGORIES = {"az": [2, 1], "orta": [3, 4, 6], "cok": [5, 3]}
HOT_DRINK_WORDS = ["kahve", "latte", "cappuccino", "espresso", "çay", "sıcak"]
HEAVY_DRINK_WORDS = ["Kola", "Fanta", "Ayran", "Şalgam", "Ice Tea"]
LIGHT_DRINK_WORDS = ["Su", "Soda", "Limonata", "Ice Tea"]
HEAVY_MEAL_CATEGORIES = [3, 4, 5, 6]

# A request draws its picks on its own: slot k of a request is a hash of
# (request, slot, seed) that points into the numbered pool of its level, skipping
# what earlier slots have drawn.  No request x catalogue product is formed.


def _draws(size: Column, n: int, seed: int) -> Column:
    """Up to n different numbers below ``size``, drawn by ``request_id``."""
    def hashed(slot: Column) -> Column:
        text = F.concat_ws("-", F.col("request_id").cast("string"), slot.cast("string"), F.lit(str(seed)))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")

    def draw(taken: Column, slot: Column) -> Column:
        free = F.pmod(hashed(slot), size - slot)        # the free-th number that is not taken yet
        number = F.aggregate(F.array_sort(taken), free, lambda i, t: F.when(i >= t, i + 1).otherwise(i))
        return F.array_append(taken, number)

    slots = F.slice(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), F.lit(1),
                    F.least(size, F.lit(n)).cast("int"))
    return F.aggregate(slots, F.expr("array()").cast("array<long>"), draw)


def _pick(requests: DataFrame, pool: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """Rows (request columns, slot, pool columns): n draws per request from the
    pool rows of its ``group``; the groups are levels of a fixed rule table."""
    pool = cut_lineage(numbered(pool, [group], ["product_id"]))
    sizes = pool.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()         # a row a level
    if not sizes:
        return requests.withColumn("slot", F.lit(0)).join(pool.drop("number"), group).limit(0)
    size = F.create_map(*[F.lit(x) for r in sizes for x in (r[group], r["n"])])
    drawn = (requests.withColumn("_size", F.try_element_at(size, F.col(group))).where("_size IS NOT NULL")
             .select("*", F.posexplode(_draws(F.col("_size"), n, seed)).alias("slot", "number")).drop("_size"))
    return drawn.join(pool, [group, "number"]).drop("number")


def wizard_mains(products: DataFrame, requests: DataFrame, seed: int, n: int = 4) -> DataFrame:
    """``requests`` (request_id, hunger) -> n mains from the level's
    categories in seeded random order, drawn for each request."""
    spark = requests.sparkSession
    levels = spark.createDataFrame([(h, c) for h, cats in HUNGER_CATEGORIES.items() for c in cats],
                                   "hunger string, category_id int")
    pool = products.select("product_id", "product_name", "category_id", "price").join(F.broadcast(levels), "category_id")
    req = requests.select("request_id", F.when(F.col("hunger").isin("az", "orta"), F.col("hunger"))
                          .otherwise(F.lit("cok")).alias("hunger"))
    return _pick(req, pool, "hunger", n, seed).select(
        "request_id", (F.col("slot") + 1).alias("pick"), "product_id", "product_name", "category_id", "price")


def _any_contains(name: Column, ws: list[str], lower: bool = False) -> Column:
    e = None
    for wd in ws:
        c = (F.lower(name) if lower else name).contains(wd)
        e = c if e is None else e | c
    return e


def wizard_drinks(products: DataFrame, requests: DataFrame, seed: int, drink_category: int = 7,
                  n: int = 4, hot=HOT_DRINK_WORDS, heavy_words=HEAVY_DRINK_WORDS,
                  light_words=LIGHT_DRINK_WORDS) -> DataFrame:
    """``requests`` (request_id, main_category).  Hot drinks are dropped;
    heavy meals prefer one keyword list, light meals another (W11): preferred
    drinks are drawn first, then the others."""
    name = F.col("product_name")
    drinks = products.filter((F.col("category_id") == drink_category)
                             & ~_any_contains(name, hot, lower=True)).select("product_id", "product_name", "price")
    by_meal = (drinks.withColumn("meal", F.lit("heavy")).withColumn("pref", _any_contains(name, heavy_words))
               .unionByName(drinks.withColumn("meal", F.lit("light")).withColumn("pref", _any_contains(name, light_words))))
    pool = by_meal.withColumn("level", F.concat_ws("-", "meal", F.when(F.col("pref"), F.lit("first")).otherwise(F.lit("last"))))
    heavy = F.coalesce(F.col("main_category").isin(*HEAVY_MEAL_CATEGORIES), F.lit(False))
    meal = F.when(heavy, F.lit("heavy")).otherwise(F.lit("light"))
    req = requests.select("request_id", meal.alias("_meal"), F.explode(F.array(F.lit("first"), F.lit("last"))).alias("_turn"))
    req = req.select("request_id", F.concat_ws("-", "_meal", "_turn").alias("level"))
    drawn = _pick(req, pool, "level", n, seed)
    firsts = (pool.filter("pref").groupBy("meal").agg(F.least(F.lit(n), F.count(F.lit(1))).cast("int").alias("before")))
    pick = F.col("slot") + 1 + F.when(F.col("pref"), 0).otherwise(F.coalesce("before", F.lit(0)))
    return (drawn.join(firsts, "meal", "left").withColumn("pick", pick).filter(F.col("pick") <= n)
                 .select("request_id", "pick", "product_id", "product_name", "price"))


def wizard_desserts(products: DataFrame, requests: DataFrame, seed: int, dessert_category: int = 8,
                    n: int = 4) -> DataFrame:
    """N desserts in seeded random order, drawn for each request."""
    desserts = products.filter(F.col("category_id") == dessert_category).select(
        "product_id", "product_name", "price", F.col("category_id").alias("level"))
    req = requests.select("request_id", F.lit(dessert_category).alias("level"))
    return _pick(req, desserts, "level", n, seed).select(
        "request_id", (F.col("slot") + 1).alias("pick"), "product_id", "product_name", "price")


def combo_total(main: DataFrame, drink: DataFrame, dessert: DataFrame) -> DataFrame:
    """Sum of the selected prices, a missing pick counts 0."""
    m = main.select("request_id", F.col("price").alias("p_main"))
    d = drink.select("request_id", F.col("price").alias("p_drink"))
    s = dessert.select("request_id", F.col("price").alias("p_dessert"))
    j = m.join(d, "request_id", "full").join(s, "request_id", "full")
    zero = F.lit(0).cast("decimal(18,2)")
    return j.select("request_id", (F.coalesce("p_main", zero) + F.coalesce("p_drink", zero)
                                   + F.coalesce("p_dessert", zero)).alias("total"))
