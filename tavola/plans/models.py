"""Forecast and segmentation queries."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tavola.operators import datasets as D
from tavola.operators import forecast as FC
from tavola.operators import refresh as RF
from tavola.operators import segments as SG
from tavola.plans.datasets import TRAINING_EXTRA, _summary, _summary_sql, _training
from tavola.plans.datasets import BASKET_LABELS
from tavola.plans.registry import register
from tavola.session import cut_lineage, scratch_path
from tavola.sources import files
from tavola.sources.tables import TABLE_SCHEMAS, table_path
from tavola.sources.fixtures import Fixtures

HORIZON = 14
# Fixed centroids (standardised space) for the expression form of the
# assignment (M11): high spend, early hours, weekend, late small baskets.
FIXED_CENTROIDS = [
    [1.5, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    [-0.5, 0.0, -0.5, -1.0, 0.0, 0.0, 0.0, 0.0],
    [0.0, 0.0, 0.0, 0.0, 1.5, 0.0, 0.0, 0.0],
    [-1.0, 0.0, -1.0, 1.0, -0.5, 0.0, 0.0, 0.0],
]

WEATHER_SQL = "CASE {c} WHEN 'Güneşli' THEN 0 WHEN 'Bulutlu' THEN 1 WHEN 'Serin' THEN 2 " \
              "WHEN 'Yağmurlu' THEN 3 WHEN 'Soğuk/Karlı' THEN 4 ELSE {d} END"
MONTH_SQL = "CASE month(tarih) " + " ".join(
    f"WHEN {m} THEN {float(t)}" for m, t in D.MONTH_TEMPERATURE.items()) + " ELSE 15.0 END"


def _cyc_sql(x, period, fn):
    return f"floor({fn}(2 * pi() * {x} / {period}) * 1e10 + 0.5) / 1e10"


def features_sql(src: str, unknown: int) -> str:
    g = "(isodow(tarih) - 1)"
    return f"""SELECT tarih, toplam_ciro, kaynak, hava, CAST({g} AS INTEGER) AS gun_no,
 CAST(month(tarih) AS INTEGER) AS ay, CAST({g} >= 4 AS INTEGER) AS hafta_sonu,
 CAST({WEATHER_SQL.format(c='hava', d=unknown)} AS INTEGER) AS hava_kod,
 coalesce(sicaklik, {MONTH_SQL}) AS sicaklik,
 {_cyc_sql(g, 7, 'sin')} AS gun_sin, {_cyc_sql(g, 7, 'cos')} AS gun_cos,
 {_cyc_sql('month(tarih)', 12, 'sin')} AS ay_sin, {_cyc_sql('month(tarih)', 12, 'cos')} AS ay_cos,
 CAST(CASE WHEN kaynak = 'db' THEN 3.0 ELSE 1.0 END AS DOUBLE) AS weight FROM {src}"""


def _train_features(spark, sf):
    return FC.features(_training(spark, sf))


@register("forecast_features", _summary_sql(features_sql("training", 2), extra=TRAINING_EXTRA))
def forecast_features(spark, sf):
    return _train_features(spark, sf)


def _scaled_sql(src: str, cols: list[str], keep: list[str]) -> str:
    parts = [f"floor((({c}) - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 "
             f"ELSE stddev_pop({c}) OVER () END * 1e9 + 0.5) / 1e9 AS {c}" for c in cols]
    return f"SELECT {', '.join(keep + parts)} FROM {src}"


def _round9(df, cols):
    return df.select(*[(F.floor(F.col(c) * 1e9 + 0.5) / 1e9).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


@register("scaled_features", _summary_sql(
    _scaled_sql("ff", FC.FEATURES, ["tarih"]),
    extra={**TRAINING_EXTRA, "ff": features_sql("training", 2)}))
def scaled_features(spark, sf):
    f = _train_features(spark, sf)
    return _round9(FC.standardize(f, FC.FEATURES, ["tarih"]), FC.FEATURES)


def _today(spark, sf):
    return _training(spark, sf).agg(F.max("tarih").alias("today"))


@register("forecast_calendar", _summary_sql(
    features_sql("cal", 0).replace("toplam_ciro, kaynak, hava,", "CAST(NULL AS DOUBLE) AS toplam_ciro, "
                                   "'db' AS kaynak, hava,"),
    extra={**TRAINING_EXTRA, "cal": f"""
 SELECT CAST(t.today + INTERVAL (i + 1) DAY AS DATE) AS tarih,
  ['Güneşli', 'Bulutlu', 'Güneşli', 'Serin', 'Bulutlu', 'Güneşli', 'Güneşli'][i % 7 + 1] AS hava,
  CAST(NULL AS DOUBLE) AS sicaklik
 FROM (SELECT max(tarih) AS today FROM training) t, range(0, {HORIZON}) r(i)"""}))
def forecast_calendar(spark, sf):
    return FC.prediction_features(FC.calendar(_today(spark, sf), HORIZON))


def _model(spark, sf):
    train = cut_lineage(_train_features(spark, sf))      # one row a day
    return FC.fit(train), train


def _solve_ctes() -> dict[str, str]:
    """The weighted normal equations of the training days, solved by elimination: table
    ``coef`` has the coefficients of the features as they are (b0, b1, ...) and base."""
    f, n = FC.FEATURES, len(FC.FEATURES)
    mean = lambda x: f"sum(weight * {x}) / sum(weight)"                                           # noqa: E731
    out = {"mid": "SELECT " + ", ".join(f"{mean(x)} AS m_{x}" for x in [*f, "toplam_ciro"]) + " FROM ff"}
    dev = [f"(ff.{x} - mid.m_{x})" for x in [*f, "toplam_ciro"]]
    out["e0"] = "SELECT " + ", ".join(f"sum(weight * {dev[i]} * {dev[j]}) AS a{i}_{j}" for i in range(n) for j in range(n + 1)) + " FROM ff, mid"
    for k in range(n):
        cells = [(f"CASE WHEN abs(a{k}_{k}) < 1e-9 THEN 0 ELSE a{k}_{j} / a{k}_{k} END" if i == k else
                  f"CASE WHEN abs(a{k}_{k}) < 1e-9 THEN a{i}_{j} ELSE a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} END") + f" AS a{i}_{j}"
                 for i in range(n) for j in range(n + 1)]
        out[f"e{k + 1}"] = f"SELECT {', '.join(cells)} FROM e{k}"
    out["coef"] = "SELECT " + ", ".join(f"a{i}_{n} AS b{i}" for i in range(n)) + ", m_toplam_ciro - " + " - ".join(
        f"a{i}_{n} * m_{x}" for i, x in enumerate(f)) + f" AS base FROM e{n}, mid"
    return out


def _value_sql(row: str) -> str:
    return "base + " + " + ".join(f"b{i} * {row}.{x}" for i, x in enumerate(FC.FEATURES))


FIT_CTES = {**TRAINING_EXTRA, "ff": features_sql("training", 2), **_solve_ctes()}
CALENDAR_SQL = f"""
 SELECT CAST(t.today + INTERVAL (i + 1) DAY AS DATE) AS tarih,
  ['Güneşli', 'Bulutlu', 'Güneşli', 'Serin', 'Bulutlu', 'Güneşli', 'Güneşli'][i % 7 + 1] AS hava,
  CAST(NULL AS DOUBLE) AS sicaklik, CAST(NULL AS DOUBLE) AS toplam_ciro, 'db' AS kaynak
 FROM (SELECT max(tarih) AS today FROM training) t, range(0, {HORIZON}) r(i)"""
FORECAST_CTES = {**FIT_CTES, "cal": CALENDAR_SQL, "cf": features_sql("cal", 0), "fc": f"""
 SELECT CAST(cf.tarih AS VARCHAR) AS tarih, ['Pazartesi', 'Salı', 'Çarşamba', 'Perşembe', 'Cuma', 'Cumartesi', 'Pazar'][isodow(cf.tarih)] AS gun,
  hava, sicaklik, round(greatest({_value_sql('cf')}, 0), 2) AS tahmini_ciro, hafta_sonu = 1 AS hafta_sonu FROM cf, coef"""}


def _fit_sql(body: str, extra: dict) -> str:
    return _summary_sql(body, extra=extra).replace(" AS (", " AS MATERIALIZED (")


FORECAST_SQL = _fit_sql("SELECT * FROM fc", FORECAST_CTES)


@register("forecast_fit", _fit_sql("SELECT u.feature, round(u.coefficient, 3) AS coefficient, round(q.r2, 9) AS r2 FROM (" + " UNION ALL ".join(
    f"SELECT '{x}' AS feature, b{i} * (SELECT stddev_samp({x}) FROM ff) AS coefficient FROM coef" for i, x in enumerate(FC.FEATURES))
    + " UNION ALL SELECT 'intercept', base + " + " + ".join(f"b{i} * (SELECT avg({x}) FROM ff)" for i, x in enumerate(FC.FEATURES)) + f""" FROM coef) u,
 (SELECT 1 - sum(weight * (toplam_ciro - ({_value_sql('ff')})) ** 2) / sum(weight * (toplam_ciro - m_toplam_ciro) ** 2) AS r2 FROM ff, coef, mid) q""",
    FIT_CTES))
def forecast_fit(spark, sf):
    """Coefficients of the standardised features, intercept and weighted R^2."""
    model, train = _model(spark, sf)
    lr = model.stages[-1]
    values = [*zip(FC.FEATURES, map(float, lr.coefficients)), ("intercept", float(lr.intercept))]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(F.lit(v), 3).alias("coefficient")) for n, v in values]))
    return FC.weighted_r2(model, train).select(rows.alias("r"), F.round("r2", 9).alias("r2")).select("r.*", "r2")


@register("forecast_equations", "SELECT unnest(['intercept', " + ", ".join(f"'{f}'" for f in FC.FEATURES)
          + "]) AS feature, true AS holds")
def forecast_equations(spark, sf):
    """The normal equations of the fit, one row per column: the weighted
    residuals are orthogonal to it (to a millionth of its size)."""
    model, train = _model(spark, sf)
    p = model.transform(train).withColumn("intercept", F.lit(1.0))
    w, rest = F.col("weight"), F.col("toplam_ciro") - F.col("prediction")
    names = ["intercept", *FC.FEATURES]
    holds = [(F.abs(F.sum(w * rest * F.col(c))) <= 1e-6 * (F.sum(w * F.abs(F.col("toplam_ciro") * F.col(c))) + 1e-9)).alias(c)
             for c in names]
    return p.agg(*holds).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("holds")) for c in names])).alias("r")).select("r.*")


@register("forecast", FORECAST_SQL)
def forecast(spark, sf):
    model, _ = _model(spark, sf)
    return FC.predict(model, FC.calendar(_today(spark, sf), HORIZON))


@register("forecast_summary", _fit_sql("""
SELECT COUNT(*) AS forecast_days, round(sum(tahmini_ciro), 2) AS total_predicted_revenue,
 round(coalesce(avg(tahmini_ciro), 0), 2) AS daily_average, max(tahmini_ciro) AS max_day FROM fc""", FORECAST_CTES))
def forecast_summary(spark, sf):
    model, _ = _model(spark, sf)
    return FC.summary(FC.predict(model, FC.calendar(_today(spark, sf), HORIZON)))


@register("forecast_from_saved", FORECAST_SQL)
def forecast_from_saved(spark, sf):
    """Save the fitted pipeline to the shared folder, load, predict."""
    model, _ = _model(spark, sf)
    path = scratch_path(spark, f"models/forecast-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    return FC.predict(loaded, FC.calendar(_today(spark, sf), HORIZON))


# ----------------------------------------------------------------- segments
SEG_FEATURE_SQL = f"""SELECT siparis_id, toplam_tutar, CAST(kisi_sayisi AS DOUBLE) AS kisi_sayisi,
 CAST(urun_sayisi AS DOUBLE) AS urun_sayisi, CAST(saat AS DOUBLE) AS saat, CAST(hafta_sonu AS DOUBLE) AS hafta_sonu,
 CAST(CASE yas_grubu WHEN '18-24' THEN 0 WHEN '25-34' THEN 1 WHEN '35-44' THEN 2 WHEN '45-54' THEN 3
  WHEN '55+' THEN 4 ELSE 2 END AS DOUBLE) AS yas_kod,
 CAST({WEATHER_SQL.format(c='hava_durumu', d=2)} AS DOUBLE) AS hava_kod, sicaklik_c FROM summary"""


@register("segment_features", _summary_sql(SEG_FEATURE_SQL))
def segment_features(spark, sf):
    return SG.segment_features(_summary(spark, sf))


def _assign_sql():
    dist = []
    for i, c in enumerate(FIXED_CENTROIDS):
        d = " + ".join(f"({f} - {float(v)}) * ({f} - {float(v)})" for f, v in zip(SG.SEGMENT_FEATURES, c))
        dist.append(f"({d}, {i})")
    return f"SELECT siparis_id, least({', '.join(dist)})[2] AS segment_id FROM sc"


SEG_CTES = {"segf": SEG_FEATURE_SQL,
            "sc0": _scaled_sql("segf", SG.SEGMENT_FEATURES, ["siparis_id"]).replace(" * 1e9 + 0.5) / 1e9", ") ")
            .replace("floor((", "(("),
            "sc": "SELECT * FROM sc0"}


def _kept_summary(spark, sf):
    """The columns of the summary that segments and their profile need, written once."""
    return cut_lineage(_summary(spark, sf).select("siparis_id", "toplam_tutar", "kisi_sayisi", "urun_sayisi", "saat",
                                                  "hafta_sonu", "yas_grubu", "hava_durumu", "sicaklik_c"))


def _fixed_assignment(summary):
    return SG.assign_fixed(SG.scaled(SG.segment_features(summary)), FIXED_CENTROIDS)


@register("segment_assign", _summary_sql(_assign_sql(), extra=SEG_CTES))
def segment_assign(spark, sf):
    return _fixed_assignment(_summary(spark, sf))


PROFILE_SQL = """
 SELECT segment_id, musteri_sayisi,
  round_even(musteri_sayisi / (SELECT COUNT(*) FROM summary) * 100 * 10, 0) / 10 AS yuzde,
  round_even(spend * 100, 0) / 100 AS ortalama_tutar, round_even(grp * 10, 0) / 10 AS ortalama_kisi,
  round_even(items * 10, 0) / 10 AS ortalama_urun, round_even(rev * 100, 0) / 100 AS toplam_ciro,
  round_even(wk * 100 * 10, 0) / 10 AS hafta_sonu_orani, coalesce(peak, 12) AS en_yogun_saat,
  rank() OVER (ORDER BY spend DESC, segment_id) AS rnk
 FROM (SELECT a.segment_id, COUNT(*) AS musteri_sayisi, avg(s.toplam_tutar) AS spend, avg(s.kisi_sayisi) AS grp,
   avg(s.urun_sayisi) AS items, sum(s.toplam_tutar) AS rev, avg(s.hafta_sonu) AS wk,
   (SELECT saat FROM summary s2 JOIN asg a2 ON a2.siparis_id = s2.siparis_id WHERE a2.segment_id = a.segment_id
    GROUP BY saat ORDER BY COUNT(*) DESC, saat LIMIT 1) AS peak
  FROM summary s JOIN asg a ON a.siparis_id = s.siparis_id GROUP BY a.segment_id)"""

NAMES_SQL = "CASE rnk " + " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(SG.SEGMENT_NAMES)) + \
            " ELSE 'Segment ' || CAST(segment_id AS VARCHAR) END"


@register("segment_profile", _summary_sql(f"""
SELECT segment_id, {NAMES_SQL} AS ad, musteri_sayisi, yuzde, ortalama_tutar, ortalama_kisi, ortalama_urun,
 toplam_ciro, hafta_sonu_orani, en_yogun_saat FROM prof""", extra={**SEG_CTES, "asg": _assign_sql(),
                                                                    "prof": PROFILE_SQL}))
def segment_profile(spark, sf):
    summary = _kept_summary(spark, sf)
    return SG.profile(summary, _fixed_assignment(summary))


@register("dominant_segment", _summary_sql(f"""
SELECT arg_min({NAMES_SQL}, (-musteri_sayisi, segment_id)) AS dominant_segment, max(musteri_sayisi) AS size
FROM prof""", extra={**SEG_CTES, "asg": _assign_sql(), "prof": PROFILE_SQL}))
def dominant_segment(spark, sf):
    summary = _kept_summary(spark, sf)
    return SG.dominant(SG.profile(summary, _fixed_assignment(summary)))


STARTS, CLUSTERS, SEED = 10, 4, 42


def _lloyd_ctes() -> dict[str, str]:
    """All starts and steps of the fit, one table of centres a step."""
    f = SG.SEGMENT_FEATURES
    square = " + ".join(f"(s.{x} - c.{x}) * (s.{x} - c.{x})" for x in f)
    out = {"cen0": f"""SELECT CAST(st AS INTEGER) AS st, CAST(row_number() OVER (PARTITION BY st ORDER BY code, siparis_id) - 1 AS INTEGER) AS cl, {', '.join(f)}
 FROM (SELECT *, md5(CAST(siparis_id AS VARCHAR) || '-' || CAST({SEED} + st AS VARCHAR)) AS code FROM sc, range({STARTS}) r(st))
 QUALIFY cl < {CLUSTERS}"""}
    for i in range(SG.MAX_STEPS + 1):
        out[f"near{i}"] = f"""SELECT siparis_id, st, n.cl AS cl, n.d AS d FROM (
  SELECT s.siparis_id, c.st, min({{'d': {square}, 'cl': c.cl}}) AS n FROM sc s, cen{i} c GROUP BY s.siparis_id, c.st)"""
        if i < SG.MAX_STEPS:
            out[f"cen{i + 1}"] = f"""SELECT c.st, c.cl, {', '.join(f'coalesce(m.{x}, c.{x}) AS {x}' for x in f)} FROM cen{i} c LEFT JOIN (
  SELECT n.st, n.cl, {', '.join(f'avg(s.{x}) AS {x}' for x in f)} FROM near{i} n JOIN sc s ON s.siparis_id = n.siparis_id GROUP BY n.st, n.cl) m
 ON m.st = c.st AND m.cl = c.cl"""
    last = f"near{SG.MAX_STEPS}"
    out["best"] = f"SELECT st FROM (SELECT st, CAST(format('{{:.8e}}', sum(d)) AS DOUBLE) AS cost FROM {last} GROUP BY st) ORDER BY cost, st LIMIT 1"
    out["asg"] = f"SELECT siparis_id, cl AS segment_id FROM {last} WHERE st = (SELECT st FROM best)"
    return out


SEGMENTS_SQL = _summary_sql(f"""
SELECT segment_id, {NAMES_SQL} AS ad, musteri_sayisi, yuzde, ortalama_tutar, ortalama_kisi, ortalama_urun,
 toplam_ciro, hafta_sonu_orani, en_yogun_saat FROM prof""", extra={**SEG_CTES, **_lloyd_ctes(), "prof": PROFILE_SQL})


@register("segments", SEGMENTS_SQL.replace(" AS (", " AS MATERIALIZED ("))
def segments(spark, sf):
    """Best of 10 K-Means starts, profiled, named and sorted by revenue;
    the result is saved and read from then on, until a file of its tables changes."""
    def fit():
        summary = _kept_summary(spark, sf)
        sc = SG.scaled(SG.segment_features(summary))
        centres, _, _ = SG.best_kmeans(sc, CLUSTERS, STARTS, SEED)
        return SG.profile(summary, SG.assign_fixed(sc, centres))

    name = hashlib.sha256(sf.rstrip("/").encode()).hexdigest()[:24]
    inputs = [table_path(sf, t) for t in ("orders", "lineitem", "part")]
    return (SG.cached(spark, scratch_path(spark, f"segments/{name}"), inputs, fit)
              .orderBy(F.desc("toplam_ciro"), "segment_id"))


@register("segments_check", _summary_sql("""
SELECT COUNT(*) AS orders, COUNT(*) AS at_nearest_centre, 3 AS starts_not_better FROM summary"""))
def segments_check(spark, sf):
    """Each order lies in the segment of its nearest centre, and no
    start of the best-of-n costs less than the best."""
    sc = cut_lineage(SG.scaled(SG.segment_features(_summary(spark, sf))))
    centres, best, _ = SG.best_kmeans(sc, CLUSTERS, 3, SEED)
    costs = [SG.best_kmeans(sc, CLUSTERS, 1, SEED + i)[1] for i in range(3)]
    each = [SG._square(c) for c in centres]
    own = SG.assign_fixed(sc, centres).join(sc, "siparis_id")
    chosen = F.element_at(F.array(*each), F.col("segment_id") + 1)
    return own.agg(F.count(F.lit(1)).alias("orders"), F.count_if(chosen <= F.least(*each)).alias("at_nearest_centre")
                   ).withColumn("starts_not_better", F.lit(sum(c >= best * (1 - 1e-9) for c in costs)))


@register("refresh_job", _summary_sql("""
SELECT (SELECT COUNT(*) FROM summary) AS summary_rows, (SELECT COUNT(DISTINCT order_id) FROM order_item_f) AS basket_lines,
 (SELECT COUNT(DISTINCT order_id) FROM order_item_f) AS basket_rows, (SELECT COUNT(*) FROM training) AS training_days,
 true AS fitted""", extra=TRAINING_EXTRA))
def refresh_job(spark, sf):
    """Bring the summary by day up to date (CSV), export basket lines (text) and
    the one-hot basket (CSV), then retrain the forecast; one row of counts."""
    fx = Fixtures(spark, sf)
    name = hashlib.sha256(sf.rstrip("/").encode()).hexdigest()[:24]
    kept, base = scratch_path(spark, f"refresh/{name}"), scratch_path(spark, f"refresh/{uuid.uuid4().hex}")
    refresh_summary(spark, sf, kept)
    files.write_text_lines(D.basket_lines(fx.order_item_f, fx.product_f), "line", f"{base}/basket_lines")
    files.write_csv(D.basket_onehot(fx.order_item_f, fx.product_f, "basket_label", BASKET_LABELS), f"{base}/market_basket")
    model, train = _model(spark, sf)
    counts = {"summary_rows": files.read_csv(spark, f"{kept}/data", files.SUMMARY_SCHEMA), "basket_lines": spark.read.text(f"{base}/basket_lines"),
              "basket_rows": spark.read.option("header", True).csv(f"{base}/market_basket"), "training_days": train}
    return FC.weighted_r2(model, train).select(
        *[df.select(F.count(F.lit(1))).scalar().alias(name) for name, df in counts.items()],
        F.col("r2").between(0, 1).alias("fitted"))


def refresh_summary(spark, sf, out: str):
    """The order summary by day, of which only days with new orders or items are rebuilt."""
    fx = Fixtures(spark, sf)
    day = F.to_date("created_at")
    orders = fx.order_f

    def days_of(table, paths):
        if table == "part":
            return None
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}[table]
        new = spark.read.schema(TABLE_SCHEMAS[table]).parquet(*paths).select(F.col(key).alias("order_id"))
        return orders.join(new, "order_id", "left_semi").select(day.alias("day"))

    def build(days):
        picked = orders if days is None else orders.where(day.isin(days))
        items = fx.order_item_f if days is None else fx.order_item_f.join(picked.select("order_id"), "order_id", "left_semi")
        rows = D.order_summary(picked, items, fx.product_f)
        return rows.withColumn("day", F.to_date(F.substring("tarih_saat", 1, 10)))

    inputs = {t: table_path(sf, t) for t in ("orders", "lineitem", "part")}
    return RF.refresh_by_day(spark, out, inputs, days_of, build, header=True, escape='"', nullValue=files.NULL_TOKEN, emptyValue='""')
