"""Daily revenue forecast.

Features are column expressions; the model is MLlib's weighted linear
regression (normal equations, no regularisation) on standardised features.
The training frame has one row per day, so it stays small; the work that
grows with the data is the daily aggregation in ``operators.datasets``.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions import exprs as X
from tavola.operators.datasets import MONTH_TEMPERATURE, WEATHER_CODE
from tavola.session import cut_lineage

FEATURES = ["gun_no", "ay", "hafta_sonu", "hava_kod", "sicaklik", "gun_sin", "gun_cos", "ay_sin", "ay_cos"]
# Default weather cycle of the prediction calendar; weights.
DEFAULT_WEATHER_CYCLE = ["Güneşli", "Bulutlu", "Güneşli", "Serin", "Bulutlu", "Güneşli", "Güneşli"]
SOURCE_WEIGHT = {"db": 3.0, "csv": 1.0}
MAX_DAYS = 90


def _cyc(x: Column, period: int, fn) -> Column:
    """sin/cos of 2 pi x / period, rounded to 10 decimals (libm and the JVM
    may differ in the last bit)."""
    return F.floor(fn(F.lit(2 * math.pi) * x / period) * 1e10 + 0.5) / 1e10


def features(daily: DataFrame, unknown_weather_code: int = 2, weekend_from: int = 4) -> DataFrame:
    """Weekday (Mon=0), month, weekend (Fri-Sun by default, D5),
    weather code (unknown -> 2 in training, D6), temperature filled by the
    monthly constant else 15, cyclical encodings, source weight."""
    d = F.col("tarih")
    gun, ay = F.weekday(d), F.month(d)
    temp = F.coalesce(F.col("sicaklik"), X.lookup(ay, list(MONTH_TEMPERATURE.items()), 15.0).cast("double"))
    out = daily.select(
        "tarih", "toplam_ciro", "kaynak", "hava",
        gun.alias("gun_no"), ay.alias("ay"), (gun >= weekend_from).cast("int").alias("hafta_sonu"),
        X.lookup(F.col("hava"), list(WEATHER_CODE.items()), unknown_weather_code).cast("int").alias("hava_kod"),
        temp.alias("sicaklik"),
        _cyc(gun, 7, F.sin).alias("gun_sin"), _cyc(gun, 7, F.cos).alias("gun_cos"),
        _cyc(ay, 12, F.sin).alias("ay_sin"), _cyc(ay, 12, F.cos).alias("ay_cos"))
    weight = F.when(F.col("kaynak") == "db", F.lit(SOURCE_WEIGHT["db"])).otherwise(F.lit(SOURCE_WEIGHT["csv"]))
    return out.withColumn("weight", weight)


def standardize(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """M8: (x - mean) / population std, std 0 -> 1.  ``df`` is written once; its
    statistics are one row, which comes to the driver."""
    df = cut_lineage(df.select(*dict.fromkeys([*keep, *cols])))
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return df.select(*keep, *[((F.col(c) - F.lit(st[f"m_{c}"])) / F.lit(st[f"s_{c}"] or 1.0)).alias(c) for c in cols])


def pipeline() -> Pipeline:
    """Assembler -> scaler -> weighted least squares.  MLlib's scaler
    uses the sample deviation; the fit's predictions do not depend on a
    common scale factor, so they equal the population-scaled fit."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LinearRegression(featuresCol="features", labelCol="toplam_ciro", weightCol="weight",
                         solver="normal", regParam=0.0, elasticNetParam=0.0),
    ])


def fit(train: DataFrame) -> PipelineModel:
    return pipeline().fit(train)


def weighted_r2(model: PipelineModel, train: DataFrame) -> DataFrame:
    """1 - SSE_w / SST_w."""
    p = model.transform(train)
    ybar = p.agg((F.sum(F.col("weight") * F.col("toplam_ciro")) / F.sum("weight")).alias("yb"))
    j = p.select("weight", "toplam_ciro", "prediction").withColumn("yb", ybar.scalar())
    return j.agg((1 - F.sum(F.col("weight") * (F.col("toplam_ciro") - F.col("prediction")) ** 2)
                  / F.sum(F.col("weight") * (F.col("toplam_ciro") - F.col("yb")) ** 2)).alias("r2"))


def calendar(start: DataFrame, days: int, weather: list[str] | None = None, most: int = MAX_DAYS) -> DataFrame:
    """The next ``days`` dates after ``start`` (one row, column
    ``today``) with the weather list cycled (default) or taken as given
    (a short list leaves the rest sunny).  The service answers for ``most`` days at
    most (D15)."""
    days = max(0, min(days, most))
    if weather is None:
        cycle = F.array(*[F.lit(w) for w in DEFAULT_WEATHER_CYCLE])
        pick = lambda i: F.element_at(cycle, F.pmod(i, F.lit(len(DEFAULT_WEATHER_CYCLE))) + 1)
    else:
        given = F.array(*[F.lit(w) for w in weather]) if weather else F.array().cast("array<string>")
        pick = lambda i: F.coalesce(F.try_element_at(given, i + 1), F.lit("Güneşli"))
    rows = start.select(F.col("today"), F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("i")) \
        if days > 0 else start.select(F.col("today"), F.lit(0).alias("i")).filter(F.lit(False))
    return rows.select(F.date_add("today", F.col("i") + 1).alias("tarih"), pick(F.col("i")).alias("hava"))


def prediction_features(cal: DataFrame) -> DataFrame:
    """Calendar rows as model input: unknown weather -> 0 here (D6), monthly
    temperature, no revenue."""
    return features(cal.withColumn("sicaklik", F.lit(None).cast("double"))
                       .withColumn("toplam_ciro", F.lit(None).cast("double"))
                       .withColumn("kaynak", F.lit("db")), unknown_weather_code=0)


def predict(model: PipelineModel, cal: DataFrame) -> DataFrame:
    """Floor at 0, round 2, Turkish weekday name."""
    feats = prediction_features(cal)
    p = model.transform(feats)
    return p.select(F.date_format("tarih", "yyyy-MM-dd").alias("tarih"),
                    X.weekday_name_tr(F.col("tarih")).alias("gun"), "hava",
                    F.col("sicaklik"),
                    F.round(F.greatest(F.col("prediction"), F.lit(0.0)), 2).alias("tahmini_ciro"),
                    (F.col("hafta_sonu") == 1).alias("hafta_sonu"))


def summary(pred: DataFrame) -> DataFrame:
    """Total, daily mean, maximum."""
    return pred.agg(F.count(F.lit(1)).alias("forecast_days"),
                    F.round(F.sum("tahmini_ciro"), 2).alias("total_predicted_revenue"),
                    F.round(F.coalesce(F.avg("tahmini_ciro"), F.lit(0.0)), 2).alias("daily_average"),
                    F.max("tahmini_ciro").alias("max_day"))
