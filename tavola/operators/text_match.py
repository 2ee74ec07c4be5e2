"""Which needles stand in which texts, as an equi-join.

Every needle is looked up by its head, its first letters up to ``HEAD``.  A text sends
each place once per head length, so the rows grow with the text's length and not with
its square; a hit of a head is verified against the whole needle at that place.  Long
texts and long needles cost the same per letter as short ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = 6


def contained(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Distinct (text, needle) such that the needle stands in the text, letter by
    letter.  Empty needles and nulls stand in no text."""
    wanted = (needles.select(F.col(needle).alias("needle")).where(F.length("needle") > 0).distinct()
              .withColumn("head", F.substring("needle", 1, HEAD)))
    length = F.length("text")
    heads = (texts.select(F.col(text).alias("text")).where(F.length("text") > 0).distinct()
             .withColumn("at", F.explode(F.sequence(F.lit(1), length)))
             .withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD), length - F.col("at") + 1))))
             .select("text", "at", F.substr("text", "at", "size").alias("head")))
    whole = F.substr(F.col("text"), F.col("at"), F.length("needle")) == F.col("needle")
    return heads.join(wanted, "head").where(whole).select(F.col("text").alias(text), F.col("needle").alias(needle)).distinct()
