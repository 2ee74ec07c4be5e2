"""Exports by day that rebuild only what new input files touch.

Beside an export lies the manifest of the input files it was made from: path, size and
time of each.  At the next run new files name the days they hold, and only these days
are built again and overwritten (dynamic partition overwrite).  Where a file is gone or
another one under its name, it is not known which days it held, so all are rebuilt; so
they are where an input, such as the menu, has no days of its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.sources import files

MOST_DAYS = 1000         # days that a filter names; more new ones than that rebuild all


def _saved(spark: SparkSession, path: str) -> dict | None:
    if not files.exists(spark, f"{path}/_SUCCESS"):
        return None
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def changed_days(spark: SparkSession, before: dict | None, now: dict,
                 days_of: Callable[[str, list[str]], DataFrame | None]) -> list | None:
    """Days (of a column ``day``) that the new files hold, sorted; None for all days."""
    if before is None or before.keys() != now.keys():
        return None
    days: set = set()
    for name, found in now.items():
        old = before[name]
        if any(found.get(f) != mark for f, mark in old.items()):
            return None
        new = sorted(found.keys() - old.keys())
        if new:
            held = days_of(name, new)
            if held is None:
                return None
            days |= {r.day for r in held.select("day").distinct().limit(MOST_DAYS + 1).collect()}
            if len(days) > MOST_DAYS:
                return None
    return sorted(days)


def refresh_by_day(spark: SparkSession, out: str, inputs: dict[str, str], days_of: Callable[[str, list[str]], DataFrame | None],
                   build: Callable[[list | None], DataFrame], fmt: str = "csv", **options) -> list | None:
    """Bring the export at ``out``/data up to date and return the days rebuilt (None: all).

    ``build(days)`` makes the export's rows, with a column ``day``, of the given days.
    The manifest is written last: a run that fails is made again in full by the next."""
    now = {name: files.manifest(spark, [path]) for name, path in inputs.items()}
    days = changed_days(spark, _saved(spark, f"{out}/manifest"), now, days_of)
    if days is None or days:
        rows = build(days).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
        (rows.repartition("day").write.mode("overwrite").format(fmt).options(**options)
             .option("partitionOverwriteMode", "static" if days is None else "dynamic").partitionBy("day").save(f"{out}/data"))
    text = json.dumps(now)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return days
