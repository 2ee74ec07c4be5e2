"""Host-level quality rules (operator 9).

Each document is counted and tested on its own (``DOCUMENT_RULES``).  Per host
the failures are then added up and the failure rate is shrunk towards the rate
of all hosts with a beta prior fitted to the hosts by their moments, so that a
host of two documents is not judged by two documents.  A host whose shrunk rate
is over ``HOST_LIMIT`` is rejected as a whole, and the verdict is joined back:
a document is kept if neither it nor its host fails.

The counts are partial sums, so a host with a third of all rows is added up
where its rows lie; the verdict table has one row per host and is joined with
skew handling, or broadcast where Spark sees that it is small.

Defined results: a null text has no words and fails; a null host is a host of
its own; repeated rows count once each; no document gives no row; equal rates
get equal verdicts, and a rate equal to the limit is kept.  Answer columns
replace input columns of the same names; other columns stay.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import written
from tavola.llm.workers import lean

MIN_WORDS = 50           # fewer words fail
REPEAT_PERCENT = 50      # more of the words in repeated 3-word windows fail
HOST_LIMIT = 0.75        # shrunk failure rate over which a host is rejected
MAX_STRENGTH = 1e6       # prior documents where hosts differ no more than by chance

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def count(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, _BLANKS))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        upto = 0
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 3 - max(upto, i)
                upto = i + 3
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated


def counts(text: Column) -> Column:
    """Struct of the counts of a text column."""
    def run(texts: pa.Array) -> pa.Array:
        rows = [count(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(COUNTS))], list(COUNTS))

    return F.arrow_udf(lean(run), ", ".join(f"{c} long" for c in COUNTS))(text)


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts and ``base_failed`` to every row."""
    return (docs.withColumn("_counts", counts(F.col(text_col)))
            .withColumns({c: F.col(f"_counts.{c}") for c in COUNTS}).drop("_counts")
            .withColumn("base_failed", base_failed()))


def host_verdicts(counted: DataFrame, host_col: str = "source") -> DataFrame:
    """One written row per host: host, n, failures, rate (shrunk), host_kept.

    The prior's mean m is the failure rate of all documents.  Its strength is
    m (1 - m) / v - 1, where v is the part of the variance of the host rates
    (weighted by documents) that chance does not explain; where chance explains
    all of it, hosts do not differ and the strength is ``MAX_STRENGTH``."""
    hosts = counted.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    hosts = written(hosts, "hosts")
    n, k = F.col("n").cast("double"), F.col("failures").cast("double")
    sums = hosts.agg(F.sum(n).alias("docs"), F.sum(k).alias("failed"), F.count(F.lit(1)).alias("hosts"),
                     F.sum(k * k / n).alias("squares")).first()
    if not sums.docs:
        return hosts.withColumns({"rate": F.lit(0.0), "host_kept": F.lit(True)})
    m = sums.failed / sums.docs
    chance = m * (1 - m) * sums.hosts / sums.docs
    extra = sums.squares / sums.docs - m * m - chance
    strength = min(MAX_STRENGTH, max(1.0, m * (1 - m) / extra - 1)) if extra > 0 else MAX_STRENGTH
    rate = (k + m * strength) / (n + strength)
    return written(hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= HOST_LIMIT),
                   "verdicts")


def judge(counted: DataFrame, verdicts: DataFrame, host_col: str = "source") -> DataFrame:
    """Add ``host_rate`` and ``kept`` to counted documents."""
    hosts = verdicts.select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"),
                            F.col("host_kept").alias("_host_kept"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("_host_kept"), F.lit(True))
    return (counted.drop("host_rate").join(hosts, F.col(host_col).eqNullSafe(F.col("_host")), "left")
            .withColumn("kept", kept).drop("_host", "_host_kept"))
