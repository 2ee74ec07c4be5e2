"""Licence scan with a positional index of rare words (operator 5).

Built-in functions only: no Python runs on the executors.  A first scan counts
in how many documents each word of the notices below occurs.  A second scan takes
of each text the licence words with the highest inverse document frequency, at most
``FILE_WORDS`` different ones, and looks up their postings: the notices that have the
word, and where.  The place of a word in the text less its position in the notice is a
place where the notice may start; places on which ``LEAST_WORDS`` of the looked-up
words agree are kept.  There the notice's mandatory key phrase must stand word by
word, and ``LEAST_SHARE`` of all its words in place, so a notice with some of its words
altered is still found.  The share is the label's score.

Apart from that, a document is labelled for every base phrase whose words stand
in it one after the other.  Everything happens within a row, so a hot group of
equal texts needs no shuffle; only one count per notice word leaves the tasks.

Defined results: a null, empty or wordless text has n_words 0, no labels, null
positions and score 0; labels are distinct and sorted; words with equal counts
are ordered by themselves; repeated rows are scanned alike and count once each
in the frequencies; answer columns replace input columns of the same names,
other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FILE_WORDS = 12          # rarest licence words of a text that are looked up
LEAST_WORDS = 2          # looked-up words that must agree on where a notice starts
LEAST_SHARE = 0.6        # of a notice's words that must stand in place
BASE_SCORE = 0.5         # least score of a text with a base phrase

# Base phrases and their labels.
BASE_PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

# Label, mandatory key phrase, first words of public licence notices.
NOTICES = [
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("bsd", "source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by", "commons attribution",
     "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "public domain dedication", "cc0 1 0 universal public domain dedication"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license",
     "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "distribute this software for any purpose",
     "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "lesser general public license",
     "under the terms of the gnu lesser general public license"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "released into the public domain",
     "this is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lower, SEPARATORS), "")


def notice_words(notices: list[tuple] = NOTICES) -> list[str]:
    return sorted({w for _, _, notice in notices for w in notice.split()})


def document_frequencies(docs: DataFrame, text_col: str = "text", notices: list[tuple] = NOTICES) -> dict[str, int]:
    """Documents per notice word: as many numbers as the notices have words."""
    vocabulary = F.array(*[F.lit(w) for w in notice_words(notices)])
    present = docs.select(F.explode(F.array_intersect(vocabulary, words_of(F.col(text_col)))).alias("word"))
    counted = {r.word: r.n for r in present.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counted.get(w, 0) for w in notice_words(notices)}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _stands(words: Column, at: Column, phrase: list[str]) -> Column:
    return _all([F.get(words, at + i) == w for i, w in enumerate(phrase)])


def _places(word: str, position: int) -> Column:
    """Where a text must begin if ``word`` in it is the word at ``position``."""
    return F.transform(F.filter(F.col("_hits"), lambda h: h["word"] == word), lambda h: h["at"] - position)


def _base_places(phrase: list[str]) -> Column:
    last = len(phrase) - 1
    return F.filter(_places(phrase[last], last), lambda o: (o >= 0) & _stands(F.col("_words"), o, phrase))


def _notice_share(key: str, notice: str) -> Column:
    """Best share over the places where a notice stands; null if it stands nowhere."""
    words, rare, parts, phrase = F.col("_words"), F.col("_rare"), notice.split(), key.split()
    key_at = next(i for i in range(len(parts)) if parts[i:i + len(phrase)] == phrase)
    places = F.array_distinct(F.concat(*[F.when(F.array_contains(rare, w), _places(w, i)).otherwise(_nowhere())
                                         for i, w in enumerate(parts)]))
    proven = F.filter(places, lambda o: (o >= 0) & _stands(words, o + key_at, phrase))

    def count(o: Column, only_rare: bool) -> Column:
        there = [(F.get(words, o + i) == w) & (F.array_contains(rare, w) if only_rare else F.lit(True)) for i, w in enumerate(parts)]
        return sum((F.when(t, 1).otherwise(0) for t in there), F.lit(0))

    share = F.transform(F.filter(proven, lambda o: count(o, True) >= LEAST_WORDS), lambda o: count(o, False) / len(parts))
    key_words = sorted(set(phrase))
    possible = F.size(F.array_intersect(F.array(*[F.lit(w) for w in key_words]), F.col("_present"))) == len(key_words)
    return F.when(possible, F.array_max(F.filter(share, lambda x: x >= LEAST_SHARE)))


def _nowhere() -> Column:
    return F.expr("CAST(array() AS array<int>)")


def scan(docs: DataFrame, text_col: str = "text", frequency: dict[str, int] | None = None,
         notices: list[tuple] = NOTICES) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``notices``: (label, key phrase, words of the notice), as short as the expressions
    over them should be; the first words of a licence are enough."""
    frequency = frequency or document_frequencies(docs, text_col, notices)
    vocabulary, words = sorted(notice_words(notices), key=lambda w: (frequency[w], w)), F.col("_words")
    last_words = sorted({p.split()[-1] for p, _ in BASE_PHRASES})
    present = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), words)       # rarest first
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
                    lambda h: h["word"].isin(last_words) | (h["word"].isin(vocabulary) & F.array_contains(F.col("_rare"), h["word"])))
    out = (docs.withColumn("_words", words_of(F.col(text_col))).withColumn("_present", present)
           .withColumn("_rare", F.slice("_present", 1, FILE_WORDS))
           .withColumn("_hits", hits))
    starts = [_base_places(phrase.split()) for phrase, _ in BASE_PHRASES]
    out = out.withColumns({f"_base{i}": s for i, s in enumerate(starts)} | {
        f"_share{i}": _notice_share(key, notice) for i, (_, key, notice) in enumerate(notices)})
    base = F.concat(*[F.coalesce(F.col(f"_base{i}"), F.expr("array()").cast("array<int>"))
                      for i in range(len(BASE_PHRASES))])
    base_labels = [F.when(F.size(f"_base{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE_PHRASES)]
    labels = [F.when(F.col(f"_share{i}").isNotNull(), F.lit(label)) for i, (label, _, _) in enumerate(notices)]

    def joined(columns: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*columns)))), ",")

    best = F.greatest(F.lit(0.0), *[F.col(f"_share{i}") for i in range(len(notices))])
    answers = {"n_words": F.size("_words").cast("long"), "n_base": F.size("_base").cast("long"),
               "first_word": F.array_min("_base").cast("long"), "last_word": F.array_max("_base").cast("long"),
               "base_labels": joined(base_labels), "labels": joined(base_labels + labels),
               "score": F.greatest(best, F.when(F.size("_base") > 0, BASE_SCORE).otherwise(0.0))}
    spare = ["_words", "_present", "_rare", "_hits", "_base", *(f"_base{i}" for i in range(len(BASE_PHRASES))),
             *(f"_share{i}" for i in range(len(notices)))]
    return out.withColumn("_base", base).withColumns(answers).drop(*spare)


def oracle() -> str:
    """The operator's query over ``documents`` in DuckDB's SQL."""
    def quoted(rows) -> str:
        return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)

    notices, bases = [], []
    for t, (label, key, notice) in enumerate(NOTICES):
        parts, phrase = notice.split(), key.split()
        key_at = next(i for i in range(len(parts)) if parts[i:i + len(phrase)] == phrase)
        notices += [(t, label, i, w, int(key_at <= i < key_at + len(phrase))) for i, w in enumerate(parts)]
    for b, (phrase, label) in enumerate(BASE_PHRASES):
        bases += [(b, label, i, w) for i, w in enumerate(phrase.split())]
    return rf"""
WITH notice(t, label, pos, word, is_key) AS (VALUES {quoted(notices)}),
base(b, label, pos, word) AS (VALUES {quoted(bases)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
v AS (SELECT doc_id, word, i FROM p
      WHERE word IN (SELECT word FROM notice UNION SELECT word FROM base)),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM v GROUP BY word),
rare AS (SELECT doc_id, word FROM (
    SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY n, word) AS r
    FROM (SELECT DISTINCT doc_id, word FROM v WHERE word IN (SELECT word FROM notice)) JOIN df USING (word)) WHERE r <= {FILE_WORDS}),
whole AS (SELECT doc_id, t, i - pos AS o FROM v JOIN rare USING (doc_id, word) JOIN notice USING (word) WHERE i >= pos
    GROUP BY doc_id, t, i - pos HAVING count(*) >= {LEAST_WORDS}),
slot AS (SELECT doc_id, t, o, label, is_key, word, o + pos AS i FROM whole JOIN notice USING (t)),
share AS (SELECT doc_id, t, o, any_value(label) AS label, count(v.doc_id) / count(*) AS share,
      bool_and(is_key = 0 OR v.doc_id IS NOT NULL) AND count(v.doc_id) / count(*) >= {LEAST_SHARE} AS proven
    FROM slot LEFT JOIN v USING (doc_id, i, word) GROUP BY doc_id, t, o),
sized AS (SELECT *, count(*) OVER (PARTITION BY b) AS size FROM base),
base_at AS (SELECT doc_id, b, any_value(label) AS label, i - pos AS o FROM v JOIN sized USING (word)
    WHERE i >= pos GROUP BY doc_id, b, i - pos
    HAVING count(*) = max(size)),
base_sum AS (SELECT doc_id, count(*) AS n_base, min(o) AS first_word, max(o) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base_at GROUP BY doc_id),
label AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
      SELECT doc_id, label FROM share WHERE proven UNION SELECT doc_id, label FROM base_at) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM share WHERE proven GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN {BASE_SCORE} ELSE 0.0 END) AS score
FROM d LEFT JOIN base_sum USING (doc_id) LEFT JOIN label USING (doc_id) LEFT JOIN best USING (doc_id)
"""
