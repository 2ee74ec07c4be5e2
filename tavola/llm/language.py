"""Language identification by compression (operator 1).

For each language a few raw-content dictionaries are filled with labelled text.
A text is cut into blocks, each block is compressed with every language's
dictionaries, and the language with the fewest bytes in all wins: a compressor
that has seen the language finds its syllables and words in the dictionary.  Texts
and dictionaries are lower-cased and hold one space for each run of signs that
are no letters, so that neither capitals nor punctuation count.  A block is half of the
text, but within bounds: long texts cannot explain themselves by their own past, every
part of them counts, and the compressors are the same for texts of all lengths.  A text is rejected (``rejected``), though its best language
is still told, if its two best languages lie close together, as in random letters, or
if the best language of each block explains it better than one language explains them
all, as in a text of two languages.

The model is fitted on a bounded sample of the labelled rows: at most
``SAMPLES`` texts a language and, by fewer of each language, at most ``MODEL_TEXTS``
in all (but one of each at least, so every label is learnt), of each at most
``SAMPLE_BYTES`` bytes; the choice goes by a hash of the text.  Every prediction reads
the whole text.

Defined results: a null text, an empty one or one without a letter is ``und``
with score 0 and is rejected; ties go to the language that comes first in the
alphabet, with score 0; with no labelled row at all every text is ``und``; a language with a
single labelled text has one dictionary, whose sizes count as often as those of two.
Repeated texts get the same answer, the answer columns replace input columns of
the same names, and all other columns stay as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.common import written
from tavola.llm.workers import lean

SAMPLES = 96             # labelled texts a language at most
MODEL_TEXTS = 24_576     # labelled texts in all, of 256 languages and more
SAMPLE_BYTES = 4096      # bytes of each
DICTIONARIES = 2         # dictionaries a language; the texts are dealt out to them
MIN_BLOCK = 64           # bytes compressed at once: half of a text, but at least so many
BLOCK = 2048             # and at most so many
# Parameters of the compressors; the tables are as large as a dictionary needs.
COMPRESSOR = dict(window_log=18, hash_log=16, chain_log=16, search_log=3, min_match=4,
                  strategy=zstandard.STRATEGY_LAZY)
# Bars of rejection.  Of labelled documents 99 % win by a margin above 0.1; random letters reach
# 0.043, and half of the texts of two halves in two languages stay below 0.05.
MARGIN = 0.05            # share of bytes by which the best language must win,
MARGIN_BYTES = 4         # and the number of bytes
MIXED = 0.02             # share of bytes that the blocks' own best languages may save

_NO_LETTERS = re.compile(r"[\W\d_]+")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[bytes]]:
    """Dictionaries of each language from rows with a text and a label.

    Per language and hash class the text of the smallest hash is taken, so the
    work is one partial aggregate of two numbers and one filtered scan."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    keyed = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                        F.xxhash64(text_col).alias("h"))
    classes = written(keyed.groupBy("lang", F.pmod("h", F.lit(SAMPLES)).alias("k")).agg(F.min("h").alias("h")),
                      "language-sample")
    languages = classes.select("lang").distinct().count()
    if not languages:
        return {}
    texts = max(1, min(SAMPLES, MODEL_TEXTS // languages))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("k"))      # of SAMPLES rows at most
    picked = classes.withColumn("number", number).where(F.col("number") <= texts)
    found = (keyed.join(F.broadcast(picked), ["lang", "h"])
             .groupBy("lang", "number").agg(F.min(F.substring("text", 1, SAMPLE_BYTES)).alias("text")).collect())
    out: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.number)):
        dictionaries = out.setdefault(r.lang, [b""] * DICTIONARIES)
        dictionaries[r.number % DICTIONARIES] += plain(r.text)[:SAMPLE_BYTES] + b"\n"
    return {lang: [d for d in dicts if d] for lang, dicts in out.items()}


@lru_cache(maxsize=4)
def _compressors(model: tuple) -> list:
    how = zstandard.ZstdCompressionParameters(
        **COMPRESSOR, write_checksum=False, write_content_size=False, write_dict_id=False)

    def compressor(data: bytes):
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=content, compression_params=how).compress
    return [[compressor(d) for d in dicts] for _, dicts in model]


def plain(text: str) -> bytes:
    """Lower-cased letters of a text with one space for all between them."""
    return _NO_LETTERS.sub(" ", text.lower()).encode()


def _sizes(text: bytes, model: tuple) -> list[list[float]]:
    """Bytes of each block with each language, as if each had all its dictionaries."""
    width = max(MIN_BLOCK, min(BLOCK, -(-len(text) // 2)))
    blocks = [text[at:at + width] for at in range(0, len(text), width)]
    return [[sum(len(compress(block)) for compress in several) * DICTIONARIES / len(several)
             for several in _compressors(model)] for block in blocks]


def predict(text: Column, model: dict[str, list[bytes]], margin: float = MARGIN) -> Column:
    """Struct (lang string, score double, rejected boolean) of a text column."""
    frozen = tuple((lang, tuple(model[lang])) for lang in sorted(model))

    def run(texts: pa.Array) -> pa.Array:
        langs = [lang for lang, _ in frozen]
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_pylist()
        best, score, rejected = [], [], []
        for text, ok in zip(texts, letters):
            if not ok or not langs:
                best.append("und")
                score.append(0.0)
                rejected.append(True)
                continue
            blocks = _sizes(plain(text.as_py()), frozen)
            size = [sum(column) for column in zip(*blocks)]
            first = min(range(len(size)), key=size.__getitem__)
            rest = [s for i, s in enumerate(size) if i != first]
            won = (min(rest) - size[first]) / min(rest) if rest else 1.0
            close = bool(rest) and (won < margin or min(rest) - size[first] < MARGIN_BYTES)
            mixed = size[first] - sum(map(min, blocks)) > MIXED * size[first]
            best.append(langs[first])
            score.append(min(1.0, won))
            rejected.append(close or mixed)
        return pa.StructArray.from_arrays(
            [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
            ["lang", "score", "rejected"])

    return F.arrow_udf(lean(run), "lang string, score double, rejected boolean").asNondeterministic()(text)


def classify(docs: DataFrame, model: dict[str, list[bytes]], text_col: str = "text",
             margin: float = MARGIN) -> DataFrame:
    """Add lang_pred, score and rejected to every row."""
    return (docs.withColumn("_language", predict(F.col(text_col), model, margin))
            .withColumns({"lang_pred": F.col("_language.lang"), "score": F.col("_language.score"),
                          "rejected": F.col("_language.rejected")}).drop("_language"))
