"""BPE, packing, training order, language ID and quality rules."""
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tavola.llm import bpe, language, packing, quality, training_order
from tavola.llm.training_order import Permutation

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "×", "÷", "ñ", "日本", "\x1c", "\x85", "²", "1", "23", ".", "!!",
       "<|endoftext|>", "\r\n", "the", "ing", "😀", "à", "Ω", "\x00", "ɐ", "\xa0"]
TEXTS = [None, "", "the cat's  hat\n\n", "<|endoftext|> x", "é" * 3000, "ab " * 2000, "Straße 42 №", "x" * 700]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_ids_and_texts_equal_the_library(reference):
    own, rnd = bpe.load(PATH), random.Random(5)
    texts = ["".join(rnd.choices(ODD, k=rnd.randint(0, 14))) for _ in range(3000)] + [t or "" for t in TEXTS]
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(ids).decode() == reference.decode(ids.tolist(), skip_special_tokens=False)
    some = [rnd.randrange(50257) for _ in range(300)]
    assert own.decode(np.array(some)).decode() == reference.decode(some, skip_special_tokens=False)


def test_long_words_and_long_texts(reference):
    own, rnd = bpe.load(PATH), random.Random(6)
    word = "".join(rnd.choices("abcdethn", k=4000))
    text = " ".join("".join(rnd.choices("etaoinshr", k=rnd.randint(1, 9))) for _ in range(600_000))
    for t in (word, text):
        assert own.encode_batch([t])[0].tolist() == reference.encode(t, add_special_tokens=False).ids


def test_a_worker_may_forget_words(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    own, rnd = bpe.Bpe(PATH), random.Random(7)
    for _ in range(5):
        text = " ".join("".join(rnd.choices("abcdef", k=5)) for _ in range(200))
        assert own.encode_batch([text])[0].tolist() == reference.encode(text, add_special_tokens=False).ids


def test_columns_encode_and_decode(docs_of, reference):
    docs = docs_of(TEXTS, ids=[7, 7, 2, 3, 4, 5, 6, None], back=["c"] * len(TEXTS))
    once = docs.withColumn("i", bpe.encode(F.col("text"), PATH)).withColumn("back", bpe.decode(F.col("i"), PATH))
    both = docs.select("text", bpe.round_trip(F.col("text"), PATH).alias("c")).select("text", "c.*")
    for row in once.collect() + both.toDF("text", "i", "back").collect():
        ids = reference.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.i, "<u4").tolist() == ids
        assert row.back == (row.text or "")


def check_pieces(rows, docs, window, reference):
    texts = Counter((d.doc_id, d.text) for d in docs.collect())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for s in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        total += at
        assert at == window or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    want = 0
    for (doc_id, text), times in texts.items():
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += times * len(ids)
        if sum(c for (d, _), c in texts.items() if d == doc_id) == 1:
            pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
            assert sum(p.length for p in pieces) == len(ids) == pieces[0].doc_tokens
            for p in pieces:
                assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    assert total == want


@pytest.mark.parametrize("window", [16, 2048])
def test_pieces_tile_the_sequences(docs_of, reference, window):
    docs = docs_of(TEXTS + ["ab", "ab"], ids=[0, 1, 2, 3, 4, 5, 6, 7, 9, 9], length=["clash"] * 10)
    rows = packing.pack(docs, PATH, window).collect()
    check_pieces(rows, docs, window, reference)
    last = [r for r in rows if r.sequence_id == max(x.sequence_id for x in rows)]
    filled = sum(r.length for r in last)
    assert last[0].padded_length == (filled if filled & (filled - 1) == 0 else window)


def test_nothing_to_pack(docs_of, spark):
    assert packing.pack(docs_of([]), PATH).count() == 0
    shards = training_order.write_shards(docs_of([]), PATH)
    assert training_order.read_shards(spark, shards).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 1000, 65537])
def test_permutation_uses_each_slot_once(n):
    order = Permutation(n, key=n)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert order.sequences(slots).tolist() == list(range(n))
    if n >= 1000:
        assert (slots != Permutation(n, key=n + 1).slots(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.1


def test_shards_hold_the_packed_sequences(docs_of, spark, reference):
    docs = docs_of([t for t in TEXTS if t] * 2)
    window = 32
    shards = training_order.write_shards(docs, PATH, shard_rows=7, window=window)
    rows = training_order.read_shards(spark, shards).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) == sorted(r.slot for r in rows)
    pieces = sorted(packing.pack(docs, PATH, window).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert sum(r.length for r in rows) == sum(p.length for p in pieces)
    whole = {p.sequence_id: p.ids_crc32 for p in pieces if p.length == window}
    for r in rows:
        assert (r.shard, r.byte_offset) == shards.place(r.slot)
        assert r.sequence_id not in whole or whole[r.sequence_id] == r.ids_crc32
    later = training_order.read_shards(spark, shards, first_slot=5).collect()
    assert {r.slot for r in later} == set(range(5, len(rows)))


def test_reader_of_a_range_opens_its_shards_only(docs_of, spark, tmp_path):
    docs, path = docs_of([t for t in TEXTS if t] * 2), str(tmp_path / "shards")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)       # must not split a shard
    try:
        shards = training_order.write_shards(docs, PATH, shard_rows=4, window=16, path=path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    files = {int(f.name[5:].split("-")[0]): f for f in tmp_path.glob("shards/part-*")}
    assert sorted(files) == list(range(-(-shards.order.n // 4))) and len(files) > 4
    want = {r.slot: r for r in training_order.read_shards(spark, shards, with_ids=True).collect()}
    for r in want.values():
        mapped = np.memmap(files[r.shard], dtype=shards.record, mode="r")
        assert mapped["ids"][r.slot % 4][:r.length].tolist() == r.ids
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    for shard in (0, 1, max(files)):                             # a reader of 9..13 must not touch these
        files[shard].write_bytes(b"damaged")
    got = training_order.read_shards(spark, shards, 9, 14, with_ids=True).collect()
    assert [r.slot for r in sorted(got, key=lambda r: r.slot)] == list(range(9, 14))
    assert all(r == want[r.slot] for r in got)
    assert training_order.read_shards(spark, shards, 9, 9).count() == 0
    assert training_order.read_shards(spark, shards, shards.order.n).count() == 0


def test_language_accuracy_on_held_out_rows(spark):
    from tavola.llm.queries import QUERIES
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op1_language_id"](spark, folder).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas().set_index("doc_id")
    assert len(out) == len(docs) and out.score.between(0, 1).all()
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.index]
    assert out.held_out.tolist() == held
    right = (out.lang_pred == docs.lang.reindex(out.index))
    assert right[out.held_out].mean() > 0.95
    assert out.rejected.mean() < 0.02


def test_language_of_odd_texts(docs_of):
    train = docs_of(["the house and the garden of the man"] * 3 + ["das haus und der garten von dem mann"] * 3 + [None, "x"],
                    lang=["en"] * 3 + ["de"] * 3 + ["en", None])
    model = language.fit(train)
    assert set(model) == {"de", "en"}
    odd = [None, "", "12 34 !?", "the garden and the house", "THE MAN AND THE GARDEN OF THE HOUSE", "der mann und das haus", "q"]
    rows = {r.doc_id: r for r in language.classify(docs_of(odd, score=["old"] * len(odd)), model).collect()}
    assert [rows[i].lang_pred for i in range(6)] == ["und"] * 3 + ["en", "en", "de"]
    assert all(rows[i].rejected and rows[i].score == 0 for i in range(3))
    assert rows[6].lang_pred in model and 0 <= rows[6].score <= 1
    assert language.classify(docs_of([]), model).count() == 0
    assert language.fit(docs_of([])) == {}
    assert {r.lang_pred for r in language.classify(docs_of(["text"]), {}).collect()} == {"und"}


def test_rejection_of_gibberish_and_mixed_texts(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    rnd, by = random.Random(9), {}
    for r in docs.where("doc_id % 2 = 1 AND n_chars > 300").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    clean = [t[:rnd.choice([150, 1000, 9000])] for texts in by.values() for t in texts]
    noise = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz    ", k=rnd.choice([10, 100, 300, 5000]))) for _ in range(100)]
    mixed = []
    for _ in range(100):
        one, two = (rnd.choice(by[lang]) for lang in rnd.sample(sorted(by), 2))
        n = min(len(one), len(two), rnd.choice([150, 1000, 9000]))
        mixed.append(one[:n] + " " + two[:n])
    share = {}
    for name, texts in {"clean": clean, "noise": noise, "mixed": mixed}.items():
        rows = language.classify(docs_of(texts), model).collect()
        share[name] = sum(r.rejected for r in rows) / len(rows)
    assert share["clean"] < 0.01 and share["noise"] > 0.97 and share["mixed"] > 0.9, share


def test_every_label_is_learnt(docs_of, monkeypatch):
    """More labels than the sample has room for get one text each; none is left out."""
    monkeypatch.setattr(language, "MODEL_TEXTS", 8)
    labels = [f"l{i:03d}" for i in range(300)]
    texts = [f"{chr(97 + i % 26) * 9} {i} {chr(97 + i // 26) * 7}" for i in range(300)]
    model = language.fit(docs_of(texts + texts, lang=labels + labels))
    assert sorted(model) == labels and {len(d) for d in model.values()} == {1}
    monkeypatch.setattr(language, "MODEL_TEXTS", 8 * 300)
    more = language.fit(docs_of([f"{t} number {n}" for n in "abcdef" for t in texts], lang=labels * 6))
    assert sorted(more) == labels and all(1 <= sum(x.count(b"\n") for x in d) <= 6 for d in more.values())


def test_language_with_one_text_does_not_win_by_having_one_dictionary(docs_of):
    english = [f"the house and the garden of the man number {w}" for w in "one two three four five six".split()]
    model = language.fit(docs_of(english + ["das haus und der garten von dem mann"], lang=["en"] * 6 + ["de"]))
    assert len(model["de"]) == 1 and len(model["en"]) == 2
    rows = language.classify(docs_of(["the man and the garden of the house and the number",
                                      "das haus und der garten von dem mann und dem haus"]), model).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {0: "en", 1: "de"}


def slow_counts(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(hit))


def test_counts_equal_the_plain_form():
    rnd = random.Random(1)
    for text in [None, "", " \n\t ", "a a a a", "x y z x y z q", "l\nl\n\nl \n", "a\xa0b\x1cc d#$é"] + [
            "".join(rnd.choices("ab \n#é\x85", k=rnd.randint(0, 60))) for _ in range(300)]:
        assert quality.count(text) == slow_counts(text), repr(text)


def test_host_verdicts(docs_of):
    good = " ".join(f"w{i}" for i in range(60))
    texts = [good] * 40 + ["bad"] * 40 + ["bad"] + [good, None] + [good] * 3
    hosts = ["good"] * 40 + ["bad"] * 40 + ["tiny"] + ["mixed"] * 2 + [None] * 3
    docs = docs_of(texts, source=hosts, kept=["old"] * len(texts))
    counted = quality.with_counts(docs)
    verdicts = quality.host_verdicts(counted)
    rows = {r.host: r for r in verdicts.collect()}
    n = {h: hosts.count(h) for h in set(hosts)}
    k = {h: sum(1 for t, x in zip(texts, hosts) if x == h and t != good) for h in n}
    m, total = sum(k.values()) / len(texts), len(texts)
    extra = sum(k[h] ** 2 / n[h] for h in n) / total - m * m - m * (1 - m) * len(n) / total
    strength = max(1.0, m * (1 - m) / extra - 1)
    for h in n:
        assert rows[h].rate == pytest.approx((k[h] + m * strength) / (n[h] + strength))
        assert rows[h].host_kept == (rows[h].rate <= quality.HOST_LIMIT)
    assert not rows["bad"].host_kept and rows["good"].host_kept
    out = quality.judge(counted, verdicts).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.kept == (r.text == good and rows[r.source].host_kept)
    empty = quality.with_counts(docs_of([]))
    assert quality.judge(empty, quality.host_verdicts(empty)).count() == 0


def test_sha_columns_of_the_query(spark):
    from tavola.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in QUERIES["op3_bpe"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    ref = Tokenizer.from_file(PATH)
    for d in docs[:60]:
        ids = ref.encode(d.text or "", add_special_tokens=False).ids
        assert out[d.doc_id].n_tokens == len(ids)
        assert out[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
