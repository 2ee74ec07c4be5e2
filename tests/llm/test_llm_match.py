"""Similarity join, repeated passages, licences, main text, nearest neighbours."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tavola.llm import ann, html_text, licences, ngram_join, repeats
from tavola.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_sets(texts, words):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words
                   else {tuple(w)} if w else set())
    return out


def slow_components(ids, texts, words, percent):
    sets, up = slow_sets(texts, words), list(range(len(texts)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least.get(find(i))) for i in range(len(ids))]


def near_copies(rnd, groups, copies, size):
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rnd.choices(vocabulary, k=12)
    texts = []
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=rnd.randint(1, size))
        for _ in range(rnd.randint(1, copies)):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                t = t[:rnd.randint(0, len(t))] + shared + t[rnd.randint(0, len(t)):]
            texts.append(" ".join(t).upper() if rnd.random() < 0.2 else "\n".join(t))
    return texts


@pytest.mark.parametrize("words,percent,block,seed", [(4, 85, 2048, 1), (5, 80, 3, 2), (1, 50, 2, 3)])
def test_join_equals_all_pairs(docs_of, words, percent, block, seed):
    rnd = random.Random(seed)
    texts = near_copies(rnd, 14, 9, 60) + [None, "", " \n", "one", "one", "One  ", "one two", "a b c d", "a b c d e"]
    ids = rnd.sample(range(10_000), len(texts))
    ids[-3] = None
    got = ngram_join.connect(docs_of(texts, ids=ids, node=["x"] * len(texts), version=["x"] * len(texts)), words, percent, block).collect()
    assert Counter(map(tuple, got)) == Counter(slow_components(ids, texts, words, percent))


def test_join_on_the_whole_table(spark):
    from tavola.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    got = QUERIES["op2_ngram_join"](spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(slow_components(docs.doc_id.tolist(), docs.text.tolist(), 4, 85))


def test_join_of_nothing_and_of_copies(docs_of):
    assert ngram_join.connect(docs_of([])).count() == 0
    same = ngram_join.connect(docs_of(["a b c d e f g h"] * 200)).collect()
    assert {r.component_id for r in same} == {0} and len(same) == 200


def test_tree_finds_every_class():
    rnd = random.Random(9)
    for _ in range(40):
        sets = [sorted(set(rnd.choices(range(30), k=rnd.randint(1, 20))), reverse=True) for _ in range(25)]
        sets = [list(x) for x in {tuple(s) for s in sets}]
        tree = ngram_join.PrefixTree(60)
        for s in sets:
            tree.add(s, len(s))
        up = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len({*a} & {*sets[j]}) >= 60 * len({*a} | {*sets[j]}):
                    old, new = up[i], up[j]
                    up = [new if x == old else x for x in up]
        roots = [tree.find(i) for i in range(len(sets))]
        assert len(set(zip(roots, up))) == len(set(roots)) == len(set(up))


def test_components_of_a_long_chain(spark, docs_of):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(900, 901), (901, 900), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}
    assert components(links.limit(0)).count() == 0


def slow_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * (len(r) + 1)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def patchwork(rnd, n, pieces):
    parts = ["".join(rnd.choices("abcdé ", k=rnd.randint(5, 90))) for _ in range(pieces)] + ["ab" * 60, "z" * 80]
    return ["".join(rnd.choice(parts) if rnd.random() < 0.5 else "".join(rnd.choices("efghijk\n", k=rnd.randint(1, 40)))
                    for _ in range(rnd.randint(0, 7))) for _ in range(n)]


@pytest.mark.parametrize("length,hot,seed", [(40, 50_000, 1), (24, 2, 2), (24, 0, 3)])
def test_repeats_equal_all_windows(docs_of, length, hot, seed):
    rnd = random.Random(seed)
    texts = patchwork(rnd, 30, 5) + [None, "", "q" * length, "q" * (length - 1), "copy of a text " * 9, "copy of a text " * 9]
    docs = docs_of(texts, kept=["old"] * len(texts), start=["x"] * len(texts))
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, length, hot).collect()}
    for i, want in enumerate(slow_repeats(texts, length)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want, i


def test_repeats_of_nothing_and_of_long_texts(docs_of, monkeypatch):
    assert repeats.remove_repeats(docs_of([])).count() == 0
    monkeypatch.setattr(repeats, "SLICE", 512)      # in this process: the anchors of a text in slices
    rnd = random.Random(4)
    texts = [t * 3 for t in patchwork(rnd, 6, 3)]
    raws = [t.encode() for t in dict.fromkeys(texts)]
    number, place, fp = repeats.anchors(raws, 40)
    gone = [np.zeros(len(r), bool) for r in raws]
    lefts = [raws[i][max(p - 30, 0):p][::-1] for i, p in zip(number, place)]
    rights = [raws[i][p:p + 40] for i, p in zip(number, place)]
    rows = list(dict.fromkeys(zip(number.tolist(), place.tolist(), range(len(place)))))
    first = {(i, p): k for i, p, k in reversed(rows)}
    pick = sorted(first.values())
    for k, e, d in repeats.maximal_repeats([lefts[k] for k in pick], [rights[k] for k in pick], fp[pick], 40):
        gone[number[pick[k]]][place[pick[k]] - e:place[pick[k]] + d] = True
    for g, want in zip(gone, slow_repeats([r.decode() for r in raws], 40)):
        assert int(g.sum()) == want[1]


def test_intervals_of_a_suffix_array():
    text = "banana$"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [next(k for k in range(9) if text[a + k:a + k + 1] != text[b + k:b + k + 1] or not text[a + k:a + k + 1])
           for a, b in zip(order, order[1:])]
    got = {(text[order[f]:][:d], l - f + 1) for f, l, d in repeats.intervals(np.array(lcp), 1)}
    assert got == {("a", 3), ("ana", 2), ("na", 2)}


def test_licence_edges(docs_of):
    texts = [None, "", "...", "Released under the MIT License.", "MIT license mit LICENSE", "licensed under CC BY-NC 4.0",
             "the general public license", "x Apache License, Version 2.0 licensed under the apache license version 2 0 mit",
             "license mit", "é MIT—License", "Permission is hereby granted, free of charge, to any person obtaining a copy"]
    rows = {r.doc_id: r for r in licences.scan(docs_of(texts, labels=["old"] * len(texts))).collect()}
    base = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for _, r in sorted(rows.items())]
    assert base[:5] == [(0, 0, None, None, "")] * 3 + [(5, 1, 3, 3, "mit"), (4, 2, 0, 2, "mit")]
    assert base[6] == (4, 1, 1, 1, "gpl") and base[7][1:] == (2, 1, 9, "apache")
    assert base[8] == (2, 0, None, None, "") and base[9][0] == 2
    assert [rows[i].labels for i in (3, 5, 7, 10)] == ["mit", "cc-by-nc", "apache", "mit"]
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[3].score == 1.0
    assert licences.scan(docs_of([])).count() == 0


def test_altered_notices_keep_their_label(docs_of):
    """Each text's own rarest words decide, so a changed word, another corpus or a second licence do not."""
    bsd = "redistribution and use in source and binary forms with or without {} are permitted"
    apache = "licensed under the apache license version 2 0"
    texts = [bsd.format("modification"), bsd.format("alteration"), "x " * 50 + bsd.format("change") + " y " + apache,
             "redistribution and use in binary and source forms with or without modification are permitted",
             "in source and binary forms", "commons attribution", "this work is licensed under a commons attribution note"]
    for more in ([], ["modification " * 3] * 40, ["redistribution binary forms source"] * 40):
        got = {r.doc_id: (r.labels, r.score) for r in licences.scan(docs_of(texts + more)).collect()}
        assert [got[i][0] for i in range(7)] == ["bsd", "bsd", "apache,bsd", "", "", "", ""]
        assert got[0][1] == 1.0 and 0.9 < got[1][1] < 1.0 and got[2][1] == 1.0
    own = licences.scan(docs_of(["zlib says as is here", "as is"]), notices=[("zlib", "says as", "zlib says as is")]).collect()
    assert sorted(r.labels for r in own) == ["", "zlib"]


def test_licences_use_no_python(spark):
    from tavola.llm.queries import QUERIES
    plan = QUERIES["op5_licences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="top-ad">Buy</div><form><input value=x>Search</form>
<main><article><h1>Title&nbsp; one</h1><p>First <b>bold</b>
 text&#33;<br>next<p>Second &lt;b&gt; <!-- no --> para<ul><li>one<li>two</ul><div class=share>Share it</div>
<section class="comments"><p>nice</p></section></article><div class="promo">More</div></main>
<aside>Side</aside><footer>&copy; me</footer></body>"""


def test_main_text_of_a_page():
    assert html_text.Page(PAGE).text() == "Title one\nFirst bold text! next\nSecond <b> para\none\ntwo"
    for html, text in {"": "", "plain": "plain", "<p>a<p>b": "a\nb", "<div>a<b>c</div>d": "ac\nd", "<p>x</b></p> y": "x\ny",
                       "<main><p>m</p></main><p>n": "m", "<![foo bar[<p>a": "a", "<p hidden>h</p>v": "v", "a < b & c": "a < b & c",
                       "<article class=comment>c</article><article>k</article>": "k", "&#xe9;&eacute;": "éé"}.items():
        assert html_text.Page(html).text() == text, html
    assert html_text.Page("<div>" * 3000 + "deep").text() == "deep"


def test_markup_deletes_no_article():
    for html, text in {
            "<article class='post category-social has-comments'><p>a</p></article><p>b</p>": "a",
            "<article id=notice class='widget category-notices'><p>a</p></article>": "a",
            "<body><form action=x><input value=y><div><article><p>a</p><button>Go</button></article></div></form><p>b": "a",
            "<form><div><p>Long text of it</p><select><option>no</select></div></form><form>Search</form>": "Long text of it",
            "<div class='widget related'><article><p>a</p></article></div><p>more text</p>": "a",
            "<aside><article><p>the whole article</p></article></aside><p>b</p>": "the whole article",
            "<main><p>real text</p><aside><article>teaser</article></aside></main>": "real text",
            "<article><p>a</p><section class=notice-period><p>b</p></section><div class=related-work>c</div>"
            "<div class=widget-api>d</div><div class='x related'>no</div></article>": "a\nb\nc\nd",
            "<article>a<section class=comments><article>no</article></section></article>": "a",
            "<article><p>a</p></article><div id=comments><article>no</article></div>"
            "<article class='comment odd'>no</article><article class=ad>no</article>": "a",
            "<header><main><p>a</p></main></header><p>b": "a", "<main class=modal>a</main>b": "a"}.items():
        assert html_text.Page(html).text() == text, html


def test_templates_are_removed(spark, docs_of):
    box = "<div><p>Follow us</p><p>everywhere</p></div>"
    pages = [(i, f"https://a.org/{i}", f"<body><article><p>Text {i}</p>{box if i % 4 else ''}</article></body>") for i in range(40)]
    pages += [(100 + i, f"http://b.org/{i}", f"<p>One {i}</p>{box}") for i in range(5)]
    pages += [(200, None, f"<p>x</p>{box}"), (201, "http://[broken", None), (202, "https://a.org/z", ""), (0, "https://a.org/0", pages[0][2])]
    table = spark.createDataFrame([(*p, "old") for p in pages], "page_id long, url string, html string, text string").repartition(3)
    got = html_text.extract(table).collect()
    assert len(got) == len(pages)
    for r in got:
        kept = "" if r.page_id < 100 else "\nFollow us\neverywhere"
        want = "" if not r.html else f"Text {r.page_id}" if r.page_id < 100 else (
            f"One {r.page_id - 100}" if r.page_id < 200 else "x") + kept
        assert (r.text, r.n_chars) == (want, len(want))
    assert html_text.extract(table.limit(0)).count() == 0


def test_copies_are_no_templates(spark):
    """A host made up mostly of copies keeps their article, under changing adverts too."""
    copy = "<body><div class=ad>Buy {}</div><article><h1>Head</h1><p>First of it</p><p>Second of it</p></article></body>"
    box = "<div><p>Follow us</p><p>everywhere</p></div>"
    pages = [(i, "https://c.org/x", copy.format(i % 7)) for i in range(60)]
    pages += [(100 + i, f"https://c.org/{i}", f"<article><p>Own {i}</p>{box}</article>") for i in range(30)]
    pages += [(200 + i, f"https://d.org/{i}", f"<div><h1>Head</h1><p>All of it</p></div><nav>{i}</nav>") for i in range(20)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    for r in html_text.extract(table).collect():
        assert r.text == ("Head\nFirst of it\nSecond of it" if r.page_id < 100 else
                          f"Own {r.page_id - 100}" if r.page_id < 200 else "Head\nAll of it"), r


def test_templates_of_large_small_and_many_tongued_hosts(spark):
    def page(host, where, i, box):
        return (f"https://{host}.org/{where}{i}", f"<article><p>{host} {i}</p>{box}</article>")
    box, no = "<div><p>Follow us</p><p>everywhere</p></div>", "<p>Yes.</p>"
    pages = [page("large", "", i, box if i % 50 == 0 else no if i % 20 == 1 else "") for i in range(2000)]
    tongues = [page("tongues", f"{k}/", 100 * k + i, f"<p>Box {k}</p>") for k in range(30) for i in range(12)]
    small = [page("six", "", i, box) for i in range(6)] + [page("few", "", i, box) for i in range(5)]
    rows = [(i, *p) for i, p in enumerate(pages + tongues + small)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.url: r.text for r in html_text.extract(table).collect()}
    assert len(got) == len(rows)
    for i in range(2000):
        assert got[f"https://large.org/{i}"] == f"large {i}" + ("\nYes." if i % 50 and i % 20 == 1 else "")
    for k in range(30):
        assert all(got[f"https://tongues.org/{k}/{100 * k + i}"] == f"tongues {100 * k + i}" for i in range(12))
    assert all(got[f"https://six.org/{i}"] == f"six {i}" for i in range(6))
    assert all(got[f"https://few.org/{i}"] == f"few {i}\nFollow us\neverywhere" for i in range(5))


def slow_nearest(rows, k, query):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good[i], v) if i in good else v
    out = {}
    for q in filter(query, good):
        near = sorted((-float(np.dot(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        out[q] = [i for _, i in near[:k]]
    return out


def test_neighbours_equal_all_products(spark, docs_of):
    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.integers(-4, 5, 6) * rnd.choice([0.25, 1.0])).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0] * 6) for i in range(60)] + [(400 + i, rnd.normal(size=3).tolist()) for i in range(5)]
    rows += [(500, None), (501, [0.0] * 6), (502, [float("nan")] + [1.0] * 5), (503, [None] + [1.0] * 5),
             (504, [float("inf")] * 6), (None, [1.0] * 6), (7, [9.0] * 6), (0, rows[0][1])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    found = ann.nearest(table, F.col("vec_id") % 20 == 0, k=7, shard_rows=50, query_rows=4).collect()
    want = slow_nearest(rows, 7, lambda i: i % 20 == 0)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append(r.vec_id)
    assert got == want
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_the_whole_table(spark):
    from tavola.llm.queries import QUERIES
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want[ids[q]] = set(ids[np.lexsort((ids, -s))[:20]].tolist())
    got = {}
    for r in QUERIES["op7_nearest_neighbours"](spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(x[ids == r.query_id][0] @ x[ids == r.vec_id][0]), abs=1e-12)
    assert got == want
    tree = ann.Tree(ids, x)
    q = ids % 20 == 0
    _, loose = tree.search(ids[q], x[q], 20, relax=2.0)
    assert np.mean([len(want[i] & set(f.tolist())) / 20 for i, f in zip(ids[q], loose)]) >= 0.9
