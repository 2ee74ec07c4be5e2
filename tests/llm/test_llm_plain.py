"""Language ID and main text against plain forms of the same definitions, on whole tables."""
import re
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from tavola.llm import html_text, language
from tavola.llm.queries import QUERIES, held_out

SMALL = "/root/testdata/sf0.001"


def plain_language(text, dictionaries):
    """(language, score, rejected): one zstandard call for each block, language and dictionary."""
    if text is None or not any(c.isalpha() for c in text) or not dictionaries:
        return "und", 0.0, True
    raw = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
    size = max(64, min(2048, (len(raw) + 1) // 2))
    how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=3, min_match=4,
                                              strategy=zstandard.STRATEGY_LAZY, write_checksum=False,
                                              write_content_size=False, write_dict_id=False)
    total, lowest = Counter(), 0
    for at in range(0, len(raw), size):
        of_block = {}
        for lang, several in dictionaries.items():
            of_block[lang] = 0
            for d in several:
                c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
                of_block[lang] += len(c.compress(raw[at:at + size])) * 2 / len(several)
            total[lang] += of_block[lang]
        lowest += min(of_block.values())
    best = min(sorted(total), key=total.__getitem__)
    others = [n for lang, n in total.items() if lang != best]
    if not others:
        return best, 1.0, total[best] - lowest > 0.02 * total[best]
    won = (min(others) - total[best]) / min(others)
    narrow = won < 0.05 or min(others) - total[best] < 4
    return best, min(1.0, won), narrow or total[best] - lowest > 0.02 * total[best]


def test_language_equals_plain_compression(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    dictionaries = language.fit(docs.where(~held_out()).select("text", "lang"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op1_language_id"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score, rejected = plain_language(texts[r.doc_id], dictionaries)
        assert (r.lang_pred, r.rejected) == (lang, rejected) and r.score == pytest.approx(score, abs=1e-12), r.doc_id


def test_main_text_equals_counting_all_subtrees(spark):
    """Templates counted in one dictionary over all pages, sets of them taken from each page."""
    box, line = "<div><p>Follow us</p><p>everywhere</p></div>", "<p>Every third page says this.</p>"
    boxed = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("</article>"), F.lit(box + "</article>"))).when(
        F.col("page_id") % 3 == 1, F.replace("html", F.lit("</article>"), F.lit(line + "</article>"))).otherwise(F.col("html"))
    for folder, changed in ((SMALL, False), ("/root/testdata/sf0.01", False), ("/root/testdata/sf0.01", True)):
        table = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", boxed.alias("html") if changed else "html")
        pages = table.collect()
        seen, contents = defaultdict(set), defaultdict(set)
        parsed = {}
        for r in pages:
            page = parsed[r.page_id] = html_text.Page(r.html or "")
            main = page.text()
            for scope in html_text.scopes_of(r.url):
                contents[scope].add(main)
                for digest, tag in zip(page.digests, page.tags):
                    if digest and tag not in html_text.FRAME:
                        seen[scope, digest].add(main)

        def recurs(scope, digest, block):
            n, every = len(seen[scope, digest]), len(contents[scope])
            enough = n >= 6 and (n >= 10 or 2 * n >= every) and n >= 0.02 * every
            return enough and (not block or n >= 0.2 * every)

        result = html_text.extract(table) if changed else QUERIES["op6_html_text"](spark, folder)
        got = {r.page_id: r for r in result.collect()}
        removed = 0
        for r in pages:
            page, scopes = parsed[r.page_id], html_text.scopes_of(r.url)
            found = [{d for d in page.digests if d and any(recurs(s, d, block) for s in scopes)} for block in (False, True)]
            want = page.text(frozenset(found[0]), frozenset(found[1]))
            removed += want != page.text()
            assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want)), r.page_id
        assert len(got) == len(pages)
    assert removed > 0


def test_digests_stand_for_whole_subtrees():
    """Equal digests are equal subtrees: elements with one digest have one tag and one text below."""
    html = ["<div><p>a b</p><ul><li>c<li>d</ul></div>", "<div><p>a  b</p><ul><li>c</li><li>d</li></ul></div>",
            "<div><p>a</p><ul><li>b c<li>d</ul></div>", "<section><p>a b</p></section><div><p>a b</p></div>"]
    by_digest = defaultdict(set)
    for h in html:
        page = html_text.Page(h)
        below = defaultdict(str)
        for e in range(len(page.tags) - 1, 0, -1):
            own = "".join("".join(t.split()) for x in [e] for t in [i[1] for i in page.flow if i is not None and i[0] == x])
            below[e] = f"<{page.tags[e]}>{own}" + "".join(below[c] for c in range(e + 1, len(page.tags)) if page.parents[c] == e)
            if page.digests[e]:
                by_digest[page.digests[e]].add(below[e])
    assert all(len(v) == 1 for v in by_digest.values()) and len(by_digest) > 8
