"""Main text of web pages with site template removal (operator 6).

Every element's subtree (its tag, its text with white space made one space, and
the digests of its children) is hashed.  Spark counts on how many distinct pages of
each host, and of each section of a host, a digest occurs; subtrees that recur on
many of them belong to the site, not to the page, and are deleted before the text is
taken.  An absolute number of pages decides (10, on small hosts 6 to 10); on hosts
and in sections of over 500 pages, a share of 2 %, so that what many pages happen to
share stays.  Single paragraphs, headings, list items and table cells, which may be
body text, go if a fifth of the pages has them.  Nothing recurs on fewer than 6.  Pages are distinct by
their main text as markup alone gives it, so copies of a page, also those under
other menus or adverts, count as one page and are no evidence of a template.  What HTML
itself marks as no article (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) is left out as well, by element name,
role, and whole names of class and id; never an element that holds the page's
article or main, nor a form round the page's text, of which only controls go.

The text is that of the outermost ``article`` elements, else of ``main``, else
of the body.  Block elements delimit blocks; in a block white space becomes one
space; blocks that are not empty are joined by one line feed in page order.

Defined results: null or empty html gives an empty text; a null or broken url
has no host, so nothing of the page counts as recurring; broken markup is read
as far as it goes, open elements end with their parent; repeated rows get equal
results and count as one page of the host; answer columns replace input columns of
the same names, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import written
from tavola.llm.workers import lean

# A subtree recurs on a host, or in a section of it (the first part of the path), if it stands on
MIN_PAGES = 10           # so many distinct pages at least; under twice as many pages: on half of them,
SMALL_PAGES = 6          # but never on fewer than these;
MIN_SHARE = 0.02         # and on this share of the distinct pages,
BLOCK_SHARE = 0.2        # or on this one if it is a paragraph or the like, which may be body text

# Element names of HTML, roles, and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split())
INERT = frozenset(
    "head title script style noscript template iframe object embed svg canvas math audio video "
    "button input select textarea option".split())
NO_TEXT = frozenset("nav footer aside menu dialog".split())
NO_TEXT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
    "toolbar status".split())
# Whole names of classes and ids; a part of a longer name says nothing.
ADVERT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox ad-box ad-slot ad-container "
    "ad-banner banner-ad top-ad sponsor sponsored".split())
COMMENT = frozenset("comment comment-body".split())
COMMENTS = frozenset(
    "comments commentlist comment-list comments-area comments-section comment-form disqus disqus_thread "
    "respond responses replies".split())
NO_TEXT_WORDS = ADVERT | COMMENT | COMMENTS | frozenset(
    "promo promotion nav navbar navigation main-nav main-navigation site-nav site-navigation top-nav "
    "menu main-menu menubar breadcrumb breadcrumbs pagination pager footer site-footer page-footer "
    "sidebar left-sidebar right-sidebar sidebar-left sidebar-right aside masthead site-header toolbar "
    "cookie cookies cookie-banner cookie-bar cookie-consent cookie-notice consent gdpr notice notices "
    "popup modal overlay newsletter newsletter-signup subscribe subscription signup login share sharing "
    "share-buttons share-links social social-links social-share related related-posts related-articles "
    "widget widgets widget-area".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption blockquote pre address".split())
FRAME = frozenset(["#root", "html", "body", "main", "article"])
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_SCOPE = frozenset("ul ol dl table".split())
SOFT, HARD, DEAD = 1, 2, 3    # markup against an element: by a name or role, as no article, as no text at all


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url or "").hostname
    except ValueError:
        return None


def scopes_of(url: str | None) -> list[str]:
    """A url's host, and its host and first directory; none without a host."""
    if (host := host_of(url)) is None:
        return []
    first, slash, _ = urlsplit(url).path.lstrip("/").partition("/")
    return [host, f"{host}/{first}"] if slash and first else [host]


def _marked(tag: str, attrs: list) -> int:
    """How strongly the markup itself says that an element is no part of an article."""
    found = DEAD if tag in INERT else HARD if tag in NO_TEXT else SOFT if tag == "form" else 0
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            found = max(found, SOFT)
        elif name == "role" and value in NO_TEXT_ROLES:
            found = max(found, SOFT)
        elif name == "style" and "display:none" in value.replace(" ", ""):
            found = max(found, SOFT)
        elif name in ("class", "id"):
            names = {*value.split()}
            if tag == "article":
                # an article is one of many things; only a comment or an advert is none
                found = max(found, HARD if names & (ADVERT | COMMENT) else 0)
            elif tag != "main" and names & NO_TEXT_WORDS:
                found = max(found, HARD if names & (ADVERT | COMMENT | COMMENTS) else SOFT)
    return found


class Page(HTMLParser):
    """Flat list of a page's elements (a parent before its children) and its flow
    of texts and block borders."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.marked = ["#root"], [-1], [0]
        self.digests: list[int] = [0]
        self.flow: list[tuple[int, str] | None] = []
        self.open: list[tuple[int, str, list[str]]] = [(0, "#root", [])]
        self.feed(html)
        self.close()
        while self.open:
            self._end()

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def updatepos(self, i, j):
        return j                        # nobody asks for line numbers

    def _end(self) -> None:
        element, tag, parts = self.open.pop()
        text = "\0".join(parts)
        if text and tag not in INLINE:
            self.digests[element] = xxhash.xxh3_64_intdigest(f"{tag}\0{text}") - 2**63
        if self.open and text:
            self.open[-1][2].append(text if tag in INLINE else f"\1{self.digests[element]}")
        if tag not in INLINE:
            self.flow.append(None)

    def _end_until(self, names, barrier) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][1] in names:
                while len(self.open) > k:
                    self._end()
                return
            if self.open[k][1] in barrier:
                return

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._end_until(("p",), FRAME | LIST_SCOPE | {"div", "section", "td", "th", "blockquote"})
            self.flow.append(None)
        if tag in CLOSES:
            self._end_until(CLOSES[tag], LIST_SCOPE)
        element = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.open[-1][0])
        self.marked.append(_marked(tag, attrs))
        self.digests.append(0)
        if tag not in VOID:
            self.open.append((element, tag, []))
        elif tag == "br":
            self.flow.append((element, " "))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end()

    def handle_endtag(self, tag):
        if tag in INLINE:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][1] == tag:
                    while len(self.open) > k:
                        self._end()
                    return
                if self.open[k][1] not in INLINE:
                    return
        else:
            self._end_until((tag,), ())

    def handle_data(self, data):
        element, _, parts = self.open[-1]
        self.flow.append((element, data))
        if text := " ".join(data.split()):
            parts.append(text)

    def _weights(self, cost: list[int], most: int) -> list[int]:
        """Letters below each element, without what is marked more strongly."""
        weight = [0] * len(self.tags)
        for item in self.flow:
            if item is not None and cost[item[0]] <= most:
                weight[item[0]] += len("".join(item[1].split()))
        for e in range(len(weight) - 1, 0, -1):
            weight[self.parents[e]] += weight[e]
        return weight

    def _spared(self, mark: list[int], article: list[bool]) -> list[bool]:
        """Elements that no markup deletes: those with the page's article or main.

        Of the outermost articles those count that no element round them is marked
        against, else those in elements marked by a name, a role or as a form; the
        ones in menus, sidebars or comments, and comments themselves, only on a page
        that has more text in them than outside.  A form that holds most of the
        page's text is a wrapper, of which only the controls go."""
        n, parents, tags = len(self.tags), self.parents, self.tags
        cost = [0] * n
        for e in range(1, n):
            cost[e] = max(cost[parents[e]], mark[e])
        articles = [e for e in range(1, n) if tags[e] == "article" and not article[parents[e]] and cost[e] < DEAD]
        mains = [e for e in range(1, n) if tags[e] == "main" and cost[e] < DEAD]
        keep = ([e for e in articles if not cost[e]] or [e for e in articles if cost[e] == SOFT])
        keep += [e for e in mains if not cost[e]] or [e for e in mains if cost[e] == SOFT]
        if not keep and (hard := articles or mains):
            weight = self._weights(cost, HARD)
            if 2 * sum(weight[e] for e in hard) > weight[0]:
                keep = hard
        if "form" in tags:
            weight = self._weights(cost, SOFT)
            keep += [e for e in range(1, n) if tags[e] == "form" and 2 * weight[e] > weight[0]]
        spared = [False] * n
        for e in keep:
            while e > 0 and not spared[e]:
                spared[e] = True
                e = parents[e]
        return spared

    def text(self, recurring: frozenset[int] = frozenset(), often: frozenset[int] | None = None) -> str:
        """Main text without the subtrees whose digests are given; ``often`` has
        those of paragraphs and the like, if not the same."""
        often = recurring if often is None else often
        n = len(self.tags)
        gone, article, main, mark = [False] * n, [False] * n, [False] * n, [*self.marked]
        for e in range(1, n):
            up, tag = self.parents[e], self.tags[e]
            article[e] = article[up] or tag == "article"
            main[e] = main[up] or tag == "main"
            if tag in ("html", "body"):
                mark[e] = 0
            elif tag == "header" and not article[e]:
                mark[e] = max(mark[e], SOFT)
        spared = self._spared(mark, article)
        for e in range(1, n):
            gone[e] = gone[self.parents[e]] or (mark[e] > 0 and not spared[e]) or (
                self.tags[e] not in FRAME and self.digests[e] != 0
                and self.digests[e] in (often if self.tags[e] in BLOCKS else recurring))
        shown = [e for e in range(n) if not gone[e]]
        kept = (article if any(article[e] for e in shown) else main if any(main[e] for e in shown)
                else [True] * n)
        blocks, now = [], []
        for item in [*self.flow, None]:
            if item is None:
                if block := " ".join("".join(now).split()):
                    blocks.append(block)
                now = []
            elif kept[item[0]] and not gone[item[0]]:
                now.append(item[1])
        return "\n".join(blocks)


def subtree_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(scope, digest, pages): on how many distinct pages of a host, or of a section
    of a host, a subtree occurs; digest 0 counts all its distinct pages.

    Both aggregates are partial ones: a task sends a (scope, digest, page) once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scopes, digests, contents = [], [], []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not (within := scopes_of(url)):
                    continue
                page = Page(html.as_py() or "")
                found = {d for d, tag in zip(page.digests, page.tags) if tag not in FRAME} | {0}
                content = xxhash.xxh3_64_intdigest(page.text()) - 2**63
                for scope in within:
                    scopes += [scope] * len(found)
                    digests += found
                    contents += [content] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(scopes, pa.string()), pa.array(digests, pa.int64()), pa.array(contents, pa.int64())],
                names=["scope", "digest", "content"])

    found = (pages.select(F.col(url_col), F.col(html_col))
             .mapInArrow(lean(run), "scope string, digest long, content long"))
    once = found.groupBy("scope", "digest", "content").agg(F.lit(1).alias("_"))
    return once.groupBy("scope", "digest").agg(F.count(F.lit(1)).alias("pages"))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES,
              min_share: float = MIN_SHARE, block_share: float = BLOCK_SHARE) -> DataFrame:
    """One written row per scope with recurring subtrees: scope, digests and often
    (arrays; those that reach ``min_share`` and ``block_share``).

    A page has a bounded number of subtrees, and at most that many divided by
    ``min_share`` can recur, so an array is as long as some pages, not as a host."""
    least = min(SMALL_PAGES, min_pages)
    counted = written(subtree_counts(pages, url_col, html_col).where(F.col("pages") >= least), "subtrees")
    scopes = counted.where("digest = 0").select("scope", F.col("pages").alias("all_pages"))
    bar = F.greatest(F.lit(least), F.least(F.lit(min_pages), F.col("all_pages") / 2))
    blocks = F.when(F.col("pages") >= block_share * F.col("all_pages"), F.col("digest"))
    return written(counted.where("digest <> 0").join(scopes, "scope")
                   .where((F.col("pages") >= bar) & (F.col("pages") >= min_share * F.col("all_pages")))
                   .groupBy("scope").agg(F.collect_list("digest").alias("digests"),
                                         F.collect_list(blocks).alias("often")), "templates")


def main_text(html: Column, scopes: list[Column], recurring: list[Column]) -> Column:
    """Main text of an html column, without the recurring subtrees of its ``scopes``: for
    each scope two arrays of digests, all and those for blocks.  The sets of a scope are
    made once a batch."""
    n_scopes = len(scopes)

    def run(htmls: pa.Array, *given: pa.Array) -> pa.Array:
        names, arrays = given[:n_scopes], given[n_scopes:]
        known: dict[tuple, tuple[frozenset, frozenset]] = {}
        out = []
        for k, (html, *within) in enumerate(zip(htmls, *(n.to_pylist() for n in names))):
            key = tuple(within)
            if key not in known:
                known[key] = tuple(frozenset(d for column in arrays[i::2] for d in column[k].as_py() or ()) for i in (0, 1))
            out.append(Page(html.as_py() or "").text(*known[key]))
        return pa.array(out, type=pa.string())

    return F.arrow_udf(lean(run), "string").asNondeterministic()(html, *scopes, *recurring)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES,
            min_share: float = MIN_SHARE, block_share: float = BLOCK_SHARE) -> DataFrame:
    """Add ``text`` and ``n_chars`` to every page."""
    def run(urls: pa.Array) -> pa.Array:
        return pa.array([scopes_of(u) for u in urls.to_pylist()], type=pa.list_(pa.string()))

    sites = templates(pages, url_col, html_col, min_pages, min_share, block_share)
    out = pages.withColumn("_of", F.arrow_udf(lean(run), "array<string>").asNondeterministic()(F.col(url_col)))
    for k in (0, 1):
        out = out.join(sites.toDF(f"_scope{k}", f"_digests{k}", f"_often{k}"),
                       F.get("_of", F.lit(k)) == F.col(f"_scope{k}"), "left")
    arrays = [F.col(f"_{name}{k}") for k in (0, 1) for name in ("digests", "often")]
    return (out.withColumn("text", main_text(F.col(html_col), [F.col(f"_scope{k}") for k in (0, 1)], arrays))
            .withColumn("n_chars", F.length("text").cast("long"))
            .drop("_of", *[f"_{name}{k}" for k in (0, 1) for name in ("scope", "digests", "often")]))
