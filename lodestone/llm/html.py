"""Main text of web pages: boilerplate elements by markup, site templates by subtree counts per host.

One map parses the pages and hashes their element subtrees; Spark counts, per host, the pages with different contents
in which each subtree occurs; a second map deletes the subtrees that recur and joins the blocks that are left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: A subtree belongs to the template if it is on more than this share of its host's pages, pages of equal content
#: counted once, and on so many at least.
RATIO, MIN_PAGES = 0.5, 5
#: Template subtrees of all hosts that are broadcast at most (8 bytes each).
BROADCAST_SUBTREES = 1_000_000

#: Elements of HTML by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NOT_TEXT = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "input", "map", "menu", "nav", "noscript",
    "object", "option", "script", "select", "style", "svg", "template", "textarea", "title", "video",
}
NOT_TEXT_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: What names boilerplate as a whole class or id, alone or with words that only say what kind of part or place it is.
#: Any other word beside them makes it a name of something else: ``ad-box`` is an advert, ``related-work`` is text.
NOT_TEXT_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "responses",
    "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets",
}
PART_WORDS = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "form", "icons", "inner", "item", "items", "left",
    "link", "links", "list", "outer", "page", "panel", "post", "posts", "reader", "right", "section", "site", "slot", "stories", "sticky", "thread",
    "top", "unit", "user", "wrap", "wrapper",
}
COMMENT_NAMES = {"comment", "comments", "disqus", "reply", "replies", "responses"}
#: An element that only its name tells as boilerplate, on a page without article or main, is none with more than this share of its text.
WRAPPER_SHARE = 0.5
#: What stands beside an article, directly in main, and is text of its own.
FLOW = {"blockquote", "dl", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "ol", "p", "pre", "table", "ul"}
#: An element of a key is closed by the start of one of its values, unless one of the barriers is open in between.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table"}
CONTAINERS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "article", "section", "div", "main", "body", "td", "th", "blockquote", "aside", "nav", "form", "header", "footer"}

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LONG_NUMBER = re.compile(r"&#\d{9,}")
_COMMENT, _RAW, _TAG = re.compile("<!--"), ("script", "style", "textarea", "title"), re.compile(r"<[A-Za-z/!?]")


class Page(HTMLParser):
    """A page's elements in document order, with the end tags that may be left out put in.

    Element i has tags[i], parents[i] and parts[i], its texts and the numbers of its children. A parent comes before its
    children, so loops over the numbers replace recursion and nesting may be of any depth.
    """

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.dropped = ["html"], [-1], [False]
        self.parts: list[list[str | int]] = [[]]
        self.named, self.headers = [False], [False]
        self._open, self._at = [0], {}  # open elements, and by tag where they stand among them
        html = _shortened(_ended(html or ""))
        self._last_end = html.rfind("]]>")
        self.feed(html)
        self.close()
        self._own = [sum(len("".join(p.split())) for p in parts if isinstance(p, str)) for parts in self.parts]
        self.kept = self._kept()

    # -- parsing

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCK:
            self._close_through("p", CONTAINERS)
        for held, closers in CLOSED_BY.items():
            if tag in closers and self._at.get(held):
                self._close_through(held, LISTS | {"tr"} if held in ("td", "th") and tag != "tr" else LISTS)
        if tag in VOID and tag not in BLOCK:
            self.parts[self._open[-1]].append(" ")
            return
        number = len(self.tags)
        dropped, named, header = _verdict(tag, dict(attrs)) if attrs else (tag in NOT_TEXT, False, tag == "header")
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.parts.append([])
        self.dropped.append(dropped)
        self.named.append(named)
        self.headers.append(header)
        self.parts[self._open[-1]].append(number)
        if tag not in VOID:
            self._at.setdefault(tag, []).append(len(self._open))
            self._open.append(number)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if places := self._at.get(tag):
            self._close_from(places[-1])

    def handle_data(self, data: str) -> None:
        self.parts[self._open[-1]].append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...``: a comment in HTML, whatever it says; to its own end if it has one, else to the next ``>``."""
        mark = "]]>" if self.rawdata[i : i + 9].lower() == "<![cdata[" and i < self._last_end else ">"
        end = self.rawdata.find(mark, i + 3)
        return end + len(mark) if end >= 0 else -1

    def _close_through(self, tag: str, barriers: set[str]) -> None:
        places = self._at.get(tag)
        if places and places[-1] > max((self._at[b][-1] for b in barriers if self._at.get(b)), default=-1):
            self._close_from(places[-1])

    def _close_from(self, place: int) -> None:
        for number in self._open[place:]:
            self._at[self.tags[number]].pop()
        del self._open[place:]

    # -- what is text

    def _kept(self) -> list[bool]:
        """Whether an element may be text: not boilerplate itself and not within it."""
        n = len(self.tags)
        inside, article, heading = [False] * n, [False] * n, [False] * n
        for i, tag in enumerate(self.tags):
            inside[i] = tag in ("article", "main") or (i > 0 and inside[self.parents[i]])
        mass = self.mass([not d for d in self.dropped])
        wrapped = not any(tag in ("article", "main") and mass[i] for i, tag in enumerate(self.tags))
        for i in range(n - 1, 0, -1):
            if self.dropped[i]:
                continue
            article[i] |= self.tags[i] in ("article", "main")
            heading[i] |= self.tags[i] == "h1"
            named = self.named[i] and not article[i] and not (wrapped and mass[i] > WRAPPER_SHARE * mass[0])
            if named or (self.headers[i] and not article[i] and not (heading[i] and inside[i])):
                self.dropped[i] = True
            else:
                article[self.parents[i]] |= article[i]
                heading[self.parents[i]] |= heading[i]
        kept = [True] * n
        for i in range(1, n):
            kept[i] = kept[self.parents[i]] and not self.dropped[i]
        return kept

    def mass(self, kept: list[bool]) -> list[int]:
        """The characters of text that each kept element holds, white space aside."""
        out = [own if k else 0 for own, k in zip(self._own, kept, strict=True)]
        for i in range(len(self.tags) - 1, 0, -1):
            if kept[i]:
                out[self.parents[i]] += out[i]
        return out

    def roots(self) -> list[int]:
        """The elements that are the article, in page order and none within another.

        The outermost articles, if they hold half of the text of the page or, if it has one, of its main; with them goes what
        stands directly in main as text of its own. Otherwise articles are teasers: main, if it holds half of the page's text,
        else the page.
        """
        mass, n = self.mass(self.kept), len(self.tags)

        def outermost(wanted: str) -> list[int]:
            within, found = [False] * n, []
            for i, tag in enumerate(self.tags):
                within[i] = i > 0 and within[self.parents[i]]
                if tag == wanted and mass[i] and not within[i]:
                    within[i] = True
                    found.append(i)
            return found

        articles, mains = outermost("article"), outermost("main")
        scope = sum(mass[i] for i in mains) or mass[0]
        if articles and 2 * sum(mass[i] for i in articles) >= scope:
            beside = [i for i in range(n) if self.parents[i] in mains and self.tags[i] in FLOW and mass[i]]
            return articles if self._within(mains, articles) else sorted({*articles, *beside})
        return mains if mains and 2 * scope >= mass[0] else [0]

    def _within(self, inner: list[int], outer: list[int]) -> bool:
        """Whether any of some elements lies within another of some."""
        held, within = set(outer), [False] * len(self.tags)
        for i in range(len(self.tags)):
            within[i] = i in held or (i > 0 and within[self.parents[i]])
        return any(within[i] and i not in held for i in inner)

    def digests(self, roots: list[int]) -> list[int]:
        """Each element's subtree hash, 0 if it has no text; only those within the roots."""
        n = len(self.tags)
        within, out = [False] * n, [0] * n
        for i in roots:
            within[i] = True
        for i in range(1, n):
            within[i] = (within[i] or within[self.parents[i]]) and self.kept[i]
        for i in range(n - 1, -1, -1):
            if not within[i]:
                continue
            state, text = xxhash.xxh64(self.tags[i].encode()), False
            for part in self.parts[i]:
                if isinstance(part, str):
                    words = _SPACE.sub(" ", part).strip()
                    if words:
                        text = True
                        state.update(b"\x01" + words.encode("utf-8", "replace"))
                elif out[part]:
                    text = True
                    state.update(b"\x02" + out[part].to_bytes(8, "big", signed=True))
            if text:
                out[i] = int.from_bytes(state.digest(), "big", signed=True)
        return out

    def blocks(self, roots: list[int], digests: list[int] | None = None, template: set[int] = frozenset()) -> list[str]:
        """The text blocks of the roots in page order, without template subtrees."""
        out: list[str] = []
        run: list[str] = []

        def flush() -> None:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                out.append(text)
            run.clear()

        for root in roots:
            flush()
            path = [(root, iter(self.parts[root]))]
            while path:
                element, rest = path[-1]
                for part in rest:
                    if isinstance(part, str):
                        run.append(part)
                    elif self.kept[part] and not (template and digests[part] in template):
                        if self.tags[part] in BLOCK:
                            flush()
                        path.append((part, iter(self.parts[part])))
                        break
                else:
                    path.pop()
                    if self.tags[element] in BLOCK:
                        flush()
            flush()
        return out


def _ended(html: str) -> str:
    """A page without the tag or comment that its end cuts off: neither is text, and neither is looked for again and again."""
    html = html.replace("<!-->", "").replace("<!--->", "")  # comments that end where they begin
    start = _COMMENT.search(html, html.rfind("-->") + 1)
    if start:
        low = html[: start.start()].lower()
        if not any(low.rfind(f"<{tag}") > low.rfind(f"</{tag}") for tag in _RAW):
            html = html[: start.start()]
    open_ = _TAG.search(html, html.rfind(">") + 1)
    return html[: open_.start()] if open_ else html


def _shortened(html: str) -> str:
    """Character references of over eight digits, which no character has, cut; leading zeros of long ones go."""
    if not _LONG_NUMBER.search(html):
        return html
    return re.sub(r"&#(\d{8})\d+", r"&#\1", re.sub(r"&#0+(?=\d)", "&#", html))


def _names_boilerplate(token: str) -> bool:
    words = {w.lower() for w in _NAME.findall(token)}
    return bool(words & NOT_TEXT_NAMES) and words <= NOT_TEXT_NAMES | PART_WORDS


def _names_comments(token: str) -> bool:
    words = {w.lower() for w in _NAME.findall(token)}
    return bool(words & COMMENT_NAMES) and words <= COMMENT_NAMES | NOT_TEXT_NAMES | PART_WORDS


def _verdict(tag: str, attrs: dict[str, str | None]) -> tuple[bool, bool, bool]:
    """Whether an element is boilerplate, whether its names say so, and whether it is a header."""
    tokens = [*(attrs.get("class") or "").split(), *(attrs.get("id") or "").split()]
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
    comment = tag != "main" and any(map(_names_comments, tokens))
    named = tag not in ("article", "main") and any(map(_names_boilerplate, tokens))
    dropped = tag in NOT_TEXT or hidden or comment or (attrs.get("role") or "").lower() in NOT_TEXT_ROLES
    return dropped, named, tag == "header" or any(t.lower() in ("header", "page-header", "site-header") for t in tokens)


def host(url: str = "url") -> Column:
    """The host of a URL in lower case; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.col(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


def template_subtrees(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree): hashes of the element subtrees that recur over a host's pages. pages: host, html."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, contents, subtrees = [], [], []
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(html.as_py())
                roots = page.roots()
                digests = page.digests(roots)
                tops = [digests[r] for r in roots]
                content = xxhash.xxh64_intdigest(repr(tops)) >> 1
                own = {d for d, tag in zip(digests, page.tags, strict=True) if d and tag in BLOCK}
                found = [*own.difference(tops), 0]  # 0 stands for the page
                hosts += [name] * len(found)
                contents += [content] * len(found)
                subtrees += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(subtrees, pa.int64())], ["host", "content", "subtree"])

    rows = pages.select("host", "html").mapInArrow(hashed, "host string, content long, subtree long")
    counts = stored(rows.groupBy("host", "subtree").agg(F.countDistinct("content").alias("n")).where(f"n >= {min_pages} or subtree = 0"))
    totals = counts.where("subtree = 0").select(F.col("host").alias("of"), F.col("n").alias("total"))
    return counts.where("subtree <> 0").join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("total")).select("host", "subtree")


def extract_text(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The main text of each page.

    Returns page_id, url, text (blocks joined by line feeds), n_chars (code points), a row per input row. A null or empty
    page has an empty text; a null url, or one without a host, belongs to a host of its own. Malformed markup is parsed
    leniently, a tag or comment that the page's end cuts off is no text, and pages of any length and nesting are read whole.
    Repeated rows stay; a page whose article or main elements hold less than half of its text gives what is left of its body. An empty table gives an empty result; other columns are ignored.
    """
    rows = bounded_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", host().alias("host"), "html")
    template = stored(template_subtrees(rows, ratio, min_pages))
    known = template.groupBy(F.col("host").alias("of")).agg(F.collect_list("subtree").alias("template"))
    if template.count() <= BROADCAST_SUBTREES:
        known = F.broadcast(known)
    met = rows.join(known, F.col("host").eqNullSafe(F.col("of")), "left").select("page_id", "url", "html", "template")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for html, known in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                page = Page(html.as_py())
                roots = page.roots()
                out.append("\n".join(page.blocks(roots, page.digests(roots), set(known)) if known else page.blocks(roots)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return met.mapInArrow(texts, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
