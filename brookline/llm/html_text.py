"""Main text of web pages as the maximum-scoring subsequence of their words and tags.

A page is a line of words and tags. Words score +1, tags score below zero, each tag name by how much commoner it is outside
of content than in it. One linear scan finds the contiguous stretch with the highest sum: that is the content
region. Its blocks are read out, without elements that are boilerplate by name or by a whole token of class, id or role
(menus, forms, adverts, reader comments and the like); such an element costs the scan BOILERPLATE
once (nothing within an article or main), and its words count for nothing. But an element that holds most of the words of
its page, or of its article or main, is read like any other, however it is named: see `held`.

Weights come from labelled pages: pages with exactly one <article> (else one <main>) say themselves what is content.
At most MAX_LABELLED of them are read for fitting, those with the lowest hash of their html; without any, every tag
has the weight LEAST. Extraction itself reads every page, whole.

Defined cases: a null, empty or tagless-and-wordless page has the empty text; a page without tags is one block; a tag,
comment or script that is never closed ends with the page; elements end where HTML lets their end tag be left out (p by the
next block, li, dt, dd, tr, td, option by their sibling) and with any element around them; an unclosed boilerplate element also
ends where an article or main begins; of regions with equal sums the one that ends first is taken; repeated rows get equal texts; an empty
table gives an empty result; other columns travel in a struct.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.llm.shared import LONG, STRING, col, packed, stage
from brookline.session import spread

MAX_LABELLED = 2_000
LEAST, SCALE, BOILERPLATE = -0.25, 2.0, -3.0
#: However rare a tag is in labelled content, it costs no more than this: other pages may use it there.
MOST, MOST_INLINE = -6.0, -1.0

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table caption tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head title nav footer aside form button select textarea iframe object svg canvas noscript template dialog menu audio video map datalist fieldset".split())
#: Words of class, id and role that name boilerplate.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side footer cookie cookies consent notice notices alert gdpr comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager toolbar tagcloud search complementary contentinfo masthead".split())
OUTER_HINTS = frozenset(["header", "topbar"])
#: Words that make no other name of a hint beside it: share-buttons and page-nav are hints, has-sidebar and page-with-nav are not.
PARTS = frozenset("area article bar block blog body bottom box btn button buttons card center col column container content count entry feed form global group header holder icon icons inner item items label left link links list lists main message module notification outer page panel placeholder post posts primary right row secondary section site slot sticky story text title top unit view wrap wrapper zone".split())
#: A token of such words alone names content, whatever stands beside it.
CONTENT = frozenset("article body content entry hentry main page post story text".split())
#: Elements that hold no text to read, however much there is of it.
NEVER = frozenset("head title button select textarea iframe object svg canvas noscript template audio video map datalist".split())
#: How many times the words beside it an element must hold to be read in spite of its name, or as a wrapper.
NAMED, WRAPPER = 4, 2

CELLS = frozenset("td th caption object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROWS = frozenset("caption colgroup tbody td tfoot th thead tr".split())
IN_HEAD = frozenset("base basefont bgsound head link meta".split())
#: Elements whose end tag may be left out: start tag -> (what it ends, what they do not reach beyond).
SIBLINGS = {
    "li": (frozenset(["li"]), CELLS | frozenset("ul ol menu dir table".split())),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), CELLS | frozenset(["dl", "table"]))),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"]))),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    **dict.fromkeys(["tbody", "thead", "tfoot"], (ROWS, frozenset(["table"]))),
    **{n: (frozenset([n]), CELLS | frozenset(["table"])) for n in ("a", "button")},
}
HEAD, P, AROUND_P = frozenset(["head"]), frozenset(["p"]), CELLS | frozenset(["table", "button"])
ENDS_P = BLOCKS - ROWS - frozenset("body html option".split())
#: End tags that end whatever is open in their element; others do not reach out of a table's cell.
STRONG = frozenset("article main section body html table".split())
#: An end is looked for among so many open elements (browsers nest no deeper).
DEEPEST = 512

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S | re.I)
_attribute = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_none = re.compile(r"display\s*:\s*none", re.I)
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_value = re.compile(r"""=\s*[^\s"'>]+$""")


def pieces(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(kind, name or text, closing, attributes): kind is `text`, `tag` or `raw` (a comment, a script, ...)."""
    at = 0
    for m in _tag.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], False, ""
        name = m[3] or m[6]
        if name:
            yield "tag", name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        else:
            yield "raw", (m[1] or "").lower(), False, ""
        at = m.end()
    if at < len(page):
        yield "text", page[at:], False, ""


def needed(name: str, attributes: str, inside: bool) -> float:
    """0 for an element that is no boilerplate by its name and attributes, else how many times the words beside it it must hold to be read.
    inside: in an article or main, where a header belongs to the text."""
    if name in NEVER:
        return math.inf
    least = (WRAPPER if name in ("form", "fieldset") else NAMED) if name in SKIPPED or name == "header" and not inside else 0
    if name in ("body", "html", "article", "main") or not attributes:
        return least
    given: dict[str, str] = {}
    for m in _attribute.finditer(attributes):
        given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or _none.search(given.get("style", "")):
        return max(least, NAMED)
    content = False
    for token in " ".join(given.get(a, "") for a in ("class", "id", "role")).split():
        words = {w.lower() for w in _words.findall(token) if len(w) > 1}
        content |= bool(words) and words <= CONTENT
        hints = words & HINTS if inside else words & HINTS | words & OUTER_HINTS
        if hints and words - hints <= PARTS:
            least = max(least, NAMED)
    return min(least, WRAPPER) if content else least


class Opened:
    """The elements that are open, each as a list of its name (and what is added to it). Tags give the elements that they end, by HTML's rules for end tags that are left out."""

    def __init__(self) -> None:
        self.elements: list[list] = []
        self.count: Counter = Counter()

    def _close(self, i: int) -> list[list]:
        """Ends element i with all that is open in it; an inline element ends alone if a block is open in it."""
        alone = i + 1 < len(self.elements) and self.elements[i][0] not in BLOCKS and any(e[0] in BLOCKS for e in self.elements[i + 1 :])
        last = i + 1 if alone else len(self.elements)
        gone = self.elements[i:last]
        del self.elements[i:last]
        for e in gone:
            self.count[e[0]] -= 1
        return gone

    def _end(self, names: frozenset[str], barrier: frozenset[str], outermost: bool = False) -> list[list]:
        found = None
        for i in range(len(self.elements) - 1, max(-1, len(self.elements) - 1 - DEEPEST), -1):
            name = self.elements[i][0]
            if name in names:
                found = i
                if not outermost:
                    break
            elif name in barrier:
                break
        return [] if found is None else self._close(found)

    def implied(self, what: str) -> list[list]:
        """What a start tag ends."""
        gone = self._end(HEAD, frozenset()) if self.count["head"] and what not in IN_HEAD else []
        if self.count["p"] and what in ENDS_P:
            gone += self._end(P, AROUND_P)
        if what in SIBLINGS and any(self.count[n] for n in SIBLINGS[what][0]):
            gone += self._end(*SIBLINGS[what], outermost=True)
        if what in HEADINGS and self.elements and self.elements[-1][0] in HEADINGS:
            gone += self._close(len(self.elements) - 1)
        return gone

    def start(self, what: str) -> list:
        element = [what]
        if what != "form" or not self.count["form"]:  # forms do not nest
            self.elements.append(element)
            self.count[what] += 1
        return element

    def end(self, what: str) -> list[list]:
        """What an end tag ends."""
        if what in ("body", "html"):
            gone, self.elements = self.elements, []
            self.count.clear()
            return gone
        if not self.count[what] and what not in HEADINGS:
            return []
        barrier = frozenset() if what in STRONG else frozenset(["table"]) if what in ROWS else CELLS
        return self._end(HEADINGS if what in HEADINGS else frozenset([what]), barrier)


def empty(what: str, attributes: str) -> bool:
    """Whether a start tag opens nothing; a slash that ends an unquoted value does not say so."""
    return what in VOID or attributes.rstrip().endswith("/") and not _value.search(attributes)


class Held:
    """A page, an article or main, or a boilerplate element: where it is in the page's items, and its words outside of links."""

    def __init__(self, name: str = "", start: int = 0, least: float = 0, inside: bool = False):
        self.name, self.start, self.least, self.inside = name, start, least, inside
        self.end, self.whole = start, True  # whole: not ended by an article or main that opens
        self.plain, self.total, self.inner = 0, 0, []

    def words(self) -> int:
        return 0 if self.least == math.inf else self.total

    def sum_up(self) -> None:
        self.total = self.plain + sum(e.words() for e in self.inner)


def held(page: str) -> tuple[list[tuple[str, str, int]], list[Held]]:
    """(all items of the page, the elements to cut). A boilerplate element is cut unless it holds most of the words of what it
    is in (the page, the article or main, or a boilerplate element that is itself read) and `least` times those that are in
    none. Outside of articles and mains with words, all are cut. Words of links do not count."""
    items: list[tuple[str, str, int]] = []
    opened, inside = Opened(), 0
    outer, now = Held(), None  # the page, and the outermost article or main that is open
    scopes, found = [outer], []
    open_: list[Held] = []  # boilerplate elements that are open, outermost first
    for kind, what, closing, attributes in pieces(page):
        if kind == "text":
            if what.strip():
                if opened.count["head"]:
                    _ended(open_, opened.implied("body"), len(items))
                if not opened.count["a"]:
                    (open_[-1] if open_ else now or outer).plain += len(what.split())
            items.append(("text", what, len(what.split())))
        elif kind == "tag":
            if not closing and what in ("article", "main"):
                for e in open_:  # it was never closed
                    e.end, e.whole = len(items), False
                open_.clear()
            gone = opened.end(what) if closing else opened.implied(what)
            own = _ended(open_, gone, len(items), what if closing else "", what not in ("body", "html"))
            element = None if closing or empty(what, attributes) else opened.start(what)
            if what in ("article", "main"):
                inside = max(0, inside + (-1 if closing else 1))
                if not inside:
                    now = None
                elif now is None:
                    now = Held(what, inside=True)
                    scopes.append(now)
            least = needed(what, attributes, inside > 0) if element else 0
            if least:
                e = Held(what, len(items), least, inside > 0)
                (open_[-1] if open_ else now or outer).inner.append(e)
                open_.append(e)
                element.append(e)
                found.append(e)
            items.append(("tag", what, 0))
            if own:
                own.end = len(items)
    for e in open_:
        e.end, e.whole = len(items), False
    for e in [*reversed(found), *scopes]:
        e.sum_up()
    cut, marked = [], False
    for first in (scopes[1:], [outer]):
        todo = list(first)
        for s in todo:
            for e in s.inner:
                if e.words() * 2 > s.total and e.words() > e.least * s.plain and not (s is outer and marked):
                    todo.append(e)
                else:
                    cut.append(e)
        marked = any(s.plain for s in todo)
    return items, sorted(cut, key=lambda e: e.start)


def _ended(open_: list[Held], gone: list[list], at: int, closed: str = "", whole: bool = True) -> Held | None:
    """Ends the boilerplate elements among `gone`; gives the first of these if the end tag is its own."""
    for _, e in reversed([g for g in gone if len(g) > 1] if open_ else []):
        if e in open_[-1:]:
            open_.pop()
        elif e in open_:
            open_.remove(e)
        else:
            continue  # an article or main has ended it
        e.end, e.whole = at, whole
        if closed == e.name and gone[0][-1] is e:
            return e
    return None


def line(page: str) -> Iterator[tuple[str, str, int]]:
    """The page as (kind, what, words): `text`, `tag`, or `cut` for a whole boilerplate element (then: whether it is in an article)."""
    items, cut = held(page)
    at = 0
    for e in cut:
        if e.start < at:
            continue
        yield from items[at : e.start]
        at = e.end
        if e.whole:
            yield "cut", e.name, int(e.inside)
    yield from items[at:]


def region(items: list[tuple[str, str, int]], weights: dict[str, float]) -> tuple[int, int]:
    """The stretch of items with the highest sum of scores, by one scan."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, what, words) in enumerate(items):
        total += words if kind == "text" else BOILERPLATE * (1 - words) if kind == "cut" else weights.get(what, LEAST)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Main text of one page: its blocks, in page order."""
    items = list(line(page or ""))
    start, end = region(items, weights)
    blocks, now = [], []
    for kind, what, _ in items[start:end]:
        if kind == "text":
            now.append(what)
        elif kind == "cut" or what in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif what == "br":
            now.append(" ")
    blocks.append("".join(now))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def densities(page: str) -> Counter:
    """Counts of tags and words, inside and outside of the one article (else main) of a labelled page; none for others.
    Boilerplate elements that are cut are not counted: the scan never sees their tags."""
    items = list(line(page))
    seen = Counter(what for kind, what, _ in items if kind == "tag")
    mark = next((m for m in ("article", "main") if seen[m]), None)
    out: Counter = Counter()
    if mark is None or seen[mark] > 2:  # its start and its end
        return out
    inside = False
    for kind, what, words in items:
        if kind == "tag" and what == mark:
            inside = not inside
        elif kind == "tag":
            out[inside, what] += 1
        elif kind == "text":
            out[inside, ""] += words
    return out


def learned(pages: DataFrame, body: str = "html") -> dict[str, float]:
    """Weight of each tag name: SCALE times the logarithm of how much commoner it is in content than elsewhere, from MOST to LEAST."""
    text = F.coalesce(col(body), F.lit(""))
    marked = pages.select(text.alias("page"), F.xxhash64(text).alias("h")).where(F.lower("page").rlike("<(article|main)[\\s>]"))
    # the lowest hashes are found among hashes alone; equal pages have one, and count once
    bound = marked.select("h").distinct().orderBy("h").limit(MAX_LABELLED).agg(F.max("h")).first()[0]
    sample = stage(marked.where(F.col("h") <= (bound if bound is not None else 0)).dropDuplicates(["h"]).select("page"), "html-labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column("page").to_pylist():
                total.update(densities(page))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["inside", "name", "n"])

    summed = sample.mapInArrow(run, "inside boolean, name string, n long").groupBy("name").agg(*[F.coalesce(F.sum(F.when(F.col("inside") == x, F.col("n"))), F.lit(0)).alias(a) for a, x in (("content", True), ("rest", False))])
    rows = {r["name"]: (r["content"], r["rest"]) for r in summed.collect()}  # the tag names of at most MAX_LABELLED pages
    rows.pop("", None)
    odds = {name: SCALE * (math.log(a + 1) - math.log(b + 1)) for name, (a, b) in rows.items()}
    return {name: min(LEAST, max(MOST if name in BLOCKS else MOST_INLINE, x)) for name, x in odds.items()}


def main_text(pages: DataFrame, weights: dict[str, float], body: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) in a struct `row`, with text and n_chars."""
    kept = pages.select(*[col(c) for c in carry]) if carry else pages
    given = pages.select(packed(kept), col(body).alias("_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), weights) for p in batch.column("_page")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    return given.mapInArrow(run, T.StructType([T.StructField("row", given.schema["row"].dataType), T.StructField("text", STRING), T.StructField("n_chars", LONG)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    out = main_text(pages, learned(pages), carry=["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", "n_chars")
