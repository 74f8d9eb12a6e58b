"""Main text of web pages by site template removal.

Every element outside a page's article is hashed with all that is below it, twice: as it is, and as a skeleton of tags,
class, id and role (digits masked), kinds of text and children, runs of alike children counted once. Spark counts on how
many different pages of a host each hash occurs; elements whose hash recurs on many pages of their host are the site's
template and are deleted with all they hold. A host of few pages has no template of its own: there, what recurs over the
pages of all hosts is deleted.

A skeleton says little about prose, so it speaks only against what surely isn't the article: elements beside the one that
the page marks as such (``article``, ``main``, role main), and elements that are mostly links where nothing is marked.
Elements whose name says what they are (menus, footers, adverts, comments) need to recur less, also inside the article,
and are counted by that name. Scripts, styles, forms and hidden elements are no text in HTML itself.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardflow.llm import textkernel as tk
from boardflow.plans.staging import staged

#: An element that occurs on so many different pages of its host, and on this share of them, is part of the template.
#: Elements that go by a name need two fifths of the pages, and no share.
MIN_PAGES = 5
MIN_SHARE = 0.05
#: Hosts with this share of all pages are few; their templates go to every task instead of their pages to one.
HOT = 256

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|([^\s=/"'>]+)""")
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an open p can't hold.
ENDS_P = BLOCK - frozenset("body html option tbody td tfoot th thead tr".split())
SAME_ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol menu dir dl table article section div body html".split())
#: Elements that hold no text of the page: code, controls, the head.
NO_TEXT = frozenset("form button select script style noscript template iframe svg dialog textarea title head xmp noembed noframes".split())
# Names that say what an element is: it is deleted where it recurs.
NAMED_TAGS = frozenset("nav aside footer menu".split())
NAMED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion sidebar menu menubar nav navbar navigation breadcrumb "
    "breadcrumbs cookie cookies consent gdpr notice newsletter subscribe subscription popup modal overlay comment comments disqus reply replies share sharing social "
    "related recommended footer login signup skip toolbar pagination pager".split()
)
#: Outside the article only: inside it, its own header has the headline.
NAMED_OUTSIDE = frozenset("header masthead banner topbar".split())
_TEXT, _LINK = 1, 2


@dataclass(slots=True)
class _Open:
    tag: str
    name: str
    main: bool
    block: bool
    link: bool
    look: str
    holds_main: bool = False
    words: int = 0
    linked: int = 0
    hashes: list[int] = field(default_factory=list)
    below: list[int] = field(default_factory=list)
    digest: xxhash.xxh64 = field(default_factory=xxhash.xxh64)

    def saw(self, what: int) -> None:
        if not self.below or self.below[-1] != what:
            self.below.append(what)


@dataclass(slots=True)
class Page:
    """Blocks in order, as text and the elements around; and whether the page marks its article."""

    blocks: list[tuple[str, tuple[_Open, ...]]] = field(default_factory=list)
    marked: bool = False

    def rows(self) -> list[tuple[str, list[int]]]:
        """(text, hashes of the elements around by which it may go) of every block."""
        return [(text, [h for o in around for h in o.hashes]) for text, around in self.blocks]


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for m in ATTR.finditer(text):
        if m[1]:
            v = m[2]
            out.setdefault(m[1].lower(), entities.unescape(v[1:-1] if v[0] in "\"'" else v))
        else:
            out.setdefault(m[3].lower(), "")
    return out


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I))


def _name(tag: str, attrs: dict[str, str], inside: bool) -> str:
    """The name that says what an element is, or nothing."""
    if tag in NAMED_TAGS or (not inside and tag in NAMED_OUTSIDE):
        return tag
    if not attrs:
        return ""
    if (role := attrs.get("role", "").lower()) in NAMED_ROLES:
        return role
    if tag in ("html", "body", "main") and not inside:
        return ""
    names = set(WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    if tag == "article" and not inside:
        names = set(WORD.findall(attrs.get("class", "").lower())) & {"comment", "comments", "reply", "ad", "advert", "related", "promo"}
    return min(names & (NAMES if inside else NAMES | NAMED_OUTSIDE), default="")


def _hash(*parts: str | list[int]) -> int:
    """Negative; what goes by name has a number from 0 on."""
    return (xxhash.xxh64(repr(parts)).intdigest() >> 1) - (1 << 63)


def parse(text: str, by_name: bool = True) -> Page:
    """Blocks of a page, with markup that isn't closed, or cut off, read as far as it goes."""
    page, stack, words, at = Page(), [_Open("", "", False, True, False, "")], [], 0
    closed: list[_Open] = []

    def flush() -> None:
        if words:
            line = " ".join("".join(words).split())
            words.clear()
            if line:
                top = stack[-1]
                page.marked |= top.main
                page.blocks.append((line, tuple(o for o in stack[1:] if o.block or o.name)))
                data, n = line.encode("utf-8", "surrogatepass"), line.count(" ") + 1
                for o in stack:
                    if not o.main:
                        o.digest.update(data + b"\n")
                    o.words += n

    def close() -> None:
        o = stack[-1]
        if o.block:
            flush()
        stack.pop()
        up = stack[-1]
        up.linked += o.linked
        if o.block:
            up.saw(_hash(o.tag, o.look, o.below))
            closed.append(o)
        elif o.name:
            closed.append(o)
        up.digest.update(b"/" + o.tag.encode())

    def close_to(names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in stop:
                return

    def heard(got: str) -> None:
        words.append(got)
        if not got.isspace():
            top = stack[-1]
            if top.link:
                top.linked += len(got.split())
            for o in reversed(stack):
                if o.block:
                    o.saw(_LINK if top.link else _TEXT)
                    break

    end, skipped = len(text), 0  # depth in an element without text
    while at < end:
        m = TOKEN.search(text, at)
        got = text[at : m.start() if m else end]
        if got and not skipped:
            heard(entities.unescape(got) if "&" in got else got)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not skipped:
                heard(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            close_to({tag}, frozenset() if tag in BLOCK else HOLDS | frozenset({"p", "li", "td"}))
            skipped = sum(o.look == "-" for o in stack)
            continue
        if tag in BLOCK or tag == "hr":
            flush()
            if tag in ENDS_P:
                close_to({"p"}, HOLDS | frozenset({"li", "td", "th", "dd"}))
            if tag in SAME_ENDS:
                close_to(SAME_ENDS[tag], HOLDS)
            if tag == "body":
                close_to({"head"}, frozenset())
            skipped = sum(o.look == "-" for o in stack) if skipped else 0
        if tag in VOID:
            if tag == "br":
                words.append(" ")
            continue
        attrs = _attributes(m[3]) if m[3].strip(" \t\r\n/") else {}
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
            at = m.end() if m else end
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        top = stack[-1]
        name = _name(tag, attrs, top.main) if by_name else ""
        main = not name and (top.main or tag in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "").lower() == "articlebody")
        if main and not top.main:
            for o in stack:
                o.holds_main = True
        silent = tag in NO_TEXT or (bool(attrs) and _hidden(attrs))
        look = "-" if silent else DIGITS.sub("0", f"{attrs.get('class', '')}|{attrs.get('id', '')}|{attrs.get('role', '')}") if attrs else ""
        if silent:
            flush()
            skipped += 1
        stack.append(_Open(tag, name, main, tag in BLOCK, top.link or tag == "a", look))
    flush()
    while len(stack) > 1:
        close()
    for o in closed:
        if o.name:
            o.hashes.append(xxhash.xxh64(f"{o.tag} {o.name}").intdigest() >> 1)
        if o.block and not (o.main or o.holds_main or o.tag in ("html", "body")):
            o.hashes.append(_hash("as it is", f"{o.digest.intdigest()} {o.words}"))
            if page.marked or 2 * o.linked >= o.words > 0:
                o.hashes.append(_hash("skeleton", o.tag, o.look, o.below))
    return page


def _parsed(by_name: bool):
    """Blocks of every page, with the hashes by which each may go."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("around", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "html", 1 << 20):
            found = [[{"text": t, "around": a} for t, a in parse(text or "", by_name).rows()] for text in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host", "content")), pa.array(found, kind)], ["page_id", "url", "host", "content", "blocks"])

    return run


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", by_name: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Blocks are joined by an empty line, in page order; white space inside a block is one space, character references
    are decoded. n_chars counts code points. A null or empty page, or one without main text, has an empty text and
    stays. Pages without a url share the host "". Copies of a page count once, so that they are no template. Hosts
    of fewer than ``min_pages`` different pages lose what recurs as often, and in this share, over all pages. Without
    ``by_name`` no element is known by its name. Very long pages are read whole, as text in any element but a script
    or the like. Repeated rows come back as often. Other columns are not looked at. An empty table gives no rows.
    """
    tk.for_long_rows(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"://([^/?#]*)", 1), F.lit("")))
    html = F.col(html_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.unhex(F.md5(F.coalesce(html, F.lit("")))).alias("content"), html.alias("html"))
    schema = rows.drop("html").selectExpr("*", "array(named_struct('text', '', 'around', array(0L))) AS blocks").schema
    parsed = staged(rows.mapInArrow(tk.lean(_parsed(by_name)), schema), "parsed")
    # different pages first, so that the count of a hot host's element is a sum of partial counts
    seen = parsed.select("host", "content", F.explode(F.array_distinct(F.flatten("blocks.around"))).alias("element")).distinct()
    on = staged(seen.groupBy("host", "element").agg(F.count("*").alias("on")), "elements")
    of = staged(parsed.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("of")), "hosts")

    def recurs(total: Column) -> Column:
        by_hash = (F.col("on") >= min_pages) & (F.col("on") >= min_share * total)
        return F.when(F.col("element") >= 0, F.col("on") >= max(2, 2 * min_pages // 5)).otherwise(by_hash)

    # a page has few elements, and a template is on a share of the pages: a host's templates number a page's elements / min_share
    own = on.join(of, "host").where(recurs(F.col("of"))).groupBy("host").agg(F.collect_list("element").alias("gone"))
    every = of.agg(F.coalesce(F.sum("of"), F.lit(0)).alias("all"), F.count("*").alias("hosts")).first()
    common = on.groupBy("element").agg(F.sum("on").alias("on")).where(recurs(F.lit(every["all"]))).select("element").collect()
    common = F.expr(f"cast(array({', '.join(f'{r[0]}L' for r in common)}) as array<bigint>)")
    none = F.array().cast("array<long>")
    few = F.col("of") < min_pages
    lists = staged(of.join(own, "host", "left").select("host", "of", F.when(few, F.concat(F.coalesce("gone", none), common)).otherwise(F.coalesce("gone", none)).alias("gone")), "templates")
    hot = F.broadcast(lists.where(F.col("of") * HOT >= every["all"]).select("host", "gone"))  # at most HOT hosts
    cold = lists.where(F.col("of") * HOT < every["all"]).select("host", "gone")
    both = parsed.join(hot, "host").unionByName(parsed.join(F.broadcast(lists.where(F.col("of") * HOT >= every["all"]).select("host")), "host", "left_anti").join(cold, "host"))
    left = F.filter("blocks", lambda b: ~F.arrays_overlap(b["around"], F.col("gone")))
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n\n")
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
