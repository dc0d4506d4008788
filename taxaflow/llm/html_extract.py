"""Main text of web pages by site template removal.

Pass one parses each page into elements and hashes its subtrees, whatever their tag or class, inside its articles too;
Spark counts on how many pages of a host each hash occurs. Pass two deletes the subtrees that recur on many pages of
their host. What a single page shows of menus, comments or notices does not recur: of what is left, a tag, role or class
that says so deletes a subtree too. Articles are chosen from the rest, and their blocks joined. n_recurring and n_marked
tell how many subtrees of a page the counts deleted, and how many the tags and classes alone.

A paragraph of prose inside an article is text although it recurs if articles of another host have it too, or if most
of the prose of its page recurs: the page is then a copy of others. A notice that stands as a single paragraph in
articles of several hosts therefore stays; in an element of its own (div, section, list) it goes.

Null html counts as empty: empty text. A null or odd url: the page has host '' and shares templates with other such
pages. Pages whose articles are the same count as one; unclosed and stray tags are closed as browsers do, roughly.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bound_batches

#: A subtree is part of a host's template if it occurs on this many of its pages, and on one more each time the host
#: doubles beyond so many pages: 18 on a host of a million.
LEAST_PAGES, FREE_PAGES = 5, 100
#: Rows of the table of template hashes (one for each host) up to which it may be broadcast, and hashes of one host up
#: to which each of its pages gets them all; beyond it each page gets those that it has.
BROADCAST_HOSTS, BROADCAST_HASHES, HOST_HASHES = 50_000, 500_000, 1000
# Fixed values of HTML: elements without content, elements whose content is no markup, and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold prose, and what turns their hash inside an article into another one: they are counted apart.
PROSE = frozenset("blockquote dd dl dt figcaption h1 h2 h3 h4 h5 h6 li ol p pre table tbody td tfoot th thead tr ul".split())
IN_ARTICLE = 0x5DEECE66D1CE4E5B
#: Elements that are never main text.
NEVER = frozenset("script style head title noscript template iframe nav footer aside form button select textarea input option svg canvas object menu dialog".split())
#: Roles and words of classes and ids that mark what is no main text.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|comment-list|disqus|replies|respond|widget|toolbar|pagination|pager|skip|hidden)(?:$|[\s_-])",
    re.I,
)
#: Where an open element of the first kind is closed by the start of one of the second.
CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
SCOPE = frozenset("ul ol dl table div article section main nav aside header footer body form select td th blockquote".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
BLANK = re.compile(r"\s+")


class Element:
    """An element: its children are elements and strings."""

    __slots__ = ("tag", "attributes", "children", "hash", "text_size", "link_size")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.hash = self.text_size = self.link_size = 0


def parse(page: str) -> Element:
    root = Element("html", {})
    open_: list[Element] = [root]
    at = 0
    while match := TOKEN.search(page, at):
        if match.start() > at:
            open_[-1].children.append(page[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
            continue
        if tag in ("html", "body") and any(e.tag == tag for e in open_[1:]):
            continue
        for k in range(len(open_) - 1, 0, -1):
            if tag in CLOSES.get(open_[k].tag, ()):
                del open_[k:]
                break
            if open_[k].tag in SCOPE:
                break
        attributes = {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(match[3])} if match[3].strip(" /") else {}
        element = Element(tag, attributes)
        open_[-1].children.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            element.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        if not match[3].endswith("/") or tag in BLOCK:
            open_.append(element)
    if at < len(page):
        open_[-1].children.append(page[at:])
    return root


def measure(element: Element) -> None:
    """Hashes of subtrees (tags, classes and text), and how much of their text is links. Not recursive: pages may be deep."""
    stack, order = [element], []
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in e.children if not isinstance(c, str)]
    for e in reversed(order):
        parts = [e.tag, e.attributes.get("class", "")]
        for c in e.children:
            if isinstance(c, str):
                text = BLANK.sub(" ", c).strip()
                parts.append(text)
                e.text_size += len(text)
            else:
                parts.append(str(c.hash))
                e.text_size += c.text_size
                e.link_size += c.link_size
        if e.tag == "a":
            e.link_size = e.text_size
        e.hash = xxhash.xxh3_64_intdigest("\x00".join(parts)) - (1 << 63)


def is_marked(e: Element, in_article: bool) -> bool:
    a = e.attributes
    if e.tag in NEVER or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    if e.tag == "header":
        return not in_article
    if e.tag in ("html", "body", "article", "main", "h1"):
        return e.tag == "article" and bool(MARKED.search(a.get("class", "") + " " + a.get("id", ""))) and in_article
    return bool(a) and (bool(MARKED.search(a.get("class", "") + " " + a.get("id", ""))) or "display:none" in a.get("style", "").replace(" ", ""))


def key_of(e: Element, inside: bool) -> int | None:
    """What a block with text is counted under; None for other elements and for those that hold the page's text."""
    if e.tag not in BLOCK or e.tag in ("html", "body", "br", "hr", "article", "main") or not e.text_size:
        return None
    return e.hash ^ IN_ARTICLE if inside and e.tag in PROSE and 2 * e.link_size <= e.text_size else e.hash


def holds_text(e: Element) -> str | None:
    return "article" if e.tag == "article" else "main" if e.tag == "main" or e.attributes.get("role") == "main" else None


def main_elements(root: Element, template: set[int]) -> list[Element]:
    """The elements with text outside the template, in page order and none inside another: `article`s without a marking class, else any `article`s, else `main`s; else the page."""
    found: dict[str, list[Element]] = {"article": [], "marked": [], "main": []}
    stack = [(root, None, False)]
    while stack:
        e, within, inside = stack.pop()
        if key_of(e, inside) in template or is_marked(e, inside):
            continue
        kind = holds_text(e)
        if kind and within not in (kind, "article") and text_left(e, template):
            found["marked" if kind == "article" and is_marked(e, True) else kind].append(e)
            within = kind
        stack += [(c, within, inside or bool(kind)) for c in reversed(e.children) if not isinstance(c, str)]
    return found["article"] or found["marked"] or found["main"] or [root]


def text_left(top: Element, template: set[int]) -> bool:
    stack: list = [top]
    while stack:
        e = stack.pop()
        if isinstance(e, str):
            if e.strip():
                return True
        elif e is top or not (is_marked(e, True) or key_of(e, True) in template):
            stack += e.children
    return False


def template_hashes(page: str) -> tuple[int, list[int], list[int]]:
    """What the page's articles are, and the hashes of the subtrees that could be part of a template: prose of articles, and all others."""
    root = parse(page)
    measure(root)
    prose, other, stack = set(), set(), [(root, False)]
    while stack:
        e, inside = stack.pop()
        if (key := key_of(e, inside)) is not None:
            (other if key == e.hash else prose).add(key)
        inside = inside or bool(holds_text(e))
        stack += [(c, inside) for c in e.children if not isinstance(c, str)]
    articles = "\x00".join(str(e.hash) for e in main_elements(root, set()))
    return xxhash.xxh3_64_intdigest(articles) - (1 << 63), sorted(prose), sorted(other)


def without_copied(root: Element, template: set[int]) -> set[int]:
    """The template without the prose of articles, if that is most of the prose that this page's articles have."""
    recurring, size, all_, stack = set(), 0, 0, [(root, False, False, False)]
    while stack:
        e, inside, counted, recurs = stack.pop()
        key = key_of(e, inside)
        if is_marked(e, inside) or key == e.hash and key in template:
            continue
        if key is not None and key != e.hash:
            all_ += 0 if counted else e.text_size
            counted = True
            if key in template:
                recurring.add(key)
                size += 0 if recurs else e.text_size
                recurs = True
        inside = inside or bool(holds_text(e))
        stack += [(c, inside, counted, recurs) for c in e.children if not isinstance(c, str)]
    return template - recurring if 2 * size > all_ else template


def deleted(root: Element, template: set[int]) -> tuple[int, int]:
    """How many subtrees of the page go because they recur, and how many more because of their tag or class."""
    recurring = marked = 0
    stack = [(root, False)]
    while stack:
        e, inside = stack.pop()
        if key_of(e, inside) in template:
            recurring += 1
        elif e.text_size and is_marked(e, inside):
            marked += 1
        else:
            inside = inside or bool(holds_text(e))
            stack += [(c, inside) for c in e.children if not isinstance(c, str)]
    return recurring, marked


def main_text(page: str, template: set[int]) -> tuple[str, int, int]:
    """Blocks of the articles in page order, joined by one newline; what `deleted` counts."""
    root = parse(page)
    measure(root)
    if template:
        template = without_copied(root, template)
    tops = main_elements(root, template)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = BLANK.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            blocks.append(text)

    for top in tops:
        stack: list = [(top, top is not root)]
        while stack:
            e, inside = stack.pop()
            if e is None:
                flush()
            elif isinstance(e, str):
                run.append(e)
            elif e is not top and (is_marked(e, inside) or key_of(e, inside) in template):
                if e.tag in BLOCK:
                    flush()
            else:
                inside = inside or bool(holds_text(e))
                if e.tag in BLOCK:
                    flush()
                    stack.append((None, inside))
                stack += [(c, inside) for c in reversed(e.children)]
        flush()
    return "\n".join(blocks), *deleted(root, template)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id_column, url_column, text, n_chars, n_recurring, n_marked of every page."""
    spark = pages.sparkSession
    bound_batches(spark)
    ws = Workspace(spark, "html")
    rows = pages.select(F.col(id_column), F.col(url_column), host_of(url_column).alias("__host"), F.coalesce(F.col(html_column), F.lit("")).alias("__html"))
    rows = rows.withColumn("__page", F.unhex(F.md5(F.concat_ws("\n", "__host", "__html"))))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [template_hashes(x) for x in batch.column(2).to_pylist()]
            articles, prose, other = ([m[k] for m in made] for k in range(3))
            arrays = [batch.column(0), batch.column(1), pa.array(articles, pa.int64()), pa.array(prose, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "page", "articles", "prose", "other"])

    seen = ws.write(rows.select("__host", "__page", "__html").mapInArrow(hashed, "host string, page binary, articles bigint, prose array<bigint>, other array<bigint>"))
    sizes = seen.select("host", "articles").distinct().groupBy("host").count().withColumnRenamed("count", "pages")

    def often(kind: str) -> DataFrame:
        on = seen.select("host", "articles", F.explode(kind).alias("hash")).distinct().groupBy("host", "hash").count()
        if kind == "prose":
            elsewhere = on.groupBy("hash").agg(F.count("*").alias("hosts"), F.max(F.struct("count", "host")).alias("most"))
            on = elsewhere.where("hosts = 1").select("most.host", "hash", "most.count")
        return on.where(F.col("count") >= LEAST_PAGES)

    keys = often("prose").unionByName(often("other")).join(sizes, "host").where(F.col("count") >= LEAST_PAGES + F.log2(F.greatest(F.col("pages") / FREE_PAGES, F.lit(1.0)))).select("host", "hash")
    keys = ws.write(keys)
    templates = keys.groupBy(F.col("host").alias("__host")).agg(F.collect_list("hash").alias("__template"))
    size = templates.agg(F.count("*"), F.coalesce(F.sum(F.size("__template")), F.lit(0)), F.coalesce(F.max(F.size("__template")), F.lit(0))).first()
    if size[2] <= HOST_HASHES:
        if size[0] <= BROADCAST_HOSTS and size[1] <= BROADCAST_HASHES:
            templates = F.broadcast(templates)
        out = rows.join(templates, "__host", "left")
    else:
        has = seen.select("host", "page", F.explode(F.concat("prose", "other")).alias("hash")).distinct().join(keys, ["host", "hash"])
        out = rows.join(has.groupBy(F.col("page").alias("__page")).agg(F.collect_list("hash").alias("__template")), "__page", "left")
    out = out.select(id_column, url_column, "__html", "__template")
    kinds = [pages.schema[id_column].simpleString().split(":", 1), pages.schema[url_column].simpleString().split(":", 1)]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds) + ", text string, n_chars bigint, n_recurring bigint, n_marked bigint"

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(x, set(t or ())) for x, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            texts, recurring, marked = ([m[k] for m in made] for k in range(3))
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(list(v), pa.int64()) for v in (map(len, texts), recurring, marked))]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_column, url_column, "text", "n_chars", "n_recurring", "n_marked"])

    out = ws.write(out.mapInArrow(extracted, schema))
    ws.drop_all_but(out)
    return out
