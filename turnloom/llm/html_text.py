"""Main text of web pages by deducing each host's template.

Method: a page's elements are tokens, named by their way from the root (tag,
class and id of each element on it, digits levelled); a block of text is a token
too, named by its element and its words. Tokens of one host that occur equally
often on each of its pages (equal occurrence vectors) form an equivalence class.
A class is valid where its elements follow each other in one order on all pages.
Valid classes nest: each part of a class lies in one gap of the class around it.
That is the host's template, and text tokens that share the vector of a valid
class of elements are part of it. What lies between template tokens are slots;
those of the main region are the page's text.

The main region: slots under elements that name themselves boilerplate (menus,
headers, footers, sidebars, notices, adverts, forms, comments, by tag, role,
class or id) are no candidates. Of the others it is the articles, else the main
element, else the element to which one gets from the root by going, while one
child has half of the words that are no links, to that child. A page of which
nothing is left by its host's template is judged by its own elements.

Scale: the first pass writes each page's outline (counts per token, some
hundred bytes), vectors are sums of hashes, so that they are partly summed in
each task and a host with a third of all pages is no burden. A template keeps
tokens on at least a tenth of a host's pages, so it is no longer than ten times
a mean page. Templates are joined to pages by host; only where Spark does not
broadcast them are pages shuffled.

Defined cases: null and empty html give the empty text; null urls and urls
without a host share one template; a host's only page is its own template, as
texts only count as template where TEXT_PAGES pages have them; where all main
blocks of a page are template texts they are kept; repeated pages give repeated
rows, an empty table none; unclosed elements end with the element around
them; very long pages are read whole, in time that grows with their length;
columns named like those added are replaced.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import textops
from turnloom.llm.columns import ROW, boxed, unboxed, without
from turnloom.llm.url_filters import host_of
from turnloom.llm.workspace import Workspace

#: A template token is on one page in so many at least; a template text on so many pages.
SHARE, TEXT_PAGES = 10, 10
#: Hosts whose templates a task remembers.
REMEMBERED = 512
_BATCH = 1 << 20

# Fixed values of HTML.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "svg", "math", "template", "object", "select", "button", "xmp", "noembed", "noframes", "canvas", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var area base col embed img input link meta param source track wbr".split())
#: Which open elements a start tag ends, where one of them is innermost.
ENDS = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",), "tbody": ("p", "td", "th", "tr", "tbody", "thead"), "tfoot": ("p", "td", "th", "tr", "tbody", "thead")}
#: Elements without main text, and words of classes, ids and roles that say so.
BOILERPLATE = frozenset("head nav footer aside menu dialog fieldset header".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "aside footer header masthead topbar toolbar comment comments reply replies respond disqus discussion share sharing social related recommended newsletter subscribe signup login popup modal overlay widget "
    "widgets pager pagination paging copyright legal disclaimer search form skip complementary contentinfo".split()
)
#: First words of names that tell a state of the page, and words that make a header one of the article.
STATES, TITLED = frozenset("has no with without is not".split()), frozenset("article post entry story content page title".split())
#: Whether an element is no main text: in a form (which some sites put around whole pages, articles included), or for another reason.
FORM, OTHER = 1, 2
#: Elements that hold others; the way to the main region ends before any other.
HOLDERS = frozenset("html body main article section div center table tbody tr td".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?:(?<=/)>|>.*?(?:</\1\s*+>|\Z))|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


class Element:
    __slots__ = ("token", "tag", "parent", "bad", "label")

    def __init__(self, token: int, tag: str, parent: Element | None, bad: int, label: str):
        self.token, self.tag, self.parent, self.bad, self.label = token, tag, parent, bad, label


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's label, and whether it says that it is no main text."""
    names = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _NAMES.finditer(attributes)} if "=" in attributes else {}
    label = tag + "".join(f"[{n}={' '.join(sorted(_DIGITS.sub('0', names[n]).split()))}]" for n in ("id", "class", "role") if n in names)
    for name in " ".join(names.values()).split():
        words = [w.lower() for w in _PARTS.split(name)]
        if words[0] in STATES:
            continue
        said = HINTS.intersection(words)
        if said and not (said == {"header"} and not TITLED.isdisjoint(words)):
            return label, True
    return label, False


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def _child(parent: Element | None, tag: str, attributes: str) -> Element:
    label, hinted = _named(tag, attributes)
    around = 0 if parent is None else parent.bad
    inside = parent if tag == "header" else None
    while inside is not None and inside.tag not in ("article", "main"):
        inside = inside.parent
    if tag in ("article", "main"):
        own = 0
        around = 0 if around == FORM else around
    elif tag == "form":
        own = FORM
    else:
        own = OTHER if (tag in BOILERPLATE and inside is None) or (hinted and tag not in ("html", "body")) else 0
    token = _signed(xxhash.xxh64_intdigest(label, seed=0 if parent is None else parent.token & (2**64 - 1)))
    return Element(token, tag, parent, max(own, around), label)


def read_page(html: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """The elements in order, and the blocks: their element, text and how many characters of it are links."""
    root = _child(None, "html", "")
    stack, open_, elements, blocks = [root], Counter(), [root], []
    pieces: list[str] = []
    linked, link = 0, False

    def close_block():
        nonlocal linked
        if pieces:
            words = " ".join(references.unescape("".join(pieces)).split())
            if words:
                blocks.append((stack[-1], words, min(linked, len(words))))
            pieces.clear()
        linked = 0

    def leave():
        open_[stack.pop().tag] -= 1

    at, last = 0, html.rfind(">") + 1
    for m in _TAG.finditer(html, 0, last):
        if m.start() > at:
            pieces.append(html[at : m.start()])
            linked += (m.start() - at) * link
        at = m.end()
        tag = m[3]
        if tag is None:  # comments, declarations and elements of which nothing is read
            continue
        tag = tag.lower()
        if tag == "a":
            link = not m[2]
        if tag in INLINE:
            continue
        close_block()
        if tag in VOID or tag == "html":
            continue
        if m[2]:
            if open_[tag]:
                while stack[-1].tag != tag:
                    leave()
                leave()
                link = False
            continue
        ends = ENDS.get(tag, ("p",))
        while stack[-1].tag in ends and len(stack) > 1:
            leave()
        element = _child(stack[-1], tag, m[4])
        stack.append(element)
        open_[tag] += 1
        elements.append(element)
    if at < len(html):
        rest = html[at:]
        pieces.append(rest[: m.start()] if (m := re.search(r"<[a-zA-Z/!?]", rest)) else rest)
    close_block()
    return elements, blocks


def _text_token(element: Element, words: str) -> int:
    return _signed(xxhash.xxh64_intdigest(words, seed=element.token & (2**64 - 1)))


# ---------------------------------------------------------------- outlines and classes

_TOKEN = "struct<token:bigint,parent:bigint,label:string,n:bigint,chars:bigint,links:bigint>"
_OUTLINE = f"host string, page bigint, tokens array<{_TOKEN}>, line array<bigint>"
_TOKEN_ARROW = pa.struct([("token", pa.int64()), ("parent", pa.int64()), ("label", pa.string()), ("n", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])


def _outlines(html: str):
    """Of each page its tokens with counts, and its elements' tokens in order. Texts have no label; bad elements have no characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches, html, _BATCH):
            hosts, pages, tokens, lines = [], [], [], []
            for host, page, text in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), batch.column(html).to_pylist(), strict=True):
                elements, blocks = read_page(text or "")
                found: dict[int, dict] = {}
                for e in elements:
                    own = found.setdefault(e.token, {"token": e.token, "parent": e.parent.token if e.parent else None, "label": e.label, "n": 0, "chars": 0, "links": 0})
                    own["n"] += 1
                for e, words, linked in blocks:
                    if not e.bad:
                        found[e.token]["chars"] += len(words)
                        found[e.token]["links"] += linked
                    token = _text_token(e, words)
                    own = found.setdefault(token, {"token": token, "parent": e.token, "label": None, "n": 0, "chars": 0, "links": 0})
                    own["n"] += 1
                hosts.append(host)
                pages.append(page)
                tokens.append(list(found.values()))
                lines.append([e.token for e in elements])
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "page": pa.array(pages, pa.int64()), "tokens": pa.array(tokens, pa.list_(_TOKEN_ARROW)), "line": pa.array(lines, pa.list_(pa.int64()))})

    return run


def equivalence_classes(outlines: DataFrame) -> DataFrame:
    """(host, tokens): the tokens on enough pages of a host, with the class that each belongs to.

    A class is the pair of sums, over pages, of the halves of a hash of page and
    count, besides the number of pages: equal vectors give equal sums.
    """
    each = outlines.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    h = F.xxhash64("page", "n")
    sums = each.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"),
        F.first("parent").alias("parent"), F.first("label").alias("label"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
    )
    sizes = outlines.groupBy("host").agg(F.count("*").alias("all_pages"))
    often = sums.join(sizes, "host").where((F.col("pages") * SHARE >= F.col("all_pages")) & (F.col("label").isNotNull() | (F.col("pages") >= TEXT_PAGES)))
    classed = often.select("host", F.struct("token", "parent", "label", F.xxhash64("pages", "low", "high").alias("cls"), "pages", "chars", "links").alias("t"))
    return classed.groupBy("host").agg(F.array_sort(F.collect_list("t")).alias("tokens"))  # at most SHARE times a mean page


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, cls, first and last order): a class's elements follow each other alike on a page, or its order is null."""
    seen: dict[tuple, list] = {}
    known: dict = {}
    for batch in batches:
        for host, line, tokens in zip(*(batch.column(n) for n in ("host", "line", "classes")), strict=True):
            host = host.as_py()
            if host not in known:
                if len(known) > REMEMBERED:
                    known.clear()
                known[host] = {t["token"]: t["cls"] for t in tokens.as_py() or [] if t["label"] is not None}
            cls_of = known[host]
            orders: dict[int, list[int]] = {}
            for token in line.as_py():
                if token in cls_of:
                    orders.setdefault(cls_of[token], []).append(token)
            for cls, order in orders.items():
                times = order.count(order[0])
                one = order[: len(order) // times]
                print_ = zlib.crc32(repr(one).encode()) if one * times == order else -1
                have = seen.setdefault((host, cls), [print_, print_])
                have[0], have[1] = min(have[0], print_), max(have[1], print_)
        if len(seen) > 100_000:
            yield _order_rows(seen)
            seen = {}
    yield _order_rows(seen)


def _order_rows(seen: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "host": pa.array([k[0] for k in seen], pa.string()), "cls": pa.array([k[1] for k in seen], pa.int64()),
        "low": pa.array([v[0] for v in seen.values()], pa.int64()), "high": pa.array([v[1] for v in seen.values()], pa.int64()),
    })


def templates(outlines: DataFrame, workspace: Workspace) -> DataFrame:
    """(host, tokens, broken): of each host its frequent tokens with their classes, and the classes that are not valid."""
    found = workspace.keep(equivalence_classes(outlines), "classes")
    lines = outlines.select("host", "line").join(found.withColumnRenamed("tokens", "classes"), "host")
    orders = lines.select("host", "line", "classes").mapInArrow(_orders, "host string, cls bigint, low bigint, high bigint")
    bad = orders.groupBy("host", "cls").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < 0 OR low <> high")
    broken = bad.groupBy("host").agg(F.collect_list("cls").alias("broken"))
    return workspace.keep(found.join(broken, "host", "left"), "templates")


# ---------------------------------------------------------------- slots and the main region


class Template:
    """A host's valid classes, nested, and the elements whose slots are its main region."""

    def __init__(self, tokens: list[dict], broken: list[int] | None):
        gone = set(broken or ())
        elements = {t["token"]: t for t in tokens if t["label"] is not None}
        valid = {k for k, t in elements.items() if t["cls"] not in gone}
        classes = {elements[k]["cls"] for k in valid}
        self.texts = {t["token"] for t in tokens if t["label"] is None and t["cls"] in classes}
        #: The gap that each part of a class lies in: (class, token of the element around it) for every template element.
        self.nested = {k: (elements[k]["cls"], self._around(elements, valid, elements[k]["parent"])) for k in valid}
        # the text of elements outside of valid classes belongs to the slot around them
        slots = {k: [0, 0] for k in valid}
        for k, t in elements.items():
            home = k if k in valid else self._around(elements, valid, k)
            if home is not None:
                slots[home][0] += t["chars"]
                slots[home][1] += t["links"]
        self.main = main_region({k: (elements[k]["label"], self.nested[k][1], max(0, slots[k][0] - slots[k][1])) for k in valid})

    @staticmethod
    def _around(elements: dict, valid: set, token: int | None) -> int | None:
        while token is not None and token not in valid:
            token = elements[token]["parent"] if token in elements else None
        return token


def main_region(slots: dict[int, tuple[str, int | None, int]]) -> set[int]:
    """Elements whose parts are main text, from (label, element around, characters of its slots) of each element."""
    children: dict[int | None, list[int]] = {}
    for token, (_, parent, _) in slots.items():
        children.setdefault(parent, []).append(token)
    total: dict[int, int] = {}
    todo = [(t, False) for t in children.get(None, [])]
    while todo:
        token, done = todo.pop()
        if done:
            total[token] = slots[token][2] + sum(total[c] for c in children.get(token, []))
        else:
            todo += [(token, True), *((c, False) for c in children.get(token, []))]
    tag = lambda t: re.split(r"\[", slots[t][0], maxsplit=1)[0]
    for name in ("article", "main"):
        best = max((total[t] for t in total if tag(t) == name), default=0)
        if best:
            return {t for t in total if tag(t) == name and 4 * total[t] >= best}
    region = sorted(children.get(None, []))
    while True:
        inside = [c for t in region for c in children.get(t, [])]
        whole = sum(total[t] for t in region)
        best = max(inside, key=lambda c: (total[c], c), default=None)
        if best is None or not whole or 2 * total[best] < whole or tag(best) not in HOLDERS:
            return set(region)
        region = [best]


def main_blocks(elements: list[Element], blocks: list[tuple[Element, str, int]], template: Template | None) -> list[str]:
    """The page's text, block by block."""
    usable = [(e, words) for e, words, _ in blocks if not e.bad]

    def within(region: set[int]) -> list[tuple[Element, str]]:
        known: dict[int, bool] = {}

        def inside(e: Element | None) -> bool:
            way = []
            while e is not None and id(e) not in known and e.token not in region:
                way.append(e)
                e = e.parent
            found = e is not None and (e.token in region or known[id(e)])
            known.update((id(x), found) for x in way)
            return found

        return [(e, words) for e, words in usable if inside(e)]

    found = within(template.main) if template else []
    if not found:
        slots: dict[int, list] = {e.token: [e.label, e.parent.token if e.parent else None, 0] for e in elements}
        for e, words, linked in blocks:
            slots[e.token][2] += 0 if e.bad else max(0, len(words) - linked)
        found = within(main_region({k: tuple(v) for k, v in slots.items()}))
    left = [words for e, words in found if not (template and template.texts and _text_token(e, words) in template.texts)]
    return left or [words for _, words in found]


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", keep_html: bool = True, workspace: Workspace | None = None) -> DataFrame:
    """The rows with text, the main text of their html, and n_chars, its code points."""
    ws = workspace or Workspace(pages.sparkSession)
    rows = without(pages, "text", "n_chars")
    kind = rows.schema[html].dataType
    if not isinstance(kind, T.StringType):
        raise TypeError(f"column {html} must be a string, not {kind.simpleString()}")
    host = host_of(F.col(url))
    # pages with the same html count as one page seen more than once, which changes no equality of vectors
    hashed = rows.select(host.alias("host"), F.xxhash64(url, html).alias("page"), F.col(html).alias("html"))
    outlines = ws.keep(hashed.mapInArrow(_outlines("html"), _OUTLINE), "outlines")
    known = templates(outlines, ws).withColumnRenamed("host", "tl_host")
    carried = [c for c in rows.columns if keep_html or c != html]
    parts = boxed(rows, carried, tl_host=host, tl_html=F.col(html))
    joined = parts.join(known, "tl_host", "left")
    inner = T.StructType([parts.schema[ROW], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        built: dict[str, Template] = {}
        for batch in textops.slices(batches, "tl_html", _BATCH):
            texts = []
            for i, (name, page) in enumerate(zip(batch.column("tl_host").to_pylist(), batch.column("tl_html").to_pylist(), strict=True)):
                if name not in built:
                    if len(built) > REMEMBERED:
                        built.clear()
                    tokens = batch.column("tokens")[i].as_py()
                    built[name] = Template(tokens, batch.column("broken")[i].as_py()) if tokens else None
                elements, blocks = read_page(page or "")
                texts.append("\n".join(main_blocks(elements, blocks, built[name])))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [ROW, "text", "n_chars"])

    return joined.mapInArrow(run, inner).select(*unboxed(carried), "text", "n_chars")
