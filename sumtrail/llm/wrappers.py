"""Main text of web pages by union-free regular-expression inference.

The pages of a host come from a template. Its wrapper is a regular expression without
unions: tags, text slots, optional groups and repeated groups. It is inferred by aligning
pages one after another with what is known so far: repeated neighbours fold into one
group, texts that differ make a slot, and what only one side has becomes optional.

The wrapper tells what the template repeats and what a page fills in. Every page is
aligned with the wrapper of its host, and blocks that consist of the template's texts are
left out, inside article elements too: there headings stay, as articles share them, and all
stays if most blocks are constant, as such pages are copies of one article. Names of elements and classes are hints beside it:
menus, headers, footers, sidebars, notices, adverts, forms and comments are left out
everywhere, and of a page with an article element only that is taken.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrail.llm.folders import small_batches, written

# HTML element names by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|textarea|title|iframe"
LEFT_OUT = frozenset("head nav footer aside form header menu dialog fieldset label template svg object canvas select button annotation annotation-xml".split())
# Elements that a start tag ends if they are open, and those that they are not looked for beyond.
CLOSES_P = BLOCKS - frozenset("body caption html option tbody td tfoot th thead tr".split())
ITEM_SCOPE = BLOCKS - frozenset("address div p li dd dt".split())
TABLE, NONE = frozenset(("table",)), frozenset()
ENDS = (
    {"li": (frozenset(("li",)), ITEM_SCOPE), "tr": (frozenset(("tr",)), TABLE)}
    | dict.fromkeys(("dd", "dt"), (frozenset(("dd", "dt")), ITEM_SCOPE))
    | dict.fromkeys(("td", "th"), (frozenset(("td", "th")), TABLE))
    | dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(("tbody", "thead", "tfoot")), TABLE))
)
P_SCOPE = frozenset("button caption object table td template th html".split())
# Words in class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments cookie cookies consent disclaimer "
    "discussion disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted "
    "promotion related replies reply responses share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar "
    "topbar widget widgets alert complementary contentinfo search site-header".split()
)
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# So many different pages of a host must have a text before it counts as the template's:
# inside an article more, as a few articles can agree in a sentence.
LEAST_PAGES, LEAST_ARTICLES = 2, 10
# Shapes of pages of a host that a task holds before it aligns them.
SHAPES = 64
# Wrappers are broadcast up to this many bytes in all, and joined by host beyond.
BROADCAST_BYTES = 16 << 20

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?:{RAW})(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:[\s\"']|\s[a-z-]+))?/>|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.IGNORECASE)
_SPACES = re.compile(r"\s+")


@lru_cache(maxsize=1 << 14)
def _tag(closing: str, name: str, rest: str) -> tuple[str, bool]:
    """Label of a tag, and whether it opens something that is left out."""
    if closing:
        return "/" + name, False
    attributes = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)]
    words = [w for a, value in attributes if a in ("class", "id", "role") for w in re.split(r"[\s_-]+", value.lower()) if w]
    hidden = any(
        a == "hidden" or (a == "aria-hidden" and value.strip().lower() == "true") or (a == "style" and _HIDDEN_STYLE.search(value)) for a, value in attributes
    )
    gone = name in LEFT_OUT or bool(MARKS.intersection(words)) or hidden
    return name + "".join("." + w for w in sorted(set(words)) if not any(c.isdigit() for c in w)), gone


def tokens(html: str | None) -> list[tuple[str, str, bool]]:
    """Tags and texts of a page: label ("" for text), text or element name, left out."""
    out, at = [], 0
    html = html or ""
    for m in _TOKEN.finditer(html):
        if m.start() > at and (text := html[at : m.start()]).strip():
            out.append(("", text, False))
        elif m.start() > at:
            out.append((" ", " ", False))
        at = m.end()
        if m[3]:
            name = m[3].lower()
            label, gone = _tag(m[2], name, m[4])
            out.append((label, name, gone))
            if name in ("svg", "math") and not m[2] and m[4].endswith("/"):
                out.append(("/" + name, name, False))
    if at < len(html) and html[at:].strip():
        out.append(("", html[at:], False))
    return out


# A wrapper is a list of nodes: [label] for a tag, ["", text] for a text that is the same
# everywhere (a slot has None instead), ["?", nodes] for an optional group and
# ["+", nodes] for a repeated one. The text in a repeated group is the list of its texts.
# A text that several pages have is followed by their number.


def _repeated(group: list[list]) -> list:
    """One of several equal nodes, with the texts of all."""
    label = group[0][0]
    if label == "+":
        return [label, [_repeated(list(g)) for g in zip(*(x[1] for x in group), strict=True)]]
    return ["", [t for x in group for t in _texts(x)]] if label == "" else group[0]


def _texts(node: list) -> list[str]:
    return node[1] if isinstance(node[1], list) else [node[1]]


def fold(nodes: list) -> list:
    """Replace neighbours that repeat by one repeated group, short groups first."""
    keys = [_key(x) for x in nodes]
    size = 0
    while 2 * (size := size + 1) <= len(nodes):
        if not _repeats(keys, size):
            continue
        out, i = [], 0
        while i < len(nodes):
            n = 1
            # A group begins with an opening tag or a text, as a list's item does.
            if i + size < len(nodes) and keys[i] == keys[i + size] and nodes[i][0][:1] != "/":
                group = keys[i : i + size]
                while keys[i + n * size : i + (n + 1) * size] == group:
                    n += 1
            if n > 1 and (size > 1 or nodes[i][0] not in ("", "+")):
                out.append(["+", [_repeated(nodes[i + k : i + n * size : size]) for k in range(size)]])
                i += n * size
            else:
                out.append(nodes[i])
                i += 1
        if len(out) < len(nodes):
            nodes, keys = out, [_key(x) for x in out]
    return nodes


def _repeats(keys: list[str], size: int) -> bool:
    """Whether some ``size`` neighbours are followed by their like.

    Then ``size`` places in a row equal those ``size`` further on. One of them is a multiple of
    ``size``, so only these are tried, and all sizes together take about n log n steps.
    """
    last = len(keys) - size
    for m in range(0, last, size):
        if keys[m] == keys[m + size]:
            low = high = m
            while high < last and high < m + size and keys[high] == keys[high + size]:
                high += 1
            while low > 0 and high - low < size and keys[low - 1] == keys[low - 1 + size]:
                low -= 1
            if high - low >= size:
                return True
    return False


def _key(node: list) -> str:
    """What two nodes must have in common to be aligned."""
    return "+(" + " ".join(_key(x) for x in node[1] if x[0] != "?") + ")" if node[0] == "+" else "<" + node[0] + ">"


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of two node lists."""
    x, y = [_key(n) for n in a], [_key(n) for n in b]
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    j = 0
    while j < min(len(x), len(y)) - i and x[-1 - j] == y[-1 - j]:
        j += 1
    p, q = x[i : len(x) - j], y[i : len(y) - j]
    # Bit vectors of the suffixes' longest common subsequences: zeros count what is common.
    # Every ``step``-th is kept and those between are worked out again, so that two long pages
    # don't take memory by the product of their lengths.
    at: dict[str, int] = {}
    for r, key in enumerate(reversed(p)):
        at[key] = at.get(key, 0) | 1 << r
    full = (1 << len(p)) - 1
    masks = [at.get(key, 0) for key in reversed(q)]
    step = isqrt(len(q)) + 1

    def block(row: int, k: int) -> list[int]:
        rows = [row]
        for m in masks[k * step : (k + 1) * step]:
            row = ((row + (row & m)) | (row & ~m)) & full
            rows.append(row)
        return rows

    kept = [full]
    for k in range(len(q) // step):
        kept.append(block(kept[-1], k)[-1])
    near: dict[int, list[int]] = {}

    def row_at(t: int) -> int:
        k = t // step
        if k not in near:
            # The places looked at only go down; a block and the one before are in use.
            near.pop(k + 2, None)
            near[k] = block(kept[k], k)
        return near[k][t - k * step]

    def best(r: int, s: int) -> int:
        n = len(p) - r
        return n - (row_at(len(q) - s) & ((1 << n) - 1)).bit_count()

    out, r, s = [(k, k) for k in range(i)], 0, 0
    while r < len(p) and s < len(q):
        if p[r] == q[s]:
            out.append((i + r, i + s))
            r, s = r + 1, s + 1
        elif best(r + 1, s) >= best(r, s + 1):
            r += 1
        else:
            s += 1
    return out + [(len(x) - k, len(y) - k) for k in range(j, 0, -1)]


def align(wrapper: list, other: list) -> list:
    """The wrapper of everything that either of two wrappers stands for."""
    one, two = _flat(wrapper), _flat(other)
    a_optional, b_optional = _optional(wrapper), _optional(other)
    out: list = []
    i, j = 0, 0

    def add(node: list, optional: bool) -> None:
        if not optional:
            out.append(node)
        elif out and out[-1][0] == "?":
            out[-1][1].append(node)
        else:
            out.append(["?", [node]])

    for r, s in [*_matches(one, two), (len(one), len(two))]:
        for x in (*one[i:r], *two[j:s]):
            add(x, True)
        if r < len(one):
            a, b = one[r], two[s]
            if a[0] == "+":
                a = ["+", align(a[1], b[1])]
            elif a[0] == "":
                a = ["", a[1], _pages(a) + _pages(b)] if a[1] == b[1] and a[1] is not None else ["", None]
            add(a, a_optional[r] or b_optional[s])
        i, j = r + 1, s + 1
    return out


def _flat(nodes: list) -> list:
    """Nodes with optional parts as if they were not optional."""
    return [y for x in nodes for y in (x[1] if x[0] == "?" else [x])]


def _optional(nodes: list) -> list[bool]:
    return [x[0] == "?" for x in nodes for _ in (x[1] if x[0] == "?" else [x])]


def page_nodes(page: list[tuple[str, str, bool]]) -> list:
    return fold([["", _clean(text)] if not label else [label] for label, text, _ in page if label != " "])


def _pages(text: list) -> int:
    return text[2] if len(text) > 2 else 1


def _shape(nodes: list) -> str:
    return " ".join(map(_key, nodes))


def _groups(nodes: list) -> Iterator[tuple[str, list]]:
    """Key and nodes of the repeated groups, also of those in others and in optional parts."""
    for x in nodes:
        if x[0] in ("+", "?"):
            if x[0] == "+":
                yield _key(x), x[1]
            yield from _groups(x[1])


def describe(nodes: list) -> dict:
    """The wrapper of one page.

    ``common`` has, for each kind of repeated group, how many pages have it and the texts
    that it has on all of them: a line that ends every article stands in the group of its
    paragraphs, of which each page has another number.
    """
    common: dict[str, list] = {}
    for key, group in _groups(nodes):
        own = common.setdefault(key, [1, []])
        own[1] = sorted({*own[1], *(t for x in group if x[0] == "" for t in _texts(x))})
    return {"nodes": nodes, "pages": 1, "common": common}


def merge_wrappers(one: dict, two: dict) -> dict:
    common = dict(one["common"])
    for key, (n, texts) in two["common"].items():
        m, known = common.get(key, (0, texts))
        common[key] = [m + n, sorted(set(known).intersection(texts))]
    return {"nodes": align(one["nodes"], two["nodes"]), "pages": one["pages"] + two["pages"], "common": common}


def infer(pages: list[dict]) -> dict | None:
    wrapper = None
    for page in pages:
        wrapper = page if wrapper is None else merge_wrappers(wrapper, page)
    return wrapper


class Wrapper:
    """Tells which texts of a page are the template's."""

    def __init__(self, wrapper: dict | None) -> None:
        self.nodes = _flat(wrapper["nodes"]) if wrapper else []
        self.pages = wrapper["pages"] if wrapper else 0
        self.common = {k: (n, frozenset(texts)) for k, (n, texts) in wrapper["common"].items()} if wrapper else {}
        self.pairs: dict[str, list[tuple[int, int]]] = {}

    def template(self, page: list[tuple[str, str, bool]]) -> dict[int, int]:
        """Number of each token that is a text of the template, and how many pages have it."""
        found: dict[int, int] = {}
        if self.pages < 2:
            return found
        # Folding doesn't look at texts, so their numbers can stand for them.
        nodes = fold([["", k] if not label else [label] for k, (label, _, _) in enumerate(page) if label != " "])
        shape = _shape(nodes)
        if shape not in self.pairs:
            if len(self.pairs) > 1000:
                self.pairs.clear()
            # Pages of one shape are aligned alike.
            self.pairs[shape] = _matches(nodes, self.nodes)
        for r, s in self.pairs[shape]:
            self._compare(page, nodes[r], self.nodes[s], found)
        return found

    def _compare(self, page: list[tuple[str, str, bool]], own: list, known: list, found: dict[int, int]) -> None:
        if own[0] == "":
            # A text of only some pages is the template's if most pages have it.
            if known[1] is not None and 2 * _pages(known) > self.pages and [_clean(page[k][1]) for k in _texts(own)] == _texts(known):
                found.update((k, _pages(known)) for k in _texts(own))
        elif own[0] == "+":
            n, common = self.common.get(_key(own), (0, frozenset()))
            if common and 2 * n > self.pages:
                found.update((k, n) for x in own[1] if x[0] == "" for k in _texts(x) if _clean(page[k][1]) in common)
            plain = _flat(known[1])
            for r, s in _matches(own[1], plain):
                self._compare(page, own[1][r], plain[s], found)


def _clean(text: str) -> str:
    return _SPACES.sub(" ", entities.unescape(text)).strip()


def main_text(page: list[tuple[str, str, bool]], wrapper: Wrapper) -> str:
    """The blocks of the article, one a line."""
    inside = _article(page)
    template = wrapper.template(page)
    least = LEAST_PAGES if inside is None else LEAST_ARTICLES
    # The blocks, and which of them have a text of their own.
    blocks: list[tuple[str, bool]] = []
    part: list[str] = []
    own: list[bool] = []
    # Open elements, and whether they or one around them is left out.
    stack: list[tuple[str, bool]] = []

    def close(names: frozenset[str], scope: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    def end() -> None:
        block = _SPACES.sub(" ", "".join(part)).strip()
        if block:
            blocks.append((block, any(own)))
        part.clear()
        own.clear()

    for k, (label, text, out) in enumerate(page):
        if label in ("", " "):
            if not (stack and stack[-1][1]) and (inside is None or k in inside):
                part.append(entities.unescape(text) if label == "" else text)
                constant = template.get(k, 0) >= least and (inside is None or not any(name in HEADINGS for name, _ in stack))
                own.append(label == "" and not constant)
            continue
        if text in BLOCKS:
            end()
        elif text == "br":
            part.append(" ")
        if label[0] == "/":
            # The end of an inline element doesn't end blocks in it.
            close(frozenset((text,)), NONE if text in BLOCKS or text in LEFT_OUT else BLOCKS)
            continue
        if text in CLOSES_P:
            close(frozenset(("p",)), P_SCOPE)
        if text in ENDS:
            close(*ENDS[text])
        if text not in VOID:
            kept = text in ("body", "html", "article", "main")
            stack.append((text, bool(stack and stack[-1][1]) or (out and not kept)))
    end()
    # Pages that agree in most of an article are copies, and tell nothing of the template.
    copies = inside is not None and 2 * sum(not new for _, new in blocks) > len(blocks)
    return "\n".join(block for block, new in blocks if new or copies)


def _article(page: list[tuple[str, str, bool]]) -> set[int] | None:
    """Numbers of the tokens inside article or main elements; None if there are none."""
    found: set[int] = set()
    for name in ARTICLE:
        depth = 0
        own: set[int] = set()
        for k, (label, text, _) in enumerate(page):
            if text == name and label:
                depth = max(0, depth - 1) if label[0] == "/" else depth + 1
            elif depth:
                own.add(k)
        if any(page[k][0] == "" for k in own):
            found = own if not found else found & own if found & own else found
    return found or None


def host_of(url: str):
    """The host in a URL column, in lower case; pages without one share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``host`` and ``wrapper`` (JSON) of every host, from all of its pages.

    Tasks infer a wrapper for each host from the pages they hold; these are then aligned
    with each other, so a host with most of the pages gathers one wrapper from each task.
    """

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict] = {}
        shapes: dict[str, dict[str, dict]] = {}

        def add(host: str) -> None:
            parts = shapes.pop(host).values()
            known[host] = infer([known[host], *parts] if host in known else [*parts])

        for batch in batches:
            for host, page in zip(batch["host"], batch["html"], strict=True):
                found = describe(page_nodes(tokens(page)))
                shape = _shape(found["nodes"])
                own = shapes.setdefault(host, {})
                own[shape] = merge_wrappers(own[shape], found) if shape in own else found
                if len(own) == SHAPES:
                    add(host)
        for host in [*shapes]:
            add(host)
        yield pd.DataFrame({"host": list(known), "wrapper": [json.dumps(w) for w in known.values()]}, columns=["host", "wrapper"], dtype=object)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        parts = [json.loads(w) for w in sorted(group["wrapper"])]
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(infer(parts))]}, dtype=object)

    rows = pages.select(host_of(url).alias("host"), F.col(html).alias("html"))
    # A page that occurs again says nothing about the template.
    rows = rows.withColumn("hash", F.md5("html")).dropDuplicates(["host", "hash"]).select("host", "html")
    partial = rows.mapInPandas(some, "host string, wrapper string")
    return partial.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def extract_text(pages: DataFrame, wrappers: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Add ``text``, the main text, to ``pages``; a column of that name is replaced.

    Null or empty pages, and pages without an article, have an empty text. On a host with
    one page, or only copies of one, nothing is known to be constant. Repeated pages have
    the same text.
    """
    constant = wrappers.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    if (constant.agg(F.sum(F.length("__wrapper"))).first()[0] or 0) <= BROADCAST_BYTES:
        constant = F.broadcast(constant)

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Wrapper] = {}
        for page, wrapper in batches:
            out = []
            for p, w in zip(page, wrapper, strict=True):
                if w not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[w] = Wrapper(json.loads(w) if w else None)
                out.append(main_text(tokens(p), known[w]))
            yield pd.Series(out, dtype=object)

    own = [F.col(f"`{c}`") for c in pages.columns if c != "text"]
    joined = pages.withColumn("__host", host_of(url)).join(constant, "__host", "left")
    return joined.select(*own, extract(F.col(f"`{html}`"), F.col("__wrapper")).alias("text"))


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    hosts = pages.select(host_of("url").alias("host")).groupBy("host").agg(F.count("*").alias("pages"))
    wrappers = infer_wrappers(pages).join(hosts.filter("pages > 1"), "host", "left_semi")
    found = extract_text(pages, written(wrappers, "wrappers"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
