"""Main text of web pages by composite text density (Sun, Song and Liao, 2011).

Every element of a page's tree gets its characters per tag, adjusted for the share of characters and tags that links take.
The element whose children's densities have the largest sum is the article's core; the smallest density on the way from it to
the body is the threshold. What stays is the whole article or main element around the core and all else that is dense enough:
in other such elements, or in the whole body if none is around the core. A heading goes with the text that follows it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from erspark.llm.common import kept_columns, packed, read_table, unpacked

# Element names by their role, and words in class, id and role that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms msup msub mtext q s samp small span strike strong sub sup time tt u var wbr br img".split())
NOISE_TAGS = frozenset("nav footer aside form fieldset button select option dialog menu".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote figcaption caption pre dt dd td th".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NOISE_WORDS = frozenset(
    """ad ads adbox advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promoted promotion banner
    sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert alerts popup
    modal newsletter subscribe subscription share sharing social related recommended comment comments commentlist reply replies disqus respond
    widget widgets skiplink toolbar pagination hidden""".split()
)
#: Words before which another one only says how the page is laid out, and those that make a header the site's own.
MODIFIERS = frozenset("has no with without is not show hide js without".split())
SITE = frozenset("site page global top masthead main blog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[A-Za-z/][^<]*\Z""", re.S)
NAMES = re.compile(r"""(?i)(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?:\s*=\s*["']?(?:hidden|true)?["']?)?(?=\s|/|$)""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def named_noise(attributes: str) -> str:
    """What an element's class, id and role say: ``noise``, ``header`` (noise outside an article) or nothing."""
    said = ""
    for kind, *values in NAMES.findall(attributes):
        value = next(filter(None, values), "")
        if kind.lower() == "role":
            if value.strip().lower() in NOISE_ROLES:
                return "noise"
            continue
        for name in value.split():
            words = [w.lower() for w in WORD.findall(name)]
            if not words or words[0] in MODIFIERS:
                continue
            if not NOISE_WORDS.isdisjoint(words):
                return "noise"
            if "header" in words:
                said = "site" if not SITE.isdisjoint(words) else said or "header"
    return said


@dataclass
class Node:
    tag: str
    parent: int
    noise: bool
    guarded: bool = False  # noise by its names alone, which a main title inside revokes
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    total: float = 0.0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The tree (parents before children) with its counts, and the blocks (element, text) that are not noise.

    Every open element is known by its tag, so that no end tag and no text has to look through the open ones: the time is
    in proportion to the page, however deeply it is nested.
    """
    nodes = [Node("body", -1, False)]
    blocks: list[tuple[int, int, int, str]] = []  # element, characters, of these in links, text
    stack, buffer, counted = [0], [], [0, 0]
    places: dict[str, list[int]] = {}  # tag -> places in the stack
    solid = [0]  # places in the stack of elements that are not inline
    holders = CLOSES_P - {"p"} | {"td", "th", "li", "dd"}

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append((stack[solid[-1]], *counted, text))
            counted[:] = 0, 0

    def cut(n: int) -> None:
        while len(stack) > n:
            places[nodes[stack.pop()].tag].pop()
            if solid[-1] >= len(stack):
                solid.pop()

    def close(tag: str, bounds: frozenset | set) -> None:
        if places.get(tag):
            n = places[tag][-1]
            if all(not places.get(b) or places[b][-1] < n for b in bounds if b != tag):
                if tag not in INLINE:
                    flush()
                cut(n)

    def say(text: str) -> None:
        if text:
            text = html.unescape(text)
            n = len("".join(text.split()))
            counted[0] += n
            top = nodes[stack[-1]]
            top.chars += n
            if places.get("a"):
                counted[1] += n
                top.link_chars += n
            buffer.append(text)

    at = 0
    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close(tag, frozenset() if tag not in INLINE else holders)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P:
            close("p", holders)
        if tag in SELF_CLOSING:
            close(tag, SELF_CLOSING[tag])
        if tag == "br":
            buffer.append(" ")
        if tag in VOID:
            nodes[stack[-1]].tags += 1
            continue
        inside = any(places.get(t) for t in CONTENT_TAGS)
        said = named_noise(m[3]) if m[3] else ""
        if said == "header" and inside:
            said = ""
        noise = tag in NOISE_TAGS or (tag == "header" and not inside) or said == "site" or bool(m[3] and HIDDEN.search(m[3]))
        nodes.append(Node(tag, stack[-1], noise, not noise and bool(said), 0, 1, 0, int(tag == "a")))
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            solid.append(len(stack))
        stack.append(len(nodes) - 1)
    say(page[at:])
    flush()
    settle(nodes)
    return nodes, [(k, t) for k, _, _, t in blocks if not nodes[k].noise]


def settle(nodes: list[Node]) -> None:
    """Decide what is noise, then sum counts up to each element's parent.

    A name such as ``layout-sidebar`` on the element around a whole article would lose it: names mark as noise only what has
    no main title or main element inside. Whatever is in noise is noise.
    """
    titled = [False] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        n = nodes[k]
        if n.guarded:
            n.noise = not titled[k]
        if not n.noise and (titled[k] or n.tag in ("h1", "main")):
            titled[n.parent] = True
    for n in nodes[1:]:
        n.noise = n.noise or nodes[n.parent].noise
    for k in range(len(nodes) - 1, 0, -1):
        n, up = nodes[k], nodes[nodes[k].parent]
        if not n.noise:
            up.chars += n.chars
            up.tags += n.tags
            up.link_chars += n.link_chars
            up.link_tags += n.link_tags


def density(n: Node, body: Node) -> float:
    """Composite text density: characters per tag, times a logarithm that falls as links take over."""
    if n.noise or not n.chars:
        return 0.0
    tags, links, link_chars = max(1, n.tags), max(1, n.link_tags), max(1, n.link_chars)
    plain = max(1, n.chars - n.link_chars)
    base = math.log(n.chars / plain * n.link_chars + body.link_chars / max(1, body.chars) * n.chars + math.e)
    value = n.chars / link_chars * tags / links
    return n.chars / tags * max(0.0, math.log(max(value, 1e-9)) / math.log(max(base, 1.0001)))


def linked(nodes: list[Node], k: int) -> bool:
    """Whether a block is a menu's: mostly links, and no paragraph or the like, nor an item of a list that has more than links."""
    n = nodes[k]
    up = nodes[n.parent] if n.tag == "li" else n
    return 2 * up.link_chars > up.chars and n.tag not in PROSE


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by an empty line; empty if there is none."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    each = [density(n, nodes[0]) for n in nodes]
    for k in range(1, len(nodes)):
        if nodes[k].tag not in INLINE:
            nodes[nodes[k].parent].total += each[k]
    inner = [k for k in range(len(nodes)) if not nodes[k].noise and nodes[k].tag not in INLINE]
    best = max(inner, key=lambda k: (nodes[k].total, -k))
    if not nodes[best].total:  # text that stands in no element but the body
        best = 0
    while nodes[best].tag == "p":
        best = nodes[best].parent
    path, k = [], best
    while k > 0:
        path.append(each[k])
        k = nodes[k].parent
    threshold = min([*path, each[0]] if each[0] else path, default=0.0)
    around, k = [], best
    while k > 0:
        if nodes[k].tag in CONTENT_TAGS:
            around.append(k)
        k = nodes[k].parent
    under, scope = {around[-1] if around else best}, set() if around else {0}
    for k in range(1, len(nodes)):
        if nodes[k].parent in under:
            under.add(k)
        if not nodes[k].noise and (nodes[k].tag in CONTENT_TAGS or nodes[k].parent in scope):
            scope.add(k)
    # One paragraph has less density than the elements around it: away from the core, half of the core's median block will do.
    core = sorted(each[k] for k, _ in blocks if k in under)
    away = min(threshold, core[len(core) // 2] / 2) if core else threshold
    kept, follows = [], False
    for k, t in reversed(blocks):
        ok = (k in under and (k == best or each[k] >= threshold or not linked(nodes, k))) or (k in scope and each[k] >= away > 0)
        if nodes[k].tag in HEADINGS:
            ok = ok or (follows and k in scope)
        else:
            follows = ok
        if ok:
            kept.append(t)
    kept.reverse()
    return "\n\n".join(kept)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without its markup, with ``text`` and ``n_chars`` (code points). Null and empty pages have no text.

    The caller's columns named text or n_chars give way to these.
    """
    keep = kept_columns(pages, column, "text", "n_chars")
    df = packed(pages, keep, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["__own", "text", "n_chars"])

    return df.mapInArrow(run, f"__own {df.schema['__own'].dataType.simpleString()}, text string, n_chars long").select(*unpacked(keep), "text", "n_chars")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``.

    Null, empty and blank pages, and pages that are all noise, have the empty text; a page of any length is read whole, in
    time proportional to it; of elements with equal density sums the first is the core; repeated rows stay; an empty table
    gives no rows. Columns besides page_id, url and html are not read.
    """
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
