"""Main text of web pages by a site style tree.

Pages of one host share a tree of elements, named by their path of tags, classes and ids. For each
node of the tree two entropies are taken over the host's pages: of the ways its children are laid out
(presentation), and of the texts below it (content). A node that looks alike and says the same on all pages
has a low importance, and its branch is cut from each page.

Menus and adverts may say something else on every page, so entropy alone would keep them: elements that
are named for what they are (navigation, footer, form, advert ...) have no importance from the start. A class or id is
such a name as a whole, or with words that only say where it stands; a branch that only a class or id names
stays if it holds most of the page's text. An article ends what a name around it says, unless the page
has another article outside of such branches. Where a page marks its article, only the article is read, and the style tree cuts nothing inside it. A branch that
holds most of a page's remaining text is never cut. Pages of a host that say the same count once, so copies make
nothing look repeated, and a node that few of them have keeps an importance near 1.

Defined cases: null or empty pages have an empty text; a missing or odd address makes a host of its own text;
repeated rows and null ids give a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import Batches, sliced, written

TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand in a line of text; all others begin and end a block.
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr""".split())
#: Elements that a new one of the kind, or the end of their parent, closes.
CLOSED_BY = {"p": set(), "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
             "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements and names that say what a branch is. Fixed lists.
NOISE_TAGS = set("""nav footer aside form script style noscript template iframe textarea button select svg canvas object
menu dialog title head xmp""".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_NAMES = set("""ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
gdpr notice notices alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead
comment comments reply replies disqus share sharing social related recommended newsletter subscribe signup popup modal
widget pagination pager search""".split())
#: Words that may stand beside those in a class or id and only say where a branch is or what it is made of.
PLACES = set("""site page main global top bottom left right side primary secondary bar box list links items item buttons button
slot unit wrapper wrap container block section area content inner posts post articles stories media form text""".split())
#: Not noise inside an article, where they hold its title.
HEADERS = {"header", "masthead"}


class Node(NamedTuple):
    tag: str
    key: int
    main: bool  # inside an article
    noise: bool
    above: tuple[int, ...]  # keys from the top, its own included
    outer: tuple[int, ...]  # those of them outside of an article
    named: tuple[int, ...]  # those of them that a class or id names as noise
    inherited: bool  # in an article inside a branch that is noise by name


class Block(NamedTuple):
    text: str
    path: tuple[int, ...]
    main: bool
    outer: tuple[int, ...]  # the part of the path outside of a marked article
    named: tuple[int, ...]  # the part of the path that a class or id names as noise
    inherited: bool  # in an article inside a branch that is noise by name


class Page(NamedTuple):
    blocks: list[Block]
    children: dict[int, list[str]]


def named(attributes: str) -> tuple[str, set[str], bool, bool]:
    """A style name, the names in class and id, whether it marks an article, whether it is hidden."""
    style, words, main, hidden = [], set(), False, False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden":
            hidden = True
        elif name == "role":
            main |= value == "main"
            hidden |= value in NOISE_ROLES
        elif name == "itemprop":
            main |= value == "articlebody"
        else:
            # Numbers differ from page to page; the name without them is the style.
            style.append(re.sub(r"\d+", "", value))
            words.update(value.split())
    return " ".join(style), words, main, hidden


def noise_names(words: set[str]) -> set[str]:
    """The names of noise in classes and ids of which every word is one, or a place."""
    out = set()
    for word in words:
        parts = {x for x in re.split(r"[^a-z]+", word) if x}
        if parts <= NOISE_NAMES | PLACES:
            out |= parts & NOISE_NAMES
    return out


def kept(blocks: list[Block], most: float = 0.5) -> list[Block]:
    """The blocks outside of branches that are noise by name or, in pages with a marked article, not marked.

    A branch that holds more than ``most`` of the page's text stays in any case.
    """
    size: dict[int | tuple[int, ...], int] = defaultdict(int)
    for b in blocks:
        for key in {*b.path, b.path}:  # branches, and the text that stands in an element itself
            size[key] += len(b.text)
    total = sum(len(b.text) for b in blocks)
    large = {key for key, n in size.items() if n > most * total}
    stays = [b for b in blocks if large.issuperset(b.named)]
    clean = any(b.main and not b.inherited for b in stays)
    read = [b.main and not (clean and b.inherited) for b in stays]
    marked = {key for b, r in zip(stays, read) if r for key in b.path}
    return [b for b, r in zip(stays, read) if r or not marked or not large.isdisjoint({*b.path, b.path} - marked)]


def parse(source: str) -> Page:
    """The page's blocks of text outside of branches that are noise by name, and each node's children."""
    top = Node("", 0, False, False, (), (), (), False)
    stack, blocks, children = [top], [], defaultdict(list)
    held: list[str] = []
    held_at = top

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                blocks.append(Block(text, held_at.above, held_at.main, held_at.outer, held_at.named, held_at.inherited))
            held = []

    def say(text: str) -> None:
        nonlocal held_at
        if not stack[-1].noise and text:
            if not held:
                held_at = stack[-1]
                for node in reversed(stack):  # a block belongs to its block element
                    held_at = node
                    if node.tag not in INLINE:
                        break
            held.append(text)

    at = 0
    while True:
        m = TAG.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE and tag != "br":
            flush()
        if tag == "br":
            say(" ")
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # A paragraph's end must not close what stands around it, nor an inline end a block.
            if depth and not (tag in INLINE and any(n.tag not in INLINE for n in stack[depth:])):
                del stack[depth:]
            continue
        if tag in CLOSED_BY:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag in ("dt", "dd") and stack[i].tag in ("dt", "dd")) or (
                        tag in ("td", "th") and stack[i].tag in ("td", "th")):
                    del stack[i:]
                    break
                if stack[i].tag in CLOSED_BY[tag] or (tag == "p" and stack[i].tag not in INLINE):
                    break
        elif tag not in INLINE and tag not in VOID:  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        style, words, main, hidden = named(m[3]) if m[3] else ("", set(), False, False)
        up = stack[-1]
        main = up.main or main or tag in ("article", "main")
        begins = main and not up.main
        bad = not begins and tag not in ("html", "body") and bool(noise_names(words) - (HEADERS if up.main else set()))
        noise = up.noise or hidden or tag in NOISE_TAGS or (tag == "header" and not up.main)
        if tag in ("html", "body") and not hidden:
            noise = False
        if not up.noise and not noise and not bad:
            kids = children[up.key]
            if not kids or kids[-1] != tag:
                kids.append(tag)
        if tag in VOID:
            continue
        key = xxhash.xxh3_64_intdigest(f"{tag} {style}", up.key & 0xFFFFFFFFFFFFFFFF)
        key -= (key >> 63) << 64
        if tag in RAW:
            end = RAW[tag].search(source, at)
            at = end.end() if end else len(source)
            continue
        above = (*up.above, key)
        named_ = () if begins else (*up.named, key) if bad else up.named
        stack.append(Node(tag, key, main, noise, above, up.outer if main else above, named_, up.inherited or (begins and bool(up.named))))
    flush()
    return Page(kept(blocks), children)


def features(page: Page) -> set[tuple[int, bool, int]]:
    """(node, is style, feature) of one page: each node's layout, and the texts at and below it."""
    out = set()
    for block in page.blocks:
        said = xxhash.xxh3_64_intdigest(block.text) - (1 << 63)
        for key in block.path:
            out.add((key, False, said))
            out.add((key, True, xxhash.xxh3_64_intdigest(" ".join(page.children.get(key, ()))) - (1 << 63)))
    return out


def cut(page: Page, low: set[int], most: float = 0.5) -> list[str]:
    """The texts that stay when the branches in ``low`` go, outermost first; marked articles stay whole."""
    blocks = page.blocks
    total = sum(len(b.text) for b in blocks)
    size: dict[int, int] = defaultdict(int)
    for b in blocks:
        for key in b.path:
            size[key] += len(b.text)
    gone = {key for key in low if size.get(key, 0) <= most * total}
    return [b.text for b in blocks if gone.isdisjoint(b.outer)] if gone else [b.text for b in blocks]


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def importance(pages: DataFrame, decay: float = 0.9, copies: bool = True) -> DataFrame:
    """host, node, pages, importance of the style tree of each host, from all of its pages (host, html).

    (1 - decay^l) * presentation + decay^l * content, where l is the number of layouts of the node, both entropies
    are to the base of its number of pages, and a text that c of m pages have adds 1 - log c / log m.
    Without ``copies``, pages of a host with the same features count as one.
    Counts are combined before the shuffle, and keys hold node and feature, so a hot host is many keys.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in sliced(batch, "html"):
                found = [features(parse(source or "")) for source in part.column("html").to_pylist()]
                columns = list(zip(*(f for fs in found for f in fs))) or [()] * 3
                kinds = {"node": pa.int64(), "is_style": pa.bool_(), "feature": pa.int64()}
                rows = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds.values())], names=list(kinds))
                ends = pa.array(list(accumulate(map(len, found), initial=0)), pa.int32())
                digests = [xxhash.xxh3_128_digest(repr(sorted(fs))) for fs in found]
                yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, rows)],
                                                 names=["host", "page", "features"])

    found = pages.mapInArrow(run, "host string, page binary, features array<struct<node: long, is_style: boolean, feature: long>>")
    if not copies:
        found = found.groupBy("host", "page").agg(F.first("features").alias("features"))
    said = found.select("host", F.inline("features"))
    n = F.col("n").cast("double")
    counted = (said
               .groupBy("host", "node", "is_style", "feature").agg(F.count("*").alias("n"))
               .groupBy("host", "node").agg(
                   F.sum(F.when(F.col("is_style"), n)).alias("pages"),
                   F.sum(F.when(F.col("is_style"), 1)).alias("layouts"),
                   F.sum(F.when(F.col("is_style"), n * F.log(n))).alias("style_logs"),
                   F.sum(F.when(~F.col("is_style"), n)).alias("texts"),
                   F.sum(F.when(~F.col("is_style"), n * F.log(n))).alias("text_logs")))
    base = F.log("pages")
    presentation = (base - F.col("style_logs") / F.col("pages")) / base
    content = 1 - F.col("text_logs") / F.col("texts") / base
    weight = F.pow(F.lit(decay), F.col("layouts"))
    value = F.when(F.col("pages") > 1, (1 - weight) * presentation + weight * content).otherwise(1.0)
    return counted.select("host", "node", F.col("pages").cast("long").alias("pages"), value.alias("importance"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               threshold: float = 0.2, least_pages: int = 20) -> DataFrame:
    """page_id, url, text: the main blocks in page order, joined by line breaks.

    A node's importance is drawn towards 1 as if some more pages had it, each all different, beside the m that do: so many
    that a node without any importance is cut from ``least_pages`` different pages on. The fewer, the less is cut.

    The low nodes of a host are one row beside its pages; that table is written, so the optimizer knows its size
    and sends it to all tasks or joins by host, splitting a host with very many pages.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"),
                        F.col(html_col).alias("html"))
    more = least_pages * threshold / (1 - threshold)
    drawn = (F.col("pages") * F.greatest("importance", F.lit(0.0)) + more) / (F.col("pages") + more)
    low = written(importance(rows.select("host", "html"), copies=False)
                  .filter(drawn <= threshold + 1e-9)
                  .groupBy("host").agg(F.collect_list("node").alias("low")), "style-tree")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in sliced(batch, "html"):
                texts = ["\n".join(cut(parse(source or ""), set(low or ())))
                         for source, low in zip(part.column("html").to_pylist(), part.column("low").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"
    return rows.join(low, "host", "left").select("page_id", "url", "html", "low").mapInArrow(run, kind)
