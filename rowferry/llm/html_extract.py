"""Main text of web pages by a consensus of each host's pages.

Every page scores its own containers by the running text in them and votes for the path of the best one, or of the
article or main element around it, with tags
and class names generalised (numbers dropped). Spark counts the votes of a host, and each page is extracted again from
the containers on the winning path; a page without such a container, or without a host, uses its own best one.

Left out, inside a container too, are navigation, asides, form controls, scripts and styles. A class, id or role that names
a menu, header, footer, notice, advert or form decides only for a part that is small beside the page's text, or
rich in links: what holds most of the text is never left out for its name, nor are an article's headings. Reader comments go
whatever their size. Where no article or main element says so, the container is widened while what stands around it
holds much text as well. Block texts have their character references decoded and white space reduced to single blanks; blocks are
joined by a blank.

Null and empty pages give an empty text. Repeated rows are extracted alike (and vote each), an empty table gives an
empty result, and input columns named like a result column are replaced. Broken markup is read as it comes.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import materialise
from .batches import Measure, with_text_columns

# Names of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th
    thead tr ul""".split())
LEFT_OUT = frozenset("""nav aside footer head script style noscript template iframe svg math canvas object button select label
    textarea input dialog menu audio video""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
ENDS_PARAGRAPH = BLOCKS - {"br", "option", "body", "html"}
# A new one of these ends an open one, unless the scope given begins in between.
ENDED_BY = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar".split())
# Words of class names and ids: of comments, of what is hardly ever text, of what may be text, and those that turn them round.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
PLAIN = frozenset("""ad ads advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies footer gdpr
    masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup sidebar sponsor sponsored""".split())
VAGUE = frozenset("""banner header promo promotion recommended related reply share sharing signup social subscribe subscription
    toolbar widget widgets""".split())
TURNED = frozenset("no non not with without has hoc free".split())

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[|<[!?][^>]*>"
    r"|<(?P<raw>script|style|template|noscript|textarea|iframe|svg|math|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LEVELS = 8

TEXT = T.StructType([T.StructField("text", T.StringType())])
VOTE = T.StructType([T.StructField("path", T.StringType())])


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    path: tuple[str, ...]
    named: int = 0
    """What class, id or tag say: one of `_VAGUE` to `_COMMENT`, or nothing."""
    out: bool = False
    article: bool = False
    """Inside an article or main element, or one itself."""
    text: int = 0
    links: int = 0
    """Characters of text below, and of those in links."""


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, int, str]] = field(default_factory=list)
    """Text runs in page order: node, number of the block, raw text."""


_VAGUE, _VAGUE_ALONE, _PLAIN, _PLAIN_ALONE, _FORM, _COMMENT = range(1, 7)


def _attributes(rest: str) -> dict[str, str]:
    """Attributes one after another, by their whole lower-case names; the first of a name counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), a or b or c)
    return found


def _named(names: str) -> int:
    """What the most telling of some class names and ids says."""
    most = 0
    for name in names.split():
        words = [w.lower() for w in _PARTS.findall(name)]
        if not words or not TURNED.isdisjoint(words):
            continue
        if not COMMENTS.isdisjoint(words):
            most = max(most, _COMMENT)
        elif not PLAIN.isdisjoint(words):
            most = max(most, _PLAIN_ALONE if PLAIN.issuperset(words) else _PLAIN)
        elif not VAGUE.isdisjoint(words):
            most = max(most, _VAGUE_ALONE if VAGUE.issuperset(words) else _VAGUE)
    return most


def parse(page: str) -> Page:
    """Elements and text runs of a page; raw elements such as scripts are passed over."""
    result = Page()
    nodes = result.nodes
    nodes.append(Node("", -1, ()))
    stack, block, at = [0], 0, 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            result.runs.append((stack[-1], block, page[at:m.start()]))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, rest = tag.lower(), m["rest"] if m["tag"] else m["rest2"]
        if tag in BLOCKS:
            block += 1
        if m["end"] or m["end2"]:
            _close(nodes, stack, tag)
            continue
        if tag in ENDS_PARAGRAPH:
            _end(nodes, stack, {"p"}, {"table", "td", "button"})
        if tag in ENDED_BY:
            _end(nodes, stack, *ENDED_BY[tag])
        parent = stack[-1]
        node = Node(tag, parent, nodes[parent].path)
        _describe(nodes, node, rest)
        nodes.append(node)
        if tag not in VOID and not rest.endswith("/"):
            stack.append(len(nodes) - 1)
    if at < len(page):
        result.runs.append((stack[-1], block, page[at:]))
    _settle(result)
    return result


def _describe(nodes: list[Node], node: Node, rest: str) -> None:
    given = _attributes(rest) if rest.strip() else {}
    names, role = given.get("class", ""), given.get("role", "").strip().lower()
    step = node.tag
    if names and node.tag in CONTAINERS:
        step += "." + ".".join(sorted({re.sub(r"\d+", "", c) for c in names.split()} - {""}))
    if node.tag in CONTAINERS or node.tag in ("html", "ul", "ol", "table"):
        path = nodes[node.parent].path
        node.path = path if path[-1:] == (step,) else (*path[1 - _LEVELS:], step)
    inside = nodes[node.parent].article
    node.article = inside or node.tag in ("article", "main")
    node.out = nodes[node.parent].out or node.tag in LEFT_OUT or "hidden" in given or role in ROLES or (
        node.tag == "header" and not inside)
    named = _named(f"{names} {given.get('id', '')}")
    if node.tag == "form" or role == "form":
        named = max(named, _FORM)
    if node.tag in ("html", "body", "main") or (node.tag == "article" and named != _COMMENT) or (node.tag in HEADINGS and inside):
        named = 0
    node.named = named


def _close(nodes: list[Node], stack: list[int], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if nodes[stack[k]].tag == tag:
            del stack[k:]
            return
        if nodes[stack[k]].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
            return  # a stray end tag does not close what holds the page together


def _end(nodes: list[Node], stack: list[int], tags: set[str], scopes: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        tag = nodes[stack[k]].tag
        if tag in tags:
            del stack[k:]
            return
        if tag in scopes or tag in CONTAINERS:
            return


def _settle(page: Page) -> None:
    """Decides which of the named parts are left out, from the text in them; so is all below them."""
    nodes = page.nodes
    linked = [False] * len(nodes)
    for k, node in enumerate(nodes):
        linked[k] = node.tag == "a" or (node.parent >= 0 and linked[node.parent])
    for k, _, raw in page.runs:
        if not nodes[k].out:
            size = 0 if raw.isspace() else len(raw)
            nodes[k].text += size
            nodes[k].links += size if linked[k] else 0
    for node in reversed(nodes[1:]):
        nodes[node.parent].text += node.text
        nodes[node.parent].links += node.links
    holds = _holders(nodes)
    for k, node in enumerate(nodes):
        node.out = node.out or (node.parent >= 0 and nodes[node.parent].out) or (
            node.named > 0 and k not in holds and _is_beside(node, nodes[0].text))


def _holders(nodes: list[Node]) -> set[int]:
    """What stands around an article or main element that is in no other one and is no comment."""
    holds: set[int] = set()
    for node in nodes:
        up = node.parent
        if node.tag in ("article", "main") and not nodes[up].article and node.named != _COMMENT:
            while up > 0 and up not in holds:
                holds.add(up)
                up = nodes[up].parent
    return holds


def _is_beside(node: Node, total: int) -> bool:
    """Whether a named part is no part of the page's main text."""
    rich = 3 * node.links >= node.text
    small = 4 * node.text <= total
    if node.named == _COMMENT:
        return node.text < total
    if node.named == _PLAIN_ALONE:
        return 10 * node.text <= 9 * total
    if node.named in (_FORM, _PLAIN):
        return small or (rich and 2 * node.text <= total)
    if node.named == _VAGUE_ALONE and not node.article:
        return small or (rich and 2 * node.text <= total)
    return rich and 2 * node.text <= total


def best_path(page: Page) -> str | None:
    """Path of the container with most running text: a block counts for its container, half for the next one up."""
    scores: dict[int, float] = {}
    running = [0] * len(page.nodes)
    linked = {k for k, n in enumerate(page.nodes) if n.tag == "a"}
    inside = _containers(page)
    for node, _, raw in page.runs:
        if page.nodes[node].out:
            continue
        size = len(raw) if not raw.isspace() else 0
        if not size:
            continue
        size = -size if node in linked else size
        running[node] += size
        holder = inside[node]
        for weight in (1.0, 0.5):
            if holder < 0:
                break
            scores[holder] = scores.get(holder, 0.0) + weight * size
            holder = inside[page.nodes[holder].parent]
    top = max(scores.items(), key=lambda s: (s[1], -s[0]), default=None)
    if top is None:
        return None
    for k in range(len(running) - 1, 0, -1):
        running[page.nodes[k].parent] += running[k]
    return "/".join(page.nodes[_whole(page, inside, top[0], running)].path)


def _whole(page: Page, inside: list[int], holder: int, running: list[int]) -> int:
    """The outermost article around a container, else the outermost main element; else what a quotation stands in, and
    what holds a third as much running text again around the container."""
    found: dict[str, int] = {}
    up = holder
    while up > 0:
        if page.nodes[up].tag in ("article", "main"):
            found[page.nodes[up].tag] = up
        up = page.nodes[up].parent
    up = inside[page.nodes[holder].parent]
    while up >= 0 and not found:
        if page.nodes[holder].tag == "blockquote" or 3 * (running[up] - running[holder]) >= running[holder]:
            holder = up
        up = inside[page.nodes[up].parent]
    return found.get("article", found.get("main", holder))


def _containers(page: Page) -> list[int]:
    """The innermost container around every node, itself included; -1 if none. The last entry serves parent -1."""
    inside: list[int] = []
    for k, node in enumerate(page.nodes):
        inside.append(k if node.tag in CONTAINERS else inside[node.parent] if node.parent >= 0 else -1)
    return [*inside, -1]


def extract(page: Page, path: str | None) -> str:
    """Texts of the blocks inside containers on the path, or anywhere when there is no path."""
    chosen = [path is None] * len(page.nodes)
    for k, node in enumerate(page.nodes):
        chosen[k] = chosen[k] or (node.parent >= 0 and chosen[node.parent]) or (
            node.tag in CONTAINERS and "/".join(node.path) == path)
    if path is not None and not any(chosen):
        return extract(page, best_path(page))
    return " ".join(_blocks(page, chosen))


def _blocks(page: Page, chosen: list[bool]) -> Iterator[str]:
    current, parts = -1, []
    for node, block, raw in page.runs:
        if not chosen[node] or page.nodes[node].out:
            continue
        if block != current and parts:
            yield from _block(parts)
            parts = []
        current = block
        parts.append(raw)
    yield from _block(parts)


def _block(parts: list[str]) -> Iterator[str]:
    text = " ".join(entities.unescape("".join(parts)).split())
    if text:
        yield text


def host_of(url: Column) -> Column:
    """Lower-case host of an address, null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _vote() -> Measure:
    return lambda pages: [pa.array([best_path(parse(p)) for p in pages], pa.string())]


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The path that most pages of a host vote for. Counted per task first, so a large host is no burden."""
    rows = pages.select(host_of(pages[url]).alias("host"), pages[html].alias("_html")).filter("host is not null")
    votes = with_text_columns(rows, "_html", VOTE, _vote, ["host"]).filter("path is not null")
    counts = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    return counts.groupBy("host").agg(F.max(F.struct("n", "path"))["path"].alias("winning_path"))


def _extract_on_paths() -> Measure:
    def apply(rows: list[str]) -> list[pa.Array]:
        texts = []
        for row in rows:
            path, _, page = row.partition("\n")
            texts.append(extract(parsed := parse(page), path or best_path(parsed)))
        return [pa.array(texts, pa.string())]

    return apply


def main_text(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds `text`, the main text of every page."""
    winners = materialise(host_paths(pages, url, html))  # Spark broadcasts it where its size allows
    rows = pages.withColumn("_host", host_of(pages[url])).join(winners.withColumnRenamed("host", "_host"), "_host", "left")
    # The path travels in front of the page; it has no line breaks.
    rows = rows.withColumn("_page", F.concat(F.coalesce("winning_path", F.lit("")), F.lit("\n"), F.coalesce(F.col(html), F.lit(""))))
    kept = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    return with_text_columns(rows, "_page", TEXT, _extract_on_paths, kept)
