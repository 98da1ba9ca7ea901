"""Main text of web pages by wrappers inferred per host.

A page becomes a stream of tags and text slots; neighbouring alike elements fold into one repeated
group. Pages of one host are aligned one after the other: what both have stays, differing strings
become slots, what only one has becomes optional. The result, a regular expression without unions,
is the host's wrapper. Its slots carry how much text passed through them, and the element that
holds the article is read off from these; pages are then cut by the wrapper of their host.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import slices, stage

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PIECES = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select tbody thead tfoot tr".split())
NOISE_TAGS = frozenset("nav header footer aside form head button select menu dialog object".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay popup promo promoted"
    " recommended related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE_TAGS = ("article", "main")
ROOT = "#"
DEEPEST = 150
"""Elements below this depth count as children of the element at it."""
HELD_HOSTS = 2000


def events(page: str) -> Iterator[tuple[int, str, str]]:
    """(1, tag, attributes) at an opening, (-1, tag, '') at a closing, (0, '', text) in between; always balanced.

    Elements left open are closed where HTML implies it, at the end of their parent or of the page.
    """
    stack: list[str] = []
    at = 0
    for match in TOKEN.finditer(page):
        if match.start() > at:
            yield 0, "", page[at : match.start()]
        at = match.end()
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["close"]:
            if tag in stack:
                while True:
                    top = stack.pop()
                    yield -1, top, ""
                    if top == tag:
                        break
            elif tag in ("p", "br"):
                yield 1, tag, ""
                yield -1, tag, ""
            continue
        if tag in CLOSES_PARAGRAPH and "p" in stack:
            while (top := stack.pop()) != "p":
                yield -1, top, ""
            yield -1, "p", ""
        elif tag in SIBLINGS:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] in SIBLINGS[tag]:
                    while len(stack) > depth:
                        yield -1, stack.pop(), ""
                    break
                if stack[depth] in SCOPES and stack[depth] not in SIBLINGS[tag]:
                    break
        yield 1, tag, match["attrs"] or ""
        if tag in VOID or (match["attrs"] or "").endswith("/") and tag not in CLOSES_PARAGRAPH and tag not in INLINE:
            yield -1, tag, ""
        else:
            stack.append(tag)
    if at < len(page):
        yield 0, "", page[at:]
    while stack:
        yield -1, stack.pop(), ""


NAMED, HIDDEN = 1, 2


def described(tag: str, attributes: str) -> tuple[str, int]:
    """The element's label, tag and classes, and whether it is noise: by its tag or names (NAMED) or being hidden (HIDDEN).

    A name is noise when all of its words are: ``cookie-notice`` is, ``no-sidebar`` and ``article-header`` are not.
    """
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, NAMED * (tag in NOISE_TAGS)
    noise, classes = NAMED * (tag in NOISE_TAGS), ""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden":
            noise = HIDDEN
        else:
            if not noise and tag not in ("html", "body", *ARTICLE_TAGS):
                noise = NAMED * any(NOISE_NAMES.issuperset(words) for part in value.split() if (words := PIECES.findall(part)))
            if name == "class":
                classes = "." + ".".join(value.split())
    return tag + classes, noise


def described_events(page: str) -> list[tuple[int, str, str, int]]:
    """(kind, tag, label or text, noise) of every event.

    An element that is noise by tag or name is none when a main element is in it, or an article and
    the page has none outside of noise.
    """
    found: list[tuple[int, str, str, int]] = []
    path: list[int] = []
    around: list[int] = []
    holds: dict[int, bool] = {}
    hidden, outside = 0, False
    for kind, tag, text in events(page):
        noise = 0
        if kind == 1:
            text, noise = described(tag, text)
            if noise == NAMED:
                around.append(len(found))
            hidden += noise == HIDDEN
            path.append(noise)
            if tag in ARTICLE_TAGS and not hidden:
                outside |= not around
                for k in around:
                    holds[k] = holds.get(k, False) or tag == "main"
        elif kind == -1:
            closed = path.pop()
            hidden -= closed == HIDDEN
            if closed == NAMED:
                around.pop()
        found.append((kind, tag, text, noise))
    for k, main in holds.items():
        if main or not outside:
            found[k] = (*found[k][:3], 0)
    return found


# A wrapper node is [label, optional, repeated, slot chars, children]; a text slot has the label "".
Node = list


def page_tree(page: str) -> Node:
    """The page as a wrapper of its own: noise left out, alike neighbours folded into repeated groups."""
    root: Node = [ROOT, 0, 0, 0, []]
    path, skipped = [root], []
    for kind, tag, text, noise in described_events(page):
        if kind == 0:
            if not skipped and (size := len(text.strip())):
                children = path[-1][4]
                if children and children[-1][0] == "":
                    children[-1][3] += size
                else:
                    children.append(["", 0, 0, size, []])
        elif kind == 1:
            if skipped:
                skipped.append(tag)
                continue
            if noise:
                skipped.append(tag)
            elif tag in INLINE or tag in VOID or len(path) > DEEPEST:
                path.append(path[-1])
            else:
                node: Node = [text, 0, 0, 0, []]
                path[-1][4].append(node)
                path.append(node)
        elif skipped:
            skipped.pop()
        else:
            node = path.pop()
            if node is not path[-1]:
                folded(path[-1][4])
    return root


def folded(children: list[Node]) -> None:
    """Fold the last child into its left neighbour when both are the same element."""
    if len(children) > 1 and children[-1][0] == children[-2][0]:
        last = children.pop()
        children[-1] = merged(children[-1], last)
        children[-1][2] = 1


def merged(a: Node, b: Node) -> Node:
    return [a[0], a[1] | b[1], a[2] | b[2], a[3] + b[3], aligned(a[4], b[4]) if a[4] or b[4] else []]


def aligned(left: list[Node], right: list[Node]) -> list[Node]:
    """Align two sequences: common parts merge, the rest becomes optional, alike neighbours fold."""
    if [n[0] for n in left] == [n[0] for n in right]:
        return [merged(a, b) for a, b in zip(left, right)]
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = best[i + 1][j + 1] + 1 if left[i][0] == right[j][0] else 0
            best[i][j] = max(same, best[i + 1][j], best[i][j + 1])
    out: list[Node] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and left[i][0] == right[j][0] and best[i][j] == best[i + 1][j + 1] + 1:
            node = merged(left[i], right[j])
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            node = [left[i][0], 1, *left[i][2:]]
            i += 1
        else:
            node = [right[j][0], 1, *right[j][2:]]
            j += 1
        out.append(node)
        folded(out)
    return out


def expression(node: Node) -> str:
    """The wrapper as a union-free regular expression: ``#`` is a text slot."""
    label = node[0]
    inner = "#" if label == "" else " ".join(expression(c) for c in node[4])
    body = inner if label in ("", ROOT) else f"<{label}> {inner} </{label.split('.')[0]}>" if inner else f"<{label}/>"
    return f"({body})+" if node[2] and not node[1] else f"({body})*" if node[2] else f"({body})?" if node[1] else body


def article_path(wrapper: Node) -> str:
    """Path of the element that holds the article: the article or main element with most text, else the
    deepest one that still holds four fifths of the text."""
    volume: dict[int, int] = {}

    def weigh(node: Node) -> int:
        volume[id(node)] = node[3] + sum(weigh(c) for c in node[4])
        return volume[id(node)]

    weigh(wrapper)
    found: list[tuple[int, int, str]] = []

    def seek(node: Node, path: str) -> None:
        for child in node[4]:
            if child[0]:
                own = f"{path}/{child[0]}"
                if child[0].split(".")[0] in ARTICLE_TAGS:
                    found.append((ARTICLE_TAGS.index(child[0].split(".")[0]), -volume[id(child)], own))
                seek(child, own)

    seek(wrapper, "")
    if found and -min(found)[1] > 0:
        return min(found)[2]
    node, path = wrapper, ""
    while True:
        heavy = [c for c in node[4] if c[0] and not c[2] and volume[id(c)] * 5 >= volume[id(wrapper)] * 4 > 0]
        if not heavy:
            return path
        node, path = heavy[0], f"{path}/{heavy[0][0]}"


def page_text(page: str, region: str | None) -> str:
    """The text inside the wrapper's region; where the page lacks it, inside its articles, else of the whole page."""
    texts: dict[str, list[str]] = {"region": [], "article": [], "page": []}
    found = {"region": False, "article": False, "page": True}
    inside = {"region": 0, "article": 0}
    path: list[str] = []
    opened: list[tuple[bool, bool]] = []
    skipped = 0
    for kind, tag, text, noise in described_events(page):
        if kind == 0:
            if not skipped:
                texts["page"].append(text)
                for name, depth in inside.items():
                    if depth:
                        texts[name].append(text)
            continue
        if tag not in INLINE and not skipped:
            texts["page"].append("\n")
            for name, depth in inside.items():
                if depth:
                    texts[name].append("\n")
        if kind == 1:
            if skipped:
                skipped += 1
                continue
            if noise == NAMED and region:
                # An element on the way to the region is no noise, whatever this page names it.
                own = "/" + "/".join(p for p in (*path, text) if p)
                noise *= own != region and not region.startswith(own + "/")
            if noise:
                skipped = 1
                continue
            if tag in INLINE or tag in VOID or len(opened) >= DEEPEST:
                opened.append((False, False))
                path.append("")
                continue
            path.append(text)
            hit = bool(region) and "/" + "/".join(p for p in path if p) == region
            article = tag in ARTICLE_TAGS
            opened.append((hit, article))
            inside["region"] += hit
            inside["article"] += article
            found["region"] |= hit
            found["article"] |= article
        elif skipped:
            skipped -= 1
        else:
            path.pop()
            hit, article = opened.pop()
            inside["region"] -= hit
            inside["article"] -= article
    chosen = next(name for name in ("region", "article", "page") if found[name])
    return " ".join(html.unescape("".join(texts[chosen])).split())


def _host(column: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"://([^/?#]*)", 1))


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, n_pages, wrapper, expression, region``: one wrapper per host from all of its pages.

    Tasks align the pages they read; their wrappers, one per task and host, are aligned in two
    rounds, so a hot host is spread by a salt before its last step. Null and empty pages align as
    pages without elements.
    """

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flushed() -> pa.RecordBatch:
            rows = [(h, n, json.dumps(w)) for h, (n, w) in held.items()]
            held.clear()
            return pa.record_batch(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["host", "n_pages", "wrapper"]
            )

        for whole in batches:
            for batch in slices(whole, html_col):
                for host, page in zip(batch.column("host").to_pylist(), batch.column(html_col).to_pylist()):
                    tree = page_tree(page or "")
                    known = held.get(host)
                    held[host] = [1, tree] if known is None else [known[0] + 1, merged(known[1], tree)]
                if len(held) > HELD_HOSTS:
                    yield flushed()
        yield flushed()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, pages_seen, tree = None, 0, None

        def row() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([host]), pa.array([pages_seen]), pa.array([json.dumps(tree)]), pa.array([expression(tree)]), pa.array([article_path(tree)])],
                names=["host", "n_pages", "wrapper", "expression", "region"],
            )

        for batch in batches:
            for name, n, text in zip(*(batch.column(c).to_pylist() for c in ("host", "n_pages", "wrapper"))):
                if tree is not None and name != host:
                    yield row()
                    tree, pages_seen = None, 0
                part = json.loads(text)
                host, pages_seen, tree = name, pages_seen + n, part if tree is None else merged(tree, part)
        if tree is not None:
            yield row()

    schema = "host string, n_pages long, wrapper string, expression string, region string"
    partial = pages.select(_host(url_col).alias("host"), html_col).mapInArrow(infer, "host string, n_pages long, wrapper string")
    salted = partial.withColumn("salt", F.spark_partition_id() % 32).repartition("host", "salt").drop("salt")
    return salted.sortWithinPartitions("host").mapInArrow(joined, schema).repartition("host").sortWithinPartitions("host").mapInArrow(joined, schema)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every page: the article's text by the wrapper of its host.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments and hidden
    parts are left out, by tag, or by class, id and role. Text is unescaped, white space becomes one
    space, blocks are joined by one space. A null or empty page, or one without text, gives an empty
    text. Pages without a host share the wrapper of the empty host. Repeated rows give equal rows;
    null ids and URLs pass through; other columns are not read; an empty table gives an empty result.
    """
    wrappers = stage(host_wrappers(pages, url_col, html_col).select("host", "region"), "wrappers")
    schema = pages.schema
    kinds = [schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_html"):
                texts = [page_text(p or "", r) for p, r in zip(batch.column("_html").to_pylist(), batch.column("region").to_pylist())]
                yield pa.record_batch(
                    [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), _host(url_col).alias("host"))
    return rows.join(wrappers, "host", "left").mapInArrow(cut, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
