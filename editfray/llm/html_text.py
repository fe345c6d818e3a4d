"""HTML extraction by tag-path ratios.

A page is read as blocks, each at a path: the tags, class names and ids from the root
to it. Text length and punctuation are aggregated by path, so that one long paragraph speaks
for its short kin; the ratios are smoothed over neighbours in page order, fused, and shifted by a
prior: what its tag, role or name marks as something else counts for less. Paths
at or over a threshold that follows the scores' deviation are the content, whatever their marks. The innermost
container around most of it completes it with what stands there beside: headings, short lists and the like; of that, marked frames go
that hold no content path. Page navigation and footers, by their elements, reader comments, which are as long and as well punctuated as articles, and what is hidden are left out by their marks alone.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, quoted, table

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noframes".split())
CONTAINER = frozenset("html body div section article main center table tbody tr td form".split())
#: Elements that end the open one of their kind, and what keeps them from doing so: kind by tag, and kinds that a tag begins anew.
ENDS = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
BEGINS = {x: (0,) for x in "div section article main body td th".split()} | {x: (0, 1, 2, 3, 4, 5) for x in "ul ol dl table select".split()} | {"tr": (4,)}
# Elements, roles and words of class names and ids of what is no article.
OTHER_TAGS = frozenset("head nav footer button select dialog menu".split()) | RAW
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "sidebar sidenav widget widgets toolbar masthead topbar footer bottombar colophon copyright cookie cookies consent gdpr notice notices popup modal overlay "
    "sharing subscribe newsletter signup login searchbox skip".split()
)
#: Words that articles use for parts of their own, too.
DOUBTFUL_WORDS = frozenset("banner rail header alert discussion share social follow subscription related recommended recommendations teaser trending popular search hidden".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
QUOTE_WORDS = frozenset("pullquote quote".split())
#: Elements whose names say what all of them is: a paragraph's or a heading's may be those of its subject.
FRAMES = frozenset("div section article aside header footer ul ol dl table form fieldset main figure iframe center".split())
CONTROLS = frozenset("input select textarea button".split())
_TAG = re.compile(r"<(?:/(?P<end>[a-zA-Z][^\s/>]*)[^>]*|(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^\"'>]|\"[^\"]*\"|'[^']*')*+)|(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)|[!?][^>]*)>")
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

#: Marks, and what a score counts for under each. A page's comments and what is hidden aren't scored.
PLAIN, DOUBTFUL, OTHER, STRUCTURE, COMMENTS, HIDDEN = range(6)
PRIOR = (1.0, 0.5, 0.2, 0.1, 0.0, 0.0)


def _named(tag: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """The label of an element in its path, and how it is marked as no part of an article."""
    found = STRUCTURE if tag in OTHER_TAGS or (tag in ("header", "aside") and not in_article) else OTHER if tag == "aside" else PLAIN
    names = _NAMES.findall(attributes) if attributes else ()
    label, whole = [tag], tag in ("html", "body", "main", "h1")
    for name, value in names:
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            parts = sorted({x.lower() for x in _PART.findall(value)})
            label.append(("#" if name == "id" else ".") + "-".join(parts))
            if whole:
                continue
            if tag == "aside" and not QUOTE_WORDS.isdisjoint(parts):
                found = PLAIN
            if tag in FRAMES and not COMMENT_WORDS.isdisjoint(parts):
                found = max(found, COMMENTS)
            elif not OTHER_WORDS.isdisjoint(parts):
                found = max(found, OTHER)
            elif tag in FRAMES and not DOUBTFUL_WORDS.isdisjoint(parts):
                found = max(found, DOUBTFUL)
        elif tag in ("html", "body", "form"):
            continue
        elif (name == "hidden" or (name == "aria-hidden" and value == "true")) or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            found = HIDDEN
        elif name == "role" and value.lower() in OTHER_ROLES:
            found = max(found, STRUCTURE)
    return "".join(label), found


@dataclass
class Page:
    """Elements in page order, each after its parent, in parallel lists; 0 is the root. blocks: element, text, and how much of it is links.

    A path is a number for its parent's path and the element's own label: nothing here grows with the depth."""

    tag: list[str] = field(default_factory=lambda: ["#"])
    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[int] = field(default_factory=lambda: [0])
    marked: list[int] = field(default_factory=lambda: [0])
    article: list[bool] = field(default_factory=lambda: [False])
    controls: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def up(self, of: list) -> list:
        """Sums over what each element holds, itself included."""
        out = list(of)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def down(self, f) -> list:
        """f(element, what its parent has) for each element, the root first (with None)."""
        out = [f(0, None)]
        for i in range(1, len(self.tag)):
            out.append(f(i, out[self.parent[i]]))
        return out


def read_page(page: str) -> Page:
    """The page in one pass: no search for an end goes over the same text twice, and no step walks up all open elements."""
    out = Page()
    paths: dict[tuple[int, str], int] = {}
    stack, open_tags = [0], {"#": 1}
    #: For each open element the level of the open one of each kind of ENDS, 0 for none; shared with its parent where nothing changes.
    near = [(0,) * 6]
    held: list[str] = []
    links = depth = 0
    endless: set[str] = set()  # ends that the rest of the page doesn't have

    def flush():
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.blocks.append((stack[-1], text, links))
            held.clear()
        links = 0

    def add(raw: str):
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if depth:
                links += len(text.strip())

    def close(level: int):
        while len(stack) > level:
            open_tags[out.tag[stack.pop()]] -= 1
            near.pop()

    def end_of(end: str, start: int) -> int:
        at = -1 if end in endless else page.find(end, start)
        if at < 0:
            endless.add(end)
        return at

    at, last = 0, page.rfind(">")
    while (start := page.find("<", at)) >= 0 and start < last:
        if page.startswith("<!--", start):
            add(page[at:start])
            end = end_of("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", start) and (end := end_of("]]>", start + 9)) >= 0:
            add(page[at:start])
            held.append(page[start + 9 : end])
            at = end + 3
            continue
        m = _TAG.match(page, start)
        if not m:
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        at = m.end()
        if tag := m["end"]:
            tag = tag.lower()
            if tag in INLINE:
                depth = max(0, depth - 1) if tag == "a" else depth
                continue
            flush()
            if open_tags.get(tag):
                while out.tag[stack[-1]] != tag:
                    close(len(stack) - 1)
                close(len(stack) - 1)
                depth = 0
        elif tag := m["tag"] or m["tag2"]:
            tag = tag.lower()
            rest = m["rest"] if m["tag"] else m["rest2"]
            if tag in CONTROLS:
                out.controls[stack[-1]] += 1
            if tag == "br":
                held.append("\n")
                continue
            if tag in INLINE:
                depth += tag == "a"
                continue
            if tag in RAW:
                if not rest.rstrip().endswith("/") or tag in ("script", "style"):
                    end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    if end:
                        at = end.end()
                    else:
                        endless.add(tag)
                        at = len(page) if tag in ("script", "style", "textarea", "title") else at
                if tag != "svg" and tag != "math":
                    flush()
                continue
            flush()
            if tag in VOID:
                continue
            if near[-1][0]:
                close(near[-1][0])
            if tag in ENDS and near[-1][ENDS[tag]]:
                close(near[-1][ENDS[tag]])
            here = stack[-1]
            label, marked = _named(tag, rest, out.article[here])
            out.tag.append(tag)
            out.parent.append(here)
            out.marked.append(marked)
            out.article.append(out.article[here] or tag in ("article", "main"))
            out.controls.append(0)
            out.path.append(paths.setdefault((out.path[here], label), len(paths) + 1))
            kinds = near[-1]
            if tag in BEGINS or tag in ENDS:
                kinds = list(kinds)
                for k in BEGINS.get(tag, ()):
                    kinds[k] = 0
                if tag in ENDS:
                    kinds[ENDS[tag]] = len(stack)
                kinds = tuple(kinds)
            stack.append(len(out.tag) - 1)
            near.append(kinds)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            depth = 0
    rest = page[at:]
    add(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    flush()
    return out


def marks(page: Page) -> list[int]:
    """For each element the gravest mark of what it stands in, itself included.

    A name says nothing of a frame that holds most of the page's text beside comments ("has-sidebar", or a form around all), nor does a doubtful one, or one of comments, of a frame with the
    heading; forms and field sets are marked where they have controls."""
    n = len(page.tag)
    headed = page.up([int(x == "h1") for x in page.tag])
    own = [PLAIN if headed[i] and m in (COMMENTS, DOUBTFUL) else m for i, m in enumerate(page.marked)]
    unseen = page.down(lambda i, above: bool(above) or own[i] >= COMMENTS)
    text = [0] * n
    for e, t, links in page.blocks:
        text[e] += 0 if unseen[e] else max(0, len(t) - links)
    inside, controls = page.up(text), page.up(page.controls)
    for i in range(1, n):
        if own[i] == PLAIN and page.tag[i] in ("form", "fieldset") and controls[i]:
            own[i] = OTHER
        if own[i] < STRUCTURE and 2 * inside[i] > inside[0]:
            own[i] = PLAIN
    return page.down(lambda i, above: max(own[i], above or PLAIN))


def menus(page: Page) -> list[bool]:
    """For each element, whether it stands in a list or table of links, whatever its names."""
    held = page.down(lambda i, above: i if page.tag[i] in ("ul", "ol", "table") else -1 if above is None else above)
    sums: dict[int, list[int]] = {}
    for e, text, links in page.blocks:
        if held[e] >= 0:
            s = sums.setdefault(held[e], [0, 0])
            s[0] += len(text)
            s[1] += links
    found = {k for k, (n, linked) in sums.items() if linked > 0.6 * n}
    return page.down(lambda i, above: bool(above) or i in found)


def path_sums(page: Page, prior: list[float]) -> dict[tuple[int, float], tuple[int, int, int]]:
    """Of each path, and prior where one path has several: length of text that is no link, punctuation, and blocks."""
    sums: dict[tuple[int, float], tuple[int, int, int]] = {}
    for e, text, links in page.blocks:
        key = page.path[e], prior[e]
        a, b, c = sums.get(key, (0, 0, 0))
        sums[key] = a + max(0, len(text) - links), b + len(_PUNCTUATION.findall(text)), c + 1
    return sums


def _smooth(x: np.ndarray) -> np.ndarray:
    y = np.pad(x, 1, mode="edge")
    return 0.25 * y[:-2] + 0.5 * y[1:-1] + 0.25 * y[2:]


def path_scores(page: Page, prior: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """For each block the number of its path, and the score of each path: the mean of its blocks' smoothed, fused and weighed ratios."""
    sums = path_sums(page, prior)
    place = {key: k for k, key in enumerate(sums)}
    of = np.array([place[page.path[e], prior[e]] for e, _, _ in page.blocks])
    ratios = np.array([(a / c, b / c, w) for (_, w), (a, b, c) in sums.items()])
    if not (ratios[:, 0] * ratios[:, 2]).any():  # an article of links alone
        ratios[:, 0] = np.bincount(of, weights=[len(text) for _, text, _ in page.blocks]) / np.bincount(of)
    fused = _smooth(ratios[of, 0]) * (0.5 + np.sqrt(_smooth(ratios[of, 1]))) * ratios[of, 2]
    return of, np.bincount(of, weights=fused) / np.bincount(of)


def content_paths(scores: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which paths are content: those at the deviation of all blocks' scores, or at half of the highest, if that is less."""
    least = min(scores[of].std(), scores.max() / 2)
    return (scores >= least) & (scores > 0)


#: A container is completed where its content is at least this share of it: what the ratios leave out is what stands beside, not the rest of a page.
COMPLETE = 0.15


def extract(page: str | None) -> str:
    """The article's text: its blocks, joined by a line feed."""
    tree = read_page(page or "")
    if not tree.blocks:
        return ""
    mark = marks(tree)
    of, scores = path_scores(tree, [PRIOR[m] for m in mark])
    chosen = content_paths(scores, of)[of]
    return "\n".join(text for (e, text, _), k in zip(tree.blocks, selected(tree, mark, chosen), strict=True) if k and mark[e] < STRUCTURE)


def selected(tree: Page, mark: list[int], chosen) -> list[bool]:
    """Of each block whether it is of the article: what is chosen, and what completes it."""
    # The innermost container with most of the content, which counts as its prior lets it.
    weight, whole = [0.0] * len(tree.tag), [0.0] * len(tree.tag)
    for (e, text, _), c in zip(tree.blocks, chosen, strict=True):
        weight[e] += len(text) * PRIOR[mark[e]] if c and mark[e] < STRUCTURE else 0
        whole[e] += len(text) if c or mark[e] == PLAIN else 0
    weight, whole = tree.up(weight), tree.up(whole)
    best = [0] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        if weight[i] > (weight[best[tree.parent[i]]] if best[tree.parent[i]] else 0):
            best[tree.parent[i]] = i
    top = 0
    if not weight[0]:
        return [False] * len(tree.blocks)
    while (inner := best[top]) and tree.tag[inner] in CONTAINER and weight[inner] >= 0.7 * weight[0]:
        top = inner
    # The whole of the article that it stands in.
    while tree.article[top] and tree.tag[top] not in ("article", "main"):
        top = tree.parent[top]
    if weight[top] < COMPLETE * whole[top]:
        return [bool(c) for c in chosen]
    # A doubtful name is none on a frame with content in it.
    doubt = tree.down(lambda i, above: i if tree.marked[i] == DOUBTFUL else -1 if above is None else above)
    beside = [mark[e] == PLAIN or (mark[e] == DOUBTFUL and doubt[e] >= 0 and weight[doubt[e]] > 0) for e, _, _ in tree.blocks]
    inside = tree.down(lambda i, above: bool(above) or i == top)
    heading = [k for k, (e, _, _) in enumerate(tree.blocks) if tree.tag[e] == "h1" and beside[k]]
    heads = set() if any(inside[tree.blocks[k][0]] for k in heading) else set(heading)
    if tree.tag[top] in ("#", "html", "body"):
        # The page's root is no choice: what stands before and after the content, or is a list of links, is as well beside the article.
        menu, headings = menus(tree), set(heading)
        spots = [k for k in range(len(tree.blocks)) if chosen[k] or k in headings]
        return [bool(chosen[k]) or (spots[0] <= k <= spots[-1] and beside[k] and not menu[e]) for k, (e, _, _) in enumerate(tree.blocks)]
    # Content outside the container stays, too, unless it is marked, or of another article.
    other = tree.down(lambda i, above: bool(above) or (tree.tag[i] == "article" and not inside[i] and not weight[i] >= weight[top]))
    return [(inside[e] and (bool(c) or beside[k])) or (bool(c) and beside[k] and not other[e]) or k in heads for k, ((e, _, _), c) in enumerate(zip(tree.blocks, chosen, strict=True))]


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row of pages.

    Null and empty pages, and those without an article, give the empty text. Nothing in the
    article is dropped or shortened for its size. Broken markup is read on; what
    is no tag is text. Time and memory of a page are linear in its length, whatever its depth and whatever is never closed.
    Repeated rows stay, null ids and urls as they are; an empty table gives an empty one. Only the named columns are read."""
    kept = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url"), quoted(html_col).alias("html"))

    def make():
        def f(batch):
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return f

    kind = kept.schema["page_id"].dataType.simpleString()
    return arrow_map(kept, make, f"page_id {kind}, url string, text string, n_chars long", "html")


def query(spark, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))
