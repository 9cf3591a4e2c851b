"""Main text of web pages by tag-path ratios.

Each text of a page lies on a path of tags from the root. Per path, the characters and the punctuation
marks of its texts are added up and divided by the number of texts; both ratios are smoothed over the
paths in page order and fused, and the mean with the path's own figure is taken. Links take from the score, and so do names of boilerplate and elements such
as nav or footer: they are factors of a score, never a bar. Paths above the page's threshold are the core
of the content. The article is the container that holds nearly all of the core (or an article element
that holds a good part of it), with the titles and texts around it that are no links.

Within the article nothing is dropped for being short: titles, cells and list items stay. What goes are
branches without any core that their ratios, names or headings show to be something else: menus (linked,
short, without marks), text that stands in no paragraph, by-lines, and reader comments (under a heading that says so, or as
records of a short first line each). Names that an article may have too (ids made from headings, say)
count only where the links, lengths and marks of what they name speak against it; so does a form.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwise.llm.shared import map_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, and those that end at their own end tag only.
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button option datalist".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an open paragraph cannot hold.
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th")}
SCOPES = frozenset("table ul ol dl article section div body main aside blockquote".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
#: Words in class, id and role that name boilerplate.
NAMES = re.compile(
    r"(?:^|[-_\s\d])(?:ads?|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer|foot|header|masthead|topbar|toolbar|"
    r"comments?|commentlist|respond|replies|disqus|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|"
    r"pagination|pager|skip|search\w*|widget\w*|legal|copyright|disclaimer|complementary|contentinfo|navigation|form)(?:$|[-_\s\d])",
    re.I,
)
#: Those of them that no article gives its own parts as class or role.
SURE = re.compile(
    r"(?:^|[-_\s\d])(?:ads?|advert\w*|adsense|adbox|adslot|sponsor\w*|nav|navbar|menu|breadcrumbs?|sidebar\w*|comments?|commentlist|respond|replies|disqus|cookie\w*|gdpr|"
    r"footer|masthead|topbar|toolbar|popup|modal|overlay|newsletter|signup|login|pagination|pager|complementary|contentinfo|navigation)(?:$|[-_\s\d])",
    re.I,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
SPACES = re.compile(r"\s+")


#: What names of boilerplate leave of a score, and the share of the mean score, by characters, from which on
#: a path is core content.
NAMED, THRESHOLD = 0.001, 0.6
#: Elements that name boilerplate as surely as a class does, and those that are judged by their ratios.
NAMING, JUDGED = frozenset("nav footer aside dialog menu".split()), frozenset(("form",))
#: Elements of which text directly within is no paragraph.
LOOSE = frozenset("div section span center fieldset details summary dir form".split())
#: A heading of reader comments, in the languages of the corpus.
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:reader\s+)?(?:comments?|responses|replies|leave an? (?:reply|comment)|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?\W*", re.I)
SENTENCE = re.compile(r"[.!?…。！？]")


class _Path:
    """A path of tags: its place in the page's list and the one above, and whether a name makes it doubtful."""

    __slots__ = ("above", "at", "doubtful", "named", "prior")

    def __init__(self, at: int, above: _Path | None, sure: bool, doubtful: bool):
        self.at, self.above, self.doubtful = at, above, doubtful
        self.prior = (above.prior if above else 1.0) * (NAMED if sure else 1.0)
        self.named = False


class _Node:
    __slots__ = ("article", "at", "barred", "content", "depth", "dropped", "first", "header", "held", "inside", "last", "link", "links", "marks", "name", "of_text", "parent", "path", "plain", "records", "table", "texts")

    def __init__(self, name: str, path: _Path, parent: _Node | None, barred: bool):
        self.name, self.parent, self.path = name, parent, path
        up = parent or self
        self.depth = up.depth + 1 if parent else 0
        self.barred = barred or parent is not None and up.barred
        self.article = name in ("article", "main") or parent is not None and up.article
        self.link = name == "a" or parent is not None and up.link
        self.of_text = name == "p" or name in HEADINGS or parent is not None and up.of_text
        self.header = name == "header" or parent is not None and up.header
        self.content = self.held = self.plain = 0  # characters: of core paths, of all, and of all that are no links or labels
        self.links = self.marks = self.texts = 0  # of all texts below
        self.inside = self.dropped = self.table = False
        self.at = self.last = 0  # place among the nodes, and that of the last one below
        self.first: tuple[_Node, str] | None = None
        self.records: dict[int, int] = {}  # children that are records, by their path


@dataclass
class Page:
    """The blocks of a page, those of elements that are no text left out: the node that each began in, its
    text, and the characters of it that are links; all nodes and paths, those above before those below."""

    blocks: list[tuple[_Node, str, int]]
    nodes: list[_Node]
    paths: list[_Path]


def is_boilerplate(chars: int, links: int, marks: int, texts: int) -> bool:
    """Whether an element's texts are links for a third, short, or without sentences."""
    return 3 * links >= chars or chars < 25 * texts or 2 * marks < texts


def read_page(page: str) -> Page:
    """Parse a page, in time that is linear in its length."""
    root = _Path(0, None, False, False)
    stack, out, parts, owner, linked = [_Node("", root, None, False)], [], [], None, 0
    nodes, paths, known, opened = [stack[0]], [root], {}, defaultdict(int)
    ends = {name: max((m.start() for m in re.finditer(rf"</{name}", page, re.I)), default=-1) for name in NAMING}

    def flush() -> None:
        nonlocal owner, linked
        text = SPACES.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text and owner is not None:
            out.append((owner, text, min(linked, len(text))))
        owner, linked = None, 0

    def close(names: tuple[str, ...], stops: frozenset) -> None:
        if not any(opened[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                for x in stack[k:]:
                    opened[x.name] -= 1
                del stack[k:]
                return
            if stack[k].name in stops:
                return

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at or m and m["data"]:
            text = page[at:stop] + (m["data"] or "" if m else "")
            if not stack[-1].barred:
                if owner is None and text.strip():
                    owner = stack[-1]
                parts.append(text)
                if stack[-1].link:
                    linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name in BLOCKS:
                flush()
            if opened[name]:
                close((name,), frozenset())
            continue
        attrs = m["attrs"] or ""
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if name in CLOSES_P:
            close(("p",), SCOPES | {"td", "th", "li"})
        if name in SAME:
            close(SAME[name], SCOPES - {"div"} if name not in ("li", "dt", "dd") else frozenset(("ul", "ol", "dl", "table")))
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            continue
        if name in ("article", "main"):  # what is never closed ends here
            for unclosed in [x for x in NAMING if opened[x] and ends[x] < at]:
                close((unclosed,), frozenset())
        label, barred, sure, doubtful = name, name in SILENT, name in NAMING or name == "header" and not stack[-1].article, name in JUDGED
        for key, *values in ATTRIBUTE.findall(attrs):
            key, value = key.lower(), entities.unescape(next(filter(None, values), ""))
            if key in ("class", "id", "role"):
                label += f".{value}" if key == "class" else ""
                if name not in ("html", "body", "article", "main") and not (key == "id" and name in HEADINGS) and (named := NAMES.search(value.replace("header", "") if stack[-1].article else value)):
                    if SURE.search(value) and (key != "id" or named[0] == value):
                        sure, barred = True, barred or name not in BLOCKS  # within a block there is no path to judge
                    else:
                        doubtful = True
                    label += f"#{value}"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or re.search(r"display\s*:\s*none", value):
                barred = True
        above = stack[-1].path
        path = known.get((above.at, label))
        if path is None:
            path = known[above.at, label] = _Path(len(paths), above, sure, doubtful)
            paths.append(path)
        stack.append(_Node(name, path, stack[-1], barred))
        nodes.append(stack[-1])
        opened[name] += 1
        if name in RAW:  # up to its own end tag, nothing in between is a tag
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name in SILENT or name == "title":
                stack.pop()
                opened[name] -= 1
                at = end.end() if end else len(page)
    flush()
    return Page(out, nodes, paths)


def fused(chars: float, marks: float) -> float:
    """One figure from characters and punctuation marks for each text; without marks little is left."""
    return chars * math.sqrt(0.05 + marks)


def path_scores(page: Page, by_name: bool = True, reach: int = 1) -> dict[int, float]:
    """Per path with texts (by its place): the score of its ratios, of links, and of names on it or above.
    ``by_name``: whether names of boilerplate count."""
    n = len(page.paths)
    chars, links, marks, count = [0] * n, [0] * n, [0] * n, [0] * n
    order: dict[int, None] = {}
    for node, text, linked in page.blocks:
        at = node.path.at
        order[at] = None
        chars[at], links[at], marks[at], count[at] = chars[at] + len(text), links[at] + linked, marks[at] + len(MARKS.findall(text)), count[at] + 1
    own, paths = {}, list(order)
    sizes, dots = [chars[x] / count[x] for x in paths], [marks[x] / count[x] for x in paths]
    for i, at in enumerate(paths):  # smoothed over the paths in page order
        begin, end = max(0, i - reach), i + reach + 1
        around = 1 + min(end, len(paths)) - begin
        smooth = fused((sizes[i] + sum(sizes[begin:end])) / around, (dots[i] + sum(dots[begin:end])) / around)
        own[at] = math.sqrt(smooth * fused(sizes[i], dots[i]))  # a path next to paragraphs is not one itself
    whole = [list(x) for x in (chars, links, marks, count)]  # with all paths below
    for path in reversed(page.paths[1:]):
        for x in whole:
            x[path.above.at] += x[path.at]
    against, out = [1.0] * n, {}
    for path in page.paths:
        at, above = path.at, path.above
        c, k, m, t = (x[at] for x in whole)
        against[at] = (against[above.at] if above else 1.0) * (NAMED if path.doubtful and t and is_boilerplate(c, k, m, t) else 1.0)
        if at in own:
            out[at] = own[at] * (1 - links[at] / chars[at]) * (path.prior * against[at] if by_name else 1.0)
        path.named = by_name and path.prior * against[at] < 1
    return out


def content_paths(page: Page, scores: dict[int, float]) -> set[int]:
    """The paths whose score reaches the threshold of the page."""
    size = sum(len(text) for _, text, _ in page.blocks)
    mean = sum(len(text) * scores[node.path.at] for node, text, _ in page.blocks) / max(size, 1)
    return {at for at, score in scores.items() if score >= THRESHOLD * mean and score > 0}


def measure(page: Page, paths: set[int]) -> None:
    """Add up what each node holds, from the texts to the root."""
    for i, node in enumerate(page.nodes):
        node.at = node.last = i
    for node, text, linked in page.blocks:
        size, marks = len(text), len(MARKS.findall(text))
        node.held, node.links, node.marks, node.texts = node.held + size, node.links + linked, node.marks + marks, node.texts + 1
        node.first = node.first or (node, text)
        if 2 * linked < size and (node.of_text or not is_boilerplate(size, 0, marks, 1)):
            node.plain += size
        if node.path.at in paths:
            node.content += size
    for node in reversed(page.nodes[1:]):
        up = node.parent
        for x in ("content", "held", "plain", "links", "marks", "texts"):
            setattr(up, x, getattr(up, x) + getattr(node, x))
        up.last = max(up.last, node.last)
        up.table |= node.table or node.name in ("table", "dl", "pre", "figure")
        if node.first and (up.first is None or node.first[0].at <= up.first[0].at):
            up.first = node.first
        if node.texts >= 2 and node.name in ("li", "div", "section", "article"):
            owner, text = node.first
            if owner.name not in HEADINGS and len(text) < 60 and not SENTENCE.search(text):
                up.records[node.path.at] = up.records.get(node.path.at, 0) + 1


def find_article(page: Page, by_name: bool) -> list[_Node]:
    """The elements that the article lies in."""
    total = page.nodes[0].content
    named = [n for n in page.nodes if n.name in ("article", "main") and n.content * 3 >= total > 0] if by_name else []
    if named:
        best = max(named, key=lambda n: (n.content, -n.depth))
        return [n for n in page.nodes if n.name == best.name and n.depth == best.depth]
    # the deepest container that holds nearly all of the core, and those around it which add titles,
    # paragraphs and sentences rather than links
    holders = [n for n in page.nodes if n.name in CONTAINERS and n.content * 10 >= total * 8]
    best = max(holders, key=lambda n: n.depth) if holders else page.nodes[0]
    above = best.parent if best.name != "body" else None
    while above is not None and above.name != "body":
        if 2 * (above.plain - best.plain) < above.held - best.held:
            break
        best, above = above if above.name in CONTAINERS else best, above.parent
    return [best]


def is_foreign(node: _Node) -> bool:
    """Whether a branch of the article without core texts is no part of it."""
    if node.path.named:
        return True
    if max(node.records.values(), default=0) >= 3 and not node.table:
        return True
    if node.article:
        return False
    menu = 2 * node.links >= node.held and node.name != "p" and (node.held < 25 * node.texts or 2 * node.marks < node.texts)
    return menu or node.first is not None and node.first[0] is node and node.name in LOOSE and not SENTENCE.search(node.first[1])


def comment_texts(page: Page) -> set[int]:
    """The blocks below a heading of reader comments, up to the next heading of its rank or the end of what
    both lie in."""
    out, scope, rank = set(), None, 0
    for i, (node, text, _) in enumerate(page.blocks):
        heading = next((n for n in (node, node.parent) if n is not None and n.name in HEADINGS), None)
        if scope is not None and (not scope.at < node.at <= scope.last or heading is not None and heading.name <= rank):
            scope = None
        if scope is None and heading is not None and len(text) < 60 and COMMENTS.fullmatch(text):
            scope, rank = heading.parent, heading.name
        if scope is not None:
            out.add(i)
    return out


def main_text(html: str, by_name: bool = True) -> str:
    """The texts of the article, one block a line. ``by_name``: whether names and elements of boilerplate count."""
    page = read_page(html)
    scores = path_scores(page, by_name)
    if not any(scores.values()):  # all is boilerplate by name
        scores = path_scores(page, by_name=False)
    paths = content_paths(page, scores)
    measure(page, paths)
    if not page.nodes[0].content:
        return ""
    for node in find_article(page, by_name):
        node.inside = True
    comments = comment_texts(page)
    for node in page.nodes[1:]:
        up = node.parent
        node.dropped = up.dropped or up.inside and not node.content and is_foreign(node)
        node.inside = node.inside or up.inside
    kept = []
    for i, (node, text, _) in enumerate(page.blocks):
        by_line = node.header and len(text) < 80 and not (node.name in HEADINGS or node.parent is not None and node.parent.name in HEADINGS)
        if node.inside and not node.dropped and i not in comments and not (by_line and node.path.at not in paths):
            kept.append(text)
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page's id, url, main text and its number of code points.

    Null and empty pages, and those without text, give an empty text; repeated rows are extracted
    each; a page without tags is its own article; pages of any length and depth are read whole. No rows
    give none. Other columns are not read.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    return pages.select(id_col, url_col, html_col).transform(map_batches, extract, f"page_id {kind}, url {url_kind}, text string, n_chars long")
