"""Main-text extraction by composite text density.

Each page is parsed into a flat DOM (parallel lists). For every node the
composite text density is computed from characters, tags, link characters and
link tags of its subtree; the densities of a node's children are summed, and
of the subtrees whose density reaches the threshold taken from the path
between the body and the densest node, the one with the largest density sum
is the article. Two things soften the sum over direct children, which would
cut an article of several sections down to its longest one: an ``article`` or
``main`` element counts the sums of the nodes below it as its own (a prior
inside the densities: it still loses to a denser subtree elsewhere), and from
the chosen subtree the choice rises to the parent as long as the text that
this adds is mostly of like density.

Elements that can't hold article text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out of the
tree: by element name, by ARIA role and by being hidden. A ``class`` or ``id``
of a block container, all of whose words are customary names of boilerplate or
of layout, only raises a doubt, which what the container holds can remove: one
that holds most of a page's text or its article stays, whatever it is called;
``search``, ``related``, ``discussion`` and the like stay where they hold
paragraphs and neither links, fields nor signed remarks; a header stays with a
headline in it. Headings and text elements raise no doubt, nor do sections of
an article by their ``id``, which is often a slug of their title. ``label`` is
inline text, and so is a ``button`` inside a paragraph.

Defined results
---------------
* null or empty html, or html without text: ``text`` is '' and ``n_chars`` 0;
* unclosed and stray end tags, truncated pages: handled as a browser would,
  with implied end tags; text outside any element belongs to the body;
* white space is what Unicode calls so, no-break spaces included;
* ties between subtrees: the outermost, then the first in page order;
* very long pages: parsed whole, in one task, at a cost in proportion to their length;
* rows are handled one by one: repeated rows give repeated results; an empty
  table gives no rows; other input columns are not read.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import read_table, text_batches

# Element names of the HTML standard by their part in a page, and customary names of boilerplate.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROPPED = frozenset(
    "aside canvas dialog footer form head iframe input menu nav noembed noframes noscript object "
    "option script select style svg template textarea title video audio xmp".split()
)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
_CLOSES_P = _BLOCKS - frozenset("body caption html tbody td tfoot th thead tr legend summary".split())
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead footer sidebar aside widget widgets "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login "
    "share sharing social toolbar pagination pager copyright disclaimer "
    "complementary contentinfo skip".split()
)
_REMARKS = frozenset("comment comments commentlist disqus guestbook".split())
_READERS = frozenset("user users reader readers customer customers visitor visitors guest guests member members".split())
_OPINIONS = frozenset("reviews review feedback opinions ratings".split())  # those of readers are remarks, others may be the text
_DOUBTFUL = frozenset("header search related recommended recommendations discussion replies respond reviews feedback".split())
# Words that names of boilerplate have beside those, saying where or what kind of box it is.
_LAYOUT = frozenset(
    "area bar block bottom box button buttons container content contents elem element entry fixed form global group head holder icons id inline inner item items "
    "js left link links list main message mobile module outer page panel policy popular post posts primary recent right row section secondary site slot "
    "sticky tags text this thread top unit view wrap wrapper zone amp".split()
)
_HEADLINE = frozenset("main post entry article story content title".split())  # what a header that belongs to the text is called beside that
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar".split())
_SAFE = frozenset("html body article main".split())
_CONTAINERS = frozenset("div section aside ul ol dl li nav table header footer figure form details center fieldset".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")
_ABOUT = frozenset("has with no not without hide is show".split())  # "has-sidebar" says something about what is around


def _named_so(value: str) -> str | None:
    """What a class or id says its element is: 'remarks', a doubtful name, 'other' boilerplate, or None."""
    for name in value.split():
        words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if not words or words[0] in _ABOUT:
            continue
        remarks = _REMARKS.intersection(words) or (_READERS.intersection(words) and _OPINIONS.intersection(words))
        found = _BOILERPLATE.intersection(words) | _DOUBTFUL.intersection(words) | (remarks or frozenset())
        if found and all(w in found or w in _LAYOUT or w in _READERS or len(w) == 1 or remarks and w in _OPINIONS for w in words):
            if remarks:
                return "remarks"
            if found <= _DOUBTFUL:
                return "headline" if "header" in found and _HEADLINE.intersection(words) else min(found)
            return "other"
    return None


def _out_of_sight(attributes: str) -> bool:
    """Whether an element is hidden or has the role of boilerplate."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and _INVISIBLE.search(value) or name == "role" and value.strip().lower() in _ROLES:
            return True
    return False


def _names(tag: str, attributes: str, in_article: bool) -> str | None:
    """What the names of a container say that it is."""
    if "-" in tag and (said := _named_so(tag)):
        return said
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class" and (tag in _CONTAINERS or tag == "p" and not in_article) or name == "id" and tag in _CONTAINERS and not (in_article and tag == "section"):
            if said := _named_so(value):
                return said
    return None


class _Dom:
    """Parallel lists: a node's index is its order in the page; ``events`` keep text and block breaks in order."""

    __slots__ = ("tag", "parent", "dropped", "end", "events", "doubts", "classes")

    def __init__(self) -> None:
        self.doubts: list[tuple[int, str, bool]] = []  # (node, what its names say, whether it is inside an article)
        self.classes: dict[int, str] = {}
        self.tag, self.parent, self.dropped, self.end = ["body"], [-1], [False], [0]
        self.events: list[tuple[int, str | None]] = []  # (node, text) or (node, None) for a block break


def parse(page: str) -> _Dom:
    dom = _Dom()
    tag, parent, dropped, end, events = dom.tag, dom.parent, dom.dropped, dom.end, dom.events
    stack, at, size = [0], 0, len(page)
    search = _TOKEN.search

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            end[node] = len(tag)
            if tag[node] in _BLOCKS:
                events.append((stack[-1], None))

    while at < size:
        m = search(page, at)
        start = m.start() if m else size
        if start > at and not dropped[stack[-1]]:
            events.append((stack[-1], page[at:start]))
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in ("html", "body"):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if tag[stack[depth]] == name:
                    close(depth)
                    break
                if tag[stack[depth]] in ("article", "main", "section", "td", "table") and name not in _BLOCKS:
                    break
            continue
        attributes = m[3]
        if name in ("html", "body"):
            continue
        if name == "br":
            events.append((stack[-1], " "))
            continue
        if name in _CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            wanted = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = tag[stack[depth]]
                if open_tag == "p" and name in _CLOSES_P or open_tag in wanted:
                    close(depth)
                    if open_tag != "td" and open_tag != "th" or name != "tr":
                        break
                elif open_tag in _BLOCKS:
                    break
        node = len(tag)
        tag.append(name)
        parent.append(stack[-1])
        gone = dropped[stack[-1]] or name in _DROPPED or name == "button" and tag[stack[-1]] != "p"
        if not gone and name not in _SAFE and (attributes or name == "header" or "-" in name):
            inside = any(tag[x] in ("article", "main") for x in stack)
            gone = _out_of_sight(attributes) or name == "header" and not inside
            if not gone and (said := _names(name, attributes, inside)):
                dom.doubts.append((node, said, inside))
        if attributes:
            dom.classes[node] = attributes
        dropped.append(gone)
        end.append(node + 1)
        if name in _BLOCKS:
            events.append((stack[-1], None))
        if name in _VOID or attributes.endswith("/") and name not in _BLOCKS and name not in _RAW:
            continue
        if name in _RAW:
            shut = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            stop = shut.start() if shut else size
            if not gone:
                events.append((node, page[at:stop]))
            at = shut.end() if shut else size
            continue
        stack.append(node)
    while len(stack) > 1:
        node = stack.pop()
        end[node] = len(tag)
    end[0] = len(tag)
    return dom


def _amounts(dom: _Dom) -> tuple[list[int], list[int], list[int], list[int]]:
    """Characters and tags of every subtree, and those in links."""
    n = len(dom.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = dom.tag[i] == "a" or in_link[dom.parent[i]]
    for node, text in dom.events:
        if text is not None and not dom.dropped[node]:
            size = len(text) - text.count(" ")
            chars[node] += size
            if in_link[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):
        up = dom.parent[i]
        if dom.dropped[i]:
            continue
        chars[up] += chars[i]
        tags[up] += tags[i] + 1
        link_chars[up] += link_chars[i]
        link_tags[up] += link_tags[i] + (dom.tag[i] == "a")
    return chars, tags, link_chars, link_tags


_SIGNED = re.compile(r"\b(?:class|id)\s*=\s*[\"']?[^\"'>]*(?:comment|reply|avatar|commenter|username|vote)", re.I)


def _is_boilerplate(dom: _Dom, node: int, said: str, in_article: bool, chars: list[int], link_chars: list[int]) -> bool:
    """Whether a container is what its names say, by what it holds."""
    inside = range(node + 1, dom.end[node])
    shown = [i for i in inside if not dom.dropped[i]]
    if said == "remarks":
        return True
    if any(dom.tag[i] in ("article", "main") for i in shown):
        return False
    size, linked = chars[node], link_chars[node]
    elsewhere = any(t in ("article", "main") for t in dom.tag) and not in_article
    if 2 * size > chars[0] and 3 * linked < size and not elsewhere and not in_article:
        return False
    if said == "other":
        return True
    heading = any(dom.tag[i] in ("h1", "h2") and chars[i] > 2 * link_chars[i] for i in shown)
    if said in ("header", "headline"):
        return not (in_article or said == "headline" and heading and not elsewhere)
    fields = any(dom.tag[i] in ("form", "input", "textarea", "select") for i in inside)
    signed = any(_SIGNED.search(dom.classes[i]) for i in inside if i in dom.classes)
    told = any(dom.tag[i] in ("p", "blockquote", "pre", "table") and chars[i] > 2 * link_chars[i] for i in shown) and 3 * linked < size
    return fields or signed or not told or elsewhere


def resolve_doubts(dom: _Dom) -> None:
    """Leave out the containers that are the boilerplate their names say."""
    if not dom.doubts:
        return
    chars, _, link_chars, _ = _amounts(dom)
    for node, said, in_article in dom.doubts:
        if not dom.dropped[node] and _is_boilerplate(dom, node, said, in_article, chars, link_chars):
            for i in range(node, dom.end[node]):
                dom.dropped[i] = True


def _densities(dom: _Dom) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite text density of every node, the sum over its children, and the characters of its subtree, all and those in links."""
    n = len(dom.tag)
    chars, tags, link_chars, link_tags = _amounts(dom)
    ratio = link_chars[0] / chars[0] if chars[0] else 0.0
    density = [0.0] * n
    for i in range(n):
        c = chars[i]
        if not c or dom.dropped[i]:
            continue
        t, lc, lt = tags[i] or 1, link_chars[i] or 1, link_tags[i] or 1
        plain = max(c - link_chars[i], 1)
        base = math.log(c / plain * lc + ratio * c + math.e)
        value = c / t * (c / lc) * (t / lt)
        density[i] = c / t * math.log(max(value, 1.0), max(base, 1.0 + 1e-9)) if value > 0 else 0.0
    own, below = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        up = dom.parent[i]
        own[up] += density[i]
        below[up] += below[i] + own[i]
    sums = [own[i] + below[i] if dom.tag[i] in ("article", "main") else own[i] for i in range(n)]
    return density, sums, chars, link_chars


_TEXT_PARTS = frozenset("p li td th tr tbody thead tfoot table ul ol dl dd dt pre blockquote h1 h2 h3 h4 h5 h6".split())
_TOLD = frozenset("p h1 h2 h3 h4 h5 h6".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())


def _is_like(dom: _Dom, node: int, than: float, density: list[float], chars: list[int], link_chars: list[int]) -> bool:
    """Whether a node beside the chosen subtree holds text of its kind: a heading, text as dense, or paragraphs without links, however short."""
    if dom.tag[node] in _HEADINGS:
        return True
    if 2 * density[node] >= than and 2 * link_chars[node] < chars[node]:
        return True
    inside = range(node, dom.end[node])
    if any(dom.tag[i] in ("article", "main") for i in inside):
        return False
    told = sum(chars[i] for i in inside if dom.tag[i] in _TOLD and not dom.dropped[i])
    return link_chars[node] == 0 and 2 * told > chars[node]


def select(dom: _Dom) -> int:
    """The node that holds the article; leaves out boxes of links that stand beside its parts."""
    density, sums, chars, link_chars = _densities(dom)
    n = len(dom.tag)
    best = max(range(n), key=lambda i: (sums[i], -i))
    threshold, at = density[best], best
    while at >= 0:  # the least density between the body and the densest sum
        if density[at]:
            threshold = min(threshold, density[at])
        at = dom.parent[at]
    kept = [i for i in range(n) if density[i] >= threshold and density[i] > 0]
    chosen = max(kept, key=lambda i: (sums[i], -i)) if kept else 0
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        if chars[i] and not dom.dropped[i]:
            children.setdefault(dom.parent[i], []).append(i)
    risen: list[tuple[int, list[int]]] = []
    while chosen:
        up = dom.parent[chosen]
        if dom.tag[chosen] in _BLOCKS and dom.tag[chosen] not in _TEXT_PARTS:
            others = [i for i in children.get(up, ()) if i != chosen]
            own = chars[up] - chars[chosen] - sum(chars[i] for i in others)
            like = own + sum(chars[i] for i in others if _is_like(dom, i, density[chosen], density, chars, link_chars))
            if 2 * like <= chars[up] - chars[chosen] or dom.tag[chosen] in ("article", "main") and up == 0:
                break
            risen.append((up, others))
        chosen = up
    if dom.tag[chosen] not in ("article", "main"):
        for up, others in risen:  # boxes of links beside the text don't rise with it
            for i in others:
                if up >= chosen and dom.tag[i] in _CONTAINERS and 3 * link_chars[i] >= 2 * chars[i]:
                    dom.dropped[i : dom.end[i]] = [True] * (dom.end[i] - i)
    return chosen


def extract(page: str | None) -> str:
    """The article's blocks, one to a line."""
    if not page:
        return ""
    dom = parse(page)
    resolve_doubts(dom)
    root = select(dom)
    last = dom.end[root]
    blocks, parts = [], []
    for node, text in dom.events:
        if text is None:
            if parts:
                blocks.append("".join(parts))
                parts = []
        elif root <= node < last and not dom.dropped[node]:
            parts.append(_html.unescape(text) if "&" in text else text)
    blocks.append("".join(parts))
    clean = (" ".join(b.split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return text_batches(narrow).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_main_text(read_table(spark, sf_dir, "pages"))
