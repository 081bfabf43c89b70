"""Main text of HTML pages by scoring the element tree.

A page becomes a tree of elements; what is no article by its element or role is left out. An element that only its name, or being a form,
speaks against is left out too, unless it holds most of the page's text and the signs of an article; if that leaves nothing worth
the name, the page is scored without regard to names. Every block of text passes points for its length and commas to its ancestors, in
full to the nearest, less with each level; article elements and names add some. Points are discounted by the share of
the element's text that stands in links. The element with most points (of several, the first) is the container; its siblings stay if
they score well or are headings. Pages are independent of each other: one pass, linear in the page, one page at a time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("script style noscript template iframe object embed applet svg canvas video audio map head title nav footer aside button select textarea input label dialog menu noembed noframes".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "thead": ("tr", "td", "th")}
LIMITS = frozenset("ul ol dl table td th div section article main body html blockquote".split())
PARAGRAPHS = frozenset("p li td pre h1 h2 h3 h4 h5 h6 blockquote dd dt figcaption".split())
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar alertdialog".split())
# Words of class and id names.
STRONG = frozenset("comment comments commentlist disqus reply replies respond ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr sidebar aside related recommended share sharing social newsletter subscribe subscription signup popup modal overlay breadcrumb breadcrumbs pagination pager menu nav navbar navigation footer foot widget widgets notice notices banner toolbar login search skip disclaimer".split())
WEAK = frozenset("header head masthead meta alert warning info tags tools hidden print".split())
POSITIVE = frozenset("article articlebody body content entry main page post story text blog".split())
#: Words that make a name a state or a layout ("no-sidebar", "comments-open"), not what the element is.
STATES = frozenset("no not with without has have is open closed enabled disabled active on off layout".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A container of fewer points is none, if names have taken text away.
LEAST_POINTS = 4.0
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "names", "suspect", "children", "points", "text", "linked", "kept", "menu", "dropped", "article")

    def __init__(self, tag: str, parent: Node | None, names: frozenset[str] = frozenset(), suspect: bool = False):
        self.tag, self.parent, self.names, self.suspect = tag, parent, names, suspect
        self.children: list = []
        self.points, self.text, self.linked, self.kept, self.menu = 0.0, 0, 0, False, False
        self.dropped, self.article = False, tag in MAIN or tag == "h1" or bool(names & POSITIVE)


def _name_words(value: str) -> set[str]:
    """Words of the names in a class or id that say what an element is: of a name that ends in a good word, that word."""
    out: set[str] = set()
    for name in value.split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        if words and not STATES.intersection(words):
            out.update(words[-1:] if words[-1] in POSITIVE else words)
    return out


def _attributes(raw: str) -> tuple[frozenset[str], bool]:
    """(words of class and id, whether the element is hidden or has a role that is no article)."""
    names, gone = set(), False
    for key, value in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            names |= _name_words(value)
        elif key == "role":
            gone |= value.strip().lower() in ROLES
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            gone = True
        elif key == "style":
            gone |= _HIDDEN.search(value) is not None
    return frozenset(names), gone


def _suspect(tag: str, names: frozenset[str], inside: bool) -> bool:
    """Whether its name, or being a form or a page header, speaks against an element."""
    if tag in ("html", "body") or (tag in MAIN and not names & STRONG):
        return False
    if tag == "form" or names & STRONG:
        return True
    return (tag == "header" and not inside) or bool(names & WEAK and not names & POSITIVE and not inside)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """(elements, blocks) in page order: block elements, and texts as (element, text, characters in links), without what is surely none."""
    root = Node("html", None)
    nodes, stack, skipped = [root], [root], 0
    blocks: list[tuple[Node, str, int]] = []
    run: list[str] = []
    opened: dict[str, int] = {}
    linked, links, inside, place, end = 0, 0, 0, 0, len(page)
    last = page.rfind(">")  # no tag ends behind it

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((stack[-1].parent if stack[-1].tag in INLINE else stack[-1], text, min(linked, len(text))))
            run.clear()
        linked = 0

    def words(raw: str) -> None:
        nonlocal linked
        if skipped or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        run.append(text)
        if links:
            linked += len(" ".join(text.split()))

    def close(k: int) -> None:
        """Close the elements from the k-th on."""
        nonlocal links, inside, skipped
        for node in reversed(stack[k:]):
            if node.tag not in INLINE:
                flush()
            opened[node.tag] -= 1
            links -= node.tag == "a"
            inside -= node.tag in MAIN
            skipped -= node.points < 0
            stack.pop()

    def close_implied(tags: tuple[str, ...]) -> None:
        if not any(opened.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                close(k)
                return
            if stack[k].tag in LIMITS:
                return

    while place < end:
        if place > last:
            words(page[place:].partition("<!--")[0])
            break
        m = _TAG.search(page, place)
        if m is None:
            words(page[place:])
            break
        words(page[place : m.start()])
        place = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag in INLINE and stack[k].tag in LIMITS:
                        break
            if tag == "br":
                words(" ")
            continue
        if tag in ENDS_PARAGRAPH:
            close_implied(("p",))
        if tag in ENDS_ITEM:
            close_implied(ENDS_ITEM[tag])
        if tag not in INLINE:
            flush()
        if tag in VOID:
            if tag == "br":
                words(" ")
            continue
        raw = m[3]
        names, gone = _attributes(raw) if len(raw) > 2 else (frozenset(), False)
        if tag in RAW:
            found = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, place)
            place = found.end() if found else end
            continue
        above = stack[-1].parent if stack[-1].tag in INLINE else stack[-1]  # parents are block elements
        suspect = _suspect(tag, names, inside > 0 and tag != "div")
        node = Node(tag, above, names, suspect)
        if tag in NEVER or (gone and tag not in ("html", "body")) or (suspect and tag in INLINE):
            node.points = -1.0
            skipped += 1
        elif not skipped and tag not in INLINE:
            above.children.append(node)
            nodes.append(node)
        if raw.endswith("/>") and tag not in ENDS_PARAGRAPH and tag not in INLINE and tag not in ENDS_ITEM:
            skipped -= node.points < 0
            continue
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
        inside += tag in MAIN
        stack.append(node)
    flush()
    return nodes, blocks


def _weight(node: Node) -> float:
    return (25.0 if node.tag in MAIN else 0.0) + (10.0 if node.names & POSITIVE else 0.0) - (10.0 if node.names & WEAK else 0.0)


def _scores(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> dict[int, float]:
    """Points of every element that has any, from the blocks."""
    for node in nodes:
        node.points, node.text, node.linked = 0.0, 0, 0
    for node, text, linked in blocks:
        above = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
        above.points += (1.0 + text.count(",") + min(len(text) / 100, 10.0)) * (1 - linked / len(text))
        node.text += len(text)
        node.linked += linked
    for node in reversed(nodes[1:]):  # children come after their parents
        node.parent.points += max(0.0, node.points) / 2
        node.parent.text += node.text
        node.parent.linked += node.linked
        node.parent.article |= node.article and node.text > 0
    return {id(n): (n.points + _weight(n)) * (1 - n.linked / n.text) for n in nodes if n.points > 0}


def _without_suspects(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """Blocks outside of suspect elements. One that holds most of the text and the signs of an article, or is a form, is none."""
    whole = nodes[0].text
    for node in nodes[1:]:
        most = 2 * node.text >= whole and (node.article or node.tag == "form")
        node.dropped = node.parent.dropped or (node.suspect and not most)
    return [b for b in blocks if not b[0].dropped]


def main_text(page: str | None) -> str:
    """Blocks of the best container and its kept siblings, joined by two line ends."""
    nodes, blocks = parse(page or "")
    if not blocks:
        return ""
    everything = _scores(nodes, blocks)
    left = _without_suspects(nodes, blocks)
    score = _scores(nodes, left) if len(left) < len(blocks) else everything
    if len(left) < len(blocks) and max(score.values(), default=0.0) < LEAST_POINTS:
        for node in nodes:
            node.dropped = False
        score = _scores(nodes, blocks)
        if left and max(score.values(), default=0.0) < LEAST_POINTS:  # nothing anywhere: what no name speaks against
            score = _scores(nodes, left)
        else:
            left = blocks
    if not score:
        return "\n\n".join(t for _, t, _ in left)
    best = max((n for n in nodes if id(n) in score), key=lambda n: score[id(n)])
    least = max(3.0, 0.2 * score[id(best)])
    best.kept = True
    for sibling in best.parent.children if best.parent is not None else ():
        well = score.get(id(sibling), 0.0) >= least
        sibling.kept |= well and sibling.tag == best.tag if best.tag in MAIN else well or sibling.tag in HEADINGS or sibling.tag == "p"
    for node in nodes[1:]:
        node.kept |= node.parent.kept
        # A list of links is a menu wherever it stands; a paragraph that is one link is text.
        node.menu = node.linked > 0.8 * node.text if node.tag in LISTS else node.parent.menu
    return "\n\n".join(t for n, t, k in left if n.kept and not (n.menu and k >= 0.8 * len(t)))


def _extract(html_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                text = [main_text(v.as_py()) for v in part.column(html_col)]
                columns = {"text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())}
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else part.column(c) for c in names], names=names)

    return run


def extract_main_text(pages: DataFrame, *, html_col: str = "html", keep_html: bool = True) -> DataFrame:
    """All columns of ``pages`` (without the html if not ``keep_html``) and text, n_chars (code points).

    Null and empty pages, and pages without text, have the empty text; broken markup is read as far as it goes, and a tag that never ends is text;
    pages of any length are read whole, by one task each; repeated rows are judged alike; no rows give none. Columns of ``pages`` named like an added one are replaced.
    """
    rows = pages.drop(*[c for c in pages.columns if c.lower() in ("text", "n_chars") and c != html_col])
    kept = [f for f in rows.schema.fields if keep_html or f.name != html_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, n_chars long"])
    return rows.mapInArrow(_extract(html_col, [*(f.name for f in kept), "text", "n_chars"]), schema)
