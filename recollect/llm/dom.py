"""Web pages as trees of blocks: a lenient reading of HTML, and what a model sees of each node."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of HTML: elements whose text is never shown as text, those without content, blocks, and what ends what.
DROPPED = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button datalist".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr", "li", "dd", "dt", "legend"}
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}, "a": {"a"}}
#: What an open element of these keeps from being closed by what stands inside.
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}

#: Kinds of words in class, id and role (fixed values), each a bit of a node's marks.
MARKS = {
    "menu": "nav navbar navigation menu menus menubar breadcrumb breadcrumbs crumbs pager pagination paging skip sitemap tabs toolbar",
    "head": "header masthead logo brand branding topbar tagline hero",
    "foot": "footer foot colophon copyright legal bottom contentinfo",
    "side": "sidebar sidebars side aside widget widgets rail related recommended recommendations popular trending archive archives tagcloud categories complementary teaser teasers readmore",
    "notice": "cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay dialog toast announcement newsletter subscribe subscription signup disclaimer paywall privacy",
    "advert": "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot sponsor sponsored sponsors promo promos promotion promoted banner banners affiliate",
    "comment": "comment comments commentlist commentbody reply replies respond responses discussion disqus thread feedback review reviews",
    "form": "form search login register contact field",
    "share": "share sharing social follow likes tweet buttons",
    "hidden": "hidden invisible offscreen",
    "content": "article articles articlebody content maincontent post entry story main body text prose copy hentry blog",
}
BITS = {word: 1 << k for k, words in enumerate(MARKS.values()) for word in words.split()}
CONTENT, HIDDEN = 1 << list(MARKS).index("content"), 1 << list(MARKS).index("hidden")
#: Elements that say as much as a word.
TAG_BITS = {"nav": BITS["nav"], "menu": BITS["nav"], "header": BITS["header"], "footer": BITS["footer"], "aside": BITS["aside"], "form": BITS["form"], "search": BITS["form"], "dialog": BITS["dialog"], "ins": BITS["ad"], "article": CONTENT, "main": CONTENT}
#: Kinds of elements that a model tells apart; others are one more.
KINDS = ["#block", "p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "table", "tr", "blockquote", "pre", "figure", "figcaption", "dl", "body"]
KIND = {tag: k for k, tag in enumerate(KINDS)} | {"td": KINDS.index("tr"), "th": KINDS.index("tr"), "h5": KINDS.index("h4"), "h6": KINDS.index("h4")}

_NEXT = re.compile(r"<(?:!--(?P<comment>)|[!?](?P<odd>)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>\x00]*))")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Tree:
    """Nodes in page order, a parent before its children; leaves of kind #block hold the text."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)  # the sibling before, or -1
    place: list[int] = field(default_factory=list)  # among its siblings
    end: list[int] = field(default_factory=list)  # one past the last node below
    depth: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)  # marks
    above: list[int] = field(default_factory=list)  # marks of the node and all above it
    near: list[int] = field(default_factory=list)  # 1 if the nearest marked node is content, -1 if it is other
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links
    tags: list[int] = field(default_factory=list)  # inline tags of a block
    inputs: list[int] = field(default_factory=list)
    truth: list[int] = field(default_factory=list)  # of training pages: 1 main, 0 other, -1 unknown


def marks(attributes: str) -> tuple[int, int]:
    """(marks, truth) of an element's attributes."""
    bits, truth = 0, -1
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for word in _WORD.findall(value):
                bits |= BITS.get(word.lower(), 0)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            bits |= HIDDEN
        elif name == "data-truth" and value in ("0", "1"):
            truth = int(value)
    return bits, truth


def is_block(name: str) -> bool:
    return name in BLOCKS or name in ("td", "th")


def parsed(page: str | None) -> Tree:
    """The tree of a page's blocks.

    Text between the edges of block elements is one leaf, whatever inline elements it stands in; white
    space in it is one space, and leaves without text are left out. Unclosed and misnested elements
    are closed as browsers do, as far as blocks go. The work is in proportion to the page's length.
    """
    t = Tree()
    page = page or ""
    # Open elements: (name, node or the node it stands in, marks above, near, truth); a node's last child is kept in last.
    last: dict[int, int] = {-1: -1}
    stack: list[tuple[str, int, int, int, int]] = [("", -1, 0, 0, -1)]
    open_: dict[str, int] = {}
    links = dropped = inline = 0
    run: list[str] = []
    run_linked = 0

    def node(tag: str, bits: int, truth: int) -> int:
        _, parent, above, near, own_truth = stack[-1]
        k = len(t.tag)
        t.tag.append(tag)
        t.parent.append(parent)
        t.before.append(last.get(parent, -1))
        t.place.append(t.place[t.before[k]] + 1 if t.before[k] >= 0 else 0)
        last[parent] = k
        t.end.append(k + 1)
        t.depth.append(t.depth[parent] + 1 if parent >= 0 else 0)
        t.own.append(bits)
        t.above.append(above | bits)
        t.near.append(near if not bits else 1 if bits & CONTENT and not bits & ~CONTENT else -1)
        t.text.append("")
        t.linked.append(0)
        t.tags.append(0)
        t.inputs.append(0)
        t.truth.append(own_truth if truth < 0 else truth)
        return k

    def flush() -> None:
        nonlocal run, run_linked, inline
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                k = node("#block", 0, -1)
                t.text[k], t.linked[k], t.tags[k] = text, min(run_linked, len(text)), inline
            run = []
        run_linked = inline = 0

    def close() -> None:
        nonlocal links, dropped
        name, k, *_ = stack.pop()
        open_[name] -= 1
        if is_block(name) and k >= 0:
            t.end[k] = len(t.tag)
        links -= name == "a"
        dropped -= name in DROPPED

    def close_to(names: set[str], scope: set[str]) -> None:
        """Closes the nearest open element of these names, with all inside it, unless one of the scope stands between."""
        if any(open_.get(n) for n in names):
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] in names:
                    if any(is_block(x[0]) for x in stack[at:]):
                        flush()
                    while len(stack) > at:
                        close()
                    return
                if stack[at][0] in scope:
                    return

    at = 0
    while at < len(page):
        m = _NEXT.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not dropped:
            run.append(text)
            if links:
                run_linked += len(text.strip())
        if not m:
            break
        if m["comment"] is not None:
            stop = page.find("-->", m.end())
            at = len(page) if stop < 0 else stop + 3
            continue
        rest = _REST.match(page, m.end())
        stop = rest.end() if rest else page.find(">", m.end()) + 1
        if not stop:
            break
        attributes, at = page[m.end() : stop - 1], stop
        if m["odd"] is not None:
            continue
        name = m["name"].lower()
        block = is_block(name)
        if m["end"]:
            if name == "p" and not open_.get("p") and not dropped:
                flush()
            if name == "p" or not block:
                close_to({name}, {"td", "th", "table", "body"} if name != "body" else set())
            else:
                close_to({name}, {"table"} - {name} if name not in ("table", "body", "html") else set())
            continue
        if name == "br" or name in ("wbr", "img"):
            if not dropped:
                run.append(" " if name != "wbr" else "")
                inline += 1
            continue
        if name in VOID:
            if not dropped:
                if name == "hr":
                    flush()
                if name == "input" and stack[-1][1] >= 0:
                    t.inputs[stack[-1][1]] += 1
            continue
        if name in ("html", "body") and open_.get(name):
            continue
        if open_.get("head") and (name == "body" or name in CLOSES_P):
            close_to({"head"}, set())
        if name in CLOSES_P and open_.get("p"):
            close_to({"p"}, {"td", "th", "table", "button"})
        if name in CLOSED_BY:
            close_to(CLOSED_BY[name], SCOPES.get(name, set()))
        bits, truth = marks(attributes) if attributes.strip() else (0, -1)
        bits |= TAG_BITS.get(name, 0)
        _, holder, above, near, own_truth = stack[-1]
        if block and not dropped:
            flush()
            k = node(name, bits, truth)
            stack.append((name, k, t.above[k], t.near[k], t.truth[k]))
        else:
            if name in ("textarea", "select", "button") and holder >= 0 and not dropped:
                t.inputs[holder] += 1
            inline += 1
            stack.append((name, holder, above, near, own_truth))
        open_[name] = open_.get(name, 0) + 1
        links += name == "a"
        dropped += name in DROPPED
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if not found:
                break
            at = found.start()
    flush()
    while len(stack) > 1:
        close()
    return t


#: Columns of ``features``, by name.
NAMES = [
    "kind", "parent_kind", "depth", "chars", "own_chars", "share_of_page", "link_share", "tags", "chars_by_tag", "blocks", "block_chars", "paragraphs", "share_in_paragraphs", "sentences_by_char", "children", "place", "siblings", "like_siblings",
    "starts_at", "ends_at", "inputs", "headings", "before_chars", "before_links", "after_chars", "after_links", "parent_links", "parent_block_chars", "parent_share", "near", "marked_below", "content_below",
    *(f"own_{m}" for m in MARKS), *(f"above_{m}" for m in MARKS),
]


def features(trees: list[Tree]) -> np.ndarray:
    """A row for each node of the trees: its subtree's density, marks, depth, and its siblings' statistics."""
    join = lambda name: np.array([x for t in trees for x in getattr(t, name)])
    size = np.array([len(t.tag) for t in trees], np.int64)
    n = int(size.sum())
    if not n:
        return np.zeros((0, len(NAMES)), np.float32)
    first = np.repeat(np.cumsum(size) - size, size)
    whole = np.repeat(np.arange(len(trees)), size)
    move = lambda v: np.where(v >= 0, v + first, -1)
    parent, before, end = move(join("parent").astype(np.int64)), move(join("before").astype(np.int64)), join("end").astype(np.int64) + first
    kind = np.array([KIND.get(x, len(KINDS)) for t in trees for x in t.tag])
    own, above = join("own").astype(np.int64), join("above").astype(np.int64)
    text = [x for t in trees for x in t.text]
    chars = np.array([len(x) for x in text], float)
    stops = np.array([x.count(".") + x.count("!") + x.count("?") + x.count(",") + x.count("。") for x in text], float)
    at = np.arange(n)
    after = np.full(n, -1)
    after[before[before >= 0]] = at[before >= 0]

    def below(v: np.ndarray) -> np.ndarray:
        """Sums over the subtrees, which are runs of nodes."""
        s = np.concatenate([[0.0], np.cumsum(v)])
        return s[end] - s[at]

    def of(where: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.where(where >= 0, v[where], -1.0)

    is_block = (kind == 0).astype(float)
    under_p = is_block * (of(parent, kind.astype(float)) == KIND["p"])
    total, linked, blocks = below(chars), below(join("linked").astype(float)), below(is_block)
    tags = below(join("tags").astype(float)) + end - at
    by_page = np.bincount(whole, chars, len(trees))
    page = np.maximum(1.0, by_page)[whole]
    start = np.cumsum(chars) - chars - (np.cumsum(by_page) - by_page)[whole]
    children = np.bincount(parent[parent >= 0], minlength=n).astype(float)
    place = join("place").astype(float)
    _, inverse, count = np.unique(np.where(parent >= 0, parent, n + whole) * 64 + kind, return_inverse=True, return_counts=True)
    alike = count[inverse].astype(float)
    link_share = linked / np.maximum(total, 1)
    block_chars = total / np.maximum(blocks, 1)
    siblings = np.where(parent >= 0, children[parent], 1.0)
    columns = [
        kind, of(parent, kind.astype(float)), join("depth"), np.log1p(total), np.log1p(chars), total / page, link_share, np.log1p(tags), total / np.maximum(tags, 1), np.log1p(blocks), np.log1p(block_chars), np.log1p(below(under_p)),
        below(chars * under_p) / np.maximum(total, 1), below(stops) / np.maximum(total, 1), np.log1p(children), place / np.maximum(siblings - 1, 1), np.log1p(siblings), alike / siblings, start / page, (start + total) / page,
        np.log1p(below(join("inputs").astype(float))), np.log1p(below(np.isin(kind, [KIND[h] for h in ("h1", "h2", "h3", "h4")]).astype(float))), of(before, np.log1p(total)), of(before, link_share), of(after, np.log1p(total)), of(after, link_share),
        of(parent, link_share), of(parent, np.log1p(block_chars)), of(parent, total / page), join("near"), np.log1p(below((own & ~CONTENT > 0).astype(float))), np.log1p(below((own & CONTENT > 0).astype(float))),
        *((own >> k) & 1 for k in range(len(MARKS))), *((above >> k) & 1 for k in range(len(MARKS))),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def decoded(t: Tree, score: np.ndarray) -> list[bool]:
    """Which nodes are kept: the likeliest choice in which nothing is kept below a node that is not, and no
    node is kept without text of its own below it.

    gain is what keeping a node, and the best of what is below it, adds to the log-likelihood over dropping
    it with all below; a pass upward finds it, a pass downward reads the choice off. Where nothing below a node
    gains by itself, keeping the node means keeping the child that costs least.
    """
    n = len(t.tag)
    gain = [2 * float(s) for s in score]
    leaf = [tag == "#block" for tag in t.tag]
    best: list[int] = [-1] * n  # the child with the highest gain, among those that can be kept
    for k in range(n - 1, -1, -1):
        if not leaf[k] and best[k] < 0:
            continue
        if not leaf[k] and gain[best[k]] <= 0:
            gain[k] += gain[best[k]]
        p = t.parent[k]
        if p >= 0:
            if best[p] < 0 or gain[k] > gain[best[p]]:
                best[p] = k
            if gain[k] > 0:
                gain[p] += gain[k]
    kept = [False] * n
    for k in range(n):
        p = t.parent[k]
        kept[k] = (leaf[k] or best[k] >= 0) and (gain[k] > 0 if p < 0 else kept[p] and (gain[k] > 0 or (best[p] == k and gain[k] <= 0)))
    return kept


def main_text(t: Tree, kept: list[bool]) -> str:
    """The kept blocks in page order, with an empty line between."""
    return "\n\n".join(text for text, keep in zip(t.text, kept, strict=True) if keep and text)
