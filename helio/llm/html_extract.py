"""Main-text extraction by tag-path ratios.

Each page is read into text blocks with their root-to-leaf path of block elements, kept as
nodes of a trie (a path is its parent and its last tag).  Elements that are never article
text by their name (scripts, menus, footers, forms), that are hidden, or that are containers
with a whole class or role of cue words (adverts, comments, notices) are left out with all
they hold.  A paragraph or a run of inline text with such a class is left out only if its
own ratio is low.  A cue word in an id, or in part of a class, is only a hint: what such an
element holds has no say in the choice of paths (unless it is most of the page), but
stays where it lies inside the selected content and is not mostly links.

Text length outside links and punctuation are summed per path; a path's ratio
is length and punctuation per block.  Ratios are smoothed over similar paths (a
Gaussian of the steps between two paths, up to three steps), fused (their geometric mean)
and compared with a share of the page's strongest path.  Blocks are selected below the nearest
common ancestor of the chosen paths, in those of its branches that hold a chosen path,
so headings and one-word paragraphs of the article stay.  Where <article> or <main> hold
the strongest path and at least half the text of the chosen paths, other paths are left
out, and the whole of the element that holds all chosen paths is taken.

Pages are independent, so the work needs no shuffle: Spark deals pages to tasks.

Defined results: null and empty html give empty text; a page without any text outside
the elements left out gives empty text; unclosed elements end where their parent does;
a very long or deeply nested page takes time and memory in proportion to its length;
repeated rows give the same text; paths of equal score are chosen together; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
OUTSIDE = frozenset(
    "head nav header footer aside form button select option input fieldset dialog menu "
    "object canvas svg audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map "
                   "mark math mfrac mi mn mo mrow msqrt msub msup mtext q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
#: A class or role of these words marks an element outside the article; one of them in an
#: id, or among other words, is a hint.
CUES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies disclaimer discussion disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pagination pager popup promo promoted promotion recommended related replies "
    "reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar topbar widget contentinfo complementary alert alertdialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an open <p> cannot hold.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("table ul ol dl article section main div body html nav aside".split())
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARK = re.compile(r"[.,;:!?。，…]")
#: Steps between two paths beyond which they do not smooth each other.
REACH = 3


def attributes(text: str) -> dict[str, str]:
    """Names (lower case) and values of a start tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def outside(tag: str, attrs: str) -> str:
    """What an element's name and attributes say of it: "out" holds no article text, "cue" is
    a paragraph or inline element named as such, "id" and "part" are hints (the id is all
    cue words; a cue among other words), empty says nothing."""
    if tag in OUTSIDE:
        return "out"
    if not attrs or tag in ("html", "body", "article", "main"):
        return ""
    named = attributes(attrs)
    if "hidden" in named or re.search(r"(?:^|;)\s*display\s*:\s*none", named.get("style", ""), re.I):
        return "out"
    if tag in HEADINGS:
        return ""
    hint = ""
    for name in ("class", "role", "id"):
        for token in named.get(name, "").split():
            cues = [w.lower() in CUES for w in _WORD.findall(token)]
            if not any(cues):
                continue
            if not all(cues):
                hint = hint or "part"
            elif name == "id":
                hint = "id"
            else:
                return "cue" if tag == "p" or tag in INLINE else "out"
    return "" if tag in INLINE else hint


class Paths:
    """A trie of root-to-leaf paths: node 0 is the root, parents come before children."""

    def __init__(self):
        self.parent, self.tag, self.depth, self._child = [0], [""], [0], {}

    def child(self, node: int, tag: str) -> int:
        found = self._child.get((node, tag))
        if found is None:
            found = self._child[node, tag] = len(self.parent)
            self.parent.append(node)
            self.tag.append(tag)
            self.depth.append(self.depth[node] + 1)
        return found


class Reader:
    """Reads a page into blocks [node, text, link chars, chars named as cues, hint]."""

    def __init__(self):
        self.paths, self.blocks = Paths(), []
        self.hints: list[tuple[int, str, int]] = []  # (hint around it or -1, kind, node)
        # open elements: [tag, left out, node, hint, cue, closed]; places of every tag
        self.stack: list[list] = []
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []  # places of elements that are not inline
        self.held, self.links, self.named = [], 0, 0
        self.skipped = self.in_link = self.in_cue = 0
        self.node, self.hint = 0, -1

    def text(self, piece: str) -> None:
        if not self.skipped:
            self.held.append(piece)
            shown = len(piece) - piece.count(" ") - piece.count("\n")
            self.links += len(piece) if self.in_link else 0
            self.named += shown if self.in_cue else 0

    def flush(self) -> None:
        raw = "".join(self.held)
        if raw:
            text = " ".join(html.unescape(raw).split())
            if text:
                shown = len(raw) - raw.count(" ") - raw.count("\n")
                self.blocks.append([self.node, text, min(self.links, len(text)),
                                    self.named >= shown, self.hint])
        self.held, self.links, self.named = [], 0, 0

    def _end(self, entry: list) -> None:
        if not entry[5]:
            entry[5] = True
            self.skipped -= entry[1]
            self.in_link -= entry[0] == "a"
            self.in_cue -= entry[4]

    def pop(self, n: int) -> None:
        """Close the elements from place n on."""
        while len(self.stack) > n:
            entry = self.stack.pop()
            self.places[entry[0]].pop()
            if self.solid and self.solid[-1] == len(self.stack):
                self.solid.pop()
            self._end(entry)
        if self.solid:
            self.node, self.hint = self.stack[self.solid[-1]][2:4]
        else:
            self.node, self.hint = 0, -1

    def place(self, names) -> int:
        return max((self.places[t][-1] for t in names if self.places.get(t)), default=-1)

    def close(self, names, limits) -> None:
        at = self.place(names)
        if at >= 0 and at > self.place(limits - names):
            self.flush()
            self.pop(at)

    def start(self, tag: str, attrs: str) -> None:
        inline = tag in INLINE
        if not inline:
            self.flush()
            if tag in ENDS_P:
                self.close({"p"}, LIMITS)
            if tag in SAME:
                self.close(SAME[tag], LIMITS)
        if tag in VOID or attrs.rstrip().endswith("/") and inline:
            return
        kind = outside(tag, attrs)
        left, cue = kind == "out", kind == "cue"
        if left and not self.skipped and inline:
            self.flush()
        if not inline:
            self.node = self.paths.child(self.node, tag)
            if kind in ("id", "part"):
                self.hints.append((self.hint, kind, self.node))
                self.hint = len(self.hints) - 1
            self.solid.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append([tag, left, self.node, self.hint, cue, False])
        self.skipped += left
        self.in_link += tag == "a"
        self.in_cue += cue

    def end(self, tag: str) -> None:
        at = self.place((tag,))
        if tag in INLINE:
            if at > (self.solid[-1] if self.solid else -1):
                # others around it stay open: it is only marked, unless it is the last
                if at == len(self.stack) - 1:
                    self.pop(at)
                else:
                    self._end(self.stack[at])
                    self.stack[at][0] = ""
                    self.places[tag].pop()
                    self.places.setdefault("", []).append(at)
        elif at >= 0:
            self.flush()
            self.pop(at)
        elif tag == "p":
            self.flush()

    def read(self, page: str) -> "Reader":
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self.text(page[at:m.start()])
            at = m.end()
            tag = m.group("tag")
            if tag is not None:
                if m.group("end"):
                    self.end(tag.lower())
                else:
                    self.start(tag.lower(), m.group("attrs"))
        if at < len(page):
            self.text(page[at:])
        self.flush()
        return self


def path_scores(paths: Paths, lengths, marks, counts, sigma: float = 1.0) -> np.ndarray:
    """Smoothed and fused ratios of all nodes that hold blocks (0 for others).

    Two paths are as many steps apart as the longer one has below their common part.
    ``below[i, r]`` sums the subtree of node i at r levels below it, so the paths that part
    from a path at one of its next ancestors are that ancestor's sum less its branch's.
    """
    n = len(paths.parent)
    parent = np.array(paths.parent)
    # a path's weight is its number of blocks: sums of ratio times weight, and weights
    own = np.stack([lengths, np.where(counts > 0, 1.0 + marks, 0.0), counts], axis=1)
    below = np.zeros((n, REACH + 1, 3))
    below[:, 0] = own
    level = own
    for r in range(1, REACH + 1):
        up = np.zeros((n, 3))
        np.add.at(up, parent[1:], level[1:])
        below[:, r] = level = up
    near = np.exp(-np.arange(REACH + 1) ** 2 / (2 * sigma ** 2))
    total = np.zeros((n, 3))
    branch, at = None, np.arange(n)
    alive = np.ones(n, dtype=bool)
    for up in range(REACH + 1):  # the common part ends ``up`` levels above the path
        here = below[at].copy()
        if branch is not None:
            here[:, 1:] -= below[branch][:, :-1]
        here[~alive] = 0
        total += np.einsum("nrk,r->nk", here, near[np.maximum(np.arange(REACH + 1), up)])
        branch, alive = at, alive & (at > 0)
        at = parent[at]
    weight = np.maximum(total[:, 2], 1e-300)
    score = np.sqrt(np.maximum(total[:, 0], 0) / weight * np.maximum(total[:, 1], 0) / weight)
    return np.where(counts > 0, score, 0.0)


def main_text(page: str, share: float = 0.15) -> str:
    """The article's text: its blocks joined by one space."""
    read = Reader().read(page)
    every, paths, hints = read.blocks, read.paths, read.hints
    if not every:
        return ""
    n = len(paths.parent)
    shown, links_in = [0] * len(hints), [0] * len(hints)
    for _, text, links, _, hint in every:
        if hint >= 0:
            shown[hint] += len(text)
            links_in[hint] += links
    for h in range(len(hints) - 1, -1, -1):  # what a hint inside another holds, both hold
        if hints[h][0] >= 0:
            shown[hints[h][0]] += shown[h]
            links_in[hints[h][0]] += links_in[h]
    whole_page = sum(len(b[1]) for b in every)
    # a hint on most of the page says nothing, unless the id is nothing but cues
    void = [kind == "part" and 2 * shown[h] >= whole_page for h, (_, kind, _) in enumerate(hints)]
    silent = [False] * len(hints)
    for h, (around, _, _) in enumerate(hints):
        silent[h] = void[h] and (around < 0 or silent[around])
    found = [b for b in every if not b[3] and (b[4] < 0 or silent[b[4]])]
    if not any(len(b[1]) > b[2] for b in found):
        found = every = [[*b[:3], False, -1] for b in every]
    lengths, marks, counts = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text, links, _, _ in found:
        lengths[node] += len(text) - links
        marks[node] += len(_MARK.findall(text)) * (links < len(text))
        counts[node] += 1
    best = 0.0
    if not lengths.any():
        chosen = counts > 0
    else:
        weight = path_scores(paths, lengths, marks, counts) * (lengths > 0)
        best = weight.max()
        chosen = (counts > 0) & (weight >= share * best)
    named = [False] * n  # inside <article> or <main>
    for i in range(1, n):
        named[i] = named[paths.parent[i]] or paths.tag[i] in ("article", "main")
    article = chosen & np.array(named)
    if article.any() and best and article[int(weight.argmax())] and (
            2 * lengths[article].sum() >= lengths[chosen].sum()):
        # the page says itself where its article is, and the ratios agree: the strongest
        # path and most of the chosen paths' text are there (a teaser's <article> is not)
        chosen = article
    inside = chosen.astype(int).tolist()  # chosen paths in a node's subtree
    for i in range(n - 1, 0, -1):
        inside[paths.parent[i]] += inside[i]
    total = inside[0]
    root = max((i for i in range(n) if inside[i] == total), key=lambda i: paths.depth[i])
    if chosen.sum() == 1 and paths.depth[root] > 1:
        root = paths.parent[root]
    above, at = [], root
    while at:
        above.append(at)
        at = paths.parent[at]
    for name in ("article", "main"):
        if any(paths.tag[i] == name for i in above):  # the whole element, all its parts
            root = [i for i in above if paths.tag[i] == name][-1]
            break
    whole = named[root]
    held = whole or paths.tag[root] not in ("", "html", "body")
    below, taken = [False] * n, [False] * n  # in the subtree, and in a branch that counts
    below[root] = taken[root] = True
    for i in range(root + 1, n):
        up = paths.parent[i]
        below[i] = below[up]
        taken[i] = taken[up] and (up != root or whole or inside[i] > 0)
    stays = [False] * len(hints)
    for h, (around, kind, node) in enumerate(hints):
        # a hinted element inside the selected content stays if it is text
        fits = void[h] or (2 * links_in[h] < shown[h] and below[node] and node != root and (
            held or kind == "part" or paths.tag[node] not in ("div", "ul", "ol")))
        stays[h] = fits and (around < 0 or stays[around])

    def selected(node, text, links, cue, hint) -> bool:
        if cue:
            ratio = (len(text) - links) * (1 + len(_MARK.findall(text)))
            return taken[node] and ratio >= (share * best) ** 2 and links < len(text)
        if hint < 0 or silent[hint]:
            return taken[node]
        return below[node] and stays[hint]
    return " ".join(b[1] for b in every if selected(*b))


def extracted(pages: DataFrame, html_col: str = "html", share: float = 0.15) -> DataFrame:
    """(page_id, url, text) of every page."""
    def run(batches):
        for batch in batches:
            texts = [main_text(p, share) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"])
    return pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"),
                        F.col(html_col).alias("html")).mapInArrow(
        run, "page_id long, url string, text string")
