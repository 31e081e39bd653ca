"""Main text of web pages by wrapper induction.

Every page is reduced to its tree of block elements.  The reference of a host is the page that holds most of what is on more than
half of its pages.  Simple tree matching aligns every other page of the host with it: nodes with the same text on most pages may be the host's
template wherever they stand, the others are slots.  Pages with the same tree and texts count as one, and copies of the reference do not count beside it.  The wrapper of a host is the path of
the node that holds its slots, the places of slots outside it, and the template nodes, each of them
confirmed by a count over all pages of the host; every page of the host is read by it.  Siblings of one signature are told
apart by their number from the front or from the back, whichever the alignment bears out, but for paragraphs and rows.  Elements that say what they are
(nav, footer, form, role, a class or id made of such words alone, a section headed "Comments") are no content unless they hold the article.

Pages are scanned once, whatever is broken in them: an unclosed tag at the end is text, an unclosed comment or script
reaches to the end, depth and number of siblings are not bounded.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, tidy

#: A template node stands on so many different pages of a host, on at least this share of them,
#: and other text in its place on at most the last share of the pages that have it.
TEMPLATE_PAGES, TEMPLATE_SHARE, OTHER_SHARE = 4, 0.5, 0.1
#: Share of the slots' text that the content node must hold.
HELD = 0.7
#: Share of the distinct words of two pages in both of them, from which they are copies and what they share is their content.
COPIES = 0.8
#: Share of a page's text from which its only article or main is the content node, however long what stands beside it.
ONLY_ARTICLE = 0.3
#: Share of a page's text from which an element is content whatever its class or id says.
NAMED_HELD = 0.8
#: Tree matching: pairs of siblings compared at once, levels below them that weigh in, and pairs compared in all for two
#: pages.  Beyond these, siblings are aligned by their equal subtrees and signatures, in linear time.
CELLS, LEVELS, WORK = 4096, 8, 400_000
#: Rows of siblings with more pairs are compared a row at a time.
FEW_CELLS = 64
#: A longer run of text is prose, not a form's label.
PROSE = 80
#: Wrappers up to so many characters are broadcast; more are joined by a shuffle, a host's pages in so many parts.
BROADCAST_CHARS, PARTS = 32 << 20, 64
#: About so many pages of a host are aligned with one copy of its reference, and so many such parts make a task.
PART_PAGES, TASK_PARTS = 512, 8

# HTML element names by role.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROP = frozenset("head script style noscript template iframe svg annotation annotation-xml button select textarea title object canvas audio video noembed noframes xmp".split())
_SIDE = frozenset("nav footer aside form dialog menu".split())
_IN_HEAD = frozenset("base link meta title style script noscript template basefont bgsound noframes".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}
_BOXES = frozenset("body article main section div td".split())
_P_SCOPE = _BOXES | {"table"}
#: A class or id names an element that is no content if one of its words is in the first list and all are in either.
_NAMES = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pager|pagination|sidebar|aside|footer|masthead|topbar|toolbar|"
    r"comments?|commentlist|disqus|respond|reply|replies|related|recommended|share|sharing|social|widget|skip"
)
_NEUTRAL = frozenset(
    "area bar block body bottom box button buttons container content footer form global group header heading icons inner item items left link links list main outer "
    "page panel posts primary right row secondary section site slot text thread title top unit user users wrap wrapper".split()
)
#: Names of what visitors write have a word of both lists.
_PEOPLE, _SAYINGS = frozenset("reader readers user users visitor visitors".split()), frozenset("notes opinions reactions remarks responses thoughts voices".split())
#: Headings of reader comments.
_COMMENT_HEADING = re.compile(
    r"(?:\(?\d+\)? )?(?:(?:all|latest|reader|readers'?|user|visitor|your) )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?|commenti|reacties)(?: \(?\d+\)?)?:?|"
    r"(?:leave|post|write|add) (?:a|your) (?:comment|reply)|(?:reader|user|visitor)s?'? (?:remarks|reactions|opinions)",
    re.I,
)
_COMMENT_NAMES = frozenset("comment comments reply replies respond".split())
_HEADINGS, _ROWS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("p li dt dd td th tr".split())
_UNNUMBERED = _HEADINGS | _ROWS
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_TAG_UNQUOTED = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_COMMENT = re.compile(r"<(?:[!?]|/[^A-Za-z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I) for tag in _RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile(r"class|id|hidden|role", re.I)


@lru_cache(maxsize=1 << 14)
def _named(names: str) -> bool:
    """Whether a class or id is made of words for what is no content."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
        marks = [bool(_NAMES.fullmatch(w)) for w in words]
        if any(marks) and all(m or w in _NEUTRAL for m, w in zip(marks, words)):
            return True
        if _PEOPLE & set(words) and _SAYINGS & set(words) and all(w in _PEOPLE | _SAYINGS | _NEUTRAL for w in words):
            return True
    return False


@lru_cache(maxsize=1 << 10)
def _describe(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool, str]:
    """(whether an element is none of the content, whether it is so by its kind or by its class or id unless it holds the article, its signature)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if _TELLING.search(attributes) else {}
    drop = side = named = False
    if tag == "article":
        named = _named(found.get("class", "")) and bool(_COMMENT_NAMES & set(re.split(r"[-_\s]+", found["class"].lower())))
    elif tag not in ("html", "body", "main"):
        drop = tag in _DROP or "hidden" in found or found.get("aria-hidden") == "true"
        side = tag in _SIDE or found.get("role") in _ROLES or (tag == "header" and not in_article)
        # headings and paragraphs have ids made of their own words
        named = tag not in _HEADINGS and (_named(found.get("class", "")) or (tag not in _ROWS and _named(found.get("id", ""))))
    classes = ".".join(sorted(set(re.sub(r"\d+", "#", found["class"]).split()))) if "class" in found else ""
    return drop, side, named, f"{tag}.{classes}" if classes else tag


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed)


def _numbered(parent: list[int], signature: list[str], drop: list[bool]) -> tuple[list[int], list[int]]:
    """Places of nodes: their paths with the number of each element among kept siblings of its signature, from the front and from the back.

    The first from the front and an only one have no number, so that their places are their paths.  Nor have paragraphs, headings and rows of lists
    and tables: what is the same on all pages among others that vary is content there.
    """
    n, seen = len(parent), Counter()
    rank = [0] * n
    for k in range(1, n):
        if not drop[k] and signature[k].partition(".")[0] not in _UNNUMBERED:
            rank[k] = seen[parent[k], signature[k]]
            seen[parent[k], signature[k]] += 1
    fore, back = [0] * n, [0] * n
    for k in range(1, n):
        if not drop[k]:
            up, name, of = parent[k], signature[k], seen.get((parent[k], signature[k]), 1)
            fore[k] = _hash(f"{name} {rank[k]}" if rank[k] else name, fore[up])
            back[k] = _hash(f"{name} -{of - rank[k]}" if of > 1 else name, back[up])
    return fore, back


class Page:
    """A page's block elements and its runs of text, in page order.

    Node k has ``parent[k]``, ``tag[k]``, ``signature[k]``, ``path[k]`` (a hash of the signatures from the root) and
    ``drop[k]`` (it or an ancestor is no content); ``blocks`` are (node, text) with white space collapsed.
    An element is dropped for its kind (a form, a nav that is never closed), class or id only if it is not around the page's main or
    largest article; for its class or id only if it holds little of the text as well, as such names also describe a layout.
    So do forms: one with most of the text, and that in long runs, is the page's frame.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.signature, self.path, self.drop, self.depth = [-1], [""], [""], [0], [False], [0]
        self.blocks: list[tuple[int, str]] = []
        self._stack: list[tuple[str, int]] = []
        self._at: dict[str, list[int]] = {}  # places of each open tag in the stack
        self._named: list[int] = []
        self._side: list[int] = []
        self._text: list[str] = []
        self._scan(source)
        self._flush()
        self._name_comments()
        if self._named or self._side:
            self._drop_named()

    def _scan(self, source: str):
        at, end, tag = 0, len(source), _TAG
        while (i := source.find("<", at)) >= 0:
            if i > at:
                self._text.append(source[at:i])
            if _COMMENT.match(source, i):
                close = "-->" if source.startswith("<!--", i) else ">"
                at = source.find(close, i + 2)
                at = end if at < 0 else at + len(close)
                continue
            m = tag.match(source, i)
            if m is None and tag is _TAG and re.match(r"</?[A-Za-z]", source[i : i + 3]):
                # a quotation mark is never closed: from here on they do not count
                tag = _TAG_UNQUOTED
                m = tag.match(source, i)
                if m is None:  # nor is any tag
                    self._text.append(source[i:])
                    return
            if m is None:
                self._text.append("<")
                at = i + 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                self._close(name)
            elif name in _RAW:
                stop = _RAW_END[name].search(source, at)
                at = stop.end() if stop else end
            else:
                self._open(name, m[3])
        self._text.append(source[at:])

    def _node(self) -> int:
        return self._stack[-1][1] if self._stack else 0

    def _flush(self):
        text = " ".join(html.unescape("".join(self._text)).split())
        self._text = []
        if text:
            self._leave_head()
            self.blocks.append((self._node(), text))

    def _leave_head(self):
        """What cannot stand in a head closes it."""
        if self._stack and self._stack[-1][0] == "head":
            self._cut(len(self._stack) - 1)

    def _last(self, tags) -> int:
        """Place of the innermost open element of ``tags`` in the stack, -1 for none."""
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def _cut(self, k: int):
        for tag, _ in reversed(self._stack[k:]):
            self._at[tag].pop()
        del self._stack[k:]

    def _name_comments(self):
        """A section or div that begins with a heading of comments is named by it."""
        before = -1
        for k, t in self.blocks:
            up = self.parent[k]
            if self.tag[k] in _HEADINGS and before < up and self.tag[up] in ("section", "div") and len(t) < 60 and _COMMENT_HEADING.fullmatch(t):
                self._named.append(up)
            before = k

    def _drop_named(self):
        own, prose, parent, n = [0] * len(self.parent), [0] * len(self.parent), self.parent, len(self.parent)
        named, side = set(self._named), set(self._side)
        marked = named | side
        for k, t in self.blocks:
            if not self.drop[k]:
                own[k] += len(t)
                prose[k] += len(t) if len(t) > PROSE else 0
        clear, under = own[:], [False] * n
        for k in range(1, n):
            under[k] = under[parent[k]] or k in marked
        # text of each element without what is marked inside it
        for k in range(n - 1, 0, -1):
            clear[parent[k]] += 0 if k in marked else clear[k]
        outside = sum(size for k, size in enumerate(own) if not under[k])
        kept = set()
        for tag in ("main", "article"):
            best = max((k for k in range(1, n) if self.tag[k] == tag and not self.drop[k] and k not in marked), key=lambda k: clear[k], default=0)
            if best and under[best] and (tag == "main" or clear[best] >= outside):
                k = best
                while k > 0:
                    kept.add(k)
                    k = parent[k]
        # of the others, forms may be the page's frame
        beside = side - kept
        forms = {k for k in beside if self.tag[k] == "form"}
        inside, written = own[:], prose[:]
        for k in range(n - 1, 0, -1):
            if k not in beside or k in forms:
                inside[parent[k]] += inside[k]
                written[parent[k]] += written[k]
        frames = {k for k in forms if inside[k] >= NAMED_HELD * max(1, inside[0]) and 2 * written[k] > inside[k]}
        held = own[:]
        for k in range(n - 1, 0, -1):
            held[parent[k]] += 0 if k in beside and k not in frames else held[k]
        kept |= frames | {k for k in named - beside if held[k] >= NAMED_HELD * max(1, held[0])}
        for k in range(1, n):
            self.drop[k] = self.drop[k] or self.drop[parent[k]] or (k in marked and k not in kept)

    def _open(self, tag: str, attributes: str):
        if tag not in _IN_HEAD:
            self._leave_head()
        if tag == "br":
            self._text.append(" ")
            return
        drop, side, named, signature = _describe(tag, attributes, tag == "header" and self._last(("article", "main")) >= 0)
        if tag in _INLINE and not (drop or side or named):
            return
        if tag in _VOID:
            if tag == "hr":
                self._flush()
            return
        self._flush()
        if tag in _CLOSES_P and self._at.get("p"):
            self._pop(("p",), _P_SCOPE)
        if tag in _CLOSES:
            self._pop(_CLOSES[tag], _SCOPE.get(tag, ()))
        above = self._node()
        self.parent.append(above)
        self.tag.append(tag)
        self.signature.append(signature)
        self.path.append(_hash(signature, self.path[above]))
        self.drop.append(drop or self.drop[above])
        self.depth.append(self.depth[above] + 1)
        if named:
            self._named.append(len(self.parent) - 1)
        if side:
            self._side.append(len(self.parent) - 1)
        self._at.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, len(self.parent) - 1))

    def _pop(self, tags, scope):
        """Close open elements of ``tags`` up to the nearest one of ``scope``."""
        k = self._last(tags)
        if k > self._last(scope):
            self._cut(k)

    def _close(self, tag: str):
        k = self._last((tag,))
        if k >= 0 and (tag not in _INLINE or k > self._last(_BOXES)):
            self._flush()
            self._cut(k)
        elif k < 0 and tag in ("p", "br"):
            self._flush()

    # -- what a wrapper says about the page

    def root(self, mass: dict[int, int]) -> int:
        """The content node by ``mass`` (text by node)."""
        held = [0] * len(self.parent)
        for k, n in mass.items():
            held[k] += n
        for k in range(len(held) - 1, 0, -1):
            held[self.parent[k]] += held[k]
        return _content_node(self.parent, self.tag, held)

    def text(self, wrapper: dict) -> str:
        roots = {wrapper.get("root"), *wrapper.get("also", ())} - {None}
        inside = [k > 0 and p in roots for k, p in enumerate(self.path)]
        if not any(b for k, b in enumerate(inside) if not self.drop[k]):
            mass: dict[int, int] = {}
            for k, t in self.blocks:
                if not self.drop[k]:
                    mass[k] = mass.get(k, 0) + len(t)
            inside[self.root(mass)] = True
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parent[k]]
        blocks = [(k, t) for k, t in self.blocks if inside[k] and not self.drop[k]]
        template = {tuple(x) for x in wrapper.get("template", ())}
        if template:
            fore, back = _numbered(self.parent, self.signature, self.drop)
            blocks = [(k, t) for k, t in blocks if (fore[k], h := _hash(t)) not in template and (back[k], h) not in template]
        return " ".join(t for _, t in blocks)

    def template_places(self, template: list) -> list[int]:
        """For each place and text of ``template`` on this page ``k`` of the text's place in the list, and ``-k-1`` where other text stands in its place."""
        at: dict[int, set[int]] = {}
        fore, back = _numbered(self.parent, self.signature, self.drop)
        for k, t in self.blocks:
            if not self.drop[k]:
                for place in {fore[k], back[k]}:
                    at.setdefault(place, set()).add(_hash(t))
        known: dict[int, set[int]] = {}
        for place, h in template:
            known.setdefault(place, set()).add(h)
        out = [k for k, (place, h) in enumerate(template) if h in at.get(place, ())]
        return out + [-k - 1 for k, (place, _) in enumerate(template) if at.get(place, set()) - known[place]]


def _content_node(parent: list[int], tag: list[str], held: list[int]) -> int:
    """The only article or main if it holds enough of the text, else the deepest box that holds most of it, or the outermost article or main around that.

    ``held`` is the text of each subtree.
    """
    depth, box, outer = [0] * len(parent), [False] * len(parent), []
    for k in range(1, len(parent)):
        depth[k] = depth[parent[k]] + 1
        box[k] = box[parent[k]] or tag[k] in ("article", "main")
        if box[k] and not box[parent[k]] and held[k]:
            outer.append(k)
    if len(outer) == 1 and held[outer[0]] >= ONLY_ARTICLE * held[0]:
        return outer[0]
    best = 0
    for k in range(1, len(parent)):
        if held[0] and held[k] >= HELD * held[0] and depth[k] >= depth[best] and tag[k] in _BOXES:
            best = k
    node, k = best, best
    while k > 0:
        if tag[k] in ("article", "main"):
            node = k
        k = parent[k]
    return node


def _nodes(source: str) -> list:
    """A page's kept nodes: parent, signature, and hashes and length of its own text; for the first, the set of the page's words as well."""
    page = Page(source)
    keep, nodes = {0: 0}, [[-1, "", "", 0, set().union(*(t.split() for k, t in page.blocks if not page.drop[k]))]]
    for k in range(1, len(page.parent)):
        if page.drop[k]:
            keep[k] = -1
        else:
            keep[k] = len(nodes)
            nodes.append([keep[page.parent[k]], page.signature[k], "", 0])
    texts: dict[int, list[str]] = {}
    for k, t in page.blocks:
        if keep[k] >= 0:
            texts.setdefault(keep[k], []).append(str(_hash(t)))
            nodes[keep[k]][3] += len(t)
    for k, hashes in texts.items():
        nodes[k][2] = " ".join(hashes)
    return nodes


def skeleton(source: str) -> str:
    """A page's tree as JSON, with hashes in place of its words."""
    nodes = _nodes(source)
    nodes[0][4] = sorted({_hash(w) >> 32 for w in nodes[0][4]})
    return json.dumps(nodes, separators=(",", ":"), ensure_ascii=False)


# -- alignment ---------------------------------------------------------------


class Tree:
    """A skeleton with children, path hashes, numbered places, and for each node's subtree a hash and its number of nodes."""

    def __init__(self, nodes: list):
        self.parent, self.signature, self.hash, self.size = ([n[i] for n in nodes] for i in range(4))
        self.children: list[list[int]] = [[] for _ in nodes]
        self.path, self.depth = [0], [0]
        for k in range(1, len(nodes)):
            self.children[self.parent[k]].append(k)
            self.path.append(_hash(self.signature[k], self.path[self.parent[k]]))
            self.depth.append(self.depth[self.parent[k]] + 1)
        self.words = frozenset(nodes[0][4]) if len(nodes[0]) > 4 else frozenset()
        self.whole, self.nodes = [0] * len(nodes), [1] * len(nodes)
        for k in range(len(nodes) - 1, -1, -1):
            self.whole[k] = _hash(f"{self.signature[k]}|{self.hash[k]}|{self.size[k]}|{','.join(str(self.whole[x]) for x in self.children[k])}")
            self.nodes[k] += sum(self.nodes[x] for x in self.children[k])

    def tag(self, k: int) -> str:
        return self.signature[k].partition(".")[0]

    @cached_property
    def numbered(self) -> tuple[list[int], list[int]]:
        return _numbered(self.parent, self.signature, [False] * len(self.parent))

    @property
    def fore(self) -> list[int]:
        return self.numbered[0]

    @property
    def back(self) -> list[int]:
        return self.numbered[1]

    @cached_property
    def codes(self) -> np.ndarray:
        """Of each node numbers for its signature and its own text, and whether it has children."""
        return np.array([[hash(s) for s in self.signature], [hash(h) for h in self.hash], [int(bool(c)) for c in self.children]], np.int64)

    def paths(self) -> set[int]:
        return {_signed(p) for p in self.path}

    def texts(self) -> set[int]:
        """Hashes of texts with their paths."""
        return {_signed(_hash(h, p)) for p, hashes in zip(self.path, self.hash) for h in hashes.split()}


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class _Matcher:
    """Order-preserving matches of equal signatures below matched parents; a pair weighs one, and one more for equal text."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.work, self._known = a, b, WORK, {}

    def weight(self, x: int, y: int, levels: int) -> int:
        """Of the best match of two subtrees, so many levels deep."""
        a, b = self.a, self.b
        if a.whole[x] == b.whole[y]:
            return 2 * a.nodes[x]
        own = 1 + (a.hash[x] == b.hash[y])
        left, right = a.children[x], b.children[y]
        if not left or not right:
            return own
        if not levels or len(left) * len(right) > min(CELLS, self.work):
            shared = Counter(a.whole[i] for i in left) & Counter(b.whole[j] for j in right)
            return own + sum(shared.values())
        key = (x, y, levels)
        if key not in self._known:
            self._known[key] = own + sum(w for _, _, w in self.pairs(left, right, levels - 1))
        return self._known[key]

    def pairs(self, left: list[int], right: list[int], levels: int) -> list[tuple[int, int, int]]:
        """(child of x, child of y, weight) of the best alignment of two rows of siblings."""
        a, b, out = self.a, self.b, []
        lo, hi_a, hi_b = 0, len(left), len(right)
        same = lambda i, j: a.whole[left[i]] == b.whole[right[j]]
        take = lambda i, j: out.append((left[i], right[j], 2 * a.nodes[left[i]]))
        # equal subtrees at either end are in a best alignment
        while lo < hi_a and lo < hi_b and same(lo, lo):
            take(lo, lo)
            lo += 1
        while hi_a > lo and hi_b > lo and same(hi_a - 1, hi_b - 1):
            hi_a, hi_b = hi_a - 1, hi_b - 1
            take(hi_a, hi_b)
        left, right = left[lo:hi_a], right[lo:hi_b]
        if not left or not right:
            return out
        if len(left) * len(right) <= min(CELLS, self.work):
            return out + self._best(left, right, levels)
        return out + self._long(left, right, levels)

    def _best(self, left: list[int], right: list[int], levels: int) -> list[tuple[int, int, int]]:
        a, b, m, n = self.a, self.b, len(left), len(right)
        self.work -= m * n
        if m * n > FEW_CELLS:
            return self._trace(left, right, *self._by_rows(left, right, levels))
        weight = [[self.weight(x, y, levels) if a.signature[x] == b.signature[y] else 0 for y in right] for x in left]
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            row, above, now = weight[i], best[i], best[i + 1]
            for j in range(n):
                now[j + 1] = max(above[j + 1], now[j], above[j] + row[j])
        return self._trace(left, right, weight, best)

    def _by_rows(self, left: list[int], right: list[int], levels: int) -> tuple[list[list[int]], list[list[int]]]:
        """Weights and best sums as in _best, along the longer side at once."""
        (name_a, text_a, inner_a), (name_b, text_b, inner_b) = self.a.codes[:, left], self.b.codes[:, right]
        alike = name_a[:, None] == name_b
        weight = alike * (1 + (text_a[:, None] == text_b))
        # only what is below both says more than signature and text
        for i, j in np.argwhere(alike & (inner_a[:, None] * inner_b > 0)).tolist():
            weight[i, j] = self.weight(left[i], right[j], levels)
        turned = len(left) > len(right)
        rows = weight.T if turned else weight
        best = np.zeros((len(rows) + 1, len(rows[0]) + 1), np.int64)
        for i, row in enumerate(rows):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + row))
        return weight.tolist(), (best.T if turned else best).tolist()

    def _trace(self, left: list[int], right: list[int], weight: list[list[int]], best: list[list[int]]) -> list[tuple[int, int, int]]:
        out, i, j = [], len(left), len(right)
        while i and j:
            if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
                i, j = i - 1, j - 1
                out.append((left[i], right[j], weight[i][j]))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out

    def _long(self, left: list[int], right: list[int], levels: int) -> list[tuple[int, int, int]]:
        """Long rows: subtrees that occur once on both sides, in the longest common order, part the rows;
        what is between them is compared in full if it is short, else matched by signatures in order."""
        a, b = self.a, self.b
        once_a, once_b = (Counter(t.whole[k] for k in row) for t, row in ((a, left), (b, right)))
        place = {b.whole[y]: j for j, y in enumerate(right) if once_b[b.whole[y]] == 1}
        both = [(i, place[a.whole[x]]) for i, x in enumerate(left) if once_a[a.whole[x]] == 1 and a.whole[x] in place]
        tails, chain, before = [], [], []
        for k, (_, j) in enumerate(both):
            at = bisect_left(tails, j)
            before.append(chain[at - 1] if at else -1)
            tails[at : at + 1], chain[at : at + 1] = [j], [k]
        anchors, k = [], chain[-1] if chain else -1
        while k >= 0:
            anchors.append(both[k])
            k = before[k]
        out, i0, j0 = [], 0, 0
        for i, j in [*reversed(anchors), (len(left), len(right))]:
            between, other = left[i0:i], right[j0:j]
            if between and other:
                short = len(between) * len(other) <= min(CELLS, self.work)
                out += self._best(between, other, levels) if short else self._in_order(between, other)
            if i < len(left):
                out.append((left[i], right[j], 2 * a.nodes[left[i]]))
            i0, j0 = i + 1, j + 1
        return out

    def _in_order(self, left: list[int], right: list[int]) -> list[tuple[int, int, int]]:
        places: dict[str, list[int]] = {}
        for j, y in enumerate(right):
            places.setdefault(self.b.signature[y], []).append(j)
        out, last = [], -1
        for x in left:
            row = places.get(self.a.signature[x], [])
            at = bisect_right(row, last)
            if at < len(row):
                last = row[at]
                out.append((x, right[last], 1 + (self.a.hash[x] == self.b.hash[right[last]])))
        return out


def match_trees(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching from the roots down: node of a to node of b.

    The match is the largest one where siblings, levels and pairs stay within CELLS, LEVELS and WORK.
    """
    matcher, out, todo = _Matcher(a, b), {0: 0}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        left, right = a.children[x], b.children[y]
        if len(left) == len(right) == 1:  # whatever the weight of what is below
            found = [(*left, *right, 1)] if a.signature[left[0]] == b.signature[right[0]] else []
        else:
            found = matcher.pairs(left, right, LEVELS)
        for i, j, _ in found:
            out[i] = j
            todo.append((i, j))
    return out


def _copies(a: Tree, b: Tree) -> bool:
    few, many = sorted((len(a.words), len(b.words)))
    if few < COPIES * many:
        return False
    shared = len(a.words & b.words)
    return shared >= COPIES * max(1, few + many - shared)


def reference(trees: list[Tree]) -> Tree:
    """Of different pages of a host the one like most others that holds most of what is on more than half of them; of several the one with the most nodes."""
    common = [{x for x, n in Counter(x for t in trees for x in of(t)).items() if 2 * n > len(trees)} for of in (Tree.paths, Tree.texts)]

    def rank(t: Tree) -> tuple:
        paths, shared = t.paths(), t.paths() & common[0]
        return 2 * len(shared) < len(paths | common[0]), -len(shared) - len(t.texts() & common[1]), -len(t.parent), _signed(t.whole[0])

    return min(trees, key=rank)


#: What a page says about a node of the reference with text: its match has the same text or another, and has its number from the back or from the front alone.
_SAME, _VARIED, _BACK, _FORE = range(4)
#: And that the page counts.
_PAGE = -1


def votes(first: Tree, other: Tree) -> list[int]:
    """What a page says about the nodes k of its host's reference, as 4 * k and one of the above; nothing if it is a copy of the reference."""
    if first.whole[0] == other.whole[0] or _copies(first, other):
        return []
    out = [_PAGE]
    for k, j in sorted(match_trees(first, other).items()):
        if first.hash[k]:
            out.append(4 * k + (_SAME if first.hash[k] == other.hash[j] else _VARIED))
            back, fore = first.back[k] == other.back[j], first.fore[k] == other.fore[j]
            if back != fore:
                out.append(4 * k + (_BACK if back else _FORE))
    return out


def induce(skeletons: Iterable[str]) -> dict:
    """The wrapper of a host from skeletons of all its pages; no pages, no wrapper."""
    trees = list({t.whole[0]: t for t in (Tree(json.loads(s)) for s in skeletons)}.values())
    if not trees:
        return {}
    first = reference(trees)
    return conclude(first, Counter(v for t in trees for v in votes(first, t)))


def conclude(first: Tree, counts: dict[int, int]) -> dict:
    """The wrapper of a host from its reference and the counts of what its pages say.

    Nodes whose text is the same on most pages may be template; nodes whose text differs from that on TEMPLATE_PAGES - 1 others, and on too many for a
    template, are slots for certain.  Where no article or main holds the slots, those outside the root are named by their paths.
    """
    n_pages, nodes = 1 + counts.get(_PAGE, 0), range(len(first.hash))
    same = [counts.get(4 * k + _SAME, 0) + bool(first.hash[k]) for k in nodes]
    varied = [counts.get(4 * k + _VARIED, 0) for k in nodes]
    # whether numbers from the back or from the front say better which sibling it is
    backward = [counts.get(4 * k + _BACK, 0) - counts.get(4 * k + _FORE, 0) for k in nodes]
    constant = [n > 1 and 2 * n > n_pages for n in same]
    slots = sum(n for n, c in zip(first.size, constant) if not c)
    # where hardly anything varies, all of the text tells where the content is
    inner = [0 if c and 2 * slots >= sum(first.size) else n for n, c in zip(first.size, constant)]
    for k in range(len(constant) - 1, 0, -1):
        inner[first.parent[k]] += inner[k]
    root = _content_node(first.parent, [first.tag(k) for k in range(len(constant))], inner)
    below, above = [k == root for k in range(len(constant))], set()
    for k in range(1, len(below)):
        below[k] = below[k] or below[first.parent[k]]
    k = root
    while k > 0:
        k = first.parent[k]
        above.add(first.path[k])
    place = [b if n > 0 else f for f, b, n in zip(first.fore, first.back, backward)]
    out = {"root": first.path[root] if root else None, "template": [[place[k], int(h)] for k in range(len(below)) if constant[k] for h in first.hash[k].split()]}
    if root and first.tag(root) not in ("article", "main"):
        over = {first.path[k] for k in range(len(below)) if below[k]} | above
        out["also"] = sorted({first.path[k] for k in range(1, len(below)) if not below[k] and first.size[k] and varied[k] >= TEMPLATE_PAGES - 1 and varied[k] > OTHER_SHARE * same[k]} - over)
    return out


# -- jobs --------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """Lower-case authority of a URL; empty for null and for what has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _of_host(rows: DataFrame, facts: DataFrame, size: Column, deal: Column, how: str) -> DataFrame:
    """Join rows (host, ...) with facts (one row a host), by broadcast if their ``size`` is small in all; else the rows of a host are dealt by a hash."""
    if (facts.agg(F.sum(size + F.length("host"))).head()[0] or 0) <= BROADCAST_CHARS:
        return rows.join(F.broadcast(facts), "host", how)
    dealt = facts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", F.pmod(deal, F.lit(PARTS)).cast("int")).join(dealt, ["host", "part"], how).drop("part")


def _with_wrappers(keyed: DataFrame, wrappers: DataFrame, how: str) -> DataFrame:
    """Join rows (host, html) with the wrappers of their hosts."""
    return _of_host(keyed, wrappers, F.length("wrapper"), F.xxhash64("html"), how)


def _named_pages(pages: DataFrame) -> DataFrame:
    return pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> '' and html <> ''")


def references(pages: DataFrame) -> DataFrame:
    """(host, html, parts): the reference of each host, by counts over all its different pages, and how many parts all its pages make."""

    @F.pandas_udf("page long, nodes int, paths array<long>, texts array<long>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sources in batches:
            trees = (Tree(_nodes(s)) for s in sources)
            rows = [(_signed(t.whole[0]), len(t.parent), list(t.paths()), list(t.texts())) for t in trees]
            yield pd.DataFrame(rows, columns=["page", "nodes", "paths", "texts"])

    named = _named_pages(pages).withColumn("at", F.xxhash64("html"))
    looked = named.select("host", "at", look("html").alias("x")).select("host", "at", "x.*")
    of_page = [F.first(c).alias(c) for c in ("nodes", "paths", "texts")]
    different = materialize(looked.groupBy("host", "page").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"), *of_page))

    whole = materialize(different.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.ceil(F.sum("copies") / PART_PAGES).cast("int").alias("parts")))
    each = lambda c: different.select("host", F.lit(c).alias("kind"), F.explode(c).alias("x"))
    counts = each("paths").unionByName(each("texts")).groupBy("host", "kind", "x").agg(F.count(F.lit(1)).alias("n"))
    frequent = _of_host(counts, whole, F.lit(8), F.xxhash64("x"), "inner").where(2 * F.col("n") > F.col("pages"))
    of_kind = lambda c: F.collect_list(F.when(F.col("kind") == c, F.col("x"))).alias(f"common_{c}")
    common = materialize(frequent.groupBy("host").agg(of_kind("paths"), of_kind("texts")))

    known = _of_host(different, common, 8 * (F.size("common_paths") + F.size("common_texts")), F.xxhash64("page"), "inner")
    shared = F.size(F.array_intersect("paths", "common_paths"))
    unlike = 2 * shared < F.size("paths") + F.size("common_paths") - shared
    rank = F.struct(unlike, -shared - F.size(F.array_intersect("texts", "common_texts")), -F.col("nodes"), F.col("page"))
    best = materialize(known.groupBy("host").agg(F.min_by("at", rank).alias("best")))
    found = _of_host(named, best, F.lit(8), F.col("at"), "inner").where("at = best")
    return found.groupBy("host").agg(F.min("html").alias("html")).join(whole.select("host", "parts"), "host")


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON): every page of a host is aligned with its reference, where it lies, and what pages say is counted by node."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            hosts, keys, says = [], [], []
            for host, is_first, source in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                tree = Tree(_nodes(source.as_py()))
                if is_first:
                    first = tree
                elif said := votes(first, tree):
                    hosts.append(host)
                    keys.append(_signed(tree.whole[0]))
                    says.append(said)
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(says, pa.list_(pa.int32()))], names=["host", "page", "says"])

    @F.pandas_udf("string")
    def wrap(firsts: pd.Series, says: pd.Series, ns: pd.Series) -> pd.Series:
        out = []
        for first, ks, n in zip(firsts, says, ns):
            counts = {} if ks is None else {int(k): int(m) for k, m in zip(ks, n)}
            out.append(json.dumps(conclude(Tree(_nodes(first)), counts), ensure_ascii=False))
        return pd.Series(out, dtype=object)

    # each part of a host's pages lies behind a copy of the reference
    firsts = materialize(references(pages))
    numbered = _named_pages(pages).withColumn("id", F.monotonically_increasing_id())
    dealt = _of_host(numbered, firsts.select("host", "parts"), F.lit(4), F.col("id"), "inner")
    dealt = dealt.select("host", F.pmod("id", "parts").cast("int").alias("part"), F.lit(False).alias("first"), "html")
    ahead = firsts.select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("first"), "html")
    spark = pages.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (firsts.agg(F.sum("parts")).head()[0] or 0) // TASK_PARTS)
    both = dealt.unionByName(ahead).repartition(tasks, "host", "part").sortWithinPartitions("host", "part", F.desc("first"))
    said = both.mapInArrow(tidy(align), "host string, page long, says array<int>")
    once = said.groupBy("host", "page").agg(F.first("says").alias("says"))
    counts = once.select("host", F.explode("says").alias("k")).groupBy("host", "k").agg(F.count(F.lit(1)).alias("n"))
    of_host = materialize(counts.groupBy("host").agg(F.collect_list(F.struct("k", "n")).alias("c")))
    return firsts.join(of_host, "host", "left").select("host", wrap("html", F.col("c.k"), F.col("c.n")).alias("wrapper"))


@lru_cache(maxsize=4096)
def _wrapper(text: str | None) -> dict:
    return json.loads(text) if text else {}


def confirm_templates(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """The wrappers without the template nodes that the whole host does not bear out.

    Counted over all different pages of a host that has such nodes; text whose place holds other text on
    other pages, or beside it, is content.
    """

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, found in batches:
            yield pd.Series([Page(s).template_places(_wrapper(w)["template"]) for s, w in zip(sources, found)], dtype=object)

    @F.pandas_udf("string")
    def keep(found: pd.Series, confirmed: pd.Series) -> pd.Series:
        out = []
        for w, ks in zip(found, confirmed):
            wrapper, good = json.loads(w), set(() if ks is None else (int(k) for k in ks))
            wrapper["template"] = [x for k, x in enumerate(wrapper.get("template", ())) if k in good]
            out.append(json.dumps(wrapper, ensure_ascii=False))
        return pd.Series(out, dtype=object)

    doubtful = wrappers.where("wrapper like '%\"template\": [[%'")
    held = _with_wrappers(_named_pages(pages), doubtful, "inner").select("host", F.xxhash64("html").alias("page"), places("html", "wrapper").alias("ks"))
    # -2**31 counts the page itself
    rows = held.select("host", "page", F.explode(F.concat("ks", F.array(F.lit(-(1 << 31))))).alias("k")).distinct()
    counts = materialize(rows.groupBy("host", "k").agg(F.count(F.lit(1)).alias("n")))
    whole = counts.where(F.col("k") == -(1 << 31)).select("host", F.col("n").alias("pages"))
    other = counts.where(F.col("k").between(-(1 << 31) + 1, -1)).select("host", (-F.col("k") - 1).alias("k"), F.col("n").alias("other"))
    sure = counts.where("k >= 0").join(whole, "host").join(other, ["host", "k"], "left")
    sure = sure.where((F.col("n") >= F.greatest(F.col("pages") * TEMPLATE_SHARE, F.lit(TEMPLATE_PAGES))) & (F.coalesce("other", F.lit(0)) <= F.col("n") * OTHER_SHARE))
    confirmed = sure.groupBy("host").agg(F.collect_list("k").alias("ks"))
    return wrappers.join(confirmed, "host", "left").select("host", keep("wrapper", "ks").alias("wrapper"))


def extract_text(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars`` to each page (url, html).

    Null and empty pages have the empty text.  Pages of no host, or whose host's
    wrapper finds nothing on them, are read by the box with most of their text.  Input columns with these names are
    replaced, all others stay.
    """

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, wrappers in batches:
            yield pd.Series([Page(s).text(_wrapper(w)) if s else "" for s, w in zip(sources, wrappers)], dtype=object)

    wrappers = materialize(confirm_templates(pages, materialize(induce_wrappers(pages))))
    row = pages.drop("text", "n_chars")
    keyed = row.select(F.struct(*(F.col(f"`{c}`") for c in row.columns)).alias("row"), host_of(F.col("url")).alias("host"), F.col("html").alias("html"))
    joined = _with_wrappers(keyed, wrappers, "left").select("row", read("html", "wrapper").alias("text"))
    return joined.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
