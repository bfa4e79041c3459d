"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into its leaf blocks: stretches of text between block-level tags, each with its chain
of ancestor tags. A block's features are its ancestors (tags, and what their class, id and role names
speak of, and whether they are hidden), its parent, its text (length, links, punctuation, cue words) and its place. The CRF labels
each block main or other; its weights are fitted on labelled pages (see html_labelled.py) by maximum
likelihood with forward-backward sums, and pages are decoded by Viterbi. Elements that never hold text
of the page (head, script, style and the like) are not parsed into blocks.

The page is scanned from mark to mark, so nothing inside a comment, a script or an attribute is taken for
a tag. An attribute's quotes open after = only. <head> ends at its end tag, at the first start tag that
can't be inside it, or at text. A dead element with markup in it (svg, object and the like) that isn't
closed before the end tag of its parent, or at all, is read as if its tag weren't there; an unclosed
comment or quote ends at the next >, an unclosed title at the next <, an unclosed script where the head or
body does: none takes the rest of the page along. Blocks share the element they stand in, so time and memory
grow with the page's length, however deep it is nested.

Defined cases: null or empty html has no blocks and an empty text; broken markup is parsed as far as it
goes (an unclosed tag at the end is dropped, end tags close what they can); page_id and url may be null
or repeated (each row gets its own result, equal pages equal ones); of equally likely labels `other` is taken; very
long pages are read whole; an
empty table gives an empty result; extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches

# Fixed values of HTML: elements by their role in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
DEAD = frozenset("script style noscript template textarea svg iframe object canvas audio video title noframes".split())
#: Dead elements whose content is not markup: up to their own end tag.
RAW = frozenset("script style textarea title iframe noframes".split())
#: Tags that may stand inside <head>; any other start tag ends it.
HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template html head".split())
CLOSES_P = BLOCK - {"button", "option", "caption", "legend"}
TAGS = ("article main section div nav header footer aside form ul ol li table td th p h1 h2 h3 h4 blockquote pre figure figcaption button select dl dialog body details address".split())
#: What names in class, id, role and aria-label speak of.
NAMES = {
    "ad": r"\bads?\b|advert|sponsor|promo|banner|commercial|\bad[-_]|[-_]ad\b|doubleclick|affiliate",
    "nav": r"\bnav|menu|breadcrumb|pagination|pager|toolbar|topbar|skip|\btabs?\b",
    "head": r"header|masthead|logo|site-?title|hero",
    "foot": r"footer|copyright|legal|imprint|bottom",
    "comment": r"comment|repl(y|ies)|disqus|discussion|responses?\b|feedback|review",
    "notice": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri|paywall|notification|toast|disclaimer",
    "side": r"side|widget|related|recommend|trending|popular|latest|more-|share|social|rail|tag-?(list|cloud)|author-?(box|bio)|complementary",
    "form": r"form|search|login|sign-?(in|up)|input|contact",
    "main": r"article|content|post|entry|\bmain\b|body|story|\btext\b|page",
}
CUES = {
    "cue_notice": r"cookie|consent|privacy|datenschutz|newsletter|subscribe|sign up|sign in|log ?in|accept all",
    "cue_foot": r"©|\(c\) |copyright|all rights reserved|terms of|impressum",
    "cue_ad": r"advertis|sponsored|buy now|% off|anzeige|publicité|publicidad|shop now|discount",
    "cue_list": r"read more|related|share|tweet|comments?\b|repl(y|ies)|leave a|previous|next|home\b|menu|more from|follow us|posted by",
}
_NAME = {k: re.compile(v, re.I) for k, v in NAMES.items()}
_CUE = {k: re.compile(v, re.I) for k, v in CUES.items()}
#: What `<` may open: a tag's name, a comment, a character-data section, or another declaration.
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/<>]*)|!--|!\[CDATA\[|[!?/])")
#: The rest of an ordinary tag: quotes open after = only, and hold neither < nor >.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"<>]*"|'[^'<>]*'|(?!["'])))*+>""")
_STOP = re.compile(r""">|=\s*(["'])""")
_ATTR = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|aria-label|aria-hidden|style|hidden)(?![\w-])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Values of style that take an element out of sight.
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: An element that ends itself; a slash may also be the end of an unquoted value.
_EMPTY = re.compile(r"(?s)(?:.*[\s\"'])?/\s*\Z").match
#: Where an unclosed raw element ends at the latest.
_PAST = re.compile(r"</head\b|</?body\b|</html\b", re.I)
#: Start tags that close an open element of their kind, and what shields it: (closed, closing tags, shields).
_SCOPES = [
    (frozenset("p".split()), CLOSES_P, frozenset("div td th li section article button table body".split())),
    (frozenset("li".split()), frozenset("li".split()), frozenset("ul ol dl table select div body".split())),
    (frozenset("dd dt".split()), frozenset("dd dt".split()), frozenset("ul ol dl table div body".split())),
    (frozenset("option".split()), frozenset("option".split()), frozenset("select ul ol table div body".split())),
    (frozenset("td th".split()), frozenset("td th".split()), frozenset("tr tbody table div body".split())),
    (frozenset("tr".split()), frozenset("tr".split()), frozenset("tbody table div body".split())),
]


@functools.lru_cache(maxsize=20_000)
def _spoken(attrs: str) -> frozenset[str]:
    """What an element's names speak of; `hidden` if it isn't shown."""
    names, unseen = [], False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("hidden", "aria-hidden", "style"):
            unseen |= key == "hidden" or key == "style" and bool(_UNSEEN.search(value)) or value.lower() == "true"
        else:
            names.append(re.sub(r"([a-z])([A-Z])", r"\1-\2", value))
    said = " ".join(names).replace("_", "-")
    return frozenset([k for k, r in _NAME.items() if said and r.search(said)] + ["hidden"] * unseen)


def _tag_end(page: str, at: int) -> int:
    """Where a tag ends whose name ends at `at`. A quote that opens after = and isn't closed, or is closed
    only by the next tag's opening quote, ends with the tag at the first >."""
    if m := _REST.match(page, at):
        return m.end()
    while m := _STOP.search(page, at):
        if not m.group(1):
            return m.end()
        start = m.end()
        end = page.find(m.group(1), start)
        if end < 0 or page[end + 1 : end + 2] not in ("", ">", "/") and not page[end + 1].isspace() and page.find(">", start, end) >= 0:
            return page.find(">", start) + 1 or len(page)
        at = end + 1
    return len(page)


def scan(page: str) -> list[tuple[int, int, str, str, str]]:
    """The page's marks in order: (start, end, kind, tag, attributes); kind is "<", "/" or, for character data,
    "!". Comments and declarations have an empty tag. A raw element's mark reaches to the end of its end tag.
    Time is linear in the page: a search that found nothing isn't made again."""
    out, at, never = [], 0, set()

    def find(what: str, start: int) -> int:
        k = -1 if what in never else page.find(what, start)
        if k < 0:
            never.add(what)
        return k

    while m := _OPEN.search(page, at):
        start, tag = m.start(), (m.group(2) or "").lower()
        if tag:
            at = _tag_end(page, m.end())
            attrs = page[m.end() : at - 1]
            kind = "/" if m.group(1) else "<"
            if kind == "<" and tag in RAW and not _EMPTY(attrs):
                closing = None if tag in never else re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                if closing:
                    at = closing.end()
                else:  # an unclosed title ends at the next mark, other raw text where the head or body does
                    never.add(tag)
                    past = None if "past" in never else _PAST.search(page, at)
                    if not past:
                        never.add("past")
                    k = find("<", at) if tag in ("title", "textarea") else past.start() if past else len(page)
                    at = k if k >= 0 else len(page)
            out.append((start, at, kind, tag, attrs))
        elif m.group() == "<![CDATA[" and (k := find("]]>", m.end())) >= 0:
            at = k + 3
            out.append((start, at, "!", "", page[m.end() : k]))
        else:
            k = find("-->", start + 2) if m.group() == "<!--" else -1
            at = k + 3 if k >= 0 else find(">", m.end()) + 1 or len(page)
            out.append((start, at, "<", "", ""))
    return out


def _dead_ends(marks: list[tuple[int, int, str, str, str]]) -> dict[int, int]:
    """For the start mark of each closed dead element with markup in it, the number of its end mark."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    n: dict[str, int] = {}
    noscript = [i for i, m in enumerate(marks) if m[3] == "noscript"]
    after = {i: j for i, j in zip(noscript, noscript[1:]) if marks[j][2] == "/"}
    i = 0
    while i < len(marks):
        _, _, kind, tag, attrs = marks[i]
        if tag == "head" or tag in DEAD or tag in BLOCK:
            if kind == "/":
                while n.get(tag):
                    top, start = stack.pop()
                    n[top] -= 1
                    if top == tag:
                        if tag in DEAD:
                            ends[start] = i
                        break
            elif tag == "noscript":  # can't be nested, and end tags in it close nothing outside
                if i in after:
                    ends[i] = i = after[i]
            elif tag not in RAW and not (tag in DEAD and _EMPTY(attrs)):
                stack.append((tag, i))
                n[tag] = n.get(tag, 0) + 1
        i += 1
    return ends


class Node:
    """An open element. What a block below it inherits (tags above it, names they speak of, the nearest such
    names, and the elements that a start tag may close) is kept here once, so blocks only point to it."""

    __slots__ = ("tag", "depth", "above", "near", "scopes", "_base")

    def __init__(self, tag: str, spoken: frozenset[str], parent: Node | None):
        self.tag, self.depth, self._base = tag, parent.depth + 1 if parent else 1, None
        mine = {f"in_{tag}", *(f"name_{s}" for s in spoken)}
        above = parent.above if parent else frozenset()
        self.above = above if mine <= above else above | mine
        self.near = frozenset(f"near_{s}" for s in spoken) if spoken - {"hidden"} else parent.near if parent else frozenset()
        # the depth of the nearest open element of each scope that nothing shields
        self.scopes = tuple(self.depth if tag in closed else 0 if tag in shields else was for (closed, _, shields), was in zip(_SCOPES, parent.scopes if parent else (0,) * len(_SCOPES)))

    @property
    def base(self) -> frozenset[str]:
        """The features that every block right below this element has."""
        if self._base is None:
            own = {f"parent_{self.tag}", "depth_1" if self.depth < 2 else "depth_2_3" if self.depth < 4 else "depth_4"}
            if "in_header" in self.above and ("in_article" in self.above or "in_main" in self.above):
                own.add("article_header")
            if self.tag == "body":
                own.add("bare")
            self._base = self.above | self.near | own
        return self._base


class Block:
    """A leaf block: its text, the share of it in links, and the element that it stands in (None: none)."""

    __slots__ = ("text", "link", "node")

    def __init__(self, text: str, link: float, node: Node | None):
        self.text, self.link, self.node = text, link, node


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks in page order."""
    page, out = page or "", []
    stack: list[Node] = []
    places: dict[str, list[int]] = {}  # of each tag, the places in the stack
    text: list[str] = []
    linked = anchor = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, linked / sum(map(len, text)), stack[-1] if stack else None))
            text.clear()
            linked = 0

    def close_from(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]

    marks = scan(page)
    ends = _dead_ends(marks) if any(m[3] in DEAD and m[3] not in RAW for m in marks) else {}
    at, head, i = 0, False, -1
    while (i := i + 1) < len(marks):
        start, end, kind, tag, attrs = marks[i]
        if start > at:
            piece = page[at:start]
            head = head and not piece.strip()
            if not head:
                text.append(piece)
                linked += len(piece) * bool(anchor)
        at = end
        if kind == "!" and not head:
            text.append(html.escape(attrs))
        if not tag:
            continue
        close = kind == "/"
        if tag == "head":
            head = not close and not out and not stack and not "".join(text).strip()
            continue
        if head and tag not in HEAD:
            if close and tag not in ("body", "br"):
                continue
            head = False
        if tag in DEAD:
            if not close and i in ends:
                i = ends[i]
                at = marks[i][1]
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            anchor = 0 if close else 1
            continue
        if tag not in BLOCK:
            continue
        flush()
        anchor = 0
        if close:
            if places.get(tag):
                close_from(places[tag][-1])
            continue
        for k, (_, closing, _) in enumerate(_SCOPES):
            if stack and tag in closing and stack[-1].scopes[k]:
                close_from(stack[-1].scopes[k] - 1)
        if tag not in VOID and tag != "html" and not (tag == "body" and places.get("body")):
            places.setdefault(tag, []).append(len(stack))
            spoken = _spoken(attrs) if attrs and tag != "body" else frozenset()
            stack.append(Node(tag, spoken, stack[-1] if stack else None))
    if at < len(page) and not (head and not page[at:].strip()):
        piece = page[at:]
        text.append(piece)
        linked += len(piece) * bool(anchor)
    flush()
    return out


FEATURES = [
    "one", *(f"in_{t}" for t in TAGS), *(f"parent_{t}" for t in TAGS), *(f"name_{n}" for n in NAMES), *(f"near_{n}" for n in NAMES), "name_hidden", *CUES,
    "article_header", "bare", "words_1", "words_2_4", "words_5_9", "words_10_24", "words_25", "links_none", "links_some", "links_most",
    "ends_stop", "commas", "no_stop", "pipes", "digits", "first", "last", "head_tenth", "tail_tenth", "heading_next_text", "after_h1", "before_h1",
    "alone", "few", "depth_1", "depth_2_3", "depth_4",
]
_AT = {f: i for i, f in enumerate(FEATURES)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NOWHERE = frozenset({"bare", "depth_1"})


def features(blocks: list[Block]) -> list[list[int]]:
    """The indices of each block's features."""
    out, n = [], len(blocks)
    h1 = next((i for i, b in enumerate(blocks) if b.node and b.node.tag == "h1"), None)
    for i, b in enumerate(blocks):
        got = {"one"}
        words = b.text.count(" ") + 1
        got.add("words_1" if words < 2 else "words_2_4" if words < 5 else "words_5_9" if words < 10 else "words_10_24" if words < 25 else "words_25")
        got.add("links_none" if b.link == 0 else "links_some" if b.link < 0.5 else "links_most")
        last = b.text[-1]
        got.add("ends_stop" if last in ".!?…»”\"。:" else "no_stop")
        if "," in b.text:
            got.add("commas")
        if any(c in b.text for c in "|·•»›"):
            got.add("pipes")
        if words < 25:
            if any(c.isdigit() for c in b.text):
                got.add("digits")
            got |= {k for k, r in _CUE.items() if r.search(b.text)}
        if n == 1:
            got.add("alone")
        elif n < 4:
            got.add("few")
        if i == 0:
            got.add("first")
        if i == n - 1:
            got.add("last")
        if 10 * i < n:
            got.add("head_tenth")
        if 10 * i >= 9 * n:
            got.add("tail_tenth")
        if b.node and b.node.tag in _HEADINGS and i + 1 < n and blocks[i + 1].text.count(" ") > 8:
            got.add("heading_next_text")
        if h1 is not None:
            got.add("after_h1" if i >= h1 else "before_h1")
        got |= b.node.base if b.node else _NOWHERE
        out.append(sorted(_AT[g] for g in got if g in _AT))
    return out


class Crf:
    """A two-label chain: weights of features for `main` against `other`, start and transition weights."""

    def __init__(self, w: np.ndarray | None = None, trans: np.ndarray | None = None, start: np.ndarray | None = None):
        self.w = np.zeros(len(FEATURES)) if w is None else w
        self.trans = np.zeros((2, 2)) if trans is None else trans
        self.start = np.zeros(2) if start is None else start

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], rounds: int = 300, rate: float = 0.2, l2: float = 2e-5) -> Crf:
        """Maximum likelihood by Adam over all pages at once; pages are padded to one length."""
        pages = [p for p in pages if p[1]]
        n, longest = len(pages), max(len(y) for _, y in pages)
        x = np.zeros((n, longest, len(FEATURES)), np.float32)
        y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (rows, labels) in enumerate(pages):
            for j, row in enumerate(rows):
                x[i, j, row] = 1
            y[i, : len(labels)], mask[i, : len(labels)] = labels, True
        flat = x.reshape(-1, len(FEATURES))
        theta = np.zeros(len(FEATURES) + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        pair = mask[:, 1:]
        for t in range(1, rounds + 1):
            w, trans, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
            emit = np.zeros((n, longest, 2))
            emit[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, longest)
            fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
            fwd[:, 0] = start + emit[:, 0]
            for j in range(1, longest):
                s = fwd[:, j - 1, :, None] + trans[None]
                s = np.logaddexp(s[:, 0], s[:, 1]) + emit[:, j]
                fwd[:, j] = np.where(mask[:, j, None], s, fwd[:, j - 1])
            for j in range(longest - 2, -1, -1):
                s = trans[None] + (emit[:, j + 1] + bwd[:, j + 1])[:, None, :]
                s = np.logaddexp(s[:, :, 0], s[:, :, 1])
                bwd[:, j] = np.where(mask[:, j + 1, None], s, 0)
            z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
            post = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
            gap = (y * mask - post[:, :, 1]).astype(np.float32)
            grad = np.empty_like(theta)
            grad[:-6] = gap.reshape(-1) @ flat
            both = np.exp(fwd[:, :-1, :, None] + trans[None, None] + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
            seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
            grad[-6:-2] = (seen - both.sum(axis=(0, 1))).ravel()
            grad[-2:] = np.bincount(y[:, 0], minlength=2) - post[:, 0].sum(axis=0)
            grad = grad / mask.sum() - l2 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, self.trans, self.start = theta[:-6].copy(), theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy()
        return self

    def viterbi(self, rows: list[list[int]]) -> list[int]:
        """The most likely labels."""
        if not rows:
            return []
        w, (aa, ab), (ba, bb) = self.w, *([self.trans[0].tolist()]), *([self.trans[1].tolist()])
        other, main = float(self.start[0]), float(self.start[1] + w[rows[0]].sum())
        back: list[tuple[int, int]] = []
        for row in rows[1:]:
            e = float(w[row].sum())
            o0, o1, m0, m1 = other + aa, main + ba, other + ab, main + bb
            back.append((int(o1 > o0), int(m1 > m0)))
            other, main = max(o0, o1), max(m0, m1) + e
        label = int(main > other)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = blocks_of(page)
        return "\n".join(b.text for b, y in zip(blocks, self.viterbi(features(blocks))) if y)


@functools.cache
def trained(pages: int = 600, seed: int = 7) -> Crf:
    """The CRF fitted on `pages` labelled pages (a documented, fixed bound)."""
    from .html_labelled import labelled_pages

    data = []
    for page, main in labelled_pages(pages, seed):
        blocks = blocks_of(page)
        data.append((features(blocks), [int(b.text in main) for b in blocks]))
    return Crf().fit(data)


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", model: Crf | None = None) -> DataFrame:
    """Per row: page_id, url, text and n_chars."""
    modest_batches(df.sparkSession)
    crf = model or trained()
    kinds = [df.schema[c].dataType.simpleString() for c in (page_id, url)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [crf.main_text(p) for p in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    cols = [F.col(f"`{c}`").alias(n) for c, n in ((page_id, "page_id"), (url, "url"), (page, "html"))]
    return df.select(*cols).mapInPandas(rows, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
