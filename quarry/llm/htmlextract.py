"""Main text of web pages: boosted trees over DOM nodes, decoded as a tree.

1. Nodes: every whole page is read into its block elements (inline elements
   belong to the block around them).  Unclosed and implied ends are closed as
   browsers do; scripts, styles, comments and their like never become text, and
   elements that show other things than text (``unseen``) are always OUT.
2. Features of a node: its tag, attribute tokens (class, id, role ...) of its
   own and of its ancestors, depth and position, text and link density of its
   subtree, its share of the page, and the same of its siblings.
3. Boosted trees give each node the probability of OUT (nothing below it is
   main text), IN (its text is main text) and THROUGH (a wrapper: main text
   lies deeper).  They are fitted on the driver on at most ``LAYOUTS`` labelled
   layouts (``pagelayouts``), filled with words of at most ``SAMPLE_PAGES``
   pages drawn by hash, and on those pages themselves where one article or
   main element labels them.
4. Decoding: the most probable labels of the whole tree under the rules that
   below OUT all is OUT, below IN nothing is THROUGH, and a THROUGH node has a
   child that is not OUT -- an upward pass of best sums and a downward pass of
   choices, level by level for all pages of a slice.
5. Text: the runs of IN nodes, character references decoded, white space made
   one space, trimmed, joined by one newline in page order.

Pages are independent, so nothing is shuffled and a task holds one slice.

Defined results: a null or empty page has an empty text; a page cut off inside
a tag loses that tag only; elements nested deeper than ``MAX_DEPTH`` count as
part of the one at that depth, with all their text; repeated rows each get
their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, train
from .pagelayouts import Layouts
from .textscan import slices

OUT, IN, THROUGH = 0, 1, 2
MAX_DEPTH = 512
LAYOUTS = 400
SAMPLE_PAGES = 200
SAMPLE_BYTES = 1 << 16     # pages above it aren't in the sample
SAMPLE_WORDS = 20_000
SLICE = 2 << 20
SEED = 13

# HTML element names by their part in a page.
GROUPS = {
    "article": "article main", "plain": "div section center", "prose": "p blockquote pre address",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl", "item": "li dt dd", "menu": "nav menu",
    "header": "header", "footer": "footer", "aside": "aside dialog",
    "form": "form fieldset button label input legend search", "table": "table tbody thead tfoot caption",
    "cell": "tr td th", "figure": "figure figcaption details summary hr", "page": "#page html body",
    "head": "head", "other": "frameset noframes",
    "unseen": "noscript template svg math canvas audio video object select",
}
GROUP_OF = {tag: i for i, tags in enumerate(GROUPS.values()) for tag in tags.split()}
VOID = set("hr input".split())
RAW = "script style title textarea iframe noembed xmp"      # their content isn't markup
UNSEEN = set(GROUPS["unseen"].split())
ENDS_P = set(GROUP_OF) - UNSEEN - set("button label input legend html body head".split())
IMPLIED = {   # start tag: (open elements that it ends, elements that it stays inside)
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
}
# Tokens of attributes, by what they say about an element.
TOKENS = {
    "content": "article articlebody content contents entry post story text body main hentry page blog news",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs topnav",
    "edge": "header footer masthead colophon copyright top bar legal site",
    "advert": "ad ads advert adverts advertisement sponsor sponsored banner promo promoted adsbygoogle",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe dialog gdpr toast",
    "side": "sidebar aside widget related recommended secondary share social tags trending more teaser",
    "comment": "comment comments commentlist reply replies response responses disqus discussion thread user",
    "form": "form search login signup contact input",
    "hidden": "hidden none invisible",
}
TOKEN_OF = {t: 1 << i for i, ts in enumerate(TOKENS.values()) for t in ts.split()}

_NAME = r"[a-zA-Z][^\s/>]*+"
_REST = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
MARKUP = re.compile(
    rf"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(?P<skip>{RAW.replace(' ', '|')})(?=[\s/>])[^>]*+"
    rf"(?:>.*?(?:</(?P=skip)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|(?P<end>/?)(?P<name>{_NAME})(?P<rest>{_REST})>|/?[a-zA-Z].*\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""",
                       re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ROLE = re.compile(r'data-role="(\w+)"')


@lru_cache(maxsize=1 << 14)
def attribute_bits(rest: str) -> int:
    bits = 0
    for name, value in ATTRIBUTE.findall(rest):
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and "true" in value):
            bits |= TOKEN_OF["hidden"]
        elif name.lower() != "aria-hidden":
            for w in WORDS.findall(value):
                bits |= TOKEN_OF.get(w.lower(), 0)
    return bits


class Pages:
    """The block elements of some pages, in page order, and their text.

    A node's parent comes before it, and its subtree is node..last[node]-1."""

    def __init__(self, roles: bool = False):
        self.tag, self.parent, self.depth, self.bits, self.last = [], [], [], [], []
        self.roles: list | None = [] if roles else None
        self.page = []                      # root node of each page
        self.text, self.owner, self.run, self.linked = [], [], [], []
        self.runs = 0

    def _open(self, tag: str, parent: int, depth: int, rest: str) -> int:
        self.tag.append(GROUP_OF.get(tag, GROUP_OF["noframes"]))
        self.parent.append(parent)
        self.depth.append(depth)
        self.bits.append(attribute_bits(rest) if rest else 0)
        self.last.append(0)
        if self.roles is not None:
            found = ROLE.search(rest)
            self.roles.append(found[1] if found else tag if tag in ("article", "main") else "")
        return len(self.tag) - 1

    def add(self, page: str) -> None:
        root = self._open("#page", -1, 0, "")
        self.page.append(root)
        stack, names = [root], ["#page"]
        link = 0                            # open elements where a link began
        at = 0

        def close(size: int) -> None:
            while len(stack) > size:
                self.last[stack.pop()] = len(self.tag)
                names.pop()

        def say(text: str) -> None:
            if text:
                self.text.append(entities.unescape(text) if "&" in text else text)
                self.owner.append(stack[-1])
                self.run.append(self.runs)
                self.linked.append(link > 0)

        for m in MARKUP.finditer(page):
            if m.start() > at:
                say(page[at:m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if name not in GROUP_OF and "-" not in name:      # inline
                if name == "br":
                    say(" ")
                elif name == "a":
                    link = 0 if m["end"] else len(stack)
                continue
            unseen = name in UNSEEN
            self.runs += not unseen         # text goes on after them
            if m["end"]:
                if name in names and name not in ("html", "body"):
                    close(len(names) - 1 - names[::-1].index(name))
            else:
                if names[-1] == "p" and name in ENDS_P:
                    close(len(stack) - 1)
                if name in IMPLIED:
                    ends, inside = IMPLIED[name]
                    low = 0
                    for i in range(len(names) - 1, 0, -1):
                        if names[i] in inside:
                            break
                        if names[i] in ends:
                            low = i
                    if low:
                        close(low)
                whole = unseen and m["rest"].endswith("/")
                if name not in VOID and not whole and len(stack) < MAX_DEPTH:
                    stack.append(self._open(name, stack[-1], len(stack), m["rest"]))
                    names.append(name)
            if link > len(stack):
                link = 0
        if at < len(page):
            say(page[at:])
        close(0)
        self.runs += 1

    def arrays(self):
        kinds = (("tag", np.int16), ("parent", np.int64), ("depth", np.int64), ("bits", np.int64),
                 ("last", np.int64), ("page", np.int64), ("owner", np.int64))
        return [np.array(getattr(self, n), dtype=k) for n, k in kinds]


def features(p: Pages) -> np.ndarray:
    """Features x nodes."""
    tag, parent, depth, bits, last, page, owner = p.arrays()
    n = len(tag)
    up = np.maximum(parent, 0)
    solid = [len(x) - x.count(" ") for x in p.text]
    size = np.array(solid, dtype=np.float64)
    stops = np.array([sum(map(x.count, ".,;:!?")) for x in p.text], dtype=np.float64)
    link = size * np.array(p.linked, dtype=np.float64)

    def own(w):
        return np.bincount(owner, weights=w, minlength=n)

    def below(w):
        total = np.concatenate(([0.0], np.cumsum(w)))
        return total[last] - total[np.arange(n)]

    def tags(*names):
        return np.isin(tag, [list(GROUPS).index(x) for x in names]).astype(np.float64)

    chars, marks, links = own(size), own(stops), own(link)
    all_chars, all_marks, all_links = below(chars), below(marks), below(links)
    root = page[np.searchsorted(page, np.arange(n), side="right") - 1]
    whole = np.maximum(all_chars[root], 1)
    blocks = (last - np.arange(n)).astype(np.float64)
    inherited = bits.copy()                         # tokens of the ancestors, level by level
    for d in range(1, int(depth.max(initial=0)) + 1):
        on = np.flatnonzero(depth == d)
        inherited[on] |= inherited[parent[on]]
    inherited_up = np.where(parent >= 0, inherited[up], 0)
    down_tags = tags("menu", "header", "footer", "aside", "form").astype(bool)
    inside = down_tags.copy()
    good = tags("article").astype(bool)
    for d in range(1, int(depth.max(initial=0)) + 1):
        on = np.flatnonzero(depth == d)
        inside[on] |= inside[parent[on]]
        good[on] |= good[parent[on]]
    kids = np.bincount(up[parent >= 0], minlength=n).astype(np.float64)
    kid_chars = np.bincount(up[parent >= 0], weights=all_chars[parent >= 0], minlength=n)
    order = np.lexsort((np.arange(n), parent))      # siblings next to each other
    index, before, after = np.zeros(n), np.zeros(n), np.zeros(n)
    same = parent[order[1:]] == parent[order[:-1]]
    head = np.concatenate(([True], ~same)) if n else np.zeros(0, dtype=bool)
    start = np.flatnonzero(head)
    index[order] = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    before[order[1:]] = np.where(same, all_chars[order[:-1]], 0)
    after[order[:-1]] = np.where(same, all_chars[order[1:]], 0)
    prose = below(tags("prose"))
    log = np.log1p
    rows = [tag == i for i in range(len(GROUPS))]
    rows += [bits >> i & 1 for i in range(len(TOKENS))]
    rows += [inherited_up >> i & 1 for i in range(len(TOKENS))]
    rows += [inside, good, np.where(parent >= 0, tag[up], -1), np.minimum(depth, 20),
             log(all_chars), log(chars), all_links / np.maximum(all_chars, 1),
             all_marks / np.maximum(all_chars, 1), all_chars / blocks, log(blocks), log(prose), log(kids),
             prose / blocks, below(tags("item")) / blocks, below(tags("menu", "header", "footer", "aside", "form")) > 0,
             below(tags("article")) > 0, below(tags("heading")) / blocks, all_chars / whole, log(whole),
             below((bits > 0).astype(np.float64)) / blocks, (np.arange(n) - root) / np.maximum(last[root] - root, 1),
             index, np.where(parent >= 0, kids[up] - 1, 0), log(before), log(after),
             all_chars / np.maximum(np.where(parent >= 0, kid_chars[up], all_chars), 1),
             np.where(parent >= 0, all_links[up] / np.maximum(all_chars[up], 1), 0),
             np.where(parent >= 0, log(all_chars[up]), 0)]
    return np.array(rows, dtype=np.float32).reshape(len(rows), n)


def decode(parent: np.ndarray, depth: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Labels of the greatest summed score (3 x nodes) under the rules."""
    n = score.shape[1]
    best = score.astype(np.float64).copy()
    any_, need = np.zeros(n), np.zeros(n)
    turn = np.full(n, -np.inf)               # of the children: least loss for one that is not OUT
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=-1)) + 1)]
    for on in reversed(levels):
        best[THROUGH, on] += turn[on]        # minus infinity without children
        inner = np.maximum(best[OUT, on], best[IN, on])
        free = np.maximum(inner, best[THROUGH, on])
        some = np.maximum(best[IN, on], best[THROUGH, on])
        any_[on], need[on] = free, some - free
        kid = on[parent[on] >= 0]
        up = parent[kid]
        np.add.at(best[OUT], up, best[OUT, kid])
        np.add.at(best[IN], up, np.maximum(best[OUT, kid], best[IN, kid]))
        np.add.at(best[THROUGH], up, any_[kid])
        np.maximum.at(turn, up, need[kid])
    label = np.zeros(n, dtype=np.int64)
    forced = np.zeros(n, dtype=bool)
    if n:   # the child that loses least by not being OUT; the first of equals
        order = np.lexsort((np.arange(n), -need, parent))
        lead = np.ones(n, dtype=bool)
        lead[1:] = parent[order[1:]] != parent[order[:-1]]
        forced[order[lead]] = True
    for on in levels:
        above = np.where(parent[on] >= 0, label[np.maximum(parent[on], 0)], THROUGH)
        allowed = best[:, on].copy()
        allowed[IN, above == OUT] = -np.inf
        allowed[THROUGH, above != THROUGH] = -np.inf
        allowed[OUT, (above == THROUGH) & forced[on] & (parent[on] >= 0)] = -np.inf
        label[on] = allowed.argmax(axis=0)
    return label


def _joined(p: Pages, label: np.ndarray) -> list[str]:
    """The text of each page: its runs in IN nodes."""
    out: list[list[str]] = [[] for _ in p.page]
    owner = np.array(p.owner, dtype=np.int64)
    page = np.searchsorted(np.array(p.page, dtype=np.int64), owner, side="right") - 1
    run, pieces, where = -1, [], -1

    def flush():
        text = " ".join("".join(pieces).split())
        if text:
            out[where].append(text)

    for i in np.flatnonzero(label[owner] == IN).tolist():
        if p.run[i] != run:
            if pieces:
                flush()
            run, pieces, where = p.run[i], [], int(page[i])
        pieces.append(p.text[i])
    if pieces:
        flush()
    return ["\n".join(x) for x in out]


def extract(trees: Trees, htmls: list[str]) -> list[str]:
    p = Pages()
    for h in htmls:
        p.add(h)
    if not p.tag:
        return []
    parent, depth = np.array(p.parent, dtype=np.int64), np.array(p.depth, dtype=np.int64)
    score = trees.scores(features(p))
    unseen = np.array(p.tag) == GROUP_OF["svg"]
    score[:, unseen] = np.array([[0.0], [-1e9], [-1e9]])
    return _joined(p, decode(parent, depth, score))


# ----------------------------------------------------------------- training

def labelled(htmls: list[str], self_labelled: bool) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of pages whose parts are marked by data-role, or of
    real pages with one article or main element."""
    p = Pages(roles=True)
    for h in htmls:
        p.add(h)
    tag, parent, depth, _, last, page, _ = p.arrays()
    n = len(tag)
    label = np.zeros(n, dtype=np.int64)
    keep = np.zeros(n, dtype=bool)
    outs = {GROUP_OF[x] for x in ("nav", "header", "footer", "aside", "form", "head")}
    for lo in page:
        hi = last[lo]
        marks = ("article", "main") if self_labelled else ("article",)
        roots = [i for i in range(lo, hi) if p.roles[i] in marks]
        if not self_labelled:
            roots = [i for i in roots if not any(j < i < last[j] for j in roots)]
        if len(roots) != 1:
            continue
        keep[lo:hi] = True
        main = roots[0]
        i = main
        label[main:last[main]] = IN
        while parent[i] >= 0:
            i = parent[i]
            label[i] = THROUGH
        for i in range(main + 1, last[main]):
            if (tag[i] in outs) if self_labelled else p.roles[i] not in ("", "article"):
                label[i:last[i]] = OUT
    return features(p)[:, keep], label[keep]


def fit(htmls: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> Trees:
    """Trees fitted on layouts with the words of ``htmls``, and on ``htmls``."""
    p = Pages()
    for h in htmls:
        p.add(h)
    words = " ".join(p.text).split()[:SAMPLE_WORDS]
    made = Layouts([entities.escape(w) for w in words], seed)
    x, y = labelled([made.page() for _ in range(layouts)], False)
    if htmls:
        own_x, own_y = labelled(htmls, True)
        x, y = np.concatenate((x, own_x), axis=1), np.concatenate((y, own_y))
    return train(x, y, 3)


def train_extractor(pages: DataFrame) -> Trees:
    """Trees from a bounded sample of the pages, the same in every run."""
    some = pages.filter(F.octet_length("html").between(1, SAMPLE_BYTES)) \
        .select("html", F.xxhash64("page_id", "html").alias("h"))
    # about four times the sample leaves the tasks, however many pages there are
    share = min(1.0, 4 * SAMPLE_PAGES / max(some.count(), 1))
    near = some.filter(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40))) \
        .groupBy("h").agg(F.min("html").alias("html"))
    return fit([r["html"] for r in near.orderBy("h").limit(SAMPLE_PAGES).collect()])


def main_text(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or train_extractor(pages))

    def run(batches):
        for b in slices(batches, "html", SLICE):
            texts = extract(shared.value, [x or "" for x in b.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, type=pa.string()),
                 pa.array([len(t) for t in texts], type=pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
