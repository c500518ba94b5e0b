"""HTML extraction with gradient-boosted trees over DOM-node features.

Every page becomes a small tree of elements. Each element has features of its subtree's density (text, tags,
links), its depth, its siblings (place, share, the largest one before and after it), its kind, whether an article holds it,
and the evidence of its attribute tokens and of those above it. Boosted trees score each element as content or
not.

Labels come from two places: small pages written by rule (`written_pages`), whose author marks every part as content or not,
under many names, kinds and layouts, with parts that have no name and names that mislead; and a bounded sample of the
table's pages, where elements inside article or main, and inside nav, footer, aside or form, are taken at their kind. The
latter train without kind and tokens, so they can't repeat the kind, only show what such text looks like here.

What a token says is its log-odds among labelled elements, learned in two steps. Trees without any token are fitted first; they
read the sampled pages by structure, and each page votes once for every token of an element that they and the decoding are
sure of (`_named`). Votes of LEAST_VOTES pages or more are added to the counts of the written pages, so a table's own names
count, also against what the written pages say of them. Tokens are hashed, so the evidence has a fixed bound.

Tokens of html and body, and of an article or main with most of the page's text, describe the page and are not
evidence; nor are names of states (no-sidebar, comments-open) or classes of headings. Decoding is hierarchical: below
a dropped element everything is dropped, and the choice of all elements of a page together is the best one of that
form, so no element contradicts its ancestors.

Cases: null and empty pages give an empty text; unclosed and cut-off markup is closed at the end; a page
of plain text is content; a head without an end tag ends where the body's content starts; a slash at the end of a tag closes
nothing but void and drawing elements, as in HTML; repeated rows and ids are extracted like any other; pages of any length
and depth are read whole; columns besides page_id, url and html are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The classifier's bounds: sampled pages and training elements; depths from which on elements look alike.
MAX_PAGES, MAX_NODES, MAX_DEPTH = 400, 10_000, 12
#: Places for hashed tokens, pages that must vote on one, and the score from which the trees without tokens are sure.
TOKEN_PLACES, LEAST_VOTES, SURE = 1 << 18, 3, 2.0

# Kinds of elements, and the tokens by which a page names its parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp".split())
BLOCKS = set("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HEAD = set("title meta link base script style noscript template".split())
NEVER = set("script style noscript template iframe head title svg canvas select button input textarea object".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH_ENDS = BLOCKS - {"body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "option", "legend", "summary", "figcaption"} | {"p"}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
CONTENT_KINDS = {"article", "main"}
OTHER_KINDS = {"nav", "footer", "aside", "form", "dialog", "menu"}
DRAWN = {"path", "circle", "rect", "line", "polygon", "polyline", "ellipse", "use", "stop", "g", "image"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Parts of names that tell a state of the page, not what the element is.
STATES = {"no", "non", "without", "with", "has", "is", "free", "open", "opened", "closed", "enabled", "disabled", "hidden", "single", "off", "on"}
KINDS = ["html", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "form", "figure", "blockquote", "pre", "span", "a", "b", "td"]

KIND_AT = {k: i for i, k in enumerate(KINDS)}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAMES = re.compile(r"[a-z]+(?:[-_]+[a-z]+)*")
PARTS = re.compile(r"[a-z]+")
MARK = re.compile(r"\bdata-keep=\"([01])\"")
SPACE = re.compile(r"\s+")


def place_of(token: str) -> int:
    return zlib.crc32(token.encode()) % TOKEN_PLACES


def names(attributes: str) -> frozenset:
    """The parts of an element's names, hashed; a name that tells a state gives none."""
    found: set[int] = set()
    for a in ATTRIBUTE.finditer(attributes):
        for name in NAMES.findall((a[2] or a[3] or a[4] or "").lower()):
            parts = PARTS.findall(name)
            if not STATES.intersection(parts):
                found.update(map(place_of, parts))
    return frozenset(found)


class Node:
    __slots__ = ("below", "depth", "kind", "mark", "parent", "tokens")

    def __init__(self, kind: str, parent: int, depth: int, tokens: frozenset, mark: int = -1):
        self.kind, self.parent, self.depth, self.tokens, self.mark, self.below = kind, parent, depth, tokens, mark, 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """(elements in page order, the root first; runs of text by element, with None where a block begins or
    ends)."""
    nodes, runs, stack, at = [Node("#root", -1, 0, frozenset())], [], [0], 0
    opened: dict[str, int] = {}

    def text(piece: str) -> None:
        if piece:
            if nodes[stack[-1]].kind == "head" and piece.strip(" \t\n\r\f"):
                close("head")
            runs.append((stack[-1], entities.unescape(piece) if "&" in piece else piece))

    def close(kind: str, within: set | frozenset = frozenset()) -> None:
        if not opened.get(kind):
            return
        for i in range(len(stack) - 1, 0, -1):
            k = nodes[stack[i]].kind
            if k == kind:
                if any(nodes[x].kind in BLOCKS for x in stack[i:]):
                    runs.append((stack[i], None))
                for x in stack[i:]:
                    opened[nodes[x].kind] -= 1
                del stack[i:]
                return
            if k in within:
                return

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        kind = m[2].lower()
        if m[1]:
            if kind == "br":
                runs.append((stack[-1], " "))
            else:
                close(kind)
            continue
        # </head> may be left out: a head ends at the first tag or text that can't stand in it. What can is never
        # left open here, so an open head is the last on the stack.
        if nodes[stack[-1]].kind == "head" and kind not in HEAD:
            close("head")
        if kind in PARAGRAPH_ENDS and opened.get("p"):
            close("p", {"table", "button", "object"})
        for other in CLOSES.get(kind, ()):
            close(other, SCOPES.get(kind, frozenset()))
        rest = m[3] or ""
        parent = stack[-1]
        mark = MARK.search(rest)
        nodes.append(Node(kind, parent, len(stack), names(rest) if rest else frozenset(), int(mark[1]) if mark else -1))
        nodes[parent].below += 1
        me = len(nodes) - 1
        if kind == "br":
            runs.append((parent, " "))
        elif kind in BLOCKS:
            runs.append((me, None))
        if kind in VOID or kind in DRAWN and rest.endswith("/"):
            continue
        if kind in RAW:
            end = re.compile(rf"</{re.escape(kind)}\b[^>]*>?", re.I).search(page, at)
            piece, at = (page[at:], size) if not end else (page[at : end.start()], end.end())
            if kind not in NEVER:
                runs.append((me, piece))
            continue
        stack.append(me)
        opened[kind] = opened.get(kind, 0) + 1
    return nodes, runs


def blocks(runs: list[tuple[int, str | None]], kept: np.ndarray) -> str:
    """The kept runs' text, one line per block."""
    out, line = [], []
    for node, piece in [*runs, (0, None)]:
        if piece is None:
            if line and (joined := SPACE.sub(" ", "".join(line)).strip()):
                out.append(joined)
            line = []
        elif kept[node]:
            line.append(piece)
    return "\n".join(out)


N_DENSITY = 19
N_FEATURES = N_DENSITY + 6 + len(KINDS)


def tree_sums(nodes: list[Node], runs: list[tuple[int, str | None]]) -> tuple[list, ...]:
    """Letters of each element's own text, and of its subtree: text, tags, linked text and paragraphs."""
    own = [0] * len(nodes)
    for node, piece in runs:
        if piece:
            own[node] += len(piece.strip())
    text, tags = own.copy(), [1] * len(nodes)
    link = [t if x.kind == "a" else 0 for x, t in zip(nodes, own, strict=True)]
    paragraphs = [int(x.kind == "p") for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        text[p] += text[i]
        tags[p] += tags[i]
        link[p] += link[i]
        paragraphs[p] += paragraphs[i]
    return own, text, tags, link, paragraphs


def said(x: Node, share: float) -> frozenset:
    """The tokens of an element that are evidence of what it is."""
    if x.kind in ("html", "body") or x.kind in HEADINGS or x.kind in CONTENT_KINDS and share > 0.5:
        return frozenset()
    return x.tokens


def features(nodes: list[Node], runs: list[tuple[int, str | None]], evidence: dict[int, float]) -> np.ndarray:
    """One row per element: density and place, then tokens and article, then kind."""
    n = len(nodes)
    own, text, tags, link, paragraphs = tree_sums(nodes, runs)
    up = [max(x.parent, 0) for x in nodes]
    whole = max(text[0], 1)
    place, before, after, seen, most = ([0] * n for _ in range(5))
    for i in range(1, n):
        p = up[i]
        place[i], before[i] = seen[p], most[p]
        seen[p] += 1
        most[p] = max(most[p], text[i])
    most = [0] * n
    for i in range(n - 1, 0, -1):
        after[i] = most[up[i]]
        most[up[i]] = max(most[up[i]], text[i])
    low, high, inside, said_here, near = ([0.0] * n for _ in range(5))
    kind = np.zeros((n, len(KINDS)), np.float32)
    for i, x in enumerate(nodes):
        p = up[i]
        mine = sum(evidence.get(t, 0.0) for t in said(x, text[i] / whole)) if x.tokens else 0.0
        said_here[i] = mine = max(-3.0, min(3.0, mine))
        low[i], high[i] = min(low[p], mine), max(high[p], mine)
        inside[i] = 1.0 if x.kind in CONTENT_KINDS else inside[p]
        near[i] = float(x.kind in OTHER_KINDS or nodes[p].kind in OTHER_KINDS)
        if x.kind in KIND_AT:
            kind[i, KIND_AT[x.kind]] = 1
    articles = max((text[i] for i, x in enumerate(nodes) if x.kind in CONTENT_KINDS), default=0)
    up_ = np.array(up)
    text_, own_, tags_, link_, below, paragraphs_, low_, high_ = (np.array(c, np.float32) for c in (text, own, tags, link, [x.below for x in nodes], paragraphs, low, high))
    depth = np.minimum(np.array([x.depth for x in nodes], np.float32), MAX_DEPTH)
    linked = link_ / np.maximum(text_, 1)
    cols = [np.log1p(text_), np.log1p(own_), text_ / tags_, linked, np.log1p(tags_), depth, below, place, below[up_], text_ / whole, text_ / np.maximum(text_[up_], 1), np.arange(n) / n, paragraphs_, linked[up_], text_ / np.maximum(below, 1), paragraphs_[up_], np.array(before) / whole, np.array(after) / whole, text_[up_] / whole]
    cols += [said_here, low_[up_], high_[up_], inside, near, np.full(n, articles / whole)]
    return np.concatenate([np.array(cols, np.float32).T, kind], axis=1)


def marked(nodes: list[Node]) -> np.ndarray:
    """The author's marks on a written page: of the nearest marked element above, else -1."""
    out = np.full(len(nodes), -1)
    for i, x in enumerate(nodes):
        out[i] = x.mark if x.mark >= 0 or not i else out[x.parent]
    return out


def by_kind(nodes: list[Node]) -> np.ndarray:
    """1 inside article or main, 0 inside nav, footer, aside, form and the like, else -1."""
    out = np.full(len(nodes), -1)
    for i, x in enumerate(nodes):
        above = out[x.parent] if x.parent >= 0 else -1
        out[i] = 0 if above == 0 or x.kind in OTHER_KINDS else 1 if above == 1 or x.kind in CONTENT_KINDS else -1
    return out


# Names that authors give to parts of a page, for the written pages.
CONTENT_NAMES = ["article", "content", "post", "entry", "story", "text", "prose", "hentry", "entry-content", "post-body", "article-body", "main-content", "page-content", "single-post"]
PART_NAMES = {
    "links": ["nav", "navbar", "navigation", "menu", "main-menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar", "related", "related-posts", "recommended", "share", "sharing", "social", "skip", "site-header", "masthead", "header", "sidebar", "widget", "footer"],
    "blurb": ["ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "banner", "promo", "cookie", "cookies", "consent", "gdpr", "cookie-notice", "notice", "popup", "modal", "copyright", "legal", "footer", "site-footer", "footnotes-legal"],
    "form": ["newsletter", "subscribe", "signup", "login", "search", "form", "respond", "search-box"],
    "talk": ["comment", "comments", "comment-list", "reply", "replies", "disqus", "comments-area", "sidebar", "widget"],
}
STATE_NAMES = ["no-sidebar", "has-sidebar", "comments-open", "comments-closed", "ad-free", "with-banner", "menu-open", "single-post", "page", "home", "dark"]


def written_pages(n: int = 320, seed: int = 7) -> list[str]:
    """Pages by rule, each part of them marked by data-keep."""
    rng = random.Random(seed)

    def prose(least: int, most: int) -> str:
        out: list[str] = []
        size = rng.randint(least, most)
        while sum(map(len, out)) < size:
            out.append(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(4, 18))).capitalize() + ".")
        return " ".join(out)

    def heading(least: int, most: int) -> str:
        """A sentence, or one to four words."""
        return prose(least, most) if rng.random() < 0.6 else " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 4))).capitalize()

    def links(k: int) -> str:
        items = [f'<a href="/{i}">{"w" * rng.randint(3, 20)}</a>' for i in range(k)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def article() -> str:
        out, heads = [], rng.choice(["", ' class="post-header"', ' class="entry-title"', ' class="article-header"'])
        title = f"<h1{heads}>{heading(15, 60)}</h1>"
        out.append(f"<header>{title}<p>{prose(10, 40)}</p></header>" if rng.random() < 0.3 else title)
        for _ in range(rng.choice([1, 2, 3, 5, 9, 20])):
            kind = rng.random()
            p = prose(20, rng.choice([80, 400, 1500]))
            out.append(f"<h2{heads}>{heading(10, 40)}</h2><p>{p}</p>" if kind < 0.15 else f"<ul><li>{p}</li><li>{prose(10, 200)}</li></ul>" if kind < 0.25 else f"<blockquote>{p}</blockquote>" if kind < 0.3 else f'<p>{p} <a href="/x">{prose(10, 30)}</a> {p}</p>' if kind < 0.45 else f"<table><tr><td>{p}</td><td>{prose(5, 60)}</td></tr></table>" if kind < 0.5 else f"<p><b>{prose(10, 60)}</b><br>{p}</p>" if kind < 0.6 else f"<pre>{p}</pre>" if kind < 0.63 else f"<div>{p}</div>" if kind < 0.7 else f"<p>{p}</p>")
            if rng.random() < 0.06:
                out.append(part("links" if rng.random() < 0.5 else "blurb", True))
        return "".join(out)

    def part(what: str, named: bool) -> str:
        body = {
            "links": lambda: links(rng.randint(3, 14)),
            "blurb": lambda: f"<p>{prose(10, 140)}</p>" if rng.random() < 0.5 else prose(10, 160) + rng.choice(["", ' <a href="#">Wwwww</a>', "<button>Ww</button>"]),
            "form": lambda: f"<form>{prose(5, 60)}<input type=text><button>Wwww</button></form>",
            "talk": lambda: "".join(f"<div><b>Wwww</b><p>{prose(20, 400)}</p></div>" for _ in range(rng.randint(1, 6))),
        }[what]()
        kind = rng.choice({"links": ["div", "nav", "ul", "section", "aside", "header", "footer"], "blurb": ["div", "div", "aside", "footer", "section"], "form": ["div", "section", "aside"], "talk": ["div", "section", "ol", "aside"]}[what]) if named else "div"
        name = f' {rng.choice(["class", "id"])}="{rng.choice(PART_NAMES[what])}"' if named else ""
        if named and kind in OTHER_KINDS | {"header"} and rng.random() < 0.4:
            name = ""
        return f'<{kind}{name} data-keep="0">{body}</{kind}>'

    out = []
    for _ in range(n):
        kind = rng.choice(["article", "article", "main", "div", "div", "div", "section", "td", "bare", "bare"])
        states = " ".join(rng.sample(STATE_NAMES, rng.randint(0, 3)))
        name = f'class="{rng.choice(CONTENT_NAMES)} {states}"' if kind not in ("article", "main") and rng.random() < 0.7 or rng.random() < 0.4 else f'class="{states}"'
        body = f'<{kind} {name} data-keep="1">{article()}</{kind}>'
        body = f"<table><tr>{body}</tr></table>" if kind == "td" else body
        bare = kind == "bare"
        alone = bare and rng.random() < 0.6
        if bare:
            short = rng.choice([prose(10, 60), f"<p>{prose(10, 60)}</p>", f"<div>{prose(10, 200)}</div>", f"<h1>{prose(10, 30)}</h1><p>{prose(10, 80)}</p>"])
            body = short if rng.random() < 0.5 else article()
        top = [part("links", kind == "bare" or rng.random() < 0.9) for _ in range(rng.randint(0, 2))] + [part("blurb", True) for _ in range(rng.randint(0, 2))]
        end = [part(rng.choice(["links", "blurb", "form", "talk"]), True) for _ in range(rng.randint(0, 4))]
        if kind in CONTENT_KINDS and rng.random() < 0.6:
            end.insert(0, part(rng.choice(["talk", "blurb"]), False))
        if rng.random() < 0.5:
            end.append(part("blurb", True).replace("<div", "<footer").replace("</div>", "</footer>"))
        inner = body if alone else "".join([*top, body, *end])
        for _ in range(0 if bare else rng.choice([0, 0, 1, 2])):
            inner = f'<div class="{rng.choice(["wrap", "container", "page", "site", "row"])}">{inner}</div>'
        out.append(f'<html><head><title>w</title></head><body class="{" ".join(rng.sample(STATE_NAMES, rng.randint(0, 3)))}"{' data-keep="1"' * bare}>{inner}</body></html>')
    return out


class Boosted:
    """Gradient-boosted trees with logistic loss over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 70, depth: int = 4, rate: float = 0.3, bins: int = 24):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.asfortranarray(self.binned(x).astype(np.int32))
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.depth, self.trees = float(np.log(mean / (1 - mean))), depth, []
        score = np.full(len(y), self.base)
        width = max(len(c) for c in self.cuts) + 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            split = np.zeros((2**depth - 1, 2), int)
            at = np.zeros(len(y), np.int32)
            for level in range(depth):
                low = 2**level - 1
                n = 2**level
                gain, best = np.full(n, -1.0), np.zeros((n, 2), int)
                for j in range(x.shape[1]):
                    key = (at - low) * width + b[:, j]
                    gs, hs = (np.bincount(key, w, n * width).reshape(n, width).cumsum(1) for w in (g, h))
                    all_g, all_h = gs[:, -1:], hs[:, -1:]
                    v = gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1)
                    k = v.argmax(1)
                    new = v[np.arange(n), k]
                    best[new > gain] = np.column_stack([np.full(n, j), k])[new > gain]
                    gain = np.maximum(gain, new)
                split[low : low + n] = best
                f, t = split[at, 0], split[at, 1]
                at = 2 * at + 1 + (b[np.arange(len(y)), f] > t)
            leaf = at - (2**depth - 1)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            score = score + value[leaf]
            self.trees.append((split, value))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for split, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                s = split[at]
                at = 2 * at + 1 + (b[rows, s[:, 0]] > s[:, 1])
            score += value[at - (2**self.depth - 1)]
        return score


def decode(nodes: list[Node], logit: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The best choice of kept elements in which nothing below a dropped element is kept. An element counts by
    its own text; scripts and the like are never kept."""
    n = len(nodes)
    worth = np.clip(logit, -6, 6) * np.log1p(own)
    keep, drop = worth.copy(), -worth
    for i in range(n - 1, 0, -1):
        x = nodes[i]
        if x.kind in NEVER:
            keep[i] = -np.inf
        keep[x.parent] += max(keep[i], drop[i])
        drop[x.parent] += drop[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and keep[i] >= drop[i] and nodes[i].kind not in NEVER
    return kept


@dataclass
class Model:
    evidence: dict[int, float]
    trees: Boosted


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements with a label by kind: their density and place, nothing else."""
    for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
        xs, ys, order = [], [], []
        for page in b.column(0).to_pylist():
            nodes, runs = parse(page or "")
            y = by_kind(nodes)
            xs += features(nodes, runs, {})[y >= 0, :N_DENSITY].tolist()
            ys += y[y >= 0].tolist()
            order += [zlib.crc32(f"{i} {page}".encode()) for i in np.flatnonzero(y >= 0)]
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float32())), pa.array(ys, pa.int32()), pa.array(order, pa.int64())], names=["x", "y", "o"])


def _named(plain: Boosted):
    """Each page's votes: the tokens of elements of which the trees without tokens are sure, and of whose text the decoding keeps most, or least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            votes: list[tuple[int, int]] = []
            for page in b.column(0).to_pylist():
                nodes, runs = parse(page or "")
                x = features(nodes, runs, {})
                logit, own, text = plain.logit(x), np.expm1(x[:, 1]), np.maximum(np.expm1(x[:, 0]), 1)
                held = np.where(decode(nodes, logit, own), own, 0)
                for i in range(len(nodes) - 1, 0, -1):
                    held[nodes[i].parent] += held[i]
                sure = (np.abs(logit) >= SURE) & ((held > text / 2) == (logit > 0))
                votes += {(t, int(logit[i] > 0)) for i in np.flatnonzero(sure) for t in said(nodes[i], text[i] / text[0])}
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in votes], pa.int32()), pa.array([k for _, k in votes], pa.int32())], names=["token", "keep"])

    return run


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, max_nodes: int = MAX_NODES) -> Model:
    """Trains on the written pages and on the elements of at most max_pages pages, the first by a hash of their ids; these pages also vote on
    what tokens say, of which at most TOKEN_PLACES counts return."""
    sample = pages.select("page_id", "html").where(F.col("html").isNotNull()).orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(max_pages).select("html")
    rows = sample.mapInArrow(_training, "x array<float>, y int, o long").orderBy("o", "y", "x").limit(max_nodes).collect()
    seen = np.zeros((len(rows), N_FEATURES), np.float32)
    if rows:
        seen[:, :N_DENSITY] = [r["x"] for r in rows]
    written = [(*parse(p),) for p in written_pages()]
    labels = [marked(nodes) for nodes, _ in written]
    y = np.concatenate([*(k[k >= 0] for k in labels), [r["y"] for r in rows]]).astype(float)

    def trees(evidence: dict[int, float], n: int) -> Boosted:
        return Boosted(np.concatenate([*(features(*t, evidence)[k >= 0] for t, k in zip(written, labels, strict=True)), seen]), y, n)

    counts: dict[int, list[float]] = {}
    for (nodes, runs), label in zip(written, labels, strict=True):
        _, text, *_ = tree_sums(nodes, runs)
        for x, k, t in zip(nodes, label, text, strict=True):
            for token in said(x, t / max(text[0], 1)) if k >= 0 else ():
                counts.setdefault(token, [0.5, 0.5])[k] += 1
    voted = sample.mapInArrow(_named(trees({}, 30)), "token int, keep int").groupBy("token").agg(F.count_if(F.col("keep") == 0).alias("no"), F.count_if(F.col("keep") == 1).alias("yes"))
    for r in voted.where(F.col("no") + F.col("yes") >= LEAST_VOTES).collect():
        no, yes = counts.setdefault(r["token"], [0.5, 0.5])
        counts[r["token"]] = [no + r["no"], yes + r["yes"]]
    evidence = {t: float(np.clip(np.log(yes / no), -3, 3)) for t, (no, yes) in counts.items()}
    return Model(evidence, trees(evidence, 70))


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """pages (page_id, url, html) with their main text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            trees = [parse(p or "") for p in b.column(2).to_pylist()]
            rows = [features(*t, m.evidence) for t in trees]
            logit = m.trees.logit(np.concatenate(rows)) if rows else np.empty(0)
            texts, at = [], 0
            for (nodes, runs), x in zip(trees, rows, strict=True):
                kept = decode(nodes, logit[at : at + len(nodes)], np.expm1(x[:, 1]))
                at += len(nodes)
                texts.append(blocks(runs, kept))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
