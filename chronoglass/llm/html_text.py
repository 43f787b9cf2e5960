"""Main text of web pages: boosted trees over DOM-node features, then decoding along the tree."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import small_batches

#: Generated pages that the trees are fitted on, and the seed of their generator.
FIT_PAGES, FIT_SEED = 500, 11
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_ATTRS = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTR = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# HTML's element classes.
RAW = {"script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"html", "head", "body", "title", "noscript", "template", "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "iframe", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "svg", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "tr", "ul", "video", "audio"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
SCOPE = {"table", "ul", "ol", "dl", "select", "td", "th", "button", "html", "body"}
ROOTS = {"#root", "html", "body"}
NEVER = {"head", "title", "noscript", "template", "iframe", "svg", "select", "option", "textarea", "button", "video", "audio"}
TAG_GROUPS = [{"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend", "search"}, {"article"}, {"main"}, {"section"}, {"div"}, {"p"}, {"li"}, {"ul", "ol"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"table", "tbody", "tr", "td", "th", "thead", "caption"}, {"blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd", "details", "summary"}]
# Words of class, id and role by what they are used for.
TOKEN_GROUPS = [
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip"},
    {"header", "masthead", "topbar", "top", "logo", "branding"},
    {"footer", "foot", "copyright", "colophon", "contentinfo", "legal", "bottom"},
    {"sidebar", "side", "aside", "widget", "widgets", "rail", "related", "recommended", "complementary", "trending", "popular", "more"},
    {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "commercial"},
    {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "paywall", "overlay", "disclaimer"},
    {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "feedback", "responses"},
    {"share", "social", "follow", "sharing", "tags", "meta", "byline", "author"},
    {"form", "search", "login", "contact"},
    {"content", "article", "post", "entry", "main", "body", "story", "text", "blog", "hentry", "prose"},
]


@dataclass
class Page:
    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters in links


def tags_of(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of each tag, and of comments and declarations with an empty name.

    Reads the source once: a quote that no other closes is a character like any other, and after the last > there is no
    tag. What is between a RAW element's tags goes with the first of them.
    """
    at, last = 0, source.rfind(">")
    while True:
        m = _OPEN.search(source, at)
        if m is None:
            return
        if m[1]:
            end = source.find("-->", m.end())
            at = len(source) if end < 0 else end + 3
            yield m.start(), at, False, "", ""
            continue
        if m.start() > last:
            return
        if m[2]:
            at = source.find(">", m.end()) + 1
            yield m.start(), at, False, "", ""
            continue
        end = _ATTRS.match(source, m.end()).end()
        while end < len(source) and source[end] != ">":
            end = _ATTRS.match(source, end + 1).end()
        if end >= len(source):
            return
        at, name = end + 1, m[4].lower()
        attrs = source[m.end() : end]
        if name in RAW and not m[3]:
            close = re.compile(rf"</{name}\b", re.I).search(source, at)
            stop = source.find(">", close.end()) if close else -1
            at = len(source) if stop < 0 else stop + 1
        yield m.start(), at, bool(m[3]), name, attrs


class _Stack:
    """Open elements with the block element each is in, and where the innermost of each name, scope and block is."""

    def __init__(self):
        self.open: list[tuple[str, int]] = [("#root", 0)]
        self.where: dict[str, list[int]] = {}
        self.scopes, self.blocks = [0], [0]

    def push(self, tag: str, node: int) -> None:
        k = len(self.open)
        self.open.append((tag, node))
        self.where.setdefault(tag, []).append(k)
        if tag in SCOPE:
            self.scopes.append(k)
        if tag in BLOCK and tag != "p":
            self.blocks.append(k)

    def pop(self) -> tuple[str, int]:
        tag, node = self.open.pop()
        self.where[tag].pop()
        if tag in SCOPE:
            self.scopes.pop()
        if tag in BLOCK and tag != "p":
            self.blocks.pop()
        return tag, node

    def at(self, tag: str) -> int:
        """The innermost open element of the name, or 0."""
        found = self.where.get(tag)
        return found[-1] if found else 0


def parse(source: str) -> Page:
    """The page's block elements and its blocks of text, in order, in time linear in the source. Unclosed and misnested
    elements end as in browsers. Text right under the root, html or body gets an element of its own, #text, so that it
    is judged like any other."""
    page = Page(["#root"], [-1], [""], [])
    stack = _Stack()
    run: list[tuple[str, bool]] = []
    links = 0

    def element(tag: str, node: int, attrs: str) -> int:
        page.tags.append(tag)
        page.parents.append(node)
        page.attrs.append(attrs)
        return len(page.tags) - 1

    def flush(node: int) -> None:
        if run:
            text = "".join([x for x, _ in run])
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                loose = page.tags[node] in ROOTS
                page.blocks.append((element("#text", node, "") if loose else node, text, sum([len(x) for x, a in run if a])))
            run.clear()

    def close(k: int) -> None:
        nonlocal links
        while len(stack.open) > k:
            tag, node = stack.open[-1]
            if tag in BLOCK:
                flush(node)
            links -= tag == "a"
            stack.pop()

    at = 0
    for begin, end, closes, tag, attrs in tags_of(source):
        if begin > at:
            run.append((source[at:begin], links > 0))
        at = end
        if not tag or tag in RAW:
            continue
        if closes:
            k = stack.at(tag)
            if k and (tag in BLOCK or k >= stack.scopes[-1]):
                close(k)
            continue
        node = stack.open[-1][1]
        if tag == "br":
            run.append((" ", False))
            continue
        if tag in BLOCK:
            ends = CLOSES.get(tag, ())
            while (k := max(map(stack.at, ("p", *ends)))) and k >= (stack.scopes[-1] if ends else stack.blocks[-1]):
                close(k)
                if stack.open[-1][0] not in ends:
                    break
            node = stack.open[-1][1]
            flush(node)
            if tag == "hr":
                continue
            node = element(tag, node, attrs)
        if tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path", "iframe")):
            links += tag == "a"
            stack.push(tag, node)
    if at < len(source):
        run.append((source[at:], links > 0))
    close(1)
    flush(0)
    return page


@lru_cache(maxsize=256)
def _tag_group(tag: str) -> tuple:
    return tuple(float(tag in g) for g in TAG_GROUPS)


@lru_cache(maxsize=20_000)
def _token_group(attrs: str) -> tuple:
    found = {w.lower() for m in _ATTR.finditer(attrs) for w in _PIECE.findall(m[2] or m[3] or m[4] or "")} if attrs else set()
    return tuple(float(bool(found & g)) for g in TOKEN_GROUPS)


def _counts(page: Page) -> tuple:
    """What features() needs of a page, a list over its block elements each."""
    n, parents = len(page.tags), page.parents
    sums = [[0.0] * 6 for _ in range(n)]  # characters, in links, marks, words, blocks, elements
    own, first, seen = [0] * n, [-1] * n, 0
    for node, text, linked in page.blocks:
        s, k = sums[node], len(text)
        own[node] += k
        s[0] += k
        s[1] += min(linked, k)
        s[2] += text.count(".") + text.count(",") + text.count(";") + text.count(":") + text.count("!") + text.count("?")
        s[3] += text.count(" ") + 1
        s[4] += 1
        if first[node] < 0:
            first[node] = seen
        seen += k
    for i in range(n - 1, 0, -1):  # children come after their parents
        s, p = sums[i], parents[i]
        s[5] += 1
        up = sums[p]
        for k in range(6):
            up[k] += s[k]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    sums[0][5] += 1
    groups = [_tag_group(t) for t in page.tags]
    tokens = [_token_group(a) for a in page.attrs]
    none = (0.0,) * len(TAG_GROUPS), (0.0,) * len(TOKEN_GROUPS)
    above: list[tuple] = [none]
    depth, index, children, alike = [0] * n, [0] * n, [0] * n, {}
    cache: dict[int, tuple] = {}
    for i in range(1, n):
        p = parents[i]
        if p not in cache:
            cache[p] = tuple(map(max, above[p][0], groups[p])), tuple(map(max, above[p][1], tokens[p]))
        above.append(cache[p])
        depth[i], index[i] = depth[p] + 1, children[p]
        children[p] += 1
        alike[p, page.tags[i]] = alike.get((p, page.tags[i]), 0) + 1
    same = [0.0] + [alike[parents[i], page.tags[i]] / children[parents[i]] for i in range(1, n)]
    words = [g + t + x + y for g, t, (x, y) in zip(groups, tokens, above, strict=True)]
    return sums, own, first, depth, index, children, same, words, [max(sums[0][0], 1)] * n


def features(pages: list[Page]) -> np.ndarray:
    """A row per block element of all pages."""
    lists = [_counts(p) for p in pages]
    starts = np.concatenate([[0], np.cumsum([len(p.tags) for p in pages])[:-1]])
    up = np.concatenate([np.maximum(np.array(p.parents), 0) + k for p, k in zip(pages, starts, strict=True)])
    sums, own, first, depth, index, children, same, words, all_text = (np.array([x for page in lists for x in page[k]], float) for k in range(9))
    (total, linked, punct, count, blocks, nodes), first = sums.T, np.maximum(first, 0)
    cols = [
        depth, np.log1p(total), np.log1p(own), linked / np.maximum(total, 1), punct / np.maximum(total, 1), np.log1p(total / nodes), np.log1p(nodes), total / np.maximum(blocks, 1),
        total / all_text, first / all_text, index, np.maximum(children[up] - 1 - index, 0), same, total / np.maximum(total[up], 1), np.log1p(total[up]), linked[up] / np.maximum(total[up], 1), count / np.maximum(blocks, 1),
    ]
    return np.column_stack([*cols, words])


def decode(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """Whether each element is kept: the likeliest labelling in which nothing under a dropped element is kept."""
    n = len(page.tags)
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    for i, t in enumerate(page.tags):
        if t in NEVER:
            yes[i] = -1e9
    keep, drop = yes.copy(), no.copy()
    keep[0], drop[0] = 0.0, -1e12
    for t in ("html", "body"):
        for i in range(n):
            if page.tags[i] == t:
                keep[i], drop[i] = 0.0, -1e9
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[page.parents[i]] and keep[i] > drop[i]
    return out


def text_of(page: Page, kept: np.ndarray) -> str:
    return "\n".join(t for node, t, _ in page.blocks if kept[node])


def plain_text(page: Page) -> str:
    """For a page of which decoding keeps nothing: the blocks that are not mostly links, and stand under no element that is
    boilerplate by its tag or attribute words. A page of menus alone has none."""
    bad = np.zeros(len(page.tags), bool)
    for i, t in enumerate(page.tags):
        own = t in NEVER or any(_tag_group(t)[:5]) or any(_token_group(page.attrs[i])[:9])
        bad[i] = i > 0 and (own or bad[page.parents[i]])
    return "\n".join(t for node, t, linked in page.blocks if not bad[node] and 2 * linked < len(t))


class _Pages:
    """Pages of many layouts with known labels, from a seeded generator."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        letters = "etaoinshrdlucmfwypvbgkéüñó"
        self.words = ["".join(letters[int(x)] for x in (self.rng.random(int(n)) ** 1.5 * len(letters))) for n in self.rng.integers(1, 11, 2000)]

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def prose(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        words = [self.words[int(x)] for x in self.rng.integers(len(self.words), size=n)]
        marks = self.rng.random(n)
        bars = self.rng.random() < 0.05
        return " ".join((w.capitalize() if i == 0 or marks[i - 1] > 0.9 else w) + (" |" if bars else "." if marks[i] > 0.9 else "," if marks[i] > 0.8 else "") for i, w in enumerate(words)) + ("" if bars else self.pick(".", ".", ""))

    def attrs(self, group: set[str] | None, plain: float = 0.2) -> str:
        if group is None or self.rng.random() < plain:
            return self.pick("", "", f' class="c{int(self.rng.integers(100))}"', f' id="x{int(self.rng.integers(100))}"')
        word = self.pick(*sorted(group))
        return self.pick(f' class="{word}"', f' id="{word}"', f' class="{self.pick("site", "page", "js", "block", "l")}-{word}"', f' class="{word} {word}-{self.pick("box", "wrap", "list", "inner")}"')

    def links(self, low: int, high: int) -> str:
        items = [f'<li><a href="/{i}">{self.prose(1, 3)}</a></li>' for i in range(int(self.rng.integers(low, high + 1)))]
        return f"<ul>{''.join(items)}</ul>" if self.rng.random() < 0.8 else " ".join(x[4:-5] for x in items)

    def side(self) -> str:
        """One boilerplate element."""
        k, prose = int(self.rng.integers(10)), self.prose
        if k == 0:
            return self.pick(f"<nav{self.attrs(TOKEN_GROUPS[0], 0.7)}>{self.links(2, 10)}</nav>", f"<div{self.attrs(TOKEN_GROUPS[0], 0)}>{self.links(2, 10)}</div>")
        if k == 1:
            inner = self.pick(f"<h1>{prose(1, 4)}</h1>", f"<p>{prose(2, 12)}</p>", prose(1, 8)) + self.pick("", self.links(2, 6))
            return self.pick(f"<header{self.attrs(TOKEN_GROUPS[1], 0.6)}>{inner}</header>", f"<div{self.attrs(TOKEN_GROUPS[1], 0)}>{inner}</div>")
        if k == 2:
            inner = self.pick(f"&copy; {prose(1, 25)}", f"<p>{prose(3, 25)}</p>", self.links(2, 8))
            return self.pick(f"<footer{self.attrs(TOKEN_GROUPS[2], 0.7)}>{inner}</footer>", f"<div{self.attrs(TOKEN_GROUPS[2], 0)}>{inner}</div>")
        if k == 3:
            inner = self.pick(f"<h3>{prose(1, 4)}</h3>", "") + self.pick(self.links(2, 8), f"<p>{prose(5, 40)}</p>")
            return self.pick(f"<aside{self.attrs(TOKEN_GROUPS[3], 0.6)}>{inner}</aside>", f"<div{self.attrs(TOKEN_GROUPS[3], 0)}>{inner}</div>")
        if k in (4, 5):
            tag = self.pick("div", "div", "aside", "section")
            return f"<{tag}{self.attrs(TOKEN_GROUPS[4], 0)}>{self.pick(prose(2, 60), f'<p>{prose(2, 60)}</p>', f'<a href=/x>{prose(2, 12)}</a>')}</{tag}>"
        if k == 6:
            return f"<div{self.attrs(TOKEN_GROUPS[5], 0)}>{self.pick(prose(4, 40), f'<p>{prose(4, 40)}</p>')}{self.pick('', '<button>Ok</button>')}</div>"
        if k == 7:
            notes = "".join(f"<{t}{self.attrs(TOKEN_GROUPS[6], 0.5)}>{self.pick(prose(2, 60), f'<p>{prose(2, 60)}</p>')}</{t}>" for t in [self.pick("div", "li", "article")] * int(self.rng.integers(1, 6)))
            tag = self.pick("div", "section", "ol", "div")
            return f"<{tag}{self.attrs(TOKEN_GROUPS[6], 0)}>{self.pick('', f'<h3>{prose(1, 3)}</h3>')}{notes}</{tag}>"
        if k == 8:
            return f"<div{self.attrs(TOKEN_GROUPS[7], 0)}>{self.pick(self.links(2, 6), prose(1, 6))}</div>"
        return f"<form{self.attrs(TOKEN_GROUPS[8], 0.6)}><label>{prose(1, 4)}</label><input name=q>{self.pick('', f'<p>{prose(2, 15)}</p>')}<button>Go</button></form>"

    def loose(self) -> str:
        """Text right under the body that belongs to no article."""
        return self.pick(f"&copy; {self.prose(1, 12)}", self.prose(1, 4), f"<a href=#c>{self.prose(1, 4)}</a>", f"{self.prose(1, 3)} | {self.prose(1, 3)}")

    def body(self, bare: float = 0.0) -> str:
        """An article's elements, some of them text without a tag."""
        out = [self.pick("", f"<{(h := self.pick('h1', 'h2'))}>{self.prose(1, 12)}</{h}>", f"<h1>{self.prose(2, 12)}</h1>")]
        for _ in range(int(self.rng.integers(1, self.pick(2, 4, 12)))):
            k = int(self.rng.integers(14))
            p = self.prose(1, self.pick(12, 120))
            out.append(
                f"{p} <a href='/y'>{self.prose(1, 4)}</a>{self.pick('', '<br><br>' + self.prose(4, 80))}" if bare and self.rng.random() < bare else f"<h2>{self.prose(1, 6)}</h2>" if k == 0 else f"<ul>{''.join(f'<li>{self.prose(1, 20)}</li>' for _ in range(4))}</ul>" if k == 1 else f"<blockquote>{self.pick(p, f'<p>{p}</p>')}</blockquote>" if k == 2
                else f"<table><tr><td>{self.prose(1, 3)}</td><td>{self.prose(1, 3)}</td></tr></table>" if k == 3 else f"<pre>{p}</pre>" if k == 4 else f"<p><b>{p}<br>" if k == 5
                else f"<p>{p} <a href='/y'>{self.prose(1, 4)}</a> {self.prose(1, 9)}</p>" if k == 6 else f"<div>{p}</div>" if k == 7 else f"<p>{p}</p>"
            )
        if self.rng.random() < 0.15:
            out.insert(int(self.rng.integers(1, len(out) + 1)), "\x01" + self.pick(*[self.side() for _ in range(1)]) + "\x02")
        return "".join(out)

    def page(self) -> str:
        """HTML in which \\x03 and \\x04 enclose the article, \\x01 and \\x02 what does not belong to it."""
        before, after = ("".join(self.side() for _ in range(int(self.rng.integers(0, 4)))) for _ in range(2))
        group = TOKEN_GROUPS[9]
        article = self.pick(f"<article{self.attrs(group, 0.7)}>\x03{self.body()}\x04</article>", f"<main{self.attrs(group, 0.7)}>\x03{self.body()}\x04</main>", f"<div{self.attrs(group, 0)}>\x03{self.body()}\x04</div>", f"<main><article>\x03{self.body()}\x04</article></main>", f"<div{self.attrs(group, 0)}><section>\x03{self.body()}\x04</section></div>")
        kind = self.rng.random()
        if kind < 0.2:  # right under the body
            article = f"\x03{self.body(self.pick(0.2, 0.5, 1.0))}\x04"
        elif kind > 0.95:
            article = ""
        if self.rng.random() < 0.25:
            before, after = self.pick((self.loose() + before, after), (before, after + self.loose()), (self.loose() + before, after + self.loose()))
        inner = before + article + after
        return f"<!DOCTYPE html><html><head><title>{self.prose(1, 9)}</title><script>var a='<p>';</script></head><body>{self.pick(inner, inner, f'<div{self.attrs(None)}>{inner}</div>')}{self.pick('</body></html>', '')}"


def _labelled(source: str) -> tuple[Page, np.ndarray]:
    page = parse(source)
    kept, inside, out_of, texts = np.zeros(len(page.tags), bool), False, False, []
    for node, text, _ in page.blocks:
        plain = []
        for piece in re.split("([\x01\x02\x03\x04])", text):
            inside = inside if piece not in ("\x03", "\x04") else piece == "\x03"
            out_of = out_of if piece not in ("\x01", "\x02") else piece == "\x01"
            if piece.strip() and piece not in "\x01\x02\x03\x04":
                plain.append(inside and not out_of)
        texts.append((node, any(plain)))
    for node, good in texts:
        while good and node >= 0 and not kept[node]:
            kept[node], node = True, page.parents[node]
    # marks of ends may form blocks of their own; they are no text
    page.blocks = [(n, t, a) for n, t, a in ((n, re.sub("[\x01-\x04]", "", t).strip(), a) for n, t, a in page.blocks) if t]
    return page, kept


@lru_cache(maxsize=2)
def trained(pages: int = FIT_PAGES, seed: int = FIT_SEED) -> boosting.Forest:
    """The forest, fitted on the driver on a fixed number of generated pages: no row of a corpus is labelled."""
    make, xs, ys = _Pages(seed), [], []
    for _ in range(pages):
        page, kept = _labelled(make.page())
        use = np.array([t not in ("#root", "html", "body", "head", "title") for t in page.tags])
        xs.append(features([page])[use])
        ys.append(kept[use])
    return boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_text(forest: boosting.Forest, sources: list[str]) -> list[str]:
    pages = [parse(s) for s in sources]
    sizes = [len(p.tags) for p in pages]
    if not pages:
        return []
    odds = np.split(forest.log_odds(features(pages)), np.cumsum(sizes)[:-1])
    return [text_of(p, decode(p, o)) or plain_text(p) for p, o in zip(pages, odds, strict=True)]


def _extract(forest: boosting.Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                texts = main_text(forest, [h or "" for h in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])

    return run


def extract_text(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The carry columns and the text of every page's whole html.

    Elements are scored by boosted trees over subtree and link density, attribute words, depth and sibling statistics of
    the element and those above it; decoding along the tree keeps the likeliest set of elements in which none lies under a
    dropped one. Of a page where that keeps nothing, what is neither mostly links nor under boilerplate by name is the text.
    Blocks of kept elements are decoded, have white space collapsed and are joined by \\n in page order.
    Null or empty html gives an empty text. Rows are independent: ties, repeated rows and other columns change nothing.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(*(carry or []), F.col(html).cast("string").alias("_html"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_extract(trained()), kinds + "text string")
