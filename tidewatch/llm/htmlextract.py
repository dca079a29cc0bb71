"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

#: Comments, declarations and tags. As in HTML, a quote opens a value only right
#: after an equals sign; a quoted value that never ends is taken as unquoted.
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: Elements whose content isn't text of the page.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't break a line of text and don't show in a tag path.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Regions that aren't the article by their element; a header is only outside one.
AWAY = frozenset("nav footer aside form dialog menu head svg math object select button datalist".split())
MAIN = frozenset("article main".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Elements that hold a container's text; what holds them is the container.
TEXTUAL = frozenset("p li ul ol dl dt dd table caption thead tbody tfoot tr td th figure figcaption blockquote pre details summary h1 h2 h3 h4 h5 h6 hgroup address center".split())
UNMARKED = TEXTUAL - {"ul", "ol", "dl", "table", "figure"} | {"html", "body"}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
P_STOPS = ("article", "div", "section", "td", "li", "body")
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOP = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select", "datalist")}
#: Last words of a container's class, id or role that lower its paths' scores:
#: a lot for what readers know as not the article, less for what may be.
HARD = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login sidebar nav navbar navigation menu menus breadcrumb breadcrumbs pagination footer masthead comment comments commentlist disqus respond replies contentinfo complementary foot".split())
SOFT = frozenset("share sharing social related recommended recommendations widget widgets tags legal copyright alert rail toolbar topbar search skip pager toc meta reply".split())
#: First words of a class that tell of a topic or a state, not of a region.
STATES = frozenset("has with without no is js tag category cat topic term type format status author".split())
#: Words of a class that say nothing about the content.
PLAIN = frozenset("box block list item items wrap wrapper container area section inner outer unit slot bar panel group row col column body content top bottom left right links posts".split())
FACTOR = {"hard": 0.03, "soft": 0.3}
PUNCTUATION = re.compile(r"[,.;:!?，。；：！？、]")
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
KERNEL /= KERNEL.sum()


@dataclass
class Paths:
    """The tag paths of a page as a tree: parent, tag and label (tag and class
    names, digits left out) by number; path 0 is the root."""

    parent: list = field(default_factory=lambda: [0])
    tag: list = field(default_factory=lambda: [""])
    away: list = field(default_factory=lambda: [False])
    main: list = field(default_factory=lambda: [False])
    factor: list = field(default_factory=lambda: [1.0])
    holder: list = field(default_factory=lambda: [0])
    number: dict = field(default_factory=dict)

    def child(self, at: int, tag: str, label: str, away: bool, factor: float) -> int:
        key = (at, label, away, factor)
        got = self.number.get(key)
        if got is None:
            got = self.number[key] = len(self.parent)
            self.parent.append(at)
            self.tag.append(tag)
            self.away.append(self.away[at] or away)
            self.main.append(self.main[at] or tag in MAIN)
            self.factor.append(min(self.factor[at], factor))
            self.holder.append(self.holder[at] if tag in TEXTUAL else got)
        return got

    def spans(self) -> tuple[list[int], list[int]]:
        """Each path's place in a walk of the tree, and that of its last descendant."""
        below: list[list[int]] = [[] for _ in self.parent]
        for p in range(1, len(self.parent)):
            below[self.parent[p]].append(p)
        first, walk = [0] * len(below), [0]
        order = []
        while walk:
            p = walk.pop()
            first[p] = len(order)
            order.append(p)
            walk += below[p]
        last = first[:]
        for p in reversed(order[1:]):
            last[self.parent[p]] = max(last[self.parent[p]], last[p])
        return first, last


@dataclass
class Block:
    """Text between tags that break the line: its path and its characters, all
    and within links."""

    path: int
    text: str
    linked: int


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in reversed(ATTRIBUTE.findall(source))}


def _mark(names: list[str], main: bool) -> float:
    """The least factor of the class names: of the last word that isn't plain.
    A header is one of the page outside the article only."""
    least = 1.0
    for name in names:
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        while len(words) > 1 and words[-1] in PLAIN:
            words.pop()
        if words and words[0] not in STATES and not {"with", "no", "without"} & set(words):
            soft = words[-1] in SOFT or words[-1] == "header" and not main
            least = min(least, FACTOR["hard"] if words[-1] in HARD else FACTOR["soft"] if soft else 1.0)
    return least


def blocks(html: str) -> tuple[Paths, list[Block]]:
    """The blocks of text in page order, and their paths. A block is what stands
    between tags that break the line; inline elements don't. Every tag costs the
    same however deep it stands."""
    paths, out = Paths(), []
    stack: list[tuple[str, int]] = []  # tag, path
    opened: dict[str, list[int]] = {}  # tag: its places in the stack
    held: list[str] = []
    linked: list[str] = []
    link = -1  # height of the stack where a link is open
    at, n = 0, len(html)

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(Block(stack[-1][1] if stack else 0, text, min(len(text), sum(len(" ".join(unescape(x).split())) for x in linked))))
        linked.clear()

    def say(text: str) -> None:
        held.append(text)
        if link >= 0:
            linked.append(text)

    def last(names: tuple[str, ...]) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=-1)

    def close(names: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        nonlocal link
        i = last(names)
        if i < 0 or i < last(stops):
            return
        flush()
        while len(stack) > i:
            opened[stack.pop()[0]].pop()
        if link > len(stack):
            link = -1

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            tail = html[at:]
            say(tail[: cut.start()] if (cut := re.search(r"</?\Z", tail)) else tail)
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        if not m[4]:  # the page ends within a tag
            break
        name = name.lower()
        if m[1]:
            if name == "a":
                link = -1
            elif name == "br":
                held.append("\n")
            elif name not in VOID and name not in INLINE:
                close((name,))
            continue
        if name in RAW:
            flush()
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                gt = html.find(">", end.start()) if end else -1
                at = n if gt < 0 else gt + 1
            continue
        if name in VOID:
            if name == "hr":
                close(("p",), P_STOPS)
                flush()
            held.append("\n" if name == "br" else "")
            continue
        if name == "a":
            link = len(stack)
            continue
        if name in INLINE:
            continue
        if name in CLOSES_P:
            close(("p",), P_STOPS)
        if name in SAME:
            close(SAME[name], STOP.get(name, ()))
        flush()
        if m[3].endswith("/") and "=" not in m[3][-2:]:
            continue
        top = stack[-1][1] if stack else 0
        away, factor, label = name in AWAY or name == "header" and not paths.main[top], 1.0, name
        if m[3] and (given := _attributes(m[3])):
            away |= "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", "")) is not None
            if name not in UNMARKED:
                factor = _mark(" ".join(given.get(x, "") for x in ("class", "role", "id")).lower().split(), paths.main[top])
            label = ".".join([name, *sorted({re.sub(r"\d+", "", x) for x in given.get("class", "").split()} - {""})])
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, paths.child(top, name, label, away, factor)))
    flush()
    return paths, out


def path_scores(paths: Paths, found: list[Block]) -> dict[int, float]:
    """The score of each tag path, 0 to 1.

    Per path: characters a block and punctuation marks a block, each brought to
    0..1 by x / (x + typical). The ratios are spread to the blocks and smoothed
    over neighbours in page order; both, fused as a geometric mean, are averaged
    by path. Links, and marks of the containers, lower a score; so does standing
    outside the page's article or main element."""
    path = np.array([b.path for b in found])
    size = np.array([len(b.text) for b in found], float)
    dots = np.array([len(PUNCTUATION.findall(b.text)) for b in found], float)
    linked = np.array([b.linked for b in found], float)
    blocks_of = np.maximum(np.bincount(path), 1)
    mean = lambda x: np.bincount(path, x) / blocks_of
    chars, marks = mean(size), mean(dots)
    ratio = (chars / (chars + 80) * (0.25 + marks) / (1 + marks))[path]
    smooth = np.convolve(np.pad(ratio, 2, mode="edge"), KERNEL, "valid")
    fused = mean(np.sqrt(ratio * smooth))
    free = 1 - mean(linked) / np.maximum(chars, 1)
    there = np.unique(path).tolist()
    article = any(paths.main[p] for p in there)
    return {p: float(fused[p] * free[p] ** 2) * paths.factor[p] * (0.3 if article and not paths.main[p] else 1) for p in there}


def select(paths: Paths, every: list[Block], strength: float = 0.3) -> list[str]:
    """Texts of the content blocks.

    A path is content where its score reaches `strength` times the mean score of
    a character of the page. Elements of a container's text (paragraphs, items,
    cells) count with at least 0.6 of the mean score of a character in their
    container, less their links, so a short one stays with its like; a heading
    stays where its section, up to the next heading of its rank, holds content.
    Regions that aren't the article by their element take no part, and paths of
    containers marked as such set no limit: they are content only as long prose on
    a page that has nothing better."""
    found = [b for b in every if not paths.away[b.path]]
    if not found:
        return []
    score = path_scores(paths, found)
    size: dict[int, int] = {}
    links: dict[int, int] = {}
    for b in found:
        size[b.path] = size.get(b.path, 0) + len(b.text)
        links[b.path] = links.get(b.path, 0) + b.linked
    hard = {p for p in score if paths.factor[p] <= FACTOR["hard"]}
    usual = [p for p in score if p not in hard]
    total = sum(size[p] for p in usual)
    limit = strength * sum(score[p] * size[p] for p in usual) / total if total else 0
    least = 0.5 * FACTOR["hard"]
    group: dict[int, list[float]] = {}
    for p in score:
        g = group.setdefault(paths.holder[p], [0.0, 0.0])
        g[0] += score[p] * size[p]
        g[1] += size[p]
    chosen = set()
    for p, s in score.items():
        tag = paths.tag[p]
        if tag in TEXTUAL and tag not in HEADINGS:
            g = group[paths.holder[p]]
            s = max(s, 0.6 * g[0] / g[1] * (1 - links[p] / size[p]) ** 2)
        if s > 0 and s >= (max(limit, least) if p in hard else limit):
            chosen.add(p)
    keep = [b.path in chosen for b in found]
    first, last = paths.spans()
    content = len(found)
    heads = dict.fromkeys(range(1, 7), len(found))  # the next heading of a rank or above
    for i in range(len(found) - 1, -1, -1):
        p = found[i].path
        rank = HEADINGS.get(paths.tag[p])
        if not rank:
            content = i if keep[i] else content
            continue
        if content < heads[rank]:
            home = paths.holder[p]
            keep[i] |= first[home] <= first[found[content].path] <= last[home]
        for r in range(rank, 7):
            heads[r] = i
    return [b.text for b, k in zip(found, keep) if k]


def main_text(html: str | None) -> str:
    return " ".join(select(*blocks(html or "")))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without `html`, with text (the main text, empty if there is none)
    and n_chars (its code points). Null html counts as empty; malformed or cut
    pages give what can be read; columns text and n_chars are replaced; every
    row stays. Each page is worked on by itself, so no row is shuffled."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    d = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html", 16 << 20):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return d.mapInArrow(run, d.drop("html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema)


def op6(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
