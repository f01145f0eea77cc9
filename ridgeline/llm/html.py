"""Main text of web pages by a minimum cut.

A page is cut into blocks at the borders of block elements.  A logistic classifier over a block's ancestors, class and id words,
link density and text gives costs for either label; these are the capacities to the two terminals.  Its weights start at PRIOR and
are fitted to a bounded sample of the pages (``train``), whose labels are what repeats across the pages of a host and what stands
on one alone; the prior holds where the sample says nothing.  Neighbours in page order, and the nearest blocks under the same element, are
joined by smoothness edges.  A maximum flow saturates the cheapest cut, and the blocks that the source still reaches are content.
Scripts, styles and other elements without text of their own never make blocks.  All is row for row, without a shuffle.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, below_share

#: A quote opens a value behind = alone, and only if it is closed; values of any length, in one pass (atomic).
#: What has an end mark of its own is found by its beginning alone; its end is looked for once.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>(?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+))>|<!--|<!\[CDATA\[|<[!?/]""")
ENDS = {"<!--": "-->", "<![CDATA[": "]]>"}
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
#: Elements whose text is none of the page's.
RAW = frozenset(("title", "script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "head", "textarea", "select", "button", "datalist", "annotation", "annotation-xml", "audio", "video"))
RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input link meta math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open element of its group that has no other block between.
CLOSES = {t: g for g in (("p",), ("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for t in g}
#: Words of classes and ids that say what a block is not, surely or perhaps, and what it is.
SURE = "ads? advert\\w* comments? discussion reactions replies responses disqus cookies? consent newsletter subscribe popup promo\\w* sponsor\\w* modal login signup sidebar nav navbar navigation menu footer foot breadcrumbs? pagination pager".split()
PERHAPS = "alert banner copyright disclaimer header legal masthead notice recommended related search share sharing social tags toolbar topbar widget".split()
FOR_WORDS = "article body content entry main post story text".split()
WORDS = {name: re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words)})(?:$|[\s_-])", re.IGNORECASE) for name, words in (("sure", SURE), ("perhaps", PERHAPS), ("good", FOR_WORDS))}
TALK = re.compile(r"(?:^|[\s_-])(?:discussion|reactions|responses)(?:$|[\s_-])", re.IGNORECASE)
#: What the classifier sees: elements and words above a block (for it and against it), then its text; with the weights it starts from.
PRIOR = {
    "article": 4.0, "main": 3.5, "p": 1.0, "good": 1.5,
    "nav": -9.0, "footer": -8.0, "aside": -7.0, "form": -8.0, "header": -5.0, "menu": -8.0, "dialog": -7.0, "address": -2.0, "figure": -0.5, "sure": -7.5, "perhaps": -3.5,
    "hidden": -20.0,
    "one": -0.4, "words": 2.0, "sentences": 1.0, "stop": 0.4, "links": -2.5, "rights": -1.5,
}
NAMES = list(PRIOR)
IN_FAVOUR, ABOVE = 4, NAMES.index("one")
BIT = {name: 1 << k for k, name in enumerate(NAMES[:ABOVE])}
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|\baria-hidden\s*=\s*["']?true|\bdisplay\s*:\s*none""", re.IGNORECASE)
AGAINST = sum(BIT.values()) - sum(BIT[n] for n in NAMES[:IN_FAVOUR])
ELEMENT = {n: n for n in NAMES[:ABOVE] if n not in WORDS} | dict.fromkeys(("h1", "pre", "blockquote"), "p")
#: Pages of the sample, about, and blocks of each at most; how firmly the prior holds, against labels that weigh as many rows at most.
SAMPLE_PAGES, SAMPLE_BLOCKS, FIRMNESS, LABELS_WEIGH = 500, 200, 20.0, 200
#: Different pages of a host from which a text is template.
TEMPLATE_PAGES = 3
SMOOTH_NEXT, SMOOTH_SAME, SMOOTH_NEAR = 0.6, 1.4, 0.5


class Block:
    __slots__ = ("parent", "above", "link", "parts", "near")

    def __init__(self, parent: int, above: int, near: int):
        self.parent, self.above, self.near = parent, above, near
        self.parts: list[str] = []
        self.link = 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


def bits_of(name: str, attributes: str, above: int) -> int:
    """What is above the blocks of an element: what stands for content counts only where nothing above stands against it.

    A word that surely speaks against a block only perhaps does beside one that speaks for it, and so does a word on readers' talk within an article.
    """
    in_article = above & (BIT["article"] | BIT["main"])
    bits = BIT.get(ELEMENT.get(name, ""), 0)
    if name == "header" and in_article:
        bits = 0  # the head of an article belongs to it
    if attributes and name not in ("html", "body"):
        for _, value in ATTRIBUTE.findall(attributes):
            value = value.strip("\"'")
            if in_article or re.fullmatch("h[1-6]", name):
                value = re.sub("header", " ", value, flags=re.IGNORECASE)
            said = {kind for kind, words in WORDS.items() if words.search(value)}
            if "sure" in said and ("good" in said or (in_article and TALK.search(value))):
                said = said - {"sure"} | {"perhaps"}
            for kind in said:
                bits |= BIT[kind]
        if HIDDEN.search(attributes):
            bits |= BIT["hidden"]
    return above | (bits & AGAINST if above & AGAINST else bits)


def blocks_of(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, bits of what is above, share of link text, numbers of the parent element and of its parent) of each block with text.

    Time is linear in the page: every end mark is looked for once, and an end tag without an open element is passed over.
    """
    out: list[Block] = []
    # Open block elements: name, number, bits of it and all above.
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    count, links, at, current = 0, 0, 0, None
    opened: dict[str, int] = {}  # how many elements of a name are open
    endless: set[str] = set()  # raw elements and marks with no end in the rest of the page

    def add(piece: str) -> None:
        nonlocal current
        if current is None:
            current = Block(stack[-1][1], stack[-1][2], stack[-2][1] if len(stack) > 1 else 0)
            out.append(current)
        current.parts.append(piece)
        if links:
            current.link += len(piece.strip())

    while True:
        m = TAG.search(page, at)
        if not m:
            if at < len(page):
                add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            mark = ENDS.get(m[0], ">")
            end = -1 if mark in endless else page.find(mark, at)
            if end >= 0:
                if mark == "]]>":
                    add(page[at:end])
                at = end + len(mark)
            elif mark == "-->":
                break  # a comment without an end takes the rest
            else:
                endless.add(mark)
                add(m[0])
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            end = None if name in endless else RAW_END[name].search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
                at = len(page) if name in ("script", "style") else at
            if name not in ("button", "select", "annotation", "annotation-xml"):
                current = None
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            if name == "br" and current is not None:
                add(" ")
            continue
        current = None
        if closing:
            if opened.get(name):
                while (gone := stack.pop()[0]) != name:
                    opened[gone] -= 1
                opened[name] -= 1
                links = 0
            continue
        if (group := CLOSES.get(name)) is not None and stack[-1][0] in group:
            opened[stack.pop()[0]] -= 1
        if name == "p":
            links = 0
        if name in VOID:
            continue
        count += 1
        stack.append((name, count, bits_of(name, m[3], stack[-1][2])))
        opened[name] = opened.get(name, 0) + 1
    found = []
    for b in out:
        text = b.text()
        if text:
            found.append((text, b.above, min(1.0, b.link / len(text)), b.parent, b.near))
    return found


def of_text(text: str, link: float) -> list[float]:
    """The features of a block's own text, in the order of NAMES."""
    marks = sum(text.count(x) for x in (". ", ", ", "? ", "! "))
    rights = "©" in text or "all rights reserved" in text.lower()
    return [1.0, min(1.0, (text.count(" ") + 1) / 40), min(1.0, 0.5 * marks), float(text[-1] in ".!?…\"”»"), link if link > 0.5 else 0.0, float(rights)]


def evidence(text: str, above: int, link: float, weights: list[float]) -> float:
    """Log odds of content."""
    score = sum(w for k, w in enumerate(weights[:ABOVE]) if above >> k & 1)
    return score + sum(w * x for w, x in zip(weights[ABOVE:], of_text(text, link), strict=True))


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Logistic regression towards the prior, by Newton steps; each label weighs as much as the other, as a whole."""
    weights = prior.copy()
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * min(len(y), LABELS_WEIGH)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        g = x.T @ (share * (y - p)) - FIRMNESS * (weights - prior)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + FIRMNESS * np.eye(len(weights)), g)
        weights = weights + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def block_hash(host: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}\n{' '.join(text.lower().split())}") >> 1


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z]+:/*", "", (url or "").lower()).partition("/")[0]


def train(pages: DataFrame) -> list[float]:
    """Weights fitted to about SAMPLE_PAGES pages, chosen by a hash; of each, at most SAMPLE_BLOCKS blocks evenly spaced are read.

    Labels come from all pages, not from the weights: of the sample's blocks, those whose text stands on TEMPLATE_PAGES or more pages of a
    host that differ elsewhere are template, and those that stand on one page are content; others have no label.
    Without pages, or with one label alone, the prior stays.
    """

    def sampled(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"key": [], "x": []}
        for page, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True):
            blocks, host = blocks_of(page or ""), host_of(url)
            for text, above, link, _, _ in blocks[:: 1 + len(blocks) // SAMPLE_BLOCKS]:
                out["key"].append(block_hash(host, text))
                out["x"].append([float(above >> k & 1) for k in range(ABOVE)] + of_text(text, link))
        return out

    rows = pages.select("html", "url", F.xxhash64("page_id", "url", "html").alias("h")).where("html IS NOT NULL")
    sample = below_share(rows, SAMPLE_PAGES / max(1, pages.count()), "h").select("html", "url")
    found = arrow_map(sample, sampled, "key bigint, x array<double>").toArrow()
    prior = np.array(list(PRIOR.values()))
    if not found.num_rows:
        return prior.tolist()
    keys = np.unique(found.column("key").to_numpy())  # of the sample, so bounded
    asked = pages.sparkSession.sparkContext.broadcast(keys)

    def seen(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"key": [], "page": []}
        for page, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True):
            texts, host = [b[0] for b in blocks_of(page or "")], host_of(url)
            own = np.unique(np.array([block_hash(host, t) for t in texts], dtype=np.int64))
            at = np.minimum(np.searchsorted(asked.value, own), len(asked.value) - 1)
            out["key"] += own[asked.value[at] == own].tolist()
            out["page"] += [block_hash("", "\n".join(texts))] * (len(out["key"]) - len(out["page"]))
        return out

    on = arrow_map(rows.select("html", "url"), seen, "key bigint, page bigint")
    # Copies of a page count once.
    counts = on.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("page", 0.02).alias("kinds")).toArrow()
    order = np.argsort(counts.column("key").to_numpy())
    at = np.searchsorted(counts.column("key").to_numpy()[order], found.column("key").to_numpy())
    n, kinds = (counts.column(c).to_numpy()[order][at] for c in ("n", "kinds"))
    template, content = kinds >= TEMPLATE_PAGES, n == 1
    if not template.any() or not content.any():
        return prior.tolist()
    x = np.array(found.column("x").to_pylist()).reshape(found.num_rows, len(NAMES))
    labelled = template | content
    return fit(x[labelled], content[labelled].astype(float), prior).tolist()


def minimum_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a least cut.

    content and boilerplate: capacities from the source and to the sink; edges: (a, b, capacity both ways).  Flow that
    goes straight through a node is taken at once; the rest by shortest paths, level by level (Dinic).
    """
    n = len(content)
    source, sink = [max(0.0, c - b) for c, b in zip(content, boilerplate, strict=True)], [max(0.0, b - c) for c, b in zip(content, boilerplate, strict=True)]
    to, room, out = [], [], [[] for _ in range(n)]
    for a, b, w in edges:
        out[a].append(len(to))
        to.append(b)
        room.append(w)
        out[b].append(len(to))
        to.append(a)
        room.append(w)
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = [v for v in range(n) if source[v] > tiny]
        for v in queue:
            level[v] = 0
        reached = False
        for v in queue:
            if sink[v] > tiny:
                reached = True
            for e in out[v]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for root in range(n):
            while source[root] > tiny:
                path, v = [], root
                while sink[v] <= tiny:
                    while turn[v] < len(out[v]):
                        e = out[v][turn[v]]
                        if room[e] > tiny and level[to[e]] == level[v] + 1:
                            break
                        turn[v] += 1
                    if turn[v] == len(out[v]):
                        if not path:
                            v = -1
                            break
                        v = to[path.pop() ^ 1]
                        turn[v] += 1
                    else:
                        path.append(out[v][turn[v]])
                        v = to[path[-1]]
                if v < 0:
                    break
                push = min(source[root], sink[v], *(room[e] for e in path))
                source[root] -= push
                sink[v] -= push
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push


def labelled_blocks(page: str, weights: list[float] | None = None) -> list[tuple[str, bool]]:
    """(text, is content) of each block in page order; by the prior if there are no weights."""
    blocks = blocks_of(page)
    weights = weights or list(PRIOR.values())
    scores = [evidence(b[0], b[1], b[2], weights) for b in blocks]
    edges, last_of, last_near = [], {}, {}
    for i, (_, _, _, parent, near) in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SMOOTH_NEXT))
        if parent in last_of:
            edges.append((last_of[parent], i, SMOOTH_SAME))
        elif near in last_near:
            edges.append((last_near[near], i, SMOOTH_NEAR))
        last_of[parent] = last_near[near] = i
    inside = minimum_cut([max(0.0, s) for s in scores], [max(0.0, -s) for s in scores], edges)
    return [(b[0], c) for b, c in zip(blocks, inside, strict=True)]


def main_text(page: str, weights: list[float] | None = None) -> str:
    return "\n".join(t for t, content in labelled_blocks(page, weights) if content)


def extract(pages: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages, by weights of train(); text is empty for null, empty or textless html.

    Whole pages; null ids and urls and repeated rows stay; further columns are dropped.
    """

    def run(batch: pa.RecordBatch) -> dict:
        text = [main_text(h or "", weights) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": text, "n_chars": list(map(len, text))}

    return arrow_map(pages.select("page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
