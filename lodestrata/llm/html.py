"""Main text of web pages by minimum-cut labelling of their text blocks."""

from __future__ import annotations

import re
from collections import Counter, deque
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the markup language: what holds no running text, what starts
# and ends a block, what has no end tag.
RAW = "script|style|title|textarea|iframe|xmp|noframes"
#: Elements left out with all that is in them, if their end tag is there.
SKIPPED = frozenset("template svg select button canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("hr br img input link meta area base col embed source track wbr".split())
#: A start tag of the first kind ends an open element of the second, up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements, and words of class, id and role, that speak for or against main text.
AGAINST = frozenset("nav header footer aside form menu dialog search".split())
WORDS_AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header "
    "masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "form search pagination pager toolbar widget copyright legal disclaimer complementary contentinfo".split()
)
#: Readers' words read like main text, so their names weigh more.
WORDS_READERS = frozenset("comment comments commentlist reply replies discussion respond disqus".split())
FOR = frozenset({"article", "main"})
WORDS_FOR = frozenset("article post entry story content main text body".split())
#: Classes of an element that is a section of a text, as document generators write them.
WORDS_SECTION = frozenset("section subsection chapter".split())
#: A name that begins or ends so tells what the page has, not what the element is.
WORDS_STATE = (frozenset("with has no without not hide show is js".split()), frozenset("open closed enabled disabled on off".split()))

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>)(?:.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

#: Evidence of an element's kind or name against main text, of a name of readers' words,
#: of a name with words for and against: the classifier takes it in units of the first.
HINT, READERS, MIXED = 9.0, 18.0, 1.0
#: What the page itself says of a block, in log-odds: it is in an article or main element, in
#: one named like that, outside of the page's own article or of what is named so.
SECTION, NAMED, OUTSIDE, UNNAMED = 6.0, 3.0, 3.0, 1.5
#: Smoothness edges: to the next block and to the one before in the same element; what is
#: left of an edge between a block with evidence against it and one without.
NEXT, NEAR, BORDER = 1.5, 1.0, 0.1
#: Weights of the features (see ``features``) before any page is seen.
PRIOR = np.array([0.6, 4.0, -3.5, -0.4, 0.5, -4.0, -9.0, 0.5, 0.0])
#: Pages that weights are fitted on at most, blocks of each, and what all these blocks
#: count for beside the prior, whose weights have a deviation of one each.
FIT_PAGES, FIT_BLOCKS, FIT_WEIGHT = 400, 200, 200.0
#: Words of a block that is long.
LONG = 40
#: An element that holds this share of a page's words, and beside which there is no more than
#: the second share of that without evidence, is the page, whatever its name.
WRAPS, BESIDE = 0.5, 0.1


@dataclass
class Element:
    """An element that may hold blocks: its parent's number, what its kind and its names say
    against it, whether it is an article or main element, named like one, or a
    heading or section, and the words in it that are no links."""

    parent: int
    tag: str
    kind: float
    names: float
    article: bool
    named: bool
    topical: bool
    words: float = 0.0


@dataclass
class Block:
    """Text between two block boundaries; its innermost element; the share of link text; the
    element around its own; steps in the tree from the block before; and the
    evidence of the elements that it is in."""

    text: str
    element: int
    links: float
    home: int
    steps: int
    words: int = 0
    against: float = 0.0
    place: float = 0.0
    labelled: bool | None = field(default=None)


def _element(parent: int, tag: str, rest: str) -> Element:
    """What an element's kind and names say.

    Of a name of several words, the last says what the element is, the others what it
    is about: ``article-header`` is a header, ``form-article`` an article."""
    out = Element(parent, tag, HINT * (tag in AGAINST), 0.0, tag in FOR, False, tag in HEADINGS or tag == "section")
    if "=" in rest:
        for m in _NAMES.finditer(rest):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                words = _WORD.findall(name)
                if not words or len(words) > 1 and (words[0] in WORDS_STATE[0] or words[-1] in WORDS_STATE[1]):
                    continue
                if name in WORDS_SECTION:
                    out.topical = True
                elif words[-1] in WORDS_FOR:
                    out.named = tag != "body"
                    out.names = max(out.names, MIXED * (not WORDS_AGAINST.union(WORDS_READERS).isdisjoint(words)))
                elif not WORDS_READERS.isdisjoint(words):
                    out.names = max(out.names, READERS)
                elif not WORDS_AGAINST.isdisjoint(words):
                    out.names = max(out.names, HINT)
    if tag in ("body", "html", "main"):
        out.names = 0.0
    return out


def _tokens(page: str) -> list[tuple[int, int, str, bool, str | None]]:
    """(start, end, name, whether it ends, attributes) of tags; the name is empty for what is
    passed over: comments, raw text, and skipped elements from start to end tag."""
    out: list[tuple[int, int, str, bool, str | None]] = []
    # Where skipped elements without an end tag so far started, by name.
    open_: dict[str, list[int]] = {x: [] for x in SKIPPED}
    skips: dict[int, int] = {}
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        if m[1] and open_["svg"] and m[2].endswith("/>"):
            # A foreign element: closed.
            at = m.end(2)
        tag = "" if m[4] is None else m[4].lower()
        if tag in SKIPPED:
            if m[3]:
                if open_[tag]:
                    skips[open_[tag].pop()] = len(out)
            elif not (tag == "svg" and (m[5] or "").endswith("/>")):
                open_[tag].append(len(out))
        out.append((m.start(), at, tag, bool(m[3]), m[5]))
    kept, i = [], 0
    while i < len(out):
        end = skips.get(i, i)
        kept.append(out[i] if end == i else (out[i][0], out[end][1], "", False, None))
        i = end + 1
    return kept


def read(page: str) -> tuple[list[Block], list[Element]]:
    """The page's text blocks in order, and its elements, each after its parent; the first
    stands for the page. Tags that are missing are implied."""
    out: list[Block] = []
    elements = [Element(-1, "", 0.0, 0.0, False, False, False)]
    # Numbers of the open elements.
    stack = [0]
    open_: Counter[str] = Counter()
    at, anchor = 0, False
    parts: list[str] = []
    linked = 0
    # Depth of the last block, and the least depth since.
    depth, least = 1, 1

    def flush() -> None:
        nonlocal linked, depth, least
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                home = stack[-2] if len(stack) > 1 else -1
                b = Block(text, stack[-1], min(1.0, linked / len(text)), home, depth + len(stack) - 2 * least, text.count(" ") + 1)
                elements[b.element].words += b.words * (1 - b.links)
                out.append(b)
                depth = least = len(stack)
            parts.clear()
        linked = 0

    def take(upto: int) -> None:
        nonlocal linked
        if upto > at:
            text = page[at:upto]
            if "&" in text:
                text = unescape(text)
            parts.append(text)
            if anchor:
                linked += len(text)

    def close(i: int) -> None:
        nonlocal least
        open_.subtract(elements[e].tag for e in stack[i:])
        del stack[i:]
        least = min(least, len(stack))

    for start, end, tag, ends_it, rest in _tokens(page):
        take(start)
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            anchor = not ends_it
        elif tag in BLOCKS:
            flush()
            if ends_it:
                if open_[tag]:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].tag == tag))
                continue
            if elements[stack[-1]].tag == "p":
                close(len(stack) - 1)
            if tag in IMPLIED:
                ends, upto = IMPLIED[tag]
                if any(open_[x] for x in ends):
                    for i in range(len(stack) - 1, 0, -1):
                        if elements[stack[i]].tag in ends:
                            close(i)
                            break
                        if elements[stack[i]].tag in upto:
                            break
            if tag not in VOID:
                elements.append(_element(stack[-1], tag, rest or ""))
                stack.append(len(elements) - 1)
                open_[tag] += 1
    take(len(page))
    flush()
    for e in reversed(elements[1:]):
        elements[e.parent].words += e.words
    return out, elements


def own_article(elements: list[Element]) -> int | None:
    """The element that is the page's article: of article and main elements, or else of those
    named so, the one with most words for what speaks against it and around it; of
    one in another, the inner if it has most of the outer's words."""
    for choose in (lambda e: e.article, lambda e: e.named and e.kind + e.names < HINT):
        against, best, score = [0.0] * len(elements), None, 0.0
        for i, e in enumerate(elements[1:], 1):
            against[i] = against[e.parent] + e.kind + e.names
            if choose(e) and e.words > 0:
                inner = best is not None and _inside(elements, i, best)
                value = e.words / (1 + against[i])
                if inner and e.words >= 0.5 * elements[best].words or not inner and value > score:
                    best, score = i, max(score, value)
        if best is not None:
            return best
    return None


def _inside(elements: list[Element], i: int, outer: int) -> bool:
    while i > outer:
        i = elements[i].parent
    return i == outer


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order with the evidence of the elements that they are in.

    Evidence adds up from the outside, with three exceptions. What is said of elements around
    the page's own article says nothing of the article. Names of headings, and of
    sections inside that article, tell topics. An element that holds most of the
    page, with next to nothing without evidence beside it, is the page, not a form or what
    its name says."""
    found, elements = read(page)
    own = own_article(elements)
    total = elements[0].words
    n = len(elements)
    against, section, named, teaser, within = [0.0] * n, [False] * n, [False] * n, [False] * n, [False] * n
    wrapping: set[int] = set()
    if own is None:
        large = [i for i, e in enumerate(elements) if i and e.kind + e.names >= HINT and e.names < READERS and (not e.kind or e.tag == "form") and e.words >= WRAPS * total]
        if large:
            clean = [True] + [False] * (n - 1)
            for i, e in enumerate(elements[1:], 1):
                clean[i] = clean[e.parent] and e.kind + e.names < HINT
            plain = sum(b.words * (1 - b.links) for b in found if clean[b.element])
            wrapping = {i for i in large if plain <= BESIDE * elements[i].words}
    for i, e in enumerate(elements[1:], 1):
        up = e.parent
        within[i] = within[up] or i == own
        names = 0.0 if e.tag in HEADINGS or e.topical and within[up] else e.names
        mine = 0.0 if i == own or i in wrapping else e.kind + names
        # What speaks against an element inside an article speaks of that part of it. An
        # article in an aside or a menu is a teaser; one in an element that is only
        # named like these may be the article.
        part = mine < HINT
        teaser[i] = teaser[up] or e.tag in AGAINST and i not in wrapping
        against[i] = mine if i == own else against[up] + mine
        section[i] = section[up] and part or e.article and (i == own or not teaser[i])
        named[i] = e.named or named[up] and part
    for b in found:
        i = b.element
        b.against = against[i]
        b.place = SECTION * section[i] + NAMED * named[i]
        if own is not None and not within[i]:
            b.place -= OUTSIDE if elements[own].article else UNNAMED
        if own is not None and elements[own].article and not (within[i] and b.against):
            b.labelled = within[i]
    return found


def features(found: list[Block]) -> np.ndarray:
    """What the classifier sees of each block; nothing of article and main elements.

    One; its length up to ``LONG`` words, of text that is no link; the share of links; whether it
    is short; whether it ends like a sentence; whether it has no letter or digit; the
    evidence against it; the mean length of the blocks before and after; how far it is from both ends."""
    n = len(found)
    out = np.zeros((n, len(PRIOR)))
    out[:, 0] = 1
    out[:, 1] = [min(1.0, b.words / LONG) * (1 - b.links) for b in found]
    out[:, 2] = [b.links for b in found]
    out[:, 3] = [b.words < 10 for b in found]
    out[:, 4] = [b.text[-1] in ".!?\u2026:;\"\u201d\u00bb)" for b in found]
    out[:, 5] = [not any(map(str.isalnum, b.text)) for b in found]
    out[:, 6] = [min(3.0, b.against / HINT) for b in found]
    if n > 1:
        out[1:, 7] += out[:-1, 1] / 2
        out[:-1, 7] += out[1:, 1] / 2
        at = np.linspace(-1, 1, n)
        out[:, 8] = 1 - np.abs(at)
    return out


def costs(found: list[Block], weights: np.ndarray = PRIOR) -> tuple[list[float], list[float]]:
    """(cost of dropping, cost of keeping) of each block by itself: the classifier's log-odds
    of main text and what the page says of the block's place, on the side that it speaks for."""
    odds = features(found) @ weights + [b.place for b in found]
    return np.maximum(odds, 0).tolist(), np.maximum(-odds, 0).tolist()


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a normal prior of deviation one around
    ``PRIOR``, by Newton steps with halving; the prior makes them unique."""
    w = PRIOR.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ((w - PRIOR) ** 2).sum() / 2)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weight * (p - y)) + (w - PRIOR)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), slope)
        while (after := loss(w - step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        if np.abs(step).max() < 1e-10:
            break
        w, now = w - step, after
    return w


def learn(pages: DataFrame, key: str = "page_id", page: str = "html") -> np.ndarray:
    """Weights fitted on blocks of pages that say where their article is: blocks in it are
    main text, those outside are not, those in it with evidence against them are left out.

    A bounded sample: at most ``FIT_PAGES`` pages with an article or main element, least by a
    hash of key and text, and of each at most ``FIT_BLOCKS`` blocks, evenly spread. Pages
    count alike. Without such a page the weights are the prior's."""

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                got = blocks(x.as_py())
                found = [(f, b.labelled) for b, f in zip(got, features(got), strict=True) if b.labelled is not None]
                found = [found[i] for i in np.unique(np.linspace(0, len(found) - 1, min(len(found), FIT_BLOCKS)).astype(int)).tolist()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f.tolist() for f, _ in found], pa.list_(pa.float64())), pa.array([bool(y) for _, y in found]), pa.array([1 / len(found)] * len(found))], ["x", "y", "weight"])

    at = F.xxhash64(key, page)
    some = pages.where(F.col(page).rlike("(?i)<(?:article|main)[\\s>]"))
    drawn = [r[0] for r in some.select(at.alias("at")).distinct().orderBy("at").limit(FIT_PAGES).collect()]
    sample = some.where(at <= F.lit(drawn[-1])) if drawn else some.limit(0)
    sample = sample.select(at.alias("at"), F.col(page).alias("page")).dropDuplicates(["at"]).select("page").mapInArrow(run, "x array<double>, y boolean, weight double").toPandas()
    if not len(sample):
        return PRIOR
    order = sample.assign(t=sample["x"].map(tuple)).sort_values(["t", "y", "weight"]).index
    sample = sample.loc[order]
    weight = sample["weight"].to_numpy()
    return fit(np.stack(sample["x"].to_numpy()), sample["y"].to_numpy(float), weight * FIT_WEIGHT / weight.sum())


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the next block, by how near it is in the tree, and to the
    block before in the same element."""
    out, last = [], {}

    def add(i: int, j: int, weight: float) -> None:
        out.append((i, j, weight * (BORDER if (found[i].against >= HINT) != (found[j].against >= HINT) else 1.0)))

    for i, b in enumerate(found):
        if i:
            add(i - 1, i, NEXT / (1 + b.steps))
        # A block's own element is mostly a paragraph; the one around it counts.
        if b.home in last:
            add(last[b.home], i, NEAR)
        last[b.home] = i
    return out


def minimum_cut(drop: list[float], keep: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: main text) of least total cost, by maximum flow.

    The source feeds each block with the cost of dropping it, the sink drains
    the cost of keeping it, and links cost what they carry when their ends
    differ. What can pass straight through a block does so at once; the rest
    finds its way by shortest augmenting paths from one block after the other.
    What a block with flow left still reaches, without an end, is main text and
    is not searched again, so a page costs about its blocks.
    """
    n = len(drop)
    over = [d - k for d, k in zip(drop, keep, strict=True)]
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        room[a][b] = room[a].get(b, 0.0) + w
        room[b][a] = room[b].get(a, 0.0) + w
    tiny = 1e-9
    main = [False] * n
    for start in range(n):
        while over[start] > tiny and not main[start]:
            came = {start: -1}
            queue = deque(came)
            end = -1
            while queue and end < 0:
                i = queue.popleft()
                for j, w in room[i].items():
                    if w > tiny and j not in came and not main[j]:
                        came[j] = i
                        if over[j] < -tiny:
                            end = j
                            break
                        queue.append(j)
            if end < 0:
                for i in came:
                    main[i] = True
                break
            path, i = [], end
            while came[i] >= 0:
                path.append((came[i], i))
                i = came[i]
            flow = min(over[start], -over[end], *(room[a][b] for a, b in path))
            over[start] -= flow
            over[end] += flow
            for a, b in path:
                room[a][b] -= flow
                room[b][a] += flow
    return main


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """The main text: blocks in page order, one a line. Empty for a null page or one
    whose blocks all look like boilerplate. White space only parts words; a page
    without tags is one block."""
    found = blocks(page or "")
    if not found:
        return ""
    labels = minimum_cut(*costs(found, weights), edges(found))
    return "\n".join(b.text for b, main in zip(found, labels, strict=True) if main)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """Per page: key, url, text, n_chars. Costs are of ``weights``, or learned from a bounded sample
    of the pages. Pages are read whole, one at a time; repeated pages give
    repeated rows, null pages empty texts, an empty table no rows."""
    weights = learn(pages, key, page) if weights is None else weights

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(key, url, page).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, `{url}` string, text string, n_chars long")
