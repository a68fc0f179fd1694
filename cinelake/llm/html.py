"""Main text of web pages by tag-path ratios.

A page is read into blocks: the text between two block-level tags, with the
path of block-level elements from the root. For every path the text length and
the punctuation of its blocks are summed; text per block, weighted by
punctuation and by the share of text outside links, is the path's ratio. The
ratios in page order are smoothed with a Gaussian window, fused with the
unsmoothed ones, and blocks from the standard deviation on are content. The
element around the content gives the text: the article or main element that
holds most of it, else the innermost element around all of it. Blocks inside
navigation, page headers, footers, sidebars, forms, notices, adverts, comments
and the like never take part.

What a class or id says counts less than what an element holds: such a mark is
passed over on an element around an article or main element, or around more
than half of the text that no element name rules out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import arrow_map

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mfrac mi mn mo mrow ms msqrt msub msup mtext semantics".split())
RAW = frozenset("script style template iframe object svg canvas audio video textarea select xmp title".split())
NEVER = frozenset("head nav footer aside form button dialog menu fieldset".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div body html main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|"
    r"social|share|sharing|comments?|commentlist|disqus|replies|respond|sidebars?|widgets?|nav|navbar|navigation|menus?|breadcrumbs?|footer|masthead|recommended|pagination|pager|toolbar|skip-link|login|search|"
    r"related(?:[_-]?(?:posts?|articles?|stories|content|links?|news|topics|items|pages|reading))?(?=\s|$))(?:$|[\s_-])",
    re.I,
)
# what a page has or lacks is no boilerplate itself
_STATE = re.compile(r"^(?:has|no|not|is|with|without)[_-].*|.*[_-](?:enabled|disabled|allowed)$", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？«»“”\"()]")


#: What rules an element out: nothing, its class or id, or its name, role or style.
FREE, MARKED, OUT = 0, 1, 2


class _Element:
    __slots__ = ("mark", "name", "number", "parent", "path")

    def __init__(self, name: str, parent: _Element | None, number: int, mark: int) -> None:
        self.name, self.parent, self.number, self.mark = name, parent, number, mark
        self.path = (parent.path if parent else "") + "/" + name

    def chain(self) -> Iterator[_Element]:
        e: _Element | None = self
        while e is not None:
            yield e
            e = e.parent


def _boilerplate(name: str, attributes: str, around: _Element) -> int:
    """FREE, MARKED or OUT for an element below ``around``."""
    if name in NEVER:
        return OUT
    inside = any(e.name in ("article", "main") for e in around.chain())
    if name in ("header", "noscript") and not inside:
        return OUT
    if not attributes or name in ("html", "body", "article", "main"):
        return FREE
    mark = FREE
    for key, value in _ATTR.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            said = " ".join(word for word in value.split() if not _STATE.match(word))
            if _BAD.search(said) or not inside and _HEADER.search(said):
                mark = MARKED
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return OUT
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return OUT
    return mark


def _kept(found: list[tuple[_Element, str, int]]) -> list[tuple[_Element, str, int]]:
    """Blocks that no element around them rules out."""
    allowed = [b for b in found if all(e.mark != OUT for e in b[0].chain())]
    total = sum(len(t) for _, t, _ in allowed)
    held: dict[int, int] = {}
    around: set[int] = set()  # elements around an article or main element that holds text
    for e, t, _ in allowed:
        inner = False
        for x in e.chain():
            held[x.number] = held.get(x.number, 0) + len(t)
            if inner:
                around.add(x.number)
            inner = inner or x.name in ("article", "main")
    return [b for b in allowed if all(e.mark == FREE or e.number in around or 2 * held[e.number] > total for e in b[0].chain())]


def blocks(page: str) -> list[tuple[_Element, str, int]]:
    """Blocks in page order: element, text with single spaces, characters of it inside links."""
    here = _Element("", None, 0, FREE)
    out: list[tuple[_Element, str, int]] = []
    text: list[str] = []
    linked, in_link, count = 0, 0, 0
    hidden = 0  # open inline elements that are boilerplate

    def flush() -> None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            out.append((here, whole, min(linked, len(whole))))
        text.clear()
        linked = 0

    inline: list[tuple[str, bool]] = []
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                if not hidden:
                    piece = entities.unescape(piece)
                    text.append(piece)
                    if in_link:
                        linked += len(piece.strip())
            continue
        name, closing = name.lower(), m.group(1) == "/"
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            if name not in INLINE:
                text.append(" ")
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name in VOID:
                pass
            elif closing:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i][0] == name:
                        hidden -= inline.pop(i)[1]
                        break
                in_link = sum(t == "a" for t, _ in inline)
            else:
                bad = bool(m.group(3)) and name != "a" and _boilerplate(name, m.group(3), here) != FREE
                inline.append((name, bad))
                hidden += bad
                in_link += name == "a"
            continue
        flush()
        inline, in_link, hidden = [], 0, 0
        if closing:
            for e in here.chain():
                if e.name == name:
                    here = e.parent
                    break
            continue
        if name == "body":  # its start ends an open head
            here = next((e for e in here.chain() if e.name in ("html", "")), here)
        if name in CLOSES_P:
            for e in here.chain():
                if e.name == "p":
                    here = e.parent
                    break
                if e.name in SCOPES:
                    break
        if name in SIBLINGS:
            for e in here.chain():
                if e.name in SIBLINGS[name]:
                    here = e.parent
                    if name != "tr" or e.name == "tr":
                        break
                elif e.name in SCOPES:
                    break
        if name not in VOID:
            count += 1
            here = _Element(name, here, count, _boilerplate(name, m.group(3), here))
    flush()
    return out


def main_text(page: str | None, sigma: float = 1.0) -> str:
    """The main text of a page, one line for each block; empty if it has none."""
    found = _kept(blocks(page or ""))
    if not found:
        return ""
    sums: dict[str, list[float]] = {}
    for e, t, linked in found:
        s = sums.setdefault(e.path, [0.0, 0.0, 0.0, 0.0])
        for i, v in enumerate((len(t), len(_PUNCTUATION.findall(t)), linked, 1)):
            s[i] += v
    ratio = {p: c / n * np.log(np.e + a) * (1 - k / c) for p, (c, a, k, n) in sums.items()}
    raw = np.array([ratio[e.path] for e, _, _ in found])
    reach = int(3 * sigma) or 1
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    padded = np.pad(raw, reach, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), "valid")
    fused = np.sqrt(raw * smooth)
    content = fused >= fused.std()
    if not content.any():
        content = fused >= fused.max()
    weight = [len(t) if c else 0 for (_, t, _), c in zip(found, content)]
    total = sum(weight)
    held: dict[int, int] = {}
    for (e, _, _), w in zip(found, weight):
        for x in e.chain():
            if x.name in ("article", "main"):
                held[x.number] = held.get(x.number, 0) + w
    around = {number for number, w in held.items() if 2 * w >= total}
    if around:
        inner = max(around)  # the innermost is numbered last
        keep = [any(x.number == inner for x in e.chain()) for e, _, _ in found]
    else:
        chains = [[x for x in e.chain()][::-1] for (e, _, _), c in zip(found, content) if c]
        shared = [x for i, x in enumerate(chains[0]) if all(len(c) > i and c[i] is x for c in chains)]
        top = shared[-1]
        if top.name in ("", "html", "body"):
            keep = content.tolist()
        else:
            keep = [any(x is top for x in e.chain()) for e, _, _ in found]
    return "\n".join(t for (_, t, _), k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages (page_id, url, html)``.

    Null and empty pages, and pages without any content, give an empty text;
    very long pages are read whole. Repeated rows give repeated results; other columns are ignored; an empty
    table gives no rows.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    needed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(needed, rows, "page_id long, url string, text string, n_chars long")
