"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of text; page furniture that markup names (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) leaves empty lines, and the bounds of an article
element leave a gap. The weights of a few lines in a row are summed: where the sums surge a stretch of text begins,
where they dive to zero it ends. A line weighs its characters outside links; in an article or main element
links count as well, and the line gets a bonus. Reading is linear in the page's length.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from tapeworks.llm.common import appended

#: Lines summed at each place, and the sum at which a stretch counts as text.
WINDOW, SURGE = 3, 86
#: Stretches that weigh less than this share of the heaviest one are left out.
SHARE = 0.25
#: An article element's lines weigh so many times their characters, and so much more each.
BONUS, HEAD_START = 8, 43

_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|math|object|select|audio|video|canvas)\b[^<>]*+(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))", re.S | re.I)
# No quantifier gives back what it took, and an unquoted < ends a tag's attributes, so that unclosed tags cost their own length.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^<>]*+>")
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Elements by their HTML meaning, and names that pages give to their furniture.
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "side-bar", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "header", "site-header", "page-header", "masthead", "footer", "site-footer", "cookie", "cookies", "consent", "gdpr",
    "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "comment", "comments", "disqus", "replies", "respond", "share", "social", "related",
    "widget", "toolbar", "pagination", "complementary", "contentinfo", "search",
}
#: Of these, the ones that may head an article without being furniture.
_HEADS = {"header", "page-header"}


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in _FURNITURE or name == "header" and not in_article:
        return True
    if name in ("article", "main", "body", "html", "p") or not attributes:
        return False
    if re.search(r"\bhidden\b|display\s*:\s*none", attributes, re.I):
        return True
    for m in _NAMES.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").lower().split():
            found = {word, *re.split(r"[-_]+", word)} & _WORDS
            if found - _HEADS or found and not in_article:
                return True
    return False


def _ends(tags: list) -> list[int | None]:
    """For each tag the place of the one that closes it, or None, by a stack for each name."""
    out: list[int | None] = [None] * len(tags)
    opened: dict[str, list[int]] = {}
    for k, (_, closing, name, *_) in enumerate(tags):
        if not closing:
            opened.setdefault(name, []).append(k)
        elif opened.get(name):
            out[opened[name].pop()] = k
    return out


def lines(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, inside an article) of each line; furniture and article bounds are empty lines."""
    html = _RAW.sub(lambda m: " " if (m[1] or "").lower() not in ("title",) else "", html)
    tags = [(m.start(), bool(m[1]), (m[2] or "").lower(), m[3] or "", m.end()) for m in _TAG.finditer(html)]
    ends = _ends(tags)
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = at = articles = in_link = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append((text, max(0, len(text) - linked), articles > 0))
        parts.clear()
        linked = 0

    k = 0
    while k < len(tags):
        start, closing, name, attributes, end = tags[k]
        if start > at:
            parts.append(html[at:start])
            linked += (start - at) * (in_link > 0)
        at = end
        if not closing and name and name not in _VOID and (j := ends[k]) is not None and _is_furniture(name, attributes, articles > 0):
            if name in _BLOCK or name == "head":
                close()
                out.append(("", 0, articles > 0))
            else:
                parts.append(" ")
            at, k = tags[j][4], j + 1
            continue
        if name in _BLOCK:
            close()
            if name in ("article", "main"):
                before, articles = articles, max(0, articles + (-1 if closing else 1))
                if not before or not articles:
                    out += [("", 0, False)] * (WINDOW - 1)
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
        k += 1
    parts.append(html[at:])
    close()
    return out


def stretches(weight: list[int]) -> list[tuple[int, int, int, int]]:
    """(first line, line after the last, largest sum, whole weight) of each run of lines between dives of the window's sum to zero."""
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    out, k = [], 0
    while k < len(sums):
        if not sums[k]:
            k += 1
            continue
        end = k
        while end < len(sums) and sums[end]:
            end += 1
        # The window runs ahead of the text: a stretch itself begins and ends with a line that weighs something.
        own = [i for i in range(k, end) if weight[i]]
        out.append((own[0], own[-1] + 1, max(sums[k:end]), sum(weight[k:end])))
        k = end
    return out


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by empty lines."""
    found = lines(html or "")
    weight = [(BONUS * len(t) + HEAD_START if a else own) if t else 0 for t, own, a in found]
    every = stretches(weight)
    if not every:
        return ""
    most = max(s[3] for s in every)
    chosen = [s for s in every if s[2] >= SURGE and s[3] >= SHARE * most] or [max(every, key=lambda s: (s[3], -s[0]))]
    return "\n\n".join(found[i][0] for a, b, *_ in chosen for i in range(a, b) if found[i][0])


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """pages (html, and any columns) with text and n_chars, the main text and its code points.

    Null html counts as empty and gives an empty text. Nothing is cut; an existing text or n_chars column gives way.
    Equal pages give equal texts, and repeated rows stay separate rows; an empty table gives no rows.
    """

    def make():
        import pyarrow as pa

        def run(b):
            texts = [main_text(h.as_py()) for h in b.column("html")]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return run

    return appended(pages, make, "text string, n_chars long", ["html"], keep, rows=500)
