"""Main text of web pages by tree scoring.

A page becomes a small tree.  Menus, footers, sidebars, notices, adverts, forms
and comments go by element, role or class word.  Every block of text that is
left earns points for its length and its commas and passes them to the elements
around it, half as many at each step up; an element's points are discounted by
the share of its text that stands in links.  The best element, widened to the
article or main element around it, and those of its siblings that hold text of
the same kind are kept.

All steps take time in proportion to the page: points and link shares are summed
bottom-up, once over the nodes, whatever their depth.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: what stands in these is never markup
RAW = set("script style title textarea xmp iframe noembed noframes".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul""".split())
#: blocks that hold blocks: a text that stands in one directly earns points for it, not for its parent
HOLDER = set("article body center dd details div fieldset html main section tr".split())
CELL = {"td", "th"}
#: an end tag does not reach past these
FENCE = {"table", "td", "th", "caption"}
#: an opening tag ends an open element of the set, unless one of the second set stands between
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": (CELL, {"tr", "table"}), "th": (CELL, {"tr", "table"}),
           **{t: ({"tbody", "thead", "tfoot"}, {"table"}) for t in ("tbody", "thead", "tfoot")}}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
INNER = HEADING | CELL | {"tr", "thead", "tbody", "caption", "dt", "legend", "summary"}
IN_HEAD = {"head", "title", "meta", "link", "script", "style", "base", "noscript", "template", "html"}

NOISE_TAGS = set("""nav footer aside script style noscript template iframe svg button select option textarea object canvas audio video map
    dialog menu search datalist progress meter""".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert status menu menubar toolbar form".split())
NOISE_WORDS = set("""ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot sponsor sponsors
    sponsored promo promos promotion promotions promoted banner banners sidebar sidebars rail widget widgets menu menus nav navs navbar
    navigation breadcrumb breadcrumbs crumbs footer footers header headers masthead topbar toolbar comment comments commentlist disqus
    replies respond cookie cookies cookiebar consent gdpr notice notices notification notifications alert alerts popup popups
    modal overlay lightbox newsletter newsletters subscribe subscription signup signin login register share shares sharing sharebar
    social follow related recommended trending popular outbrain taboola pagination pager paging search searchbox searchform skip
    skiplink hidden form forms""".split())
#: words that name a heading or a row of a table rather than the top of a page
TOP_WORDS = {"header", "headers"}
NEGATED = {"has", "with", "no", "without", "not", "is", "show"}
PLAIN_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby s samp small span strike strong sub sup time tt u var".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
TAG_BEGIN = re.compile("</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
COMMA = re.compile("[,،、，]")


class Page:
    """Nodes as columns (tag, parent, attributes), text runs (node, block number, text) in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attributes = ["html"], [-1], [""]
        self.runs: list[tuple[int, int, str]] = []
        self.html, self.block = html, 0
        self.stack, self.open = [0], {"html": 1}
        self._read()

    def _read(self) -> None:
        html, at, end, tag = self.html, 0, len(self.html), TAG
        while at < end:
            mark = html.find("<", at)
            if mark < 0:
                self._text(html[at:])
                return
            if mark > at:
                self._text(html[at:mark])
            found = tag.match(html, mark)
            if found is None and TAG_BEGIN.match(html, mark):
                if html.find(">", mark) < 0:
                    return  # the page is cut inside a tag
                tag = LOOSE_TAG  # a quote is never closed: from here on a tag ends at the next >
                found = tag.match(html, mark)
            if found:
                at = found.end()
                name = found[2].lower()
                if found[1]:
                    self._close(name)
                elif name in RAW:
                    stop = re.compile(f"</{name}", re.I).search(html, at)
                    if stop is None and name in ("title", "textarea"):
                        stop = re.compile("<").search(html, at)
                    at = stop.start() if stop else end
                    if stop and stop[0] != "<":
                        at = html.find(">", at) + 1 or end
                else:
                    self._start(name, found[3])
            elif html.startswith("<!--", mark):
                at = html.find("-->", mark + 2) + 3
                at = end if at == 2 else at
            elif html.startswith(("<!", "<?", "</"), mark):
                at = html.find(">", mark) + 1 or end
            else:
                self._text("<")
                at = mark + 1

    def _text(self, text: str) -> None:
        self.runs.append((self.stack[-1], self.block, unescape(text) if "&" in text else text))

    def _pop_to(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.open[self.tag[node]] -= 1
        del self.stack[depth:]

    def _end(self, names: set[str], stop: set[str]) -> None:
        """Close the innermost open element of ``names`` unless one of ``stop`` lies inside it."""
        if not any(self.open.get(n) for n in names):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[depth]]
            if name in names:
                self._pop_to(depth)
                return
            if name in stop:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self.open.get(name):
            return
        if name not in IN_HEAD:
            self._end({"head"}, BLOCK)
        if name in BLOCK:
            self.block += 1
            self._end({"p"}, FENCE | {"button"})
            if name in HEADING and self.tag[self.stack[-1]] in HEADING:
                self._pop_to(len(self.stack) - 1)
        if name in IMPLIED:
            self._end(*IMPLIED[name])
        if name in VOID:
            if name == "br" or name == "img":
                self._text(" ")
            return
        if name in CELL:
            self._text(" ")
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.attributes.append(attributes)
        self.stack.append(len(self.tag) - 1)
        self.open[name] = self.open.get(name, 0) + 1

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self.block += 1
        if name in CELL:
            self._text(" ")
        if name in ("html", "body") or not self.open.get(name):
            return
        stop = (FENCE | BLOCK if name not in BLOCK | FENCE else FENCE - {name}) if name != "table" else set()
        if name in ("tr", "tbody", "thead", "tfoot", "td", "th"):
            stop = {"table"}
        self._end({name}, stop)


def class_noise(tag: str, attributes: str) -> bool:
    """Whether role, class, id or visibility mark an element as no part of the article."""
    if not attributes or attributes.isspace():
        return False
    found = {k.lower(): (v[1:-1] if v[:1] in ("'", '"') else v) for k, v in ATTRIBUTE.findall(attributes)}
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    if found.get("role", "").lower() in NOISE_ROLES:
        return True
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w.lower() for w in CLASS_WORD.findall(name)]
        for before, w in zip(["", *words], words):
            if w in NOISE_WORDS and before not in NEGATED and not (w in TOP_WORDS and tag in INNER):
                return True
    return False


def _dead(p: Page) -> list[bool]:
    """Nodes that are no part of an article, and all below them."""
    n = len(p.tag)
    marked, by_words, in_article, in_code = [False] * n, [False] * n, [False] * n, [False] * n
    for v in range(n):
        tag, up = p.tag[v], p.parent[v]
        in_article[v] = tag == "article" or tag == "main" or up >= 0 and in_article[up]
        in_code[v] = tag in ("pre", "code") or up >= 0 and in_code[up]
        if tag in NOISE_TAGS or tag == "header" and not in_article[v]:
            marked[v] = True
        elif tag == "form":
            by_words[v] = True
        elif not (tag in PLAIN_INLINE or tag in ("html", "body", "main", "h1", "h2", "pre") or in_code[v]):
            by_words[v] = class_noise(tag, p.attributes[v])
    # a marked element that holds the article is a wrapper: what it holds outside other marked elements decides
    held = [[0, 0] for _ in range(n)]  # main or h1; articles
    for v in range(n - 1, 0, -1):
        if marked[v] or by_words[v] and p.tag[v] == "article":
            continue
        held[v][0] += p.tag[v] in ("main", "h1")
        held[v][1] += p.tag[v] == "article"
        for i in (0, 1):
            held[p.parent[v]][i] += held[v][i]
    dead = [False] * n
    for v in range(n):
        up = p.parent[v]
        wraps = p.tag[v] != "article" and (held[v][0] > 0 or held[v][1] == held[0][1] > 0)
        dead[v] = up >= 0 and dead[up] or marked[v] or by_words[v] and not wraps
    return dead


def main_text(html: str | None, share: float = 0.2) -> tuple[str, str | None, float]:
    """(text, element kept, its score) of one page; ("", None, 0.0) where nothing is left."""
    p = Page(html or "")
    n, dead = len(p.tag), _dead(p)
    linked, holder = [False] * n, [0] * n  # inside a link; the block element around
    for v in range(1, n):
        linked[v] = p.tag[v] == "a" or linked[p.parent[v]]
        holder[v] = v if p.tag[v] in BLOCK or p.tag[v] in CELL else holder[p.parent[v]]
    chars, link_chars, links = [0] * n, [0] * n, [0] * n
    for v in range(1, n):
        links[v] = int(p.tag[v] == "a" and not dead[v])
    blocks: list[tuple[int, str]] = []  # holder, text
    at = 0
    while at < len(p.runs):
        node, number, _ = p.runs[at]
        parts, first = [], None
        while at < len(p.runs) and p.runs[at][1] == number:
            node, _, text = p.runs[at]
            if not dead[node]:
                parts.append(text)
                size = len(text.strip())
                chars[node] += size
                link_chars[node] += size * linked[node]
                if first is None and size:
                    first = holder[node]
            at += 1
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((first, text))
    for v in range(n - 1, 0, -1):
        for column in (chars, link_chars, links):
            column[p.parent[v]] += column[v]
    # short links and nothing else make a menu, wherever it stands
    for v in range(1, n):
        menu = links[v] >= 3 and p.tag[v] in ("ul", "ol", "dl", "div", "section", "table", "p") and (
            link_chars[v] >= 0.8 * chars[v] and link_chars[v] < 25 * links[v])
        dead[v] = dead[v] or menu or dead[p.parent[v]]
    blocks = [(v, t) for v, t in blocks if not dead[v]]
    points = [0.0] * n
    for v, text in blocks:
        gain = 1 + len(COMMA.findall(text)) + min(len(text) / 100, 3)
        points[v if p.tag[v] in HOLDER or p.tag[v] in CELL or v == 0 else p.parent[v]] += gain
    for v in range(n - 1, 0, -1):
        points[p.parent[v]] += points[v] / 2
    score = [points[v] * (1 - link_chars[v] / chars[v]) if chars[v] and not dead[v] else 0.0 for v in range(n)]
    best = max(range(n), key=lambda v: (score[v], -v))
    if not blocks:
        return "", None, 0.0
    kept = _with_siblings(p, best, dead, score, chars, link_chars, share)
    under = [False] * n
    for v in range(n):
        under[v] = v in kept or v > 0 and under[p.parent[v]]
    return "\n".join(t for v, t in blocks if under[v]), p.tag[best], score[best]


def _with_siblings(p: Page, best: int, dead: list[bool], score: list[float], chars: list[int], link_chars: list[int],
                   share: float) -> set[int]:
    """The best element, or the article or main element around it, and its siblings of the same kind."""
    around, v = [best], best
    while p.parent[v] >= 0:
        v = p.parent[v]
        around.append(v)
    whole = [v for v in around if p.tag[v] == "article"] or [v for v in around if p.tag[v] == "main"]
    top = whole[-1] if whole else best
    kept, up = {top}, p.parent[top]
    if up < 0:
        return kept
    siblings = [v for v in range(up + 1, len(p.tag)) if p.parent[v] == up and not dead[v] and v != top and chars[v]]
    title = {p.parent[v] if p.tag[p.parent[v]] == "header" else v for v in range(len(p.tag)) if p.tag[v] == "h1"}
    for v in siblings:
        plain = link_chars[v] <= 0.25 * chars[v]
        heads = v < top and (v in title or any(p.parent[t] == v for t in title))
        if whole:
            same = p.tag[v] == p.tag[top] and score[v] >= share * score[top]
        elif p.tag[v] in HOLDER or p.tag[v] in ("table", "ul", "ol", "dl"):
            same = score[v] >= share * score[top]
        else:
            same = True
        if plain and (heads or same):
            kept.add(v)
    return kept


def extract(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """(page_id, url, text, n_chars, container, score), a row per row of ``pages``.

    ``text`` joins the blocks of the article by one newline; inside a block
    white space is one space, character references are decoded.  ``share`` is
    the part of the best element's score from which a sibling container is kept.

    A null or empty html, and a page of menus and notices alone, gives an empty
    text, no container and score 0.  Unclosed and badly nested elements are
    closed as browsers do; a cut page counts as far as it goes.  Null ids,
    repeated rows and ties keep their rows (of equal elements the outer one is
    best); an empty table gives no rows; columns besides page_id, url and html
    are not read.  No shuffle: pages never meet.
    """
    @F.arrow_udf("text string, container string, score double")
    def run(html: pa.Array) -> pa.Array:
        out = [main_text(h.as_py(), share) for h in html]
        columns = list(zip(*out)) or [(), (), ()]
        kinds = (pa.string(), pa.string(), pa.float64())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["text", "container", "score"])

    d = pages.select("page_id", "url", run(F.col("html").cast("string")).alias("found"))
    return d.select("page_id", "url", F.col("found.text").alias("text"), F.length("found.text").cast("long").alias("n_chars"),
                    F.col("found.container").alias("container"), F.col("found.score").alias("score"))
