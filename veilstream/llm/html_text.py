"""Main text of web pages from streamed parser events and text-to-tag ratios.

The standard library's parser streams start, end and text events; they are folded into *lines*, one for each block of
the page, with the number of tags they hold and the characters in and outside links.  Tags and names only weigh: the
lines of a *part* (navigation, footer, form, what is named advert, notice, comments ...) weigh nothing, unless the
part holds so much of the page that it is a mere wrapper.  The text-to-tag ratios are smoothed with a Gaussian along
the lines of each part, and a threshold splits all of them into two clusters.

The clusters decide.  Lines of the upper one vote, with their characters, for the elements around them; the innermost
element that holds nearly all of the votes (the article around it, if there is one) is the content region.  All its
lines are kept, however short, but for those of parts whose own lines are mostly in the lower cluster.  Beside an article
its main element's other articles are split by clusters of their own, and the headings before it count from the h1 on.

All steps are linear in the page: elements and parts point to their parents, and sums go up these pointers once.

Defined results: null, empty and tag-only pages give the empty string; text without any markup is one block;
unclosed elements end where their parent does, an unclosed comment or tag at the end of the page; a page of any length is read whole; equal and repeated pages give
equal texts, a row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.5
#: share of the votes that the content element must hold
MOST = 0.85
#: share of the page's characters from which a part is a wrapper; one named after nothing but page parts needs MOST
HALF = 0.5

# Element and attribute names with a meaning in HTML, and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SILENT = frozenset("script style noscript template svg math canvas iframe object audio video head title select option button textarea input datalist map".split())
CHROME = frozenset("nav footer aside menu dialog".split())
WRAPPING = frozenset("form header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond reply replies disqus widget widgets toolbar pagination pager copyright legal disclaimer alert skip".split()
)
#: of these, the ones that say so in whatever name they stand
ALWAYS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar cookie cookies consent gdpr popup modal newsletter subscribe signup login comment comments respond reply replies disqus pagination pager".split()
)
READERS = frozenset("comment comments respond reply replies disqus".split())
#: an element of this kind ends an open one of the same row
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: a name that starts so tells how a page is laid out, not what the element is
LAYOUT = frozenset("has with no".split())
#: elements that are no region by themselves: their siblings belong to them
_LONE = frozenset(["p", "li", "pre", "blockquote", *HEADINGS])

#: kinds of parts: the tag says so; the tag may say so, or wrap the page; the name says so; the name may say something
#: else; the name says readers' comments
TAG, WRAP, NAMED, MIXED, COMMENTS = range(5)


def _part(attrs: list) -> int | None:
    """Whether the names make an element another part of the page."""
    found = None
    for name, value in attrs:
        if name == "role" and value and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return NAMED
        if name in ("class", "id") and value:
            for token in value.split():
                words = [x.lower() for x in _NAME.findall(token)]
                if words and words[0] not in LAYOUT and not PARTS.isdisjoint(words):
                    if not READERS.isdisjoint(words):
                        return COMMENTS
                    if PARTS.issuperset(words) or not ALWAYS.isdisjoint(words):
                        return NAMED
                    found = MIXED
    return found


class _Lines(HTMLParser):
    """Folds events into lines, elements and parts; number 0 is the page itself."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.ending = False
        self.stack: list[int] = []  # open elements
        self.depths: dict[str, list[int]] = {}  # of the open elements of each name, deepest last
        self.names, self.up = [""], [0]  # of each element: name, parent
        # of each part: parent, kind, whether it is in an article, holds one, and is a header
        self.part_up, self.part_kind, self.part_in, self.part_holds, self.part_header = [0], [TAG], [False], [False], [False]
        self.part_of = [0]  # innermost part of each open element, beside the stack
        self.silent = 0  # depth of the outermost such element, or 0
        self.tags = self.free = self.all = 0
        self.text: list[str] = []
        self.words: list[list[str]] = []
        self.rows: list[tuple[int, int, int, int, int]] = []  # tags, characters outside links, all, element, part

    # What is never closed goes to the end of the page; looking for its end at every later "<" would take quadratic time.

    def close(self):
        self.ending = True
        super().close()

    def _to_end(self, i: int, k: int) -> int:
        return len(self.rawdata) if k < 0 and self.ending and self.rawdata.find(">", i) < 0 else k

    def parse_starttag(self, i):
        return self._to_end(i, super().parse_starttag(i))

    def parse_endtag(self, i):
        return self._to_end(i, super().parse_endtag(i))

    def parse_pi(self, i):
        return self._to_end(i, super().parse_pi(i))

    def parse_html_declaration(self, i):
        return self._to_end(i, super().parse_html_declaration(i))

    def parse_comment(self, i, report=True):
        k = super().parse_comment(i, report)
        return len(self.rawdata) if k < 0 and self.ending else k

    def inside(self, *names: str) -> bool:
        return any(self.depths.get(n) for n in names)

    def flush(self):
        if self.text:
            words = "".join(self.text).split()
            if words:
                self.words.append(words)
                self.rows.append((self.tags, self.free, self.all, self.stack[-1] if self.stack else 0, self._own_part()))
            self.text = []
        self.tags = self.free = self.all = 0

    def _own_part(self) -> int:
        """The part of a line that ends here; headings and paragraphs of an article's header are the article's."""
        part = self.part_of[-1]
        if self.part_header[part] and self.part_in[part] and self.inside("p", *HEADINGS):
            return self.part_up[part]
        return part

    def _pop(self, depth: int):
        """Close all elements from this depth (0 is the outermost) on."""
        if any(self.names[n] in BLOCKS for n in self.stack[depth:]) or self.part_of[depth] != self.part_of[-1]:
            self.flush()
        for n in self.stack[depth:]:
            own = self.depths[self.names[n]]
            while own and own[-1] >= depth:
                own.pop()
        del self.stack[depth:], self.part_of[depth + 1 :]
        if self.silent > depth:
            self.silent = 0

    def _open(self, names, limits=()) -> int | None:
        """The depth of the innermost open element of the names, if none of the limits is further in."""
        deepest = lambda of: max((d[-1] for n in of if (d := self.depths.get(n))), default=-1)
        at = deepest(names)
        return at if at >= 0 and at > deepest(limits) else None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if (i := self._open(("p", *(HEADINGS if tag in HEADINGS else ())), ("article", "main", "section", "div", "td", "th", "li", "blockquote", "body"))) is not None:
                self._pop(i)
            if tag == "body" and (i := self._open(("head",))) is not None:
                self._pop(i)
        if tag in CLOSES and (i := self._open(CLOSES[tag], LIMITS[tag])) is not None:
            self._pop(i)
        if tag in ("br", "td", "th", "hr", "img"):
            self.text.append(" ")
        if tag in VOID:
            self.tags += 1
            return
        in_article = self.inside("article", "main")
        kind = TAG if tag in CHROME else WRAP if tag in WRAPPING else None if tag in ("html", "body", *HEADINGS) else _part(attrs)
        if kind == MIXED and tag == "p" and in_article:
            kind = None
        if kind is not None:
            self.flush()
            self.part_up.append(self.part_of[-1])
            self.part_kind.append(kind)
            self.part_in.append(in_article)
            self.part_holds.append(False)
            self.part_header.append(tag == "header" or any("header" in (v or "") for k, v in attrs if k in ("class", "id")))
        if kind is None and tag in ("article", "main"):
            n = self.part_of[-1]
            while not self.part_holds[n] and self.part_kind[n] != COMMENTS:
                self.part_holds[n] = True
                n = self.part_up[n]
        self.tags += 1
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.names))
        self.up.append(self.stack[-2] if len(self.stack) > 1 else 0)
        self.names.append(tag)
        self.part_of.append(self.part_of[-1] if kind is None else len(self.part_up) - 1)
        if not self.silent and tag in SILENT:
            self.silent = len(self.stack)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if (i := self._open((tag,), ("article", "main", "body") if tag not in BLOCKS else ())) is not None:
            self._pop(i)

    def handle_data(self, data):
        if self.silent:
            return
        self.text.append(data)
        self.all += len(data)
        if not self.inside("a"):
            self.free += len(data)


def _sums_up(values: np.ndarray, up: list[int]) -> np.ndarray:
    """For each node of a tree, the sum over all below it; parents have smaller numbers."""
    out = values.tolist()
    for n in range(len(up) - 1, 0, -1):
        out[up[n]] += out[n]
    return np.array(out)


def _smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, w, "full")[reach : reach + len(x)] / np.convolve(np.ones(len(x)), w, "full")[reach : reach + len(x)]


def _threshold(x: np.ndarray) -> float:
    """Two clusters on a line: their border when their means no longer move."""
    x = np.sort(x)
    sums = np.r_[0.0, np.cumsum(x)]
    low, high = float(x[0]), float(x[-1])
    while True:
        border = (low + high) / 2
        k = int(np.searchsorted(x, border))
        a, b = float(sums[k]) / k if k else low, float(sums[-1] - sums[k]) / (len(x) - k) if k < len(x) else high
        if (a, b) == (low, high):
            return border
        low, high = a, b


def _weights(p: _Lines, size: np.ndarray, part: np.ndarray) -> np.ndarray:
    """1 for the lines of the page itself, of wrappers, and of what an article holds under a name that may mean anything; else 0."""
    held = _sums_up(np.bincount(part, size, minlength=len(p.part_up)), p.part_up)
    weight = np.ones(len(p.part_up))
    for n in range(1, len(weight)):  # outer parts first
        kind, holds = p.part_kind[n], p.part_holds[n]
        if kind == MIXED and p.part_in[n]:
            own = True
        elif kind != COMMENTS and (holds or not p.part_holds[0] and kind != TAG):  # where there is an article, a wrapper holds it
            own = held[n] >= (MOST if kind == NAMED and not holds else HALF) * held[0]
        else:
            own = False
        weight[n] = weight[p.part_up[n]] * own
    return weight[part]


def smoothed(ratio: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Ratios smoothed along the lines of each part."""
    smooth = np.empty(len(ratio))
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        smooth[own] = _smoothed(ratio[own], SIGMA)
    return smooth


def upper_cluster(smooth: np.ndarray) -> np.ndarray:
    """Whether each line is in the upper one of the two clusters of the smoothed ratios."""
    return (smooth >= _threshold(smooth)) & (smooth > 0)


def clusters(ratio: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Whether each line is in the upper cluster of the page's ratios, smoothed."""
    return upper_cluster(smoothed(ratio, part))


def _inherited(p: _Lines, own) -> list[int]:
    """For each element the innermost element around it (or itself) that own is true for, 0 if there is none."""
    out = [0]
    for n in range(1, len(p.up)):
        out.append(n if own(n) else out[p.up[n]])
    return out


def _beside(p: _Lines, best: int, element: np.ndarray, free: np.ndarray, every: np.ndarray, weight: np.ndarray, ratio: np.ndarray, part: np.ndarray) -> set[int]:
    """Elements that belong to the page's text beside an article: other articles of its main element (or with its
    parent), and headings of the main element before them, from its h1 on.

    An article with much shorter lines is in the lower cluster with all that is no text, so lines outside of the articles
    that are kept, smoothed article by article, are split again: an article is kept if most of its lines are in the upper cluster then, and four fifths
    of its characters are outside links.  Each round keeps those with the longest lines left; there are few rounds.
    """
    main = _inherited(p, lambda n: p.names[n] == "main")
    outer = [0]
    for n in range(1, len(p.up)):
        outer.append(outer[p.up[n]] or (n if p.names[n] == "article" else 0))
    if outer[best] != best:
        return {best}
    of = np.array(outer)[element]
    kept = {best}
    lines, chars, plain = (np.bincount(of, w, minlength=len(p.up)) for w in (np.ones(len(of)), every, free))
    near = {n for n in set(of.tolist()) - {0, best} if main[n] == main[best] and (main[n] or p.up[n] == p.up[best]) and 5 * plain[n] >= 4 * chars[n]}
    smooth = smoothed(ratio, part * len(p.up) + of) if near else ratio
    while near:
        rest = np.flatnonzero(~np.isin(of, list(kept)))
        above = np.bincount(of[rest], upper_cluster(smooth[rest]), minlength=len(p.up))
        more = {n for n in near if 2 * above[n] > lines[n]}
        if not more:
            break
        kept |= more
        near -= more
    if main[best]:
        heading = _inherited(p, lambda n: p.names[n] in HEADINGS)
        first = int(np.flatnonzero(np.isin(of, list(kept)))[0])
        before = [heading[e] for i, e in enumerate(element[:first].tolist()) if heading[e] and main[e] == main[best] and not outer[e] and weight[i] and free[i]]
        title = next((i for i, n in enumerate(before) if p.names[n] == "h1"), len(before))
        kept |= set(before[title:])
    return kept


def extract(html: str | None) -> str:
    p = _Lines()
    p.feed(html or "")
    p.close()
    p.flush()
    if not p.rows:
        return ""
    tags, free, every, element, part = np.array(p.rows, np.int64).T
    weight = _weights(p, every, part)
    shown = free if (weight * free).any() else every  # a text of nothing but links
    ratio = weight * shown / np.maximum(1, tags)
    chosen = clusters(ratio, part)
    if not chosen.any():
        return ""
    # a part stays if the upper cluster has half of its own characters, one without any if the part around it does
    size = np.bincount(part, every, minlength=len(p.part_up))
    upper = np.bincount(part, every * chosen, minlength=len(size))
    stays = np.ones(len(size), bool)
    for n in range(1, len(stays)):
        stays[n] = stays[p.part_up[n]] and (size[n] == 0 or 2 * upper[n] >= size[n])
    votes = _sums_up(np.bincount(element, (shown + 1) * chosen * stays[part], minlength=len(p.up)), p.up)
    best = max((n for n in range(1, len(p.up)) if votes[n] >= MOST * votes[0] and p.names[n] in BLOCKS), default=0)  # the innermost has the largest number
    if best and p.names[best] in _LONE:
        best = p.up[best]
    n = best
    while n and p.names[n] not in ("article", "main"):
        n = p.up[n]
    best = n or best
    roots = _beside(p, best, element, free, every, weight, ratio, part) if p.names[best] == "article" else {best}
    below = [best == 0]
    for n in range(1, len(p.up)):
        below.append(n in roots or below[p.up[n]])
    return "\n\n".join(" ".join(words) for words, e, x in zip(p.words, element.tolist(), part.tolist(), strict=True) if below[e] and stays[x])


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            text = [extract(x) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"].cast(pa.int64()), batch["url"], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
