"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines, one for each block of text. Text lengths are summed over sliding windows
of lines (anchor text counts nothing); where a sum surges above a threshold a region starts, and where
it dives to nothing the region ends. The text between these points is kept.

Tags and marks (words of class, id and role) weigh lines. In an article a character counts
``ARTICLE`` times, in a header, footer, navigation or sidebar one ``LIGHT``-th, so that these need a long
text of their own to surge, and then more of it than the page has beside them. Names that only a mark
makes up (``ad``, ``comment-list``) take a line out, unless nothing else on the page surges. Names that
hold a mark among other words (``menu-left``), and words that wrappers of main text carry as well, take
it out unless most of the text around it is under them. On a page with an article, a region outside
needs more text than half of the article's. Short regions follow the long ones that they stand between
or next to, if they are prose.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .udf import text_udf

#: Lines of a window, and characters without anchors that a window must reach in a region.
WINDOW, SURGE = 3, 80
#: What a character in an article counts, and what share of one in a header, footer or the like does.
ARTICLE, LIGHT = 8, 8

# Names of HTML elements.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "title")
BOILERPLATE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "head")
# Elements whose end tag may be left out.
OPEN_ENDED = ("p", "li", "dt", "dd", "tr", "td", "th", "option")
BLOCKS = (
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul"
).split()
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HIDDEN = ("form", "menu", "dialog", "select", "button", "head")
# Words of class, id and role that mark what is no main text, and words that mark it
# unless most of the text is under them.
STRONG = (
    "ad ads adv advert advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted recommended respond replies signup sponsor sponsored subscribe subscription "
    "toolbar alert complementary contentinfo"
).split()
WEAK = "banner feedback promotion related reply search share sharing sidebar social widget widgets header".split()
# Words that name a part of a page and may stand beside a mark.
PARTS = "area bar block body bottom box container form group holder inner item items link links list outer panel section slot top unit wrap wrapper zone".split()
# Words before a mark that turn it round.
NOT = ("has", "with", "no", "without", "non", "post", "article", "entry", "story", "content")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_RAW, _BOILERPLATE, _HIDDEN, _OPEN_ENDED, _BLOCKS, _VOID, _STRONG, _WEAK, _PARTS, _NOT = map(frozenset, (RAW, BOILERPLATE, HIDDEN, OPEN_ENDED, BLOCKS, VOID, STRONG, WEAK, PARTS, NOT))
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(BLOCKS)})\b", re.I)
_SENTENCE = re.compile(r"[.!?…。！？]['\"»”)]*$")


PLAIN, LESS, OUT = 0, 1, 2


def _mark(attributes: str) -> int:
    """3 for an element that isn't shown, 2 if its class, id or role says that it is no main text, 1 if it
    may say so, else 0."""
    mark = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" and (not m[2] or value in ("", "hidden")) or name == "aria-hidden" and value == "true":
            return 3
        for token in value.split() if name in ("class", "id", "role") else ():
            words = [w.lower() for w in _WORDS.findall(token)]
            whole = all(w in _STRONG or w in _WEAK or w in _PARTS for w in words)
            for before, w in zip(["", *words], words):
                if before not in _NOT and (w in _STRONG or w in _WEAK):
                    mark = max(mark, 2 if w in _STRONG and whole else 1)
    return mark


@dataclass
class Line:
    """A block of text: its characters outside anchors, is it in an article, the innermost weak mark over
    it (0: none), and is it plain, of a header or the like (``LESS``), or marked (``OUT``). A blank line
    stands for what is skipped."""

    text: str
    own: int
    inside: bool
    group: int
    kind: int = PLAIN

    @property
    def weight(self) -> float:
        return self.own * (1 / LIGHT if self.kind else ARTICLE if self.inside else 1)


class _Lines:
    """Collects text up to the end of each block."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        self.mute = False

    def text(self, raw: str, in_anchor: bool) -> None:
        if raw and not self.mute:
            self.parts.append(raw)
            self.linked += len(raw) if in_anchor else 0

    def close(self, inside: bool, group: int, kind: int, blank: int = 0) -> None:
        line = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip() if self.parts else ""
        if line:
            self.lines.append(Line(line, max(0, len(line) - self.linked), inside, group, kind))
        elif blank and self.lines and self.lines[-1].text:
            self.lines.extend([Line("", 0, inside, group)] * blank)
        self.parts, self.linked, self.mute = [], 0, False


class _Open:
    """The open elements from the outermost marked one on, with what they do to the text in them: ``s``
    skips it, ``o`` marks it, ``l`` makes it light, a number is a weak mark. Questions about them take
    constant time, however many are open."""

    def __init__(self) -> None:
        self.parents = [0]  # of each weak mark the one around it
        self.clear()

    def clear(self) -> None:
        self.stack: list[tuple[str, str | int]] = []
        self.names: Counter[str] = Counter()
        self.effects: Counter[str | int] = Counter()
        self.weak = 0

    def push(self, name: str, effect: str | int) -> None:
        if effect == 0:  # a weak mark
            self.parents.append(self.weak)
            effect = self.weak = len(self.parents) - 1
        self.stack.append((name, effect))
        self.names[name] += 1
        self.effects[effect] += 1

    def pop_to(self, name: str) -> None:
        top = ""
        while top != name:
            top, effect = self.stack.pop()
            self.names[top] -= 1
            self.effects[effect] -= 1
            if isinstance(effect, int):
                self.weak = self.parents[effect]
        if not (self.weak or self.effects["s"] or self.effects["o"] or self.effects["l"]):
            self.clear()

    @property
    def kind(self) -> int:
        return OUT if self.effects["o"] else LESS if self.effects["l"] else PLAIN


def lines_of(page: str) -> tuple[list[Line], list[int]]:
    """The lines of a page in order, and of each weak mark the one around it. Time is linear in the page,
    whatever its markup: no search starts where an earlier one found that there is nothing more."""
    out, open_, at, end = _Lines(), _Open(), 0, len(page)
    last_tag, no_end = page.rfind(">"), set()
    anchor, article = 0, 0

    def close(blank: int = 0) -> None:
        out.close(article > 0, open_.weak, open_.kind, blank)

    while at < end:
        lt = page.find("<", at)
        lt = end if lt < 0 else lt
        skips = open_.effects["s"] > 0
        if not skips:
            out.text(page[at:lt], anchor > 0)
        if lt == end:
            break
        m = None
        if lt < last_tag or page.startswith(("<!", "<?"), lt):
            m = _TOKEN.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:  # a bare <
            if not skips:
                out.text("<", anchor > 0)
            at = lt + 1
            continue
        at = m.end()
        if m.lastindex is None or not m[2]:
            continue
        closing, name = bool(m[1]), m[2].lower()
        if name in _RAW:
            if not closing and not m[3].endswith("/"):
                at = _raw_end(page, at, name, no_end)
            continue
        if name == "a":
            anchor = 0 if closing else 1
            continue
        outermost = name in ("article", "main", "body", "html")
        if skips and not closing and name in ("article", "main") and not article and not (open_.names["form"] or open_.names["dialog"]):
            open_.clear()  # an article isn't part of what was left open before it
            skips = False
        elif not closing and name in ("article", "main") and not article and open_.effects["l"]:
            close()
            open_.clear()
        known = open_.names[name] > 0
        if skips and not (closing and (known or outermost)):
            if not closing and name not in _VOID and not m[3].endswith("/") and name not in _OPEN_ENDED:
                open_.push(name, "")
            continue
        if name in _BLOCKS or known:
            if not skips:
                close()
            anchor = 0
        if closing:
            if known:
                open_.pop_to(name)
            elif outermost:  # what is marked was never closed
                open_.clear()
            if name in ("article", "main"):
                article = max(0, article - 1)
                close(WINDOW)
            continue
        if name in ("article", "main"):
            close(WINDOW)
            article += 1
        ends = name in _VOID or m[3].endswith("/")
        structural = name in _BOILERPLATE and not (name == "header" and article)
        mark = 0 if ends or name in ("body", "html", "article", "main") else 3 if name in _HIDDEN and name != "form" else max(_mark(m[3]) if m[3].strip() else 0, int(structural))
        effect = {0: "", 1: 0, 2: "o", 3: "s"}[mark]
        if structural and mark < 3 and name != "form":
            effect = "o" if article or mark == 2 else "l"
        if effect != "" and name not in _BLOCKS:
            close()
        if effect != "" and name in _OPEN_ENDED:
            out.mute = True  # up to the next block
        elif effect != "" or open_.stack and not ends and name not in _OPEN_ENDED:
            if effect in ("s", "o", "l"):
                close(WINDOW if structural and not article else 1)
            open_.push(name, effect)
    close()
    return out.lines, open_.parents


def _raw_end(page: str, at: int, name: str, no_end: set[str]) -> int:
    """The end of an element of raw text; one that is never closed ends at the next block's tag.
    ``no_end`` remembers what the rest of the page lacks."""
    for what, pattern in ((name, _RAW_END[name]), ("", _BLOCK_TAG)):
        m = None if what in no_end else pattern.search(page, at)
        if m:
            return m.end() if what else m.start()
        no_end.add(what)
    return len(page)


def _weighed(lines: list[Line], parents: list[int]) -> list[Line]:
    """Lines under a weak mark become blank, unless most of the text around them is under it: of the
    article's if the mark is in one, else of the page's."""
    own = lambda x: 0 if x.kind else x.own
    total = {x: sum(own(line) for line in lines if line.inside or not x) for x in (True, False)}
    under, within = [0] * len(parents), [True] * len(parents)
    for line in lines:
        if line.group:
            under[line.group] += own(line)
            within[line.group] &= line.inside
    for g in range(len(parents) - 1, 0, -1):  # a mark's number is above that of the one around it
        under[parents[g]] += under[g]
        within[parents[g]] &= within[g]
    off = [False] * len(parents)
    for g in range(1, len(parents)):
        off[g] = off[parents[g]] or 2 * under[g] <= total[within[g]]
    return [Line("", 0, x.inside, 0) if x.group and off[x.group] else x for x in lines]


def regions_of(lines: list[Line]) -> list[tuple[int, int]]:
    """Start and end of the runs of lines between a surge and a dive point."""
    lengths = [x.weight for x in lines]
    n, upto = len(lines), [0.0]
    for x in lengths:
        upto.append(upto[-1] + x)
    filled = [0]
    for x in lengths:
        filled.append(filled[-1] + (x > 0))
    sums = [upto[min(n, i + WINDOW)] - upto[i] if filled[min(n, i + WINDOW)] > filled[i] else 0 for i in range(n)]
    found, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        j = min(n, j + WINDOW - 1) if j < n else n  # sums look ahead, so the last lines are in the window
        a, b = i, j
        while a < b and not lengths[a] and not (lines[a].inside and lines[a].text):
            a += 1
        while b > a and not lengths[b - 1]:
            b -= 1
        links = b
        while links < n and lines[links].inside and lines[links].text and not lengths[links]:
            links += 1
        if links - b < WINDOW:  # an article may end with a link, but not with a list of them
            b = links
        found.append((a, b, max(sums[i:j])))
        i = j
    own = lambda a, b, kind, inside: sum(x.own for x in lines[a:b] if x.kind == kind and x.inside in inside)
    plain = [r for r in found if own(*r[:2], PLAIN, (True, False))]
    article, all_ = own(0, n, PLAIN, (True,)), own(0, n, PLAIN, (True, False))
    in_article = [r for r in plain if own(*r[:2], PLAIN, (True,))]
    best = max((r[2] for r in in_article), default=0)
    whole = any(x.inside and x.text and not x.kind for x in lines)

    def surges(r: tuple[int, int, float]) -> bool:
        if r in in_article:
            return r[2] >= SURGE or r[2] == best
        return r[2] >= SURGE and (not whole or 2 * own(*r[:2], PLAIN, (False,)) > article)

    surged = [surges(r) for r in plain]
    # a long text of a header or the like stands for the page's only where it outweighs that
    kept = [r[:2] for r in found if r not in plain and r[2] >= SURGE and own(*r[:2], LESS, (True, False)) * 2 > LIGHT * all_]
    if not any(surged):
        if not plain:
            kept = kept or [r[:2] for r in found if r[2] >= SURGE and not whole]
            return kept or ([(0, n)] if any(x.text and not x.kind for x in lines) or not any(x.text for x in lines) else [])  # anchors alone
        surged = [r[2] == max(x[2] for x in plain) for r in plain]
    first, last = surged.index(True), len(surged) - 1 - surged[::-1].index(True)
    for k, (a, b, _) in enumerate(plain):
        prose = 2 * own(a, b, PLAIN, (True, False)) >= sum(len(x.text) for x in lines[a:b] if not x.kind)
        between = first < k < last
        beside = k in (first - 1, last + 1) and any(_SENTENCE.search(x.text) for x in lines[a:b] if not x.kind)
        if surged[k] or (not whole or plain[k] in in_article) and prose and (between or beside):
            kept.append((a, b))
    return sorted(kept)


def main_text(page: str) -> str:
    """The text between surge and dive points; of a region's lines, those that are marked least."""
    lines = _weighed(*lines_of(page))
    out = []
    for a, b in regions_of(lines):
        least = min((x.kind for x in lines[a:b] if x.text), default=PLAIN)
        out += [x.text for x in lines[a:b] if x.text and x.kind == least]
    return " ".join(out)


def extractor() -> Callable[[bytes | None], str]:
    return lambda page: main_text(page.decode("utf-8", "replace")) if page else ""


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` (with html) plus text (a column of this name is replaced).

    Defined cases: a null or empty page, or one without text, gives an empty string; markup that is
    not closed ends with the element around it, a script or another element of raw text at the next
    block; repeated rows give equal texts; pages are read whole however long, and in time linear in
    their length however malformed; an empty table gives an empty result.
    """
    return pages.withColumn("text", text_udf("string", extractor)("html"))
