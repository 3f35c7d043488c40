"""Main text of web pages by composite text density.

A page is read into a tree without building objects for its text: tags open and close nodes, with the ends that HTML
leaves out. Menus, notices, adverts, forms, comments and the like are left out by tag or name, and count for nothing. A
node's density is its characters per tag, lowered where its text is mostly links; its density sum adds those of its
children. The node of the largest sum, or the article or main element that holds it, is the main subtree. The smallest
density from there up to the body gives the threshold by which every other block under the body stays or goes; blocks
that are mostly links count for nothing above them and have next to no density, so menus without a name go as well.

Tags are found by one scan in linear time: a quote that nothing closes is a letter, and what the rest of a page lacks is
looked for once.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .texts import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template iframe svg audio video head title select textarea button datalist".split())
RAW = frozenset("script style noscript template iframe svg audio video title textarea select".split())
#: Elements that are no part of an article.
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag closes an open one of these first, unless one of the limits is nearer.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class, id or role that name what an article doesn't hold: one of them in a container's name, or all words of another element's.
NOISE = re.compile(
    r"(?<![^\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|comment-?list|respond|replies|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|promo|promotion|sponsor(?:ed)?|sidebar|side|widget|related|recommended|recommendations|share|sharing|social|menu|navbar|nav|navigation|pagination|pager|footer|masthead|login|signup|search|toolbar|skip|contentinfo|complementary|dialog)(?![^\s_-])"
    , re.I,
)
WORD = re.compile(r"[^\s_-]+")
CONTAINERS = frozenset("div section aside header footer nav ul ol dl table tbody tr td form fieldset center details".split())
MARK = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: What ends a tag, or begins a quoted value in it.
STOP = re.compile(r">|=\s*[\"']")
#: An attribute and its value; a quote that nothing closes is a letter.
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The base of the logarithm falls to 1 where a page has no links, and the density would have no bound.
BASE_LEAST = 2.0
#: A block is dense from the smallest density on the main path, from this part of it where that is the body's alone, or with the density of 100 characters in one tag.
LEAST_OF_PATH, DENSE = 0.25, 100 * math.log2(100)
SPACE = re.compile(r"\s+")


def only_noise(name: str) -> bool:
    return bool(name) and not WORD.search(NOISE.sub("", name))


class Page:
    """Nodes as parallel lists: tag, parent, and whether a node is left out for its name or kind."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out = ["#root"], [-1], [False]
        self.runs: list[tuple[int, str]] = []  # (node, text); node -1 - k for the break that node k makes
        self.open = Counter()  # open elements by tag, so that looking for one that is not open costs nothing
        stack = [0]
        at, end = 0, len(source)
        missing: set[str] = set()  # what does not occur in the rest of the source, looked for once

        def find(what: str, start: int) -> int:
            if what in missing:
                return -1
            found = source.find(what, start)
            if found < 0:
                missing.add(what)
            return found

        while at < end:
            m = MARK.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            name = m.group(5)
            if name is None:
                close, start = ("-->", m.start() + 2) if m.group(1) else ("]]>", at) if m.group(2) else (">", at)
                found = find(close, start)
                at = end if found < 0 else found + len(close)
                continue
            name, began = name.lower(), at
            while (stop := STOP.search(source, at)) is not None and stop.group() != ">":
                closed = find(source[stop.end() - 1], stop.end())
                at = stop.end() if closed < 0 else closed + 1  # a quote that nothing closes is a letter
            attributes = source[began : end if stop is None else stop.start()]
            at = end if stop is None else stop.end()
            if m.group(4):
                self._close(stack, name)
                continue
            self._open(stack, name, attributes)
            if name in VOID or attributes.endswith("/") and name in ("svg", "math"):
                self.open[self.tag[stack.pop()]] -= 1
            elif name in RAW and f"/{name}" not in missing:
                found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                if found is None:
                    missing.add(f"/{name}")
                if found is None and name in ("script", "style", "title", "textarea"):
                    at = end
                elif found is not None:
                    at = found.end()
                    self.open[self.tag[stack.pop()]] -= 1

    def _text(self, node: int, text: str) -> None:
        self.runs.append((node, text))

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        if name in CLOSES_P and self.open["p"]:
            for k in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[k]]
                if t == "p":
                    self._cut(stack, k)
                    break
                if t in BLOCK:
                    break
        if name in SIBLINGS:
            own, limits = SIBLINGS[name]
            for k in range(len(stack) - 1, 0, -1) if any(self.open[t] for t in own) else ():
                t = self.tag[stack[k]]
                if t in limits:
                    break
                if t in own:
                    self._cut(stack, k)
                    if name != "tr":
                        break
        if name == "body" and "head" in (tags := [self.tag[n] for n in stack]):
            self._cut(stack, tags.index("head"))
        k = len(self.tag)
        out = self.out[stack[-1]] or name in HIDDEN or name in ASIDE
        if not out and name == "header":
            out = not (self.open["article"] or self.open["main"])
        if not out and attributes and name not in ("body", "html", "main", "article"):
            held = {a.lower(): v.strip("\"'") for a, v in reversed(ATTRIBUTE.findall(attributes))}
            named = " ".join(held.get(a, "") for a in ("class", "id", "role")).strip()
            # in an article, and for what is no container, a name counts only if all of it is such words, and a label always so
            one_is_enough = name in CONTAINERS and not (self.open["article"] or self.open["main"])
            noise = NOISE.search(named) if one_is_enough else only_noise(named)
            off = "hidden" in held or held.get("aria-hidden", "").lower() == "true" or NO_DISPLAY.search(held.get("style", ""))
            out = bool(noise or only_noise(held.get("aria-label", "")) or off)
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.out.append(out)
        self.open[name] += 1
        stack.append(k)
        if name in BLOCK:
            self.runs.append((-1 - k, ""))

    def _close(self, stack: list[int], name: str) -> None:
        if not self.open[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                self._cut(stack, k)
                return
            if name not in BLOCK and self.tag[stack[k]] in BLOCK and name not in ("html", "body"):
                return

    def _cut(self, stack: list[int], k: int) -> None:
        for n in stack[k:]:
            self.open[self.tag[n]] -= 1
            if self.tag[n] in BLOCK:
                self.runs.append((-1 - n, ""))
        del stack[k:]


def densities(page: Page, holds_block: list[bool]) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite text density of each node and the sum over its children; characters, and those in links.

    A block that is mostly links has its own density, but counts for nothing in the nodes above it, so a long menu
    does not thin out the page that holds it.
    """
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = page.tag[k] == "a" or in_link[page.parent[k]]
    for node, text in page.runs:
        if node >= 0 and not page.out[node]:
            size = len(SPACE.sub(" ", text).strip())
            chars[node] += size
            if in_link[node]:
                link_chars[node] += size
    for k in range(n - 1, 0, -1):
        if page.out[k] or 2 * link_chars[k] > chars[k] and (page.tag[k] in BLOCK or holds_block[k]):
            continue
        up = page.parent[k]
        chars[up] += chars[k]
        link_chars[up] += link_chars[k]
        tags[up] += tags[k] + 1
        link_tags[up] += link_tags[k] + (page.tag[k] == "a")
    whole, whole_links = max(1, chars[0]), link_chars[0]
    out = [0.0] * n
    for k in range(n):
        c, t, lc, lt = chars[k], max(1, tags[k]), link_chars[k], max(1, link_tags[k])
        if c and not page.out[k]:
            plain = max(1, c - lc)
            base = math.log(c / plain * lc + whole_links / whole * c + math.e)
            inner = c / max(1, lc) * t / lt
            # characters per tag, by the logarithm of what is not links to a base that rises with the links, and by their part
            out[k] = c / t * math.log(inner + 1, max(base, BASE_LEAST)) * (c - lc) / c
    sums = [0.0] * n
    for k in range(1, n):
        sums[page.parent[k]] += out[k]
    return out, sums, chars, link_chars


def main_nodes(page: Page, live: list[int], body: int) -> list[bool]:
    """Which nodes' own text is main text."""
    n, parent = len(page.tag), page.parent
    under, holds_block = [False] * n, [False] * n
    for k in live:
        under[k] = k == body or k > body and under[parent[k]]
    for k in reversed(live):
        if k and (page.tag[k] in BLOCK or holds_block[k]):
            holds_block[parent[k]] = True
    density, sums, chars, link_chars = densities(page, holds_block)
    # among equal sums the deeper node, so that a wrapper of one child does not stand for it
    best = max((k for k in live if under[k]), key=lambda k: (sums[k], k if sums[k] else -k))
    k = best
    while k != body:
        if page.tag[k] in ("article", "main"):
            best = k
            break
        k = parent[k]
    path, k = {body}, best
    while k != body:
        path.add(k)
        k = parent[k]
    # the body's own children are judged more mildly than what stands beside a main subtree
    least = min((LEAST_OF_PATH if best == body else 1.0) * min(density[k] for k in path), DENSE)
    # text of a node outside its blocks
    own, home = [0] * n, [0] * n
    for k in live:
        if under[k]:
            home[k] = k if k == body or page.tag[k] in BLOCK or holds_block[k] else home[parent[k]]
    for node, text in page.runs:
        if node >= 0 and under[node]:
            own[home[node]] += len(SPACE.sub(" ", text).strip())
    kept, whole = [False] * n, [False] * n
    sides: dict[int, list[int]] = {}
    for k in live:
        if not under[k]:
            continue
        up = parent[k]
        if k == best and k != body or k != body and whole[up]:
            kept[k] = whole[k] = True
        elif k == body or k in path or page.tag[k] in BLOCK or holds_block[k]:
            whole[k] = k not in path and density[k] >= least
            kept[k] = whole[k] or k == best or 2 * link_chars[k] <= chars[k] and own[k] * math.log2(own[k] + 1) >= least
            if k != body:
                sides.setdefault(up, []).append(k)
        else:
            kept[k] = kept[up]
    # short blocks between kept ones belong to them, and so do headings right before one, unless they are mostly links
    fill = [False] * n
    for row in sides.values():
        main = [whole[k] or k in path for k in row]
        if any(main):
            first, last = main.index(True), len(main) - 1 - main[::-1].index(True)
            for i, k in enumerate(row):
                joined = first < i < last or page.tag[k] in HEADINGS and i < last and main[i + 1]
                fill[k] = joined and not main[i] and 2 * link_chars[k] <= chars[k]
    for k in live:
        if under[k] and k != body and (fill[k] or fill[parent[k]]):
            fill[k] = kept[k] = True
    return kept


def main_text(source: str | None) -> str:
    """Text of the main blocks in page order, joined by one space. Empty if there is none."""
    if not source or not source.strip():
        return ""
    page = Page(source)
    n = len(page.tag)
    live = [k for k in range(n) if not page.out[k]]
    body = max((k for k in live if page.tag[k] == "body"), default=0)
    kept = main_nodes(page, live, body)
    blocks, held = [], []

    def flush():
        # runs of one block are joined as they stand, so words that tags part inside stay whole
        text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            blocks.append(text)

    for node, text in page.runs:
        if node < 0:
            flush()
        elif kept[node]:
            held.append(text)
    flush()
    return " ".join(blocks)


def extract_main_text(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row of `pages` (html): `columns`, text, n_chars (code points of text).

    Null and blank pages have an empty text. Pages are read alone, so repeated rows have equal results and nulls in
    other columns stay. Columns not named are ignored.
    """

    def read(sources):
        return ((t, len(t)) for t in map(main_text, sources))

    return map_texts(pages, [*columns], pages["html"], lambda: read, "text string, n_chars long")
