"""Main text of web pages by composite text density.

A page becomes a tree of elements. Each node gets its characters per tag, adjusted by links: with C characters and T tags
below it, of which LC and LT are of links, and LCb and Cb of the body,

    density = C / T * log(C * T / (LC * LT)) to the base of ln(C * LC / (C - LC) + C * LCb / Cb + e)

where a count of none is taken as one, and the base is e at least. A node's density sum is the sum of its children's densities; the
node with the largest is the article's trunk. The least density on the way from it to the body is the threshold: other branches
as dense, and with a quarter of the trunk's sum at least, are parts of the article too. An article element around the trunk, or the
main one inside it, settles the branch's edge, as does a heading just before it.

What is no text of the article goes before anything is counted: menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments, by element, by role, or by words of class and id; inside the article also lists whose text is all
links. Nothing else is dropped or capped. Trees are built in one pass over the text, and no step's work exceeds the page's size times a small
factor, however broken the markup.

Defined results: a null or empty page has an empty text; unclosed elements end where their parent does; an unclosed tag,
comment or script takes the rest of the page, as in browsers; a line break element is white space; rows are independent, so repeated
rows, null ids and urls and other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspark.llm import common

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*)|'([^']*)|([^\s"'>]+))""", re.I)
#: The class or id of what readers wrote.
COMMENT = re.compile(r"(?:^|\s)(?:(?:reader|user)[-_]?)?(?:comment|reply|replie)s?(?:[-_]?(?:body|list|item|content|text|area|section|wrapper))?(?:\s|$)", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: A start tag of the key ends an open element of the value, if no block stands between them but those named after it.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody"), "body": ("head",),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS = frozenset("ul ol dl menu table div section".split())

#: Never text of the article.
DROPPED = RAW | frozenset("head nav footer aside header form menu button select dialog template object svg canvas math audio video applet".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of a class or an id, at its start or end, that mark such parts.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget widgets related
    footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login
    comment comments commentlist disqus respond replies share sharing social""".split()
)
#: A header of the page, not of the article, by its whole class or id.
PAGE_HEADERS = frozenset("header siteheader pageheader mainheader globalheader topbar".split())
#: After such a word a mark tells what a container lacks or has beside its text.
NEGATING = frozenset("no without has with hide non".split())
#: The article itself, by element or role.
LANDMARKS = frozenset(("article", "main"))
#: Least share of the trunk's density sum of another part of the article.
SHARE = 0.25


def marked(value: str) -> bool:
    """Whether a class or an id names a part that is none of the article's."""
    for token in value.split():
        words = [w.lower() for w in WORD.findall(token)]
        if words and words[0] not in NEGATING and (words[0] in MARKS or words[-1] in MARKS or "".join(words) in PAGE_HEADERS):
            return True
    return False


class Page:
    """Elements in page order, with what each holds: texts, and numbers of elements."""

    def __init__(self, text: str):
        self.name, self.up, self.items, self.dead, self.landmark = ["body"], [-1], [[]], [0], [False]
        stack, opened = [0], Counter()
        at = 0

        def close(to: int) -> None:
            while len(stack) > to:
                opened[self.name[stack.pop()]] -= 1

        while at < len(text):
            found = TOKEN.search(text, at)
            stop = found.start() if found else len(text)
            if stop > at:
                self.items[stack[-1]].append(text[at:stop])
            if not found:
                break
            at = found.end()
            name = (found["name"] or "").lower()
            if not name or name in ("html", "body") and not found["end"]:
                # another body ends an unclosed head
                if name == "body" and opened["head"]:
                    close(next(i for i, n in enumerate(stack) if self.name[n] == "head"))
                continue
            if found["end"]:
                if opened[name]:
                    place = len(stack) - 1
                    # an inline end tag does not end a block around it
                    while self.name[stack[place]] != name and (name in BLOCKS or self.name[stack[place]] not in BLOCKS):
                        place -= 1
                    if self.name[stack[place]] == name:
                        close(place)
                continue
            if name in BLOCKS:
                for ended in (("p",) if name not in CLOSES else ("p", *CLOSES[name])):
                    place = len(stack) - 1
                    while opened[ended] and place and self.name[stack[place]] != ended and self.name[stack[place]] not in BLOCKS:
                        place -= 1
                    if opened[ended] and self.name[stack[place]] == ended:
                        close(place)
            number = len(self.name)
            self.items[stack[-1]].append(number)
            self.name.append(name)
            self.up.append(stack[-1])
            self.items.append([])
            self._classify(name, found["attrs"])
            if name in VOID or found["attrs"].endswith("/") and name not in BLOCKS and name not in RAW:
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(text, at)
                at = end.start() if end else len(text)
            stack.append(number)
            opened[name] += 1

    def _classify(self, name: str, attrs: str) -> None:
        """dead: 1 if dropped for its element, 2 for its role or names; landmark: the article by element or role."""
        dead, landmark = int(name in DROPPED), name in LANDMARKS
        if attrs and not dead:
            for key, *values in ATTRIBUTE.findall(attrs):
                value = next(filter(None, values), "")
                if key.lower() == "role":
                    landmark |= value.lower() in LANDMARKS
                    dead = 0 if landmark else dead or 2 * (value.lower() in ROLES)
                elif COMMENT.search(value):
                    landmark, dead = False, 1
                elif not dead and not landmark and marked(value):
                    dead = 2
        self.dead.append(dead)
        self.landmark.append(landmark)

    def measure(self) -> None:
        """Characters, tags, and those of links below each node; what is dropped counts nothing."""
        n, up = len(self.name), self.up
        self._rescue()
        for i in range(1, n):
            self.dead[i] = int(bool(self.dead[i] or self.dead[up[i]]))
        chars, tags, link_chars, links = ([0] * n for _ in range(4))
        for i in range(n - 1, -1, -1):
            if self.dead[i]:
                continue
            for x in self.items[i]:
                if x.__class__ is str:
                    chars[i] += sum(map(len, x.split()))
            link = self.name[i] == "a"
            if link:
                link_chars[i] = chars[i]
            if i:
                at = up[i]
                chars[at] += chars[i]
                tags[at] += tags[i] + 1
                link_chars[at] += link_chars[i]
                links[at] += links[i] + link
        self.chars, self.links, self.link_chars = chars, links, link_chars
        body = link_chars[0] / max(chars[0], 1)
        self.density, self.total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if c := chars[i]:
                t, lc = tags[i] or 1, link_chars[i]
                base = math.log(c * lc / max(c - lc, 1) + c * body + math.e)
                adjusted = math.log(max(c * t / ((lc or 1) * (links[i] or 1)), 1)) / math.log(max(base, math.e))
                self.density[i] = c / t * adjusted
                self.total[up[i] if i else 0] += self.density[i] if i else 0

    def _rescue(self) -> None:
        """A wrapper named for what it has beside the article, or a form around the whole page, is not dropped."""
        n, up = len(self.name), self.up
        below = [False] * n  # something dropped
        for i in range(1, n):
            below[i] = bool(self.dead[i]) or below[up[i]]
        landmarks = [i for i in range(n) if self.landmark[i]]
        if landmarks:
            if all(below[i] for i in landmarks):
                for i in landmarks:
                    while i and self.dead[i] != 1 or self.name[i] == "form":
                        self.dead[i] = 0
                        i = up[i]
            return
        if any(self.name[i] == "form" for i in range(n)):
            size = [0 if self.dead[i] and self.name[i] != "form" else sum(len(x) for x in self.items[i] if isinstance(x, str)) for i in range(n)]
            for i in range(n - 1, 0, -1):
                if not self.dead[i] or self.name[i] == "form":
                    size[up[i]] += size[i]
            for i in range(n):
                if self.name[i] == "form" and 2 * size[i] > size[0]:
                    self.dead[i] = 0

    def way(self, i: int) -> list[int]:
        out = [i]
        while out[-1]:
            out.append(self.up[out[-1]])
        return out

    def article(self) -> list[int]:
        """The nodes whose texts are the article."""
        self.measure()
        live = [i for i in range(len(self.name)) if self.chars[i]]
        if not live:
            return []
        # a text node alone is a child too: a node without elements has its own density as its sum
        total = [self.total[i] or self.density[i] for i in range(len(self.name))]
        trunk = max(live, key=lambda i: (total[i], -i))
        way = self.way(trunk)
        around = [i for i in way if self.landmark[i]]
        if around:
            return [around[0]]
        inside = self._below(trunk, lambda i: self.landmark[i])
        if inside:
            return [max(inside, key=lambda i: (total[i], -i))]
        threshold = min(self.density[i] for i in way)
        roots = {trunk}
        for i in way[1:]:
            before = None
            for x in self.items[i]:
                if isinstance(x, int) and self.chars[x]:
                    if x in way:
                        if before is not None and self.name[before] in HEADINGS:
                            roots.add(before)
                    elif self.density[x] >= threshold:
                        best = max(self._below(x, lambda i: True), key=lambda i: (total[i], -i))
                        if total[best] >= SHARE * total[trunk]:
                            roots.add(best)
                    before = x
        return sorted(roots)

    def _below(self, top: int, test) -> list[int]:
        """Live nodes of a subtree, itself included, that pass."""
        out, todo = [], [top]
        while todo:
            i = todo.pop()
            if self.chars[i]:
                if test(i):
                    out.append(i)
                todo += [x for x in self.items[i] if isinstance(x, int)]
        return out

    def blocks(self, roots: list[int]) -> list[str]:
        """Texts of the blocks below ``roots``, in page order."""
        out: list[str] = []
        now: list[str] = []

        def flush() -> None:
            text = " ".join("".join(now).split())
            if text:
                out.append(text)
            now.clear()

        for root in roots:
            # a negative number ends that block
            todo: list = [root]
            while todo:
                x = todo.pop()
                if isinstance(x, str):
                    now.append(html.unescape(x) if "&" in x else x)
                elif x < 0:
                    flush()
                elif self.name[x] == "br":
                    now.append(" ")
                elif not self.dead[x] and not (x != root and self.name[x] in LISTS and self.links[x] > 1 and self.link_chars[x] == self.chars[x]):
                    block = self.name[x] in BLOCKS
                    if block:
                        flush()
                        todo.append(-1)
                    todo += reversed(self.items[x])
            flush()
        return out


def main_text(page: str | None) -> str:
    tree = Page(page or "")
    return "\n\n".join(tree.blocks(tree.article()))


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars, its code points; columns of these names are replaced."""

    def made(get) -> list[pa.Array]:
        texts = [main_text(x) for x in get(column).to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return common.carried(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], made, 128)


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
