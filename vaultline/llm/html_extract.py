"""Main text of web pages by consensus host paths.

1. Each page is parsed once into text blocks and their containers. Sections
   (body, div, section, article, main, cells of a layout table) compete by the
   text they hold less its links; text of lists, data tables, quotes and
   figures counts fully for the section around them, and semantic article
   elements count the text of everything inside them. The page votes for its
   best section's generalised path (tags with class names, digits masked).
2. Spark adds up the votes per (host, path), a partial aggregate, and keeps
   the paths with ``min_share`` of their host's votes, or with ``min_votes``
   votes and ``low_share`` of them: at most 1 / ``low_share`` paths per host.
3. Pages meet their host's winning paths by an equi-join on the host (Spark
   broadcasts the stored winners only below its size threshold, and splits a
   hot host otherwise) and are extracted again from the elements on one of
   them: the one with the greatest product of votes and of the page's own
   score there. A page with none of them, or without a host, uses its own best
   container.

Class and id names that speak of text beside the article (``_BESIDE``) only
mark a block element. A marked element goes, unless it holds most of the page's
unlinked text and the page's main heading, or (if the word is only a part of a
name) hardly any text comes before it. Names such as ``no-sidebar`` or
``comments-open`` speak of the page's state and mark nothing.

Defined results: null html gives an empty text; null or hostless urls do not
vote. Unclosed elements end with the page, an unclosed tag is dropped. A
line-break element is white space. Repeated rows each return.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

MIN_SHARE = 0.1
MIN_VOTES, LOW_SHARE = 20, 0.001
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?[A-Za-z][^>]*>?", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "dt", "dd", "tr", "figcaption", "address", "summary", "caption"}
_CONTAINER = {"html", "body", "div", "article", "section", "main", "td", "th", "ul", "ol", "dl", "table", "tbody", "thead",
              "blockquote", "figure", "details", "center", "fieldset", "header", "footer", "nav", "aside", "form"}
_SECTION = {"#", "html", "body", "div", "article", "section", "main", "center"}
_INSET = {"ul", "ol", "dl", "blockquote", "figure", "details"}  # with all that is in them, text of the section around them
_CELL = {"td", "th"}
_BLOCK = _LEAF | _CONTAINER | {"hr"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}}
_DROPPED = {"head", "nav", "footer", "aside", "template", "svg", "math", "object", "canvas", "audio", "video",
            "button", "select", "dialog", "menu", "label"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar",
          "toolbar", "form"}
# words in class or id names that mark text beside the article
_BESIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "nav",
    "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "comment",
    "comments", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal",
    "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended",
    "widget", "pagination", "pager", "toolbar", "copyright", "form", "search", "skip", "tags",
}
# words before or after such a word that speak of the page's state
_STATE_BEFORE = {"no", "not", "non", "without", "has", "with", "is", "hide", "hidden", "disable", "enable"}
_STATE_AFTER = {"open", "opened", "closed", "enabled", "disabled", "on", "off", "result", "results", "left", "right"}
_ARTICLE = {"article": 1.2, "main": 1.0}


def beside(names: str) -> int:
    """Whether class or id names speak of text beside the article: 2 if a
    whole name does, 1 if a part of one does, else 0."""
    found = 0
    for name in names.split():
        words = [w.lower() for w in _NAME.findall(name)]
        hits = [k for k, w in enumerate(words) if w in _BESIDE]
        if any(w in _STATE_BEFORE for w in words[:-1]) or any(w in _STATE_AFTER for w in words[1:]):
            continue
        if hits:
            found = max(found, 2 if len(hits) == len(words) else 1)
    return found


class Page:
    """Blocks (container, text, link characters) and the element tree of one page."""

    def __init__(self, source: str):
        self.tag, self.label, self.parent, self.weight, self.depth = ["#"], ["#"], [-1], [0.0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.mark_of: list[int] = []  # of each block: the innermost marked element, or 0
        self.marks: list[list] = [[0, 0, False]]  # of each marked element: the one around it, beside(), an h1 inside
        self._parse(source)
        if len(self.marks) > 1:
            self._settle()

    def _settle(self) -> None:
        """Decide which marked elements go, outer ones first, and drop their blocks."""
        value = [len(t) - links for _, t, links in self.blocks]
        n = len(self.marks)

        def inside(gone: list[bool]) -> tuple[list[int], list[int], int]:
            """Unlinked text in each element and before it, and of the page."""
            held, before, total = [0] * n, [-1] * n, 0
            for v, m in zip(value, self.mark_of, strict=True):
                if not gone[m]:
                    k = m
                    while k and before[k] < 0:
                        before[k], k = total, self.marks[k][0]
                    held[m] += v
                    total += v
            for k in reversed(range(1, n)):
                held[self.marks[k][0]] += held[k]
            return held, before, total
        for k in reversed(range(1, n)):
            self.marks[self.marks[k][0]][2] |= self.marks[k][2]
        gone = [False] * n
        for k in range(1, n):
            gone[k] = gone[self.marks[k][0]] or self.marks[k][1] == 2 and not self.marks[k][2]
        held, before, total = inside(gone)
        for k in range(1, n):
            around, kind, h1 = self.marks[k]
            keeps = 2 * held[k] > total and (h1 or kind == 1 and 50 * before[k] <= held[k])
            gone[k] = gone[k] or gone[around] or not keeps
        self.blocks = [b for b, m in zip(self.blocks, self.mark_of, strict=True) if not gone[m]]

    def path(self, node: int) -> str:
        parts = []
        while node > 0:
            parts.append(self.label[node])
            node = self.parent[node]
        return ">".join(reversed(parts))

    def _parse(self, s: str) -> None:
        # the open elements: (tag, container, dropped, heading text only, innermost mark)
        stack: list[tuple[str, int, bool, bool, int]] = [("#", 0, False, False, 0)]
        count: Counter = Counter()
        text: list[str] = []
        links = owner = mark = 0

        def flush():
            nonlocal links
            if text:
                block = " ".join(html.unescape("".join(text)).split())
                if block:
                    self.blocks.append((owner, block, min(links, len(block))))
                    self.mark_of.append(mark)
                text.clear()
            links = 0

        def put(chunk: str):
            nonlocal links, owner, mark
            _, node, dropped, headings, inner = stack[-1]
            if dropped or not chunk or (headings and not any(count[h] for h in ("h1", "h2", "h3", "h4", "h5", "h6"))):
                return
            if not text:
                owner, mark = node, inner
            if count["h1"] and inner and not chunk.isspace():
                self.marks[inner][2] = True
            text.append(chunk)
            if count["a"]:
                links += len(chunk)

        def pop_to(tags: set[str], stop: set[str]):
            k = len(stack) - 1
            while k > 0 and stack[k][0] not in tags:
                if stack[k][0] in stop:
                    return
                k -= 1
            if k > 0:
                for t, *_ in stack[k:]:
                    count[t] -= 1
                del stack[k:]

        at, n = 0, len(s)
        while at < n:
            m = _TOKEN.search(s, at)
            if m is None:
                put(s[at:])
                break
            put(s[at:m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag in _BLOCK:
                    flush()
                if count[tag]:
                    pop_to({tag}, set() if tag in _BLOCK else _CONTAINER)
                continue
            if tag == "br":
                put(" ")
                continue
            if tag in _BLOCK:
                flush()
                if count["p"]:
                    pop_to({"p"}, _CONTAINER)
            if tag in _CLOSES:
                pop_to(_CLOSES[tag], _CONTAINER - _CLOSES[tag])
            if tag in _VOID:
                continue
            if tag in _RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(s, at)
                at = end.end() if end else n
                continue
            self._open(tag, m[3], stack, count)
        flush()

    def _open(self, tag, attributes, stack, count) -> None:
        _, up, dropped, headings, mark = stack[-1]
        kind = 2 if tag == "form" else 0
        classes, weight = "", _ARTICLE.get(tag, 0.0)
        if attributes and not dropped:
            a = {k.lower(): d or q or u for k, d, q, u in _ATTR.findall(attributes)}
            classes = " ".join(sorted(set(_DIGITS.sub("#", a.get("class", "").lower()).split())))
            if tag not in ("html", "body", "article", "main"):
                kind = max(kind, beside(a.get("class", "") + " " + a.get("id", "")))
            role = a.get("role", "").lower()
            if "main" == role or "articlebody" in a.get("itemprop", "").lower():
                weight = max(weight, 1.1)
            style = a.get("style", "").replace(" ", "").lower()
            dropped = bool(role in _ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style)
        if tag == "header":  # the page's header goes; of an article's, its headings stay
            inside = count["article"] > 0
            dropped, headings = dropped or not inside, inside
        dropped = dropped or tag in _DROPPED or kind > 0 and tag not in _BLOCK  # an inline element is not weighed
        if kind and not dropped:
            self.marks.append([mark, kind, False])
            mark = len(self.marks) - 1
        node = up
        if tag in _CONTAINER:
            node = len(self.label)
            self.tag.append(tag)
            self.label.append(f"{tag}.{classes.replace(' ', '.')}" if classes else tag)
            self.parent.append(up)
            self.weight.append(weight)
            self.depth.append(self.depth[up] + 1)
        count[tag] += 1
        stack.append((tag, node, dropped, headings, mark))

    def competing(self) -> list[bool]:
        """Which containers may be the main text. A cell is one of a layout
        table if it holds several blocks and the section around the table
        holds no text but in tables; other cells are text of that section."""
        n = len(self.tag)
        held, near, holds = [0] * n, [0] * n, [False] * n
        for k in range(1, n):  # parents come first
            near[k] = k if self.tag[k] in _CELL or self.tag[k] in _SECTION else near[self.parent[k]]
        for owner, _, _ in self.blocks:
            held[owner] += 1
            holds[near[owner]] = True
        for k in reversed(range(1, n)):
            held[self.parent[k]] += held[k]
        competes, inset, around = [False] * n, [False] * n, [0] * n
        competes[0] = True
        for k in range(1, n):  # parents come first
            up, tag = self.parent[k], self.tag[k]
            inset[k], around[k] = inset[up], around[up]
            if self.weight[k]:
                competes[k], inset[k] = True, False
            elif tag in _SECTION:
                competes[k] = not inset[k]
            elif tag in _CELL:
                competes[k] = not inset[k] and held[k] > 1 and not holds[around[k]]
                inset[k] = not competes[k]
            elif tag in _INSET:
                inset[k] = True
            if competes[k]:
                around[k] = k
        return competes

    def scores(self) -> list[float]:
        """A section's score: its own text, half and a quarter of the sections'
        just below it; semantic elements count everything inside them."""
        n, competes = len(self.label), self.competing()
        score, total, up = [0.0] * n, [0] * n, [0] * n
        for k in range(1, n):  # parents come first
            up[k] = k if competes[k] else up[self.parent[k]]
        for node, text, links in self.blocks:
            value, share, k = len(text) - links, 1.0, up[node]
            total[node] += value
            while share and k >= 0:
                if not self.weight[k]:
                    score[k] += value * share
                share = share / 2 if share > 0.3 else 0.0
                k = up[self.parent[k]] if k else -1
        for k in reversed(range(1, n)):
            total[self.parent[k]] += total[k]
            if self.weight[k]:
                score[k] = total[k] * self.weight[k]
        return score

    def best(self) -> int:
        """The best-scored section; of equals the outermost."""
        score = self.scores()
        return max(range(len(score)), key=lambda k: (score[k], -k))

    def on_path(self, path: str) -> set[int]:
        """The containers on a generalised path."""
        parts = path.split(">")
        return {k for k in range(1, len(self.label)) if self.depth[k] == len(parts) and self.label[k] == parts[-1] and self.path(k) == path}

    def text(self, roots: set[int]) -> str:
        """Blocks inside any of ``roots``, in page order."""
        inside = [False] * len(self.label)
        for k in range(len(self.label)):  # parents come first
            inside[k] = k in roots or (self.parent[k] >= 0 and inside[self.parent[k]])
        return "\n\n".join(t for node, t, _ in self.blocks if inside[node])


def vote(source: str) -> tuple[str, float] | None:
    """The page's generalised path and its weight, or None without text."""
    page = Page(source)
    return (page.path(page.best()), 1.0) if page.blocks else None


def extract(source: str, winners: list[tuple[str, float]] | None) -> str:
    """The main text, from the winning path (path, votes) that fits the page best."""
    page = Page(source)
    if not page.blocks:
        return ""
    score, best = page.scores(), (0.0, "")
    for path, votes in winners or ():
        roots = page.on_path(path)
        rank = votes * sum(score[k] for k in roots)
        if roots and (rank > best[0] or not best[1]) and (text := page.text(roots)):
            best = (rank, text)
    return best[1] or page.text({page.best()})


def host_of(url) -> F.Column:
    """Lower-case host of a url, null without one."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def winning_paths(pages: DataFrame, min_share: float = MIN_SHARE, min_votes: int = MIN_VOTES, low_share: float = LOW_SHARE) -> DataFrame:
    """(host, winners): paths with their votes, by falling votes."""
    def run(batch):
        got: Counter = Counter()
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = vote(source)
            if v:
                got[host, v[0]] += v[1]
        return {"host": [k[0] for k in got], "path": [k[1] for k in got], "votes": list(got.values())}
    src = pages.select(host_of(F.col("url")).alias("host"), "html").dropna()
    votes = map_arrow(src, run, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    won = votes.join(total, "host").where(
        (F.col("votes") >= min_share * F.col("total")) | (F.col("votes") >= F.greatest(F.lit(min_votes), low_share * F.col("total"))))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return won.groupBy("host").agg(F.transform(ranked, lambda x: F.struct(x["path"].alias("path"), (-x["v"]).alias("votes"))).alias("winners"))


def main_texts(pages: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars per page row."""
    pages = pages.select("page_id", "url", "html")
    winners = Scratch(pages.sparkSession, "html").save(winning_paths(pages, min_share), "winners")
    joined = pages.withColumn("__llm_host", host_of(F.col("url"))).join(
        winners.withColumnRenamed("host", "__llm_host"), "__llm_host", "left").select("page_id", "url", "html", "winners")

    def run(batch):
        text = [extract(s, [(x["path"], x["votes"]) for x in w or ()]) if s else "" for s, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": text, "n_chars": [len(t) for t in text]}
    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(joined, run, f"page_id {kind}, url string, text string, n_chars long")
