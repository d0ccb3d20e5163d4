"""Main text of web pages by consensus host paths.

Every page scores its containers by the running text in them (links count
against it, commas and paragraphs for it), climbs from the best one to its
outermost article or main (without one, past parents with running text of their
own) and votes for the generalised path found: tags with their classes, digits
as ``#``, named by a digest of its steps. Spark counts the votes of each host; paths with at least ``SHARE`` of a host's votes win. Each page is
then extracted again from the first of its host's winning paths, by votes, that
it has; a page that has none uses its own best container.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments are left out wherever they stand, by tag, role, class or
style; so are such elements inside a line. One rule holds in and out of
articles: a class or id counts if its first or last word can mean nothing else
(``comment-thread``, ``left-sidebar``), or if all of its words are such, doubtful
or plain ones (``share-tools``, but not ``related-work``); ``has-sidebar`` and
the like say something about a whole page. Articles inside articles can be
comments. Inside an article headings stay, ids of paragraphs are anchors, and
``header`` is the article's own. Inside a line all words have to fit. Blocks are
joined in page order by one space.

Null, empty and mark-up-only pages give an empty text. A page cut off in the
middle gives what it has; unclosed elements end with their parents, or where
HTML implies it (paragraphs, list items, table cells); end tags without a start
are ignored. Memory and time grow in proportion to a page, however deep. Null or
odd URLs share one host. Equal votes go to the first path in code-point order.
Repeated rows vote and are returned as often as they occur. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.llm.common import materialise

SHARE = 0.02
BROADCAST_HOSTS = 50_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "title", "object", "math", "canvas", "video", "audio")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINER = frozenset("html body div section article main td table tbody tr center ul ol dl blockquote figure details nav aside header footer form menu dialog fieldset button address head".split())
_DROPPED = frozenset("nav aside footer form menu dialog button head fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words that mean noise wherever a name begins or ends with them, and others that do so among their like only.
_STRONG = frozenset(
    "advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar widget"
    " gdpr popup modal overlay newsletter pagination pager toolbar comment comments commentlist respond disqus".split()
)
_LAST = _STRONG | {"ad", "ads"}
_NOISE = _LAST | frozenset("banner header aside rail notice notices alert cookie cookies consent subscribe signup login share sharing social related recommended reply replies form search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that say nothing of their own beside a noise word.
_PLAIN = frozenset(
    "area articles bar block bottom box buttons container content global icon icons inline inner label leaderboard left links list main media message module outer placement posts right section site slot stories thread tools top unit wrap wrapper zone".split()
)
#: Beginnings of names that tell what a page has.
_TELLING = frozenset("has have is no not with without".split())
_HIDDEN = frozenset("hidden invisible d-none sr-only visually-hidden screen-reader-text".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Where a start tag ends an open element of these names, and the elements that this does not reach beyond.
_ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot", "table"), "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table"), "option": ("option", "select"),
}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_P, _NONE = frozenset(("p",)), frozenset()
_WORDS = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"\d+")


def _noisy(marks: list[str], whole: bool, inside: bool = True) -> bool:
    """Whether a class or id says menu, advert and the like; ``whole``: by all of its words only."""
    for mark in marks:
        words = [w for w in _WORDS.split(mark) if len(w) > 1]
        if not words or words[0] in _TELLING:
            continue
        if not whole and (words[0] in _STRONG or words[-1] in _LAST):
            return True
        noise = _NOISE.intersection(words)
        if inside and noise == {"header"} and "site" not in words:
            continue
        if noise and _NOISE.union(_PLAIN).issuperset(words):
            return True
    return False


class Page:
    """Containers (key of the path, tag, parent) and text blocks (container, text, linked characters) of a page."""

    def __init__(self, source: str | None):
        self.keys: list[str] = [""]
        self.tags: list[str] = [""]
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, container, dropped, in an article
        self._opened: Counter[str] = Counter()
        self._text: list[str] = []
        self._linked, self._in_link = 0, False
        self._read(source or "")

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            tag = source.find("<", at)
            if tag < 0:
                self._add(source[at:])
                break
            if tag > at:
                self._add(source[at:tag])
            m = _TOKEN.match(source, tag)
            if m is None:  # a lone bracket is text
                self._add("<")
                at = tag + 1
                continue
            at = m.end()
            if m[2]:
                name = m[2].lower()
                if m[1]:
                    self._close(name)
                elif name in _RAW:
                    end = _RAW[name].search(source, at)
                    at = end.end() if end else n
                else:
                    self._open(name, m[3])
        self._flush()

    def _add(self, text: str) -> None:
        if not self._stack[-1][2]:
            self._text.append(text)
            if self._in_link:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            words = entities.unescape("".join(self._text)).split()
            if words:
                self.blocks.append((self._stack[-1][1], " ".join(words), self._linked))
            self._text, self._linked = [], 0

    def _push(self, name: str, container: int, dropped: bool, inside: bool) -> None:
        self._stack.append((name, container, dropped, inside))
        self._opened[name] += 1

    def _end(self, names: frozenset[str], beyond: frozenset[str]) -> None:
        """Ends the innermost open element of these names, unless one of ``beyond`` lies inside it."""
        if not any(self._opened[n] for n in names):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in names:
                for tag, *_ in self._stack[i:]:
                    self._opened[tag] -= 1
                del self._stack[i:]
                return
            if self._stack[i][0] in beyond:
                return

    def _open(self, name: str, rest: str) -> None:
        inline = name in _INLINE
        if inline:
            if name == "a":
                self._in_link = True
            if not rest.strip(" /") and not self._opened[name]:
                return
        else:
            self._flush()
            self._in_link = False
            self._end(_P, _CONTAINER)
            if name in _ENDS:
                self._end(*_ENDS[name])
        if name in _VOID:
            return
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if rest else {}
        _, above, dropped, inside = self._stack[-1]
        classes = found.get("class", "").lower().split()
        # ids of paragraphs and headings are where links lead to
        marks = classes if name == "p" or name in _HEADINGS else [*classes, found.get("id", "").lower()]
        unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or not _HIDDEN.isdisjoint(classes) or bool(_UNSEEN.search(found.get("style", "")))
        noise = unseen or found.get("role", "").lower() in _ROLES
        if inline:
            noise = noise or _noisy(marks, True)
            if noise or self._opened[name]:  # others of its name inside it have end tags too
                self._push(name, above, dropped or noise, inside)
            return
        whole_page = name in ("html", "body") or name in ("main", "article") and not inside
        noise = noise or name in _DROPPED or not whole_page and not (inside and name in _HEADINGS) and _noisy(marks, False, inside)
        inside = inside or name in ("article", "main")
        noise = noise or name == "header" and not inside
        if name in _CONTAINER or any(k in found for k in ("class", "id", "role")):
            step = ".".join([name, *sorted({_DIGITS.sub("#", c) for c in classes})])
            self.keys.append(hashlib.blake2b(f"{self.keys[above]}>{step}".encode("utf-8", "replace"), digest_size=12).hexdigest())
            self.tags.append(name)
            self.parents.append(above)
            above = len(self.keys) - 1
        self._push(name, above, dropped or noise, inside)

    def _close(self, name: str) -> None:
        if name in _INLINE:
            if name == "a":
                self._in_link = False
            if self._opened[name]:
                self._end(frozenset((name,)), _CONTAINER)
            return
        self._flush()
        self._in_link = False
        # paragraphs, items and the like end inside their container; a container ends whatever is open in it
        self._end(frozenset((name,)), _NONE if name in _CONTAINER else _ENDS[name][1] if name in _ENDS else _CONTAINER)

    def best(self) -> str | None:
        """Key of the path that holds the container with the most running text of its own; a parent gets half of its children's."""
        scores = [0.0] * len(self.keys)
        for at, text, linked in self.blocks:
            worth = max(0, len(text) - 2 * linked) + 25 * text.count(",") + 10
            share = 1.0
            while at > 0 and share > 0.2:
                scores[at] += worth * share
                at, share = self.parents[at], share / 2
        for i, tag in enumerate(self.tags):
            scores[i] *= 1.5 if tag in ("article", "main") else 1.0
        top = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return self.keys[self._climb(top)] if scores[top] > 0 else None

    def _climb(self, at: int) -> int:
        """The outermost article or main around a container, else the last parent in a row with running text of its own."""
        above, up = [], at
        while up > 0:
            if self.tags[up] in ("article", "main"):
                above.append(up)
            up = self.parents[up]
        if above:
            return above[-1]
        own = set()
        for block, text, linked in self.blocks:
            if len(text) > 2 * linked:
                own.add(self._outer(block))
        at = self._outer(at)
        while self.parents[at] > 0 and self.tags[self.parents[at]] not in ("html", "body") and self._outer(self.parents[at]) in own:
            at = self._outer(self.parents[at])
        return at

    def _outer(self, at: int) -> int:
        """The container around a paragraph or heading with a class."""
        while self.parents[at] > 0 and self.tags[at] not in _CONTAINER:
            at = self.parents[at]
        return at

    def text(self, key: str) -> str:
        """Text below all containers of this path."""
        inside = [False] * len(self.keys)
        for i in range(1, len(self.keys)):
            inside[i] = self.keys[i] == key or inside[self.parents[i]]
        return " ".join(t for at, t, _ in self.blocks if inside[at])


def vote(source: str | None) -> str | None:
    return Page(source).best()


def extract(source: str | None, winning: list[str]) -> str:
    """Text from the first winning path that the page has text in, else from its own best container."""
    page = Page(source)
    there = set(page.keys)
    for path in winning:
        if path in there and (text := page.text(path)):
            return text
    own = page.best()
    return page.text(own) if own else " ".join(t for _, t, _ in page.blocks)


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, paths): each host's paths with at least SHARE of its votes, by votes."""

    @F.pandas_udf("string")
    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([vote(s) for s in sources], dtype=object)

    votes = pages.select(host(F.col(url_col)).alias("host"), voted(F.col(html_col).cast("string")).alias("path"))
    votes = votes.where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    votes = votes.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("host"))).where(F.col("share") >= SHARE)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return votes.groupBy("host").agg(ranked.alias("ranked")).select("host", F.col("ranked.path").alias("paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page id, url, text, n_chars) of every page."""
    hosts = materialise(winning_paths(pages, url_col, html_col), "host-paths").withColumnRenamed("host", "of")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, paths in batches:
            yield pd.Series([extract(s, list(p) if p is not None else []) for s, p in zip(sources, paths)], dtype=object)

    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("source"))
    met = rows.join(hosts, host(F.col(url_col)) == F.col("of"), "left")
    out = met.select(id_col, url_col, extracted("source", "paths").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
