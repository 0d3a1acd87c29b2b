"""Main text of web pages by paths that the pages of a host agree on.

Every page scores its containers by how much running text they hold. The scores are votes for
generalised paths (tags with their classes, digits taken out), summed per host in Spark. Pages are
then read again with the paths their host prefers; a page that has none of them uses its own best one.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwright.llm.common import settle
from tillwright.llm.link_trust import host_of

#: Paths of a host that are tried on its pages, best first.
PATHS_PER_HOST = 8
#: Hosts whose paths are sent to all executors; beyond, pages are joined with them by host.
SENT_HOSTS = 20_000
#: What a container's text counts for those around it, each further out.
FURTHER = 0.75
#: What text in elements made for articles counts.
MARKED = {"article": 2.0, "main": 1.5}
#: Votes a task sums up before it passes them on.
HELD_VOTES = 50_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>?|[^<]++|<",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
HIDDEN = RAW | frozenset("nav header footer aside form head svg button select dialog menu object canvas map audio video datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An opening tag ends an open one of these, up to the tag that limits the search.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
CONTAINERS = frozenset("body article main section div td center blockquote".split())

#: Words of class names, ids and roles that mark what is not the article.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer bottombar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form comment "
    "comments commentlist disqus reply replies respond responses discussion share sharing social related recommended recommendations trending pagination pager toolbar widget widgets "
    "copyright legal disclaimer skip complementary contentinfo".split()
)
FIRST = ASIDE - {"header", "notice", "alert", "form", "legal", "search", "reply", "skip", "copyright", "notices"}
ARTICLE = frozenset("article articlebody content entry post story main text body page with has no".split())


def _is_aside(tag: str, names: list[str]) -> bool:
    if tag in HIDDEN:
        return True
    for name in names:
        parts = [p for p in re.split(r"[^a-z]+|(?<=[a-z])(?=[A-Z])", name) for p in [p.lower()] if p]
        if not parts or {"with", "has", "no"} & set(parts):
            continue
        if parts[-1] in ASIDE or (parts[0] in FIRST and not ARTICLE & set(parts)):
            return True
    return False


class Element:
    __slots__ = ("aside", "path", "tag", "text")

    def __init__(self, tag: str, path: str, aside: bool):
        self.tag, self.path, self.aside = tag, path, aside
        self.text = 0.0  # characters of running text without links, by how directly it is held


class Page:
    """The blocks of a page with the containers around each, and the text each container holds."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, tuple[Element, ...], bool]] = []
        self._stack: list[Element] = [Element("", "", False)]
        self._chunks: list[str] = []
        self._link_chars = self._links = 0
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        skip_to = None
        for found in TOKEN.finditer(source):
            whole = found.group()
            close, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], "")
            if skip_to:
                if not (tag and close and tag.lower() == skip_to):
                    continue
                skip_to = None
                continue
            if tag:
                tag = tag.lower()
                if close:
                    self._close(tag)
                elif tag in RAW:
                    skip_to = self._raw_end(tag, source, found.end())
                else:
                    self._open(tag, attributes, whole.endswith("/>"))
            elif whole.startswith("<![CDATA["):
                self._chunks.append(whole[9:].removesuffix("]]>"))
            elif not whole.startswith(("<!", "<?")):
                self._chunks.append(html.unescape(whole))
                if self._links:
                    self._link_chars += len(whole.strip())

    @staticmethod
    def _raw_end(tag: str, source: str, at: int) -> str | None:
        """The tag to skip to; nothing is skipped if it never closes, so that no text is lost."""
        return tag if re.compile(rf"</{tag}", re.I).search(source, at) else None

    def _flush(self) -> None:
        text = " ".join("".join(self._chunks).split())
        if text:
            around = tuple(self._stack)
            aside = any(e.aside for e in around)
            self.blocks.append((text, around, aside))
            if not aside:
                weight = max(len(text) - self._link_chars, 0)
                for element in reversed(around):
                    element.text += weight
                    if element.tag in CONTAINERS:
                        weight *= FURTHER
        self._chunks, self._link_chars = [], 0

    def _open(self, tag: str, attributes: str, closed: bool) -> None:
        if tag in INLINE:
            if tag == "br":
                self._chunks.append(" ")
            elif tag == "a":
                self._links += 1
            return
        self._flush()
        self._links = 0
        if tag in CLOSES_P:
            self._end({"p"}, CONTAINERS)
        if tag in SIBLINGS:
            self._end(*SIBLINGS[tag])
        if tag in VOID or closed and tag not in CONTAINERS:
            return
        classes, names = [], []
        for m in ATTRIBUTE.finditer(attributes):
            value = next((g for g in (m[2], m[3], m[4], m[6], m[7], m[8]) if g is not None), "")
            names += value.split()
            if m[1] and m[1].lower() == "class":
                classes += value.split()
        label = ".".join([tag, *sorted({re.sub(r"\d+", "", c.lower()) for c in classes})])
        above, kept = self._stack[-1], tag in ("html", "body", "main", "article")
        aside = _is_comment(names) if kept else _is_aside(tag, names) or _is_comment(names)
        self._stack.append(Element(tag, f"{above.path}/{label}", aside))

    def _end(self, tags: set[str], within: set[str] | frozenset[str]) -> None:
        """Close the nearest of some tags, unless an element that limits the search comes first."""
        for at in range(len(self._stack) - 1, 0, -1):
            if self._stack[at].tag in tags:
                del self._stack[at:]
                return
            if self._stack[at].tag in within or self._stack[at].tag in CONTAINERS:
                return

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a" and self._links:
                self._links -= 1
            return
        self._flush()
        self._links = 0
        for at in range(len(self._stack) - 1, 0, -1):
            if self._stack[at].tag == tag:
                del self._stack[at:]
                return

    def containers(self) -> list[Element]:
        seen = {id(e): e for _, around, aside in self.blocks if not aside for e in around[1:] if e.tag in CONTAINERS}
        return list(seen.values())

    def scores(self) -> dict[str, float]:
        """Votes of the page: per path, the share of its running text, more for what is marked as an article."""
        page = max(self._page_text(), 1)
        votes: dict[str, float] = defaultdict(float)
        for e in self.containers():
            named = set(re.split(r"[^a-z]+", e.path.rsplit("/", 1)[-1])[1:]) & ARTICLE
            votes[e.path] += e.text / page * (MARKED.get(e.tag) or (1.3 if named else 1.0))
        return dict(votes)

    def _page_text(self) -> int:
        return sum(len(text) for text, _, aside in self.blocks if not aside)

    def extract(self, paths: list[str]) -> str:
        """Text of the first path that the page has text under; else of its own best container."""
        for path in paths:
            text = self._under(path)
            if text:
                return text
        scores = self.scores()
        best = max(scores, key=lambda p: (scores[p], p), default=None)
        return self._under(best) if best else " ".join(t for t, _, aside in self.blocks if not aside)

    def _under(self, path: str) -> str:
        return " ".join(t for t, around, aside in self.blocks if not aside and any(e.path == path for e in around))


def _is_comment(names: list[str]) -> bool:
    return any({"comment", "comments", "commentlist", "replies", "disqus"} & set(re.split(r"[^a-z]+", n.lower())) for n in names)


def path_votes(pages: DataFrame) -> DataFrame:
    """Sums of the pages' scores: columns host, path, score."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], float] = defaultdict(float)

        def passed_on() -> pd.DataFrame:
            rows = [(h, p, s) for (h, p), s in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["host", "path", "score"]).astype({"score": float})

        for batch in batches:
            for host, source in zip(batch["host"], batch["html"], strict=True):
                for path, score in Page(source).scores().items():
                    held[host, path] += score
                if len(held) >= HELD_VOTES:
                    yield passed_on()
        yield passed_on()

    rows = _sources(pages).select("host", "html").where("html != ''")
    votes = rows.mapInPandas(vote, "host string, path string, score double")
    return votes.groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("score"))


def host_paths(votes: DataFrame) -> DataFrame:
    """The paths each host prefers, best first and deeper ones first among equals: columns host, paths."""
    best = Window.partitionBy("host").orderBy(F.desc("score"), F.desc(F.length("path")), "path")
    ranked = votes.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PATHS_PER_HOST)
    in_order = F.array_sort(F.collect_list(F.struct("rank", "path")))
    return ranked.groupBy("host").agg(F.transform(in_order, lambda x: x["path"]).alias("paths"))


def _sources(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id"), F.col("url"), host_of(F.col("url").cast("string")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars; null or empty html gives an empty text.

    Pages without a host vote together. Rows repeat where pages do and vote each time.
    """
    paths = settle(host_paths(path_votes(pages)))
    few = paths.limit(SENT_HOSTS + 1).count() <= SENT_HOSTS
    rows = _sources(pages).join(F.broadcast(paths) if few else paths, "host", "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Page(source).extract([] if paths is None else list(paths)) for source, paths in zip(batch["html"], batch["paths"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": found})

    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "paths")
    texts = rows.mapInPandas(read, "page_id string, url string, text string")
    return texts.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
