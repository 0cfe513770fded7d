"""Main text of web pages by consensus of a host's pages.

Each page's containers are scored by the running text in them; pages of one host vote on the
generalised tag-and-class path of the best container, in Spark; the text is then extracted again below
the path that won. A page without that path falls back on its own best container.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.scratch import materialize

#: Elements that do not break a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold one block of text each.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address summary".split())
#: Elements that are never part of an article.
CLUTTER_TAGS = frozenset("head nav header footer aside form menu noscript button select dialog template svg object".split())
#: Words of class, id and role attributes that mark clutter.
CLUTTER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus "
    "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)

#: Elements whose content is text without tags, none of it shown.
RAW = frozenset("script style textarea iframe noframes title xmp".split())
#: Elements that class words mark as clutter only where they say that readers wrote them: a page's text may be all in one of these.
MAIN, READERS = frozenset("article main body html".split()), frozenset("comment comments disqus".split())
TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/<>]*)")
STOP = re.compile(r"""[>"']""")
#: Open elements from which on paths grow no longer: text of deeper ones counts for the container at this depth.
DEEPEST = 256
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Share of a container's score that its parent gets.
LIFT = 0.75


class Tags:
    """A page's tags, found in time that grows with its size whatever it holds.

    A tag ends at the first > outside quotes. Where none follows, its < is text. A search that fails leaves what it
    went through: a later one that comes to the same place fails too.
    """

    def __init__(self, page: str):
        self.page = page
        self._dead: set[int] = set()
        #: No stop lies between these two places; the second is one, or the page's end.
        self._from, self._stop = 0, -1
        self._no_more = len(page) + 1

    def _next_stop(self, at: int) -> int:
        if not self._from <= at <= self._stop:
            found = STOP.search(self.page, at)
            self._from, self._stop = at, found.start() if found else len(self.page)
        return self._stop

    def end_of(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; -1 if it doesn't."""
        seen = []
        while at not in self._dead:
            seen.append(at)
            stop = self._next_stop(at)
            if stop == len(self.page):
                break
            if self.page[stop] == ">":
                return stop
            close = self.page.find(self.page[stop], stop + 1)
            if close < 0:
                break
            at = close + 1
        self._dead.update(seen)
        return -1

    def _plain_end(self, at: int) -> int:
        """The next > from here on, or -1."""
        if at >= self._no_more:
            return -1
        found = self.page.find(">", at)
        if found < 0:
            self._no_more = at
        return found

    def __iter__(self) -> Iterator[tuple[int, int, str | None, bool, str]]:
        """(start, end, tag or None for what isn't shown, whether it closes, attributes)."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                at = len(page) if close < 0 else close + 3
                yield start, at, None, False, ""
            elif page.startswith(("<!", "<?"), start):
                close = self._plain_end(start)
                if close >= 0:
                    at = close + 1
                    yield start, at, None, False, ""
            elif name := TAG_NAME.match(page, at):
                close = self.end_of(name.end())
                if close < 0:
                    continue
                tag, ends = name[1].lower(), page[at] == "/"
                attributes, at = page[name.end() : close], close + 1
                if tag in RAW and not ends:
                    close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                    at = close.end() if close else len(page)
                    tag = None
                yield start, at, tag, ends, attributes


def _named(tag: str, attributes: str) -> tuple[str, int]:
    """An element's generalised name, digits out, and what marks it as clutter: 2 its tag, 1 a word, 0 nothing."""
    name, clutter = tag, 2 if tag in CLUTTER_TAGS else 0
    if attributes and "=" in attributes:
        marks = READERS if tag in MAIN else CLUTTER_WORDS
        for kind, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if not marks.isdisjoint(re.split(r"[^a-z]+", value)):
                clutter = max(clutter, 1)
            if kind.lower() == "class":
                name += "." + ".".join(sorted(re.sub(r"[0-9]+", "#", value).split()))
    return name, clutter


def _closes_itself(attributes: str) -> bool:
    """A slash of its own at the end; one that ends an unquoted value belongs to the value."""
    return attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\n\r\f\"'")


def blocks_of(page: str) -> list[tuple[str, bool, str, int]]:
    """(container path, in clutter, text, characters in links) of every block, in page order. Where all text is in clutter by
    words, words don't count."""
    found = _blocks(page)
    least = 1 if any(not clutter for _, clutter, _, _ in found) else 2
    return [(path, clutter >= least, text, linked) for path, clutter, text, linked in found]


def _blocks(page: str) -> list[tuple[str, int, str, int]]:
    out: list[tuple[str, int, str, int]] = []
    #: Open elements: tag, path up to here, in what clutter.
    stack: list[tuple[str, str, int]] = [("", "", 0)]
    opened: dict[str, int] = defaultdict(int)
    parts: list[str] = []
    linked, in_link = 0, False

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1][1], stack[-1][2], text, linked))
            parts.clear()
        linked = 0

    at = 0
    for start, end, tag, ends, attributes in Tags(page):
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        if tag is None:
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = not ends
            continue
        close()
        if ends:
            # A link that nobody closed ends with its block.
            in_link = False
            while opened[tag]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
        elif tag not in VOID and not _closes_itself(attributes):
            # A new block ends an open paragraph, and an item ends the one before it.
            while len(stack) > 1 and stack[-1][0] in LEAF and (stack[-1][0] == "p" or stack[-1][0] == tag):
                opened[stack.pop()[0]] -= 1
            _, path, clutter = stack[-1]
            name, own = _named(tag, attributes)
            stack.append((tag, path if tag in LEAF or len(stack) > DEEPEST else f"{path}/{name}", max(clutter, own)))
            opened[tag] += 1
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def container_scores(found: list[tuple[str, bool, str, int]]) -> dict[str, float]:
    """Running text outside links and clutter by container; a parent gets a share of its children's."""
    direct: dict[str, float] = defaultdict(float)
    for path, clutter, text, linked in found:
        if not clutter:
            direct[path] += max(0, len(text) - 2 * linked)
    scores: dict[str, float] = defaultdict(float)
    for path, value in direct.items():
        while True:
            scores[path] += value
            if not path:
                break
            path, value = path.rpartition("/")[0], value * LIFT
    return scores


def best_path(scores: dict[str, float]) -> str | None:
    return max(scores, key=lambda p: (scores[p], p.count("/"), p)) if scores else None


def text_below(found: list[tuple[str, bool, str, int]], path: str | None) -> str:
    """The blocks at or below ``path``, or the page's own best container where it has no such text."""
    for chosen in (path, best_path(container_scores(found))):
        if chosen is not None:
            blocks = [t for p, clutter, t, _ in found if not clutter and (p == chosen or p.startswith(f"{chosen}/"))]
            if blocks:
                return "\n\n".join(blocks)
    return ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], int] = defaultdict(int)
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            scores = container_scores(blocks_of(page))
            total = sum(scores.values())
            for path, score in scores.items():
                if score > 0:
                    votes[host, path] += round(1e6 * score / total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"]
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text_below(blocks_of(page), path) for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


#: Hosts whose winning paths are sent to all executors; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): what each host's pages vote for. ``pages`` has columns host and html."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", "path"))["path"].alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the article of every page, blocks joined by an empty line.

    Null or empty html gives an empty text; a null url is a host of its own; repeated rows are
    extracted each; other columns are not read. An empty table gives an empty result.
    """
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    winners = materialize(winning_paths(rows), "paths")
    few = winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(winners) if few else winners, "host", "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
