"""Main text of web pages by consensus host paths.

1. Each page is read into blocks of text inside containers. A container scores by the text of its blocks without link
   text, which counts in full for the innermost container and half as much for each one around it.
2. Each page votes for the path of its best container: tags and classes from the root on, with digits and generated names
   generalised. Spark sums the votes of each host.
3. Every page is read again and the containers on its host's winning path give the text; a page without them falls back
   on its own best container. The text is that of the nearest article or main around them, or else also that of what
   stands beside them at any level, except for lists of links.

Dropped everywhere: menus, page headers (but not an article's headings), footers, sidebars, notices, adverts, forms,
scripts, styles, hidden parts and reader comments, by tag, role, class or id. A class or id alone doesn't drop what holds
the page's article or most of its text, nor does a form around the whole page.

Null or empty pages have an empty text. Unbalanced quotes and tags end where the page ends or an outer tag does; pages of
any length are read whole. A null url is a host of its own. Repeated rows each vote and return their row.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import prepare, table

#: Elements of HTML by what they do here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript textarea title template iframe svg math xmp noembed noframes".split())
SKIPPED = set("nav footer aside form button select dialog menu canvas audio video object datalist head".split())
CONTAINERS = set("article section main div body td center blockquote".split())
BLOCKS = CONTAINERS | set("address caption dd details dir dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li nav ol option p pre summary table tbody tfoot th thead tr ul aside dialog menu".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - set("caption dd dt legend option summary tbody td tfoot th thead tr body head html".split())
#: An element of the first kind ends an open one of the second kind, unless one of the third stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in classes and ids that mark what isn't article text; those of the second list mark headers.
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsbygoogle|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|menus?|nav|navbar|navigation|breadcrumbs?|sidebar|side|rail|widgets?|footer|foot|comments?|commentlist|respond|repl(?:y|ies)|disqus|share|sharing|social|related|recommend(?:ed|ations?)?|newsletter|subscribe|signup|login|search|pagination|pager|hidden|skip|toolbar)(?:$|[\s_-])")
#: Of these words, those that no wrapper of an article has.
NO_WRAPPER = re.compile(r"(?:^|[\s_-])(?:cookies?|consent|gdpr|popup|comments?|commentlist|respond|repl(?:y|ies)|disqus|newsletter)(?:$|[\s_-])")
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])")
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

#: A tag ends at the first > outside quotes, or at the first of all where quotes don't close.
TAG = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
#: Text from which on a form that holds most of a page's text is a wrapper.
FORM_CHARS = 200
#: Attributes that matter here.
MARKED = re.compile(r"(?:^|[\s\"'])(?:class|id|role|hidden|aria-hidden|style)\b", re.I)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"

VOTES = "host string, path string, votes double"
OUT = "page_id bigint, url string, text string, n_chars bigint, path string"


class Block:
    __slots__ = ("text", "container", "links")

    def __init__(self, text: str, container: int, links: int):
        self.text, self.container, self.links = text, container, links


def label(tag: str, attributes: dict[str, str]) -> str:
    """A step of a path: the tag and its classes, without what differs from page to page."""
    names = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split() if not re.search(r"\d.*[a-z].*\d|[0-9a-f]{8}", c)})
    return ".".join([tag, *names])


class Noise:
    """What a form, or an element that its names mark as noise, holds: text outside links, tags of articles, paragraphs
    and headings."""

    def __init__(self, names: str, form: bool = False):
        self.names, self.form, self.chars, self.tags, self.paragraphs = names, form, 0, set(), 0

    def wraps(self, total: int) -> bool:
        """Whether it is only a wrapper of the article of a page with so much text."""
        if self.tags:
            return "main" in self.tags or not NO_WRAPPER.search(self.names)
        return 2 * self.chars > total and not NO_WRAPPER.search(self.names) and (not self.form or self.paragraphs > 0 and self.chars >= FORM_CHARS)


def read(page: str) -> tuple[list[Block], list[int], list[str]]:
    """The blocks of a page in order; for each container its parent (-1 for the root's) and its path."""
    kept: set[int] = set()
    while True:
        blocks, parents, paths, noise, has_article = parse(page, kept)
        if has_article or not noise:
            return blocks, parents, paths
        total = sum(x.chars for x in noise.values()) + sum(max(0, len(b.text) - b.links) for b in blocks)
        more = {k for k, x in noise.items() if x.wraps(total)}
        if not more:
            return blocks, parents, paths
        kept |= more


def parse(page: str, kept: set[int]) -> tuple[list[Block], list[int], list[str], dict[int, Noise], bool]:
    """What read() returns; the outermost elements skipped for their names, by place, but for those in kept; and whether
    an article or main is not skipped."""
    blocks, parents, paths = [], [-1], [""]
    stack: list[tuple[str, int, int, bool, Noise | None]] = []  # tag, container, 0 or 1 (skipped) or 2 (only headings), whether link, noise
    container, skip, link = 0, 0, False
    noise: dict[int, Noise] = {}
    within, has_article = None, False
    parts: list[str] = []
    linked = 0
    heading = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, container, min(linked, len(text))))
            parts.clear()
        linked = 0

    def settle() -> None:
        nonlocal container, skip, link, heading, within
        container, skip, link, within = stack[-1][1:] if stack else (0, 0, False, None)
        heading = skip == 2 and any(s[0] in HEADINGS for s in stack)

    def pop_to(k: int) -> None:
        if any(s[0] in BLOCKS for s in stack[k:]):
            flush()
        del stack[k:]
        settle()

    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text and (skip == 0 or skip == 2 and heading):
            parts.append(text)
            if link:
                linked += len(text.strip())
        elif within and not link:
            within.chars += len(text.strip())
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and skip == 0:
                parts.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if (tag in CLOSES_P or tag in ENDS) and stack and stack[-1][0] not in CONTAINERS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" and tag in CLOSES_P:
                    pop_to(k)
                    break
                if stack[k][0] in CONTAINERS or stack[k][0] in ("table", "ul", "ol", "dl"):
                    break
        if tag in ENDS and stack:
            same, barrier = ENDS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in same:
                    pop_to(k)
                    break
                if stack[k][0] in barrier:
                    break
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        attributes = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(found[3])} if MARKED.search(found[3]) else {}
        own, kind, inner = container, skip, within
        if kind != 1 and (attributes or tag in SKIPPED or tag == "header"):
            names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().strip()
            if tag == "form" and found.start() not in kept:
                kind = 1
                inner = noise[found.start()] = Noise(names, form=True)
            elif tag in SKIPPED and tag != "form" or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "").lower()):
                kind = 1
            elif names and tag not in ("html", "body", "article", "main") and found.start() not in kept and NOISE.search(names):
                kind = 1
                inner = noise[found.start()] = Noise(names)
            elif tag == "header" or names and tag not in ("html", "body", "article", "main") and HEADER.search(names):
                kind = 2 if any(s[0] in ("article", "main") for s in stack) else 1
        if tag in CONTAINERS:
            parents.append(container)
            paths.append(f"{paths[container]}>{label(tag, attributes)}")
            own = len(parents) - 1
        if tag in ("article", "main"):
            if kind != 1:
                has_article = True
            elif inner:
                inner.tags.add(tag)
        elif inner and kind == 1 and (tag == "p" or tag in HEADINGS):
            inner.paragraphs += 1
        stack.append((tag, own, kind, link or tag == "a", inner))
        container, skip, link, within = own, kind, stack[-1][3], inner
        heading = kind == 2 and any(s[0] in HEADINGS for s in stack)
    flush()
    return blocks, parents, paths, noise, has_article


def best(blocks: list[Block], parents: list[int]) -> tuple[int, float]:
    """The container with the highest score, the outermost one of equals, and its share of all scores."""
    score = Counter()
    for b in blocks:
        worth, k = max(0, len(b.text) - 2 * b.links), b.container
        while k > 0 and worth >= 1:
            score[k] += worth
            worth, k = worth / 2, parents[k]
    if not score:
        return 0, 0.0
    k = max(score, key=lambda k: (score[k], -k))
    return k, score[k] / sum(score.values())


def inside(blocks: list[Block], parents: list[int], paths: list[str], chosen: set[int]) -> str:
    """Text of the nearest article or main around each chosen container; where there is none, text of the container and
    of what stands beside it at any level, except for lists of links."""
    whole, around = set(), set()
    for k in chosen:
        up = k
        while up > 0 and not re.match(r"(?:article|main)(?:\.|$)", paths[up].rpartition(">")[2]):
            up = parents[up]
        whole.add(up if up > 0 else k)
        while up <= 0 < k:
            k = parents[k]
            around.add(k)
    within = [False] * len(parents)
    beside = [-1] * len(parents)  # the outermost container that holds this one and no chosen one
    for k in range(len(parents)):
        within[k] = k in whole or (parents[k] >= 0 and within[parents[k]])
        if k and k not in around:
            beside[k] = k if parents[k] in around else beside[parents[k]]
    worth = Counter()
    for b in blocks:
        worth[beside[b.container]] += len(b.text) - 2 * b.links
    return "\n\n".join(b.text for b in blocks if within[b.container] or (worth[beside[b.container]] > 0 if beside[b.container] >= 0 else b.container in around and len(b.text) > 2 * b.links))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes: every task sums its pages' votes before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast: Counter = Counter()
            for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks, parents, paths = read(page or "")
                k, share = best(blocks, parents)
                if k:
                    cast[host, paths[k]] += round(share * 1e6)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in cast], pa.string()), pa.array([p for _, p in cast], pa.string()), pa.array([float(v) for v in cast.values()], pa.float64())], ["host", "path", "votes"])

    return pages.select("host", "html").mapInArrow(run, VOTES).groupBy("host", "path").agg(F.sum("votes").alias("votes"))


#: Hosts up to this number are sent to all executors with their paths; beyond it they are joined by a shuffle.
BROADCAST_HOSTS = 20_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path (that gave the text) of every page."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))))
    winners = votes(rows).groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("winner")).checkpoint()
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, page, winner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks, parents, paths = read(page or "")
                chosen = {k for k, p in enumerate(paths) if p == winner}
                text, path = inside(blocks, parents, paths, chosen), winner
                if not text:
                    k, _ = best(blocks, parents)
                    text, path = (inside(blocks, parents, paths, {k}), paths[k]) if k else ("\n\n".join(b.text for b in blocks), "")
                out.append((page_id, url, text, len(text), path))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], ["page_id", "url", "text", "n_chars", "path"])

    return rows.join(winners, "host", "left").select("page_id", "url", "html", "winner").mapInArrow(run, OUT)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
