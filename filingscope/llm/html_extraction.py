"""Main text of pages by consensus paths of their host.

Each page scores its containers by the text they hold outside links and outside parts that are no article (menus, adverts and so on,
told by tag, role and class names). The smallest container with most of that text votes for its path of tags and classes, numbers
generalised. For each path with a vote the host counts its votes and the pages that have it at all. A path wins if most pages that have it vote
for it; all such paths win, those of rare templates too. Every page is then read again. Its own vote holds if it is a winning
path. If the host has voted it down, because it is a menu or a wrapper that other pages have beside their article, the page is read
through the winning path it has, the one with the largest share of votes; without any, through its own container after all.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import map_batches, saved

MAJORITY = 0.6  # share of the page's text that the voted container holds
WON = 0.5  # share of the pages with a path that vote for it
COUNTED_PATHS = 200_000  # of hosts that a task counts before it hands them on
KNOWN_HOSTS = 64  # whose paths a task remembers

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math select".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span
    strike strong sub sup time tt u var""".split()
)
CONTAINERS = frozenset("article main section div body td center html".split())
CLOSES_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr main menu nav ol p pre section table ul""".split()
)
CLOSED_BY_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div main body html aside nav footer header form".split())
APART_TAGS = frozenset("nav footer aside form header menu dialog button fieldset".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
APART_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner
    banners sidebar sidebars aside menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager cookie cookies
    consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login search social
    share sharing related recommended recommendations comment comments commentlist reply replies respond disqus footer foot
    header masthead topbar toolbar widget widgets skip copyright""".split()
)
# Words that say where or in what form something stands, not what it is: a name of these and of apart words only is apart. "related-work",
# "with-sidebar" or "comments-open" say something else.
FORM_WORDS = frozenset(
    """area bar block bottom box button buttons center col column container content div footer form group header holder icon icons inner item items
    label left link links list main module outer page panel pane post posts primary right row secondary section site slot text title
    top unit view wrap wrapper x xs sm md lg xl""".split()
)
ARTICLE_WORDS = frozenset("article content post entry story main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NUMBER = re.compile(r"(?:(?<![A-Za-z])[A-Za-z])?[0-9a-f]*\d[0-9a-f]*")  # of a class, decimal or hexadecimal, with a lone letter before it


@dataclass
class Element:
    tag: str
    parent: int
    step: str  # of the path: tag and classes
    key: int = 0  # hash of the path, for elements that are not inline
    apart: int = 0  # 1: told by class names, 2: by tag, role or being hidden
    likely: bool = False


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links

    def path(self, i: int) -> str:
        """Steps from the top of the page, inline elements left out."""
        steps = []
        while i > 0:
            if self.elements[i].tag not in INLINE:
                steps.append(self.elements[i].step)
            i = self.elements[i].parent
        return "".join(f"/{step}" for step in reversed(steps))


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(source)} if "=" in source else {}


def _names_apart(name: str) -> bool:
    """Whether a class or id says that its element is no part of an article: an apart word among words of form only."""
    words = [w.lower() for w in WORDS.findall(name)]
    return any(w in APART_WORDS for w in words) and all(w in APART_WORDS or w in FORM_WORDS or len(w) == 1 for w in words)


def _element(tag: str, source: str, parent: int, above: int) -> Element:
    step, apart, likely = tag, 2 if tag in APART_TAGS else 0, tag in ("article", "main")
    if source.strip():
        found = _attributes(source)
        classes = found.get("class", "").split()
        names = (*classes, found.get("id", ""))
        style = found.get("style", "").replace(" ", "").lower()
        hidden = "display:none" in style or found.get("aria-hidden") == "true" or re.search(r"(^|\s)hidden(\s|$)", ATTRIBUTE.sub("", source))
        if found.get("role", "").lower() in APART_ROLES or hidden:
            apart = 2
        elif not apart and tag not in ("html", "body"):
            apart = int(any(map(_names_apart, names)))
        general = ".".join(sorted({NUMBER.sub("#", c) for c in classes}))
        step += f".{general}" if general else ""
        likely = likely or any(w.lower() in ARTICLE_WORDS for name in names for w in WORDS.findall(name))
    key = 0 if tag in INLINE else xxhash.xxh64_intdigest(step.encode(), above) >> 1
    return Element(tag, parent, step, key, apart, likely)


def parse(html: str) -> Page:
    """Blocks of text with the elements that hold them, in page order. Time is linear in the page's length."""
    page = Page([Element("", -1, "")])
    elements, stack = page.elements, [0]
    buffer: list[str] = []
    links = muted = 0
    owner = 0
    gone: set[str] = set()  # closings that the rest of the page does not have
    is_open: Counter[str] = Counter()
    holders = [0]  # of each element: itself, or the block around it if it is inline

    def flush():
        nonlocal buffer, links
        if buffer:
            text = "".join(buffer)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                page.blocks.append((owner, text, links))
            buffer, links = [], 0

    def pop_to(depth: int):
        nonlocal owner, muted
        while len(stack) > depth:
            e = elements[stack.pop()]
            is_open[e.tag] -= 1
            if e.tag not in INLINE:
                flush()
                owner = holders[stack[-1]]
            elif e.apart:
                muted -= 1

    def find(mark: str, start: int) -> int:
        if mark in gone:
            return -1
        at = html.find(mark, start)
        if at < 0:
            gone.add(mark)
        return at

    at, end = 0, len(html)
    in_link = 0
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not muted:
            buffer.append(html[at:lt])
            if in_link:
                links += lt - at
        if lt == end:
            break
        if html.startswith("<!--", lt):
            close = find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        after = html[lt + 1 : lt + 2]
        if after in ("!", "?"):
            close = find(">", lt)
            at = close + 1 if close >= 0 else end
            continue
        closing = after == "/"
        name = NAME.match(html, lt + 1 + closing)
        if not name:
            if closing:
                close = find(">", lt)
                at = close + 1 if close >= 0 else end
            else:
                if not muted:
                    buffer.append("<")
                at = lt + 1
            continue
        tag = name.group().lower()
        gt = find(">", name.end())
        # A ">" inside quotes does not end the tag.
        inside = name.end()
        while gt >= 0 and not closing:
            quotes = [q for q in (html.find('"', inside, gt), html.find("'", inside, gt)) if q >= 0]
            if not quotes:
                break
            q = min(quotes)
            second = find(html[q], q + 1)
            if second < 0:
                break
            inside = second + 1
            if inside > gt:
                gt = find(">", inside)
        if gt < 0:
            break
        source = html[name.end() : gt]
        at = gt + 1
        if closing:
            for depth in range(len(stack) - 1, 0, -1) if is_open[tag] else ():
                if elements[stack[depth]].tag == tag:
                    pop_to(depth)
                    break
                if tag in INLINE and elements[stack[depth]].tag not in INLINE:
                    break
            if tag == "a":
                in_link = max(0, in_link - 1)
            continue
        if tag in RAW:
            mark = re.compile(f"</{re.escape(tag)}", re.I).search(html, at) if tag not in gone else None
            if mark is None:
                if tag not in gone:
                    gone.add(tag)
                if not source.endswith("/"):
                    break
                continue
            close = html.find(">", mark.end())
            at = close + 1 if close >= 0 else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif not muted:
                buffer.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P or tag in CLOSED_BY_ITSELF:
                closes = {"p"} if tag in CLOSES_P else CLOSED_BY_ITSELF[tag]
                for depth in range(len(stack) - 1, 0, -1) if any(is_open[c] for c in closes) else ():
                    above = elements[stack[depth]].tag
                    if above in closes:
                        pop_to(depth)
                        break
                    if above in SCOPES:
                        break
        parent = stack[-1]
        elements.append(_element(tag, source, parent, elements[holders[parent]].key))
        holders.append(len(holders) if tag not in INLINE else holders[parent])
        if source.endswith("/") and tag not in CONTAINERS:
            continue
        stack.append(len(elements) - 1)
        is_open[tag] += 1
        if tag in INLINE:
            muted += bool(elements[-1].apart)
            in_link += tag == "a"
        else:
            owner = stack[-1]
    pop_to(1)
    flush()
    return page


def _totals(page: Page) -> tuple[list[int], list[int], list[bool]]:
    """Of each element: characters of its text, those outside links and apart elements, and whether it is apart from the page.

    An element that only class names set apart, but that holds most of the page's text, is not: it holds the article too.
    """
    n = len(page.elements)
    every, content = [0] * n, [0] * n
    own: list[list[int]] = [[0, 0] for _ in range(n)]
    for owner, text, links in page.blocks:
        own[owner][0] += len(text)
        own[owner][1] += max(0, len(text) - 2 * links)
    for i in range(n - 1, -1, -1):
        every[i] += own[i][0]
        if (up := page.elements[i].parent) >= 0:
            every[up] += every[i]
    apart = [False] * n
    for i, e in enumerate(page.elements):
        apart[i] = e.apart == 2 or (e.apart == 1 and 2 * every[i] <= every[0]) or (e.parent >= 0 and apart[e.parent])
    for i in range(n - 1, -1, -1):
        content[i] += 0 if apart[i] else own[i][1]
        if (up := page.elements[i].parent) >= 0:
            content[up] += content[i]
    return every, content, apart


def best_container(page: Page, content: list[int]) -> int:
    """The smallest container with most of the page's content; one that looks like an article wins with half as much."""
    total = content[0]
    best = 0
    if not total:
        return next((i for i, e in enumerate(page.elements) if e.tag in ("article", "main") and not e.apart), 0)
    for i, e in enumerate(page.elements):
        if e.tag in CONTAINERS and content[i] >= total * (MAJORITY / 2 if e.likely else MAJORITY):
            if not (page.elements[best].likely and not e.likely):
                best = i if content[i] >= content[best] * MAJORITY / 2 else best
    return best


def read(page: Page, roots: list[int], every: list[int]) -> str:
    """Blocks below the roots without the apart ones, joined by an empty line.

    An element that only its class words set apart stays if it holds most of the root's text. Headings of a header stay.
    """
    n = len(page.elements)
    root = [-1] * n
    out = [False] * n
    wanted = set(roots)
    heading = [False] * n
    for i, e in enumerate(page.elements):
        up = e.parent
        if i in wanted:
            root[i] = i
        elif up >= 0 and root[up] >= 0:
            root[i], out[i] = root[up], out[up]
            heading[i] = heading[up] or (e.tag in HEADINGS)
            if e.tag == "header":
                out[i] = out[i] or e.apart == 2
            elif e.apart == 2 or (e.apart == 1 and 2 * every[i] <= every[root[i]]):
                out[i] = True
            if heading[i] and out[i] and page.elements[up].tag == "header" and not out[page.elements[up].parent]:
                out[i] = False
    return "\n\n".join(text for owner, text, _ in page.blocks if root[owner] >= 0 and not out[owner])


def vote(html: str) -> str:
    page = parse(html)
    return page.path(best_container(page, _totals(page)[1]))


def _containers(page: Page, apart: list[bool]) -> set[int]:
    return {e.key for e, out in zip(page.elements, apart) if e.tag in CONTAINERS and not out}


def extract(html: str, won: Mapping[int, float] | None = None, lost: Collection[int] = ()) -> str:
    """The article of a page; `won` are the keys of the host's winning paths and their shares, `lost` those of paths it voted down."""
    page = parse(html)
    every, content, apart = _totals(page)
    best = best_container(page, content)
    if won and page.elements[best].key in lost:
        have = [k for k in _containers(page, apart) if k in won]
        if have:
            path = max(have, key=lambda k: (won[k], k))
            found = [i for i, e in enumerate(page.elements) if e.key == path and e.tag not in INLINE and not apart[i]]
            if page.elements[found[0]].tag in ("article", "main", "body", "html"):
                found = [max(found, key=lambda i: (content[i], -i))]
            return read(page, found, every)
    return read(page, [best], every)


def _host():
    return F.coalesce(F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, key, path, votes and pages (that have it) of every path that a page of the host voted for."""

    def batch_of(counts: dict[tuple[str, int], list]) -> pa.RecordBatch:
        rows = [(host, key, *own) for (host, key), own in counts.items()]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["host", "key", "path", "votes", "pages"])

    def run(batches):
        counts: dict[tuple[str, int], list] = {}
        for batch in batches:
            for host, html in zip(*(batch.column(i).to_pylist() for i in range(2))):
                page = parse(html or "")
                _, content, apart = _totals(page)
                best = best_container(page, content)
                for key in _containers(page, apart):
                    counts.setdefault((host, key), [None, 0, 0])[2] += 1
                if best:
                    own = counts.setdefault((host, page.elements[best].key), [None, 0, 1])
                    own[0], own[1] = page.path(best), own[1] + 1
            if len(counts) > COUNTED_PATHS:
                yield batch_of(counts)
                counts = {}
        yield batch_of(counts)

    found = map_batches(pages.select(_host().alias("host"), "html"), run, "host string, key long, path string, votes long, pages long")
    return found.groupBy("host", "key").agg(F.min("path").alias("path"), F.sum("votes").alias("votes"), F.sum("pages").alias("pages")).where("votes > 0")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty pages have an empty text. A null or unreadable url belongs to the host without a name. Pages without
    content outside apart elements give what their first article holds, or an empty text. Repeated rows are read each and vote each; of paths
    with the same share the one with the larger hash is taken. A page is read whole, in time linear in its length. Other columns are not read.

    The paths of all hosts are a small table; where Spark finds it small enough to send, pages are not moved.
    """
    share = F.col("votes") / F.greatest("votes", "pages")
    paths = host_paths(pages).groupBy("host").agg(F.collect_list(F.struct("key", share.alias("share"))).alias("paths"))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", _host().alias("host"))
    joined = rows.join(saved(paths), "host", "left").select("page_id", "url", "html", "host", "paths")

    def run(batches):
        hosts: dict[str, tuple[dict[int, float], set[int]]] = {}
        for batch in batches:
            texts = []
            for i, (html, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if host not in hosts:
                    if len(hosts) >= KNOWN_HOSTS:
                        hosts.clear()
                    own = batch.column(4)[i].as_py() or []
                    hosts[host] = ({p["key"]: p["share"] for p in own if p["share"] >= WON}, {p["key"] for p in own if p["share"] < WON})
                texts.append(extract(html or "", *hosts[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = map_batches(joined, run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
