"""Main text of web pages by host consensus.

1. Every page's containers are scored: the characters of a block count for the container around it, twice its link
   characters are taken off, and each container passes half of its score on to the one around it. The best container is
   widened to the outermost article around it or, without one, to the nearest main: a heading or an intro beside the body
   and sections of other classes belong to the text. Without article and main, the best container stands as it is.
2. Each page votes for the path of its widened container: tags with classes from the body down, generalised by leaving out
   digits. Spark sums the votes by host and path; a host's winner has the most votes, then the largest score.
3. Each page is extracted again: the blocks of the containers at its host's winning path, or of its own widened container
   where it has none there.

Menus, headers (but for headings inside an article), footers, side bars, notices, adverts, scripts, styles and reader
comments are left out by tag, role, class or id before anything is scored. A form goes unless it has at least 100 unlinked
characters for each of its controls: some pages are wrapped in one form. A part of an article that is named as a banner,
related or shared goes unless it is text: at least 80 characters, at most a fifth of them links.

Blocks are what block elements separate; white space in a block becomes one space; blocks are joined by line feeds in page
order. Null and empty html give an empty text. Null urls, and urls without a host, vote together as one host. Repeated rows
are extracted row by row and vote each. Unclosed and stray tags are tolerated. Empty tables give empty results; nothing is
cut.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audira.llm.shared import extended, map_batches, pick, same, settle

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*+)>""", re.S)
OPEN_TAG = re.compile(r"<[!?/a-zA-Z].*", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
# Elements by how they are treated.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav footer aside button select svg math canvas object menu dialog head audio video datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar nav navbar "
    "navigation menu breadcrumb breadcrumbs pagination pager footer masthead comment comments reply replies respond disqus widget widgets toolbar "
    "login search".split()
)
# Of these, words that inside an article also name parts of the text (a lead, a section on related work, a share price).
DOUBTFUL_WORDS = frozenset("banner related share sharing".split())
CONTROLS = frozenset("input select textarea button".split())
#: Least unlinked characters of a form for each of its controls, and of a doubtful part of an article.
FORM_CHARS, PART_CHARS = 100, 80
#: A word behind one of these says how a page is laid out, not what the element is.
LAYOUT = frozenset("no not has with without hide".split())
# Start tags that close an open element, up to a boundary.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES |= {t: ("tr", "td", "th", "thead", "tbody", "tfoot") for t in ("thead", "tbody", "tfoot")}
BOUNDARY = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",)} | {t: ("table",) for t in ("tr", "td", "th", "thead", "tbody", "tfoot")}


@cache
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


def words_of_name(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]


@dataclass
class Attributes:
    left_out: bool = False
    doubtful: bool = False  # left out unless it is text inside an article
    header: bool = False
    name: str = ""


@lru_cache(4096)
def attributes(tag: str, text: str) -> Attributes:
    """What tag, role, class and id say; cached, as a host's pages share their templates."""
    found = {m[1].lower() if m[1] else m[5].lower(): next((v for v in m.groups()[1:4] if v is not None), "") for m in ATTRIBUTE.finditer(text)} if text else {}
    role, names = found.get("role", "").lower(), f"{found.get('class', '')} {found.get('id', '')}"
    words = words_of_name(names)
    bad = {w for i, w in enumerate(words) if w in LEFT_OUT_WORDS and not (i and words[i - 1] in LAYOUT)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    whole = tag in ("html", "body", "main", "article")
    sure = tag in LEFT_OUT or bool(hidden) or (not whole and (bool(bad - DOUBTFUL_WORDS) or role in LEFT_OUT_ROLES))
    out = Attributes(sure, bool(bad) and not whole and not sure, tag == "header" or (not whole and "header" in words))
    classes = sorted({re.sub(r"\d+", "", c) for c in found.get("class", "").lower().split()} - {""})
    out.name = ".".join([tag, *classes])
    return out


@dataclass
class Page:
    """Containers and blocks of a page. Node 0 stands for the whole page."""

    parent: list[int] = field(default_factory=lambda: [-1])
    name: list[str] = field(default_factory=lambda: [""])
    code: list[int] = field(default_factory=lambda: [0])
    own: list[float] = field(default_factory=lambda: [0.0])
    blocks: list[tuple[int, str]] = field(default_factory=list)
    links: list[int] = field(default_factory=list)  # characters of each block's links

    def settle(self, first: int, controls: int | None) -> None:
        """Take the blocks from ``first`` on back unless they are text: a form (with its controls) or a doubtful part."""
        chars, links = sum(len(t) for _, t in self.blocks[first:]), sum(self.links[first:])
        text = chars - 2 * links >= FORM_CHARS * max(1, controls) if controls is not None else chars >= PART_CHARS and 5 * links <= chars
        if not text:
            for (node, t), link in zip(self.blocks[first:], self.links[first:], strict=True):
                self.own[node] -= max(0, len(t) - 2 * link)
            del self.blocks[first:], self.links[first:]

    def path(self, node: int) -> str:
        names = []
        while node > 0:
            names.append(self.name[node])
            node = self.parent[node]
        return ">".join(reversed(names))

    def best(self) -> tuple[int, float]:
        """The container with the largest score; the first one of equals."""
        score = list(self.own)
        for node in range(len(score) - 1, 0, -1):
            score[self.parent[node]] += score[node] / 2
        node = max(range(len(score)), key=lambda i: (score[i], -i))
        return node, score[node]

    def widened(self, node: int) -> int:
        """The outermost article around a container (or the container, if it is one), else the nearest main, else itself."""
        around = [node]
        while around[-1] > 0:
            around.append(self.parent[around[-1]])
        tags = [self.name[i].split(".")[0] for i in around]
        articles = [i for i, tag in zip(around, tags, strict=True) if tag == "article"]
        mains = [i for i, tag in zip(around, tags, strict=True) if tag == "main"]
        return articles[-1] if articles else mains[0] if mains else node

    def text(self, matches: set[int]) -> str:
        inside = [False] * len(self.parent)
        for node in range(len(inside)):
            inside[node] = node in matches or (node > 0 and inside[self.parent[node]])
        return "\n".join(t for node, t in self.blocks if inside[node])


def step(code: int, name: str) -> int:
    return ((code * 1000003) ^ zlib.crc32(name.encode())) & 0xFFFFFFFFFFFFFFFF


def path_code(path: str) -> int:
    code = 0
    for name in path.split(">") if path else []:
        code = step(code, name)
    return code


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, container, left out, inside a header
    parts: list[str] = []
    in_link = link_chars = n_controls = 0
    trials: list[tuple[int, int, int | None]] = []  # depth, first block, controls before (None: a doubtful part)

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                node = stack[-1][1]
                page.blocks.append((node, text))
                page.links.append(link_chars)
                page.own[node] += max(0, len(text) - 2 * link_chars)
        parts, link_chars = [], 0

    def add(text: str) -> None:
        nonlocal link_chars
        if not text or stack[-1][2]:
            return
        if stack[-1][3] and not any(s[0] in HEADINGS for s in reversed(stack) if s[3]):
            return
        parts.append(text)
        if in_link:
            link_chars += len(text)

    def pop_to(depth: int) -> None:
        nonlocal in_link
        for tag, *_ in stack[depth:]:
            in_link -= tag == "a"
        while trials and trials[-1][0] >= depth:
            flush()
            _, first, before = trials.pop()
            page.settle(first, None if before is None else n_controls - before)
        del stack[depth:]

    at, limit = 0, source.rfind(">") + 1
    while at < limit and (m := MARKUP.search(source, at, limit)):
        add(source[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(source)
            continue
        if m[1]:  # an end tag
            if tag in BLOCKS:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                flush()
            else:
                depth = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        depth = i
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if depth:
                pop_to(depth)
            continue
        n_controls += tag in CONTROLS
        if tag in RAW:
            end = raw_end(tag).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
            if tag in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in CLOSES[tag]:
                        pop_to(i)
                        if tag not in ("tr", "thead", "tbody", "tfoot"):
                            break
                    elif stack[i][0] in BOUNDARY.get(tag, ()):
                        break
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        above = stack[-1]
        said = attributes(tag, "" if tag == "a" else m[3])
        node = above[1]
        if tag not in BLOCKS and tag != "a" and not said.left_out and not said.doubtful and not (above[2] and above[0] == tag):
            continue  # plain inline markup
        if tag in CONTAINERS:
            page.parent.append(node)
            page.name.append(said.name)
            page.code.append(step(page.code[node], said.name))
            page.own.append(0.0)
            node = len(page.parent) - 1
        inside = (said.header or said.doubtful) and any(s[0] in ("article", "main") for s in stack)
        in_article = said.header and inside
        on_trial = not above[2] and (tag == "form" or (said.doubtful and inside and tag in BLOCKS)) and not said.left_out
        out = said.left_out or (said.header and not in_article) or (said.doubtful and not on_trial)
        if on_trial and not out:
            trials.append((len(stack), len(page.blocks), None if tag != "form" else n_controls))
        stack.append((tag, node, above[2] or out, above[3] or in_article))
        in_link += tag == "a"
    add(OPEN_TAG.sub("", source[at:]) if at <= limit else "")  # a tag that never ends takes the rest
    flush()
    pop_to(1)
    return page


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score) of each page's widened container, with the score of its best one, from rows (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = parse(source or "")
                node, score = page.best()
                if score > 0:
                    hosts.append(host)
                    paths.append(page.path(page.widened(node)))
                    scores.append(float(score))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    return map_batches(pages.select("host", "html"), run, "host string, path string, score double")


def winners(voted: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes, then the largest score, then the first in order."""
    sums = voted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("score"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path"))
    return sums.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(source: str, winner: str | None) -> tuple[str, bool]:
    """Text and whether it came from the winning path."""
    page = parse(source)
    if winner is not None:
        code = path_code(winner)
        matches = {i for i, c in enumerate(page.code) if c == code}
        if matches and (text := page.text(matches)):
            return text, True
    return page.text({page.widened(page.best()[0])}), False


def page_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars, host, path (the winner), by_consensus. The html is parsed twice, and not shuffled
    while the winners are small."""
    rows = pick(pages, page_id, url, html).toDF("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    won = settle(winners(votes(rows)).withColumnsRenamed({"host": "w_host"}))
    joined = rows.join(won, same(F.col("host"), F.col("w_host")), "left").select("page_id", "url", "host", "path", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, paths = batch.column(4).to_pylist(), batch.column(3).to_pylist()
            found = [main_text(s or "", p) for s, p in zip(sources, paths, strict=True)]
            texts = [t for t, _ in found]
            columns = [*batch.columns[:4], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([c for _, c in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "path", "text", "n_chars", "by_consensus"])

    schema = extended(joined.drop("html"), text=T.StringType(), n_chars=T.LongType(), by_consensus=T.BooleanType())
    return map_batches(joined, run, schema)
