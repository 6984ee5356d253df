"""HTML main text by consensus host paths: pages vote for container paths, winners extract."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slices, table

#: Fixed values of HTML: elements without content, of which nothing is text, inside a line, that end at their own closing tag
#: whatever is inside, and that hold lines of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea template iframe svg title head object canvas audio video select".split())
TEXT_ONLY = frozenset("script style noscript textarea iframe title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms msub msup mtext q s samp small span strike strong "
    "sub sup time tt u var wbr img br ruby rt rp".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th tr tbody thead tfoot table ul ol dl summary address hr figure".split())
#: Table elements, which a closing tag from outside the table does not end.
_CELL = frozenset("table td th".split())
#: Elements that are never part of an article; a header is, inside an article.
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Words in class, id or role that mark an element outside the article as a whole name or beside words of arrangement; the
#: first also beside any others, if text and links agree (ARTICLE_SHARE); and those of reader comments.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense breadcrumb breadcrumbs complementary contentinfo cookie cookies consent disqus footer gdpr masthead modal "
    "navbar navigation newsletter pagination pager popup promo promoted sidebar signup sponsor sponsored subscribe subscription".split()
)
WEAK = frozenset(
    "banner dropdown header hidden menu nav notice notices notification promotion related replies reply respond search share sharing skip social toc toolbar topbar widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist disqus".split())
ARRANGEMENT = frozenset(
    "area bar block bottom box btn button buttons container content form global icon icons inner item items left link links list main module page panel posts primary right secondary "
    "section site tab tabs top wrap wrapper".split()
)
#: A class with one of these tells of a page's arrangement (has-sidebar), not of its element.
ABOUT_LAYOUT = frozenset("has with no without layout".split())
#: Share of a page's text from which on an element marked beside other words counts as the article all the same, and the most of it that may be links.
ARTICLE_SHARE, LINK_SHARE = 0.5, 0.3
_TAG = re.compile(r"<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_MARKS = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|\Z)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_RUN = re.compile(r"\d+")
_HIDDEN, _COMMENT, _SURE, _MAYBE = 4, 3, 2, 1


@dataclass
class _Page:
    """The block elements of a page as columns (tag, path, parent, mark; 0 the page itself), its blocks, and its paths as a tree of labels."""

    tags: list = field(default_factory=lambda: [""])
    paths: list = field(default_factory=lambda: [0])
    parents: list = field(default_factory=lambda: [-1])
    marks: list = field(default_factory=lambda: [0])
    blocks: list = field(default_factory=list)
    labels: list = field(default_factory=lambda: [(-1, "")])
    known: dict = field(default_factory=dict)

    def open(self, tag: str, label: str, parent: int, mark: int) -> int:
        path = self.paths[parent]
        if tag not in LEAF:
            path = self.known.setdefault((path, label), len(self.labels))
            if path == len(self.labels):
                self.labels.append((self.paths[parent], label))
        self.tags.append(tag)
        self.paths.append(path)
        self.parents.append(parent)
        self.marks.append(mark)
        return len(self.tags) - 1

    def path_text(self, path: int) -> str:
        parts = []
        while path:
            path, label = self.labels[path]
            parts.append(label)
        return "".join(f">{x}" for x in reversed(parts))

    def path_of(self, text: str) -> int | None:
        path = 0
        for label in text.split(">")[1:]:
            path = self.known.get((path, label))
            if path is None:
                return None
        return path


def _marks(tag: str, attributes: str) -> tuple[str, int]:
    """The label of a start tag, its name and generalised first class (digits as #), and how surely it marks something outside the article."""
    label, mark = tag, 0
    if not attributes:
        return label, mark
    for name, value in _MARKS.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            mark = _HIDDEN
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = set(_WORD.findall(token))
                if ABOUT_LAYOUT & words:
                    continue
                if COMMENTS & words:
                    mark = max(mark, _COMMENT)
                elif (STRONG | WEAK) & words and words <= STRONG | WEAK | ARRANGEMENT:
                    mark = max(mark, _SURE)
                elif STRONG & words and tag not in INLINE:
                    mark = max(mark, _MAYBE)
            if name == "class" and value.split():
                label = f"{tag}.{_RUN.sub('#', value.split()[0])}".replace(">", "")
    return label, mark


def _tokens(page: str) -> list[tuple]:
    """The tags of a page, (start, end, closing, name, attributes), without comments' content and elements that hold no text."""
    out, pos, never, masked = [], 0, set(), set()

    def closing(tag: str, at: int) -> int | None:
        if tag not in never:
            if m := re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at):
                return m.end()
            never.add(tag)
        return None

    raw: tuple | None = None
    while (m := _TAG.search(page, pos)) or raw is not None:
        if m is None:
            # The closing tag of head, svg or the like stood in a script: the element ends there all the same.
            out.append((raw[1], raw[2], False, "", ""))
            masked.add(raw[0])
            pos, raw = raw[2], None
            continue
        start, pos = m.start(), m.end()
        tag = (m.group(2) or "").lower()
        for sign, last in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            # One without its end goes on to the next >.
            if not tag and last not in never and page.startswith(sign, start):
                end = page.find(last, start + 2)
                pos = end + len(last) if end >= 0 else pos
                never.update([last] * (end < 0))
        if raw is not None:
            # Inside it: on to its closing tag, but not to one that a script or style holds.
            if m.group(1) and tag == raw[0]:
                out.append((raw[1], pos, False, "", ""))
                raw = None
            elif tag in TEXT_ONLY and not m.group(1):
                pos = closing(tag, pos) or pos
            continue
        if tag in RAW:
            if not m.group(1) and not m.group(3).endswith("/") and (end := closing(tag, pos)):
                if tag not in TEXT_ONLY and tag not in masked:
                    raw = (tag, start, end)
                    continue
                pos = end
            tag = ""
        out.append((start, pos, bool(m.group(1)), tag, m.group(3) or ""))
    return out


def _partners(tokens: list[tuple]) -> dict[int, int]:
    """The closing tag of each element inside a line, by its own name and nesting."""
    opened: dict[str, list[int]] = {}
    out = {}
    for k, (_, _, closing, tag, _) in enumerate(tokens):
        if tag in INLINE and tag not in VOID:
            if not closing:
                opened.setdefault(tag, []).append(k)
            elif opened.get(tag):
                out[opened[tag].pop()] = k
    return out


def parse(page: str) -> _Page:
    """Elements and blocks (text, element, characters in links) of a page, in time and memory linear in its length."""
    out, stack, buffer = _Page(), [0], []
    tokens = _tokens(page)
    partners = _partners(tokens)
    # Open elements by name in each table, cell or the page: what a closing tag can end.
    scopes: list[dict[str, int]] = [{}]
    at, links, skip_to = 0, 0, -1

    def flush():
        if buffer:
            joined = "".join(t for t, _ in buffer)
            decode = entities.unescape if "&" in joined else str
            text = " ".join(decode(joined).split())
            if text:
                linked = sum(len("".join(decode(t).split())) for t, inside in buffer if inside)
                out.blocks.append((text, stack[-1], min(linked, len(text))))
            buffer.clear()

    def close():
        tag = out.tags[stack.pop()]
        if tag in _CELL:
            scopes.pop()
        scopes[-1][tag] -= 1

    for k, (start, end, closing, tag, attributes) in enumerate(tokens):
        if k < skip_to:
            continue
        if start > at and k != skip_to:
            buffer.append((page[at:start], links > 0))
        at = end
        if k == skip_to or not tag:
            continue
        if tag in INLINE:
            if tag in ("br", "img"):
                buffer.append((" ", False))
            elif not closing and k in partners and (tag == "button" or attributes and _marks(tag, attributes)[1]):
                buffer.append((" ", False))
                skip_to = partners[k]
            elif tag == "a":
                links = 0 if closing else int(k in partners)
            continue
        flush()
        links = 0
        if closing:
            if tag in _CELL:
                while len(scopes) > 1 and any(s.get(tag) for s in scopes):
                    last = out.tags[stack[-1]]
                    close()
                    if last == tag:
                        break
            elif scopes[-1].get(tag):
                while out.tags[stack[-1]] != tag:
                    close()
                close()
            continue
        if tag in VOID:
            continue
        while len(stack) > 1 and (out.tags[stack[-1]] == "p" or out.tags[stack[-1]] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
            close()
        label, mark = _marks(tag, attributes)
        scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
        if tag in _CELL:
            scopes.append({})
        stack.append(out.open(tag, label, stack[-1], mark))
    if at < len(page):
        buffer.append((page[at:], links > 0))
    flush()
    return out


def _outside(page: _Page) -> list[bool]:
    """Whether each element stands outside the article: by its name or being hidden; by a mark, unless it is all there is; or by a less sure mark, weighed against its share of the text and of links."""
    n = len(page.tags)
    out, article = [False] * n, [False] * n
    for k in range(1, n):
        up, tag = page.parents[k], page.tags[k]
        article[k] = article[up] or tag in ("article", "main")
        out[k] = out[up] or tag in OUTSIDE or tag == "header" and not article[up] or page.marks[k] == _HIDDEN and tag not in ("html", "body")
    size, linked = _sums(page, out)
    for k in range(1, n):
        out[k] = out[k] or out[page.parents[k]]
        if out[k] or not page.marks[k] or page.tags[k] in ("html", "body", "main") or page.tags[k] == "article" and page.marks[k] != _COMMENT:
            continue
        if page.marks[k] != _MAYBE:
            out[k] = size[k] < size[0]
        else:
            out[k] = size[k] < ARTICLE_SHARE * size[0] or linked[k] > LINK_SHARE * size[k]
    return out


def _sums(page: _Page, outside: list[bool]) -> tuple[list[int], list[int]]:
    """Characters, and those in links, below each element, without what stands outside."""
    size, linked = [0] * len(page.tags), [0] * len(page.tags)
    for text, k, in_links in page.blocks:
        if not outside[k]:
            size[k] += len(text)
            linked[k] += in_links
    for k in range(len(page.tags) - 1, 0, -1):
        size[page.parents[k]] += size[k]
        linked[page.parents[k]] += linked[k]
    return size, linked


def own_container(page: _Page, outside: list[bool]) -> int:
    """The container of best score, the deepest of those.

    An element's score is the characters below it that are not in links less those that are, so a menu without
    a mark counts against the containers around it, and a title or lead for them. With just one main, or
    else one article, that has half of the page's score, only containers in that main, or that article, are looked at.
    """
    size, linked = _sums(page, outside)
    if not size[0]:
        return 0
    n = len(page.tags)
    score = [a - 2 * b for a, b in zip(size, linked)]
    if max(score) <= 0:
        score = size
    allowed, rooms = [True] * n, [k for k in range(n) if not outside[k] and page.tags[k] not in LEAF]
    for tag in ("main", "article"):
        tops = [k for k in rooms if page.tags[k] == tag and 2 * score[k] >= max(score)]
        if len(tops) == 1:
            allowed = [k == tops[0] for k in range(n)]
            for k in range(tops[0] + 1, n) if tag == "main" else ():
                allowed[k] = allowed[page.parents[k]]
            break
    best = max(score[k] for k in rooms if allowed[k])
    # Elements stand before those inside them, so the last of equal score is the deepest.
    return max(k for k in rooms if allowed[k] and score[k] == best)


def own_path(html: str) -> str:
    """The generalised path of a page's best container; empty without text."""
    page = parse(html)
    outside = _outside(page)
    return page.path_text(page.paths[own_container(page, outside)])


def main_text(html: str | None, winner: str | None) -> str:
    """Text of the containers on the winning path if they hold all that the page's own container does, else of that."""
    page = parse(html or "")
    outside = _outside(page)
    own = own_container(page, outside)
    path = None if winner is None else page.path_of(winner)
    in_own, in_winner = [False] * len(page.tags), [False] * len(page.tags)
    for k in range(len(page.tags)):
        up = page.parents[k]
        in_own[k] = k == own or up >= 0 and in_own[up]
        in_winner[k] = page.paths[k] == path and page.tags[k] not in LEAF or up >= 0 and in_winner[up]
    kept = [(text, k) for text, k, _ in page.blocks if not outside[k]]
    inside = in_winner if all(in_winner[k] for _, k in kept if in_own[k]) else in_own
    return "\n".join(text for text, k in kept if inside[k])


def _votes(batches):
    for batch in slices(batches):
        paths = [own_path(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], names=["host", "path"])


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, winner): the container path with most votes of a host's pages, ties to the shorter and then lesser path.

    Votes of a host are combined before the shuffle, so a hot host is a few rows of each task.
    """
    votes = pages.mapInArrow(_votes, "host string, path string").where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.char_length("path"), "path")
    return votes.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("host", F.col("path").alias("winner"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page from its whole html: (page_id, url, text, n_chars).

    Each page scores its containers (own_container) and votes for the generalised path (tags and first
    classes, digits as #) of the best; per host the path with most votes wins, and pages are read
    again along it. A page where the winning path does not hold all of the page's own container uses that.
    Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and the like are left
    out by element, and by words in class, id and role (_outside). Blocks are joined by one newline; white space inside a block, also a
    line break, is one space.

    A null html, or one without text, gives an empty text; pages with a null url or one without a
    host are one host. Time and memory are linear in a page's length at any depth of nesting and with any missing
    end tags. Rows that repeat give a row each; an empty table gives none; other columns are
    ignored. The winners are broadcast only where Spark finds their table within its own threshold.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    placed = rows.join(materialise(winning_paths(rows.select("host", "html"))), "host", "left")
    kind = pages.schema[id_col].dataType.simpleString()

    def read(batches):
        for batch in slices(batches):
            texts = [main_text(h, w) for h, w in zip(batch.column("html").to_pylist(), batch.column("winner").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return placed.select("page_id", "url", "html", "winner").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
