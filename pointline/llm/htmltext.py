"""HTML extraction by nearest-URL page differencing.

A page is cut into text lines at its block elements. Within each host, pages are ordered by URL
path, and each is compared with its neighbours: lines that the longest common subsequence aligns
with most of them are the site's frame and are deleted. All lines of all pages take part. Markup is the check on what
differencing can't see: what an article element encloses is content even where neighbours repeat it, as copied
articles and quoted passages are, and menus, adverts or comments are frame even where they differ
from page to page, inside an article too. Blocks of an article whose name may say its topic as well
as its place (a disclaimer, an alert) are left to differencing.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_text, stable, written

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe svg object canvas head title textarea select audio video map annotation annotation-xml".split())
#: Elements that frame an article.
FRAME = frozenset("nav footer aside form button menu dialog".split())
#: Elements that enclose an article.
BODY = frozenset("article main".split())
#: Elements inside of which text runs on.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose".split())
#: Elements that a start tag ends if one is the innermost block; other blocks end a p.
ENDS = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"), "option": ("option",)}
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names that mark frame, whatever is inside.
FRAME_NAMES = frozenset(
    """ad ads advert adverts advertisement adsense promo promoted promotion sponsor sponsored breadcrumb breadcrumbs comment comments comment-list
    respond reply replies disqus cookie cookies consent alert popup modal newsletter subscribe subscription signup login share sharing social
    related recommended pagination pager skip-link searchbox copyright disclaimer teaser teasers""".split()
)
#: Words that mark frame unless an article or main element is inside: wrappers are named by their layout.
LAYOUT_NAMES = frozenset("banner sidebar side-bar menu nav navbar navigation footer masthead notice notices notification widget widgets toolbar topbar search legal".split())
#: Words of both lists that name a topic as often as a place: in an article neighbours decide on a block of such a name.
TOPICS = frozenset("social alert disclaimer copyright related recommended search legal consent login reply respond banner menu notification notifications promotion".split())
#: Words that say, beside one of the lists' in a name, that the block is a part of the page and no topic.
PIECES = frozenset(
    """section sections list lists item items slot slots box boxes block blocks button buttons bar bars post posts article articles story stories link links
    unit units area form forms thread threads panel panels container wrapper wrap widget widgets icons feed signup sign banner notice notices message messages
    modal popup left right user users reader readers""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Matches of lines that are listed one by one; beyond it bit vectors take less work, with a result as long.
MATCHES = 2_000_000
NAME_PART = re.compile(r"[^a-z0-9]+")
NUMBER = re.compile(r"[-_]?[0-9]+$")
#: First parts of names that say what a wrapper has beside its content.
BESIDE = frozenset("has with no without".split())


def name_kind(word: str, own: bool) -> int | None:
    """What a class or id says of a block in an article (``own``: of the article element itself): 0 for
    frame, -1 for frame unless an article is inside, 3 for what neighbours decide, None for content.

    A word of the lists counts if it is the whole name, with or without a number, or stands with a word
    of PIECES in it, joined or apart (ad-slot, commentlist). Any other company names a topic (social-history).
    """
    word = NUMBER.sub("", word)
    parts = [x for x in NAME_PART.split(word) if x]
    if not parts or parts[0] in BESIDE:
        return None
    whole = word in FRAME_NAMES or word in LAYOUT_NAMES
    if not whole and len(parts) == 1:
        for i in range(2, len(word) - 1):
            if any(x in PIECES and (y in FRAME_NAMES or y in LAYOUT_NAMES) for x, y in ((word[i:], word[:i]), (word[:i], word[i:]))):
                parts = [word[:i], word[i:]]
                break
    for kind, names in ((0, FRAME_NAMES), (None if own else -1, LAYOUT_NAMES)):
        if whole and word in names:
            return 3 if word in TOPICS and not own else kind
        if not whole and any(x in names and any(y in PIECES for j, y in enumerate(parts) if j != i) for i, x in enumerate(parts)):
            return kind
    return None


def frame_kind(name: str, attributes: str, in_body: bool) -> int | None:
    """0 for frame, -1 for frame unless an article is inside, 3 for what neighbours decide in an article, None for neither."""
    if name in ("html", "body"):
        return None
    if name in FRAME or name == "header" and not in_body:
        return 0
    kind = None
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        key, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if key in ("class", "id"):
            for word in value.split():
                if in_body or name in BODY:
                    said = name_kind(word, name in BODY)
                    if said == 0:
                        return 0
                    kind = said if kind is None or said == -1 else kind
                    continue
                if word in FRAME_NAMES or NUMBER.sub("", word) in FRAME_NAMES:
                    return 0
                parts = NAME_PART.split(word)
                if parts[0] not in BESIDE and (LAYOUT_NAMES.intersection((word, *parts)) or FRAME_NAMES.intersection(parts)):
                    kind = -1
        elif key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
            return 0
    return kind


class Tags:
    """The tags of a page in order, found in time linear in its length whatever is broken in it."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.quotes = True
        self.endless: set[str] = set()

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether it closes, lower-case name or None, attributes) of the first tag from ``at`` on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, None, ""
            m = NAME.match(page, start)
            if m is None:
                if page.startswith("<![CDATA[", start):
                    return start, start + 9, False, None, ""
                if page.startswith(("<!", "<?"), start) and start < self.last[">"]:
                    return start, page.index(">", start) + 1, False, None, ""
                at = start + 1
                continue
            end = self.end(m.end())
            if end < 0:
                return None  # no tag ends any more: the rest is text
            return start, end + 1, bool(m.group(1)), m.group(2).lower(), page[m.end() : end]
        return None

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, or -1."""
        if at > self.last[">"]:
            return -1
        first = at
        while self.quotes:
            at = PLAIN.match(self.page, at).end()
            if at == len(self.page):
                self.quotes = False  # a quote that doesn't end swallowed the rest: from here on quotes are letters
                break
            c = self.page[at]
            if c == ">":
                return at
            if at == self.last[c]:
                break
            at = self.page.index(c, at + 1) + 1
        return self.page.find(">", first)

    def close(self, name: str, at: int) -> tuple[int, int] | None:
        """Where the next end tag of ``name`` starts and ends."""
        if name in self.endless:
            return None
        m = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I | re.A).search(self.page, at)
        if m is None:
            self.endless.add(name)
            return None
        end = self.page.find(">", m.end()) if m.end() <= self.last[">"] else -1
        return m.start(), len(self.page) if end < 0 else end + 1


class Open:
    """The open elements of a page; all questions about them take constant time."""

    def __init__(self):
        self.elements: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.bodies = 0

    def push(self, name: str, zone: int) -> None:
        self.places.setdefault(name, []).append(len(self.elements))
        if name not in INLINE:
            self.blocks.append(len(self.elements))
        self.bodies += name in BODY
        self.elements.append((name, zone))

    def cut(self, at: int) -> int:
        """Close all elements from ``at`` on; the zone before them."""
        zone = self.elements[at][1]
        for name, _ in self.elements[at:]:
            self.places[name].pop()
            self.bodies -= name in BODY
        del self.elements[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        return zone

    def find(self, name: str) -> int | None:
        """The innermost open element of that name, unless it is inline and a block is inside it."""
        at = self.places.get(name)
        if not at or name in INLINE and self.blocks and self.blocks[-1] > at[-1]:
            return None
        return at[-1]

    def block(self) -> str | None:
        return self.elements[self.blocks[-1]][0] if self.blocks else None


def page_blocks(page: str) -> list[tuple[str, int]]:
    """(line, zone) of the page's text blocks in order; zone 2 in an article, 3 where neighbours decide in one, 1 elsewhere, 0 or less in frame.

    White space inside a block is one space, references are decoded, empty blocks are left out.
    """
    blocks: list[tuple[str, int]] = []
    text: list[str] = []
    open_, tags = Open(), Tags(page)
    zone, at, n = 1, 0, len(page)

    def flush() -> None:
        if text:
            line = "".join(text)
            if "&" in line:
                line = html.unescape(line)
            line = SPACE.sub(" ", line).strip()
            if line:
                blocks.append((line, zone))
            text.clear()

    while at < n:
        tag = tags.next(at)
        if tag is None:
            text.append(page[at:])
            break
        start, end, closing, name, attributes = tag
        if start > at:
            text.append(page[at:start])
        at = end
        if name is None:
            continue
        if name not in INLINE:
            flush()
        if closing:
            place = open_.find(name)
            if place is not None:
                before = open_.cut(place)
                if before != zone:
                    flush()
                    zone = before
            continue
        if name in RAW:
            if attributes.rstrip().endswith("/") and name == "svg":
                continue
            found = tags.close(name, at)
            if found is not None:
                at = found[1]
            elif name == "head":  # a head that isn't closed ends where the body begins
                body = re.compile("<body", re.I | re.A).search(page, at) if "body" not in tags.endless else None
                tags.endless.add("body")
                at = body.start() if body else at
            else:
                at = n
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            # start tags that end an element before them
            for closes in ENDS.get(name, ("p",)):
                if open_.block() == closes:
                    zone = open_.cut(open_.blocks[-1])
        after = zone
        if zone:
            kind = frame_kind(name, attributes, open_.bodies > 0)
            after = kind if kind == 0 or kind is not None and zone > 0 else 2 if name in BODY and zone != 3 else zone
        if after != zone:
            flush()
        open_.push(name, zone)
        zone = after
    flush()
    return blocks


def line_hashes(own: list[tuple[str, int]]) -> tuple[list[int], list[bool]]:
    """Hashes of all lines of a page, article or not, and which of them go if neighbours share them.

    Lines of an article have hashes of their own, so they align with lines of articles only.
    """
    body = any(zone >= 2 for _, zone in own)
    lines, asked = [], []
    for line, zone in own:
        lines.append(xxhash.xxh64_intdigest(line.encode(errors="surrogatepass"), zone == 2) - (1 << 63))
        asked.append(zone == (3 if body else 1))
    return lines, asked


def columns(rows: list[tuple], n: int) -> list[list]:
    return [[r[k] for r in rows] for k in range(n)]


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal ends and lines that the other page lacks are set aside first; the rest is solved by matches
    (Hunt and Szymanski 1977) or, where lines repeat so often that matches are many, by bit vectors.
    """
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    mine, other = Counter(a[start : len(a) - end]), Counter(b[start : len(b) - end])
    at = [i for i in range(start, len(a) - end) if a[i] in other]
    x, y = [a[i] for i in at], [v for v in b[start : len(b) - end] if v in mine]
    matches = sum(mine[v] * other[v] for v in mine if v in other)
    inner = by_matches(x, y) if matches <= MATCHES else by_bits(x, y)
    return [*range(start), *(at[k] for k in inner), *range(len(a) - end, len(a))]


def by_matches(a: list[int], b: list[int]) -> list[int]:
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    tops: list[int] = []
    chains: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tops, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                chains.append(link)
            elif j < tops[k]:
                tops[k], chains[k] = j, link
    out, node = [], chains[-1] if chains else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``, one machine word for 64 places."""
    masks: dict[int, int] = {}
    spots: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        spots.setdefault(x, []).append(j)
    for x, own in spots.items():
        bits = np.zeros(len(b), np.uint8)
        bits[own] = 1
        masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & every
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(bits == 0)]


def by_bits(a: list[int], b: list[int]) -> list[int]:
    """The same by halving ``a`` (Hirschberg 1975), so that memory stays linear."""
    if len(a) * len(b) <= MATCHES:
        return by_matches(a, b)
    if len(a) == 1:
        return [0] if a[0] in b else []
    half = len(a) // 2
    k = int((common_lengths(a[:half], b) + common_lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    return by_bits(a[:half], b[:k]) + [half + i for i in by_bits(a[half:], b[k:])]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", neighbours: int = 4) -> DataFrame:
    """The main text of every page.

    Returns ``id_col``, ``url_col``, text and n_chars (its code points), one row per row of
    ``pages``; other columns aren't carried. Each page is compared with the next ``neighbours`` / 2
    pages of its host on either side in the order of path and content; pages of a host with the same
    lines and article count as one, since copies don't show what is frame. Lines in an article or main element
    stay; lines in menus, headers, footers, asides, forms, adverts, notices and comments go; of the
    others, those go that the longest common subsequences align with more than half of the
    neighbours; beside an article element none of them is content. Null html counts as empty; a page
    without text gives an empty text. Null or odd urls form a host of their own. Repeated rows get
    the same text. In an article, blocks named as menus, adverts, sidebars, notices, sign-ups, teasers
    or comments go; those of a name that may be a topic go if the subsequences align them with most neighbours.

    The order is a global one, found by a range sort of line hashes and per-partition offsets, so a
    host may hold any part of the pages. Texts stay where they are read unless the pages with lines
    to delete are many; then they are joined by a shuffle.
    """
    host = F.coalesce(F.lower(F.regexp_extract("__url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("__url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").alias("__url"), F.col(f"`{html_col}`").alias("__html"))
    rows = rows.withColumn("__host", host).withColumn("__path", path)

    def frame_lines() -> Callable:
        def work(texts: list) -> list:
            return columns([line_hashes(page_blocks(t) if t else []) for t in texts], 2)

        return work

    fields = [T.StructField("__lines", T.ArrayType(T.LongType())), T.StructField("__open", T.ArrayType(T.BooleanType()))]
    hashed = map_text(rows, ["__host", "__path"], "__html", frame_lines, fields).withColumn("__key", F.xxhash64("__lines", "__open"))
    alike = hashed.groupBy("__host", "__key").agg(F.min("__path").alias("__path"), F.first("__lines").alias("__lines"), F.first("__open").alias("__open"))
    alike = written(alike, "page-lines")
    # numbered in the order of host, path and content
    parts = int(alike.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["__host", "__path", "__key"]
    placed = stable(alike.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    # rows of a partition are numbered from partition << 33: one count per partition makes the numbers run on
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("__at", F.col("__start") + F.col("__place").bitwiseAND((1 << 33) - 1))  # one row per partition
    turns = [s for d in range(1, max(1, neighbours // 2) + 1) for s in (-d, d)]
    sent = numbered.select(F.explode(F.array(*[F.col("__at") + t for t in turns])).alias("__at"), F.col("__host").alias("__other_host"), F.col("__lines").alias("__other"))
    # every place gets one row from each turn
    given = sent.groupBy("__at").agg(F.collect_list(F.struct("__other_host", "__other")).alias("__near"))
    near = F.transform(F.filter(F.coalesce("__near", F.array()), lambda x: x["__other_host"] == F.col("__host")), lambda x: x["__other"])
    ready = numbered.join(given, "__at", "left").select("__host", "__key", "__lines", "__open", near.alias("__near"))
    schema = T.StructType([ready.schema["__host"], ready.schema["__key"], T.StructField("__gone", T.ArrayType(T.IntegerType()))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, gone = [], []
            for i, (mine, open_, others) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                votes = Counter(k for other in others for k in aligned(mine, other))
                # what markup has settled stays as it is: text of the article, or frame that differs from page to page
                shared = sorted(k for k, n in votes.items() if 2 * n > len(others) and open_[k])
                if shared:
                    keep.append(i)
                    gone.append(shared)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(gone, pa.list_(pa.int32()))], names=schema.names)

    found = written(ready.mapInArrow(align, schema), "page-decisions")
    found = found.select(F.col("__host").alias("__host2"), F.col("__key").alias("__key2"), "__gone")

    def texts() -> Callable:
        def work(pages_: list) -> list:
            out = []
            for t in pages_:
                own = page_blocks(t) if t else []
                body = any(zone >= 2 for _, zone in own)
                # of a page with an article only the article is left here, of others what isn't frame
                left = [(line, k) for k, (line, zone) in enumerate(own) if zone >= (2 if body else 1)]
                out.append((*line_hashes(own), [line for line, _ in left], [k for _, k in left]))
            return columns(out, 4)

        return work

    fields = [*fields, T.StructField("__texts", T.ArrayType(T.StringType())), T.StructField("__spots", T.ArrayType(T.IntegerType()))]
    parsed = map_text(rows, ["__id", "__url", "__host"], "__html", texts, fields).withColumn("__key", F.xxhash64("__lines", "__open"))
    joined = parsed.join(found, (F.col("__host") == F.col("__host2")) & (F.col("__key") == F.col("__key2")), "left")
    stays = F.filter("__texts", lambda _, i: ~F.coalesce(F.array_contains("__gone", F.get("__spots", i)), F.lit(False)))
    out = joined.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), F.array_join(stays, "\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
