"""Main text of web pages by nearest-URL page differencing.

Exact copies on a host are one page. Pages are sorted by host and URL path, and
runs of near copies (lines of a fifth of the weight differ; numbers and dates
weigh nothing) stand together; each page is paired with the nearest pages of
different content on either side, of which those that share the longest path
with it count. Lines (blocks of text) of a page that also stand, in the same
order, in such a page (longest common subsequence) are the template of the site
and deleted. Lines of menus, headers, footers, sidebars, adverts, forms,
comments and the like go by their markup, but never an article or main below it
that is the page's own, nor what only looks like layout and holds the page.
Lines inside an article or main element are not deleted for standing in one
other page: two pages may carry one text. They go, as all others do, if they
stand on many different pages of the host (``MANY`` and ``SHARE``), those in
articles if they do so in articles.

The sorted order is cut into parts; each part also gets the next pages of
different runs from beyond its borders, so every page is paired wherever the
cuts fall. Only hashes and weights of lines travel.

Defined cases: a null or empty html gives an empty text; a page without a
different one on its host keeps all lines that markup allows; a page whose lines
all stand in the page it is paired with keeps them; rows equal in
id, url and html share one result.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import land

# Element names of the HTML standard by what they hold.
SKIPPED = frozenset("head script style noscript template iframe object svg math canvas audio video map form button select option textarea input label fieldset nav footer aside menu dialog datalist".split())
RAW = frozenset("script style textarea title xmp noframes iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul aside dialog""".split())
INLINE_BREAKS = frozenset(["br", "wbr"])
#: Words of class, id and role that mark what is no main text.
OFF_WORDS = frozenset("""ad ads advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices
alert newsletter subscribe subscription signup popup modal overlay sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs
footer header masthead topbar toolbar share sharing social related recommended recommendations comment comments reply replies respond discussion disqus
pagination pager login search searchbox complementary contentinfo skip paywall""".split())
#: Whole names of boilerplate, besides OFF_WORDS. In an article only whole names count.
OFF_NAMES = OFF_WORDS | frozenset("""ad-banner ad-container ad-slot ad-unit ad-wrapper adsbygoogle google-ad comment-form comment-list comment-respond comments-area comments-list
comments-section cookie-banner cookie-consent cookie-notice email-signup more-stories nav-links nav-menu main-nav site-nav site-header site-footer site-navigation main-navigation
post-navigation newsletter-form newsletter-signup recommended-articles related-articles related-content related-links related-news related-posts related-stories search-form
share-bar share-buttons share-links sharing-buttons sidebar-left sidebar-right skip-link social-icons social-links social-media social-share sponsored-content""".split())
#: Names that in an article are as often its own parts: a headline's box, admonitions, a section called so.
OWN_PARTS = frozenset("alert banner banners discussion header masthead navigation notice notices related search skip".split())
INSIDE_NAMES = OFF_NAMES - OWN_PARTS
#: In an article these are as often tokens of listed code.
INLINE_NAMES = INSIDE_NAMES - frozenset("comment comments reply replies".split())
#: Lists of what others wrote: no wrapper of a page, however long.
TALK = frozenset("comment comments reply replies respond discussion disqus related recommended recommendations".split())
#: Skipped elements that a page shows and that may hold an article.
SHOWN = frozenset("nav footer aside menu form fieldset label dialog".split())
#: Pages of one part of the sorted order.
PART = 10_000
#: Pages of which lines of at most this share of the weight differ are copies.
NEAR = 0.2
#: Lines on so many different pages and on this share of all different pages of a host are the site's.
MANY = 10
SHARE = 1 / 3
NUMBERS = re.compile(r"\d[\d\s.,:/-]*")
TAG_NAME = re.compile(r"/?[a-zA-Z]")
NAME_END = re.compile(r"[\s/>]")
TAG_START = re.compile(r"<[a-zA-Z/!?]")
SIGNS = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
SPACES = re.compile(r"\s+")


#: Why an element goes: not; perhaps, unless it holds the page; with what it holds but articles; whatever it holds.
KEPT, LAYOUT, BOILERPLATE, HIDDEN = range(4)


def _off(name: str, attributes: str, inside: bool = False) -> int:
    """What the markup of an element says of it; ``inside`` an article only whole class and role names count."""
    found = KEPT
    if name in SKIPPED:
        found = LAYOUT if name == "form" else BOILERPLATE if name in SHOWN else HIDDEN
    if not attributes:
        return found
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden":
            return HIDDEN
        if name in ("html", "body", "main"):
            continue
        if key == "aria-hidden" and value == "true":
            found = max(found, BOILERPLATE)
        elif key in ("class", "id", "role"):
            names = value.split()
            if name == "article":
                # An article of its own among comments or teasers.
                if key == "class" and not TALK.isdisjoint(names):
                    found = max(found, BOILERPLATE)
            elif inside:
                # Sections carry slugs of their headings as id.
                if key == "role" and not OFF_WORDS.isdisjoint(names) or key == "class" and not (INSIDE_NAMES if name in BLOCKS else INLINE_NAMES).isdisjoint(names):
                    found = max(found, BOILERPLATE)
                elif key == "id" and not (OFF_NAMES - OFF_WORDS | {"comments", "respond"}).isdisjoint(names):
                    found = max(found, BOILERPLATE)
            elif not OFF_NAMES.isdisjoint(names):
                found = max(found, BOILERPLATE)
            elif not OFF_WORDS.isdisjoint(SPLIT.split(value)):
                found = max(found, LAYOUT if TALK.isdisjoint(SPLIT.split(value)) else BOILERPLATE)
    return found


#: Where a line stands: elsewhere on the page, in an article, in what markup rules out.
PLAIN, ARTICLE, OFF = range(3)


class _Tags:
    """The tags of a page in order, in time linear in its length.

    A start without an end is text. What has been found out about the ends of
    names, quotes and tags is remembered, so that no stretch is searched again
    for every ``<`` before it.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in (">", '"', "'")}
        self.names = (-1, -1)             # a stretch without the end of a name
        self.ends: dict[int, int] = {}    # ends of tags by where their attributes begin
        self.dead: set[int] = set()       # quotes from which no end follows

    def _name_end(self, at: int) -> int:
        first, end = self.names
        if not first <= at < end:
            found = NAME_END.search(self.page, at)
            end = found.start() if found else len(self.page)
            self.names = (at, end)
        return end

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at ``at``: the next ``>`` outside quotes, or -1."""
        if at in self.ends:
            return self.ends[at]
        page, seen, place, found = self.page, [], at, -1
        while place <= max(self.last.values()):
            sign = SIGNS.search(page, place).start()
            if page[sign] == ">":
                found = sign
                break
            if sign in self.dead or sign == self.last[page[sign]]:
                break
            seen.append(sign)
            place = page.index(page[sign], sign + 1) + 1
        if found < 0:
            self.dead.update(seen)
        self.ends = {at: found}
        return found

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """``(start, end, closing, name, attributes)`` of the first tag from ``at``; comments and declarations have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                return start, stop + 3 if stop >= 0 else len(page), False, None, ""
            if start > self.last[">"]:
                return None
            if page.startswith(("<!", "<?"), start):
                return start, page.index(">", start) + 1, False, None, ""
            if TAG_NAME.match(page, start + 1):
                closing = page[start + 1] == "/"
                first = start + 1 + closing
                name_end = self._name_end(first)
                end = self._end(name_end)
                if end >= 0:
                    return start, end + 1, closing, page[first:name_end], page[name_end:end]
            at = start + 1
        return None


class _Open:
    """An open element and what it takes over from those around it; ``layout`` is the innermost layout element that counts, or -1."""

    __slots__ = ("name", "off", "inside", "layout", "second", "link", "own")

    def __init__(self, name: str | None, off: int = KEPT, inside: bool = False, layout: int = -1, second: bool = False, link: bool = False, own: int = -1):
        self.name, self.off, self.inside, self.layout, self.second, self.link, self.own = name, off, inside, layout, second, link, own


PAGE = _Open(None)


class _Stack:
    """The open elements, with the places of each name and the text counted inside layout elements."""

    def __init__(self):
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.total = [0, 0]               # characters in articles, and outside links
        self.held: list[list[int]] = []   # the same for each layout element: minus the total at its start, plus that at its end
        self.parents: list[int] = []      # the layout element around each

    def top(self) -> _Open:
        return self.open[-1] if self.open else PAGE

    def push(self, name: str, attributes: str) -> None:
        top = self.top()
        inside = top.inside or name in ("article", "main")
        here = BOILERPLATE if name == "header" and not top.inside else _off(name, attributes, top.inside)
        off, layout, second, own = top.off, top.layout, top.second, -1
        if name in ("article", "main") and off < HIDDEN and here < HIDDEN:
            # Back from what is off around it; below boilerplate it counts if the page has no other.
            second = second or off == BOILERPLATE or here == BOILERPLATE
            off, layout = KEPT, -1
        elif here == LAYOUT:
            own = len(self.held)
            self.parents.append(layout)
            self.held.append([-t for t in self.total])
            layout = own
        else:
            off = max(off, here)
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append(_Open(name, off, inside, layout, second, top.link or name == "a", own))

    def cut(self, size: int) -> None:
        """Close all elements from place ``size`` on."""
        while len(self.open) > size:
            element = self.open.pop()
            self.places[element.name].pop()
            if element.own >= 0:
                for k in (0, 1):
                    self.held[element.own][k] += self.total[k]

    def end(self, name: str) -> None:
        if self.places.get(name):
            self.cut(self.places[name][-1])

    def follow(self, name: str, within: tuple) -> None:
        """Close an open element that the next one ends, if no element of ``within`` lies between."""
        if self.places.get(name):
            at = self.places[name][-1]
            if all(not self.places.get(w) or self.places[w][-1] < at for w in within):
                self.cut(at)


def lines(page: str) -> list[tuple[str, int]]:
    """The blocks of text of a page in order, and where each stands.

    An article or main counts again below an element that is off. What only
    looks like layout (a form, a name like ``has-sidebar``) stays if it holds
    at least half of the articles, or of the text outside links on a page
    without any. An article below boilerplate (an aside, a list of comments)
    counts on pages that have no other.
    """
    out: list[tuple[str, int, int, bool]] = []
    text: list[str] = []
    dropped: list[str] = []
    stack, tags = _Stack(), _Tags(page)

    def add(piece: str) -> None:
        top = stack.top()
        (dropped if top.off else text).append(piece)
        if not top.off and not top.second:
            n = len(piece.strip())
            stack.total[0] += n * top.inside
            stack.total[1] += n * (not top.link)

    def close() -> None:
        top = stack.top()
        for held, off in ((text, False), (dropped, True)):
            if held:
                line = SPACES.sub(" ", entities.unescape("".join(held))).strip()
                if line:
                    out.append((line, OFF if off else ARTICLE if top.inside else PLAIN, -1 if off else top.layout, top.second))
                held.clear()

    at, end = 0, len(page)
    while at < end:
        tag = tags.next(at)
        if tag is None:
            # A tag that never ends is no text.
            cut = TAG_START.search(page, at)
            add(page[at : cut.start() if cut else end])
            break
        start, after, closing, name, attributes = tag
        if start > at:
            add(page[at:start])
        at = after
        if name is None:
            continue
        name = name.lower()
        if not closing:
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if name in BLOCKS:
                    close()
                at = stop.end() if stop else end
                continue
            if name in VOID:
                if name in BLOCKS:
                    close()
                elif name in INLINE_BREAKS:
                    add(" ")
                continue
            if name in BLOCKS:
                close()
                if name == "p":
                    stack.follow("p", ("div", "article", "section", "body", "td", "li", "blockquote", "main"))
                elif name == "li":
                    stack.follow("li", ("ul", "ol", "menu"))
            if not attributes.rstrip().endswith("/") or name in BLOCKS:
                stack.push(name, attributes)
        else:
            if name in BLOCKS:
                close()
            stack.end(name)
    close()
    stack.cut(0)
    total = stack.total
    kind = 0 if total[0] else 1
    # A line goes with any layout element around it that goes.
    gone = []
    for held, parent in zip(stack.held, stack.parents, strict=True):
        gone.append(not total[kind] or 2 * held[kind] < total[kind] or parent >= 0 and gone[parent])
    lost = lambda layout: layout >= 0 and gone[layout]
    first = any(place == ARTICLE and not second and not lost(layout) for _, place, layout, second in out)
    return [(line, OFF if second and first or lost(layout) else place) for line, place, layout, second in out]


def common(a: list[int], b: list[int]) -> list[int]:
    """Places of ``a`` on a longest common subsequence with ``b``: equal ends first, then by bits of one word per row."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = [*range(head), *range(len(a) - tail, len(a))]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y and not set(x).isdisjoint(y):
        # Bit j of row i is clear where the common length grows at y[j]: Hyyro's recurrence, one big integer a row.
        width = len(y)
        full = (1 << width) - 1
        places: dict[int, list[int]] = {}
        for j, v in enumerate(y):
            places.setdefault(v, []).append(j)
        often = {v: sum(1 << j for j in at) for v, at in places.items() if len(at) > 64}
        # Of n rows some sqrt(n) are kept, and those between made again on the way back.
        stride = max(1, int(len(x) ** 0.5))
        kept, row = [full], full

        def following(row: int, v: int) -> int:
            mask = often.get(v, 0)
            if not mask:
                for j in places.get(v, ()):
                    mask |= 1 << j
            hit = row & mask
            return ((row + hit) | (row - hit)) & full if hit else row

        for i, v in enumerate(x):
            row = following(row, v)
            if (i + 1) % stride == 0:
                kept.append(row)
        j, rows, low = width, [], len(x)
        for i in range(len(x) - 1, -1, -1):
            if i < low:
                low = i // stride * stride
                rows = [kept[low // stride]]
                for v in x[low : i + 1]:
                    rows.append(following(rows[-1], v))
            below, row = rows[i - low], rows[i - low + 1]
            # Length of the row's prefix y[:j] with and without x[i].
            mask = (1 << j) - 1
            if (mask & ~row).bit_count() > (mask & ~below).bit_count():
                found.append(head + i)
                need = (mask & ~row).bit_count()
                while (((1 << (j - 1)) - 1) & ~row).bit_count() == need:
                    j -= 1
                j -= 1
    return sorted(found)


def _hash(line: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line.encode()) - (1 << 63)


def _rows(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    url = F.col("url").cast("string").alias("url")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url, html).withColumn("k_page", F.xxhash64(F.coalesce("url", F.lit("")), "html"))


def near(a: list[int], b: list[int], wa: list[int], wb: list[int]) -> bool:
    """Whether two pages are copies but for lines that weigh little, such as dates."""
    x, y = sum(map(abs, wa)), sum(map(abs, wb))
    if min(x, y) < (1 - NEAR) * max(x, y):
        return False
    shared = sum(abs(wa[i]) for i in common(a, b))
    return shared >= (1 - NEAR) * max(x, y)


def _runs(host: list, line: list, weight: list) -> list[int]:
    """The run of each page: neighbours on one host that are near the first page of the run."""
    out, first = [], 0
    for i in range(len(host)):
        if i and (host[i] != host[first] or not near(line[first], line[i], weight[first], weight[i])):
            first = i
        out.append(first)
    return out


def _lists(pdf: pd.DataFrame) -> tuple[list, list, list]:
    return pdf["host"].tolist(), [x.tolist() for x in pdf["lines"]], [x.tolist() for x in pdf["weights"]]


ORDER = ["host", "path", "content"]


def repeated_lines(placed: DataFrame) -> DataFrame:
    """``host, line, inside``: lines on many different pages of a host, ``inside`` those that are so in articles.

    One page of a run has a vote, and pages with the same longest line have one
    together (for that line: with the same second). Lines found no longer
    count as the longest, which may let more be found.
    """

    def votes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, often = _noted(pdf)
        host, line, weight = _lists(pdf)
        rows = []
        for i, first in enumerate(_runs(host, line, weight)):
            if i != first:
                continue
            gone = {v for v, _ in often.get(host[i], ())}
            inside = any(w < 0 for w in weight[i])
            longest = sorted({(abs(w), v) for v, w in zip(line[i], weight[i], strict=True) if (w < 0 or not inside) and v not in gone}, reverse=True)[:2]
            one, two = ([v for _, v in longest] + [0, 0])[:2]
            rows.append((host[i], True, 0, False, hash((one, two))))
            rows.extend((host[i], False, v, at, two if v == one else one) for v, at in {(v, w < 0) for v, w in zip(line[i], weight[i], strict=True)})
        return pd.DataFrame(rows, columns=["host", "page", "line", "inside", "key"])

    known, size = None, 0
    while True:
        cast = _with_noted(placed, known).groupBy("part").applyInPandas(votes, "host string, page boolean, line long, inside boolean, key long").distinct()
        many = land(cast.groupBy("host", "page", "line", "inside").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MANY), "line-votes")
        pages = many.where("page").select("host", F.col("n").alias("pages"))
        often = many.where("not page").join(pages, "host").where(F.col("n") >= F.col("pages") * SHARE).select("host", "line", "inside")
        often = often if known is None else often.unionByName(known).distinct()
        known = land(often, "site-lines")
        grown = known.count()
        if grown == size:
            return known
        size = grown


def _with_noted(placed: DataFrame, known: DataFrame | None) -> DataFrame:
    """``placed`` and, in each part, a row without a path for each of its hosts: the lines known to be the host's."""
    if known is None:
        return placed
    noted = known.groupBy("host").agg(F.collect_list("line").alias("lines"), F.collect_list(F.when(F.col("inside"), -1).otherwise(1)).alias("weights"))
    noted = placed.select("part", "host").distinct().join(noted, "host").select(*[F.col(c) if c in ("part", "host", "lines", "weights") else F.lit(None).cast(t).alias(c) for c, t in placed.dtypes])
    return placed.unionByName(noted)


def _noted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    """The pages of a part in order, and the known lines of its hosts."""
    host, line, weight = _lists(pdf[pdf["path"].isna()])
    often = {h: set(zip(v, w, strict=True)) for h, v, w in zip(host, line, weight, strict=True)}
    return pdf[pdf["path"].notna()].sort_values(ORDER, ignore_index=True), often


def _edges(placed: DataFrame, parts: list[int]) -> DataFrame:
    """The pages beyond each part's borders: of the first two runs on either side, over further parts where a part is one run."""

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER, ignore_index=True)
        runs = _runs(*_lists(pdf))
        firsts = sorted(set(runs))
        lasts = [i - 1 for i in firsts[1:]] + [len(pdf) - 1]
        out = pd.concat([pdf.loc[firsts[:2]].assign(behind=True), pdf.loc[lasts[-2:]].assign(behind=False)])
        return out.assign(runs=len(firsts))

    found = land(placed.groupBy("part").applyInPandas(ends, "host string, path string, content binary, lines array<long>, weights array<int>, part int, behind boolean, runs int"), "part-ends")
    runs = dict(found.select("part", "runs").distinct().collect())
    links = []
    for at in range(len(parts)):
        for behind, others in ((True, parts[at + 1 :]), (False, parts[:at][::-1])):
            for other in others:
                links.append((parts[at], other, behind))
                if runs[other] > 1:
                    break
    # A few rows per part of the sort.
    linked = placed.sparkSession.createDataFrame(links or [(-1, -1, True)], "part int, other int, behind boolean")
    return linked.join(found.withColumnRenamed("part", "other"), ["other", "behind"]).select("part", *ORDER, "lines", "weights", F.lit(False).alias("own"))


def shared_lines(rows: DataFrame) -> DataFrame:
    """``page_id, k_page, gone``: the places, among the lines that markup allows, of those that are the site's."""

    def hashed(batches):
        import xxhash

        for batch in batches:
            found = [[(t, p) for t, p in lines(page) if p != OFF] for page in batch.column("html").to_pylist()]
            hashes = [[_hash(t) for t, _ in page] for page in found]
            weights = [[(1 + len(NUMBERS.sub("", t))) * (-1 if p == ARTICLE else 1) for t, p in page] for page in found]
            content = [xxhash.xxh128_digest(np.array(h, np.int64).tobytes() + np.array(w, np.int32).tobytes()) for h, w in zip(hashes, weights, strict=True)]
            arrays = [pa.array(content, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "k_page", "url")), *arrays], names=["page_id", "k_page", "url", "content", "lines", "weights"])

    found = rows.mapInArrow(hashed, "page_id long, k_page long, url string, content binary, lines array<long>, weights array<int>")
    plain = F.regexp_replace(F.lower("url"), r"^[a-z][a-z0-9+.-]*://", "")
    host, path = F.regexp_extract(plain, r"^([^/?#]*)", 1), F.regexp_extract(plain, r"^[^/?#]*([^?#]*)", 1)
    found = found.select("page_id", "k_page", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "content", "lines", "weights")
    found = land(found.where("host <> '' and size(lines) > 0"), "page-lines")
    # Exact copies are one page, at the first of their paths.
    contents = found.groupBy("host", "content").agg(F.min("path").alias("path"), F.first("lines").alias("lines"), F.first("weights").alias("weights"))
    parts = max(1, -(-rows.count() // PART))
    placed = land(contents.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id()), "page-contents")
    placed = placed.select(*ORDER, "lines", "weights", "part")
    # One number per part of the sort: few, and needed in order.
    parts = sorted(r["part"] for r in placed.select("part").distinct().collect())
    if not parts:
        return found.select("page_id", "k_page", F.lit(None).cast("array<int>").alias("gone"))
    columns = ["part", *ORDER, "lines", "weights", "own"]
    both = placed.withColumn("own", F.lit(True)).select(*columns)
    if len(parts) > 1:
        both = both.unionByName(_edges(placed, parts))
    both = _with_noted(both, repeated_lines(placed))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, often = _noted(pdf)
        host, line, weight = _lists(pdf)
        path, own = pdf["path"].tolist(), pdf["own"].to_numpy(dtype=bool)
        runs = _runs(host, line, weight)
        last = {first: i for i, first in enumerate(runs)}
        gone: list[list[int]] = []
        for i in range(len(pdf)):
            if not own[i]:
                gone.append([])
                continue
            many = often.get(host[i], ())
            places = {k for k, (v, w) in enumerate(zip(line[i], weight[i], strict=True)) if (v, -1) in many or w > 0 and (v, 1) in many}
            different = []
            for step in (-1, 1):
                j = runs[i] - 1 if step < 0 else last[runs[i]] + 1
                while 0 <= j < len(pdf) and host[j] == host[i]:
                    if not near(line[i], line[j], weight[i], weight[j]):
                        different.append(j)
                        break
                    j = runs[j] - 1 if step < 0 else last[runs[j]] + 1
            steps = [_shared_path(path[i], path[j]) for j in different]
            for j, s in zip(different, steps, strict=True):
                if s == max(steps):
                    shared = common(line[i], line[j])
                    if len(shared) < len(line[i]):  # else it is all in the other
                        places.update(k for k in shared if weight[i][k] > 0)
            gone.append(sorted(places))
        pdf["gone"] = gone
        return pdf[own & np.array([len(g) > 0 for g in gone], bool)][["host", "content", "gone"]]

    cut = both.groupBy("part").applyInPandas(match, "host string, content binary, gone array<int>")
    return found.select("page_id", "k_page", "host", "content").distinct().join(cut, ["host", "content"]).select("page_id", "k_page", "gone")


def _shared_path(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    rows = _rows(pages)
    gone = land(shared_lines(rows), "shared-lines")
    if not gone.head(1):
        joined = rows.select("page_id", "url", "html", F.lit(None).cast("array<int>").alias("gone"))
    else:
        joined = rows.join(gone, (rows.k_page == gone.k_page) & rows.page_id.eqNullSafe(gone.page_id), "left").select(rows.page_id, "url", "html", "gone")

    def cut(batches):
        for batch in batches:
            texts = []
            for page, places in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                drop = set(places or ())
                texts.append("\n".join(t for i, t in enumerate(t for t, place in lines(page) if place != OFF) if i not in drop))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(cut, "page_id long, url string, text string, n_chars long")
