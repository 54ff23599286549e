"""Main text of web pages by differencing each page against those with the nearest URLs.

1. A page becomes lines of text, one for each block, with what its mark-up surely says of them: FRAME for lines in
   elements that are never article text (navigation, asides, what a class, id or role names as such), MAIN for lines
   in an article or main element, OPEN for all others. FRAME lines go.
2. All pages with other lines are differenced. Pages of a host with equal lines and mark-up are one page here; the
   pages of a host are ordered by URL path and cut into blocks of about BLOCK, by ranks that are counted without
   gathering a host in one task. A block also sees the last and first pages of the blocks beside it and two unlike
   pages of the whole host (see landmarks()).
3. The lines of a page are aligned by longest common subsequence with those of the others. A page's near copies would
   take its article for the site's: only pages that share no more than half-way between the least part that any of
   them shares and all of its characters vote. Of these the VOTES nearest in order vote on the OPEN lines of a page
   without MAIN lines, and lines shared with more than half of them are deleted: they belong to the site. Lines that
   one or two pages share, as quotations, stay.
4. Where a page has MAIN lines, its text is those that differencing leaves. Mark-up speaks for them, so four pages
   that share a licence line aren't enough: all pages in sight vote, near copies of each other as one, and with VOTES
   or more votes a line goes if more than half of the nearer and more than half of the farther ones share it. So what
   a run of half the pages in sight has in common stays. A heading goes only with all lines of its section, and a line of a list
   or table only with all of them: repeated headings and labels are article text.

Differencing can't decide alone: menus and adverts that differ from page to page are shared with nobody. Mark-up also
breaks its ties: on a page whose host has no other page, lines in a header element go.

Names decide on containers only, never on headings, paragraphs, items or words in a line: those carry slugs of their own
text as ids. Inside an article an id alone says nothing, as its sections have slugs too. What a class, id or form says is weak: an element with more than half of the page's text is no frame, unless article
text is outside of it or it is named as comments; a name counts only if all its words are frame words or words of
layout (related-posts, not related-work). Where several article elements hold less than what is outside of them,
they are teasers, and all lines are OPEN.

Defined cases: null, empty and unparsable html give an empty text; a null url is a host and path of its own
("" and ""); where all lines of a page are shared, differencing can't tell and all stay; repeated rows are pages
each; equal paths are ordered by their lines' hash; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, grouped, parts, small, weighted_lookup, written

VOTES, BLOCK = 4, 32
OPEN, MAIN, FRAME, HEADER = 0, 1, 2, 3

#: A line's mark: its kind, HEADING if it is one, and GROUP times the number of the list or table that it is in.
KIND, HEADING, GROUP = 3, 4, 8

#: HTML's elements by what they do to text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_FRAME_ELEMENTS = frozenset("nav aside footer menu dialog search button select option datalist object svg canvas audio video map head".split())
_FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of names of frames, and words of layout that may stand beside them.
_FRAME_WORDS = frozenset("ad ads advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets comment comments reply replies respond discussion disqus footer masthead share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay paywall search pagination pager toolbar skip hidden".split())
_LAYOUT_WORDS = frozenset("area article articles bar block body bottom box buttons center col column container content entry form global group header inner item items left link links list main middle mobile outer page panel post posts primary region right row secondary section site slot sticky text title top unit user wrap wrapper".split())
_COMMENT_WORDS = frozenset("comment comments reply replies respond discussion disqus".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_GROUPS = frozenset("ul ol dl table".split())
_KEPT_ELEMENTS = frozenset("html body main".split())
#: Elements that hold others, so that a name can say what they hold.
_CONTAINERS = frozenset("div section article header form fieldset ul ol dl table tbody tr td details center blockquote figure".split())
_P_CLOSERS = _BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "dt", "dd", "li"}

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SURE, WEAK, COMMENTS = 1, 2, 3


def _frame(tag: str, attributes: str, in_article: bool = False) -> int:
    """How an element says that it is a frame: not at all (0), SURE, WEAK, or WEAK as COMMENTS."""
    if tag in _KEPT_ELEMENTS:
        return 0
    if tag in _FRAME_ELEMENTS:
        return SURE
    found = WEAK if tag == "form" else 0
    for m in _ATTRIBUTE.finditer(attributes) if len(attributes) > 2 else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SURE
        if tag not in _CONTAINERS:
            continue
        if name == "role" and value.strip().lower() in _FRAME_ROLES:
            found = max(found, WEAK)
        if name == "class" or name == "id" and not in_article:
            for token in value.split():
                words = {w.lower() for w in _WORD.findall(token)}
                if words & _FRAME_WORDS and words <= _FRAME_WORDS | _LAYOUT_WORDS:
                    found = max(found, COMMENTS if words & _COMMENT_WORDS else WEAK)
    return found


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each block with text, in page order."""
    return [(text, mark & KIND) for text, mark in marked(page)]


def marked(page: str | None) -> list[tuple[str, int]]:
    """(text, mark) of each block with text, in page order."""
    page = page or ""
    out: list[tuple[str, bool, bool, bool, tuple[int, ...]]] = []  # text, sure frame, main, header, weak elements
    marks: list[int] = []  # of out, without the kind
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # element, whether a sure frame, main, a header; number of a weak one
    weak: list[int] = []  # how each weak element says it
    groups: list[int] = []  # numbers of the open lists and tables
    frames = mains = headers = articles = main_elements = headings = seen = 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, frames > 0, mains > 0, headers > 0, tuple(s[4] for s in stack if s[4] >= 0)))
                marks.append(HEADING * (headings > 0) + GROUP * (groups[-1] if groups else 0))

    def pop() -> None:
        nonlocal frames, mains, headers, headings
        tag, frame, main, header, _ = stack.pop()
        frames, mains, headers, headings = frames - frame, mains - main, headers - header, headings - (tag in _HEADINGS)
        if tag in _GROUPS or main:
            groups.pop()

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag in _BLOCKS:
            flush()
        if m[1]:
            if any(s[0] == tag for s in stack):
                if tag not in _BLOCKS:
                    flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _P_CLOSERS and stack and stack[-1][0] == "p" or tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            pop()
        says, header = _frame(tag, m[3], bool(m[3]) and any(x[0] == "article" for x in stack)), tag == "header" and not mains
        main = tag in ("article", "main")
        if tag in _VOID or m[3].rstrip().endswith("/") and tag not in _BLOCKS:
            continue
        if says or main or tag in _BLOCKS:
            if tag not in _BLOCKS:
                flush()
            articles, main_elements = articles + (tag == "article" and not mains), main_elements + (tag == "main")
            stack.append((tag, says == SURE, main, header, len(weak) if says > SURE else -1))
            if says > SURE:
                weak.append(says)
            frames, mains, headers, headings = frames + (says == SURE), mains + main, headers + header, headings + (tag in _HEADINGS)
            if tag in _GROUPS:
                seen += 1
                groups.append(seen)
            elif main:  # what an article is in says nothing of its lines
                groups.append(0)
    held.append(page[at:])
    flush()
    return [(text, kind + mark) for (text, kind), mark in zip(_kinds(out, weak, articles > 1 and not main_elements), marks, strict=True)]


def _kinds(found: list[tuple[str, bool, bool, bool, tuple[int, ...]]], weak: list[int], teasers: bool) -> list[tuple[str, int]]:
    """(text, kind), with weak frames taken back where they hold most of the page."""
    of = [0] * len(weak)
    for text, sure, _, _, elements in found:
        for e in elements if not sure else ():
            of[e] += len(text)
    total = sum(len(x[0]) for x in found if not x[1])
    frames = set(range(len(weak)))
    for e, says in enumerate(weak):
        if of[e] * 2 > total and not any(x[2] and not x[1] and e not in x[4] for x in found) and (says != COMMENTS or of[e] == total):
            frames.discard(e)
    out = [(text, FRAME if sure or not frames.isdisjoint(elements) else MAIN if main else HEADER if header else OPEN) for text, sure, main, header, elements in found]
    if teasers and sum(len(t) for t, k in out if k in (OPEN, HEADER)) > sum(len(t) for t, k in out if k == MAIN):
        out = [(t, OPEN if k == MAIN else k) for t, k in out]
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence, by bit-parallel rows and a walk back.

    Of the rows every step-th is held and those between are made again, and only lines that are frequent in b
    have masks that are held, so that long pages take little memory.
    """
    here, there = set(a), set(b)
    at, to = [i for i, x in enumerate(a) if x in there], [j for j, x in enumerate(b) if x in here]
    where: dict = {}
    for j, x in enumerate(to):
        where.setdefault(b[x], []).append(j)
    masks = {x: sum(1 << j for j in places) for x, places in where.items() if len(places) > 31}
    full, step = (1 << len(to)) - 1, math.isqrt(len(at)) + 1

    def row(v: int, i: int) -> int:
        x = a[at[i]]
        u = v & (masks[x] if x in masks else sum(1 << j for j in where[x]))
        return ((v + u) | (v - u)) & full

    held, v = [full], full
    for i in range(len(at)):
        v = row(v, i)
        if (i + 1) % step == 0:
            held.append(v)
    out, j = [], len(to)
    for k in reversed(range(len(held))):
        rows = [held[k]]
        for i in range(k * step, min((k + 1) * step, len(at))):
            rows.append(row(rows[-1], i))
        i = len(rows) - 1
        while i and j:  # a zero bit: the subsequence grows there
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((at[k * step + i], to[j]))
    return out[::-1]


Page = tuple[int, list[int], list[int]]  # rank, hashes of lines, their lengths
Shared = tuple[list[int], float, tuple[int, int]]  # positions of shared lines, their part, (distance, rank)


def aligned(page: Page, other: Page) -> tuple[list[int], float]:
    """Positions of a page's lines shared with another, and their part of its characters."""
    if set(page[1]).isdisjoint(other[1]):
        return [], 0.0
    shared = [i for i, _ in common(page[1], other[1])]
    return shared, sum(page[2][i] for i in shared) / max(sum(page[2]), 1)


def half_way(shares) -> float:
    """Half-way between the least part that is shared, if any, and all."""
    return (1 + min((x for x in shares if x > 0), default=0.0)) / 2


def unlike(page: Page, others: list[Page]) -> list[Shared]:
    """What a page shares with each of those that aren't its near copies, nearest first."""
    found = [(*aligned(page, x), (abs(x[0] - page[0]), x[0])) for x in others]
    most = half_way(part for _, part, _ in found)
    return sorted((x for x in found if x[1] <= most), key=lambda x: x[2])


def voted(page: Page, others: list[Page]) -> list[int]:
    """Positions of the lines of a page that stay. others: at least one page of its host, none of equal lines."""
    near = unlike(page, others)[:VOTES]
    votes = [0] * len(page[1])
    for shared, _, _ in near:
        for i in shared:
            votes[i] += 1
    return [i for i, n in enumerate(votes) if 2 * n <= len(near)] or list(range(len(votes)))


def classes(pages: list[Page]) -> dict[int, int]:
    """The rank of each page's class: that of the first page of which it is a near copy."""
    lengths = [dict(zip(names, sizes, strict=True)) for _, names, sizes in pages]
    total = [max(sum(x.values()), 1) for x in lengths]
    shares = {}
    for j, b in enumerate(lengths):
        for i, a in enumerate(lengths[:j]):
            if both := a.keys() & b.keys():
                shares[i, j] = sum(map(a.__getitem__, both)) / min(total[i], total[j])
    most, first, out = half_way(shares.values()), [], {}
    for j, p in enumerate(pages):
        i = next((i for i in first if shares.get((i, j), 0.0) > most), j)
        out[p[0]] = pages[i][0]
        if i == j:
            first.append(j)
    return out


def of_site(page: Page, marks: list[int], others: list[Page], of: dict[int, int]) -> list[int]:
    """Positions of the MAIN lines of a page that belong to the site. of: the pages' classes."""
    votes: dict[int, set[int]] = {}
    for shared, _, (_, rank) in unlike(page, others):
        votes.setdefault(of[rank], set()).update(shared)
    if len(votes) < VOTES:
        return []
    main = [i for i, m in enumerate(marks) if m & KIND == MAIN]
    told = list(votes.values())  # nearest first
    halves = told[: len(told) // 2], told[len(told) // 2 :]
    gone = {i for i in main if all(2 * sum(i in x for x in half) > len(half) for half in halves)}
    if not gone:
        return []
    own = {marks[i] // GROUP for i in main if i not in gone}
    gone = {i for i in gone if marks[i] < GROUP or marks[i] // GROUP not in own}
    below = heading = False  # whether a line of the section stays; whether the line below is a heading
    for i in reversed(main):
        if marks[i] & HEADING:
            if below:
                gone.discard(i)
            below, heading = i not in gone, True
        else:
            below, heading = i not in gone or below and not heading, False
    return sorted(gone) if len(gone) < len(main) else []


def dropped(page: Page, marks: list[int], others: list[Page], of: dict[int, int]) -> list[int]:
    """Positions of the lines that differencing takes from a page's text."""
    if any(m & KIND == MAIN for m in marks):
        return of_site(page, marks, others, of)
    if not others:
        return [i for i, m in enumerate(marks) if m & KIND == HEADER]
    return sorted(set(range(len(marks))).difference(voted(page, others)))


def ranked(rows: DataFrame, group: str, order: list[str], slices: int) -> DataFrame:
    """rows with their rank from 0 in their group, and of, the group's size; no group meets in one task.

    Rows are range-partitioned and sorted; a row's rank is its place in its slice of the group and the sizes of
    the slices before. The sorted rows are written first, as a second sampling could cut the ranges elsewhere.
    """
    laid = rows.repartitionByRange(slices, group, *order).sortWithinPartitions(group, *order)
    laid = written(laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "laid-out")
    sizes = laid.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "of": F.sum("_n").over(Window.partitionBy(group))})
    out = weighted_lookup(laid, written(sizes, "slices"), [group, "_part"], "_n")
    return out.withColumn("rank", F.col("_before") + F.col("_at") - F.col("_from")).drop("_part", "_at", "_n", "_from", "_before")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), signed=True)


def _rest(page: str | None) -> tuple[list[tuple[str, int]], list[int], list[int], bytes]:
    """(text, mark) of the lines of a page that aren't FRAME, their hashes, their marks, and the key of both."""
    rest = [x for x in marked(page) if x[1] & KIND != FRAME]
    names, marks = [_hash(t) for t, _ in rest], [m for _, m in rest]
    return rest, names, marks, hashlib.blake2b(np.array([names, marks], np.int64).tobytes(), digest_size=16).digest()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each page; pages: page_id, url, html.

    Pages are parsed twice, for the hashes of their lines, which are all that is written, and for their text.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"(?:[?#].*|/|\.html?)$", "")

    def hashes(batches):
        for b in small(batches):
            names, sizes, marks, keys = [], [], [], []
            for h in b.column("html").to_pylist():
                rest, *told = _rest(h)
                for to, x in zip((names, marks, keys), told, strict=True):
                    to.append(x)
                sizes.append([len(t) for t, _ in rest])
            arrays = [pa.array(names, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int32())), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("path"), *arrays], ["host", "path", "names", "sizes", "marks", "key"])

    def texts(batches):
        for b in small(batches):
            lines, at, keys = [], [], []
            for h in b.column("html").to_pylist():
                rest, _, marks, key = _rest(h)
                at.append([i for i, m in enumerate(marks) if m & KIND == MAIN] or list(range(len(rest))))
                lines.append([rest[i][0] for i in at[-1]])
                keys.append(key)
            arrays = [pa.array(lines, pa.list_(pa.string())), pa.array(at, pa.list_(pa.int32())), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host")), *arrays], ["page_id", "url", "host", "lines", "at", "key"])

    schema = "host string, path string, names array<long>, sizes array<int>, marks array<int>, key binary"
    parsed = written(rows.select("html", host.alias("host"), path.alias("path")).mapInArrow(hashes, schema), "parsed")
    told = rows.withColumn("host", host).mapInArrow(texts, f"page_id {id_type}, url string, host string, lines array<string>, at array<int>, key binary")
    told = with_verdicts(told, verdicts(parsed))
    stays = F.filter("lines", lambda x, i: ~F.array_contains("dropped", F.get("at", i)))
    text = F.array_join(F.when(F.size("dropped") > 0, stays).otherwise(F.col("lines")), "\n")
    return told.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def with_verdicts(rows: DataFrame, told: DataFrame) -> DataFrame:
    """rows with dropped, which is null or empty where all lines stay; told as of verdicts().

    While few pages lose lines, these are broadcast. Beyond that rows are shuffled once, without those of keys with
    a large share of all pages, which meet a broadcast table.
    """
    some = told.where(F.size("dropped") > 0).select("host", "key", "dropped")
    if some.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(some), ["host", "key"], "left")
    total = told.agg(F.sum("copies")).first()[0]
    heavy = F.col("copies") >= max(1000, total // 2000)  # so at most 2000 keys
    few = told.where(heavy).select("host", "key", F.col("dropped").alias("_few"))
    alone = F.col("_few").isNotNull() | (F.size("lines") == 0)
    rows = rows.join(F.broadcast(few), ["host", "key"], "left").withColumn("_salt", F.when(alone, 1 + F.monotonically_increasing_id()).otherwise(0))
    rows = rows.join(told.where(~heavy).select("host", "key", "dropped", F.lit(0).cast("long").alias("_salt")), ["host", "key", "_salt"], "left")
    return rows.withColumn("dropped", F.coalesce("_few", "dropped")).drop("_few", "_salt")


def landmarks(blocks: DataFrame, top: int) -> DataFrame:
    """host, names and sizes of two pages of each host that are unlike, of all its blocks (to top) by ever larger ranges."""

    def two(batches):
        for t in grouped(batches, ["host", "block"]):
            pages = list(zip(t["rank"].to_pylist(), t["names"].to_pylist(), t["sizes"].to_pylist(), strict=True))
            least = min(range(len(pages)), key=lambda i: (aligned(pages[0], pages[i])[1] if i else 2.0, i))
            yield from t.take(sorted({0, least})).combine_chunks().to_batches()

    kinds, columns = "host string, block long, rank long, names array<long>, sizes array<int>", ["host", "block", "rank", "names", "sizes"]
    found = written(blocks.select(*columns).mapInArrow(two, kinds), "landmarks")
    while top:
        top //= BLOCK
        wider = found.withColumn("block", F.floor(F.col("block") / BLOCK)).repartition(parts(blocks.sparkSession), "host", "block").sortWithinPartitions("host", "block", "rank")
        found = written(wider.select(*columns).mapInArrow(two, kinds), "landmarks")
    return found.drop("block")


def verdicts(parsed: DataFrame) -> DataFrame:
    """dropped, the positions of the lines that go, and copies, for each host and key of pages with lines."""
    slices = parts(parsed.sparkSession)
    one = parsed.where(F.size("names") > 0).groupBy("host", "key")
    one = one.agg(F.min("path").alias("path"), *(F.any_value(c).alias(c) for c in ("names", "sizes", "marks")), F.count("*").alias("copies"))
    near = ranked(one, "host", ["path", "key"], slices)
    last = F.greatest(F.floor(F.col("of") / BLOCK) - 1, F.lit(0))  # the last block takes the rest
    near = near.withColumn("block", F.least(F.floor(F.col("rank") / BLOCK), last)).withColumn("last", last)
    first, end = F.col("rank") - F.col("block") * BLOCK < VOTES, (F.col("rank") % BLOCK >= BLOCK - VOTES) & (F.col("block") < F.col("last"))
    at = F.array(F.col("block"), F.when(first & (F.col("block") > 0), F.col("block") - 1), F.when(end, F.col("block") + 1))
    near = near.withColumn("_home", F.explode(F.filter(at, lambda x: x.isNotNull()))).withColumn("guest", F.col("_home") != F.col("block")).withColumn("block", F.col("_home"))
    columns = ["host", "block", "rank", "guest", "key", "names", "sizes", "marks", "copies", "last"]
    near = written(near.select(*columns).repartition(slices, "host", "block").sortWithinPartitions("host", "block", "rank"), "blocks")
    several = near.where("last > 0")
    if not several.isEmpty():
        own = several.where("not guest").repartition(slices, "host", "block").sortWithinPartitions("host", "block", "rank")
        marks = landmarks(own, several.agg(F.max("last")).first()[0])
        two = marks.groupBy("host").agg(F.collect_list(F.struct("rank", "names", "sizes")).alias("pages"))
        two = written(two.join(several.groupBy("host").agg(F.count_distinct("block").alias("n")), "host"), "landmarks")
        marks = weighted_lookup(several.groupBy("host", "block").agg(F.any_value("last").alias("last")), two, ["host"], "n")
        marks = marks.select("host", "block", F.explode("pages").alias("p"), "last").select("host", "block", "p.rank", F.lit(True).alias("guest"), F.lit(None).cast("binary").alias("key"), "p.names", "p.sizes", F.lit(None).cast("array<int>").alias("marks"), F.lit(0).cast("long").alias("copies"), "last")
        near = near.unionByName(marks)
    near = near.repartition(slices, "host", "block").sortWithinPartitions("host", "block", "rank")

    def difference(batches):
        for t in grouped(batches, ["host", "block"]):
            pages = {r: (r, n, s) for r, n, s in zip(*(t[c].to_pylist() for c in ("rank", "names", "sizes")), strict=True)}  # a landmark may be there already
            rank, marks = t["rank"].to_pylist(), t["marks"].to_pylist()
            own, of = [i for i, g in enumerate(t["guest"].to_pylist()) if not g], classes([pages[r] for r in sorted(pages)])
            gone = [dropped(pages[rank[i]], marks[i], [p for r, p in pages.items() if r != rank[i]], of) for i in own]
            t = t.take(pa.array(own, pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays([t["host"].combine_chunks(), t["key"].combine_chunks(), t["copies"].combine_chunks(), pa.array(gone, pa.list_(pa.int32()))], ["host", "key", "copies", "dropped"])

    return written(near.select(*columns).mapInArrow(difference, "host string, key binary, copies long, dropped array<int>"), "verdicts")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
