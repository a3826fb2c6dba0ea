"""Main text of pages: markup settles what it can, lines left open are compared with the page of the nearest address."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.common import arrow_map, written

#: Elements whose text is never main text.
OUT = frozenset("nav footer aside form head menu dialog button select option label fieldset iframe object svg math canvas audio video map noscript "
                "template datalist".split())
#: Classes, ids and roles of parts that are not main text, as whole names of the attribute; "_" counts as "-".
OUT_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side complementary footer contentinfo header masthead banner ad ads advert adverts "
    "advertisement sponsored sponsor promo promotion notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup "
    "share sharing social comment comments commentlist respond disqus related recommended pagination pager search toolbar hidden dialog "
    "nav-bar nav-menu nav-links nav-wrapper main-nav main-menu main-navigation primary-nav primary-menu primary-navigation top-nav top-menu top-bar "
    "side-nav side-menu side-bar sub-nav sub-menu site-nav site-navigation site-menu site-header page-header main-header global-header header-nav "
    "header-menu site-footer page-footer main-footer global-footer footer-nav footer-menu footer-links footer-widgets breadcrumb-nav breadcrumb-trail "
    "sidebar-left sidebar-right left-sidebar right-sidebar main-sidebar widget-area ad-banner ad-block ad-box ad-container ad-slot ad-space ad-unit "
    "ad-wrapper banner-ad main-ad side-ad sidebar-ad top-ad bottom-ad google-ad google-ads adsbygoogle sponsored-content sponsored-links promo-box "
    "promo-banner cookie-notice cookie-banner cookie-bar cookie-consent cookie-popup cookie-message cookie-law consent-banner gdpr-banner gdpr-notice "
    "alert-banner newsletter-signup newsletter-form email-signup subscribe-form subscribe-box signup-form share-bar share-buttons share-links "
    "sharing-buttons social-bar social-buttons social-icons social-links social-media social-share comment-form comment-list comment-section "
    "comments-area comments-list comments-section comments-wrapper disqus-thread related-articles related-content related-links related-posts "
    "related-stories recommended-articles recommended-posts page-navigation post-navigation pagination-links search-bar search-box search-form "
    "search-field modal-dialog skip-link".split())
#: Those of them that lay out a page and may wrap its main text; the others say what a part holds.
LAYOUT_NAMES = frozenset("sidebar side complementary header masthead banner overlay modal popup hidden dialog search share social side-bar sidebar-left "
                         "sidebar-right left-sidebar right-sidebar main-sidebar widget-area site-header page-header main-header global-header "
                         "modal-dialog".split())
#: Names that stand for main text's own heading inside an article.
HEADING_NAMES = frozenset(("header", "page-header", "main-header"))
#: Parts of a name that tell reader comments, notices and adverts whatever else the name says, and parts that take that back.
TELLING = re.compile(r"(?:comments?|commentlist|commenters?|ads|adverts?)$|(?:cookie|advertis|disqus|gdpr|newsletter|sponsor)")
UNSAYING = frozenset("no non not has have with without hide show is free off on closed disabled enabled count link".split())
#: Elements that box a part of an article if they bear a class, id or role.
BOXES = frozenset("div section ul ol dl table figure center".split())
#: Times that a page is read again with wrappers of main text let in, before all names of layout are.
SPARED_ROUNDS = 8
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre "
                   "section summary table tbody td tfoot th thead tr ul caption".split()) | OUT
#: Blocks that hold running text; inside an article their lines are settled as main text.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption summary".split())
ARTICLE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

#: Attributes up to the end of a tag; where quotes do not close, up to the next angle bracket. No alternative reads far twice.
_ATTRIBUTES = r"(?:(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^<>]*+)"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noembed|noframes|xmp)\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^<>]*+>|"
    rf"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attributes>{_ATTRIBUTES})>|(?P<text>[^<]+|<)", re.S | re.I)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=$|[\s=/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

#: What markup says of a line: main text, left open, outside an article that the page has, or in a box that is not the article's body.
MAIN, OPEN, OUTSIDE, BOXED = 0, 1, 2, 3
#: Characters from which on a line counts as running text, and the share of text that two copies have in common at least.
RUNNING = 60
MOST = 0.8
#: Characters of running text that a cookie notice or an advert has at most.
NOTICE = 500


def _names(tag: str, attributes: str, article: int) -> set[str]:
    """Classes, ids and roles of an element by which it is not main text; none for the page itself and void elements.

    An article counts only if its name tells reader comments, notices or adverts.
    """
    if not attributes or tag in VOID or tag in ("html", "body"):
        return set()
    said = {x for values in NAMED.findall(attributes) for x in "".join(values).lower().replace("_", "-").split()}
    found = {x for x in said if _tells(x)}
    if tag in ARTICLE:
        return found
    found |= said & OUT_NAMES
    return found - HEADING_NAMES if article else found


def _tells(name: str) -> bool:
    parts = name.split("-")
    return not UNSAYING.intersection(parts) and any(map(TELLING.match, parts))


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """(MAIN, OPEN, OUTSIDE or BOXED, text) of each block in page order; character references decoded, white space made one space.

    Text in menus, footers, sidebars, forms, adverts, notices, comments and the like, and in scripts, styles and the
    head, gives no line. Tags need not be closed: the page's first article, its end or the end of the page ends a part
    left out; an article inside comments, notices or adverts, or after the first one, belongs to the part. A line of an
    article is boxed if a named element around it holds less than half of the article's text. A part left out by its name alone stays if it holds most of the page's running text (text of links does not count):
    then it wraps the main text. A part whose name says what it holds (adverts, notices, comments) stays only if no
    other running text is left and it is longer than a notice, or no other line.
    """
    spared: set[int] = set()
    for turn in count():
        found, parts = _lines(page, spared, turn >= SPARED_ROUNDS)
        if not parts:
            return found
        left = sum(len(t) for kind, t in found if kind != OUTSIDE and len(t) >= RUNNING)
        any_left = any(kind != OUTSIDE for kind, _ in found)
        total = left + sum(n for n, _ in parts.values())
        most = max(n for n, _ in parts.values())
        wraps = {at for at, (n, layout) in parts.items() if layout and 2 * n > total or not left and n == most and (layout or n >= NOTICE or not any_left)}
        if not wraps:
            return found
        spared |= wraps


def _lines(page: str | None, spared: set[int], any_layout: bool = False) -> tuple[list[tuple[int, str]], dict[int, tuple[int, bool]]]:
    """Lines of a page, and by place of its tag each part left out by name alone that has running text: its characters, whether of LAYOUT_NAMES.

    Parts whose places are spared are not left out, with `any_layout` none by a name of layout. Of a page with an article
    only parts inside it are given.
    """
    found: list[tuple[int, str]] = []
    boxed: list[int] = []
    boxes, stack, opened = [-1], [("", 0)], Counter()
    held: list[str] = []
    parts: dict[int, tuple[int, bool]] = {}
    out, depth, article, block, seen = "", 0, 0, "", False
    part, layout, inner, inner_depth, linked, inside, tells = -1, False, "", 0, False, set(), False

    def close() -> None:
        nonlocal held
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if out:
                if len(text) >= RUNNING:
                    parts[part] = (parts.get(part, (0, layout))[0] + len(text), layout)
            elif text:
                found.append((OUTSIDE if not article else MAIN if block in TEXT_BLOCKS else OPEN, text))
                boxed.append(stack[-1][1])
            held = []

    for m in TOKEN.finditer(page or ""):
        kind = m.lastgroup
        if kind == "text":
            if not out or part >= 0 and not inner and not linked:
                held.append(m["text"])
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"])
        if out:
            if part >= 0 and tag in BLOCKS:
                close()
            elif tag == "a":
                linked = not closing
            if tag == out:
                depth += -1 if closing else 1
                if not depth:
                    close()
                    out = ""
                continue
            if not (tag in ARTICLE and (closing and article or not closing and not article and not seen and not tells) or tag == "body"):
                if tag == inner:
                    inner_depth += -1 if closing else 1
                    inner = inner if inner_depth else ""
                elif tag in OUT and not closing and not inner:
                    inner, inner_depth = tag, 1
                continue
            close()
            out, depth = "", 0
        if not closing:
            attributes = m["attributes"] or ""
            always = tag in OUT or tag == "header" and not article or \
                bool(attributes) and tag not in VOID and tag not in ("html", "body") and tag not in ARTICLE and bool(HIDDEN.search(attributes))
            names = set() if always or m.start() in spared else _names(tag, attributes, article)
            names = names - LAYOUT_NAMES if any_layout else names
            if always or names:
                close()
                out, depth, inner, linked = tag, 1, "", False
                part, layout = (m.start(), names <= LAYOUT_NAMES) if names else (-1, False)
                tells = any(map(_tells, names))
                if article:
                    inside.add(part)
                continue
        if tag in BLOCKS:
            close()
            block = "" if closing else tag
            if tag in ARTICLE:
                article = max(0, article + (-1 if closing else 1))
                seen = True
            elif tag in BOXES and article and not closing:
                if NAMED.search(m["attributes"] or ""):
                    boxes.append(stack[-1][1])
                stack.append((tag, len(boxes) - 1 if NAMED.search(m["attributes"] or "") else stack[-1][1]))
                opened[tag] += 1
            elif tag in BOXES and opened[tag]:
                last = ""
                while last != tag:
                    last, _ = stack.pop()
                    opened[last] -= 1
            if not article and len(stack) > 1:
                stack, opened = [("", 0)], Counter()
        elif tag == "br":
            held.append(" ")
    close()
    if seen:
        found = _in_boxes(found, boxed, boxes)
        return found, {at: x for at, x in parts.items() if at in inside}
    return [(OPEN, t) for _, t in found], parts


def _in_boxes(found: list[tuple[int, str]], boxed: list[int], boxes: list[int]) -> list[tuple[int, str]]:
    """Lines with those of an article that stand in a box of less than half of its text as BOXED.

    boxed: each line's innermost box; boxes: each box's parent, which comes before it. Box 0 is no box.
    """
    if len(boxes) == 1:
        return found
    size = [0] * len(boxes)
    for (kind, text), box in zip(found, boxed):
        if kind != OUTSIDE:
            size[box] += len(text)
    for box in range(len(boxes) - 1, 0, -1):
        size[boxes[box]] += size[box]
    return [(BOXED if kind != OUTSIDE and box and 2 * size[box] < size[0] else kind, text) for (kind, text), box in zip(found, boxed)]


#: Bits that a table of an alignment may have; longer pages are split where both halves align best.
TABLE_BITS = 1 << 26


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions of a longest common subsequence in `a`, by bit-parallel rows; lines that only one has are left out before."""
    in_a, in_b = set(a), set(b)
    places = [i for i, x in enumerate(a) if x in in_b]
    return [places[i] for i in _aligned([a[i] for i in places], [x for x in b if x in in_a])]


def _rows_of(a: list[int], b: list[int]) -> Iterator[int]:
    """A bit vector after each line of `a`: a bit that is 0 is a place of `b` where the subsequence with b so far grows."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of `a` and each start of `b`."""
    v = (1 << len(b)) - 1
    for v in _rows_of(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), dtype=np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], b: list[int]) -> list[int]:
    out, i, j = [], len(a) - 1, len(b) - 1
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[:half - 1:-1], b[::-1])[::-1]).argmax())
        return _aligned(a[:half], b[:cut]) + [half + k for k in _aligned(a[half:], b[cut:])]
    rows = list(_rows_of(a, b))
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append(i)
            i -= 1
            j -= 1
    return out[::-1]


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _parsed(pages: DataFrame) -> DataFrame:
    """row, host, path, hashes of all lines, their lengths (0 outside an article that the page has) and which of them are open or boxed."""

    def step(c: dict) -> dict:
        lines = [lines_of(h) for h in c["html"].to_pylist()]
        return {"row": c["row"], "host": c["host"], "path": c["path"], "lines": [[_hash(t) for _, t in x] for x in lines],
                "sizes": [[0 if k == OUTSIDE else len(t) for k, t in x] for x in lines], "open": [[k == OPEN for k, _ in x] for x in lines],
                "boxed": [[k == BOXED for k, _ in x] for x in lines]}

    schema = "row bigint, host string, path string, lines array<bigint>, sizes array<int>, open array<boolean>, boxed array<boolean>"
    return arrow_map(pages.select("row", "host", "path", "html"), schema, step, "html")


def _in_common(a: list[int], sizes_a: list[int], b: list[int], sizes_b: list[int], least: int) -> tuple[int, int, int]:
    """Characters in lines of `least` characters and more: shared by both pages, and of each page."""
    count_a, count_b = (Counter((x, n) for x, n in zip(lines, sizes) if n >= least) for lines, sizes in ((a, sizes_a), (b, sizes_b)))
    return tuple(sum(n * k for (_, n), k in c.items()) for c in (count_a & count_b, count_a, count_b))


def same_page(a: list[int], sizes_a: list[int], b: list[int], sizes_b: list[int]) -> bool:
    """Whether most text of the longer page is in both, so that each is a copy of the other."""
    both, one, other = _in_common(a, sizes_a, b, sizes_b, 1)
    return both > 0 and both >= MOST * max(one, other)


def copied(a: list[int], sizes_a: list[int], b: list[int], sizes_b: list[int]) -> bool:
    """Whether a page is a copy of the other, or most running text of either is in both (a print version, an excerpt)."""
    both, one, other = _in_common(a, sizes_a, b, sizes_b, RUNNING)
    return same_page(a, sizes_a, b, sizes_b) or both > 0 and both >= MOST * min(one, other)


def _prefix(a: str, b: str) -> Column:
    """Characters that two texts share at their start; 0 with NULL."""
    return F.expr(f"coalesce(aggregate(sequence(0, least(length({a}), length({b}))), 0, "
                  f"(n, i) -> if(i > 0 and n = i - 1 and substr({a}, i, 1) = substr({b}, i, 1), i, n)), 0)")


def _in_order(rows: DataFrame) -> DataFrame:
    """part, host, path, row and the neighbours (up, down) of the same host in order of the path.

    Rows are dealt by ranges of host and path, so a host with most pages spreads; the ends of ranges are joined on afterwards.
    """
    dealt = rows.filter("host is not null").select("row", "host", "path").distinct().repartitionByRange("host", "path", "row")
    dealt, _ = written(dealt.withColumn("part", F.spark_partition_id()), "addresses")
    me = F.struct("host", "path", "row")
    ends = dealt.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    by_part = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(by_part).alias("before"), F.lead("first").over(by_part).alias("behind"))
    inside = Window.partitionBy("part").orderBy("host", "path", "row")
    near = dealt.select("*", F.lag(me).over(inside).alias("up"), F.lead(me).over(inside).alias("down")).join(ends, "part")
    near = near.select("part", "row", "host", "path", F.coalesce("up", "before").alias("up"), F.coalesce("down", "behind").alias("down"))
    return near.select("part", "row", "host", "path", *[F.when(F.col(f"{c}.host") == F.col("host"), F.col(c)).alias(c) for c in ("up", "down")])


def _by_nearness(near: DataFrame) -> DataFrame:
    """row, mate (the neighbour with the longer common start, the one before on a tie) and other (the second neighbour)."""
    near = near.withColumn("up_row", F.col("up.row")).withColumn("down_row", F.col("down.row"))
    further = F.col("up_row").isNull() | (_prefix("path", "down.path") > _prefix("path", "up.path"))
    behind = F.col("down_row").isNotNull() & further
    return near.select("row", F.when(behind, F.col("down_row")).otherwise(F.col("up_row")).alias("mate"),
                       F.when(behind, F.col("up_row")).otherwise(F.col("down_row")).alias("other")).filter("mate is not null")


def nearest_pages(rows: DataFrame) -> DataFrame:
    """(row, mate): for each row (row, host, path) the row of the same host whose path is nearest in order.

    Of the neighbours before and behind the one with the longer common start counts, the one before on a tie.
    Rows with a NULL host and hosts with one page have no mate.
    """
    return _by_nearness(_in_order(rows)).select("row", "mate")


def nearest_others(parsed: DataFrame) -> DataFrame:
    """(row, mate, other): as `nearest_pages`, but the neighbours before and behind the run of copies that a page stands in.

    Neighbours in order that are copies of each other form runs; a run may span ranges.
    """
    near, _ = written(_in_order(parsed), "neighbours")
    lines = parsed.select("row", "lines", "sizes").dropDuplicates(["row"])
    pairs = near.filter("down is not null").select("row", F.col("down.row").alias("next")).join(lines, "row")
    pairs = pairs.join(lines.toDF("next", "theirs", "their_sizes"), "next")

    def step(c: dict) -> dict:
        columns = (c[n].to_pylist() for n in ("lines", "sizes", "theirs", "their_sizes"))
        return {"row": c["row"], "next": c["next"], "same": [same_page(*x) for x in zip(*columns)]}

    links, _ = written(arrow_map(pairs, "row bigint, next bigint, same boolean", step).filter("same"), "links")
    near = near.join(links.select("row", F.lit(True).alias("goes_on")), "row", "left") \
        .join(links.select(F.col("next").alias("row"), F.lit(True).alias("went_on")), "row", "left")
    begins, ends = F.col("went_on").isNull(), F.col("goes_on").isNull()
    place = ("host", "path", "row")
    # a struct around each neighbour: a run without one before or behind it is told from no end of a run in a range
    edges = near.groupBy("part").agg(F.max(F.when(begins, F.struct(*place, F.struct("up").alias("e")))).alias("a"),
                                     F.min(F.when(ends, F.struct(*place, F.struct("down").alias("e")))).alias("z"))
    by_part = Window.orderBy("part")
    edges = edges.select("part", F.last("a.e", True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                         F.first("z.e", True).over(by_part.rowsBetween(1, Window.unboundedFollowing)).alias("behind"))
    inside = Window.partitionBy("part").orderBy(*place)
    near = near.select(
        "part", "row", "path", F.last(F.when(begins, F.struct("up")), True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("a"),
        F.first(F.when(ends, F.struct("down")), True).over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("z")).join(edges, "part")
    return _by_nearness(near.select("row", "path", F.coalesce("a", "before")["up"].alias("up"), F.coalesce("z", "behind")["down"].alias("down")))


def _deleted(parsed: DataFrame) -> DataFrame:
    """(row, gone): numbers of the lines that pages which are no copies have too, aligned by longest common subsequence.

    An open line goes if the nearest such page has it, a boxed one if every such neighbour has it.
    """
    asking = parsed.filter(F.exists("open", lambda x: x) | F.exists("boxed", lambda x: x)).select("row", "lines", "sizes", "open", "boxed").dropDuplicates(["row"])
    lines = parsed.select("row", "lines", "sizes").dropDuplicates(["row"])
    names = ("lines", "sizes", "open", "boxed", "lines1", "sizes1", "lines2", "sizes2")
    both = asking.join(nearest_others(parsed), "row").join(lines.toDF("mate", "lines1", "sizes1"), "mate") \
        .join(lines.toDF("other", "lines2", "sizes2"), "other", "left").select("row", *names)

    def step(c: dict) -> dict:
        gone = []
        for a, sizes, is_open, is_boxed, *others in zip(*(c[n].to_pylist() for n in names)):
            common = [set(shared(a, b)) for b, n in zip(others[::2], others[1::2]) if b is not None and not copied(a, sizes, b, n)]
            gone.append([i for i in sorted(common[0]) if is_open[i] or is_boxed[i] and all(i in x for x in common)] if common else [])
        return {"row": c["row"], "gone": gone}

    return arrow_map(both, "row bigint, gone array<int>", step).filter(F.size("gone") > 0)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text (blocks joined by a line feed, empty if none) and n_chars of every row.

    An article's running text stays whole. Text of an article outside paragraphs, headings, lists and the like, and all
    text of a page without an article, is left open by markup: such a line goes if the page of the same host with the
    nearest path that is no copy of the page has it too (aligned by longest common subsequence), else it stays. Of the
    neighbours before and behind, the second is asked if the nearest is a copy or holds the page's running text; if both
    are, the lines stay. A line of an article in a named box of less than half its text goes if each of the neighbours
    that is no copy has it. NULL html is empty. A NULL address or one that no other shares a host with leaves such lines
    in place. Rows equal in all three columns are treated alike; repeated ids with other contents stand alone. Other
    columns are not read. Time and memory of a page are linear in its length but for the alignment, which takes as many
    bits of time as the product of the lines that both pages have, and no more than TABLE_BITS of memory.
    """
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("html"))
    address = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 0)
    rows = rows.withColumn("row", F.xxhash64("page_id", "url", "html"))
    placed = rows.withColumn("host", F.when(address != "", F.lower(F.regexp_extract("url", r"//([^/?#]*)", 1))))
    placed = placed.withColumn("path", F.regexp_extract("url", r"//[^/?#]*([^?#]*)", 1))
    parsed, _ = written(_parsed(placed), "lines")
    gone, _ = written(_deleted(parsed), "gone")
    joined = rows.join(gone, "row", "left").select("page_id", "url", "html", "gone")

    def step(c: dict) -> dict:
        texts = []
        for h, g in zip(c["html"].to_pylist(), c["gone"].to_pylist()):
            drop = set(g or ())
            texts.append("\n".join(t for i, (kind, t) in enumerate(lines_of(h)) if kind != OUTSIDE and i not in drop))
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))}

    return arrow_map(joined, "page_id bigint, url string, text string, n_chars bigint", step, "html")
