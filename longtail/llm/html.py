"""Main text of web pages by differencing with the pages of the nearest URLs.

A page is cut into lines, one a block. Pages of a host with equal lines are one, at the first
of their URLs. The distinct pages are ordered by host, URL path, URL and id, and each is aligned
with the NEAR before and the NEAR after it of its host by a longest common subsequence of its
lines. Lines shared with a neighbour are deleted.

Differencing alone can't give right results: it would delete an article's own licence lines
and whole articles that two URLs carry, and it can't see the adverts and reader comments that
each page has for itself. So the lines of an article element (or main, where there is none) stay
even if shared, and lines of elements whose tag, role, class or id says that they hold menus,
adverts, comments and the like go even if not shared. On all other lines, beside an article too,
differencing decides. A neighbour is taken for a near copy if it shares COPY_SHARE of the lines
that no other neighbour shares, and the lines that it alone shares stay. Two things can't be told
from the lines of a few neighbours: a host's only two pages with a long template from near copies
(taken for copies, the template stays), and three or more near copies side by side from pages
of one template (taken for the latter, what they share goes, unless it is in an article).

Only line hashes are shuffled. Pages are dealt by their place in the global order, in blocks
of BLOCK pages with the NEAR pages beside them, so a host with a third of all pages is as
many blocks as it needs.

Defined cases: null and empty html gives an empty text; pages without a host are not paired;
unclosed elements end with the page, unknown ones are inline; repeated rows give a row each;
empty tables give empty results; other columns are dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

NEAR, BLOCK, SMALL_ROWS = 2, 2048, 500_000
COPY_SHARE = 0.8
PLAIN, BOILER, ARTICLE = 0, 1, 2

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
RAW = frozenset("script style textarea title noscript template iframe svg select button".split())
BLOCKS = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav header footer aside form head dialog menu search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILER_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertis\w*|adsense|banner|sponsor\w*|promo\w*|comments?|comment\w*|repl(?:y|ies)|respond|disqus|discussion|sidebar|side|nav|navbar|navigation|navi|menu\w*|breadcrumbs?|"
    r"foot|footer|header|masthead|topbar|cookies?|consent|gdpr|notices?|notification\w*|alerts?|newsletter|subscri\w*|signup|popup|modal|overlay|social|share|sharing|related|recommend\w*|"
    r"widgets?|toolbar|pagination|pager|login|search|copyright|legal|disclaimer|skip)(?:[^a-z]|$)"
)
#: Names that an article gives sections of its own as well: there they don't count.
ARTICLE_NAMES = re.compile(r"(?:^|[^a-z])(?:discussion|legal|related-work|notices?|side)(?=[^a-z]|$)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


def _is_boiler(tag: str, attributes: str, in_article: bool = False) -> bool:
    if tag in BOILER_TAGS:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name == "role" and value.lower() in BOILER_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            named = CAMEL.sub("-", value).lower()
            if BOILER_NAMES.search(ARTICLE_NAMES.sub(" ", named) if in_article else named):
                return True
        if name == "class" and tag == "article" and re.search(r"\bcomment", value.lower()):
            return True
    return False


def lines(page: str) -> list[tuple[str, int]]:
    """The page's blocks in order, white space squeezed, each with its place: ARTICLE, BOILER or PLAIN."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, boiler depth, in article, in main
    text: list[str] = []
    boiler, in_article, in_main, any_article, any_main = 0, False, False, False, False

    def end() -> None:
        if text:
            got = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if got:
                heading = any(s[0] in HEADINGS for s in stack[-3:])
                # a header in the article holds its headline
                kept = not boiler or boiler == 1 and heading and in_article and any(s[0] == "header" for s in stack)
                out.append((got, 3 if not kept else ARTICLE if in_article else 1 if in_main else 0, True))
            text.clear()

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        got = m[0]
        if got[0] != "<" or got == "<":
            text.append(got)
            continue
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = close.end() if close else size if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS:
            # inline, but one that hides its text or holds an advert counts as a block
            if tag in VOID or not (closing and any(s[0] == tag for s in stack)) and not (not closing and attributes and _is_boiler(tag, attributes)):
                continue
        end()
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    _, boiler, in_article, in_main = stack[k]
                    del stack[k:]
                    break
            continue
        if stack and (stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li"):
            _, boiler, in_article, in_main = stack.pop()
        stack.append((tag, boiler, in_article, in_main))
        boiler += _is_boiler(tag, attributes, in_article)
        if not boiler:
            in_article |= tag == "article"
            in_main |= tag == "main"
            any_article |= tag == "article"
            any_main |= tag == "main"
    end()
    best = ARTICLE if any_article else 1 if any_main else 0
    return [(t, BOILER if place == 3 else ARTICLE if best and place == best else PLAIN) for t, place, _ in out]


def place(url: str | None) -> tuple[str, str]:
    """Host in lower case and path of a URL; empty where there is none."""
    try:
        parts = urlsplit(url or "")
        return (parts.netloc.rpartition("@")[2].lower(), parts.path)
    except ValueError:
        return "", url or ""


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence, by bit-parallel rows kept for the way back."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], [], []]
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            host, path = place(url)
            got = lines(page or "")
            out[0].append(host)
            out[1].append(path)
            out[2].append([xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in got])
            out[3].append([p for _, p in got])
            out[4].append(xxhash.xxh64_intdigest(np.array([out[2][-1], out[3][-1]], np.int64).tobytes()) - (1 << 63))
        kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds))], names=["id", "row", "url", "host", "path", "line", "place", "fp"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        at = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part), pa.int32()), pa.array(at, pa.int64()), *(batch.column(batch.schema.names.index(c)) for c in ("row", "host", "line", "place"))], names=["part", "at", "row", "host", "line", "place"])


def deleted(places: list[int], shared: list[set[int]]) -> set[int]:
    """Of a page's lines, given those that it shares with each neighbour, the ones to delete.

    A neighbour is a copy if nearly all lines that no other neighbour shares are shared with it, and so are those
    of the article; the lines that it alone shares then stay.
    """
    gone = {x for s in shared for x in s if places[x] != ARTICLE}
    for k, s in enumerate(shared):
        others = set().union(*shared[:k], *shared[k + 1 :])
        own = [x for x, p in enumerate(places) if p != BOILER and x not in others]
        article = [x for x in own if places[x] == ARTICLE]
        if own and all(sum(x in s for x in part) >= COPY_SHARE * len(part) for part in (own, article)):
            gone.difference_update(x for x in own if x in s)
    return gone


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the block's pages, the lines (never an article's) that are deleted because neighbours share them."""
    pdf = pdf.sort_values("pos", kind="stable")
    hosts, rows, own = pdf["host"].tolist(), pdf["row"].tolist(), pdf["own"].tolist()
    texts, places = [list(x) for x in pdf["line"]], [list(x) for x in pdf["place"]]
    shared: list[list[set[int]]] = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i + 1, min(i + 1 + NEAR, len(rows))):
            if not hosts[i] or hosts[i] != hosts[j] or not (own[i] or own[j]):
                continue
            pairs = common(texts[i], texts[j])
            shared[i].append({x for x, _ in pairs})
            shared[j].append({y for _, y in pairs})
    gone = [deleted(p, s) if o else set() for p, s, o in zip(places, shared, own)]
    got = [(r, sorted(g)) for r, g, o in zip(rows, gone, own) if o and g]
    return pd.DataFrame({"row": pd.Series([r for r, _ in got], dtype="int64"), "gone": pd.Series([g for _, g in got], dtype=object)})


def shared_lines(pages: DataFrame) -> DataFrame:
    """(row, gone): indices of the lines that each page, pages(id, url, html, row), shares with its neighbours."""
    scratch = Scratch(pages.sparkSession)
    hashed = pages.select("id", "url", "html", "row").mapInArrow(_hashes, f"id {pages.schema['id'].dataType.simpleString()}, row bigint, url string, host string, path string, line array<bigint>, place array<int>, fp bigint")
    hashed = scratch.put(hashed.where("host != ''"), "hashed")
    # equal pages of a host are one, at its first place
    first = F.min(F.struct("path", "url", "id", "row", "line", "place")).alias("first")
    distinct = scratch.put(hashed.groupBy("host", "fp").agg(first).select("host", "fp", "first.*"), "distinct")
    ordered = distinct.repartitionByRange("host", "path", "url", "id").sortWithinPartitions("host", "path", "url", "id", "row")
    ordered = scratch.put(ordered.mapInArrow(_numbered, "part int, at bigint, row bigint, host string, line array<bigint>, place array<int>"), "ordered")
    first, offsets = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets += [(part, first)]
        first += n
    offset = F.broadcast(pages.sparkSession.createDataFrame(offsets, "part int, first bigint"))
    placed = ordered.join(offset, "part").select((F.col("first") + F.col("at")).alias("pos"), "row", "host", "line", "place")
    block = F.floor(F.col("pos") / BLOCK)
    beside = F.array_distinct(F.array(block, F.floor((F.col("pos") - NEAR) / BLOCK), F.floor((F.col("pos") + NEAR) / BLOCK)))
    dealt = placed.withColumn("block", F.explode(beside)).withColumn("own", F.col("block") == block)
    found = scratch.put(dealt.groupBy("block").applyInPandas(_shared, "row bigint, gone array<int>").dropDuplicates(["row"]), "found")
    found = distinct.select("row", "host", "fp").join(small(found, SMALL_ROWS), "row").select("host", "fp", "gone")
    rows = hashed.select("row", "host", "fp").distinct()
    return scratch.put(rows.join(small(found, SMALL_ROWS), ["host", "fp"]).select("row", "gone"), "shared")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_lines, n_shared): the page's main text and how many lines it had and shared."""
    given = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("row", F.xxhash64("id", "url", "html"))
    full = given.join(small(shared_lines(given), SMALL_ROWS), "row", "left").select("id", "url", "html", "gone")
    kind = given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, shared = [], [], []
            for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                got, out = lines(page or ""), set(gone or ())
                texts.append("\n\n".join(t for i, (t, p) in enumerate(got) if p != BOILER and i not in out))
                counts.append(len(got))
                shared.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], counts, shared))], names=[key, "url", "text", "n_chars", "n_lines", "n_shared"])

    return full.mapInArrow(run, f"`{key}` {kind}, url string, text string, n_chars bigint, n_lines bigint, n_shared bigint")
