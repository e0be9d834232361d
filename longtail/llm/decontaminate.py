"""Benchmark decontamination with a broadcast hash set of test n-grams.

The windows of the benchmark items (n consecutive words; a shorter item is one
window) become sorted arrays of rolling hashes. Documents are scanned where they
lie: words become ids of the benchmark's vocabulary, every window hash is looked
up, and a hit is verified word by word. No document is shuffled.

The benchmark is broadcast in blocks of at most `max_windows` windows; a larger
benchmark takes one more pass over the same rows for each block.

Defined cases: null and empty texts have no words and are clean; items with a
null id or without words are ignored; an id that occurs in several rows counts
once; repeated documents are judged each on its own; empty tables give empty results;
`mark` replaces columns named like an output (n_words, n_hit, items, spans); `remove` returns all
columns as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sent

WINDOW = 13
MAX_WINDOWS = 2_000_000
#: Lower-cases A-Z and turns every byte that is no letter, digit or part of a non-ASCII character into a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PRIME = 0x9E3779B97F4A7C15


def words(text: bytes | str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(FOLD).split()


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
        have += step
    return out[:n]


def rolling(ids: np.ndarray, size: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hash of every window of `size` ids."""
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(ids.astype(np.uint64) * up[: len(ids)], out=total[1:])
    n = len(ids) - size + 1
    return (total[size:] - total[:-size]) * down[:n]


class Index:
    """One block of the benchmark: its words as ids in a row, and for each window size the sorted hashes with each window's place and item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        self.stream = np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for _, ws in items for w in ws), np.int32)
        begin = np.cumsum([0, *(len(ws) for _, ws in items)])
        rows: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, (name, ws) in enumerate(items):
            k = min(size, len(ws))
            rows.setdefault(k, []).append((np.arange(begin[i], begin[i + 1] - k + 1), at[name]))
        self.sizes = []
        for k, got in rows.items():
            start = np.concatenate([s for s, _ in got])
            owner = np.repeat(np.array([o for _, o in got], np.int32), [len(s) for s, _ in got])
            hashes = np.zeros(len(start), np.uint64)
            for j, p in enumerate(powers(k, PRIME)):
                hashes += self.stream[start + j].astype(np.uint64) * p
            order = np.lexsort((owner, hashes))
            hashes, start, owner = hashes[order], start[order], owner[order]
            # a window that an item repeats is kept once
            again = np.zeros(len(start), bool)
            again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
            same = np.flatnonzero(again)
            for j in range(k):
                same = same[self.stream[start[same] + j] == self.stream[start[same - 1] + j]]
            stay = np.ones(len(start), bool)
            stay[same] = False
            self.sizes.append((k, hashes[stay], start[stay].astype(np.int32), owner[stay]))

    def find(self, ids: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurring window, and the indices of the items whose windows occur."""
        hit, items = np.zeros(len(ids), bool), set()
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for k, hashes, places, owner in self.sizes:
            if len(ids) < k:
                continue
            start = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(start):
                continue
            h = rolling(ids, k, up, down)[start]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for s, a, b in zip(start[lo < hi], lo[lo < hi], hi[lo < hi]):
                same = np.flatnonzero((self.stream[places[a:b, None] + np.arange(k)] == ids[s : s + k]).all(axis=1))
                if len(same):
                    hit[s : s + k] = True
                    items.update(owner[a:b][same].tolist())
        return hit, items


def blocks(benchmark: DataFrame, text: str, item: str, size: int, max_windows: int) -> Iterator[Index]:
    """The benchmark as indexes of at most max_windows windows each (one item may exceed it alone)."""
    held, n, some = [], 0, False
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string"), F.col(text))
    for name, t in rows.toLocalIterator():
        if ws := words(t):
            if held and n + len(ws) > max_windows:
                yield Index(held, size)
                held, n = [], 0
            held.append((name, ws))
            n, some = n + max(1, len(ws) - size + 1), True
    if held or not some:
        yield Index(held, size)


OUTPUTS = ("n_words", "n_hit", "items", "spans")
KINDS = (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.ArrayType(T.LongType()))


def mark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, max_windows: int = MAX_WINDOWS, names: tuple[str, ...] = OUTPUTS
) -> DataFrame:
    """docs with n_words, n_hit, items (ids of occurring items, sorted as strings) and spans (word ranges hit, [start, end) in turn), under the names given."""
    replaced = {n.lower() for n in names}
    kept = [f for f in docs.schema.fields if f.name.lower() not in replaced]
    df = docs.select(*(F.col(f"`{f.name}`") for f in kept))
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in zip(names, KINDS))])
    place = [f.name for f in kept].index(text)
    for k, index in enumerate(blocks(benchmark, item_text, item, size, max_windows)):
        df = df.mapInArrow(_scan(sent(docs.sparkSession, index), place, len(kept), list(names), k > 0), schema)
    return df


def _scan(get_index, place: int, width: int, names: list[str], again: bool):
    """Marks behind the first `width` columns, of which the text is the one at `place`; again: earlier marks stand there already."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = get_index()
        get = index.vocab.get
        inverse = pow(PRIME, -1, 1 << 64)
        up, down = powers(1 << 12, PRIME), powers(1 << 12, inverse)
        for batch in batches:
            total, hits, owners, spans = [], [], [], []
            before = [batch.column(width + c).to_pylist() for c in (2, 3)] if again else None
            for i, t in enumerate(batch.column(place).to_pylist()):
                ws = words(t)
                if len(ws) > len(up):
                    up, down = powers(2 * len(ws), PRIME), powers(2 * len(ws), inverse)
                ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
                hit, items = index.find(ids, up, down)
                found = {index.names[x] for x in items}
                if again:
                    found |= set(before[0][i])
                    for a, b in zip(before[1][i][::2], before[1][i][1::2]):
                        hit[a:b] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
                total.append(len(ws))
                hits.append(int(hit.sum()))
                owners.append(sorted(found))
                spans.append(edges.tolist())
            made = [pa.array(total, pa.int64()), pa.array(hits, pa.int64()), pa.array(owners, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=[*batch.schema.names[:width], *names])

    return scan


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def cut_spans(text: str, spans: list[int]) -> str:
    """text without the characters from the first to the last word of each span."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    kept, last = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        kept.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode()


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", unit: str = "document", **options) -> DataFrame:
    """docs without contaminated documents; with unit="span", without the hit words of every document instead. Other columns stay as they were."""
    names = fresh(docs, *OUTPUTS)
    marked = mark(docs, benchmark, text, names=tuple(names), **options)
    if unit == "document":
        return marked.where(~contaminated(*names[:2])).drop(*names)
    cut = F.pandas_udf(lambda t, s: t.combine(s, lambda a, b: a if a is None or not len(b) else cut_spans(a, list(b))), "string")
    return marked.withColumn(text, F.when(F.size(names[3]) > 0, cut(text, names[3])).otherwise(F.col(text))).drop(*names)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of op4 from the operator's marks."""
    marked = mark(docs.select("doc_id", "text"), benchmark)
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
with b0 as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
b as (select item, w, least(13, len(w)) as k from b0 where len(w) > 0),
g as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as gram from (select item, w, k, unnest(range(1, len(w) - k + 2)) as i from b)),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
ks as (select distinct k from g),
p as (select rid, k, i, array_to_string(w[i:i + k - 1], ' ') as gram from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
m as (select p.rid, p.i, p.k, g.item from p join g on p.k = g.k and p.gram = g.gram),
h as (select rid, count(distinct pos) as n_hit from (select rid, unnest(range(i, i + k)) as pos from m) group by rid),
t as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by rid)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(t.n_items, 0)::bigint as n_items,
  sha256(coalesce(t.items, '')) as items_sha256, coalesce(h.n_hit > 0 and 20 * h.n_hit >= len(d.w), false) as contaminated
from d left join h using (rid) left join t using (rid)
"""
