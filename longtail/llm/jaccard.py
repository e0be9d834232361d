"""N-gram Jaccard join: a size-aware heavy-light set similarity join and its components.

A text's set holds the hashes of its distinct five-word shingles. Sets are joined as classes
of equal sets, so exact copies cost one row. Three steps, all driven by |x & y| >= 0.8 |x | y|:

1. Screen. Every set offers its smallest-hash prefix (the prefix filter of a random order).
   Classes are kept whose prefix meets other classes in at least `need(n)` shingles; see there
   for why a linked pair is never lost. Within a task each shingle is settled first and offered
   once, so a shingle that a third of all rows hold gives one row a task.
2. Heavy-light join of the kept classes, ordered by document frequency. Light sets (up to
   `boundary` shingles) enumerate all 2-subsets of their extended prefix; heavy sets, and light
   ones near enough in size to pair with them, enter the inverted lists of their prefix, which
   are scanned. The boundary minimises the summed cost of both. Sets that meet in a bucket form
   a star around its smallest member; the stars' components are the candidate groups.
3. Exact check of each candidate group: overlaps are counted on the whole sets until the group
   is known to be one component. Groups over GROUP sets or ELEMENTS shingles are cut into blocks: exact
   components in each block, then between the blocks' representatives, then every set outside the largest
   component against the blocks of sets that it shares a prefix shingle with. No linked pair is skipped, and no task holds
   more than a few blocks.

Shingles are 64-bit hashes; two of 10**9 shingles collide with probability 0.03.

Defined cases: a null or blank text has an empty set and links with nothing; fewer than five
words make one shingle of the whole sequence; rows that share an id are nodes of their own
sets (both belong to the component of their set); rows with a null id link like all others, and a
component is named by its smallest id, or null where all its ids are; empty tables give empty results.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, Scratch, slices, small, word_bytes
from .components import components

WORDS = 5
#: Similarity as a fraction: links need DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
GROUP, ELEMENTS = 512, 1 << 20
SMALL_ROWS = 1_000_000
CHUNK, READ_BYTES, OUT_ROWS = 1 << 19, 4 << 20, 1 << 18
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def shingles(text: bytes | str | None, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; cache: word -> hash."""
    words = word_bytes(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    if len(cache) > 1 << 18:
        cache.clear()
    new = set(words).difference(cache)
    cache.update(zip(new, map(xxhash.xxh64_intdigest, new)))
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    g = h[:n] * np.uint64(MIX[0])
    for k in range(1, WORDS):
        g += h[k : k + n] * np.uint64(MIX[k])
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return np.unique(g)


def prefix(n: int, k: int = 1) -> int:
    """Sets that link share at least k of their first prefix(n, k) shingles in any common order (k at most their overlap)."""
    return min(n, n - -(-NUM * n // DEN) + k)


@functools.lru_cache(None)
def need(n: int) -> int:
    """Shingles of its smallest-hash prefix that a set of n must share with linked sets' prefixes.

    The q smallest hashes of the union of a linked pair, q being the smaller prefix, are in
    both prefixes where they are common; of a random order each is common with probability
    0.8 or more. The answer is the largest k of which P(Binomial(q, 0.8) < k) <= 1e-13; where
    that is below 2, the prefix filter itself guarantees 1.
    """
    q = prefix(-(-NUM * n // DEN))
    p, low, k = NUM / DEN, 0.0, 0
    while k < q:
        low += math.exp(math.lgamma(q + 1) - math.lgamma(k + 1) - math.lgamma(q - k + 1) + k * math.log(p) + (q - k) * math.log1p(-p))
        if low > 1e-13:
            break
        k += 1
    return max(1, k)


SIGNED = "doc_id {}, tx bigint, n bigint, fp bigint, met bigint, offers array<bigint>, told array<bigint>"


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row: set size and fingerprint; of the first row of a class in this chunk: how many prefix shingles
    it shares within the chunk (met), those it offers to other chunks and those that it offers though already met (told)."""
    cache: dict = {}
    keys, marks, sizes, prints, rows, held = [], [], [], [], [], 0
    seen: set[int] = set()
    key_type = None

    def settle() -> pa.RecordBatch:
        owners = [i for i, p in enumerate(rows) if p is not None]
        met, offers, told = [0] * len(keys), [None] * len(keys), [None] * len(keys)
        if owners:
            flat = np.concatenate([rows[i] for i in owners])
            own = np.repeat(np.array(owners), [len(rows[i]) for i in owners])
            order = np.argsort(flat, kind="stable")
            flat, own = flat[order], own[order]
            first = np.concatenate([[True], flat[1:] != flat[:-1]])
            run = np.cumsum(first) - 1
            shared = np.bincount(run)[run] > 1
            for i, c in zip(*np.unique(own[shared], return_counts=True)):
                met[i] = int(c)
            for into, mask in ((offers, first & ~shared), (told, first & shared)):
                o, h = own[mask], flat[mask].astype(np.int64)
                by = np.argsort(o, kind="stable")
                o, h = o[by], h[by]
                ids, at = np.unique(o, return_index=True)
                for i, part in zip(ids.tolist(), np.split(h, at[1:])):
                    into[i] = part
        lists = pa.list_(pa.int64())
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, key_type), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(met, pa.int64()), pa.array(offers, lists), pa.array(told, lists)],
            names=["doc_id", "tx", "n", "fp", "met", "offers", "told"],
        )
        for x in (keys, marks, sizes, prints, rows):
            x.clear()
        seen.clear()
        return out

    for batch in batches:
        key_type = batch.schema.field(0).type
        names, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for key, mark, text in ((names[a + i], hashes[a + i], t) for a, texts in slices(batch.column(1), READ_BYTES) for i, t in enumerate(texts)):
            g = shingles(text, cache)
            keys.append(key)
            marks.append(mark)
            sizes.append(len(g))
            fp = xxhash.xxh64_intdigest(g.tobytes()) - (1 << 63) if len(g) else None
            prints.append(fp)
            if len(g) and fp not in seen:
                seen.add(fp)
                rows.append(g[: prefix(len(g))].copy())
                held += len(rows[-1])
            else:
                rows.append(None)
            if held >= CHUNK or len(keys) >= CHUNK:
                held = 0
                yield settle()
    if keys:
        yield settle()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint, size and set of each text, once a task for rows that repeat a text."""
    cache: dict = {}
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for i, mark in enumerate(batch.column(1).to_pylist()):
            if mark not in seen:
                seen.add(mark)
                fresh.append(i)
        column = batch.column(0).take(pa.array(fresh, pa.int64()))
        got = [shingles(t, cache) for _, texts in slices(column, READ_BYTES) for t in texts]
        fps = [xxhash.xxh64_intdigest(g.tobytes()) - (1 << 63) if len(g) else None for g in got]
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array([len(g) for g in got], pa.int64()), pa.array([g.view(np.int64) for g in got], pa.list_(pa.int64()))], names=["fp", "n", "set"])


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column; null is empty."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The extended prefix of each set, rarest shingles first, and the list entries that a scan of its plain prefix reads."""
    for batch in batches:
        fps, ns, orders, scans = [], [], [], []
        columns = [batch.column(i).to_pylist() for i in range(2)] + [lists(batch.column(i)) for i in range(2, 5)]
        for fp, n, whole, df, h in zip(*columns):
            by = np.lexsort((h, df))
            rare = np.sort(np.setdiff1d(whole, h, assume_unique=True))
            k = prefix(n)
            fps.append(fp)
            ns.append(n)
            orders.append(np.concatenate([rare, h[by]])[: prefix(n, 2)])
            scans.append(min(k, len(rare)) + int(df[by][: max(0, k - len(rare))].sum()))
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(orders, pa.list_(pa.int64())), pa.array(scans, pa.int64())], names=["fp", "n", "ranked", "scan"])


def cost_boundary(sizes: list[tuple[int, int, int]]) -> int:
    """Largest set size that counts as light, by the least total of subsets enumerated and list entries scanned.

    sizes: (n, how many sets, list entries that scans of their prefixes read).
    """
    light, heavy = 0.0, float(sum(s for _, _, s in sizes))
    best, boundary = heavy, 0
    for n, c, scan in sorted(sizes):
        p = prefix(n, 2)
        light += c * (p * (p - 1) / 2 if n > 1 else 1)
        heavy -= scan
        if light + heavy < best:
            best, boundary = light + heavy, n
    return boundary


def _signatures(boundary: int):
    """Bucket keys of each set: 2-subsets of a light set's extended prefix, prefix shingles of sets that a heavy set may link with."""

    def of(n: int, order: np.ndarray) -> np.ndarray:
        out = []
        if n <= boundary:
            if n == 1:
                out.append(order[:1] ^ np.uint64(MIX[4]))
            else:
                i, j = np.triu_indices(len(order), 1)
                a, b = np.minimum(order[i], order[j]), np.maximum(order[i], order[j])
                out.append((a * np.uint64(MIX[1])) ^ (b * np.uint64(MIX[2]) + np.uint64(MIX[3])))
        if DEN * n >= NUM * (boundary + 1):
            out.append(order[: prefix(n)])
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for batch in batches:
            for fp, n, ranked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lists(batch.column(2))):
                s = of(n, ranked.view(np.uint64))
                a.append(np.full(len(s), fp, np.int64))
                b.append(s.view(np.int64))
                held += len(s)
                if held >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(b)), pa.array(np.concatenate(a))], names=["sig", "fp"])
                    a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(b)), pa.array(np.concatenate(a))], names=["sig", "fp"])

    return run


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """DEN * |x & y| >= NUM * |x | y| for sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    if DEN * len(x) < NUM * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    both = int((y[at] == x).sum())
    return DEN * both >= NUM * (len(x) + len(y) - both)


def group_links(fps: list[int], sets: list[np.ndarray], new: list[bool] | None = None, label: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the group's true components: every pair is compared unless it is already connected.

    new: compare only pairs of which one is new; label: members with equal labels are connected beforehand.
    """
    parent = list(range(len(fps)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if label is not None:
        first: dict[int, int] = {}
        for i, v in enumerate(label):
            parent[i] = first.setdefault(v, i)
    links = []
    size = [len(s) for s in sets]
    order = sorted(range(len(fps)), key=size.__getitem__)
    low = 0
    for j, v in enumerate(order):
        while DEN * size[order[low]] < NUM * size[v]:
            low += 1
        for u in order[j - 1 : low - 1 if low else None : -1] if j else ():
            if new is not None and not (new[u] or new[v]):
                continue
            a, b = find(u), find(v)
            if a != b and linked(sets[u], sets[v]):
                parent[max(a, b)] = min(a, b)
                links.append((fps[u], fps[v]))
    return links


def _check(pdf: pd.DataFrame) -> pd.DataFrame:
    sets = [np.asarray(s, np.int64).view(np.uint64) for s in pdf["set"]]
    new = pdf["new"].tolist() if "new" in pdf else None
    label = pdf["label"].tolist() if "label" in pdf else None
    return pd.DataFrame(group_links(pdf["fp"].tolist(), sets, new, label), columns=["a", "b"])


PAIR = "a bigint, b bigint"


def _large(members: DataFrame, ranked: DataFrame, scratch: Scratch, group: int) -> DataFrame:
    """True links of candidate groups over `group` sets or ELEMENTS shingles; members(root, fp, n, set, many, weight), ranked(fp, n, ranked). See step 3 above."""
    parts = lambda many, weight: F.greatest(F.ceil(F.col(many) / group), F.ceil(F.col(weight) / ELEMENTS)).cast("bigint")
    members = members.withColumn("block", F.pmod(F.xxhash64("fp"), parts("many", "weight")))
    inside = scratch.put(members.groupBy("root", "block").applyInPandas(_check, PAIR), "inside")
    nodes = members.select("fp", "root", "block", "n")
    own = components(inside.union(nodes.select("fp", F.col("fp").alias("b"))), scratch)
    heads = own.select("root").distinct().withColumnRenamed("root", "fp")
    heads = members.drop("many", "weight").join(heads, "fp", "left_semi")
    width = heads.groupBy("root").agg(F.count(F.lit(1)).alias("wide"), F.sum("n").alias("weight"))
    piece = F.pmod(F.xxhash64("fp", F.lit(7)), parts("wide", "weight"))
    across = scratch.put(heads.join(width, "root").withColumn("piece", piece).groupBy("root", "piece").applyInPandas(_check, PAIR), "across")
    so_far = inside.union(across)
    label = components(so_far.union(nodes.select("fp", F.col("fp").alias("b"))), scratch).select(F.col("node").alias("fp"), F.col("root").alias("label"))
    label = scratch.put(nodes.join(label, "fp"), "labels")
    size = label.groupBy("root", "label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("weight"))
    main = size.groupBy("root").agg(F.max_by("label", F.struct("sets", "label")).alias("main"), F.sum("sets").alias("all"), F.max("sets").alias("top"))
    rest = size.join(main.where("all > top"), "root").where("label != main").groupBy("root", "main").agg(F.sum("sets").alias("wide"), F.sum("weight").alias("weight"))
    open_ = scratch.put(label.join(rest, "root"), "open")
    if not open_.limit(1).count():
        return so_far
    # a set outside the largest component goes to the blocks where sets have a shingle of its prefix, together with those sets
    turn = F.pmod(F.xxhash64("fp", F.lit(3)), parts("wide", "weight"))
    some = small(open_.select("fp", "root", "block", F.when(F.col("label") != F.col("main"), turn).alias("slice")), SMALL_ROWS)
    plain = (F.col("n") + 1 - F.ceil(F.col("n") * NUM / DEN)).cast("int")
    held = scratch.put(ranked.join(some, "fp").select("root", "block", "slice", "fp", F.explode(F.slice("ranked", F.lit(1), plain)).alias("h")), "held")
    asked = held.where("slice is not null").select("h", "root", "slice").distinct()
    there = held.select("h", "root", "block").distinct()
    old = held.select("h", "root", "block", "fp").join(asked, ["h", "root"]).select("root", "block", "slice", "fp").distinct().withColumn("new", F.lit(False))
    new = held.where("slice is not null").select("h", "root", "slice", "fp").join(there, ["h", "root"]).select("root", "block", "slice", "fp").distinct().withColumn("new", F.lit(True))
    task = old.union(new).join(label.select("fp", "label"), "fp").join(members.select("fp", "set"), "fp")
    return so_far.union(scratch.put(task.groupBy("root", "block", "slice").applyInPandas(_check, PAIR), "outside"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(key, n_shingles, component_id): component_id is the smallest key reachable by links, its own included."""
    signed, mapped = _joined(docs, key, text, group)
    out = signed.select("doc_id", "n", "fp").join(mapped, "fp", "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _text_hash(text: str):
    return F.xxhash64(F.col(text).cast("binary"))


def _joined(docs: DataFrame, key: str, text: str, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Each row's (doc_id, tx: hash of its text, n, fp: its class, ...), and each class's (fp, root: its component, component_id)."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"), _text_hash(text).alias("tx"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    signed = scratch.put(texts.mapInArrow(_screen, SIGNED.format(kind)), "signed")

    offers = signed.where("offers is not null or told is not null").select("fp", F.explode(F.concat(F.transform(F.coalesce("offers", F.array().cast("array<bigint>")), lambda h: F.struct(h.alias("h"), F.lit(1).alias("w"))), F.transform(F.coalesce("told", F.array().cast("array<bigint>")), lambda h: F.struct(h.alias("h"), F.lit(0).alias("w"))))).alias("o")).select("fp", "o.h", "o.w")
    by_h = "partition by h"
    met = offers.selectExpr("fp", "w", f"min(fp) over ({by_h}) as lo", f"max(fp) over ({by_h}) as hi").where("lo != hi").groupBy("fp").agg(F.sum("w").alias("met"))
    classes = signed.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tx")).alias("one"), F.max("n").alias("n"), F.sum("met").alias("here"))
    kept = classes.join(met, "fp", "left").where(meets("n", F.coalesce("met", F.lit(0)) + F.col("here")))
    kept = scratch.put(kept.select("fp", F.col("one.doc_id").alias("one_id"), F.col("one.tx").alias("one_tx")), "kept")

    # one text of each class, by its row's key, which may be null, and the hash of its text
    chosen = texts.join(small(kept.select("one_id", "one_tx"), SMALL_ROWS), F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("tx") == F.col("one_tx")), "left_semi").select("text", "tx")
    sets = chosen.mapInArrow(_whole, "fp bigint, n bigint, set array<bigint>").join(small(kept.select("fp"), SMALL_ROWS), "fp", "left_semi")
    sets = scratch.put(sets.dropDuplicates(["fp"]), "sets")
    links = _links(sets, scratch, group)
    labels = components(links, scratch)

    owners = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    lowest = owners.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return signed, scratch.put(owners.join(lowest, "root").select("fp", "root", "component_id"), "mapped")


def meets(n: str, count):
    """Whether a set of n shingles met others in at least need(n); need() grows with n, so a step's lower end holds for all of it."""
    starts = [1]
    while starts[-1] < 20_000:
        starts.append(max(starts[-1] + 1, int(starts[-1] * 1.05)))
    needs = [need(x) for x in starts]
    least = F.pandas_udf(lambda s: pd.Series(np.take(needs, np.searchsorted(starts, s.to_numpy(), "right") - 1)), "bigint")
    return count >= least(n)


def _links(sets: DataFrame, scratch: Scratch, group: int) -> DataFrame:
    """Links (a, b) between classes, enough of them to connect all true components; every class of `sets` may appear."""
    shingle = sets.select("fp", F.explode("set").alias("h"))
    df = shingle.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = shingle.join(df, "h").groupBy("fp").agg(F.collect_list(F.struct("df", "h")).alias("common")).select("fp", F.col("common.df").alias("df"), F.col("common.h").alias("h"))
    whole = sets.join(common, "fp", "left").select("fp", "n", "set", "df", "h")
    ranked = scratch.put(whole.mapInArrow(_rank, "fp bigint, n bigint, ranked array<bigint>, scan bigint"), "ranked")
    boundary = cost_boundary([tuple(r) for r in ranked.groupBy("n").agg(F.count(F.lit(1)), F.sum("scan")).collect()])
    buckets = scratch.put(ranked.select("fp", "n", "ranked").mapInArrow(_signatures(boundary), "sig bigint, fp bigint"), "buckets")
    hubs = buckets.groupBy("sig").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub != top")
    stars = buckets.join(hubs, "sig").where("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    groups = scratch.put(components(stars, scratch), "groups")
    groups = small(groups.withColumnRenamed("node", "fp"), SMALL_ROWS).join(ranked.select("fp", "n"), "fp")
    size = groups.groupBy("root").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("weight"))
    groups = scratch.put(groups.join(size, "root").withColumn("large", (F.col("many") > group) | (F.col("weight") > ELEMENTS) & (F.col("many") > 2)), "sized")
    # where the groups can be broadcast, the sets are shuffled once, by group
    members = sets.select("fp", "set").join(small(groups, SMALL_ROWS), "fp").select("root", "fp", "n", "set", "many", "weight", "large")
    links = members.where("not large").groupBy("root").applyInPandas(_check, PAIR)
    if groups.where("large").limit(1).count():
        links = links.union(_large(scratch.put(members.where("large").drop("large"), "members"), ranked, scratch, group))
    return scratch.put(links, "links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, and every row whose text has no words.

    Rows are told apart by their key and text. The smallest key stays, nulls being larger than any; of rows
    that share it the one whose text has the smallest hash; of rows equal in key and text any one.
    """
    signed, mapped = _joined(docs, key, text)
    rows = signed.where("fp is not null").groupBy("doc_id", "tx").agg(F.max("fp").alias("fp"), F.count(F.lit(1)).alias("times")).join(mapped.select("fp", "root"), "fp")
    rows = Scratch(docs.sparkSession).put(rows.select("doc_id", "tx", "root", "times"), "rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tx")).alias("best"))
    gone = rows.join(best, "root").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tx") == F.col("best.tx")))).select(F.col("doc_id").alias("__gone_id"), F.col("tx").alias("__gone_tx"))
    repeated = rows.where("times > 1").limit(1).count() > 0
    out = docs.withColumn("__tx", _text_hash(text))
    out = out.join(small(gone, SMALL_ROWS), F.col(key).eqNullSafe(F.col("__gone_id")) & (F.col("__tx") == F.col("__gone_tx")), "left_anti")
    if repeated:
        # rows without words are numbered, so that none is taken for a repeat
        wordless = F.coalesce(~F.col(text).rlike(SPACE_WORD), F.lit(True))
        out = out.withColumn("__no", F.when(wordless, F.monotonically_increasing_id())).dropDuplicates([key, "__tx", "__no"])
    return out.select(*docs.columns)


ORACLE = r"""
with w as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select rid, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as g from w),
sets as (select rid, doc_id, len(g)::bigint as n_shingles, g, md5(array_to_string(list_sort(g), chr(31))) as fp from s),
classes as (select fp, any_value(g) as g, any_value(n_shingles) as n from sets where n_shingles > 0 group by fp),
e as (select fp, n, unnest(g) as x from classes),
common as (select a.fp as a, b.fp as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from e a join e b on a.x = b.x and a.fp < b.fp and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.fp, b.fp),
links as (select a, b from common where 100 * c >= 80 * (na + nb - c)),
twoway as (select a, b from links union select b, a from links),
reach as (with recursive r(a, b) as (select fp, fp from classes union select r.a, twoway.b from r join twoway on r.b = twoway.a) select a, b from r),
low as (select reach.a as fp, min(sets.doc_id) as component_id from reach join sets on sets.fp = reach.b group by reach.a)
select sets.doc_id, sets.n_shingles, coalesce(low.component_id, sets.doc_id) as component_id from sets left join low on sets.fp = low.fp and sets.n_shingles > 0
"""
