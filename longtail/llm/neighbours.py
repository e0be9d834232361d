"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample (SAMPLE vectors) and every vector is indexed:
in the list of its nearest centroid and, near a boundary, in those of further centroids
up to (1 + REPLICATE) times as far, COPIES at most. A query searches every list whose
centroid is at most a ratio times as far as the nearest, and LEAST_LISTS at least; no number caps the
lists. The ratio is the least that finds a share `recall` of the nearest neighbours of PROBES vectors of the sample
within the sample (in the whole table neighbours are nearer, so the share is higher there). Centroids are found by a walk on a graph that links each with its nearest LINKS: it starts from evenly
spread entries and goes on from every centroid that is near enough to be chosen itself.

Equal vectors are one entry with the smallest ids that any answer can need, so a vector
that a third of all rows share costs a row a task. Lists are dealt into bundles of about CAP
entries, so that a query is sent once to a bundle and not once to a list; bundles over CAP are
dealt into pieces; each piece answers by itself, for ASK_CAP queries or so at a time, and the
answers are merged.

Defined cases: null, empty and zero vectors and those with null or non-finite components take
no part, as queries neither; nor do vectors of another than the most frequent dimension;
rows that repeat an id and its vector count once; distances that tie go to the smaller id;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sent

SAMPLE, PER_LIST, MAX_CENTROIDS = 20_000, 128, 4096
REPLICATE, COPIES = 0.005, 4
RECALL, LEAST_LISTS = 0.99, 8
PROBES = 512
LINKS, WIDE = 16, 16
CAP, ASK_CAP = 16_384, 65_536
ASKED = 256


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0))


def fit(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids or so, balanced: after Lloyd's rounds, lists of more than twice the mean are cut in two and empty ones go."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:k]].copy()

    def assign() -> np.ndarray:
        return np.concatenate([_distances(sample[i : i + 2048], c).argmin(1) for i in range(0, len(sample), 2048)])

    for _ in range(rounds):
        near = assign()
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c = total[n > 0] / n[n > 0][:, None]
        big = np.flatnonzero(n[n > 0] > max(2, 2 * len(sample) / k))
        if len(big) and len(c) < 2 * k:
            c = np.concatenate([c, c[big] + rng.normal(0, 0.05, (len(big), c.shape[1])) * sample.std(0)])
    return c


def graph(c: np.ndarray) -> np.ndarray:
    """Of each centroid, the LINKS nearest and the next one by number, which keeps the graph in one piece."""
    near = [np.argsort(_distances(c[i : i + 512], c), axis=1, kind="stable")[:, 1 : LINKS + 1] for i in range(0, len(c), 512)]
    return np.concatenate([np.concatenate(near), (np.arange(len(c))[:, None] + 1) % len(c)], axis=1)


def walk(x: np.ndarray, c: np.ndarray, links: np.ndarray, ratio: float, wide: int) -> np.ndarray:
    """Distances of each vector to the centroids that its walk meets, infinite elsewhere.

    A walk goes on from all centroids at most (1 + ratio) times as far as the nearest met, and from the `wide` nearest.
    """
    d = np.full((len(x), len(c)), np.inf)
    entries = np.unique(np.linspace(0, len(c) - 1, max(1, int(np.sqrt(len(c))))).astype(int))
    d[:, entries] = _distances(x, c[entries])
    gone = np.zeros(d.shape, bool)
    wide = min(wide, len(c)) - 1
    while True:
        bound = np.maximum((1 + ratio) * d.min(1), np.partition(d, wide, axis=1)[:, wide])
        rows, nodes = np.nonzero((d <= bound[:, None]) & ~gone & (d < np.inf))
        if not len(rows):
            return d
        gone[rows, nodes] = True
        to = np.unique((rows[:, None] * len(c) + links[nodes]).ravel())
        rows, nodes = np.divmod(to[np.isinf(d.ravel()[to])], len(c))
        for i in range(0, len(rows), 1 << 15):
            r, n = rows[i : i + (1 << 15)], nodes[i : i + (1 << 15)]
            d[r, n] = np.sqrt(((x[r] - c[n]) ** 2).sum(1))


def ratio_for(x: np.ndarray, c: np.ndarray, links: np.ndarray, k: int, recall: float) -> float:
    """The least distance ratio by which the sample's first vectors find a share `recall` of their k nearest others in the sample."""
    needs = []
    for i in range(0, min(PROBES, len(x)), 64):
        q = x[i : i + 64]
        d = _distances(q, x)
        d[np.arange(len(q)), np.arange(i, i + len(q))] = np.inf
        near = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
        dq = _distances(q, c)
        dq /= np.maximum(dq.min(1, keepdims=True), 1e-12)
        stored = _stored(x[near.ravel()], c, links)
        found = np.where(stored, np.repeat(dq, near.shape[1], axis=0), np.inf)
        needs.append(found.min(1) if found.size else np.empty(0))
    needs = np.concatenate(needs) if needs else np.empty(0)
    return float(np.quantile(needs, recall, method="higher")) if len(needs) else np.inf


def _stored(x: np.ndarray, c: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Whether each vector is stored in each list."""
    d = walk(x, c, links, REPLICATE, WIDE)
    least = np.partition(d, min(COPIES, d.shape[1]) - 1, 1)[:, min(COPIES, d.shape[1]) - 1]
    return (d <= (1 + REPLICATE) * d.min(1, keepdims=True)) & (d <= least[:, None]) & (d < np.inf)


def _classes(dim: int, keep: int):
    """Equal vectors of a task as one row with their smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, set[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(v, sorted(ids)) for v, ids in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.list_(pa.int64()))], names=["vec", "ids"])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) + 0.0
            for key, v in zip(batch.column(0).to_pylist(), flat):
                ids = held.setdefault(v.tobytes(), set())
                ids.add(key)
                if len(ids) > keep:
                    ids.remove(max(ids))
            if len(held) >= 1 << 15:
                yield out()
        if held:
            yield out()

    return run


def _spread(get, query: bool, bundles: int, least: int):
    """(bundle, lists, vec, ids): where each vector is stored, or searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, links, ratio = get()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            for i in range(0, len(x), 256):
                if query:
                    d = walk(x[i : i + 256], c, links, ratio - 1, max(least, WIDE))
                    low = np.partition(d, min(least, d.shape[1]) - 1, 1)[:, min(least, d.shape[1]) - 1]
                    at, to = np.nonzero((d <= np.maximum(ratio * d.min(1), low)[:, None]) & (d < np.inf))
                else:
                    at, to = np.nonzero(_stored(x[i : i + 256], c, links))
                by = np.lexsort((to, to % bundles, at))
                at, to = at[by], to[by]
                first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (to[1:] % bundles != to[:-1] % bundles)]))
                rows = pa.array(at[first] + i)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(to)), pa.int32()), pa.array(to, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(to[first] % bundles, pa.int32()), lists, batch.column(0).take(rows), batch.column(1).take(rows)], names=["bundle", "lists", "vec", "ids"])

    return run


def _answer(keep: int):
    """Nearest entries of one piece of a bundle, for each query sent to it, among those stored in a list that it searches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["ask"].to_numpy()
        qs, cs = pdf[asks], pdf[~asks]
        rows = []
        if len(qs) and len(cs):
            c = np.frombuffer(b"".join(cs["vec"]), np.float64).reshape(len(cs), -1)
            ids = cs["ids"].tolist()
            low = np.array([i[0] for i in ids])
            at = np.repeat(np.arange(len(c)), [len(v) for v in cs["lists"]])
            stored = np.concatenate(cs["lists"].tolist())
            every = np.unique(stored)
            vecs, owns, asked = qs["vec"].tolist(), qs["ids"].tolist(), qs["lists"].tolist()
            for i in range(0, len(vecs), ASKED):
                q = np.frombuffer(b"".join(vecs[i : i + ASKED]), np.float64).reshape(-1, c.shape[1])
                rough = _distances(q, c)
                # _distances loses digits by cancellation; what it leaves within this of the last place is compared exactly
                slack = 1e-6 * np.sqrt((q * q).sum(1) + (c * c).sum(1).max())
                for j, d in enumerate(rough):
                    searched = np.isin(every, asked[i + j])
                    if not searched.all():
                        out = np.ones(len(c), bool)
                        out[at[searched[np.searchsorted(every, stored)]]] = False
                        d[out] = np.inf
                    last = np.partition(d, keep - 1)[keep - 1] if len(d) > keep else np.inf
                    some = np.flatnonzero((d <= last + slack[j]) & (d < np.inf))
                    exact = np.sqrt(((c[some] - q[j]) ** 2).sum(1))
                    rows += [(int(owns[i + j][0]), float(exact[n]), ids[some[n]]) for n in np.lexsort((low[some], exact))[:keep]]
        return pd.DataFrame(rows, columns=["q", "score", "ids"])

    return run


def _merge(k: int):
    """Of one class of equal queries: the nearest candidates of each of its rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, float] = {}
        for d, ids in zip(pdf["score"], pdf["ids"]):
            for i in ids:
                found[int(i)] = d
        return pd.DataFrame([(int(pdf["q"].iloc[0]), d, i) for d, i in sorted((d, i) for i, d in found.items())[: k + 1]], columns=["q", "score", "vec_id"])

    return run


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return v.where((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries, k: int = 10, key: str = "vec_id", vector: str = "embedding", least: int = LEAST_LISTS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which `queries(id column)` holds; recall: see the module's text."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = valid(vectors, key, vector)
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return empty
    rows = rows.where(F.size("v") == dims["dim"])
    scratch = Scratch(spark)

    def classes(of: DataFrame, keep: int) -> DataFrame:
        part = of.mapInArrow(_classes(dims["dim"], keep), "vec binary, ids array<bigint>")
        return part.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))

    entries = scratch.put(classes(rows, k + 1), "entries")
    n = entries.count()
    # the hash range is cut first, so that a task sends its share of the sample and no more
    share = entries.select("vec", F.xxhash64("vec").alias("order")).where(F.pmod("order", F.lit(1_000_003)) <= min(1.0, 1.2 * SAMPLE / max(1, n)) * 1_000_003)
    sample = share.orderBy("order", "vec").limit(SAMPLE).collect()
    x = np.frombuffer(b"".join(bytes(r[0]) for r in sample), np.float64).reshape(len(sample), -1)
    c = fit(x, max(1, min(n // PER_LIST, MAX_CENTROIDS, len(x) // 4)))
    links = graph(c)
    centroids = sent(spark, (c, links, ratio_for(x, c, links, k, recall)))
    bundles = max(1, min(len(c), -(-n * COPIES // CAP)))
    kinds = "bundle int, lists array<int>, vec binary, ids array<bigint>"

    posting = scratch.put(entries.mapInArrow(_spread(centroids, False, bundles, least), kinds), "posting")
    pieces = posting.groupBy("bundle").count().select("bundle", F.ceil(F.col("count") / CAP).cast("int").alias("pieces"))
    asked = rows.where(queries(F.col("id")))
    ask = classes(asked, 1)  # a class of equal queries goes by its smallest id
    ask = scratch.put(ask, "ask")
    routes = ask.mapInArrow(_spread(centroids, True, bundles, least), kinds)
    turns = F.lit(max(1, -(-ask.count() // ASK_CAP)))
    # bundles are no more than lists (at most 2 * MAX_CENTROIDS), so their sizes may be broadcast
    stored = posting.join(F.broadcast(pieces), "bundle").select("bundle", F.pmod(F.xxhash64("vec"), "pieces").cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"), "lists", "vec", "ids", F.lit(False).alias("ask"))
    sent_to = routes.join(F.broadcast(pieces), "bundle").select("bundle", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("vec"), turns).cast("int").alias("turn"), "lists", "vec", "ids", F.lit(True).alias("ask"))
    near = stored.unionByName(sent_to).groupBy("bundle", "piece", "turn").applyInPandas(_answer(k + 1), "q bigint, score double, ids array<bigint>")
    best = near.groupBy("q").applyInPandas(_merge(k), "q bigint, score double, vec_id bigint")

    own = asked.mapInArrow(_keyed, "query_id bigint, vec binary").distinct().join(ask.select("vec", F.col("ids")[0].alias("q")), "vec").select("query_id", "q")
    out = own.join(best, "q").where("vec_id != query_id")
    rank = F.expr("cast(row_number() over (partition by query_id order by score, vec_id) as int)")
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in flat], pa.binary())], names=["query_id", "vec"])
