"""A log-bilinear language model, trained with noise-contrastive estimation.

A text is its words and one end token. The next token's score is the product of its output
vector with the sum of the two preceding tokens' input vectors, each times a vector of its
position, plus a bias. The symbols are the WORDS most frequent training words, the end and, for
all other words, ENDINGS classes by their last two bytes. Since the score is a sum over positions,
three matrix products give the normalised log-probability of every symbol after every pair of symbols.

Within its class a word is drawn by its training count c, with one symbol for all words of
the class that training has not seen: (c + 0.1) / (1.1 n + 0.1), n being the class's training tokens. A class of
n tokens has at most n different words, so this sums to 1 at most.

Three passes over the texts: exact counts of all words; training; scoring. Training deals its rows to learners of LEARN
tokens, however the table is partitioned: each goes EPOCHS times over its tokens from the same start, and the
parameters are averaged by tokens. Counts of words outside the HEAD most frequent can be many and are not broadcast: their
occurrences, one row a text and word, are joined with the counts by word hash (an equi-join of which Spark
may split a hot key) and summed by text.

Defined cases: a null text is an empty one, which is the end token; without training rows the model
is its start and all counts are 0; rows that share an id are scored each on its own;
empty tables give empty results; other columns are dropped. Word hashes have 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sent, slices, word_bytes

WORDS, ENDINGS, DIM = 2048, 512, 24
HEAD = 100_000
BATCH, NOISE, RATE = 2048, 32, 0.1
CHUNK, GROUP_BYTES = 1 << 20, 1 << 20
#: Tokens of a learner, and how often it goes over them.
LEARN, EPOCHS = 1 << 20, 2
#: Seed of Spark's xxhash64.
SEED = 42
LOG10 = np.log(10.0)


@dataclass
class Bilinear:
    """Scores of `outputs` symbols after two contexts among `inputs` symbols."""

    into: np.ndarray  # inputs x DIM
    out: np.ndarray  # outputs x DIM
    place: np.ndarray  # 2 x DIM
    bias: np.ndarray  # outputs
    noise: np.ndarray  # outputs: the noise distribution

    @classmethod
    def start(cls, inputs: int, share: np.ndarray, seed: int = 5, dim: int = DIM) -> Bilinear:
        rng = np.random.default_rng(seed)
        share = (share / share.sum()).astype(np.float64)
        f = lambda *n: rng.normal(0, 0.3, n).astype(np.float32)
        return cls(f(inputs, dim), f(len(share), dim) * 0.3, np.array([[1.0], [0.6]], np.float32).repeat(dim, 1), np.log(share).astype(np.float32), share)

    def parts(self) -> list[np.ndarray]:
        return [self.into, self.out, self.place, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Bilinear:
        got, at = [], 0
        for p in self.parts():
            got.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Bilinear(*got, self.noise)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A, B, Z): ln p(w | a, b) = A[a, w] + B[b, w] - Z[a, b], a the nearer context."""
        a = (self.into * self.place[0]) @ self.out.T + self.bias
        b = (self.into * self.place[1]) @ self.out.T
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        ea, eb, z = np.exp(a - top_a), np.exp(b - top_b).T.copy(), np.empty((len(a), len(b)), np.float32)
        for i in range(0, len(a), 256):
            z[i : i + 256] = np.log(ea[i : i + 256] @ eb)
        z += top_a
        z += top_b.T
        return a, b, z


def _rows(ids: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their summed gradient rows."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # symbols are fewer than 2**16; of 16 bits this is a radix sort
    some = ids[order]
    first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
    return some[first], np.add.reduceat(grad[order], first)


class Trainer:
    """Adagrad on the noise-contrastive objective, NOISE shared noise words a batch; weights, if given, count the examples."""

    def __init__(self, model: Bilinear, seed, rate: float = RATE):
        self.m, self.rate, self.rng = model.filled(model.flat()), rate, np.random.default_rng(seed)
        self.sums = [np.full(p.shape, 1e-1, np.float32) for p in self.m.parts()]
        self.cdf = np.cumsum(model.noise)
        self.ln = np.log(NOISE * model.noise).astype(np.float32)

    def _move(self, k: int, rows, grad: np.ndarray) -> None:
        p, s = self.m.parts()[k], self.sums[k]
        s[rows] += grad * grad
        p[rows] += self.rate * grad / np.sqrt(s[rows])

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, weight: np.ndarray | None = None) -> None:
        m = self.m
        n = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), len(self.cdf) - 1)
        ia, ib, ow, on = m.into[a], m.into[b], m.out[w], m.out[n]
        h = ia * m.place[0] + ib * m.place[1]
        real = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, ow) + m.bias[w] - self.ln[w]))
        fake = -1 / (1 + np.exp(-(h @ on.T + m.bias[n] - self.ln[n])))
        if weight is not None:
            real, fake = real * weight, fake * weight[:, None]
        scale = np.float32(32.0 / len(w))
        real, fake = real * scale, fake * scale
        dh = real[:, None] * ow + fake @ on
        rows, g = _rows(np.concatenate([w, n]), np.concatenate([np.column_stack([real[:, None] * h, real]), np.column_stack([fake.T @ h, fake.sum(0)])]))
        self._move(1, rows, g[:, :-1])
        self._move(3, rows, g[:, -1])
        ra, ga = _rows(np.concatenate([a, b]), np.concatenate([dh * m.place[0], dh * m.place[1]]))
        self._move(0, ra, ga)
        self._move(2, slice(None), np.stack([(dh * ia).sum(0), (dh * ib).sum(0)]))


def learn(trainer: Trainer, rng: np.random.Generator, near: np.ndarray, far: np.ndarray, out: np.ndarray) -> None:
    """One pass over the examples, shuffled."""
    order = rng.permutation(len(out))
    for i in range(0, len(order), BATCH):
        pick = order[i : i + BATCH]
        trainer.step(near[pick], far[pick], out[pick])


@dataclass
class Vocab:
    """head: word -> index, most frequent first, so that those below `words` are symbols; endings: last two bytes -> symbol."""

    head: dict[bytes, int]
    words: int
    endings: dict[bytes, int]

    @property
    def end(self) -> int:
        return self.words

    def symbols(self) -> int:
        return self.words + 1 + ENDINGS

    def symbol(self, w: bytes) -> int:
        """The class of a word that is no symbol itself; endings beyond the frequent ones share the last class."""
        return self.endings.get(w[-2:], self.words + ENDINGS)

    @cached_property
    def of(self) -> np.ndarray:
        """The symbol of each head word, and of the last class."""
        return np.array([*(i if i < self.words else self.symbol(w) for w, i in self.head.items()), self.words + ENDINGS], np.int32)

    def ids(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts' tokens in a row: head index (-1 if none, -2 for the end), nearer and farther context, symbol."""
        end, get, endings, rest, unknown = self.end, self.head.get, self.endings.get, self.words + ENDINGS, repeat(-1)
        total = sum(map(len, texts)) + len(texts)
        index, out = np.empty(total, np.int32), np.empty(total, np.int32)
        first = np.zeros(total, bool)
        at = 0
        for ws in texts:
            k = len(ws)
            index[at : at + k] = got = np.fromiter(map(get, ws, unknown), np.int32, k)
            out[at : at + k] = self.of[got]
            other = np.flatnonzero(got < 0)
            out[at + other] = [endings(ws[j][-2:], rest) for j in other.tolist()]
            index[at + k], out[at + k], first[at] = -2, end, True
            at += k + 1
        near = np.roll(out, 1)
        near[first] = end
        far = np.roll(near, 1)
        far[first] = end
        return index, near, far, out


def vocabulary(head: list[tuple[bytes, int]], words: int) -> tuple[Vocab, np.ndarray]:
    """The vocabulary of the frequent words, and a first guess of each symbol's count."""
    words = min(words, len(head))
    ends: Counter = Counter()
    for w, c in head[words:]:
        ends[w[-2:]] += c
    top = [e for e, _ in sorted(ends.items(), key=lambda x: (-x[1], x[0]))[: ENDINGS - 1]]
    vocab = Vocab({w: i for i, (w, _) in enumerate(head)}, words, {e: words + 1 + i for i, e in enumerate(top)})
    share = np.ones(vocab.symbols())
    for i, (w, c) in enumerate(head):
        share[i if i < words else vocab.symbol(w)] += c
    share[vocab.end] = max(1.0, share.sum() / 300)
    return vocab, share


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each chunk's words, and how many texts and tokens it has under null."""
    count: Counter = Counter()
    tokens = texts = 0

    def out() -> pa.RecordBatch:
        got = [*count.items(), (None, texts)]
        count.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.binary()), pa.array([n for _, n in got], pa.int64())], names=["word", "n"])

    for _, _, group in _groups(batches):
        for ws in group:
            count.update(ws)
            tokens += len(ws)
        texts += len(group)
        if tokens >= CHUNK:
            yield out()
            tokens = texts = 0
    if texts:
        yield out()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[list[bytes]]]]:
    """Each batch's rows, some at a time: the batch, the first row, and the rows' words."""
    for batch in batches:
        for first, texts in slices(batch.column(0), GROUP_BYTES):
            yield batch, first, [word_bytes(t) for t in texts]


def _train(get, size: int, epochs: int):
    """Of each task: tokens of each symbol, and its learners' parameters times their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, start = get()
        symbols, total = np.zeros(vocab.symbols()), np.zeros(start.flat().size)
        kept, held, learners = [], 0, 0

        def finish() -> None:
            nonlocal total, held, learners
            if held:
                seed = (TaskContext.get().partitionId(), learners)
                trainer, rng = Trainer(start, seed), np.random.default_rng(seed)
                near, far, out = (np.concatenate(x) for x in zip(*kept))
                for _ in range(epochs):
                    learn(trainer, rng, near, far, out)
                total += trainer.m.flat().astype(np.float64) * held
                learners += 1
                kept.clear()
                held = 0

        for _, _, group in _groups(batches):
            _, near, far, out = vocab.ids(group)
            symbols += np.bincount(out, minlength=len(symbols))
            kept.append((near, far, out))
            held += len(out)
            if held >= size:
                finish()
        finish()
        if learners:
            rows = {"symbols": symbols, "model": total}
            yield pa.RecordBatch.from_arrays([pa.array(list(rows)), pa.array(list(rows.values()), pa.list_(pa.float64()))], names=["kind", "v"])

    return run


@dataclass
class Model:
    vocab: Vocab
    counts: np.ndarray  # training count of each head word
    symbols: np.ndarray  # training tokens of each symbol
    tokens: int
    texts: int
    distinct: int  # words of the training texts
    net: Bilinear
    rare: DataFrame | None  # (h, c): training counts of the words outside the head

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Made where it is used: the parameters are a hundredth of its size."""
        return self.net.tables()

    def log10(self, near: np.ndarray, far: np.ndarray, out: np.ndarray) -> np.ndarray:
        """log10 p(symbol | contexts)."""
        a, b, z = self.table
        return (a[near, out].astype(np.float64) + b[far, out] - z[near, far]) / LOG10


def least_count(counted: DataFrame, most: int) -> int:
    """A count that at most `most` of the words reach, from a histogram in steps of a fiftieth of a natural logarithm."""
    steps = counted.groupBy(F.floor(F.ln("n") * 50).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("low")).collect()
    total, least = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["words"]
        if total > most:
            break
        least = r["low"]
    return least


def fit(docs: DataFrame, train: Column, text: str = "text", words: int = WORDS, head: int = HEAD, size: int = LEARN, epochs: int = EPOCHS) -> Model:
    """The model learnt from the rows for which `train` holds."""
    texts = docs.where(train).select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    spark = docs.sparkSession
    scratch = Scratch(spark)
    counted = scratch.put(texts.mapInArrow(_counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counted")
    every = counted.where("word is not null")
    sums = {r["of"]: r for r in counted.groupBy(F.col("word").isNull().alias("of")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    n_texts = sums[True]["n"] if True in sums else 0
    n_words, distinct = (sums[False]["n"], sums[False]["rows"]) if False in sums else (0, 0)
    tokens = n_words + n_texts
    least = least_count(every, head)
    frequent = sorted(((bytes(r["word"]), r["n"]) for r in every.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))
    vocab, share = vocabulary(frequent, words)
    start = Bilinear.start(vocab.symbols(), share)
    # a task holds a learner's tokens or more, so that small partitions make no weaker learners
    dealt = texts.coalesce(max(1, tokens // size))
    parts = dealt.mapInArrow(_train(sent(spark, (vocab, start)), size, epochs), "kind string, v array<double>").select("kind", F.posexplode("v")).groupBy("kind", "pos").agg(F.sum("col").alias("v"))
    got = {"symbols": np.zeros(vocab.symbols()), "model": np.zeros(start.flat().size)}
    table = parts.toArrow()
    kinds, pos, v = (table[c].to_numpy() for c in ("kind", "pos", "v"))
    for name, into in got.items():
        into[pos[kinds == name]] = v[kinds == name]
    model = start.filled(got["model"] / tokens) if tokens else start
    counts = np.array([n for _, n in frequent], np.float64)
    rare = every.where(F.col("n") < least).select(F.xxhash64("word").alias("h"), F.col("n").alias("c"))
    return Model(vocab, counts, got["symbols"], tokens, n_texts, distinct, model, rare)


SCORED = "h bigint, rid bigint, doc_id {}, learnt boolean, n bigint, tokens bigint, known bigint, base double, score double"
NAMES = ["h", "rid", "doc_id", "learnt", "n", "tokens", "known", "base", "score"]


def _score(get):
    """A row for each text with what the head gives, and one for each of its words outside the head.

    base lacks the count of such words and, for every token, the denominator; score lacks the count of such words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        vocab, n = m.vocab, m.vocab.words
        # at -2 the end, at -1 a word outside the head
        log_count = np.log10(np.concatenate([m.counts + 0.1, [m.texts + 0.1, 1.0]]))
        is_known = np.concatenate([m.counts > 0, [m.texts > 0, False]])
        within = np.log10(1.1 * m.symbols + 0.1)
        rid = TaskContext.get().partitionId() << 33
        for batch, a, group in _groups(batches):
            index, near, far, out = vocab.ids(group)
            base = log_count[index]
            lp = m.log10(near, far, out)
            inner = (index >= n) | (index == -1)
            lp[inner] += base[inner] - within[out[inner]]
            starts = np.concatenate([[0], np.cumsum([len(ws) + 1 for ws in group])[:-1]])
            learnt = batch.column(2).slice(a, len(group))
            rids = rid + np.arange(len(group))
            rid += len(group)
            sums = (np.add.reduceat(x, starts) for x in (np.ones(len(index), np.int64), is_known[index].astype(np.int64), base, lp))
            own = [xxhash.xxh64_intdigest(int(r).to_bytes(8, "little"), 1) - (1 << 63) for r in rids]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(rids), batch.column(1).slice(a, len(group)), learnt, pa.nulls(len(group), pa.int64()), *map(pa.array, sums)], names=NAMES)
            seen: dict[bytes, int] = {}
            texts, which, times = [], [], []
            at = 0
            for i, ws in enumerate(group):
                c: dict[int, int] = {}
                for j in np.flatnonzero(index[at : at + len(ws)] == -1).tolist():
                    k = seen.setdefault(ws[j], len(seen))
                    c[k] = c.get(k, 0) + 1
                at += len(ws) + 1
                texts.append(np.full(len(c), i))
                which.extend(c)
                times.extend(c.values())
            if which:
                h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in seen], np.uint64).view(np.int64)
                texts, k = np.concatenate(texts), len(which)
                empty = (pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(h[which]), pa.array(rids[texts]), pa.nulls(k, batch.column(1).type), learnt.take(pa.array(texts)), pa.array(times, pa.int64()), *empty], names=NAMES)

    return run


def score(docs: DataFrame, model: Model, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; `train` marks the rows that the model has learnt from."""
    kind = docs.schema[key].dataType.simpleString()
    get = sent(docs.sparkSession, replace(model, rare=None))
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.col(key).alias("doc_id"), train.alias("learnt")).mapInArrow(_score(get), SCORED.format(kind))
    word = rows.join(model.rare, "h", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("bigint")))
    each = word.selectExpr(
        "rid", "doc_id", "if(n is null, learnt, null) as learnt", "tokens", "if(n is null, known, if(c > 0, n, 0L)) as known",
        "if(n is null, base, n * log10(c + 0.1D)) as base", "if(n is null, score, n * log10(c + 0.1D)) as score",
    )
    sums = [F.max("doc_id").alias("doc_id"), F.max("learnt").alias("learnt"), F.max("tokens").alias("tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score")]
    total = float(np.log10(model.tokens + 0.1 * (model.distinct + (model.texts > 0) + 1)))
    return each.groupBy("rid").agg(*sums).select(
        F.col("doc_id").alias(key), (~F.col("learnt")).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("tokens") * F.lit(total)).alias("base_score"), "score",
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op1."""
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(True))
    return score(docs, fit(docs, train), train)
