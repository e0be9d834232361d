"""Toxicity grades by cumulative-link ordinal regression over sparse words.

P(grade <= k | x) = sigmoid(t_k - w.x): one weight vector for all thresholds, and thresholds
in order (their steps are exponentials). x holds log(1 + count) of words and of word beginnings of STEMS bytes, from a
vocabulary of those that are MARK times as frequent in toxic texts as in clean ones and that SUPPORT of the toxic texts
hold. The expected severity is the sum of P(grade > k).

The model is fitted on at most SAMPLE labelled texts, half of them toxic if there are as many, chosen by the hash
of their ids; scoring reads each whole text once, where it lies.

Labels of more than two values are the grades. The tables' labels are 0 or 1. `graded` makes grades 0 to 3 of them: 0 for clean
texts, and for toxic ones the third of toxic texts in which the number of words and beginnings of that vocabulary falls.

Defined cases: a null or empty text has no words, and its severity is that of an empty x; labelled rows
without text, and null labels, are not used; without rows of two grades every severity is 0; an id that is labelled twice
gives a row for each label to the sample; repeated texts are scored each on its own. `score` replaces columns named like an output.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sent

SAMPLE, VOCAB, MARK = 6000, 1024, 8.0
STEMS = (4, 5, 6)
SUPPORT = 0.02
RIDGE, ROUNDS = 1e-4, 600
CACHE = 1 << 20
#: Lower-cases A-Z and turns ASCII other than letters and digits into blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def tokens(text: bytes) -> Iterator[bytes]:
    """The text's words, and the beginnings of longer ones, marked by a hyphen."""
    for w in words(text):
        yield w
        for k in STEMS:
            if len(w) > k:
                yield w[:k] + b"-"


@dataclass
class Model:
    vocab: dict[bytes, int]
    weight: np.ndarray
    thresholds: np.ndarray

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) of each text for each threshold k."""
        z = np.zeros(len(texts))
        cache: dict[bytes, tuple[int, ...]] = {}
        get, vocab = cache.get, self.vocab
        for i, t in enumerate(texts):
            hits: list[int] = []
            for w in words(t):
                if (found := get(w)) is None:
                    found = cache[w] = tuple(vocab[x] for x in (w, *(w[:k] + b"-" for k in STEMS if len(w) > k)) if x in vocab)
                if found:
                    hits += found
            if hits:
                j, n = np.unique(hits, return_counts=True)
                z[i] = (self.weight[j] * np.log1p(n)).sum()
            if len(cache) > CACHE:
                cache.clear()
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - z[:, None], -50, 50)))


def features(counts: list[Counter], vocab: dict[bytes, int]) -> np.ndarray:
    x = np.zeros((len(counts), len(vocab)), np.float32)
    for i, c in enumerate(counts):
        for w, n in c.items():
            if (j := vocab.get(w)) is not None:
                x[i, j] = np.log1p(n)
    return x


def choose(counts: list[Counter], positive: np.ndarray, most: int = VOCAB) -> list[bytes]:
    """The words that mark positive texts, those of most positive texts first."""
    a: Counter = Counter()
    b: Counter = Counter()
    for c, p in zip(counts, positive):
        (a if p else b).update(c.keys())
    na, nb = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    marks = [w for w, n in a.items() if n >= max(3, SUPPORT * na) and n / na >= MARK * (b[w] + 0.5) / nb]
    return sorted(marks, key=lambda w: (-a[w], w))[:most]


def graded(counts: list[Counter], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 of texts labelled toxic or not; see the module's text."""
    marked = set(choose(counts, toxic))
    many = np.array([sum(n for w, n in c.items() if w in marked) for c in counts])
    out = np.zeros(len(counts), np.int64)
    if toxic.any():
        low, high = np.quantile(many[toxic], [1 / 3, 2 / 3])
        out[toxic] = 1 + (many[toxic] > low) + (many[toxic] > high)
    return out


def fit(texts: list[bytes], grades: np.ndarray | None = None, toxic: np.ndarray | None = None) -> Model:
    """The model of texts with grades 0, 1, ..., or of texts labelled toxic or not, whose grades are made here."""
    counts = [Counter(tokens(t)) for t in texts]
    if grades is None:
        grades = graded(counts, np.asarray(toxic, bool))
    levels = np.unique(grades)
    if len(levels) < 2:
        return Model({}, np.zeros(0), np.full(3, 50.0))
    y = np.asarray(grades)
    chosen = choose(counts, y > 0)
    vocab = {w: j for j, w in enumerate(chosen)}
    x = features(counts, vocab)
    top = int(y.max())
    # parameters: first threshold, logs of the further steps, weights; Adam on the mean negative log-likelihood
    first = np.log((y <= 0).mean() / (1 - (y <= 0).mean() + 1e-9) + 1e-9)
    theta = np.concatenate([[first], np.zeros(top - 1), np.zeros(len(vocab))])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -50, 50)))
    rows = np.arange(len(y))
    for r in range(1, ROUNDS + 1):
        steps = np.exp(theta[1:top])
        cuts = np.concatenate([[-np.inf], theta[0] + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
        z = x @ theta[top:].astype(np.float32)
        with np.errstate(invalid="ignore"):
            hi, lo = sig(cuts[y + 1] - z), sig(cuts[y] - z)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gz = (dhi - dlo) / len(y)
        gc = np.zeros((len(y), top + 2))
        gc[rows, y + 1] -= dhi
        gc[rows, y] += dlo
        gc = gc.sum(0)[1:-1] / len(y)
        g = np.concatenate([[gc.sum()], [gc[k:].sum() * steps[k - 1] for k in range(1, top)], x.T @ gz.astype(np.float32) + RIDGE * theta[top:]])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta -= 0.1 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8)
    return Model(vocab, theta[top:], theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:top]))]))


def sample(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> list[tuple[bytes, int]]:
    """At most `most` labelled texts, by the hash of their ids."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    marks = (marks if where is None else marks.where(where)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    # at most `most` rows: small enough to broadcast
    positive, clean = (marks.where(c).orderBy(F.xxhash64("key"), "key", "label").limit(most // 2) for c in ("label > 0", "label <= 0"))
    some = positive.union(clean)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).where("text is not null").join(F.broadcast(some), "key")
    return [(bytes(r["text"]), r["label"]) for r in rows.select("text", "label").toLocalIterator()]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None, **options) -> Model:
    got = sorted(set(sample(docs, labels, label, where, **options)))  # copies count once
    texts, grades = [t for t, _ in got], np.maximum([x for _, x in got], 0).astype(np.int64)
    if len(np.unique(grades)) > 2:
        return fit(texts, np.unique(grades, return_inverse=True)[1])
    return fit(texts, toxic=grades > 0)


OUTPUTS = ("severity", "grade", "p_toxic", "toxic")


def score(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """docs with severity (expected grade), grade (the most likely one), p_toxic = P(grade > 0) and toxic (p_toxic >= 1/2), under the names given."""
    made = [T.StructField(n, k) for n, k in zip(names, (T.DoubleType(), T.IntegerType(), T.DoubleType(), T.BooleanType()))]
    replaced = {n.lower() for n in names}
    kept = [f for f in docs.schema.fields if f.name.lower() not in replaced]
    (raw,) = fresh(docs, "raw")
    get = sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        for batch in batches:
            p = model.above([t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()])
            each = -np.diff(np.column_stack([np.ones(len(p)), p, np.zeros(len(p))]), axis=1)
            new = [pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *names])

    given = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text).cast("binary").alias(raw))
    return given.mapInArrow(run, T.StructType([*kept, *made]))


#: Labelled rows of this fold of crc32(doc_id as text) are left out of the sample, to measure with.
FOLDS, FOLD_OUT = 5, 0


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, severity, grade, p_toxic, toxic) of every text."""
    out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == FOLD_OUT
    model = train(docs, labels, where=~out)
    return score(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")
