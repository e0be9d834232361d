"""Language identification of mixed text: script ranges, word scores and a Viterbi path.

A word is a run of letters. Its script, from the range of its first non-ASCII letter, narrows
the languages to those that use it. Its score in each is the log-probability of its byte
1- to 3-grams, hashed into BUCKETS. A Viterbi path over the words, which pays SWITCH for every
change of language, labels spans; the prediction is the language of most letters, its score
that language's share of them, weighted by how sure the model is of the words.

The model is fitted on a bounded sample: at most SAMPLE documents of each language, chosen
by the hash of their ids. Predictions read the text alone, where it lies; nothing is shuffled.

Defined cases: null texts and texts without a letter are `und` with score 0 and no spans; a model
fitted on no labelled row predicts `und` for all; ties go to the language that sorts first;
repeated rows are predicted each on its own. `predict` replaces columns named like an output;
`reject` returns all columns as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sent, slices

SAMPLE = 400
BUCKETS = 1 << 16
SWITCH = 9.0
SCORED = 1 << 14
SCRIPT_SHARE = 0.01
UND = "und"
#: Of a language: at most 32,767 of them.
INDEX = np.int16
#: First code point, last code point of script blocks; a word's other letters are Latin.
SCRIPTS = {
    "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "armenian": (0x530, 0x58F), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x77F),
    "devanagari": (0x900, 0x97F), "bengali": (0x980, 0x9FF), "tamil": (0xB80, 0xBFF), "telugu": (0xC00, 0xC7F), "thai": (0xE00, 0xE7F),
    "georgian": (0x10A0, 0x10FF), "kana": (0x3040, 0x30FF), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF),
}
#: Lower-cases A-Z and turns ASCII other than letters into blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def grams(flat: np.ndarray) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams that begin at each byte of the words, which stand between blanks."""
    b = np.concatenate([flat, [32, 32]]).astype(np.int64)
    one, two = b[:-2], b[:-2] * 256 + b[1:-1]
    three = two * 256 + b[2:]
    code = np.stack([one * 7919 + 1, two * 104729 + 2, np.where((one == 32) | (b[1:-1] == 32), one * 31 + b[1:-1] + 3, three * 1299709 + 5)])
    return (code ^ (code >> 16)) & (BUCKETS - 1)


def joined(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each after a blank, and where they start."""
    flat = np.frombuffer(b" " + b" ".join(ws), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in ws])[:-1]])
    return flat, starts


def scripts(ws: list[bytes]) -> np.ndarray:
    """Index of each word's script: 0 Latin, else 1 + its place in SCRIPTS."""
    out = np.zeros(len(ws), np.int64)
    for i, w in enumerate(ws):
        if not w.isascii():
            for c in w.decode(errors="replace"):
                if c >= "Ͱ":
                    out[i] = next((1 + k for k, (a, b) in enumerate(SCRIPTS.values()) if a <= ord(c) <= b), 0)
                    break
    return out


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # BUCKETS x langs
    uses: np.ndarray  # scripts x langs: whether the language uses the script

    def score(self, ws: list[bytes]) -> np.ndarray:
        """Log-probability of each word in each language, its best language's being at 0 and none below -12."""
        parts = []
        for i in range(0, len(ws), SCORED):
            flat, starts = joined(ws[i : i + SCORED])
            code = grams(flat)
            parts.append(np.add.reduceat(self.weight[code[0]] + self.weight[code[1]] + self.weight[code[2]], starts))
        s = np.concatenate(parts)
        s = np.where(self.uses[scripts(ws)], s, np.float32(-1e4))
        return np.maximum(s - s.max(1, keepdims=True), -12.0)


def fit(rows: Iterator[tuple[str, bytes]]) -> Model:
    count: dict[str, np.ndarray] = {}
    used: dict[str, np.ndarray] = {}
    for lang, text in rows:
        if ws := words(text):
            code = grams(joined(ws)[0])
            c = count.setdefault(lang, np.zeros(BUCKETS))
            c += np.bincount(code.ravel(), minlength=BUCKETS)
            u = used.setdefault(lang, np.zeros(len(SCRIPTS) + 1))
            u += np.bincount(scripts(ws), minlength=len(u))
    langs = sorted(count)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS) + 1, 0), bool))
    n = np.stack([count[x] for x in langs], 1)
    uses = np.stack([used[x] / used[x].sum() >= SCRIPT_SHARE for x in langs], 1)
    uses[~uses.any(1)] = True  # of a script that no language was seen in, any language may be
    return Model(langs, (np.log(n + 0.5) - np.log(n.sum(0) + 0.5 * BUCKETS)).astype(np.float32) / 3, uses)


def train(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the rows for which `where` holds, of at most `sample` documents of each language."""
    rows = docs.where(where & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(key)).alias("order"))
    many = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not many:
        return fit(iter(()))
    # an even share of the hash range holds about the sample; the rank then makes the bound exact
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in many.items() for x in (k, min(1.0, 1.5 * sample / n))]), F.col("lang"))
    some = rows.where(F.pmod("order", F.lit(1_000_003)) < share * 1_000_003)
    ranked = some.withColumn("rank", F.expr("row_number() over (partition by lang order by order)")).where(F.col("rank") <= sample)
    return fit((r["lang"], bytes(r["text"])) for r in ranked.select("lang", "text").toLocalIterator())


def viterbi(score: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Best language of each word of each text: score is texts x words x languages, padded beyond lens."""
    n, t, k = score.shape
    back = np.zeros((t, n, k), INDEX)
    v = score[:, 0].copy()
    last = v.copy()
    for i in range(1, t):
        top = v.argmax(1)
        jump = v[np.arange(n), top] - np.float32(SWITCH)
        stay = v >= jump[:, None]
        back[i] = np.where(stay, np.arange(k, dtype=INDEX)[None], top[:, None].astype(INDEX))
        v = np.where(stay, v, jump[:, None]) + score[:, i]
        ended = lens == i + 1
        last[ended] = v[ended]
    path = np.zeros((n, t), INDEX)
    at = last.argmax(1)
    rows = np.arange(n)
    for i in range(t - 1, -1, -1):
        live = lens > i
        path[live, i] = at[live]
        at = np.where(live, back[i, rows, at], at)
    return path


def label(texts: list[bytes], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Of each text: language, score, and spans of words (first, beyond, language)."""
    out: list = [(UND, 0.0, [])] * len(texts)
    split = [words(t) for t in texts]
    order = [i for i in sorted(range(len(split)), key=lambda i: len(split[i])) if split[i]]
    k = len(model.langs)
    while order:
        # texts of like length together, within a bounded number of cells
        take = 1
        longest = len(split[order[-1]])
        while take < len(order) and (take + 1) * longest <= 1 << 19 and len(split[order[-take - 1]]) * 2 >= longest:
            take += 1
        some, order = order[-take:], order[:-take]
        kinds: dict[bytes, int] = {}
        ids = [np.fromiter((kinds.setdefault(w, len(kinds)) for w in split[i]), np.int64, len(split[i])) for i in some]
        table = model.score(list(kinds))
        size = np.array([len(w) for w in kinds])
        lens = np.array([len(x) for x in ids])
        grid = np.zeros((take, longest), np.int64)
        for r, x in enumerate(ids):
            grid[r, : len(x)] = x
        path = viterbi(table[grid], lens)
        sure = np.exp(table)
        sure /= sure.sum(1, keepdims=True)
        for r, (i, x) in enumerate(zip(some, ids)):
            p = path[r, : len(x)]
            letters = np.bincount(p, size[x], minlength=k)
            best = int(letters.argmax())
            cut = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]])
            score = float((sure[x, best] * size[x] * (p == best)).sum() / letters.sum())
            out[i] = (model.langs[best], score, [(int(a), int(b), model.langs[p[a]]) for a, b in zip(cut, cut[1:])])
    return out


BATCH_BYTES = 4 << 20


OUTPUTS = ("lang_pred", "score", "lang_spans")


def predict(docs: DataFrame, model: Model, text: str = "text", spans: bool = True, names: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """docs with lang_pred, score and, if asked for, lang_spans (words, first and beyond, of one language), under the names given."""
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("beyond", T.LongType()), T.StructField("lang", T.StringType())]))
    made = [T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), span))][: 2 + spans]
    replaced = {f.name.lower() for f in made}
    kept = [f for f in docs.schema.fields if f.name.lower() not in replaced]
    column = lambda f: F.col(f"`{f.name}`")
    if not model.langs:
        return docs.select(*map(column, kept), *(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(made, (UND, 0.0, None))))
    get = sent(docs.sparkSession, model)
    (letters,) = fresh(docs, "letters")
    given = docs.select(*map(column, kept), F.when(F.col(text).rlike(r"\p{L}"), F.col(text).cast("binary")).alias(letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        for batch in batches:
            got = []
            for _, texts in slices(batch.column(batch.num_columns - 1), BATCH_BYTES):
                got += label([t or b"" for t in texts], model)
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            if spans:
                new.append(pa.array([[{"first": x, "beyond": y, "lang": z} for x, y, z in g[2]] for g in got], pa.list_(pa.struct([("first", pa.int64()), ("beyond", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *(f.name for f in made)])

    return given.mapInArrow(run, T.StructType([*kept, *made]))


def held_out(key: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % folds == fold


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op5."""
    out = held_out("doc_id", 4, 2)
    model = train(docs, ~out)
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model, spans=False).drop("text")


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without those of no language, all columns as they were."""
    names = fresh(docs, *OUTPUTS)
    return predict(docs, model, text, False, tuple(names)).where(F.col(names[0]) != UND).drop(*names[:2])
