"""Delta-maintained token counts by source, language and tokenizer version.

A batch of signed changes is summed by key before it is stored, so a table of totals
is the sum of a few small delta tables and never needs the documents again. A batch is
written aside and renamed into place under its id: a batch that is already there is left
alone, so a repeated or half-done commit changes nothing. Sums are combined before the
shuffle; a hot source costs a row for each task. Texts are counted once: `counted` keeps each
row's counts without its text, and all batches read those. Versions are column expressions (VERSIONS) or a tokenizer's
vocabulary file (`tokens`).

Defined cases: null sources and languages are keys of their own; null and empty texts have
no tokens and still count as documents; a key whose documents and tokens are both back at
zero has no row; repeated rows count each; empty batches commit and change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, Scratch, once, shared_dir, slices

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, d_docs bigint, d_tokens bigint"
#: Token counts that a column expression gives, by tokenizer version.
VERSIONS = {
    "blank-1": lambda t: F.size(F.split(t, " ")).cast("bigint"),
    "word-1": lambda t: F.regexp_count(t, F.lit(SPACE_WORD)).cast("bigint"),
    "alnum-1": lambda t: F.regexp_count(t, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint"),
}


def count(text: str, version: str) -> Column:
    return VERSIONS[version](F.coalesce(F.col(text), F.lit("")))


def counted(docs: DataFrame, counts: dict[str, Column], scratch: Scratch) -> DataFrame:
    """(source, lang, one column for each count) of every row, written once so that no later batch reads a text again."""
    return scratch.put(docs.select("source", "lang", *(c.alias(name) for name, c in counts.items())), "counted")


def tokens(docs: DataFrame, vocabulary: str, out: str = "tokens", text: str = "text") -> DataFrame:
    """(source, lang, out): how many ids the tokenizer of the file `vocabulary`, which executors can read, makes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = once(f"tokenizer {vocabulary}", lambda: Tokenizer.from_file(vocabulary))
        tokenizer.encode_special_tokens = True
        for batch in batches:
            many: list[int] = []
            for _, texts in slices(batch.column(2), 1 << 20):
                many += [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(many, pa.int64())], names=["source", "lang", out])

    return docs.select("source", "lang", F.col(text)).mapInArrow(run, f"source string, lang string, `{out}` bigint")


def insert(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    """Changes that add each row's document with its tokens."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(1).cast("bigint").alias("d_docs"), tokens.alias("d_tokens"))


def delete(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    """Changes that take back each row's document; tokens as they were last counted."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(-1).cast("bigint").alias("d_docs"), (-tokens).alias("d_tokens"))


def revise(docs: DataFrame, version: str, old: Column, new: Column) -> DataFrame:
    """Changes that replace each row's count."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(0).cast("bigint").alias("d_docs"), (new - old).alias("d_tokens"))


class Rollup:
    """Delta tables under `root`, one folder a batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def has(self, batch: str) -> bool:
        fs, p = self._fs(f"{self.root}/batches/{batch}")
        return fs.exists(p)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Stores the batch's summed changes; False, and nothing done, if the batch is there already."""
        if self.has(batch):
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        fs, aside = self._fs(f"{self.root}/aside/{uuid.uuid4().hex}")
        summed.write.parquet(aside.toString())
        _, into = self._fs(f"{self.root}/batches/{batch}")
        fs.mkdirs(into.getParent())
        # rename() may move into a folder that another writer has put there meanwhile: then that one counts
        if fs.exists(into) or not fs.rename(aside, into):
            fs.delete(aside, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        fs, into = self._fs(f"{self.root}/batches")
        paths = [s.getPath().toString() for s in fs.listStatus(into)] if fs.exists(into) else []
        deltas = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        total = deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return total.where("n_docs != 0 or n_tokens != 0")


#: Documents with fewer words are withdrawn by the query's last batch.
LEAST_WORDS = 5


def query(docs: DataFrame) -> DataFrame:
    """Four batches over the whole table: a load with draft counts, a second tokenizer, the drafts revised, short documents withdrawn.

    The batch of revisions is committed twice; the second time is without effect.
    """
    spark = docs.sparkSession
    counts = counted(docs, {"words": count("text", "word-1"), "draft": count("text", "blank-1"), "alnum": count("text", "alnum-1")}, Scratch(spark))
    words, draft, alnum = F.col("words"), F.col("draft"), F.col("alnum")
    rollup = Rollup(spark, shared_dir(spark))
    rollup.commit("1-load", insert(counts, "word-1", draft))
    rollup.commit("2-alnum", insert(counts, "alnum-1", alnum))
    for _ in range(2):
        rollup.commit("3-revise", revise(counts, "word-1", draft, words))
    short = counts.where(words < LEAST_WORDS)
    rollup.commit("4-withdraw", delete(short, "word-1", words).unionByName(delete(short, "alnum-1", alnum)))
    return rollup.totals()


def tokenizer_query(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Totals over all documents by a tokenizer's ids: a load by halves of the table, one half committed twice."""
    spark = docs.sparkSession
    counts = Scratch(spark).put(tokens(docs, vocabulary), "counted")
    rollup = Rollup(spark, shared_dir(spark))
    odd = F.pmod(F.col("tokens"), F.lit(2)) == 1
    for batch, part in (("1-odd", counts.where(odd)), ("2-even", counts.where(~odd)), ("1-odd", counts)):
        rollup.commit(batch, insert(part, "byte-bpe-50k", F.col("tokens")))
    return rollup.totals()


ORACLE = r"""
with d as (select source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w, len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as a from documents)
select source, lang, version, count(*)::bigint as n_docs, sum(n)::bigint as n_tokens from
(select source, lang, 'word-1' as version, w as n from d where w >= 5 union all select source, lang, 'alnum-1', a from d where w >= 5) group by source, lang, version
"""
