"""What holds for several operators alike: clashing names, runs without the package, sizes of partitions, long texts."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from longtail.llm import decontaminate, html, jaccard, langid, lm, pii, queries, rollup, toxicity

NAMES = "lang_pred score lang_spans letters n_words n_hit items spans found pii raw severity grade p_toxic toxic n_shingles component_id root fp n tx".split()
FILTERS = {
    "reject": lambda docs, bench: langid.reject(docs, langid.train(docs, F.lit(True))),
    "remove": decontaminate.remove,
    "remove spans": lambda docs, bench: decontaminate.remove(docs, bench, unit="span"),
    "redact": lambda docs, bench: pii.redact(docs),
    "keep_one": lambda docs, bench: jaccard.keep_one(docs),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_leave_other_columns_alone(spark, name):
    text = "the small house stands beside a quiet river where nine people walk every single morning"
    docs = spark.createDataFrame([(1, text, "en", 1), (2, "mail me at a@b.org about " + text[20:60], "en", 2), (3, "eine kurze deutsche zeile mit worten", "de", 3)], "doc_id bigint, text string, lang string, mark int")
    docs = docs.select("*", *(F.concat(F.lit(n), F.col("mark")).alias(n) for n in NAMES))
    bench = spark.createDataFrame([("b", "nothing of this occurs")], "item_id string, text string")
    out = FILTERS[name](docs, bench)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == 3 and all(r[n] == f"{n}{r.mark}" for r in got for n in NAMES)


def test_scores_replace_their_own_columns_only(spark):
    docs = spark.createDataFrame([(1, "hello there", "kept", "lost", "kept")], "doc_id bigint, text string, raw string, Severity string, letters string")
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).first()
    assert (got.raw, got.severity < 1e-9, got.letters) == ("kept", True, "kept") and "Severity" not in got.asDict()


ELSEWHERE = """
import sys, os
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "700m").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
from longtail.llm import decontaminate, langid, lm, toxicity
docs = spark.createDataFrame([(i, f"some words of text number {{i}}", "en") for i in range(20)], "doc_id bigint, text string, lang string")
bench = spark.createDataFrame([("b", "words of text")], "item_id string, text string")
assert decontaminate.mark(docs, bench).where("n_hit > 0").count() == 20
assert langid.predict(docs, langid.train(docs, F.lit(True))).where("lang_pred = 'en'").count() == 20
assert lm.digest(docs).count() == 20
model = toxicity.fit([b"bad bad", b"good"] * 9, grades=__import__("numpy").array([1, 0] * 9))
assert toxicity.score(docs, model).count() == 20
print("whole")
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    repo = str(Path(__file__).parents[2])
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    (tmp_path / "away").mkdir()
    # Spark hands sys.path of the driver's start to executors, so the package's folder is added inside
    run = subprocess.run([sys.executable, "-c", ELSEWHERE.format(repo=repo, shared=f"file://{tmp_path}/shared")], cwd=tmp_path / "away", env=env, capture_output=True, text=True, timeout=300)
    assert "whole" in run.stdout, run.stderr[-3000:]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from longtail.operators import shared

    class Conf:
        get = staticmethod(lambda name, other=None: other)

    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))}))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.folder(type("Session", (), {"conf": Conf, "sparkContext": Context}))


def words_of(rng, n, kinds=400):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % kinds)


def test_lm_scores_do_not_follow_the_partitions(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, words_of(rng, 200)) for i in range(300)], "doc_id bigint, text string")
    one, many = ({r.doc_id: r for r in lm.digest(docs.repartition(n, "doc_id")).collect()} for n in (1, 7))
    for i, r in one.items():
        assert r[:6] == many[i][:6] or abs(r.base_score - many[i].base_score) < 1e-6
        assert abs(r.score - many[i].score) <= 0.01 * abs(r.score)


def test_lm_learners_are_averaged(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, words_of(rng, 200)) for i in range(300)], "doc_id bigint, text string")
    train = F.col("doc_id") % 10 != 0
    scores = [lm.score(docs, lm.fit(docs, train, size=size), train).where("held_out").agg(F.sum("score")).first()[0] for size in (1 << 20, 15_000)]
    assert abs(scores[0] - scores[1]) <= 0.03 * abs(scores[0])


def test_pii_positions_in_long_texts(spark):
    many = " ".join(f"é{i} u{i}@h.org, 10.0.{i % 256}.7" for i in range(700))
    docs = spark.createDataFrame([(1, many), (2, "x" * 4096 + " a@b.cd " + "y" * 5000 + " a@b.ce"), (3, "a@b.cd" * 3)], "doc_id bigint, text string")
    import re

    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")]
    want = {r.doc_id: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((m.start(), no, m.end(), k) for no, (k, p) in enumerate(patterns) for m in re.finditer(p, r.text))) for r in docs.collect()}
    assert {r.doc_id: r.spans for r in pii.digest(docs).collect()} == want
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[1] == " ".join(f"é{i} [EMAIL], [IP]" for i in range(700))
    assert clean[2] == "x" * 4096 + " [EMAIL] " + "y" * 5000 + " [EMAIL]"


def test_pii_context_is_what_stands_before(spark):
    rows = [(1, "phone: 743 555-3824"), (2, "phone" + " " * 36 + "743 555-3824"), (3, "phone" + " " * 35 + "743 555-3824"), (4, "call 743 555-3824, 743 555-3825")]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "local_phone:7:19", 2: "", 3: "local_phone:40:52", 4: "local_phone:5:17,local_phone:19:31"}


def test_decontamination_index_verifies_and_merges(spark):
    items = [("x", b"a b c d a b c d".split()), ("y", b"a b c".split()), ("z", b"d".split())]
    index = decontaminate.Index(items, 3)
    up, down = decontaminate.powers(99, decontaminate.PRIME), decontaminate.powers(99, pow(decontaminate.PRIME, -1, 1 << 64))
    rng = np.random.default_rng(4)
    for _ in range(200):
        text = list(rng.choice([b"a", b"b", b"c", b"d", b"e"], 12))
        ids = np.array([index.vocab.get(w, 0) for w in text])
        hit, found = index.find(ids, up, down)
        want, names = np.zeros(12, bool), set()
        for name, ws in items:
            k = min(3, len(ws))
            for i in range(len(ws) - k + 1):
                for s in range(12 - k + 1):
                    if text[s : s + k] == ws[i : i + k]:
                        want[s : s + k] = True
                        names.add(name)
        assert (hit == want).all() and {index.names[i] for i in found} == names


def test_more_than_128_languages():
    k = 300
    path = langid.viterbi(np.where(np.arange(k) == 250, 0.0, -5.0)[None, None].repeat(4, 1).astype(np.float32), np.array([4]))
    assert (path == 250).all()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 20 and right >= 0.95


def test_toxicity_grades_given(spark):
    """Three grades planted by words of their own: held-out texts get theirs, and the severity follows them."""
    rng = np.random.default_rng(8)
    marks = [[], ["rude"], ["rude", "hateful"], ["hateful", "violent", "violent"]]
    rows = [(i, " ".join([*(f"w{x}" for x in rng.integers(0, 300, 30)), *(m for _ in range(3) for m in marks[i % 4])])) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 4) for i in range(800)], "doc_id bigint, grade int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels, "grade", where=F.col("doc_id") < 600)).collect()}
    held = [got[i] for i in range(600, 800)]
    assert np.mean([r.grade == r.doc_id % 4 for r in held]) >= 0.9
    means = [np.mean([r.severity for r in held if r.doc_id % 4 == g]) for g in range(4)]
    assert all(a + 0.5 < b for a, b in zip(means, means[1:]))


def test_token_totals_by_tokenizer(spark):
    from tokenizers import Tokenizer

    rows = [(None, "en", "Hello, world"), ("a", None, None), ("a", "en", ""), ("a", "en", "naïve 東京 text " * 50), ("a", "en", "naïve 東京 text " * 50)]
    docs = spark.createDataFrame(rows, "source string, lang string, text string")
    t = Tokenizer.from_file(queries.tokenizer()[0])
    want: dict = {}
    for s, lang, text in rows:
        n, k = want.get((s, lang), (0, 0))
        want[s, lang] = (n + 1, k + len(t.encode(text or "", add_special_tokens=False).ids))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.tokenizer_query(docs, queries.tokenizer()[0]).collect()}
    assert got == want


def test_a_half_done_commit_is_made_whole(spark, tmp_path):
    """A writer that died leaves only a folder aside; of two that race, one counts."""
    changes = spark.createDataFrame([("a", "en", "v", 1, 5)], rollup.SCHEMA)
    r = rollup.Rollup(spark, str(tmp_path / "totals"))
    changes.write.parquet(f"{r.root}/aside/dead")
    assert r.totals().count() == 0
    other = rollup.Rollup(spark, r.root)
    has, r.has = r.has, lambda batch: other.commit(batch, changes) and False  # the other writer comes between the look and the rename
    assert not r.commit("b", changes)
    r.has = has
    assert not r.commit("b", changes)
    assert Counter(map(tuple, r.totals().collect())) == Counter([("a", "en", "v", 1, 5)])


def test_html_keeps_sections_and_formulas_of_an_article():
    page = '<article><p>The formula <math>x</math> holds</p><section id="discussion"><p>Kept</p></section><div class="related-work">Kept too</div><div class="legal-analysis">Also</div><div class="related-posts">Gone</div></article><div id="legal">Out</div>'
    got = html.lines(page)
    assert [t for t, p in got if p == html.ARTICLE] == ["The formula x holds", "Kept", "Kept too", "Also"]
    assert [t for t, p in got if p == html.BOILER] == ["Gone", "Out"]
