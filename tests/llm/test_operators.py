"""Small cases for every operator: brute force where there is no SQL, and nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longtail.llm import components, decontaminate, html, jaccard, langid, lm, neighbours, packing, pii, queries, rollup, toxicity
from longtail.llm.common import Scratch, shared_dir

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and stone river light under cloud winter seven green paper silent morning over deep".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n)) + ". "


def documents(spark, more=()):
    rng = np.random.default_rng(1)
    base = "".join(sentence(rng, 9) for _ in range(12))
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, "One two", "en", None), (4, base, "en", "a"), (5, base.upper(), "en", "b"), (6, base + " extra words here", "en", "b"), (7, " ".join(f"w{i}" for i in range(40_000)), "en", "a")]
    rows += [(8, "same row", "de", "c"), (8, "same row", "de", "c"), (9, "!!! 123 ---", "en", "c"), (10, "naïve café über straße " * 5, "de", "c")]
    rows += [(20 + i, sentence(rng, 30), "en", "a") for i in range(5)] + list(more)
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


def clash(docs):
    """Extra columns whose names the operators use themselves."""
    return docs.withColumns({c: F.lit("x") for c in ("n_words", "n_hit", "items", "spans", "lang_pred", "score", "severity", "grade", "pii", "h", "fp", "rid", "__letters", "__text")})


# 9 n-gram Jaccard join


def jaccard_truth(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(rng, n, size):
    base = [f"b{i}" for i in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, size))] = f"e{i}_{rng.integers(0, 99)}"
        out.append(" ".join(w[int(rng.integers(0, 4)) :]))
    return out


@pytest.mark.parametrize("group", [512, 4])
def test_jaccard_against_all_pairs(spark, group):
    rng = np.random.default_rng(3)
    texts = near_copies(rng, 30, 40) + near_copies(rng, 12, 200) + near_copies(rng, 10, 8) + [" ".join(rng.choice(WORDS, int(rng.integers(1, 9)))) for _ in range(40)]
    docs = documents(spark, [(100 + i, t, "en", "a") for i, t in enumerate(texts)])
    got = jaccard.join(clash(docs), group=group)
    assert sorted(map(tuple, got.collect())) == jaccard_truth([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.join(docs.limit(0)).count() == 0


def test_jaccard_null_ids(spark):
    w = [f"n{i}" for i in range(100)]
    texts = [" ".join(w[i : i + 80]) for i in (0, 5, 10)]  # the first and the last hang together through the middle one
    other = [" ".join(f"m{i}" for i in range(k, 60)) for k in (0, 2)]
    docs = spark.createDataFrame([(3, texts[0]), (None, texts[1]), (None, texts[1]), (4, texts[2]), (None, other[0]), (None, other[1])], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect())
    assert got == Counter([(3, 76, 3), (None, 76, 3), (None, 76, 3), (4, 76, 3), (None, 56, None), (None, 54, None)])
    assert Counter(r.doc_id for r in jaccard.keep_one(docs).collect()) == Counter([3, None])


def test_keep_one(spark):
    docs = documents(spark)
    kept = [r.doc_id for r in jaccard.keep_one(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in jaccard_truth([(r.doc_id, r.text) for r in docs.collect()])})


def test_keep_one_goes_by_rows(spark):
    rng = np.random.default_rng(21)
    a, b, c, d, e, f = (sentence(rng, 40) for _ in range(6))
    # ids repeat over unrelated texts, also where one of them is a copy of a smaller id's; nulls are many documents
    rows = [(1, b), (5, a), (6, a.upper()), (5, b), (None, c), (None, d), (None, d), (8, e), (8, f), (9, ""), (9, ""), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    kept = Counter((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect())
    assert kept == Counter([(1, b), (5, a), (None, c), (None, d), (8, e), (8, f), (9, ""), (9, ""), (9, None), (None, None)])
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_need_and_boundary():
    assert jaccard.need(5) == 1 and jaccard.need(2000) > 100 and all(jaccard.need(n) <= jaccard.need(n + 1) for n in range(1, 400))
    assert jaccard.cost_boundary([(5, 10, 1000), (400, 10, 1000)]) == 5
    assert jaccard.cost_boundary([]) == 0


def test_components_beyond_one_task(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)
    ends = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            ends[a] = ends[b] = min(ends[a], ends[b])
    for block in (50, 10_000):
        got = components.components(df, Scratch(spark), block)
        assert {r.node: r.root for r in got.collect()} == ends


# 4 decontamination


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    item = [f"q{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Short; item"), (3, None), (4, ""), (None, "w1 w2"), (2, "w5 w6 w7")], "item_id bigint, text string")
    passage = " ".join(item[3:17])
    docs = documents(spark, [(200, passage, "en", "a"), (201, sentence(rng, 400) + passage, "en", "a"), (202, "a SHORT item b", "en", "a"), (203, " ".join(item[:12]), "en", "a")])
    for most in (2_000_000, 1):
        marked = {r.doc_id: r for r in decontaminate.mark(clash(docs), bench, max_windows=most).collect()}
        assert (marked[200].n_hit, marked[200]["items"], marked[200].n_words) == (14, ["1"], 14)
        assert (marked[202].n_hit, marked[202]["items"], list(marked[202].spans)) == (2, ["2"], [1, 3])
        assert marked[203].n_hit == 0 and marked[7].n_hit == 3 and marked[1].n_words == 0
    out = {r.doc_id: r for r in decontaminate.digest(docs, bench).collect()}
    assert out[200].contaminated and not out[201].contaminated and not out[1].contaminated
    assert out[202].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert {200, 202}.isdisjoint(r.doc_id for r in decontaminate.remove(docs, bench).collect())
    cut = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, unit="span").collect()}
    assert cut[202] == "a  b" and cut[1] is None and cut[200] == ""
    assert decontaminate.digest(docs.limit(0), bench).count() == 0 and decontaminate.digest(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# 7 PII

TRICKY = [
    "a@b.c_d@e.f x@y z@q.com.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (743) 555-3824 +12 +1.2.3.4.5.6.7.8.9.0", "é" * 50 + "m@n.org", "9" * 30_000, "a" * 30_000 + "@",
    "DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "123-45-6789", "call 743 555-3824", "743 555-3824",
]


def base_spans(text):
    found = []
    for no, (kind, p) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(p, text or "") if len(text or "") < 10_000 else ():
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn or kind == "phone" and 10 <= len(digits) <= 15:
                found.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_pii(spark):
    docs = documents(spark, [(300 + i, t, "en", "a") for i, t in enumerate(TRICKY)])
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    for i, t in texts.items():
        assert got[i].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest(), (i, got[i])
    assert got[307].spans == "iban:0:27" and got[308].spans == "ssn:4:15" and got[309].spans == "ssn:0:11" and got[310].spans == "local_phone:5:17" and got[311].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(clash(docs)).collect()}
    assert clean[300] == "[EMAIL][EMAIL] x@y [EMAIL]." and clean[1] is None and clean[2] == "" and clean[4] == texts[4]
    plan = pii.digest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.digest(docs.limit(0)).count() == 0


# 3 packing


def test_packing_round_trip(spark):
    docs = documents(spark)
    paths = queries.tokenizer()
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(paths[0])
    want = Counter((r.doc_id, tuple([*slow.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    rows = packing.pack(clash(docs), *paths, size=256, block=1000).collect()
    sequences = {}
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0] + [r.length for r in s])[:-1].tolist() and sum(r.length for r in s) <= 256
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        parts = by.setdefault(r.doc_id, [[]])
        if r.start == 0 and parts[-1]:
            parts.append([])
        assert r.start == len(parts[-1])
        parts[-1] += r.ids
    assert Counter((d, tuple(p)) for d, ps in by.items() for p in ps) == want
    assert packing.pack(docs.limit(0), *paths).count() == 0


def test_fast_tokenizer_is_the_tokenizer():
    paths = queries.tokenizer()
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(paths[0])
    encode, _ = packing.encoder(*paths)
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2" for c in range(0, 0x3000) if not 0xD800 <= c < 0xE000] + ["<|endoftext|> x", "it's  we'll\n\n x\t", "１２ ½ ²"]
    for t in texts:
        assert encode(t) == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_windows_are_the_cheapest():
    rng = np.random.default_rng(9)
    for _ in range(100):
        size = int(rng.choice([8, 16, 32]))
        ends = np.cumsum(rng.integers(1, 50, int(rng.integers(1, 10))))
        inner = np.unique(rng.integers(1, ends[-1] + 1, 8))
        pos, pen = packing.cuts(ends, inner, size)
        cost = lambda a, b: 0 if (b - a) & (b - a - 1) == 0 else size - (b - a)
        best = [0.0] + [np.inf] * (len(pos) - 1)
        for j in range(1, len(pos)):
            best[j] = pen[j] + min(best[i] + cost(pos[i], pos[j]) for i in range(j) if pos[j] - pos[i] <= size)
        got = packing.best_windows(pos, pen, size)
        assert abs(sum(cost(a, b) + pen[np.searchsorted(pos, b)] for a, b in zip(got, got[1:])) - best[-1]) < 1e-9


# 5 language


def test_language(spark):
    docs = documents(spark, [(400 + i, t, lang, "a") for i, (t, lang) in enumerate([("Съешь ещё этих мягких булок", "ru")] * 4 + [("der die das und über straße", "de")] * 4)])
    model = langid.train(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.predict(clash(docs), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[9].lang_pred == "und" and got[9].score == 0 and list(got[1].lang_spans) == []
    assert got[400].lang_pred == "ru" and got[20].lang_pred == "en" and got[404].lang_pred == "de"
    mixed = docs.sparkSession.createDataFrame([(1, "the river and the stone under the cloud " * 3 + "Съешь ещё этих мягких булок " * 2)], "doc_id bigint, text string")
    assert [s.lang for s in langid.predict(mixed, model).first().lang_spans] == ["en", "ru"]
    assert {1, 2, 9}.isdisjoint(r.doc_id for r in langid.reject(docs, model).collect())
    none = langid.train(docs.limit(0), F.lit(True))
    assert langid.predict(docs, none).where("lang_pred != 'und'").count() == 0 and langid.digest(docs.limit(0)).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    score = rng.normal(0, 8, (3, 6, 3)).astype(np.float32)
    path = langid.viterbi(score, np.array([6, 6, 4]))
    value = lambda s, p: sum(s[i, x] for i, x in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
    for n, t in ((0, 6), (1, 6), (2, 4)):
        best = max(value(score[n], p) for p in np.ndindex(*[3] * t))
        assert abs(value(score[n], path[n, :t]) - best) < 1e-3


# 6 html


def test_html_lines():
    page = '<!DOCTYPE html><title>t</title><script>var a="</p>"</script><nav><a>Home</a></nav><article><header><h1>T &amp; x</h1><i>by</i></header><p>a <b>b</b><br>c<p>d<div class="comments"><p>no</p></div><span class="ad">buy</span>e</article><footer>f'
    assert [t for t, p in html.lines(page) if p == html.ARTICLE] == ["T & x", "a b c", "d", "e"]
    assert html.lines("") == [] and html.lines("<p>x &lt;y") == [("x <y", html.PLAIN)] and html.lines("<!-- x") == []


def test_html_differencing(spark):
    shell = "<div>{head}</div><p>{body}</p><p>{more}</p><div>Shared end</div>"
    rows = [(i, f"http://h.example/a/{i}", shell.format(head="Site head", body=f"story {i}", more=f"more {i}")) for i in range(6)]
    rows += [(10, "http://single.example/x", shell.format(head="Site head", body="alone", more="m")), (11, None, "<p>z"), (12, "http://h.example/b", None), (13, "::bad[", ""), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[3] == "story 3\n\nmore 3" and got[10] == "Site head\n\nalone\n\nm\n\nShared end" and got[11] == "z" and got[12] == got[13] == ""
    assert html.extract(pages).count() == len(rows) and html.extract(pages.limit(0)).count() == 0


def test_html_differencing_beside_an_article(spark):
    shell = "<div>Site head</div><article><h2>Teaser {i}</h2></article><div><p>body {i}</p><p>more {i}</p><p>end {i}</p></div><nav>Menu {i}</nav><p>Site end</p>"
    pages = spark.createDataFrame([(i, f"http://h.example/a/{i}", shell.format(i=i)) for i in range(5)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {i: f"Teaser {i}\n\nbody {i}\n\nmore {i}\n\nend {i}" for i in range(5)}


def test_html_long_templates_and_copies(spark):
    def page(host, own, end="", at=None):
        return f"http://{host}.example/{at or own}{end}", "".join(f"<p>{host} template {n}</p>" for n in range(8)) + f"<p>title {own}</p><p>story {own}</p>"

    rows = [page("short", i) for i in range(5)]
    rows += [page("copies", "a", f"?v={n}") for n in range(7)] + [page("copies", i) for i in "bc"]
    body = "".join(f"<p>same {n}</p>" for n in range(9))
    rows += [(u, h + body + f"<p>at {n}</p>") for n, (u, h) in enumerate([page("near", "a"), page("near", "a", "?print")])]
    rows += [page("near", "b"), page("near", "c")]
    pages = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id bigint, url string, html string")
    got = {r.url: r.text for r in html.extract(pages).collect()}
    assert len(got) == len(rows)
    for url, text in got.items():
        name = url.split("/")[-1].split("?")[0]
        want = [f"title {name}", f"story {name}"]
        if url.startswith("http://near.example/a"):
            want += [f"same {n}" for n in range(9)] + [f"at {int('print' in url)}"]
        assert text.split("\n\n") == want, url


def test_common_is_longest():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (rng.integers(0, 4, int(rng.integers(0, 12))).tolist() for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        got = html.common(a, b)
        assert len(got) == d[-1, -1] and all(a[i] == b[j] for i, j in got) and got == sorted(got)


# 8 neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 8)).round(3)
    v[100:300] = v[0]  # many equal vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (800, [0.0] * 8), (801, [float("nan")] * 8), (802, [None] * 8), (803, [1.0] * 3), (804, []), (None, [1.0] * 8), (5, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.search(df.withColumn("score", F.lit("x")), lambda i: i % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        assert [i for _, i, _ in sorted(found)] == want and np.allclose([s for _, _, s in sorted(found)], d[want])
    assert neighbours.search(df.limit(0), lambda i: i % 100 == 0).count() == 0
    assert neighbours.search(df.where("vec_id in (0, 1, 2)"), lambda i: i == 0).count() == 2


# 10 rollup


def test_rollup(spark):
    docs = documents(spark)
    words = rollup.count("text", "word-1")
    r = rollup.Rollup(spark, shared_dir(spark))
    assert r.totals().count() == 0
    assert r.commit("a", rollup.insert(docs, "v", words)) and not r.commit("a", rollup.insert(docs, "v", words))
    r.commit("b", rollup.delete(docs.where("source = 'c'"), "v", words))
    r.commit("c", rollup.revise(docs.where("doc_id = 3"), "v", words, F.lit(7)))
    want = {}
    for d in docs.where("source is null or source != 'c'").collect():
        n, t = want.get((d.source, d.lang), (0, 0))
        want[d.source, d.lang] = (n + 1, t + (7 if d.doc_id == 3 else len((d.text or "").split())))
    assert {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in r.totals().collect()} == want
    assert rollup.query(docs.limit(0)).count() == 0


# 1 language model


def test_lm_base_and_sum(spark):
    rng = np.random.default_rng(12)
    docs = documents(spark, [(500 + i, sentence(rng, 60), "en", "a") for i in range(60)])
    rows = docs.collect()
    tokens = {i: [*(r.text or "").encode().lower().split(), b"\n"] for i, r in enumerate(rows)}
    c = Counter(t for i, r in enumerate(rows) if zlib.crc32(str(r.doc_id).encode()) % 10 for t in tokens[i])
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(tokens[i]), sum(c[t] > 0 for t in tokens[i]), n, round(sum(np.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens[i]), 4)) for i, r in enumerate(rows))
    got = lm.digest(clash(docs).withColumn("tokens", F.lit(1))).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert lm.digest(docs.limit(0)).count() == 0
    train = F.lit(True)
    model = lm.fit(docs, train, words=8)
    near = np.repeat(np.arange(model.vocab.symbols()), 3)
    far = np.resize([0, 5, model.vocab.end], len(near))
    total = sum(10 ** model.log10(near, far, np.full(len(near), s)) for s in range(model.vocab.symbols()))
    assert np.allclose(total, 1, atol=1e-4)
    every = Counter(t for ts in tokens.values() for t in ts[:-1] if model.vocab.head.get(t, 99) >= 8)
    for s in {model.vocab.symbol(w) for w in every}:
        own = [k for w, k in every.items() if model.vocab.symbol(w) == s]
        assert sum(own) == model.symbols[s] and sum(k + 0.1 for k in own) + 0.1 <= 1.1 * model.symbols[s] + 0.1 + 1e-9


def test_lm_learns_order(spark):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"{a} {a}x" for a in rng.choice(list("abcdefgh"), 80))
    docs = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id bigint, text string")
    held = lm.digest(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.85 * held[1]


# 2 toxicity


def test_toxicity(spark):
    rng = np.random.default_rng(7)
    bad = ["trashy", "vilest"]
    rows = [(1000 + i, sentence(rng, 40) + (" ".join(rng.choice(bad, 1 + i % 9)) if i % 4 == 0 else ""), "en", "a") for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1000, 1300)] + [(1, 1, None), (None, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(clash(docs), toxicity.train(docs, labels)).collect()}
    assert all(got[i].toxic == (i % 4 == 0) for i in range(1300, 1400))
    few, many = (np.mean([got[1000 + i].severity for i in range(0, 400, 4) if i % 9 == k]) for k in (0, 8))
    assert few < many
    assert not got[1].toxic and not got[7].toxic
    p = toxicity.fit([b"a", b"b c"] * 50, grades=np.array([0, 2] * 50)).above([b"b", b"c", b"zzz"])
    assert (np.diff(p, axis=1) <= 0).all()
    assert toxicity.digest(docs, labels.limit(0)).agg(F.max("severity")).first()[0] < 1e-9 and toxicity.digest(docs.limit(0), labels).count() == 0


def test_recall_of_neighbours(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16)) * 2
    v = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.search(df, lambda i: i % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & {int(i) for i in np.argsort(((v - v[q]) ** 2).sum(1))[1:11]}) for q in got]
    assert len(got) == 60 and np.mean(hits) >= 9


def test_recall_of_neighbours_does_not_fall_with_the_number_of_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_LIST", 16)
    rng = np.random.default_rng(13)
    v = rng.normal(size=(6000, 48))
    v /= np.sqrt((v * v).sum(1))[:, None]  # no structure: only the lists that are searched make the recall
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}), "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.search(df, lambda i: i % 150 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & {int(i) for i in np.argsort(((v - v[q]) ** 2).sum(1))[1:11]}) for q in got]
    assert len(got) == 40 and np.mean(hits) >= 9.9
