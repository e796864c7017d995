"""Each operator against brute force, and on nulls, empty texts, repeated rows, empty tables and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, dac, iblt, langid, lattice, mixing, multiorder, nnpu, spviterbi, suffixes, support, urlrep
from millrace.llm.queries import RULES, tokenizer_path

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "ho") for b in ("la", "mi", "no", "pu", "re", "sy", "tä")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(20, 160)) for _ in range(40)]
    passage = prose(rng, 60)
    texts += [texts[0], texts[0], texts[1].upper(), texts[2] + " tail", texts[3][:-3] + "xyz"]
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(5)]
    texts += [None, "", " \n\t", "one", "one", "two words", "é" * 400, "x" * 5000, "ab " * 3000]
    return {i * 3: t for i, t in enumerate(texts)}


def frame(spark, corpus, **more):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1, "clash") for i, t in corpus.items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, token string")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, token string")


# ---- 1 token codes ----------------------------------------------------------------------------------


def test_dac_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.choice([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1], n).astype(np.uint32)
        for bits in (8, 16):
            s = dac.Segment(dac.pack(ids, bits))
            assert (s.decode() == ids).all() and [s[i] for i in range(n)] == ids.tolist()
    with pytest.raises(ValueError):
        dac.Segment(dac.pack(ids)[:-1])


def test_dac_files(spark, corpus):
    path, tok = support.new_path(spark, "t"), tokenizer_path("word_bpe_49k.json")
    df = frame(spark, corpus).union(frame(spark, {0: corpus[0], 3: "other text"}))
    dac.write(df.union(frame(spark, {7: "no id"}).withColumn("doc_id", F.lit(None).cast("bigint"))), path, tok)
    assert dac.read(spark, path).orderBy("start").first()["doc_id"] is None
    dac.write(df, path, tok, segment_tokens=300)
    got = dac.read(spark, path).orderBy("start").collect()
    from tokenizers import Tokenizer

    t, want, at = Tokenizer.from_file(tok), [], 0
    for i, x in sorted([*((i, x or "") for i, x in corpus.items()), (0, corpus[0]), (3, "other text")]):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    flat = [v for i, x in sorted([*((i, x or "") for i, x in corpus.items()), (0, corpus[0]), (3, "other text")]) for v in [*t.encode(x, add_special_tokens=False).ids, 2]]
    ask = [0, 5, 299, 300, 301, at - 1, at + 5]
    hit = {r["pos"]: r["token"] for r in dac.token_at(spark, path, spark.createDataFrame([(p,) for p in ask], "pos bigint")).collect()}
    assert hit == {p: flat[p] for p in ask if p < at}
    dac.write(empty(spark), path, tok)
    assert dac.read(spark, path).count() == 0


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    e, rng = dac.WordEncoder(tokenizer_path("word_bpe_49k.json"), limit=50), random.Random(5)
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))  # untouched by the module
    for _ in range(3000):
        t = "".join(rng.choice("aBc'sStTdDéÉßñÑµª²1٣ .,-_\n\t\xa0\x1ćœŒ’日İ'ſ") for _ in range(rng.randrange(14)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    for t in ("x <|endoftext|> y", "<|startoftext|><|ENDOFTEXT|>", "a<|endoftext|>é\u0301 b", "<|endoftext", "ab " * 200_000, "é日" * 50_000):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t[:40])
    assert 49407 in dac.ids_of(tokenizer_path("word_bpe_49k.json"), ["x <|endoftext|> y"])[0]


# ---- 2 url filter -----------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = ["http://A.example.com/en/7x?q", "https://example.com/en/8", "http://b.org/es/1#f", "http://example.net/de/8", "http://q.example.net/de/9", "no scheme", None, "http://", "ftp://h:80", "http://bad.com/x", "http://xcom/en/", "://com/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(9, "http://bad.com/x", "h")], "page_id bigint, url string, host string")
    more = spark.createDataFrame([(100 + i, "http://bad.com/y" if i % 2 else f"http://ok{i}.com/", "h") for i in range(60)], "page_id bigint, url string, host string")
    outcomes = spark.createDataFrame([(100 + i, bool(i % 2)) for i in range(60)] + [(100, None)], "page_id bigint, bad boolean")
    got = {r["page_id"]: r for r in urlrep.judge(pages.union(more), outcomes, RULES).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1]["rule"] == "com/en/" and got[1]["verdict"] == "block"
    assert got[2]["rule"] == "org/es/" and got[3]["rule"] == "example.net/de/8" and got[4]["rule"] == "net/de/" and got[4]["verdict"] == "allow"
    assert (got[5]["host"], got[5]["path"]) == ("", "") == (got[6]["host"], got[6]["path"]) and got[8]["host"] == "h:80"
    assert got[10]["rule"] is None and got[11]["rule"] == "com/en/"
    assert got[9]["verdict"] == "block" and got[9]["bad_rate"] > 0.7
    assert urlrep.judge(pages.union(more), outcomes, RULES).count() == 73
    assert urlrep.judge(pages.limit(0), outcomes, RULES).count() == 0
    odd = pages.union(spark.createDataFrame([(None, "http://a.org/es/" + "x" * 100_000, "h")], "page_id bigint, url string, host string"))
    assert [(r["rule"], r["verdict"]) for r in urlrep.judge(odd, outcomes, RULES).collect() if r["page_id"] is None] == [("org/es/", "block")]
    assert urlrep.judge(pages, outcomes.limit(0), RULES).count() == 13


def test_domains_and_suffixes(spark):
    want = {"b.co.za": ("b.co.za", "co.za"), "a.b.gov.au": ("b.gov.au", "gov.au"), "x.y.com": ("y.com", "com"), "h:80": ("h", "h"), "u@w.de:8080": ("w.de", "de"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]": ("[::1]", "[::1]"), "co.uk": ("co.uk", "co.uk"), "a.fr.": ("a.fr", "fr"), "": ("", ""), "www.com.br": ("www.com.br", "com.br")}
    df = spark.createDataFrame([(h,) for h in want], "h string")
    assert {r[0]: (r[1], r[2]) for r in df.select("h", urlrep.domain_of(F.col("h")), urlrep.suffix_of(F.col("h"))).collect()} == want


def test_beta_quantile(spark):
    rng, pairs = np.random.default_rng(3), [(0.02, 0.9), (0.5, 0.5), (1, 1), (2.5, 40), (300, 20), (0.3, 1000.0)]
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double").select("a", "b", urlrep.beta_quantile(F.col("a"), F.col("b"), 0.05).alias("q")).collect()
    for r in rows:
        x = rng.beta(r["a"], r["b"], 400_000)
        assert 0 <= r["q"] <= 1 and abs((x <= r["q"]).mean() - 0.05) < 0.004 or r["q"] < 1e-12, r
    assert next(r["q"] for r in rows if r["a"] == 1) == pytest.approx(0.05, abs=1e-3)


# ---- 3 toxicity -------------------------------------------------------------------------------------


def test_nnpu(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        docs.append((i, prose(rng, 40) + (" " + rng.choice(["vilest", "vilely", "nasty"]) if bad else ""), "x"))
        if i % 3 == 0:
            labels.append((i, int(bad), 1))
    docs += [(5000, None, "x"), (5001, "", "x"), (5001, "", "x"), (None, "nasty words", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, toxic string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7, None, 1)], "doc_id bigint, toxic int, quality int")
    rows = nnpu.held_out_scores(d, lab).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    right = sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    assert right / len(held) > 0.97
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] in (5000, 5001))
    again = {r["doc_id"]: r["score"] for r in nnpu.held_out_scores(d, lab).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}
    long = nnpu.held_out_scores(d.union(spark.createDataFrame([(6000, "ba " * 300_000 + "vilest", "x")], d.schema)), lab).filter("doc_id = 6000").first()
    assert long["predicted"] == 1  # the last word of a long text counts
    none = nnpu.held_out_scores(d, lab.filter("toxic = 0")).collect()
    assert all(r["score"] == 0 for r in none)
    assert nnpu.held_out_scores(d.limit(0), lab).count() == 0


def test_nnpu_risk_and_gradient_by_brute_force():
    import math

    rng = random.Random(4)
    docs = lambda k: [np.array(sorted(rng.sample(range(6), rng.randrange(0, 5))), np.int64) for _ in range(k)]
    pos, unl, prior, l2 = docs(12), docs(40), 0.2, 2e-3

    def risk(w):
        z = lambda d: w[6] + sum(w[f] for f in d)
        soft = lambda x: math.log1p(math.exp(x))
        plus, minus, u = (sum(map(f, map(z, x))) / len(x) for f, x in ((lambda x: soft(-x), pos), (soft, pos), (soft, unl)))
        return prior * plus + max(0.0, u - prior * minus) + l2 / 2 * sum(x * x for x in w[:6])

    start = [0.0] * 6 + [math.log(prior / (1 - prior))]
    w, b, risks = nnpu.train(pos, unl, 6, prior, steps=1, rate=1e-3, l2=l2)
    assert risks[0] == pytest.approx(risk(start))
    for i, moved in enumerate([*w, b - start[6]]):  # the first step of Adam follows the sign of the gradient
        up, down = list(start), list(start)
        up[i], down[i] = up[i] + 1e-6, down[i] - 1e-6
        slope = (risk(up) - risk(down)) / 2e-6
        assert abs(slope) < 1e-6 or moved == pytest.approx(-1e-3 * np.sign(slope), rel=1e-2)


def test_nnpu_risk_stays_non_negative():
    pos, unl = [np.array([0, 2])] * 30, [np.array([0, 2])] * 10 + [np.array([1])] * 90
    w, b, risks = nnpu.train(pos, unl, 3, 0.1)
    assert min(risks) >= 0 and w[0] > 0 > w[1] - 1e-9


# ---- 4 language -------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(9)
    pools = {"aa": ["katto", "mella", "rinna"], "bb": ["schtrupf", "gwelch", "zwarn"]}
    rows = [(i, " ".join(rng.choice(pools[lang]) for _ in range(30)), lang if i % 10 else "bb", "s1" if i % 2 else None) for i, lang in enumerate(["aa", "bb"] * 100)]
    rows += [(1000, None, "aa", "s1"), (1001, "", "aa", "s1"), (1002, "12 34 !!", "aa", "s1"), (1003, "katto mella", None, "s9"), (1003, "katto mella", None, "s9")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("declared", F.lit("zz"))
    got = langid.identify(df)
    assert got.columns[:5] == df.columns
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["lang_id"] == ("aa", "bb")[i % 2] and by[i]["lang_kept"] for i in range(200))
    assert not any(by[i]["lang_kept"] for i in (1000, 1001, 1002)) and by[1003]["lang_id"] == "aa"
    assert got.count() == len(rows)
    assert langid.identify(df.limit(0)).count() == 0


def test_host_priors_are_smoothed_by_level(spark):
    df = spark.createDataFrame([("aa", "com", "x.com"), ("aa", "com", "x.com"), ("bb", "com", "y.com"), (None, "org", "z.org"), ("bb", None, None)], "declared string, suffix string, host string")
    table, overall = langid.host_priors(df, ["aa", "bb"], ["suffix", "host"], 2.0)
    p = {r["host"]: r["p"] for r in table.collect()}
    assert overall == [0.5, 0.5]
    com = [(2 + 1) / 5, (1 + 1) / 5]
    assert p["x.com"] == pytest.approx([(2 + 2 * com[0]) / 4, 2 * com[1] / 4]) and p["z.org"] == [0.5, 0.5] and p[None][1] > 0.5
    pages = spark.createDataFrame([(1, "katto", "aa", "de", "h")], "id int, text string, declared string, suffix string, host string")
    m = langid.TextModel(["de", "fr"], np.full((1 << 16, 2), -3.0, np.float32))
    r = langid.posterior(pages.withColumn("declared", F.lit(None).cast("string")), m, ["host"], suffix="suffix").first()
    assert r["lang_id"] == "de" and r["lang_posterior"] == pytest.approx(0.7)


def test_every_declared_language_is_modelled(spark):
    rng = random.Random(4)
    pools = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for i in range(80)}
    rows = [(i * 10 + j, " ".join(rng.choice(pool) for _ in range(40)), lang, "s") for i, (lang, pool) in enumerate(pools.items()) for j in range(1 + i % 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert all(r["lang_id"] == r["lang"] and r["lang_kept"] for r in langid.identify(df).collect())
    x = df.select("text", F.col("lang").alias("declared"))
    dense, sparse = langid.fit(x, dense=100), langid.fit(x)
    assert isinstance(sparse, langid.SparseTextModel) and sparse.languages == dense.languages == list(pools)
    for t in [r[1] for r in rows[:5]] + ["something else", ""]:
        a, b = dense.evidence(t, 1.0), sparse.evidence(t, 1.0)
        assert a[1] == b[1] and a[0] == pytest.approx(b[0], rel=1e-4)


def test_pages_use_suffix_and_levels(spark):
    page = lambda lang, body: f"<html{lang and f' lang={chr(34)}{lang}{chr(34)}'}><head><style>p {{}}</style></head><body><p>{body}</p></body></html>"
    rng = random.Random(5)
    words = [a + b for a in ("ka", "mo", "ri", "te") for b in ("lun", "sar", "dip")]
    body = lambda: " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, f"https://www.a{i % 5}.com/x", page(("de", "en-GB")[i % 2], body())) for i in range(40)]  # both languages look alike
    rows += [(100, "https://x.co.uk/", page("", body())), (101, "https://x.de/", page("", body())), (102, None, page("en", "")), (103, "https://x.de/", None)]
    by = {r["page_id"]: r for r in langid.identify_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(by) == len(rows) and by[0]["declared"] == "de" and by[1]["declared"] == "en" and by[0]["domain"] == "a0.com"
    assert by[100]["lang_id"] == "en" and by[101]["lang_id"] == "de" and by[100]["declared"] is None
    assert not by[102]["lang_kept"] and not by[103]["lang_kept"]


# ---- 5 suffix dedup ---------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffixes(spark, corpus, hot):
    df = frame(spark, corpus).union(frame(spark, {0: corpus[0]}))
    got = suffixes.digest(df, hot=hot).collect()
    assert len(got) == len(corpus) + 1
    texts = {**corpus, "again": corpus[0]}
    want = suffixes.brute(texts)
    for r in got:
        raw, gone = (corpus[r["doc_id"]] or "").encode(), want[r["doc_id"]]
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), gone.sum(), spans), r
        assert r["kept_sha256"] == hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
    assert suffixes.digest(empty(spark)).count() == 0


def test_suffixes_of_long_texts_and_many_copies(spark):
    rng = random.Random(21)
    blob = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    passage = blob[131_072 - 150 : 131_072 + 250]
    texts = {1: blob, 2: "x " + passage + " y", 3: blob[5_000:5_300] + "é" + blob[390_000:], 4: "".join(rng.choice("ijkl") for _ in range(250_000))}
    copy = "".join(rng.choice("mnop ") for _ in range(500))
    near = {10 + i: copy[: 40 * i] + "#" + copy[40 * i :] for i in range(5)}
    rows = [*texts.items(), *near.items(), *((100 + i, copy) for i in range(20_000))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {r["doc_id"]: r for r in suffixes.digest(df, hot=3).collect()}
    want = suffixes.brute({**texts, **near, 100: copy, 101: copy})
    assert len(got) == len(rows) and all(got[100 + i]["n_removed"] == 500 for i in range(20_000))
    for i in [*texts, *near]:
        raw = (texts.get(i) or near.get(i)).encode()
        assert got[i]["n_removed"] == want[i].sum() and got[i]["kept_sha256"] == hashlib.sha256(np.frombuffer(raw, np.uint8)[~want[i]].tobytes()).hexdigest(), i


def test_suffix_texts_and_columns(spark, corpus):
    df = frame(spark, corpus).withColumn("lo", F.lit(5)).withColumn("t", F.lit("x"))
    got = suffixes.clean(df)
    assert got.columns == df.columns
    want = suffixes.brute(corpus)
    for r in got.collect():
        t = corpus[r["doc_id"]]
        assert r["text"] == (None if t is None else np.frombuffer(t.encode(), np.uint8)[~want[r["doc_id"]]].tobytes().decode("utf-8", "ignore"))


def test_deep_shallow_order():
    rng = np.random.default_rng(4)
    rows = rng.choice([0, 1, 255], (400, 64)).astype(np.uint8)
    rows[100:200, :50] = 7
    rows[150:160] = rows[150]
    group = rng.integers(0, 3, 400)
    order = suffixes.deep_shallow(rows, group)
    keys = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert sorted(order.tolist()) == list(range(400)) and keys == sorted(keys)


# ---- 6 lattice --------------------------------------------------------------------------------------


def test_e8_is_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * 2
    p, _ = lattice.e8(x)
    assert ((p % 2 == p[:, :1] % 2).all()) and (p.sum(1) % 4 == 0).all()
    d = ((x - p / 2) ** 2).sum(1)
    for _ in range(200):
        q, _ = lattice.e8(x + rng.normal(size=x.shape))
        assert (((x - q / 2) ** 2).sum(1) >= d - 1e-9).all()


def test_lattice_near(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 24))
    vecs = np.concatenate([base, base[:20] + rng.normal(size=(20, 24)) * 0.1, base[:1] + rng.normal(size=(40, 24)) * 0.08, base[:5] * 3])
    rows = [(i, int(i % 2), [float(v) for v in x]) for i, x in enumerate(vecs.astype(np.float32))]
    rows += [(500, None, rows[0][2]), (501, 0, None), (502, 0, [0.0] * 24), (503, 0, [None] * 24), (504, 0, [float("nan")] * 24), (505, 0, [1.0]), (506, 0, []), (0, 0, rows[0][2]), (None, 0, rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumn("n", F.lit(1)).withColumn("v", F.lit(2))
    for block in (2048, 8):
        got = lattice.near(df, block=block).collect()
        assert len(got) == len(rows)
        ok = [(i, lab, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, lab, v in rows if i is not None and lab is not None and i not in (501, 502, 503, 504, 505, 506)]
        n = [sum(a is not b and a[1] == b[1] and a[2] @ b[2] >= 0.98 for b in ok) for a in ok]
        i, j = zip(*[(p, q) for p, a in enumerate(ok) for q, b in enumerate(ok) if p != q and a[1] == b[1] and a[2] @ b[2] >= 0.98])
        root = lattice._forest(len(ok), np.array(i), np.array(j))
        low = {}
        for p, r in enumerate(root):
            low[r] = min(low.get(r, 10**9), ok[p][0])
        want = sorted([(a[0], n[p], low[root[p]]) for p, a in enumerate(ok)] + [(k, 0, k) for k in (500, 501, 502, 503, 504, 505, 506)])
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None) == want
    assert lattice.near(df.limit(0)).count() == 0


def test_lattice_lengths_and_labels(spark):
    v = lambda *x: [float(a) for a in x]
    rows = [(1, "a", v(1, 0)), (2, "a", v(2, 0)), (3, "a", v(0, 1, 0)), (4, "a", v(0, 3, 0)), (5, "b", v(1, 0)), (6, "a", v(1, 0, 0)), (7, "b", v(1, 0.01))]
    want = {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (0, 6), 7: (1, 5)}
    for given in (rows, rows[::-1]):
        got = lattice.near(spark.createDataFrame(given, "vec_id bigint, label string, embedding array<double>").coalesce(1)).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("dim", [8, 16, 64, 384, 1024])
def test_lattice_recall(dim):
    rng, n = np.random.default_rng(dim), 2000
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.98 * a + (1 - 0.98**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    t, one = lattice.Tables(dim, 12, 8.0, 5), np.zeros(n, np.int64)
    x, y = t.cells(a, one), t.cells(b, one)
    assert ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1).mean() >= 0.998


def test_components_in_rounds(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 80)] + [(None, 4)]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    one = sorted(map(tuple, components.components(df).collect()))
    assert sorted(map(tuple, components.components(df, last=0).collect())) == one and {c for n, c in one if n <= 60} == {0} and {c for n, c in one if n >= 300} == {300}


def test_components(spark):
    links = [(9, 8), (8, 7), (7, 1), (5, 6), (6, 5), (4, 4), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 1: 1, 5: 5, 6: 5, **{i: 20 for i in range(20, 26)}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- 7 fingerprints ---------------------------------------------------------------------------------


def test_fingerprints(spark, corpus):
    import re

    got = {r["doc_id"]: r for r in iblt.versions(frame(spark, corpus)).collect()}
    assert len(got) == len(corpus)

    def parts(t):
        return {p[i : i + 240] for p in re.split(r"\n+|(?<=[.!?])[ \t]+", t or "") for i in range(0, len(p), 240)} - {""}

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    ids = sorted(corpus, reverse=True)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, u, r = corpus[i] or "", corpus[nxt] or "", got[i]
        k = len(t) // 3
        e = t[: len(t) - k] + u[:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(parts(t), parts(e))) and r["near_next"] == pytest.approx(like(parts(t), parts(u)))
    assert got[0]["fingerprint"] == got[40 * 3]["fingerprint"] != got[3]["fingerprint"]
    assert iblt.versions(empty(spark)).count() == 0
    one = iblt.versions(frame(spark, {5: "Only one. Text."})).first()
    assert one["near_next"] == 1.0
    assert iblt.versions(frame(spark, {5: "a. b."}).union(frame(spark, {5: "a. b."}))).count() == 2


def test_differing_digests_of_two_versions(spark):
    rng = random.Random(6)
    a, b = [[rng.randrange(-(2**63), 2**63) for _ in range(n)] for n in (90, 5)]
    rows = [(a, a[7:] + b), (a, a), ([], b), ([], []), (a[:1], b[:1]), (a * 1, b)]
    fix = lambda c: F.array_sort(F.transform(c, lambda k: k.bitwiseAND(~0xFFFF).bitwiseOR(iblt._check(k))))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select(fix(F.col("a")).alias("a"), fix(F.col("b")).alias("b"))
    for r in df.select("a", "b", iblt.differences(F.col("a"), F.col("b")).alias("d"), iblt.differing(F.col("a"), F.col("b"), iblt.sketch(F.col("a"), F.lit(4), F.lit(0)), iblt.sketch(F.col("b"), F.lit(4), F.lit(0))).alias("n")).collect():
        x, y = set(r["a"]), set(r["b"])
        assert {(z["k"], z["n"]) for z in r["d"]} == {(k, 1) for k in x - y} | {(k, -1) for k in y - x} and r["n"] == len(x ^ y)


def test_fingerprints_of_null_ids_and_long_texts(spark):
    rng = random.Random(8)
    rows = {9: prose(rng, 30_000), 4: "z" * 100_000}
    df = frame(spark, rows).union(frame(spark, {7: "no id."}).withColumn("doc_id", F.lit(None).cast("bigint")))
    got = {r["doc_id"]: r for r in iblt.versions(df).collect()}
    assert set(got) == {9, 4, None} and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())
    t, u = rows[9], rows[4]
    assert got[9]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest()


def test_peeling_recovers_the_difference(spark):
    a, b = list(range(65536 * 3, 65536 * 40, 65536 * 3)), list(range(65536 * 6, 65536 * 43, 65536 * 3))
    fix = lambda c: F.transform(c, lambda k: k.bitwiseOR(iblt._check(k)))
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").select(fix(F.col("a")).alias("a"), fix(F.col("b")).alias("b"))
    w, s = F.lit(8), F.lit(0)
    r = df.select("a", "b", iblt.peel(iblt.subtract(iblt.sketch(F.col("a"), w, s), iblt.sketch(F.col("b"), w, s)), w, s, F.lit(99)).alias("d")).first()
    assert {(x["k"], x["n"]) for x in r["d"]} == {(k, 1) for k in set(r["a"]) - set(r["b"])} | {(k, -1) for k in set(r["b"]) - set(r["a"])}


# ---- 8 mixing ---------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets([10, 10, 1000], [1, 2, 3]) == pytest.approx([30, 30, 960])
    assert mixing.targets([0, 5], [1, 1]) == pytest.approx([0, 5]) and mixing.targets([], []) == []


def test_permutation():
    for n in (1, 2, 5, 64, 1000, 1025):
        assert sorted(mixing.permute(np.arange(n), n, 77).tolist()) == list(range(n))


def test_draws_meet_quotas():
    quotas = [10, 0, 500, 33, 1]
    d = mixing.Draws(quotas, 50, 3)
    each = [d.counts(h) for h in range(d.shards)]
    assert [int(x.sum()) for x in each] == [50] * 10 + [44] and all((d.counts(h) == each[h]).all() for h in range(d.shards))
    d.settle(sum(each))
    first, got = np.zeros(5, np.int64), []
    for n in each:
        for s in np.flatnonzero(n):
            got += zip(*(x.tolist() for x in d.slots(int(s), int(first[s]), int(n[s]))))
        first += n
    assert sorted(got) == [(s, j) for s, q in enumerate(quotas) for j in range(q)]
    # independent draws: shares of many shards are near those of the quotas
    d = mixing.Draws([3000, 1000], 40, 5)
    x = np.array([d.counts(h)[0] for h in range(100)])
    assert abs(x.mean() - 30) < 1.5 and abs(x.std() - (40 * 0.75 * 0.25) ** 0.5) < 0.6


def test_mix(spark, corpus):
    import re

    df = frame(spark, corpus).union(frame(spark, {0: corpus[0]}))
    rows = mixing.summary(mixing.mix(df, block=8)).collect()
    assert len(rows) == len(corpus) + 1
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in corpus.items()}
    per = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"]
        src = f"s{r['doc_id'] % 3}" if r["doc_id"] % 7 else None
        x = per.setdefault(src, [0, 0, r["source_size"], r["target"]])
        x[0] += r["size"]
        x[1] += r["taken"]
    names = sorted(per, key=lambda s: (s is None, s))
    goal = mixing.targets([per[s][0] for s in names], [i % 3 + 1 for i in range(len(names))])
    for s, g in zip(names, goal):
        n, taken, told, target = per[s]
        assert n == told and target == pytest.approx(g) and abs(taken - g) <= 8
    again = mixing.summary(mixing.mix(df, block=8)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert mixing.summary(mixing.mix(empty(spark))).count() == 0
    m = mixing.mix(frame(spark, corpus), block=8)
    words = {r["doc_id"]: r["taken"] for r in mixing.summary(m).collect()}
    out = mixing.mixed_documents(frame(spark, corpus), m)
    assert out.columns == frame(spark, corpus).columns
    got = {}
    for r in out.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(w)
        assert r["n_chars"] == len(r["text"]) and set(w) <= set(re.findall(r"[^\x20\x09-\x0D]+", corpus[r["doc_id"]]))
    assert got == {i: n for i, n in words.items() if n}


# ---- 9 pieces ---------------------------------------------------------------------------------------


def test_viterbi_equals_the_library(corpus):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for x in m.pieces:  # scores of single precision would lose the small ones beside -1e9
        x.score = -40000 if x.score == -1e9 else x.score
    lib, own = sp.SentencePieceProcessor(model_proto=m.SerializeToString()), spviterbi.Pieces(proto=m.SerializeToString(), remember=20)
    rng = random.Random(1)
    texts = [t[:300] for t in corpus.values() if t] + ["", " ", "   a  b ", "日本語 x", "😀😀 x", "x-y (z)."] + ["".join(rng.choice("aben thé\n ,.1日(x)-") for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        ids = own.encode(t).tolist()
        assert ids == lib.encode(t) and own.decode(ids) == lib.decode(ids) == t
    assert own.decode([3 + 0xFF, 3 + 0x41]) == "�A"


def test_streaming_window():
    p, rng = spviterbi.Pieces(tokenizer_path("piece_bpe_32k.model")), random.Random(2)

    def full(s):
        score, back = [0.0] + [-1e300] * len(s), [0] * (len(s) + 1)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + p.longest) + 1):
                g = p.ids.get(s[i:j])
                if g and score[i] + g[0] > score[j]:
                    score[j], back[j] = score[i] + g[0], i
            if s[i] not in p.ids and score[i] + p.unk_score > score[i + 1]:
                score[i + 1], back[i + 1] = score[i] + p.unk_score, i
        out, a = [], len(s)
        while a:
            out.append((back[a], a))
            a = back[a]
        return [x for a, z in reversed(out) for x in p._emit(s, a, z)]

    for t in ["ab" * 2000 + "xq" * 500, *("".join(rng.choice("abenthé1") for _ in range(300)) for _ in range(20))]:
        assert p.viterbi(t) == full(t)


def test_piece_columns(spark, corpus):
    model = tokenizer_path("piece_bpe_32k.model")
    p = spviterbi.Pieces(model)
    rows = spviterbi.digest(frame(spark, corpus).union(frame(spark, {0: corpus[0]})), model).collect()
    assert len(rows) == len(corpus) + 1 and all(r["round_trip"] for r in rows)
    for r in rows:
        ids = p.encode(corpus[r["doc_id"]] or "")
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    e = spviterbi.encode(frame(spark, corpus), model)
    back = e.select("doc_id", spviterbi.decoded(F.col("ids"), model).alias("text")).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in corpus.items()}
    assert spviterbi.digest(empty(spark), model).count() == 0


# ---- 10 n-gram join ---------------------------------------------------------------------------------


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_join(spark, corpus, k, num):
    rng = random.Random(11)
    more = dict(corpus)
    base = [rng.choice(WORDS) for _ in range(80)]
    for i in range(40):  # a chain of near copies
        base = list(base)
        base[rng.randrange(80)] = rng.choice(WORDS)
        more[10_000 + i] = " ".join(base)
    want = multiorder.brute(more, k, num, 100)
    got = multiorder.join(frame(spark, more), k=k, num=num).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(more)
    assert len({c for i, (_, c) in want.items() if i >= 10_000}) < 30


def test_join_edges(spark, corpus):
    df = frame(spark, {1: "a b c d e", 2: "A b\tc d E"}).union(frame(spark, {1: "a b c d e", 3: None, 4: ""}))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in multiorder.join(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)]
    assert multiorder.join(empty(spark)).count() == 0
    kept = multiorder.representatives(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
