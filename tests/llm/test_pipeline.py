"""The pipeline's stages on a small corpus against what plain Python says."""

import os
import random
import re
import shutil

import pytest

from millrace.llm import mixing, multiorder, spviterbi, suffixes, support
from millrace.llm.queries import tokenizer_path

from .test_operators import prose

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    passage = prose(rng, 80)
    rows = [(i, prose(rng, rng.randrange(60, 200)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[1][1] + " end", "en", "s1"), (102, "!!! 12", "en", "s2"), (103, None, None, None), (104, "", "en", "s1")]
    rows += [(110 + i, prose(rng, 70) + " " + passage + " " + prose(rng, 70), "en", "s3") for i in range(4)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    yield d
    shutil.rmtree(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    cols, seen = docs.columns, []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        docs, _ = support.written(out, "stage")
        seen.append(docs.collect())
        if i < 4:
            assert docs.columns == cols
    after_lang = {r["doc_id"]: r["text"] for r in seen[0]}
    assert after_lang == {i: t for i, t in given.items() if i not in (102, 103, 104)}
    want = multiorder.brute(after_lang, 5, 80, 100)
    after_near = {r["doc_id"]: r["text"] for r in seen[1]}
    assert after_near == {i: t for i, t in after_lang.items() if want[i][1] == i} and 100 not in after_near and 101 not in after_near
    gone = suffixes.brute(after_near)
    after_cut = {r["doc_id"]: r["text"] for r in seen[2]}
    import numpy as np

    cut = {i: np.frombuffer(t.encode(), np.uint8)[~gone[i]].tobytes().decode("utf-8", "ignore") for i, t in after_near.items()}
    assert after_cut == {i: t for i, t in cut.items() if t.strip()} and any(len(cut[i]) < len(after_near[i]) for i in cut)
    word = re.compile(mixing.WORD)
    per = {}
    for r in seen[3]:
        per[r["source"]] = per.get(r["source"], 0) + len(word.findall(r["text"]))
        assert r["doc_id"] in after_cut and r["n_chars"] == len(r["text"])
    size = {}
    for r in seen[2]:
        size[r["source"]] = size.get(r["source"], 0) + len(word.findall(r["text"]))
    names = sorted(size)
    for s, g in zip(names, mixing.targets([size[s] for s in names], [i % 3 + 1 for i in range(len(names))])):
        assert abs(per.get(s, 0) - g) <= 512
    p = spviterbi.Pieces(tokenizer_path("piece_bpe_32k.model"))
    assert sorted((r["doc_id"], p.decode(r["ids"])) for r in seen[4]) == sorted((r["doc_id"], r["text"]) for r in seen[3])


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs, _ = support.written(stage(spark, docs, folder), "stage")
    rows = lambda d: sorted((r["doc_id"], r["n_ids"], tuple(r["ids"])) for r in d.collect())
    assert rows(pipeline.run(spark, folder)) == rows(docs) and os.path.isdir(folder)


def test_stages_on_odd_tables(spark, folder):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.schema.simpleString()[7:-1].replace(":", " ") + ", token string, size bigint, node int, t string, s int"
    text = prose(rng, 90)
    given = [(5, text, "en", "s", len(text)), (5, text, "en", "s", len(text)), (None, prose(rng, 80), "en", None, 5), (8, None, None, None, None), (9, "", "en", "s", 0), (10, prose(rng, 20_000), "en", "s", 1)]
    odd = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in given], schema)
    for table in (odd, odd.limit(0)):
        now = table
        for name, stage in pipeline.STAGES:
            now, _ = support.written(stage(spark, now, folder), "odd")
            assert now.columns == (table.columns if name != pipeline.STAGES[-1][0] else ["doc_id", "n_ids", "ids"])
        ids = [r["doc_id"] for r in now.collect()]
        assert set(ids) <= {5, None, 10} and (10 in ids and None in ids) == (table is odd)
