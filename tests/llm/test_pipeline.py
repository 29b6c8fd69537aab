"""The pipeline on the smallest tables: each stage against its operator's brute force."""

import collections
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DIR = os.environ.get("DOCKETRY_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        if name != "bpe":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
    texts = dict(zip(seen["toxicity"]["doc_id"], seen["toxicity"]["text"]))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    kept = set(seen["near_dedup"]["doc_id"])
    # what stays is the first document of each group
    assert kept == {root(i) for i in ids}
    copies = collections.Counter(seen["mixing"]["doc_id"])
    assert set(copies) <= kept and max(copies.values()) <= 2
    assert collections.Counter(seen["bpe"]["doc_id"]) == copies
    assert len(seen["language"]) >= 0.97 * spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_odd_documents(spark, tmp_path):
    text = "the members of the committee met to discuss the plan for the new year and the budget of the town "
    rows = [(i, text + f"part {i} " * 9, "en", "a" if i % 2 else None, 1) for i in range(30)]
    rows += [(3, "the other text of the same id and the town " * 4, "en", "a", 1), (3, "the other text of the same id and the town " * 4, "en", "a", 1)]
    rows += [(None, text, "en", "a", 1), (None, text, "en", "a", 1), (60, None, "en", "a", 1), (61, "", None, None, 1), (62, " \t1 2 3", "en", "b", 1), (63, text * 3000, None, "b", 1)]
    rows += [(70 + i, "und der das mit von nicht auch eine die ist wir sie " * 9, "de", "b", 1) for i in range(6)]
    extra = {c: "x" for c in ("_found", "_score", "mix", "id", "group", "fp", "key", "_rate", "_copy", "h")}
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in extra.items()})
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(20)], "doc_id long, quality int, toxic int")
    for name, part in (("full", documents), ("none", documents.limit(0))):
        folder = str(tmp_path / name)
        part.write.parquet(f"{folder}/documents.parquet")
        labels.limit(20 if name == "full" else 0).write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES:
            out = function(spark, docs, folder)
            assert stage == "bpe" or out.columns == documents.columns
            out.write.parquet(f"{folder}/{stage}")
            docs = spark.read.parquet(f"{folder}/{stage}")
            if name == "none":
                assert docs.count() == 0
            elif stage == "language":
                assert {r["doc_id"] for r in docs.collect()} & {60, 61, 62} == set()
            elif stage == "near_dedup":
                counts = collections.Counter(r["doc_id"] for r in docs.collect())
                assert counts[None] == 2 and max(n for i, n in counts.items() if i is not None) == 1
        assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_intermediate_folders_go(spark, tmp_path):
    import glob

    from docketry.llm.common import shared_folder

    before = set(glob.glob(f"{shared_folder(spark)}/pipeline-*"))
    corpus_pipeline.run(spark, DIR).count()
    (made,) = set(glob.glob(f"{shared_folder(spark)}/pipeline-*")) - before
    assert os.listdir(made) == ["4-bpe"]
