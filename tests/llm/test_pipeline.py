"""Every stage on its own input, against plain forms, and the whole run."""

import zlib

import corpus_pipeline
from wardspark.llm import mixing, secrets, toxicity

from .test_operators import brute_groups, documents, folder  # noqa: F401


def test_stages(spark, folder):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, after = docs.collect(), stage(spark, docs, folder)
        texts = {r["doc_id"]: r["text"] for r in before}
        got = {r["doc_id"]: r for r in after.collect()}
        if k == 0:
            m = toxicity.Matcher(toxicity.fit(spark, folder, docs))
            assert {i for i, t in texts.items() if "zzbad" not in (t or "")} == set(got) and m.features("zzbad")[2]
        elif k == 1:
            assert set(got) == {i for i, (_, root) in brute_groups(texts).items() if i == root}
        elif k == 2:
            s = secrets.Scanner(secrets.tiktoken_file())
            assert set(got) == set(texts) and all(not t["text"] or not s.base(t["text"]) for t in got.values())
        elif k == 3:
            p = {r["_row"]["doc_id"]: r["_probability"] for r in mixing.weighed(docs).collect()}
            assert set(got) == {i for i in texts if draw(i) < p[i]}
        else:
            assert {r["doc_id"] for r in after.collect()} == set(texts)
        if k < 4:
            assert after.columns == docs.columns
            docs = spark.createDataFrame(after.collect(), docs.schema)


def draw(i):
    import hashlib

    return int(hashlib.md5(f"mix{i}".encode()).hexdigest()[:8], 16) / 2**32


def test_run_and_empty_input(spark, folder, tmp_path):  # noqa: F811
    assert corpus_pipeline.run(spark, folder).count() > 0 and zlib
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
