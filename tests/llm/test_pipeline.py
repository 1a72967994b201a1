"""The pipeline's stages against brute force on the smallest tables."""

import re

import corpus_pipeline as cp

LOWER = {k: k + 32 for k in range(65, 91)}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns
        path = cp.scratch_path(spark, "test")
        after.write.parquet(path)
        seen[name], docs = (docs, spark.read.parquet(path)), spark.read.parquet(path)
    before, after = (dict((r["doc_id"], r["text"]) for r in x.collect()) for x in seen["language"])
    assert set(before) - set(after) <= {i for i, t in before.items() if not t or len(t) < 40 or not any(c.isalpha() for c in t)}
    windows = {tuple(w[i : i + 10]) for t in items if (w := WORDS.findall(t.translate(LOWER))) for i in range(max(1, len(w) - 9))}
    before, after = (dict((r["doc_id"], r["text"]) for r in x.collect()) for x in seen["benchmark"])
    for i, t in before.items():
        w = WORDS.findall((t or "").translate(LOWER))
        assert (i in after) == (not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)))
    lines = {}
    before, after = (dict((r["doc_id"], r["text"]) for r in x.collect()) for x in seen["lines"])
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i in sorted(before):
        for x in before[i].split("\n"):
            lines.setdefault(key(x), i)
    for i, t in before.items():
        assert after[i] == "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or lines[key(x)] == i)


def test_run(spark, small):
    out = cp.run(spark, small)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
