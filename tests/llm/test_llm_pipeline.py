"""The corpus pipeline: its stages on their own input, against brute force where it is exact."""

import corpus_pipeline
from test_llm_sets import brute_classes, brute_passages  # noqa: F401


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes), name
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name == "minhash_near_dedup":
            keep = {d for d, (_, c) in brute_classes(rows).items() if c == d}
            assert {r["doc_id"] for r in out.collect()} == keep
        elif name == "suffix_array_dedup":
            removed = {d: n for d, _, n, _, _ in brute_passages(rows)}
            lengths = {d: len((t or "").encode()) for d, t in rows}
            for r in out.collect():
                left = lengths[r["doc_id"]] - removed[r["doc_id"]]
                assert left - 6 * 20 <= len((r["text"] or "").encode()) <= left and r["n_chars"] == len(r["text"] or "")
        else:
            assert 0.5 * before <= out.count() <= before
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_odd_rows(spark, sf):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", None, 0, "x"), (2, "...", None, "a", 3, "x"), (3, "the and of is to a in that it " * 20, "en", "a", 5, "y"), (3, "the and of is to a in that it " * 20, "en", "a", 5, "y")]
    names = ["score", "_sha", "_kept", "_text", "_all"]
    docs = spark.createDataFrame([(*r[:5], *[f"{n}-{r[5]}" for n in names]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), sf).count() == 0
        for r in out.collect():
            assert [r[n].rsplit("-", 1)[0] for n in names] == names and len({r[n][-1] for n in names}) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(rows)
