"""The stages on a small corpus: each one's own decisions, and the whole."""

import corpus_pipeline as P
from tests.llm import brute
from tidemark.llm import quality_classifier
from tidemark.llm.shared import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sent = docs.columns, {}
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        scores = {r.doc_id: r.predicted for r in quality_classifier.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()} if name == "quality_classifier" else None
        docs = cut(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
        pairs = [(k, r.text) for k, r in before.items()]
        if name == "quality_classifier":
            assert set(after) == {k for k in before if scores[k]}
        elif name == "near_dedup":
            assert set(after) == {k for k, v in brute.classes(pairs).items() if k == v}
        elif name == "substring_dedup":
            want = brute.substring(pairs)
            assert set(after) == set(before) and all(brute.sha(" ".join(brute.SPACED.findall(r.text)).encode()) == want[k][2] and r.n_chars == len(r.text) for k, r in after.items())
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {k for k, v in brute.contamination(pairs, items).items() if not v[-1]}
            assert not any(v[1] for v in brute.contamination([(k, r.text) for k, r in after.items()], items).values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
        sent[name] = len(after)
    assert docs.count() == P.run(spark, SF).count() == sent["sentencepiece"] > 100


def test_passages_below_the_share_are_cut(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(15))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain, some = "x " * 300 + "end", "x " * 300 + item + ", y " * 300 + "end"
    rows = [(1, plain, len(plain)), (2, some, len(some)), (3, item, len(item)), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    want = some.replace(item, "")
    got = sorted(map(tuple, P.drop_contaminated(spark, docs, str(tmp_path)).collect()))
    assert got == [rows[0], (2, want, len(want)), rows[3]]


def test_odd_documents(spark, tmp_path):
    """Null texts, ids and repeated rows go through all stages; so does a table without rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b", "en", "s", 3), (5, None, "en", "s", None), (5, "", "en", "s", 0), (5, "", "en", "s", 0)], docs.schema)
    for name, rows in (("odd", docs.limit(60).union(odd)), ("none", docs.where("false"))):
        sf = f"{tmp_path}/{name}"
        rows.write.parquet(f"{sf}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
        out = P.run(spark, sf).collect()
        assert all(r.round_trip for r in out) and bool(out) == (name == "odd")
