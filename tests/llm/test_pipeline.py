import corpus_pipeline as P
from strataport.llm.line_dedup import dedup_lines
from strataport.llm.ngram_join import join_ngrams
from tests.llm.test_decontamination import brute as leaks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and with that this from which their would be in a for on as by"


def documents(spark):
    base = " ".join(EN.split() * 5)
    other = " ".join(reversed(EN.split() * 6)) + " unlike the first of them"
    rows = [
        (1, base, "en", "a", 1), (2, base + " tail", "en", "b", 1), (3, None, "en", None, None), (4, "", None, "a", 0), (5, "12 %%", "en", "a", 5),
        (6, other, "en", "a", 2), (7, f"x with\ny of\nz and\n{other} seven", "en", "b", 3),
        (8, "x with\ny of\nz and\nthe end of that with which", "en", "b", 3)
    ]
    rows += [(i, f"{' '.join(EN.split()[i % 5 :])} number {i} of the and with a{i} b{i} c{i} d{i} e{i}", "en", "a", 1) for i in range(20, 90)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_stages_keep_columns_and_decide(spark, tmp_path):
    spark.createDataFrame([(1, "the end of that with which"), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = documents(spark)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "packing"]
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.dtypes == docs.dtypes
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            assert set(before) - set(after) == {3, 4, 5}
        elif name == "line_dedup":
            want = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
            assert after == {i: t for i, t in want.items() if i in after} and 8 in after and after[8] == "the end of that with which"
        elif name == "ngram_join":
            assert set(after) == {r.doc_id for r in join_ngrams(docs).collect() if r.doc_id == r.component_id} and 2 not in after
        else:
            items = [(1, "the end of that with which"), (2, None)]
            assert set(after) == {i for i, t in before.items() if not leaks(t, items)[1]} and 8 not in after
        docs = spark.createDataFrame(out.collect(), SCHEMA)
    left = docs.count()
    pieces = P.packing(spark, docs, "")
    assert pieces.select("doc_id").distinct().count() == left and pieces.columns[:3] == ["doc_id", "start", "length"]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, docs, f"file://{tmp_path}").count() == 0
