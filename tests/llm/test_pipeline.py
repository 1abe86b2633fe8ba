from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as C
from graingrid.llm import op03_decontaminate as D
from graingrid.llm import op06_langid as L
from graingrid.llm import op09_secrets as S
from graingrid.llm import queries

from .test_simhash import brute


def test_run_equals_its_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language_id", "near_duplicates", "decontaminate", "secrets", "mixing"]
    ok = {r.doc_id for r in L.identify(docs, L.train(docs)).where("accepted").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in ok]
    gone = {x for x, r in brute(rows) if x != r}
    left = spark.createDataFrame([r for r in rows if r[0] not in gone], "doc_id long, text string")
    leaked = {r.doc_id for r in D.leaks(left, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    out = C.run(spark, sf)
    assert out.columns == [*docs.columns, "n_tokens", "p_high", "p_low", "p_toxic", "rate", "copies"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {i: S.redacted(t.encode()).decode() for i, t in rows if i not in gone and i not in leaked}
    assert 0 < len(got) < docs.count()


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        assert out.count() == 0 and out.columns[:5] == docs.columns


def test_every_query_runs(spark, sf):
    for name, q in queries.queries().items():
        assert q(spark, sf).columns, name


def test_run_over_nulls_long_texts_repeats_and_clashing_names(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    few = docs.where("doc_id < 80").withColumns({"rate": F.lit("mine"), "spin": F.lit(1.5), "place": F.lit(None).cast("int"), "__text": F.lit("x"), "group_id": F.lit(7), "row": F.lit(3)})
    item = bench.orderBy("item_id").first().text
    long = " ".join(f"the river and the house number{k} of the town" for k in range(20000))
    odd = [(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, "!!! ... ???", None, None, 11), (9004, long, "en", "s", len(long)), (9005, long + " token=Zx81kfQ9aaBB77cc1", "en", "s", len(long)), (None, "the people of the house and the town went on with it", "en", "s", 51), (9006, f"the words before it {item} and after it", "en", "s", 99)]
    odd += [(9007, "the same text of the house and the people in it, twice", "en", "s", 54)] * 2
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    every = few.unionByName(more, allowMissingColumns=True).select(few.columns)
    every.write.parquet(str(tmp_path / "documents.parquet"))
    labels.union(labels.limit(5)).unionByName(spark.createDataFrame([(None, None, None)], labels.schema)).write.parquet(str(tmp_path / "labels.parquet"))
    bench.unionByName(spark.createDataFrame([(None, None), (77777, None), (77778, "")], "item_id long, text string").select(*(F.col(c).cast(bench.schema[c].dataType) for c in bench.columns))).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = C.run(spark, str(tmp_path))
    assert out.columns == [*(c for c in few.columns if c != "rate"), "n_tokens", "p_high", "p_low", "p_toxic", "rate", "copies"]
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(9007) == 1 and ids.count(None) == 1 and 9006 not in ids and not {9001, 9002, 9003} & set(ids)
    assert ids.count(9004) + ids.count(9005) == 1 and all(r.rate >= 0 and r.spin in (1.5, None) for r in rows)
    assert not any("Zx81kfQ9" in r.text for r in rows)
    # only the last stage's input is left of what was written between them
    assert len(list(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("table-*"))) >= 1
