"""Files: positions, broken lines, settings, media, catalogues."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from graingrid.functions.rows import POS, with_pos
from graingrid.sources import catalog, jsonl, media


def test_positions_follow_files_and_places_however_they_are_split(spark, tmp_path):
    for name, lo in (("b", 50), ("a", 0), ("c", 90)):
        (tmp_path / f"{name}.json").write_text("".join(json.dumps({"n": k, "pad": "x" * 50}) + "\n" for k in range(lo, lo + (50 if name == "a" else 40))))
    want = list(range(130))
    for size in ("128m", "700b", "3000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            for schema in (None, "n long, pad string"):
                got = {r[POS]: r.n for r in jsonl.read_jsonl(spark, str(tmp_path), schema).collect()}
                assert [got[k] for k in range(len(want))] == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dense_positions_of_any_rows(spark):
    df = with_pos(spark.range(0, 100, 1, 7).where("id % 3 = 0"), dense=True)
    assert [r[POS] for r in df.orderBy("id").collect()] == list(range(34))
    assert with_pos(spark.range(0), dense=True).count() == 0


def test_broken_and_blank_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    for schema in (None, "a long"):
        assert [r.a for r in jsonl.read_jsonl(spark, str(p), schema).orderBy(POS).collect()] == [1, 2]
        with pytest.raises(Exception):
            jsonl.read_jsonl(spark, str(p), schema, strict=True).collect()
    out = str(tmp_path / "out")
    jsonl.write_jsonl(jsonl.read_jsonl(spark, str(p)), out, single=True)
    assert [json.loads(t) for f in (tmp_path / "out").glob("part-*") for t in f.read_text().splitlines()] == [{"a": 1}, {"a": 2}]
    with pytest.raises(ValueError):
        jsonl.require_rows(spark.range(0))


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"dataset": {"input_path": "${ROOT}/x", "gone": null}, "list": ["$NAME"]}')
    got = jsonl.load_config(str(p), {"ROOT": str(tmp_path), "NAME": "n"})
    assert got == {"dataset": {"input_path": f"{tmp_path}/x"}, "list": ["n"]}
    with pytest.raises(ValueError):
        jsonl.load_config(str(p), {"ROOT": "r"})
    with pytest.raises(ValueError):
        jsonl.check_paths(got)
    (tmp_path / "x").write_text("")
    jsonl.check_paths(got)
    jsonl.write_json({"ü": 1}, str(tmp_path / "d" / "y.json"))
    assert jsonl.read_json(str(tmp_path / "d" / "y.json")) == {"ü": 1}
    (tmp_path / "p.txt").write_text("from file\n")
    assert jsonl.resolve_prompt("inline\n", str(tmp_path / "p.txt")) == "from file" and jsonl.resolve_prompt("inline\n") == "inline" and jsonl.resolve_prompt(default="d") == "d"


def test_media_as_data_urls(spark, tmp_path):
    (tmp_path / "a b.jpg").write_bytes(b"\xff\xd8abc")
    (tmp_path / "big.png").write_bytes(b"x" * 100)
    rows = [(1, f"{tmp_path}/a b.jpg"), (2, f"file://{tmp_path}/a b.jpg"), (3, f"{tmp_path}/big.png"), (4, f"{tmp_path}/none.png"), (5, "https://x/y.png"), (6, "data:image/png;base64,AA=="), (7, None), (8, str(tmp_path)), (9, "")]
    got = {r.k: r.u for r in media.data_urls(spark.createDataFrame(rows, "k int, p string"), "p", "u", max_bytes=50).collect()}
    jpg = "data:image/jpeg;base64," + base64.b64encode(b"\xff\xd8abc").decode()
    assert got == {1: jpg, 2: jpg, 3: None, 4: None, 5: "https://x/y.png", 6: "data:image/png;base64,AA==", 7: None, 8: None, 9: None}
    assert media.data_urls(spark.createDataFrame(rows[2:3], "k int, p string"), "p", "u").first().u.startswith("data:image/png;base64,eHh4")


def test_catalogue_of_models(spark):
    entries = [{"name": "small", "family": "b", "kind": "model", "size": "1B", "note_en": "fast", "note_zh": "小 模型"}, {"name": "data", "family": "a", "kind": "dataset"}, {"family": "c"}]
    df = catalog.catalog(spark, entries)
    assert [r.name for r in df.collect()] == ["data", "small"]
    assert [r.name for r in catalog.catalog(spark, entries, kind="model").collect()] == ["small"] and catalog.catalog(spark, entries, family="c").count() == 0
    assert "small" in catalog.table_text(df, ["name", "size"]).splitlines()[3]
    assert "| small | 1B | 小模型 |" in catalog.markdown(df, "zh") and "fast" in catalog.markdown(df)
    assert df.select(F.count("*")).first()[0] == 2
