"""Selection over many tasks: the same rows as a plain sort, and no task with a whole group."""

import random

from pyspark.sql import functions as F

from graingrid.functions.rows import POS
from graingrid.operators import aggregate, select


def made(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["hot"] * 8 + ["a", "b", None, ""]), rng.choice([1, 1, 1, 2, 3, None])) for k in range(n)]
    rows += [(n + k, f"alone{k}", 1) for k in range(5)]
    return rows, spark.createDataFrame(rows, f"{POS} long, g string, m int").repartition(7, "m")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def best(rows, share):
    groups = {}
    for p, g, m in rows:
        if m is not None:
            groups.setdefault(g or "unknown", []).append((-m, p))
    return {p for v in groups.values() for _, p in sorted(v)[: max(1, -(-len(v) * share // 10))]}


def test_shares_of_groups(spark):
    rows, df = made(spark)
    for share in (3, 10, 1):
        out = select.per_group_top(df, "g", ["m"], fraction=share / 10)
        assert {r[POS] for r in out.collect()} == best(rows, share)
        assert "row_number" not in plan(out)
    assert select.per_group_top(df.where("false"), "g", ["m"], fraction=0.5).count() == 0
    few = select.per_group_top(df, "g", ["m"], k=2)
    assert few.groupBy(F.coalesce(F.nullif("g", F.lit("")), F.lit("unknown"))).count().where("count > 2").isEmpty() and "WindowGroupLimit" in plan(few)


def test_a_share_of_all_is_sorted_by_all_tasks(spark):
    rows, df = made(spark)
    want = [p for _, p in sorted((-m, p) for p, _, m in rows if m is not None)]
    for share in (0.37, 0.0, 1.0):
        out = select.top_k(df, ["m"], fraction=share)
        assert [r[POS] for r in out.collect()] == want[: int(len(want) * share)]
        assert "SinglePartition" not in plan(out)
    assert [r[POS] for r in select.top_k(df, ["m"], k=9).collect()] == want[:9]


def test_cuts_are_the_wanted_rows(spark):
    rows, df = made(spark)
    found = {r["__g"]: (r["__quota"], r["__cut"] and r["__cut"][0]) for r in select.cuts(df.where("g is not null"), "g", [F.col(POS)], lambda n: F.floor(n / 2)).collect()}
    groups = {}
    for p, g, _ in rows:
        groups.setdefault(g, []).append(p)
    groups.pop(None)
    assert found == {g: (len(v) // 2, v[len(v) // 2 - 1] if len(v) > 1 else None) for g, v in groups.items()}


def test_balance_repeats_rows(spark):
    df = spark.createDataFrame([(k, "a" if k < 8 else "b") for k in range(10)] + [(20, "c")], "id long, category string")
    got = select.balance(df, {"a": 0.5, "b": 0.5}).collect()
    assert {c: sum(r.category == c for r in got) for c in "abc"} == {"a": 6, "b": 5, "c": 0} or {c: sum(r.category == c for r in got) for c in "abc"} == {"a": 5, "b": 6, "c": 0}
    assert len({(r.id, r._copy) for r in got}) == 11
    assert sorted(map(tuple, got)) == sorted(map(tuple, select.balance(df.repartition(5), {"a": 0.5, "b": 0.5}).collect()))
    assert sum(r.category == "b" for r in select.balance(df, {"b": 1.0}, total=7).collect()) == 7
    assert select.balance(df, {"z": 1.0}).count() == 0


def test_first_of_a_task_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "t", f"s{k}") for k in range(100)], f"{POS} long, id string, s string")
    out = aggregate.first_per_task(df, "id", 3)
    assert {r.task_id: [x.s for x in r.solutions] for r in out.collect()} == {"t": ["s0", "s2", "s4"], "unknown": ["s1", "s3", "s5"]}
    assert "WindowGroupLimit" in plan(out)


def test_numbers_and_examples_of_a_large_pool(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7 % 5000).alias(POS), F.concat(F.lit("e"), F.col("id").cast("string")).alias("text"))
    got = select.numbered(df.where(f"{POS} % 2 = 0"), [F.col(POS)]).collect()
    assert all(r[POS] == 2 * r["__i"] for r in got) and len(got) == 2500
    asked = spark.range(300).select(F.col("id").alias(POS))
    out = select.in_context_examples(asked, df, 4, 1).collect()
    assert len(out) == 300 and all(len(set(r.examples)) == 4 for r in out) and len({x for r in out for x in r.examples}) > 900
    small = df.where(f"{POS} < 3")
    assert all(len(set(r.examples)) == 3 for r in select.in_context_examples(asked, small, 3).collect())
