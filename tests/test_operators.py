"""Profiles, partitions, key audits, encoding, metrics, sources and sinks on small frames."""

import pytest

from priorwake import sources
from priorwake.contracts import LOCKED, Partition
from priorwake.functions import composite_key, day_number, replaced
from priorwake.operators import encode, key_audit, metrics, partitions, profile
from pyspark.sql import functions as F


def test_expressions(spark):
    df = spark.createDataFrame([(1, "a", -7), (None, "b", 7)], "x int, y string, t long")
    rows = df.select(composite_key(["x", "y"]).alias("k"), day_number(F.col("t"), 2).alias("d"), replaced(F.col("y"), {"a": 5}, 0, -1).alias("r")).collect()
    assert [tuple(r) for r in rows] == [("1|a", -4, 5), (None, 3, 0)]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "x int, y string")
    assert {r["column"]: (r["null_count"], r["null_percent"]) for r in profile.missingness(df).collect()} == {"x": (0, 0.0), "y": (1, 25.0)}
    row = profile.cardinality(df, ["y"]).first()
    assert (row["non_null"], row["distinct_values"], row["singletons"]) == (3, 2, 1)
    assert [(r["value"], r["n"]) for r in profile.top_values(df, ["y"], 1).collect()] == [("a", 2)]
    assert {r["level"]: r["value"] for r in profile.nearest_quantiles(df, "x", (0.0, 0.5, 1.0)).collect()} == {0.0: 1.0, 0.5: 3.0, 1.0: 4.0}
    assert profile.nearest_quantiles(df.limit(0), "x", (0.5,)).first()["value"] is None
    cover = profile.id_coverage(df, spark.createDataFrame([(1,), (1,), (9,)], "x int"), "x").first()
    assert (cover["covered"], cover["orphans"], cover["coverage_percent"]) == (1, 1, 25.0)
    assert profile.missingness(df.limit(0)).first()["null_percent"] == 0.0


def test_partitions(spark):
    partitions.validate_boundaries()
    for bad in ((), (Partition("a", 2, 1),), (Partition("a", 1, 5), Partition("b", 5, 9)), (Partition("a", 1, 5), Partition("b", 7, 9))):
        with pytest.raises(ValueError):
            partitions.validate_boundaries(bad)
    p = (Partition("a", 0, 4), Partition("b", 5, 9))
    df = spark.createDataFrame([(0, 1), (4, 0), (9, 1)], "t long, y int")
    audit = partitions.partition_audit(df, "t", "y", p)
    assert [(r["name"], r["rows"], r["positives"], r["positive_rate"]) for r in audit.collect()] == [("a", 2, 1, 0.5), ("b", 1, 1, 1.0)]
    partitions.enforce(audit, p)
    with pytest.raises(ValueError, match="outside"):
        partitions.enforce(partitions.partition_audit(df.union(spark.createDataFrame([(10, 1)], df.schema)), "t", "y", p), p)
    assert LOCKED[0].end + 1 == LOCKED[1].start


def test_key_audit(spark):
    df = spark.createDataFrame([(1, "a", 1, 1.0), (2, "a", 1, 3.0), (11, "a", 2, 5.0), (12, "b", 1, 7.0), (13, None, 1, 9.0)], "t long, k string, g int, d double")
    how = {"time": "t", "train": Partition("train", 0, 10), "validation": Partition("validation", 11, 20), "spread": ("d",), "several": ("g",), "proxy": ("g",)}
    out = {r["candidate"]: r for r in key_audit.audit_keys(df, {"k": ("k",), "none": ("missing",)}, **how).collect()}
    assert list(out) == ["k"]
    r = out["k"]
    assert (r["coverage"], r["known_rate"], r["uids"], r["singletons"], r["questionable_rate"]) == (0.8, 0.5, 2, 1, 0.5)
    empty = key_audit.audit_keys(df.withColumn("k", F.lit(None).cast("string")), {"k": ("k",)}, **how).first()
    assert (empty["coverage"], empty["uids"], empty["mean_rows"]) == (0.0, 0, None)
    assert tuple(key_audit.known_unknown(df.where("t < 11"), df.where("t >= 11"), "k").first()) == (1, 1)


def test_codes(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    codes = encode.fit_codes(train, ["c"])
    assert {r["value"]: r["code"] for r in codes.collect()} == {"a": 1, "b": 2}
    later = spark.createDataFrame([("z",), ("b",), (None,)], "c string")
    assert sorted(r["c"] for r in encode.encode(later, codes, ["c"]).collect()) == [-1, 0, 2]
    v = encode.matrix(spark.createDataFrame([(1.0, None, 1)], "a double, b double, y int"), ["a", "b"], "y").first()["features"]
    assert v[0] == 1.0 and v[1] != v[1]


def test_metrics(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.2, 1), (0.1, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    pairs = [(p, n) for p, a in rows if a for n, b in rows if not b]
    assert metrics.roc_auc(df, "s", "y").first()[0] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p, n in pairs) / len(pairs))
    assert metrics.average_precision(df, "s", "y").first()[0] == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 5) / 3)
    best = {r["fpr_cap"]: (r["recall"], r["threshold"]) for r in metrics.recall_under_fpr(df, "s", "y", (0.0, 0.34)).collect()}
    assert best == {0.0: (pytest.approx(1 / 3), 0.9), 0.34: (pytest.approx(2 / 3), 0.8)}
    assert metrics.confusion(df, "s", "y", 0.8).first().asDict() == {"tn": 2, "fp": 1, "fn": 1, "tp": 2, "precision": pytest.approx(2 / 3), "recall": pytest.approx(2 / 3), "f1": pytest.approx(2 / 3)}
    assert metrics.best_f1(df, "s", "y").first()["threshold"] == 0.2
    assert metrics.roc_auc(df.where("y = 1"), "s", "y").first()[0] is None
    assert metrics.average_precision(df.limit(0), "s", "y").first()[0] == 0.0


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,x\n1,2.5\n2,\n")
    schema = sources.derive_schema(spark, str(path))
    sources.save_schema(spark, schema, str(tmp_path / "schema.json"))
    df = sources.scan_csv(spark, str(path), sources.load_schema(spark, str(tmp_path / "schema.json")), ["id", "x"])
    assert [tuple(r) for r in df.collect()] == [(1, 2.5), (2, None)]
    with pytest.raises(FileNotFoundError):
        sources.scan_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="missing columns: y"):
        sources.scan_csv(spark, str(path), schema, ["y"])
    sources.write_json(spark, str(tmp_path / "m.json"), {"evaluation_partition": "test"})
    with pytest.raises(ValueError, match="validation"):
        sources.read_metrics(spark, str(tmp_path / "m.json"))
    assert sources.replace_section("x\n<a>\nold\n<b>\ny", "<a>", "<b>", "new") == "x\n<a>\nnew\n<b>\ny"
    with pytest.raises(ValueError):
        sources.replace_section("x", "<a>", "<b>", "new")
    assert sources.markdown_table(df).splitlines()[2] == "| 1 | 2.5 |"


def test_entry_registers(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_curves_and_quantiles_of_values_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(nan, 1), (inf, 1), (2.0, 0), (1.0, 1), (-inf, 0), (None, 1), (1.0, 0), (0.5, None)]
    df = spark.createDataFrame(rows, "s double, y int")
    curve = [(str(r["score"]), r["tp"], r["fp"]) for r in metrics.curve(df, "s", "y", 4).orderBy(F.desc("score")).collect()]
    assert curve == [("nan", 1, 0), ("inf", 2, 0), ("2.0", 2, 1), ("1.0", 3, 2), ("-inf", 3, 3)]
    got = [str(r["value"]) for r in profile.nearest_quantiles(df, "s", (0.0, 0.5, 1.0)).orderBy("level").collect()]
    assert got == ["-inf", "1.0", "nan"]
