"""The stream's scores equal the batch ones, whatever the order within the allowed delay."""

import random

from priorwake.contracts import Roles
from priorwake.operators.features import amount_history
from priorwake.streaming import strict_prior_stream
from pyspark.sql import functions as F


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"u{rng.randrange(4)}", 1_700_000_000 + 30 * rng.randrange(40), float(rng.randrange(100))) for i in range(120)]
    rows += [(1000, "zz", 1_700_100_000, 1.0), (1001, "zz", 1_700_200_000, 1.0)]  # moves the watermark past all others
    order = sorted(rows, key=lambda r: r[2] + rng.randrange(300))
    schema = "id long, user string, t long, amount double"
    for k in range(0, len(order), 20):
        spark.createDataFrame(order[k : k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("t"))
    made = strict_prior_stream(stream, key="user", id_col="id", ts="ts", amount="amount", delay="20 minutes")
    query = made.writeStream.format("memory").queryName("scored").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["id"]: (r["prior_count"], r["amt_mean"] and round(r["amt_mean"], 6)) for r in spark.table("scored").collect()}
    batch = amount_history(spark.createDataFrame(rows, schema), Roles(id="id", time="t", amount="amount"), ("user",), "p", check=False)
    want = {r["id"]: (int(r["p_prior_count"]), r["p_amt_mean"] and round(r["p_amt_mean"], 6)) for r in batch.collect() if r["id"] < 1000}
    assert {i: v for i, v in got.items() if i < 1000} == want
