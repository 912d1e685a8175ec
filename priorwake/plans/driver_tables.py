"""The event roles on the driver's tables, the registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwake.contracts import DAY, Partition, Roles, whole_seconds
from priorwake.functions import composite_key, day_number
from priorwake.operators import encode as enc
from priorwake.operators import features as feat
from priorwake.operators import key_audit, metrics, partitions, profile

EVENTS = Roles(id="event_id", time="t", amount="value", category="event_type", card=("user_id",), device="event_type", address="kind")
ORDERS = Roles(id="o_orderkey", time="t", amount="o_totalprice", category="o_orderpriority", card=("o_custkey", "c_mktsegment"), device="device", address="c_nationkey")
#: Days since 1970 of the split of orders, in seconds.
SPLIT = (Partition("train", 0, 883_612_799), Partition("validation", 883_612_800, 4_102_444_799))

OFF_TIES = 3.137e-7


def _round(df: DataFrame, digits: int = 4, keep=()) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show; to four digits off the ties that means of cents make."""
    off = OFF_TIES if digits == 4 else 0.0
    return df.select(*[F.round(F.col(c) + off, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", whole_seconds(F.col("ts")).alias("t"), "user_id", "event_type", "value", F.when(F.col("value") > 5, F.col("event_type")).alias("kind"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "lineitem"))
    device = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("device"))
    o = o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", whole_seconds(F.col("o_orderdate")).alias("t"))
    c = c.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return o.join(c, o.o_custkey == c.c_custkey, "left").drop("c_custkey").join(device, o.o_orderkey == device.l_orderkey, "left").drop("l_orderkey")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return d.select("doc_id", "n_chars", "lang").join(y, "doc_id")


SQL_EVENTS = """e AS (SELECT event_id, floor(epoch(ts))::BIGINT AS t, user_id, event_type, value, CASE WHEN value > 5 THEN event_type END AS kind FROM events)"""
SQL_ORDERS = """o AS (SELECT o.o_orderkey, floor(epoch(o_orderdate))::BIGINT AS t, o_custkey, c_mktsegment, c_nationkey, c_acctbal, o_totalprice, o_orderpriority, o_orderstatus, d.device,
  o_custkey || '|' || c_mktsegment AS card, o_custkey || '|' || c_mktsegment || '|' || c_nationkey AS ent
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS device FROM lineitem GROUP BY 1) d ON o.o_orderkey = d.l_orderkey)"""


def _past(key: str, time: str = "t", name: str = "w") -> str:
    return f"{name} AS (PARTITION BY {key} ORDER BY {time} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _amount_sql(source: str, table: str, id_col: str, key: str, amount: str, p: str) -> str:
    known = f"({key}) IS NOT NULL"
    return f"""WITH {source}, x AS (SELECT {id_col}, {amount} AS a, {known} AS k, t, count(*) OVER w AS n, avg({amount}) OVER w AS m, stddev_samp({amount}) OVER w AS s, max(t) OVER w AS l
      FROM {table} WINDOW {_past(key)})
    SELECT {id_col}, (CASE WHEN k THEN n ELSE 0 END)::DOUBLE AS {p}_prior_count, round(CASE WHEN k THEN m END, 4) AS {p}_amt_mean, round(CASE WHEN k AND n > 1 THEN s ELSE 0 END, 4) AS {p}_amt_std,
      (CASE WHEN k THEN t - l END)::DOUBLE AS {p}_recency, round(CASE WHEN k AND n > 1 AND s > 0 THEN (a - m) / s ELSE 0 END, 4) AS {p}_amt_zscore FROM x"""


_ENTITY_CTE = f"""WITH {SQL_ORDERS}, f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY ent, coalesce(o_orderpriority, 'None') ORDER BY t, o_orderkey) = 1 THEN 1 ELSE 0 END AS fst,
   least(greatest(floor(o_totalprice / 200), 0), 9) AS bin FROM o),
 x AS (SELECT *, count(*) OVER w AS n, avg(o_totalprice) OVER w AS m, stddev_samp(o_totalprice) OVER w AS s, max(t) OVER w AS l, min(t) OVER w AS b, sum(o_totalprice) OVER w AS tot,
   coalesce(sum(fst) OVER w, 0) AS u, regr_slope(o_totalprice, t::DOUBLE) OVER w AS slope, {", ".join(f"count(*) FILTER (bin = {i}) OVER w AS b{i}" for i in range(10))} FROM f WINDOW {_past("ent")})"""
_ENTROPY = " ".join(f"- CASE WHEN b{i} > 0 THEN (b{i} / n) * log2(b{i} / n) ELSE 0 END" for i in range(10))


def _first_sql(key: str, value: str) -> str:
    return f"CASE WHEN {key} IS NOT NULL AND {value} IS NOT NULL AND row_number() OVER (PARTITION BY {key}, {value} ORDER BY t, o_orderkey) = 1 THEN 1 ELSE 0 END"


_GRAPH_CTE = f"""WITH {SQL_ORDERS}, f AS (SELECT o_orderkey, t, o_totalprice, card, device::VARCHAR AS device, c_nationkey::VARCHAR AS addr,
   {_first_sql("card", "device")} AS f_cd, {_first_sql("device", "card")} AS f_dc, {_first_sql("card", "c_nationkey")} AS f_ca, {_first_sql("c_nationkey", "card")} AS f_ac FROM o),
 x AS (SELECT *, count(*) OVER c AS nc, count(*) OVER d AS nd, count(*) OVER a AS na, count(*) OVER cd AS ncd, count(*) OVER ca AS nca, count(*) OVER da AS nda, count(addr) OVER c AS nc_addr,
   coalesce(sum(f_cd) OVER c, 0) AS u_cd, coalesce(sum(f_dc) OVER d, 0) AS u_dc, coalesce(sum(f_ca) OVER c, 0) AS u_ca, coalesce(sum(f_ac) OVER a, 0) AS u_ac,
   max(t) OVER c AS last_c, max(t) OVER cd AS last_cd, avg(o_totalprice) OVER c AS m, stddev_samp(o_totalprice) OVER c AS s
   FROM f WINDOW {_past("card", name="c")}, {_past("device", name="d")}, {_past("addr", name="a")}, {_past("card, device", name="cd")}, {_past("card, addr", name="ca")}, {_past("device, addr", name="da")})"""

QUERIES, ORACLE = {}, {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql.replace(", 4)", f" + {OFF_TIES}, 4)")
        return f

    return put


@_query("prior_amount_stats", _amount_sql(SQL_EVENTS, "e", "event_id", "user_id", "value", "tb_uid"))
def prior_amount_stats(spark, sf):
    return _round(feat.amount_history(events(spark, sf), EVENTS, ("user_id",), "tb_uid", check=False))


@_query("prior_amount_stats_nullable_key", _amount_sql(SQL_EVENTS, "e", "event_id", "kind", "value", "tb_kind"))
def prior_amount_stats_nullable_key(spark, sf):
    return _round(feat.amount_history(events(spark, sf), EVENTS, ("kind",), "tb_kind", check=False))


@_query("address_history", _amount_sql(SQL_ORDERS, "o", "o_orderkey", "c_nationkey", "o_totalprice", "tb_addr"))
def address_history(spark, sf):
    return _round(feat.address_features(orders(spark, sf), ORDERS, check=False))


@_query("uid_history", _amount_sql(SQL_ORDERS, "o", "o_orderkey", "ent", "o_totalprice", "tb_uid"))
def uid_history(spark, sf):
    return _round(feat.uid_features(orders(spark, sf), ORDERS, check=False))


@_query("uid_card_history", _amount_sql(SQL_ORDERS, "o", "o_orderkey", "card", "o_totalprice", "tb_uid"))
def uid_card_history(spark, sf):
    return _round(feat.card_uid_features(orders(spark, sf), ORDERS, check=False))


@_query(
    "entity_history",
    f"""{_ENTITY_CTE} SELECT o_orderkey, (CASE WHEN ent IS NOT NULL THEN n ELSE 0 END)::DOUBLE AS tb_entity_prior_count, (CASE WHEN ent IS NOT NULL THEN coalesce(t - b, 0) ELSE 0 END)::DOUBLE AS tb_entity_first_seen_age,
   (CASE WHEN ent IS NOT NULL THEN t - l END)::DOUBLE AS tb_entity_recency, round(m, 4) AS tb_entity_amt_mean, round(CASE WHEN n > 1 THEN s ELSE 0 END, 4) AS tb_entity_amt_std,
   round(CASE WHEN n > 1 AND s > 0 THEN (o_totalprice - m) / s ELSE 0 END, 4) AS tb_entity_amt_zscore, u::DOUBLE AS tb_entity_unique_product_count FROM x""",
)
def entity_history(spark, sf):
    return _round(feat.entity_features(orders(spark, sf), ORDERS, check=False))


@_query(
    "entity_dynamics",
    f"""{_ENTITY_CTE} SELECT o_orderkey, n::DOUBLE AS tb_entity_prior_count, round(m, 4) AS tb_entity_amt_mean, round(CASE WHEN n > 1 THEN s ELSE 0 END, 4) AS tb_entity_amt_std,
   round(CASE WHEN n > 0 THEN 0 {_ENTROPY} ELSE 0 END, 4) + 0.0 AS tb_entity_amt_entropy,
   round(CASE WHEN n > 0 AND t > b THEN n / ((t - b) / 86400) ELSE 0 END, 4) AS tb_entity_txn_velocity, round(CASE WHEN n > 0 AND t > b THEN tot / ((t - b) / 86400) ELSE 0 END, 4) AS tb_entity_amt_velocity,
   coalesce(t - b, 0)::DOUBLE AS tb_entity_first_seen, u::DOUBLE AS tb_entity_unique_product_count,
   round(CASE WHEN n < 2 OR isnan(coalesce(slope, 0)) THEN 0 ELSE coalesce(slope, 0) END, 4) AS tb_entity_amt_trend FROM x""",
)
def entity_dynamics(spark, sf):
    return _round(feat.entity_dynamics(orders(spark, sf), ORDERS, check=False))


@_query(
    "pair_strength",
    f"""{_GRAPH_CTE} SELECT o_orderkey, (CASE WHEN card IS NOT NULL AND device IS NOT NULL THEN ncd ELSE 0 END)::DOUBLE AS tb_graph_card_device_count,
   (CASE WHEN card IS NOT NULL AND device IS NOT NULL AND t - last_cd <= 2592000 THEN t - last_cd END)::DOUBLE AS tb_graph_card_device_recency,
   round(CASE WHEN card IS NOT NULL AND device IS NOT NULL AND nc > 0 THEN ncd / nc ELSE 0 END, 4)::DOUBLE AS tb_graph_card_device_strength FROM x""",
)
def pair_strength(spark, sf):
    return _round(feat.pair_strength(orders(spark, sf), ORDERS, check=False))


@_query(
    "graph_structure",
    f"""{_GRAPH_CTE} SELECT o_orderkey, CASE WHEN card IS NOT NULL THEN nc END AS graph_prior_card_transaction_count, CASE WHEN device IS NOT NULL THEN nd END AS graph_prior_device_transaction_count,
   CASE WHEN addr IS NOT NULL THEN na END AS graph_prior_address_transaction_count, (CASE WHEN card IS NOT NULL THEN u_cd END)::BIGINT AS graph_prior_card_distinct_devices,
   (CASE WHEN device IS NOT NULL THEN u_dc END)::BIGINT AS graph_prior_device_distinct_cards, (CASE WHEN card IS NOT NULL THEN u_ca END)::BIGINT AS graph_prior_card_distinct_addresses,
   (CASE WHEN addr IS NOT NULL THEN u_ac END)::BIGINT AS graph_prior_address_distinct_cards,
   CASE WHEN (card IS NOT NULL)::INT + (device IS NOT NULL)::INT + (addr IS NOT NULL)::INT >= 2 THEN
     (CASE WHEN card IS NOT NULL AND device IS NOT NULL AND ncd > 0 THEN 1 ELSE 0 END + CASE WHEN card IS NOT NULL AND addr IS NOT NULL AND nca > 0 THEN 1 ELSE 0 END
      + CASE WHEN device IS NOT NULL AND addr IS NOT NULL AND nda > 0 THEN 1 ELSE 0 END)::BIGINT END AS graph_prior_shared_entity_connectivity FROM x""",
)
def graph_structure(spark, sf):
    return feat.graph_features(orders(spark, sf), ORDERS, check=False)


@_query(
    "relation_diversity",
    f"""WITH {SQL_ORDERS}, f AS (SELECT *, {_first_sql("o_custkey", "device")} AS f_cd, {_first_sql("c_nationkey", "o_custkey")} AS f_ac FROM o),
   x AS (SELECT *, coalesce(sum(f_cd) OVER c, 0) AS u_cd, coalesce(sum(f_ac) OVER a, 0) AS u_ac FROM f WINDOW {_past("o_custkey", name="c")}, {_past("c_nationkey", name="a")})
   SELECT o_orderkey, (CASE WHEN o_custkey IS NOT NULL AND device IS NOT NULL THEN u_cd ELSE 0 END)::DOUBLE AS tb_card1_device_prior_unique_count,
     (CASE WHEN o_custkey IS NOT NULL AND c_nationkey IS NOT NULL THEN u_ac ELSE 0 END)::DOUBLE AS tb_addr1_card1_prior_unique_count FROM x""",
)
def relation_diversity(spark, sf):
    return feat.relation_features(orders(spark, sf), ORDERS, card="o_custkey", check=False)


@_query(
    "novelty_stability",
    f"""{_GRAPH_CTE} SELECT o_orderkey, CASE WHEN card IS NOT NULL AND t - last_c <= 2592000 THEN t - last_c END AS tb_graph_card_recency,
   CASE WHEN card IS NOT NULL AND device IS NOT NULL AND ncd > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS tb_graph_is_novel_card_device, round(CASE WHEN card IS NOT NULL THEN m END, 4) AS tb_graph_card_amt_mean,
   round(CASE WHEN card IS NOT NULL AND nc > 1 AND s > 0 THEN (o_totalprice - m) / s ELSE 0 END, 4) AS tb_graph_card_amt_zscore,
   round(CASE WHEN card IS NOT NULL AND device IS NOT NULL AND nc > 0 THEN ncd / nc ELSE 0 END, 4)::DOUBLE AS tb_graph_card_device_stability,
   CASE WHEN card IS NOT NULL AND device IS NOT NULL AND t - last_cd <= 2592000 THEN t - last_cd END AS tb_graph_pair_recency,
   round(CASE WHEN card IS NOT NULL AND addr IS NOT NULL AND nc_addr > 0 THEN nca / nc_addr ELSE 0 END, 4)::DOUBLE AS tb_graph_card_address_stability FROM x""",
)
def novelty_stability(spark, sf):
    return _round(feat.behaviour_features(orders(spark, sf), ORDERS, check=False).drop("tb_graph_card_velocity", "tb_graph_pair_velocity"))


_BURST = 7200


@_query(
    "burst_velocity",
    f"""WITH {SQL_EVENTS}, x AS (SELECT event_id, kind, count(*) OVER c1 AS a1, count(*) OVER c2 AS a2, count(*) OVER p1 AS b1, count(*) OVER p2 AS b2 FROM e
   WINDOW c1 AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {_BURST} PRECEDING AND 1 PRECEDING), c2 AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {2 * _BURST} PRECEDING AND {_BURST + 1} PRECEDING),
     p1 AS (PARTITION BY user_id, event_type ORDER BY t RANGE BETWEEN {_BURST} PRECEDING AND 1 PRECEDING), p2 AS (PARTITION BY user_id, event_type ORDER BY t RANGE BETWEEN {2 * _BURST} PRECEDING AND {_BURST + 1} PRECEDING))
   SELECT event_id, (a1 - a2)::DOUBLE AS tb_graph_card_velocity, (b1 - b2)::DOUBLE AS tb_graph_pair_velocity FROM x""",
)
def burst_velocity(spark, sf):
    return feat.behaviour_features(events(spark, sf), EVENTS, burst=_BURST, check=False).select("event_id", "tb_graph_card_velocity", "tb_graph_pair_velocity")


@_query("ablation_e4", f"""{_GRAPH_CTE} SELECT o_orderkey, round(m, 4) AS tb_graph_card_amt_mean, round(CASE WHEN nc > 1 AND s > 0 THEN (o_totalprice - m) / s ELSE 0 END, 4) AS tb_graph_card_amt_zscore FROM x""")
def ablation_e4(spark, sf):
    return _round(feat.ablation(orders(spark, sf), "E4", ORDERS, check=False))


@_query("union_history", _amount_sql(SQL_ORDERS, "o", "o_orderkey", "c_nationkey", "o_totalprice", "tb_addr").replace("SELECT o_orderkey, (CASE", f"SELECT * FROM (SELECT o_orderkey, t AS tt, (CASE", 1) + f") WHERE tt >= {SPLIT[1].start}")
def union_history(spark, sf):
    o = orders(spark, sf)
    train, later = (partitions.only(o, "t", p) for p in SPLIT)
    both = feat.over_history(train, later, feat.address_features, ORDERS, check=False)
    return _round(later.select("o_orderkey", F.col("t").alias("tt")).join(both, "o_orderkey"))


@_query("attach_features", _amount_sql(SQL_EVENTS, "e", "event_id", "user_id", "value", "tb_uid").replace("FROM x", ", a AS value FROM x"))
def attach_features(spark, sf):
    e = events(spark, sf)
    made = feat.amount_history(e, EVENTS, ("user_id",), "tb_uid", check=False)
    return _round(feat.attach(e.select("event_id", "value"), made, EVENTS), keep=("value",))


@_query(
    "partition_audit",
    f"""WITH {SQL_ORDERS}, y AS (SELECT t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM o),
   p(name, start, "end") AS (VALUES {", ".join(f"('{p.name}', {p.start}::BIGINT, {p.end}::BIGINT)" for p in SPLIT)})
   SELECT name, start, "end", count(*) FILTER (t BETWEEN start AND "end") AS rows, count(*) FILTER (t BETWEEN start AND "end" AND y = 1) AS positives,
     round(count(*) FILTER (t BETWEEN start AND "end" AND y = 1) / count(*) FILTER (t BETWEEN start AND "end"), 6) AS positive_rate, count(*) AS total_rows, min(t) AS min_time, max(t) AS max_time,
     count(*) FILTER (t IS NULL) AS null_times, count(*) FILTER (y IS NULL) AS null_labels, count(*) FILTER (t < 0 OR t > {SPLIT[-1].end}) AS outside FROM y, p GROUP BY ALL""",
)
def partition_audit(spark, sf):
    o = orders(spark, sf).withColumn("y", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return _round(partitions.partition_audit(o, "t", "y", SPLIT), 6)


@_query("partition_filter", f"WITH {SQL_ORDERS} SELECT o_orderkey, t, t // 86400 AS day FROM o WHERE t BETWEEN {SPLIT[1].start} AND {SPLIT[1].end}")
def partition_filter(spark, sf):
    o = partitions.only(orders(spark, sf), "t", SPLIT[1])
    return o.select("o_orderkey", "t", day_number(F.col("t")).alias("day"))


_PROFILED = ("o_orderkey", "device", "o_totalprice", "c_nationkey", "o_orderpriority")


@_query(
    "missingness",
    f"WITH {SQL_ORDERS} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS total_rows, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6)::DOUBLE AS null_percent FROM o" for c in _PROFILED),
)
def missingness(spark, sf):
    return _round(profile.missingness(orders(spark, sf), _PROFILED), 6)


@_query(
    "cardinality",
    f"WITH {SQL_ORDERS}, "
    + ", ".join(f"f_{c} AS (SELECT count(*) AS n FROM o WHERE {c} IS NOT NULL GROUP BY {c})" for c in _PROFILED)
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", sum(n)::BIGINT AS non_null, count(*) AS distinct_values, round(100.0 * count(*) / sum(n), 6)::DOUBLE AS unique_percent, count(*) FILTER (n = 1) AS singletons, round(100.0 * count(*) FILTER (n = 1) / sum(n), 6)::DOUBLE AS singleton_percent FROM f_{c}"
        for c in _PROFILED
    ),
)
def cardinality(spark, sf):
    return _round(profile.cardinality(orders(spark, sf), _PROFILED), 6)


@_query(
    "top_values",
    f"WITH {SQL_ORDERS} "
    + " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM o WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT 20)" for c in ("device", "c_nationkey", "o_orderpriority")),
)
def top_values(spark, sf):
    return profile.top_values(orders(spark, sf), ("device", "c_nationkey", "o_orderpriority"))


@_query(
    "time_quantiles",
    f"WITH {SQL_ORDERS}, r AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM o), l(level) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in profile.LEVELS)}) SELECT level, t::DOUBLE AS value FROM l JOIN r ON r.i = floor((n - 1) * level + 0.5)",
)
def time_quantiles(spark, sf):
    return profile.nearest_quantiles(orders(spark, sf), "t")


@_query("time_span", f"WITH {SQL_ORDERS}, g AS (SELECT t, count(*) AS n FROM o GROUP BY t) SELECT min(t) AS first, max(t) AS last, count(*) AS distinct_times, sum(n - 1)::BIGINT AS repeated_times FROM g")
def time_span(spark, sf):
    return profile.time_span(orders(spark, sf), "t")


@_query("unique_ids", "SELECT count(*) AS total_rows, count(DISTINCT l_orderkey) AS unique_ids, count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem")
def unique_ids(spark, sf):
    return profile.unique_ids(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey")


@_query(
    "label_rate",
    "SELECT count(*) AS total_rows, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, count(*) FILTER (quality IS NULL) AS null_labels, round(count(*) FILTER (quality = 1) / count(*), 6) AS positive_rate FROM labels",
)
def label_rate(spark, sf):
    return _round(profile.label_rate(spark.read.parquet(f"{sf}/labels.parquet"), "quality"), 6)


@_query(
    "id_coverage",
    """SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS covered,
   (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphans,
   round(100.0 * (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) / (SELECT count(*) FROM documents), 6)::DOUBLE AS coverage_percent""",
)
def id_coverage(spark, sf):
    return _round(profile.id_coverage(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "doc_id"), 6)


_CANDIDATES = {"customer": ("o_custkey",), "segment": ("c_mktsegment", "c_nationkey"), "device": ("device", "c_nationkey"), "card": ("o_custkey", "device"), "absent": ("no_such_column",)}
_HOW = {"time": "t", "train": SPLIT[0], "validation": SPLIT[1], "spread": ("o_totalprice", "c_acctbal"), "several": ("o_orderpriority", "device"), "proxy": ("c_nationkey", "c_mktsegment")}


def _key_sql(name: str, parts) -> str:
    key = " || '|' || ".join(f"{p}::VARCHAR" for p in parts)
    tr, va = (f"t BETWEEN {p.start} AND {p.end}" for p in SPLIT)
    return f"""SELECT '{name}' AS candidate, r.*, k.*, x.* FROM
  (SELECT round(count(u) / count(*), 6) AS coverage, round(count(u) FILTER ({tr}) / count(*) FILTER ({tr}), 6) AS train_coverage, round(count(u) FILTER ({va}) / count(*) FILTER ({va}), 6) AS validation_coverage,
     round(count(u) FILTER ({va} AND u IN (SELECT {key} FROM o WHERE {tr} AND ({key}) IS NOT NULL)) / count(u) FILTER ({va}), 6) AS known_rate FROM (SELECT *, {key} AS u FROM o)) r,
  (SELECT count(*) AS uids, round(avg(n), 6) AS mean_rows, median(n) AS median_rows, max(n) AS max_rows, count(*) FILTER (n = 1) AS singletons, round(avg(span), 6) AS mean_span_days, min(f) AS first_seen, max(l) AS last_seen,
     round(avg(s1), 6) AS mean_std_o_totalprice, round(avg(s2), 6) AS mean_std_c_acctbal, round(avg((tuples > 1)::INT), 6) AS collision_rate, round(avg((q1 > 1 OR q2 > 1)::INT), 6) AS questionable_rate
   FROM (SELECT count(*) AS n, (max(t) - min(t)) / 86400 AS span, min(t) AS f, max(t) AS l, coalesce(stddev_samp(o_totalprice), 0) AS s1, coalesce(stddev_samp(c_acctbal), 0) AS s2, count(DISTINCT {{'a': o_totalprice, 'b': c_acctbal}}) AS tuples,
     count(DISTINCT o_orderpriority) + max((o_orderpriority IS NULL)::INT) AS q1, count(DISTINCT device) + max((device IS NULL)::INT) AS q2 FROM o WHERE ({key}) IS NOT NULL GROUP BY {key})) k,
  (SELECT round(avg(m), 6) AS mean_uids_per_proxy, max(m) AS max_uids_per_proxy FROM (SELECT count(DISTINCT {key}) AS m FROM o WHERE ({key}) IS NOT NULL AND c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY c_nationkey, c_mktsegment)) x"""


@_query("key_audit", f"WITH {SQL_ORDERS} " + " UNION ALL ".join(_key_sql(n, p) for n, p in _CANDIDATES.items() if n != "absent"))
def key_audit_query(spark, sf):
    return _round(key_audit.audit_keys(orders(spark, sf), _CANDIDATES, **_HOW), 6)


@_query(
    "key_recommendation",
    f"WITH {SQL_ORDERS}, a AS (" + " UNION ALL ".join(_key_sql(n, p) for n, p in _CANDIDATES.items() if n != "absent") + ") SELECT candidate, round(coverage * (1 - questionable_rate) * known_rate, 4) AS score FROM a ORDER BY coverage * (1 - questionable_rate) * known_rate DESC, candidate LIMIT 1",
)
def key_recommendation(spark, sf):
    return _round(key_audit.recommend(key_audit.audit_keys(orders(spark, sf), _CANDIDATES, **_HOW)), 4)


@_query(
    "key_known_unknown",
    f"""WITH {SQL_ORDERS}, k AS (SELECT t, o_custkey || '|' || device AS u FROM o), s AS (SELECT DISTINCT u FROM k WHERE t <= {SPLIT[0].end} AND u IS NOT NULL)
   SELECT count(*) FILTER (u IN (SELECT u FROM s)) AS known, count(*) FILTER (u NOT IN (SELECT u FROM s)) AS unknown FROM k WHERE t >= {SPLIT[1].start} AND u IS NOT NULL""",
)
def key_known_unknown(spark, sf):
    o = orders(spark, sf).withColumn("u", composite_key(["o_custkey", "device"]))
    return key_audit.known_unknown(*(partitions.only(o, "t", p) for p in SPLIT), "u")


_CODED = ("o_orderpriority", "device")
_CODE_SQL = f"""WITH {SQL_ORDERS}, c AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, row_number() OVER (ORDER BY {c}::VARCHAR) AS code FROM (SELECT DISTINCT {c} FROM o WHERE {c} IS NOT NULL AND t <= {SPLIT[0].end})" for c in _CODED) + ")"


@_query("category_codes", _CODE_SQL + ' SELECT "column", value, code::INT AS code FROM c')
def category_codes(spark, sf):
    return enc.fit_codes(partitions.only(orders(spark, sf), "t", SPLIT[0]), _CODED)


@_query(
    "category_encode",
    _CODE_SQL
    + " SELECT o_orderkey, "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN -1 ELSE coalesce((SELECT code FROM c WHERE c.\"column\" = '{c}' AND c.value = o.{c}::VARCHAR), 0) END::INT AS {c}" for c in _CODED)
    + f" FROM o WHERE t >= {SPLIT[1].start}",
)
def category_encode(spark, sf):
    o = orders(spark, sf)
    codes = enc.fit_codes(partitions.only(o, "t", SPLIT[0]), _CODED)
    return enc.encode(partitions.only(o, "t", SPLIT[1]).select("o_orderkey", *_CODED), codes, _CODED)


_CURVE = """WITH l AS (SELECT n_chars::DOUBLE AS s, quality AS y FROM documents JOIN labels USING (doc_id)),
 g AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM l GROUP BY s),
 c AS (SELECT s, p, n, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM g)"""


@_query("roc_auc", _CURVE + " SELECT round(sum(n * (tp - p / 2)) / (max(pos) * max(neg)), 6)::DOUBLE AS roc_auc FROM c")
def roc_auc(spark, sf):
    return _round(metrics.roc_auc(labelled(spark, sf), "n_chars", "quality"), 6)


@_query("average_precision", _CURVE + " SELECT round(sum(p * tp / (tp + fp)) / max(pos), 6)::DOUBLE AS average_precision FROM c")
def average_precision(spark, sf):
    return _round(metrics.average_precision(labelled(spark, sf), "n_chars", "quality"), 6)


_CAPS = (0.01, 0.1)


@_query(
    "recall_at_fpr",
    _CURVE + " " + " UNION ALL ".join(f"SELECT {cap}::DOUBLE AS fpr_cap, round(coalesce(max(tp / pos), 0), 6)::DOUBLE AS recall, coalesce(max_by(s, (tp / pos, s)), 'infinity'::DOUBLE) AS threshold FROM (SELECT * FROM c WHERE fp / neg <= {cap})" for cap in _CAPS),
)
def recall_at_fpr(spark, sf):
    return _round(metrics.recall_under_fpr(labelled(spark, sf), "n_chars", "quality", _CAPS), 6, keep=("threshold", "fpr_cap"))


_LOW_CAPS = (0.01, 0.001)


@_query(
    "recall_at_low_fpr",
    _CURVE + " " + " UNION ALL ".join(f"SELECT {cap}::DOUBLE AS fpr_cap, round(coalesce(max(tp / pos), 0), 6)::DOUBLE AS recall, coalesce(max_by(s, (tp / pos, s)), 'infinity'::DOUBLE) AS threshold FROM (SELECT * FROM c WHERE fp / neg <= {cap})" for cap in _LOW_CAPS),
)
def recall_at_low_fpr(spark, sf):
    return _round(metrics.recall_under_fpr(labelled(spark, sf), "n_chars", "quality", _LOW_CAPS), 6, keep=("threshold", "fpr_cap"))


@_query(
    "confusion",
    """WITH l AS (SELECT n_chars >= 1000 AS h, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (NOT h AND NOT y) AS tn, count(*) FILTER (h AND NOT y) AS fp, count(*) FILTER (NOT h AND y) AS fn, count(*) FILTER (h AND y) AS tp FROM l)
   SELECT *, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def confusion(spark, sf):
    return _round(metrics.confusion(labelled(spark, sf), "n_chars", "quality", 1000), 6)


@_query("best_f1", _CURVE + ", f AS (SELECT s, 2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos + 1e-12) AS f1 FROM c) SELECT s AS threshold, round(f1, 6)::DOUBLE AS f1 FROM f ORDER BY f.f1 DESC, s DESC LIMIT 1")
def best_f1(spark, sf):
    return _round(metrics.best_f1(labelled(spark, sf), "n_chars", "quality"), 6)


@_query(
    "model_comparison",
    """WITH l AS (SELECT n_chars AS s, quality = 1 AS q, toxic = 1 AS x FROM documents JOIN labels USING (doc_id)),
   m AS (SELECT 'quality' AS model, avg(s) FILTER (q) AS mean_chars, count(*) FILTER (q)::DOUBLE AS positives FROM l UNION ALL SELECT 'toxic', avg(s) FILTER (x), count(*) FILTER (x)::DOUBLE FROM l),
   u AS (SELECT model, 'mean_chars' AS metric, mean_chars AS value FROM m UNION ALL SELECT model, 'positives', positives FROM m)
   SELECT u.model, u.metric, round(u.value, 4) AS value, round(u.value - b.value, 4) AS delta FROM u JOIN u b ON b.model = 'quality' AND b.metric = u.metric""",
)
def model_comparison(spark, sf):
    d = labelled(spark, sf)
    one = lambda y: d.where(F.col(y) == 1).agg(F.avg("n_chars").alias("mean_chars"), F.count("*").cast("double").alias("positives"))
    return _round(metrics.compare({"quality": one("quality"), "toxic": one("toxic")}), 4)


@_query("class_weight", "SELECT round(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1), 6) AS positive_weight FROM labels")
def class_weight(spark, sf):
    return _round(metrics.class_weight(spark.read.parquet(f"{sf}/labels.parquet"), "quality"), 6)


@_query("gbt_scores")
def gbt_scores(spark, sf):
    from priorwake.operators import model

    d = labelled(spark, sf)
    codes = enc.fit_codes(d, ("lang",))
    d = enc.encode(d, codes, ("lang",))
    fitted = model.fit(d.where("doc_id % 5 <> 0"), ("n_chars", "lang"), "quality", iterations=5)
    return model.score(fitted, d, ("n_chars", "lang"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prior_amount_stats(spark, sf_dir)
