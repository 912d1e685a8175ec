"""Secret scan: patterned spans in every text, judged by who else owns the same value in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, require

#: Kind, pattern, the group that holds the secret, least length of that group.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Long mixed runs that no base kind explains; they become spans only when one owner alone has them.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|test|xxxx|0000000|1234567|abcdef"

SPAN = "struct<kind:string,rank:int,s:int,e:int,v:string>"


def find(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches whose group has at least `least` characters.

    split() gives the pieces between the matches, so offsets are running sums of lengths, in code points.
    """
    none = F.array().cast(f"array<{SPAN}>")
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matched)).alias("p"), matched.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("s"), end.alias("e"), x["v"].alias("v")).cast(SPAN)
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def live_looking(value: Column) -> Column:
    """Long, mixed, varied and no placeholder."""
    return (
        (F.length(value) >= 16)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
        & ~value.rlike(PLACEHOLDER)
    )


def ownership(candidates: DataFrame, wide_owners: int = 3) -> DataFrame:
    """(hash, n_docs, n_repos, n_owners, copied, specific) for candidates (hash, owner, repo).

    Three levels of partial aggregates, so a value that a third of all documents hold costs each task one row.
    A null owner or repository is unknown and not counted.
    """
    by_repo = candidates.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("repo").alias("repos"))
    return (
        by_owner.groupBy("hash")
        .agg(F.sum("n").alias("n_docs"), F.sum("repos").alias("n_repos"), F.count("owner").alias("n_owners"))
        .withColumn("copied", F.col("n_owners") >= wide_owners)
        .withColumn("specific", F.col("n_owners") == 1)
    )


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repo: Column | None = None,
    wide_owners: int = 3,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind,rank,s,e,n_docs,n_repos,n_owners,copied,live>>, keep.

    Base spans (assign, access, hex) are always there. Each span's value is hashed and counted over the whole corpus:
    copied means that at least wide_owners owners hold it (a shared example), live that one owner alone does and
    that it looks like a working credential. Runs of 20 and more mixed characters outside the base spans are
    added as kind `owned` when they are live. Owners default to source, repositories to source and lang.

    A null text has no spans. Repeated rows stay rows and each counts as a document; null ids are kept. Texts of any
    length are scanned whole. An empty table gives an empty result; other columns are not touched. Only JVM
    functions run; what is shuffled are hashes and offsets, never texts.
    """
    require(docs, id_col, text_col)
    owner = F.col("source") if owner is None else owner
    repo = F.concat(F.col("source"), F.lit("/"), F.col("lang")) if repo is None else repo
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), text.alias("body"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    body = F.col("body")
    base = F.concat(*[find(body, k, i, p, g, n) for i, (k, p, g, n) in enumerate(KINDS)])
    rows = rows.withColumn("base", base).withColumn("runs", find(body, "owned", len(KINDS), RUN, 0, 20))
    apart = F.filter("runs", lambda r: live_looking(r["v"]) & ~F.exists(F.col("base"), lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])))
    spans = F.transform(
        F.concat("base", apart),
        lambda x: F.struct(x["kind"].alias("kind"), x["rank"].alias("rank"), x["s"].alias("s"), x["e"].alias("e"), F.sha2(x["v"], 256).alias("hash"), live_looking(x["v"]).alias("looks")),
    )
    kept = [f"keep_{c}" for c in keep]
    # The row number is stored, so it names the same row however often a task runs.
    found = materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo", *kept, spans.alias("spans")), "secrets")
    each = found.where(F.size("spans") > 0).select("rid", "owner", "repo", F.explode("spans").alias("x")).select("rid", "owner", "repo", "x.*")
    owned = materialize(ownership(each.select("rid", "owner", "repo", "hash").distinct(), wide_owners), "owners")
    judged = (
        each.join(owned, "hash")
        .withColumn("live", F.col("specific") & F.col("looks"))
        .where((F.col("kind") != "owned") | F.col("live"))
        .groupBy("rid")
        .agg(F.sort_array(F.collect_list(F.struct("s", "rank", "e", "kind", "n_docs", "n_repos", "n_owners", "copied", "live"))).alias("spans"))
    )
    empty = F.array().cast("array<struct<s:int,rank:int,e:int,kind:string,n_docs:bigint,n_repos:bigint,n_owners:bigint,copied:boolean,live:boolean>>")
    # Only rows that have candidates are joined; all others, and what they keep, stay where they are.
    some = found.where(F.size("spans") > 0).drop("spans").join(judged, "rid", "left").withColumn("spans", F.coalesce("spans", empty))
    out = found.where(F.size("spans") == 0).withColumn("spans", empty).unionByName(some)
    return out.select("doc_id", "spans", *[F.col(f"keep_{c}").alias(c) for c in keep])


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op1_query(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return found.select(
        "doc_id",
        *[count(_of_kind(k)).alias(f"n_{k}") for k, *_ in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: x["copied"]).alias("n_copied"),
    )


def _sql_kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT rid, '{kind}' AS kind, {rank} AS rank, s::INT AS s, (s + length(m))::INT AS e, v FROM (
    SELECT rid, unnest(list_transform(range(1, len(ms) + 1), lambda i:
        {{'s': list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0), 'm': ms[i], 'v': vs[i]}}), recursive := true)
    FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, regexp_split_to_array(t, '{p}') AS ps FROM d))
  WHERE length(v) >= {least}"""


_LIVE = f"(length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8 AND NOT regexp_matches(v, '{PLACEHOLDER}'))"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, source || '/' || lang AS repo, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_sql_kind(i, *k) for i, k in enumerate(KINDS))}),
runs AS ({_sql_kind(len(KINDS), "owned", RUN, 0, 20)}),
spans AS (SELECT * FROM base UNION ALL
  SELECT * FROM runs r WHERE {_LIVE} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.s < r.e AND r.s < b.e)),
owned AS (SELECT v, count(DISTINCT source) AS n_owners FROM spans JOIN d USING (rid) GROUP BY v),
judged AS (SELECT spans.*, n_owners >= 3 AS copied, n_owners = 1 AND {_LIVE.replace("(v", "(spans.v")} AS live
           FROM spans JOIN owned ON spans.v = owned.v),
kept AS (SELECT *, kind || ':' || s || ':' || e AS txt FROM judged WHERE kind <> 'owned' OR live),
agg AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               string_agg(txt, ',' ORDER BY s, rank) FILTER (kind <> 'owned') AS b, string_agg(txt, ',' ORDER BY s, rank) AS spans,
               count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
        FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN agg USING (rid)
"""
