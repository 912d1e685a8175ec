"""Exact n-gram Jaccard join through a token-group matrix.

Documents are sets of word shingles; equal sets are one set. Sets of like size that share several least hashes with one
set are put in its group. A set that reaches similarity t with another shares a token with it among its first
n - ceil(t*n) + 1 tokens in any common order. The matrix holds the union of these leading tokens for each group, a set
outside all groups being a group of its own: a row for each token and group.

Two groups' overlap is summed on the matrix alone. Beyond the leading tokens of the set whose last one comes first, that
set has only ceil(t*n) - 1 tokens left, so the sum bounds what any two members can share. Only where the bound allows a
link are the groups opened and their members compared with whole sets; every group is also opened for its own members.

A token that many groups have makes no pairs of all of them: there a pair has to be possible with this token as its
first shared one, and what such tokens add to a sum is bounded by how many of them a group has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, partitions, require, shingle_hashes, trimmed

#: The most frequent tokens that go to the end of the common order; any set of tokens gives right results.
HEAVY = 1 << 18
#: Tokens that a task counts at once for that.
COUNTED = 1 << 22
#: log2 of the bits in the filter of set ids.
FILTER_BITS = 26
#: Groups of a token from which on it makes no pairs of all of them.
CROWD = 32
#: Sets and tokens of a part of a group, which is opened at once.
PART, PART_TOKENS = 1024, 1 << 19
#: Odd factors that reorder the tokens for least hashes, and how many of these a set shares with the first of its group.
FACTORS, AGREE = (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85), 2
#: Ratio of neighbouring classes of sizes.
RATIO = 1.1


def need(n, percent: int):
    """ceil(percent * n / 100)."""
    return -((-percent * n) // 100)


def set_id(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (shingle_hashes(t) for t in batch.column(1).to_pylist())


def _profile(docs: DataFrame) -> DataFrame:
    """(kind, doc_id, key, n, least): kind 0 are documents with their set's id, size and least hashes, kind 1 tokens and their counts in a task."""

    def counted(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, counts = _repeated(parts)
        for j in range(0, len(tokens), 100_000):
            t = tokens[j : j + 100_000]
            nothing = pa.nulls(len(t), pa.list_(pa.int64()))
            yield pa.record_batch({"kind": np.ones(len(t), np.int32), "doc_id": pa.nulls(len(t), pa.int64()), "key": t, "n": counts[j : j + 100_000].astype(np.int64), "least": nothing})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            sets = list(_sets(b))
            ids = [set_id(x) if len(x) else None for x in sets]
            least = [_least_hashes(x) if len(x) else None for x in sets]
            yield pa.record_batch({"kind": np.zeros(len(sets), np.int32), "doc_id": b.column(0), "key": pa.array(ids, pa.int64()), "n": pa.array([len(x) for x in sets], pa.int64()), "least": pa.array(least, pa.list_(pa.int64()))})
            parts += sets
            size += sum(map(len, sets))
            del sets
            if size > COUNTED:
                yield from counted(parts)
                size = 0
        yield from counted(parts)

    return docs.mapInArrow(trimmed(work), "kind int, doc_id long, key long, n long, least array<long>")


def _repeated(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur more than once in all parts, and how often; parts is emptied, and sorted is in place: a task has many."""
    values = np.concatenate([np.empty(0, np.int64), *parts])
    parts.clear()
    values.sort()
    edges = np.diff((values[1:] == values[:-1]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    return values[start], end - start + 1


def _least_hashes(x: np.ndarray) -> list[int]:
    """Least hashes of a set under several orders."""
    with np.errstate(over="ignore"):
        return [int(x[0]), int(x[-1]), *(int((x * np.int64(f)).min()) for f in FACTORS)]


def _leading(docs: DataFrame, heavy, percent: int) -> DataFrame:
    """(token, set, n, at, salt, k): the leading tokens of every set and their places in the common order.

    In each batch a token's first row has salt 0; the k - 1 others already know that the token is shared.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = heavy.value
        often = np.zeros(1 << 22, bool)  # a first look at the tokens' leading bits
        often[hot >> 42] = True
        for b in batches:
            seen, parts = set(), []
            for x in _sets(b):
                n = len(x)
                if not n or (i := set_id(x)) in seen:
                    continue
                seen.add(i)
                length = n - need(n, percent) + 1
                if len(hot):
                    some = np.flatnonzero(often[x >> 42])
                    at = np.minimum(np.searchsorted(hot, x[some]), len(hot) - 1)
                    is_hot = hot[at] == x[some]
                    late = some[is_hot][np.argsort(rank[at[is_hot]], kind="stable")]
                    x = np.concatenate((np.delete(x, late), x[late]))
                parts.append((x[:length], i, n))
            if not parts:
                continue
            lengths = [len(p[0]) for p in parts]
            token = np.concatenate([p[0] for p in parts])
            sets = np.repeat(np.array([p[1] for p in parts], np.int64), lengths)
            n = np.repeat(np.array([p[2] for p in parts], np.int32), lengths)
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
            order = np.argsort(token, kind="stable")
            token, sets, n, at = token[order], sets[order], n[order], at[order]
            lead = np.r_[True, token[1:] != token[:-1]]
            k = np.diff(np.r_[np.flatnonzero(lead), len(token)]).astype(np.int32)
            k = k[np.cumsum(lead) - 1]
            for j in range(0, len(token), 100_000):
                to = slice(j, j + 100_000)
                salt = np.where(lead[to], 0, sets[to] % 1021 + 1).astype(np.int32)
                yield pa.record_batch({"token": token[to], "set": sets[to], "n": n[to], "at": at[to], "salt": salt, "k": k[to]})

    return docs.mapInArrow(trimmed(work), "token long, set long, n int, at int, salt int, k int")


def _shared(rows: DataFrame, grouped) -> DataFrame:
    """(token, set, n, at, grouped): only the rows of tokens that two or more sets lead with, and whether the set may be in a group.

    Of each batch only one row of a token is dealt by the token alone, so a token brings a task at most a row a batch.
    """
    rows = rows.repartition(partitions(rows.sparkSession), "token", "salt").sortWithinPartitions("token")

    def shared(t: pa.Table) -> pa.Table:
        token, sets, k = (t.column(c).to_numpy() for c in (0, 1, 4))
        order = np.lexsort((-k, sets, token))
        token, sets, k = token[order], sets[order], k[order]
        new = np.r_[True, token[1:] != token[:-1]]
        fresh = new | np.r_[True, sets[1:] != sets[:-1]]
        starts = np.flatnonzero(new)
        several = np.minimum.reduceat(sets, starts) != np.maximum.reduceat(sets, starts)
        keep = fresh & ((k > 1) | np.repeat(several, np.diff(np.r_[starts, len(token)])))
        return t.take(pa.array(order[keep]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last token so far
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches(([*held.to_batches(), b]) if held is not None else [b])
            token = t.column(0).to_numpy()
            cut = int(np.searchsorted(token, token[-1]))
            held = t.slice(cut)
            if cut:
                yield from shared(t.slice(0, cut)).combine_chunks().to_batches()
        if held is not None:
            yield from shared(held).combine_chunks().to_batches()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in work(batches):
            yield pa.record_batch({**{c: t.column(c) for c in ("token", "set", "n", "at")}, "grouped": _has(grouped.value, t.column("set").to_numpy())})

    return rows.select("token", "set", "n", "at", "k").mapInArrow(trimmed(marked), "token long, set long, n int, at int, grouped boolean")


def _has(bits: np.ndarray, sets: np.ndarray) -> np.ndarray:
    at = sets.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bits(keys: DataFrame, column: str):
    """A filter of FILTER_BITS bits of a column of hashes: as large for any input, with more false hits for more keys."""
    bit = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    got = keys.select(bit.alias("b")).groupBy(F.shiftright("b", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(32767)).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in got.collect():  # at most 2 ** (FILTER_BITS - 15) rows of 4 KB
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def _token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, tokens) of the wanted set ids, made from the texts once more; the texts themselves are never shuffled."""
    bits = _bits(wanted, "set")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ids, tokens, size = [], [], 0
            for x in _sets(b):
                if len(x) and (i := set_id(x)) not in seen and _has(bits.value, np.array([i]))[0]:
                    seen.add(i)
                    ids.append(i)
                    tokens.append(x.tobytes())
                    size += x.nbytes
                    if size > 1 << 20:
                        yield pa.record_batch({"set": pa.array(ids, pa.int64()), "tokens": pa.array(tokens, pa.binary())})
                        ids, tokens, size = [], [], 0
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.record_batch({"set": pa.array(ids, pa.int64()), "tokens": pa.array(tokens, pa.binary())})

    return docs.mapInArrow(trimmed(work), "set long, tokens binary").dropDuplicates(["set"])


def _opened(docs: DataFrame, queries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect every query (q, h, parts) with the members (h, part, set) of the group h it is similar to.

    A part is the members' tokens in one sorted array; a query counts its hits there by member. Of the links among a query
    and a part's members only those are given that connect what others of this part do not yet connect.
    """
    rows = members.select("h", "part", F.lit(0).alias("kind"), "set")
    rows = rows.unionByName(queries.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), F.col("q").alias("set")))
    rows = materialize(rows, "opened")
    # A set goes once to where its rows are, and from there to the parts that ask for it.
    dealt = rows.join(_token_sets(docs, rows.select("set")), "set").select("h", "part", "kind", "set", "tokens")
    dealt = dealt.repartition(partitions(docs.sparkSession), "h", "part").sortWithinPartitions("h", "part", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, group = None, [], None
        for batch in batches:
            a, b = [], []
            tokens_of = batch.column(4)
            for k, now in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                h, part, kind, i = now
                if (h, part) != key:
                    key, held, group = (h, part), [], None
                x = np.frombuffer(tokens_of[k].as_buffer(), np.int64)
                if not kind:
                    held.append((i, x.copy()))
                    continue
                if not held:
                    continue
                if group is None:
                    sizes = np.array([len(m) for _, m in held])
                    tokens = np.concatenate([m for _, m in held])
                    held = [i for i, _ in held]
                    order = np.argsort(tokens, kind="stable")
                    group = tokens[order], np.repeat(np.arange(len(held), dtype=np.int32), sizes)[order], sizes
                    root = np.arange(len(held))
                tokens, owner, sizes = group
                low, high = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
                n = high - low
                if np.count_nonzero(n) < need(len(x), percent):
                    continue
                # A member has a token once, so there are no more hits than tokens in the part.
                at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(held))
                near = np.flatnonzero(100 * common >= percent * (len(x) + sizes - common))
                if not len(near):
                    continue
                apart, first = np.unique(root[near], return_index=True)
                if len(apart) > 1:
                    root[np.isin(root, apart)] = apart[0]
                for j in first:
                    if held[near[j]] != i:
                        a.append(i)
                        b.append(held[near[j]])
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = materialize(dealt.mapInArrow(trimmed(work), "a long, b long"), "links")
    discard(rows)
    return links


def _groups(profile: DataFrame, percent: int) -> DataFrame:
    """(set, g): sets that share AGREE least hashes or more with the first set of their size class that has these, named after it.

    Groups only decide what is compared early and what through the matrix. A set outside all groups has no row.
    """
    sets = profile.where("kind = 0 AND key IS NOT NULL").groupBy(F.col("key").alias("set")).agg(F.first("n").alias("n"), F.first("least").alias("least"))
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    keyed = materialize(sets.select("set", size.alias("size"), F.posexplode("least").alias("r", "least")), "keys")
    first = keyed.groupBy("r", "least", "size").agg(F.min(F.struct(F.xxhash64("set"), "set")).alias("x"), F.min("set").alias("low"), F.max("set").alias("high"))
    first = materialize(first.where("low < high").select("r", "least", "size", F.col("x.set").alias("g")), "firsts")
    shared = keyed.join(first, ["r", "least", "size"]).groupBy("set", "g").agg(F.count("*").alias("c")).where(F.col("c") >= AGREE)
    chosen = materialize(shared.groupBy("set").agg(F.max(F.struct("c", F.xxhash64("g"), "g")).alias("x")).select("set", F.col("x.g").alias("g")), "chosen")
    # A set that names a group and is in none itself is in its own.
    names = chosen.select(F.col("g").alias("set")).distinct().join(chosen, "set", "left_anti").select("set", F.col("set").alias("g"))
    made = materialize(chosen.unionByName(names), "grouped")
    for t in (keyed, first, chosen):
        discard(t)
    return made


def _needed(s_low, s_high, l_high, percent: int):
    """What a summed overlap must exceed, times 100 * (100 + percent), for a smaller set of the first range and a larger one of up to l_high tokens.

    A link needs percent * (s + l) / (100 + percent) common tokens, of which fewer than percent * l / 100 are no
    leading ones. That falls with l, which is at most s_high * 100 / percent, and rises with s, which is at least
    percent * l / 100. Null where no smaller set of the range is small enough.
    """
    high = F.least(l_high.cast("double"), s_high * (100.0 / percent))
    low = F.greatest(s_low.cast("double"), high * (percent / 100.0))
    return F.when(s_low <= high, 100.0 * percent * (F.least(low, high) + high) - percent * (100.0 + percent) * high - 1.0)


def _qualifying(matrix: DataFrame, percent: int) -> DataFrame:
    """(g, h), g < h: the pairs of groups whose summed overlap allows a link, of rows (token, g, low, high, most) of the matrix.

    most is the largest partner that a member can be similar to if the token is the first one that they share.
    """
    k = matrix.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    matrix = materialize(matrix.join(k, "token"), "matrix_shared")
    other = matrix.select("token", F.col("g").alias("h"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("most").alias("most2"))
    sizes = (F.col("high") * 100 >= F.col("low2") * percent) & (F.col("high2") * 100 >= F.col("low") * percent)
    few = matrix.where(F.col("k") <= CROWD).join(other, "token").where((F.col("g") < F.col("h")) & sizes)
    few = few.select("g", "h", "low", "high", "low2", "high2", F.lit(1).alias("c"))
    crowd = matrix.where(F.col("k") > CROWD)
    crowded = crowd.limit(1).count() > 0
    if crowded:
        crowd = materialize(crowd, "crowded")
        # The smaller set's size has to be in a class that both the smaller and the larger one's group allow.
        class_of = lambda v: F.floor(F.log(F.greatest(v.cast("double"), F.lit(1.0))) / float(np.log(RATIO))).cast("int")
        by_class = lambda rows, low, high: rows.where(low <= high).withColumn("size", F.explode(F.sequence(class_of(low), class_of(high))))
        small = by_class(crowd, F.col("low"), F.least("high", "most"))
        large = by_class(crowd, F.ceil(F.col("low") * percent / F.lit(100)), F.least("high", "most"))
        large = large.select("token", "size", F.col("g").alias("h"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("most").alias("most2"))
        fits = (F.col("low2") <= F.col("most")) & (F.col("low") <= F.col("most2")) & (F.col("low") <= F.col("high2")) & sizes & (F.col("g") != F.col("h"))
        many = small.join(large, ["token", "size"]).where(fits).groupBy("g", "h").agg(*[getattr(F, f)(c).alias(c) for f, c in (("min", "low"), ("max", "high"), ("min", "low2"), ("max", "high2"))])
        turn = F.col("g") > F.col("h")
        swap = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
        many = many.select(swap("g", "h").alias("g"), swap("h", "g").alias("h"), swap("low", "low2").alias("low"), swap("high", "high2").alias("high"), swap("low2", "low").alias("low2"), swap("high2", "high").alias("high2"), F.lit(0).alias("c"))
        few = few.unionByName(many)
    pairs = few.groupBy("g", "h").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("low2").alias("low2"), F.max("high2").alias("high2"))
    if crowded:
        more = materialize(crowd.groupBy("g").agg(F.count("*").alias("more")), "crowds")
        pairs = pairs.join(more, "g", "left").join(more.select(F.col("g").alias("h"), F.col("more").alias("more2")), "h", "left")
        extra = F.least(F.coalesce("more", F.lit(0)), F.coalesce("more2", F.lit(0)))
    else:
        extra = F.lit(0)
    bound = F.least(_needed(F.col("low"), F.col("high"), F.col("high2"), percent), _needed(F.col("low2"), F.col("high2"), F.col("high"), percent))
    return pairs.where((F.col("c") + extra) * (100.0 * (100 + percent)) > bound).select("g", "h", "high", "high2")


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_id, component_id, component.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of five-word shingles;
    component_id is the smallest doc_id that links reach. A null, empty or wordless text has no shingles, is linked
    with nothing and has its own doc_id as component_id. Repeated rows and equal texts share a component. Null ids
    link like others; a component of null ids only has a null component_id. component is a number of the component,
    null without shingles: where ids are repeated, several components may have one component_id. Shingles and sets are compared by 64-bit
    hashes. Every link that can change a component is tested with whole sets; no bucket is capped.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = materialize(_profile(docs), "profile")
    often = profile.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(HEAVY).toArrow()
    hot, rank = (often.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    order = np.argsort(hot)
    heavy = spark.sparkContext.broadcast((hot[order], rank[order]))

    groups = _groups(profile, percent)

    # The matrix: for each group the leading tokens of its members, with the members' sizes and possible partners.
    rows = materialize(_shared(_leading(docs, heavy, percent), _bits(groups, "set")), "leading")
    most = F.floor((100 + percent) * (F.col("n") - F.col("at")) / F.lit(percent)).cast("int") - F.col("n")
    sized = rows.select("token", "set", "n", most.alias("most"), "grouped")
    alone = sized.where("NOT grouped").select("token", F.col("set").alias("g"), F.col("n").alias("low"), F.col("n").alias("high"), "most")
    held = sized.where("grouped").join(groups, "set", "left").withColumn("g", F.coalesce("g", "set"))
    held = held.groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("most").alias("most"))
    pairs = materialize(_qualifying(alone.unionByName(held), percent), "qualifying")
    discard(rows)

    # The smaller group of a pair asks, member by member; the larger one is opened in parts. Groups ask themselves, too.
    sizes = profile.where("kind = 0 AND key IS NOT NULL").groupBy(F.col("key").alias("set")).agg(F.first("n").alias("n"))
    count = groups.join(sizes, "set").groupBy("g").agg(F.count("*").alias("many"), F.sum("n").alias("tokens"))
    count = materialize(count, "counts")
    sided = pairs.select("g", "h").join(count.select("g", F.col("many").alias("m1")), "g", "left").join(count.select(F.col("g").alias("h"), F.col("many").alias("m2")), "h", "left")
    turn = F.coalesce("m1", F.lit(1)) > F.coalesce("m2", F.lit(1))
    asked = sided.select(F.when(turn, F.col("h")).otherwise(F.col("g")).alias("g"), F.when(turn, F.col("g")).otherwise(F.col("h")).alias("h"))
    asked = materialize(asked.unionByName(count.where("many > 1").select("g", F.col("g").alias("h"))), "asked")
    parts = F.greatest(F.ceil(F.col("many") / PART), F.ceil(F.col("tokens") / PART_TOKENS), F.lit(1)).cast("int")
    opened = asked.select("h").distinct().join(count.select(F.col("g").alias("h"), parts.alias("parts")), "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    opened = materialize(opened, "parts")
    of = lambda ids, c: ids.join(groups.withColumnRenamed("g", "of"), F.col(c) == F.col("of"), "left").withColumn("set", F.coalesce("set", c))
    members = of(opened, "h").select("h", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int").alias("part"), "set")
    queries = of(asked.join(opened, "h"), "g").select(F.col("set").alias("q"), "h", "parts")
    groups = connected_components(_opened(docs, queries, members, percent))

    owned = profile.where("kind = 0 AND key IS NOT NULL").groupBy(F.col("key").alias("set")).agg(F.min("doc_id").alias("first"))
    owned = owned.join(groups.withColumnRenamed("node", "set"), "set", "left").select("set", F.coalesce("component", "set").alias("g"), "first")
    owned = materialize(owned, "owned")
    named = owned.join(owned.groupBy("g").agg(F.min("first").alias("component_id")), "g").select(F.col("set").alias("key"), "component_id", F.col("g").alias("component"))
    out = profile.where("kind = 0").join(materialize(named, "named"), "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("set_id"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def with_set_id(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with set_id as similar_components() gives it: null for a text without shingles."""

    @F.arrow_udf("long")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([set_id(x) if len(x) else None for x in map(shingle_hashes, texts.to_pylist())], pa.int64())

    read = read.asNondeterministic()  # filters on set_id stay above it, so a text is read once
    return docs.withColumn("set_id", read(F.col(text_col)))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
