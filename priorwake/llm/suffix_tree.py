"""Language-model scoring with probabilistic suffix trees, one over bytes and one over words.

The text of the model is its words, A-Z lowered, each followed by a space, then an end symbol: one of two bytes that
UTF-8 never has. Contexts of 1 to DEPTH bytes stay in the byte tree if they are frequent enough and their next-byte
distribution diverges from that of the context one byte shorter; so the tree is bounded by the frequency floor, not by
the corpus. Distributions are smoothed towards the shorter context's. The longest retained suffix of what was read
is the state; closed under suffixes and prefixes the states form an automaton that scores one table lookup a byte.

The word tree does the same with contexts of one and two frequent words over all words. A token's probability is MIX
times the word tree's plus 1 - MIX times the byte tree's: both sum to one, so the mixture does, and words that the
training rows lack are spelled by the byte tree.

Both trees are bounded by shares, so that every task can hold them. What grows with the corpus is the tree of rare words:
the word tree gives them a common probability, which is shared out among them after the two words before, whatever these
are. Such a context is retained from two occurrences of one continuation on, if it diverges; its counts never leave the cluster.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_words, materialize, mix64, require

DEPTH = 6
#: Least share of all positions that a retained context has, least divergence (nats) from its parent, and prior weight of the parent.
FLOOR, DIVERGENCE, PRIOR = 1e-5, 0.005, 10.0
START, END = 0xFE, 0xFF
#: Words whose counts every scoring task holds; all others are joined, so this changes the speed only.
HEAD = 1 << 17
#: Rare words are those with a count below 2 + RARE * all training tokens, so at most 1 / RARE words are not; DISCOUNT is taken off their counts after a context.
RARE, DISCOUNT = 5e-7, 0.5
SEGMENT, LANES = 512, 4096
#: Weight of the word tree; the words that its contexts consist of, singly and in pairs; its floors for contexts and continuations.
MIX = 0.6
FREQUENT, PAIRED = 2048, 256
CONTEXT_FLOOR, NEXT_FLOOR = 5e-5, 2e-6


def symbols(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b" ".join([*words, b"\xff"]), np.uint8)


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


class _Sums:
    """Counts by int64 key that are given away when they are many."""

    def __init__(self, most: int = 3_000_000):
        self.parts, self.size, self.most = [], 0, most

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > self.most:
            keys, n = self.take()
            if len(keys) > self.most // 2:
                yield keys, n
            else:
                self.parts, self.size = [(keys, n)], len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[at], np.add.reduceat(n, at)


def _chunks(column: pa.Array, most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about `most` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in column:
        t = t.as_py()
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _gather(texts: DataFrame) -> DataFrame:
    """(kind, key, n) partial counts: kind 0 words by hash, kind 1 windows of DEPTH + 1 bytes. A task gives a key a few times at most, so they need no partial aggregate."""

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for j in range(0, len(keys), 200_000):
            part = keys[j : j + 200_000]
            yield pa.record_batch({"kind": np.full(len(part), kind, np.int32), "key": part, "n": n[j : j + 200_000].astype(np.int64)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = _Sums(), _Sums()
        for b in batches:
            for texts in _chunks(b.column(0)):
                codes, lists = [], [lower_words(t) for t in texts]
                for full in words.add(word_hashes(chain.from_iterable(lists))):
                    yield from rows(0, *full)
                for w in lists:
                    s = np.r_[np.full(DEPTH, START, np.uint8), symbols(w)].astype(np.int64)
                    code = s[: len(s) - DEPTH].copy()
                    for k in range(1, DEPTH + 1):
                        code <<= 8
                        code |= s[k : k + len(code)]
                    codes.append(code)
                for full in windows.add(np.concatenate(codes)):
                    yield from rows(1, *full)
        yield from rows(0, *words.take())
        yield from rows(1, *windows.take())

    return texts.mapInArrow(work, "kind int, key long, n long")


class Tree:
    """The automaton: class of each byte, next state and log10 probability by state and class."""

    def __init__(self, levels: list[list[tuple[int, np.ndarray, np.ndarray]]], floor: float = FLOOR, divergence: float = DIVERGENCE, prior: float = PRIOR):
        """levels[d]: for contexts of d bytes (as integers, latest byte lowest) the next bytes and their counts."""
        root = dict(zip(*(x.tolist() for x in levels[0][0][1:]), strict=True)) if levels and levels[0] else {}
        total = max(1, sum(root.values()))
        used = sorted((b for b in root if root[b] >= floor * total or b == END), key=lambda b: b)
        self.classes = len(used) + 2  # the last but one: all other bytes; the last: padding
        other = self.classes - 2
        self.of = np.full(256, other, np.int64)
        self.of[used] = np.arange(len(used))
        spread = np.zeros(self.classes)
        spread[other] = -np.log10(max(1, 256 - len(used)))

        def counts(b: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.bincount(self.of[b], weights=n, minlength=self.classes - 1)[: self.classes - 1]

        base = counts(*levels[0][0][1:]) + 0.5 if root else np.ones(self.classes - 1)
        dist: dict[tuple[int, int], np.ndarray] = {(0, 0): base / base.sum()}

        def parent(d: int, s: int) -> np.ndarray:
            while True:
                d -= 1
                s &= (1 << 8 * d) - 1
                if (d, s) in dist:
                    return dist[d, s]

        for d in range(1, len(levels)):
            for s, b, n in levels[d]:
                c = counts(b, n)
                if c.sum() < floor * total:
                    continue
                up = parent(d, s)
                p = (c + prior * up) / (c.sum() + prior)
                if (p * np.log(p / up)).sum() >= divergence:
                    dist[d, s] = p
        # Closed under suffixes and prefixes, the longest retained suffix follows from the last one and a byte.
        states = set(dist)
        todo = list(states)
        while todo:
            d, s = todo.pop()
            for short in ((d - 1, s & ((1 << 8 * (d - 1)) - 1)), (d - 1, s >> 8)) if d else ():
                if short not in states:
                    states.add(short)
                    todo.append(short)
        order = sorted(states)
        at = {x: i for i, x in enumerate(order)}
        self.next = np.zeros((len(order), self.classes), np.int32)
        self.log = np.zeros((len(order), self.classes), np.float32)
        for i, (d, s) in enumerate(order):
            p = dist.get((d, s))
            if p is None:
                p = parent(d, s)
            self.log[i, :-1] = np.log10(p) + spread[:-1]
            if d:
                self.next[i] = self.next[at[d - 1, s & ((1 << 8 * (d - 1)) - 1)]]
            self.next[i, -1] = 0
            for k, b in enumerate(used):
                j = at.get((d + 1, s << 8 | b))
                if j is not None:
                    self.next[i, k] = j
                elif not d:
                    self.next[i, k] = 0
        self.states, self.depth = len(order), max((d for d, _ in order), default=0)
        self.first = at.get((1, START), 0)

    def byte_logs(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of each byte of texts that lie one after another and end at `ends`.

        Texts are cut into segments that are read in step, each after the bytes that set its state.
        """
        out, begins = np.zeros(len(flat)), np.r_[0, ends[:-1]]
        each = -(-(ends - begins) // SEGMENT)
        text = np.repeat(np.arange(len(ends)), each)
        first = begins[text]
        start = first + (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * SEGMENT
        stop = np.minimum(start + SEGMENT, ends[text])
        order = np.argsort(start - stop, kind="stable")
        classes = self.of[flat]
        flat_next, flat_log, warm, pad = self.next.ravel(), self.log.ravel(), self.depth, self.classes - 1
        for k in range(0, len(order), LANES):
            lane = order[k : k + LANES]
            a, b, c = first[lane], start[lane], stop[lane]
            state = np.zeros(len(lane), np.int64)
            for step in range(-warm, 0):
                at = b + step
                place = np.where(at >= a, classes[np.maximum(at, 0)], pad) + state * self.classes
                state = flat_next[place].astype(np.int64)
            shortest_first = (c - b)[::-1]
            for step in range(int(shortest_first[-1])):
                live = len(lane) - int(np.searchsorted(shortest_first, step, side="right"))
                at = b[:live] + step
                place = classes[at] + state[:live] * self.classes
                out[at] = flat_log[place]
                state = flat_next[place].astype(np.int64)
        return out


class WordTree:
    """P(word | longest retained context of up to two words) over all words.

    A retained context has its own discounted probabilities for its frequent continuations; all others share what is
    left in proportion to the shorter context's probabilities.
    """

    def __init__(self, head: np.ndarray, pairs: np.ndarray, triples: np.ndarray, whole: float):
        """head: counts of head words, most frequent first, the end token among them; whole: those of all words. pairs:
        rows (context, next, count) of word numbers; triples: the same with the context as earlier * FREQUENT + later."""
        self.root = head / max(1.0, whole)
        self.levels = []
        for rows in (pairs, triples):
            contexts, codes, logs, factors = [], [], [], []
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))] if len(rows) else rows
            cuts = np.r_[0, np.flatnonzero(np.diff(rows[:, 0])) + 1, len(rows)] if len(rows) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = rows[a:b]
                total = own[own[:, 1] < 0, 2].sum()
                own = own[own[:, 1] >= 0]
                if total < CONTEXT_FLOOR * whole or not len(own):
                    continue
                context = int(rows[a, 0])
                up = self.prob(np.full(len(own), context % FREQUENT if self.levels else -1), np.full(len(own), -1), own[:, 1])
                p = (own[:, 2] - 0.5) / total
                left, free = 1 - p.sum(), 1 - up.sum()
                if left <= 0 or free <= 0:
                    continue
                gain = (p * np.log(p / up)).sum() + left * np.log(left / free)
                if gain >= DIVERGENCE:
                    codes.append(context << 20 | own[:, 1])
                    logs.append(p)
                    contexts.append(context)
                    factors.append(left / free)
            join = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.empty(0, t)
            self.levels.append((np.array(contexts, np.int64), np.array(factors), join(codes, np.int64), join(logs, float)))

    def prob(self, last: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of head words after contexts of word numbers; -1 stands for words that are no contexts.

        For a word -1, outside the head, it is the factor of the word's share of all words.
        """
        p = np.where(word >= 0, self.root[np.maximum(word, 0)], 1.0)
        for depth, (contexts, factors, codes, probs) in enumerate(self.levels):
            if not len(contexts):
                continue
            context = np.where(last >= 0, last, -1) if not depth else np.where((last >= 0) & (before >= 0), before * FREQUENT + last, -1)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            here = np.flatnonzero(contexts[at] == context)
            code = context[here] << 20 | word[here]
            to = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            p[here] = np.where(codes[to] == code, probs[to], factors[at[here]] * p[here])
        return p


def _continuations(texts: DataFrame, frequent, end: int) -> DataFrame:
    """(depth, context, word, n): how often head words (word -1: anything) follow contexts of frequent words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = frequent.value, {1: _Sums(), 2: _Sums()}
        rank = np.argsort(keys)
        keys = keys[rank]

        def rows(depth: int, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"depth": np.full(len(code), depth, np.int32), "code": code, "n": n.astype(np.int64)})

        for batch in batches:
            for texts in _chunks(batch.column(0)):
                lists = [lower_words(t) for t in texts]
                sizes = np.array([len(w) for w in lists])
                starts = np.cumsum(sizes + 3) - sizes - 3
                h = word_hashes(chain.from_iterable(lists))
                # Two empty places before the words of a text, the end after them.
                ids = np.full(len(h) + 3 * len(lists), -1)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    ids[np.arange(len(h)) + np.repeat(3 * np.arange(len(lists)) + 2, sizes)] = np.where(keys[at] == h, rank[at], -1)
                ids[starts + sizes + 2] = end
                real = np.ones(len(ids), bool)
                real[np.r_[starts, starts + 1]] = False
                at = np.flatnonzero(real)
                last, before, word = ids[at - 1], ids[at - 2], ids[at]
                word = np.where((word >= 0) & (word < FREQUENT), word, 1 << 12)
                for depth, most in ((1, FREQUENT), (2, PAIRED)):
                    ok = (last >= 0) & (last < most) & ((before >= 0) & (before < most) if depth == 2 else True)
                    context = (last + before * FREQUENT if depth == 2 else last)[ok]
                    for full in sums[depth].add(context << 13 | word[ok]):
                        yield rows(depth, *full)
        for depth in (1, 2):
            yield rows(depth, *sums[depth].take())

    return texts.mapInArrow(work, "depth int, code long, n long")


def grow_words(texts: DataFrame, frequent: np.ndarray, head: np.ndarray, end: int, total: float) -> WordTree:
    """The word tree: contexts and continuations below the floors stay on the cluster, so at most 1 / NEXT_FLOOR rows a depth come to the driver."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)
    counted = materialize(_continuations(texts, held, end).repartition("depth", "code").groupBy("depth", "code").agg(F.sum("n").alias("n")), "continuations")
    context, word = F.shiftright("code", 13), F.col("code").bitwiseAND(F.lit((1 << 13) - 1))
    rows = counted.select("depth", context.alias("context"), word.alias("word"), "n")
    whole = rows.groupBy("depth", "context").agg(F.sum("n").alias("n")).select("depth", "context", F.lit(-1).alias("word"), "n")
    some = rows.where((F.col("word") < FREQUENT) & (F.col("n") >= max(2.0, NEXT_FLOOR * total))).unionByName(whole.where(F.col("n") >= CONTEXT_FLOOR * total))
    t = some.toArrow()
    discard(counted)
    got = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("depth", "context", "word", "n")], 1)
    return WordTree(head, *[got[got[:, 0] == d, 1:] for d in (1, 2)], total)


def grow(windows: DataFrame, floor: float = FLOOR) -> Tree:
    """The tree of windows (key, n): only contexts of at least the floor's share come to the driver, at most 1 / floor for each length."""
    total = windows.agg(F.sum("n")).first()[0] or 0
    levels = []
    # The counts of shorter windows come from those of one byte more.
    for d in range(DEPTH, -1, -1):
        if d < DEPTH:
            key = F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1))
            longer, windows = windows, materialize(windows.groupBy(key.alias("key")).agg(F.sum("n").alias("n")), "windows")
            if d < DEPTH - 1:
                discard(longer)
        rows = windows.groupBy(F.shiftrightunsigned("key", 8).alias("s")).agg(
            F.sum("n").alias("all"), F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(255)).alias("b"), "n")).alias("next")
        )
        # A list holds at most 256 bytes' counts.
        t = rows.where(F.col("all") >= floor * total).select("s", F.col("next.b").alias("b"), F.col("next.n").alias("n")).toArrow().sort_by("s").combine_chunks()
        if not t.num_rows:
            levels.append([])
            continue
        ends = t.column("b").combine_chunks().offsets.to_numpy()
        b, n = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("b", "n"))
        levels.append([(s, b[i:j], n[i:j]) for s, i, j in zip(t.column("s").to_pylist(), ends[:-1], ends[1:], strict=True)])
    discard(windows)
    return Tree(levels[::-1], floor)


def _rare_gains(tail: DataFrame, limit: float, rare: float, mixed) -> DataFrame:
    """(rid, gain): what the retained contexts of rare words add to the scores of tail's rows (rid, held_out, ctx, key, spelled, factor, c).

    A context's continuations that occur twice or more have their own discounted probabilities, the other rare words share
    what is left in proportion to their counts. Only rows whose context is retained pass the first join, a sort-merge join
    whose skewed side adaptive execution splits; counts are partial aggregates. rare: occurrences of all rare words.
    """
    tail = tail.where(F.col("ctx").isNotNull() & (F.col("c") > 0) & (F.col("c") < limit))
    pairs = materialize(tail.where("NOT held_out").groupBy("ctx", "key").agg(F.count("*").alias("m"), F.max("c").alias("c")), "rare")
    own, part = F.col("m") >= 2, F.col("m") - DISCOUNT
    sums = pairs.groupBy("ctx").agg(
        F.sum("m").alias("all"),
        F.sum(F.when(own, part)).alias("own"),
        F.sum(F.when(own, F.col("c"))).alias("up"),
        F.sum(F.when(own, part * F.log(part * rare / F.col("c")))).alias("spread"),
    )
    left, free = 1 - F.col("own") / F.col("all"), 1 - F.col("up") / F.lit(rare)
    sums = sums.where(F.col("own").isNotNull() & (F.col("up") < rare))
    divergence = (F.col("spread") - F.col("own") * F.log("all")) / F.col("all") + left * F.log(left / free)
    contexts = sums.where(divergence >= DIVERGENCE).select("ctx", "all", (left / free).alias("rest"))
    rows = tail.select("rid", "ctx", "key", "spelled", "factor", "c").join(contexts, "ctx").join(pairs.where(own).select("ctx", "key", "m"), ["ctx", "key"], "left")
    new = F.when(F.col("m").isNotNull(), rare * part / F.col("all")).otherwise(F.col("rest") * F.col("c"))
    return rows.select("rid", (mixed(new) - mixed(F.col("c"))).alias("gain"))


def score_texts(docs: DataFrame, training, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    training: a boolean column; rows where it is not true are held out. base_score is the add-half unigram score of
    the words and an end token; score is the suffix tree's log10 probability. Counts come from all training rows.
    Words and contexts of rare words are compared by 64-bit hashes; the HEAD most frequent words that aren't rare are
    looked up in place, all others by a join, so every count is exact and no score depends on HEAD. Other columns are ignored. A null text is empty and has the end token only. Equal rows stay rows of their own; null ids
    are kept. With no training rows all counts are 0 and the distributions uniform. An empty table gives no rows.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(~training, F.lit(True)).alias("held_out"))
    gathered = materialize(_gather(rows.where("NOT held_out").select("text")).repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = gathered.where("kind = 0").select("key", "n")
    windows = gathered.where("kind = 1").select("key", "n")
    tree = grow(windows)
    n_docs = windows.where(F.col("key").bitwiseAND(F.lit(255)) == END).agg(F.sum("n")).first()[0] or 0
    seen = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = (seen["n"] or 0) + n_docs, seen["v"] + bool(n_docs)
    whole = n + 0.5 * (v + 1)
    limit = 2 + RARE * n
    rare = float(words.where(F.col("n") < limit).agg(F.sum("n")).first()[0] or 0)
    head = words.where(F.col("n") >= limit).orderBy(F.desc("n"), "key").limit(HEAD).toArrow()
    keys, counts = head.column("key").to_numpy().astype(np.int64), head.column("n").to_numpy().astype(np.float64)
    # The end token takes the last frequent number, or the one after all words where there are fewer.
    end_number = min(FREQUENT - 1, len(keys))
    word_tree = grow_words(rows.where("NOT held_out").select("text"), keys[:end_number], np.insert(counts, end_number, n_docs), end_number, float(n))
    order = np.argsort(keys)
    held = spark.sparkContext.broadcast((tree, word_tree, keys[order], counts[order], order))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, word_tree, keys, counts, rank = held.value
        logs = np.log10((counts + 0.5) / whole)
        end = np.log10((n_docs + 0.5) / whole)
        for full in batches:
            for j in range(0, full.num_rows, 1024):
                b = full.slice(j, 1024)
                lists = [lower_words(t) for t in b.column(1).to_pylist()]
                if not lists:
                    continue
                tokens = np.array([len(w) + 1 for w in lists])
                ends = np.cumsum(tokens)
                last = np.zeros(ends[-1], bool)
                last[ends - 1] = True
                h = np.zeros(ends[-1], np.int64)
                h[~last] = word_hashes(chain.from_iterable(lists))
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = (keys[at] == h) & ~last if len(keys) else np.zeros(len(h), bool)
                doc = np.repeat(np.arange(len(lists)), tokens)
                # Base: head words and the end token here, the rest by the join.
                part = np.where(last, end, 0.0)
                part[hit] = logs[at[hit]]
                base = np.add.reduceat(part, np.r_[0, ends[:-1]])
                in_head = np.add.reduceat((hit | (last & (n_docs > 0))).astype(np.int64), np.r_[0, ends[:-1]])
                # Model.
                flat = np.frombuffer(b"".join(b" ".join([*w, b"\xff"]) for w in lists), np.uint8)
                stops = np.flatnonzero((flat == 0x20) | (flat == END)) + 1
                spelled = np.add.reduceat(tree.byte_logs(flat, stops[ends - 1]), np.r_[0, stops[:-1]])
                number = np.full(len(h), -1)
                number[hit] = rank[at[hit]]
                number = np.where(number >= end_number, number + 1, number)
                number[last] = end_number
                frequent = np.where((number >= 0) & (number < FREQUENT) & ~last, number, -1)
                one = np.r_[-1, frequent[:-1]]
                two = np.r_[-1, -1, frequent[:-2]][: len(h)]
                begin = np.r_[0, ends[:-1]]
                one[begin] = -1
                two[begin] = -1
                two[np.minimum(begin + 1, len(h) - 1)[tokens > 1]] = -1
                two = np.where((one < PAIRED) & (two < PAIRED), two, -1)
                by_word = word_tree.prob(one, two, number)
                rest = ~hit & ~last
                place = np.flatnonzero(rest)
                no_context = place - begin[doc[place]] < 2
                pair = h.view(np.uint64)[np.stack([place - 2, place - 1])]
                context = mix64(pair[0] * np.uint64(0x9E3779B97F4A7C15) + mix64(pair[1])).view(np.int64)
                total = (1 - MIX) * 10.0**spelled + np.where(rest, 0.0, MIX * by_word)
                # What underflows is spelled by a byte tree alone; words outside the head are scored by the join.
                logs_of = np.where(total > 0, np.log10(np.maximum(total, 1e-300)), spelled + np.log10(1 - MIX))
                score = np.add.reduceat(np.where(rest, 0.0, logs_of), begin)
                cuts = np.r_[0, np.cumsum(np.add.reduceat(rest.astype(np.int64), begin))].astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": b.column(0),
                        "held_out": b.column(2),
                        "n_tokens": tokens.astype(np.int64),
                        "known": in_head,
                        "base": base,
                        "score": score,
                        "rest": pa.ListArray.from_arrays(
                            cuts,
                            pa.StructArray.from_arrays([pa.array(context, mask=no_context), *(pa.array(x[rest]) for x in (h, spelled, by_word))], ["ctx", "key", "spelled", "factor"]),
                        ),
                    }
                )

    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rest array<struct<ctx:long,key:long,spelled:double,factor:double>>")
    # The row number is stored, so it names the same row however often a task runs.
    made = materialize(made.withColumn("rid", F.monotonically_increasing_id()), "scored")
    tail = made.select("rid", "held_out", F.inline("rest")).join(words.withColumnRenamed("n", "c"), "key", "left")
    tail = materialize(tail.select("rid", "held_out", "ctx", "key", "spelled", "factor", F.coalesce("c", F.lit(0)).alias("c")), "tail")

    def mixed(count):
        """log10 of a token's probability if the word tree gives it a share of count tokens of all."""
        p = (1 - MIX) * F.pow(F.lit(10.0), F.col("spelled")) + MIX * F.col("factor") * count / F.lit(float(max(1, n)))
        return F.when(p > 0, F.log10(F.greatest(p, F.lit(1e-300)))).otherwise(F.col("spelled") + float(np.log10(1 - MIX)))

    c = F.col("c")
    plain = tail.select("rid", (c > 0).cast("long").alias("more"), F.log10((c + 0.5) / F.lit(whole)).alias("part"), mixed(c).alias("mixed"))
    if rare:
        gains = _rare_gains(tail, limit, rare, mixed)
        plain = plain.unionByName(gains.select("rid", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("part"), F.col("gain").alias("mixed")))
    tail = plain.groupBy("rid").agg(F.sum("more").alias("more"), F.sum("part").alias("part"), F.sum("mixed").alias("mixed"))
    out = made.drop("rest").join(tail, "rid", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("part", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"),
    )


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1)
