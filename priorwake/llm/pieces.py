"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary, and decoding.

The lattice of a text has an edge for every piece that spells a part of it, and byte edges for every character. Forward
Viterbi gives each node the best score from the start; a backward A* search from the end uses these scores as exact
heuristics, so complete paths leave its agenda in the order of their scores. Every entry of the agenda stands for other
paths and has the exact score of the best of them, so an agenda of N entries is enough, however long the text is.

No piece reaches over the start of a run of spaces or over a character that only occurs alone, so the lattice of a text
falls into segments at these places: a path of the text is one path of each segment, and its score their sum. Viterbi
with two scores a node, run over many segments at once, gives each segment's best path and how much its second-best
path loses. The N-best paths of the text differ from the best one in at most N - 1 segments, those that lose least; only
these are searched, and their paths are combined in the order of what they lose.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain
from math import inf, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEEP, materialize, require, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a text's own SPACE characters, which only bytes can spell; a noncharacter that texts don't have.
OWN_SPACE = "\U0010ffff"
#: Bytes of segments and their paths that a Python worker keeps, over its tasks; beyond them it starts anew.
KEPT = 48 << 20
#: Characters of texts that are read at once; longer texts are read in parts that end between segments.
RUN = 1 << 20
#: Longest segment that is read with others at once.
LONG = 48
#: What a byte, or in a unigram model a character, without a piece loses against the least likely piece.
BYTE_LOSS, CHARACTER_LOSS = 2.0, 10.0


def model_facts(model: bytes) -> dict[str, int | bytes]:
    """type (1: unigram, 2: BPE) and normalizer settings of a serialized model: fields of its protocol buffer."""

    def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = b[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(b):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            else:
                size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
                yield tag >> 3, b[at : at + size]
                at += size

    # Field numbers of ModelProto, TrainerSpec and NormalizerSpec, and their defaults.
    out: dict[str, int | bytes] = {"type": 1, "charsmap": b"", "prefix": 1, "squeeze": 1, "escape": 1}
    for field, value in fields(model):
        if field == 2:
            out |= {"type": v for k, v in fields(value) if k == 3}
        elif field == 3:
            names = {2: "charsmap", 3: "prefix", 4: "squeeze", 5: "escape"}
            out |= {names[k]: v for k, v in fields(value) if k in names}
    return out


@dataclass
class Vocabulary:
    """Piece scores. Merge-ordered vocabularies have ranks for scores: they become Zipf log probabilities.

    unknown is the score of a character that no piece spells, or of each of its bytes where by_byte is true.
    """

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    unknown: float
    pieces: list[str]
    prefix: bool = True
    by_byte: bool = True

    def __post_init__(self):
        self.longest = max(map(len, self.scores), default=1)
        inner = {c for p in self.scores if len(p) > 1 for c in p}
        across = any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.alone = "" if "\n" in inner else "\n"
        stop = re.escape(SPACE) + self.alone
        # Without such cuts (a piece with inner spaces) a text is one segment.
        self.cut = None if across else re.compile(f"{SPACE}+[^{stop}]*|[^{stop}]+" + (f"|{self.alone}" if self.alone else ""))
        self.key = hashlib.sha256(repr((self.pieces, sorted(self.scores.items()), self.unknown, self.prefix, self.by_byte)).encode("utf-8", "surrogatepass")).hexdigest()
        self.spelling = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in self.pieces]
        for b, i in enumerate(self.bytes_):
            self.spelling[i] = bytes([b])
        # Scores of pieces, and -inf for what only begins one.
        self.begun = {p[:k]: -inf for p in self.scores for k in range(1, len(p))} | self.scores

    @cached_property
    def table(self) -> _Table:
        return _Table(self)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """The vocabulary of a model file. ValueError for a model whose normalizer changes texts, since its pieces spell other texts."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        facts = model_facts(sp.serialized_model_proto())
        if facts["charsmap"] or facts["squeeze"] or not facts["escape"]:
            raise ValueError("only models whose normalizer leaves texts as they are can be decoded exactly")
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        bytes_ = sorted((i for i in range(len(pieces)) if sp.is_byte(i)), key=lambda i: int(pieces[i][3:5], 16))
        if len(bytes_) != 256:
            raise ValueError("only models with a piece for every byte can spell every text")
        scores = {pieces[i]: sp.get_score(i) for i in plain}
        by_byte = facts["type"] != 1
        if by_byte:
            norm = log(sum(1 / (r + 2.7) for r in range(len(plain))))
            scores = {p: -log(2.7 - s) - norm for p, s in scores.items()}
        unknown = min(scores.values()) - (BYTE_LOSS if by_byte else CHARACTER_LOSS)
        return cls({pieces[i]: i for i in plain}, scores, bytes_, unknown, pieces, bool(facts["prefix"]), by_byte)

    def raw(self, c: str) -> bytes:
        return (SPACE if c == OWN_SPACE else c).encode("utf-8", "surrogatepass")

    def spelled(self, c: str) -> tuple[float, tuple[int, ...]]:
        """Score and ids of a character in bytes."""
        raw = self.raw(c)
        return self.unknown * (len(raw) if self.by_byte else 1), tuple(self.bytes_[b] for b in raw)

    def edges(self, text: str, j: int) -> Iterator[tuple[int, float, int | tuple[int, ...]]]:
        """The edges (start, score, id or ids) of the lattice that end at j."""
        for i in range(max(0, j - self.longest), j):
            piece = text[i:j]
            s = self.scores.get(piece)
            if s is not None:
                yield i, s, self.ids[piece]
        if text[j - 1] not in self.scores:
            yield j - 1, *self.spelled(text[j - 1])

    def lattice(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the edges (start, score, ids) that end there."""
        return [[], *([(i, s, x if isinstance(x, tuple) else (x,)) for i, s, x in self.edges(text, j)] for j in range(1, len(text) + 1))]

    def best(self, text: str) -> tuple[float, tuple[int, ...], float]:
        """(score, ids, how much the second-best path loses) of a segment; of equal scores the edge that starts first."""
        n, begun = len(text), self.begun.get
        one, two, back = [0.0] + [-inf] * n, [-inf] * (n + 1), [0] * (n + 1)
        for i in range(n):
            a, b = one[i], two[i]
            for j in range(i + 1, n + 1):
                s = begun(text[i:j])
                if s is None:
                    break
                v = a + s
                if v > one[j]:
                    two[j] = max(one[j], b + s)
                    one[j], back[j] = v, i
                elif v > two[j]:
                    two[j] = v
            if text[i] not in self.scores:
                s = self.spelled(text[i])[0]
                j = i + 1
                v = a + s
                if v > one[j]:
                    two[j] = max(one[j], b + s)
                    one[j], back[j] = v, i
                elif v > two[j]:
                    two[j] = v
        ids, j = [], n
        while j:
            i = back[j]
            piece = self.ids.get(text[i:j])
            ids.append((piece,) if piece is not None else self.spelled(text[i:j])[1])
            j = i
        return one[n], tuple(chain.from_iterable(reversed(ids))), one[n] - two[n]

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of a segment, best first: backward A* with the forward scores as heuristics."""
        forward, begun = [0.0] + [-inf] * len(text), self.begun.get
        for i in range(len(text)):
            if text[i] not in self.scores:
                forward[i + 1] = max(forward[i + 1], forward[i] + self.spelled(text[i])[0])
            for j in range(i + 1, len(text) + 1):
                s = begun(text[i:j])
                if s is None:
                    break
                if forward[i] + s > forward[j]:
                    forward[j] = forward[i] + s
        # Entries (-score of the best path through here, order, place, score from here to the end, path), the best last.
        agenda, order, found = [(-forward[-1], 0, len(text), 0.0, None)], 0, []
        while agenda and len(found) < n:
            _, _, j, behind, path = agenda.pop()
            if not j:
                ids = []
                while path:
                    ids += path[0] if isinstance(path[0], tuple) else (path[0],)
                    path = path[1]
                found.append((behind, tuple(ids)))
                continue
            for i, s, ids in self.edges(text, j):
                order += 1
                agenda.append((-(forward[i] + s + behind), order, i, behind + s, (ids, path)))
            agenda.sort(reverse=True)  # places and paths are never compared: the orders differ
            del agenda[: -(n - len(found))]
        return found

    def parts(self, text: str) -> Iterator[list[str]]:
        """The segments of a text, in lists of about RUN characters."""
        if not text:
            return
        text = (SPACE if self.prefix else "") + text.replace(SPACE, OWN_SPACE).replace(" ", SPACE)
        at, first = 0, re.compile(f"(?<!{SPACE}){SPACE}")
        while at < len(text):
            # A run of spaces begins a segment.
            end = first.search(text, at + RUN) if self.cut and len(text) - at > RUN else None
            end = end.start() if end else len(text)
            yield self.cut.findall(text, at, end) if self.cut else [text]
            at = end

    def segments(self, text: str) -> list[str]:
        return list(chain.from_iterable(self.parts(text)))

    def decode(self, ids) -> str:
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if self.prefix and len(ids) else text


def _spread(flat: np.ndarray, lengths: np.ndarray, fill) -> np.ndarray:
    """Rows of the given lengths that lie one after another, as a matrix."""
    out = np.full((len(lengths), max(1, int(lengths.max(initial=0)))), fill, flat.dtype)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, .. start + length - 1 of each row, one row after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class _Table:
    """What begins a piece, by the hash of its characters, for many strings at once."""

    STEP, PLACE = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, v: Vocabulary):
        names = list(v.begun)
        self.score = np.array([v.begun[p] for p in names])
        self.id = np.array([v.ids.get(p, -1) for p in names], np.int32)
        keys = np.zeros(len(names), np.uint64)
        if names:
            lengths = np.array([len(p) for p in names])
            codes = _spread(np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32), lengths, 0)
            for k in range(codes.shape[1]):
                keys = np.where(k < lengths, self.grow(keys, codes[:, k]), keys)
        self.bits = max(4, (4 * len(names)).bit_length())
        self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(names)), self.place(keys)
        while len(todo):  # of those that want one free place the first takes it, the others go on
            _, one = np.unique(at, return_index=True)
            one = one[self.entry[at[one]] < 0]
            self.entry[at[one]], self.keys[at[one]] = todo[one], keys[todo[one]]
            rest = np.ones(len(todo), bool)
            rest[one] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.bytes_ = np.array(v.bytes_ or [0] * 256, np.int32)

    def grow(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h + code + np.uint64(1)) * self.STEP

    def place(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * self.PLACE >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entries of hashes, -1 for those that begin no piece."""
        at = self.place(h)
        out = self.entry[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.entry[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != h[wrong])]
        return out


class Segmenter:
    """N-best paths of texts, with the best paths of recent segments kept: scores, losses and ids as arrays."""

    def __init__(self, vocabulary: Vocabulary, n: int = 4):
        self.v, self.n = vocabulary, n
        self.bytes_of = np.array([len(x) for x in vocabulary.spelling])
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.searched: dict[str, list] = {}
        self.score, self.loss, self.good = np.empty(0), np.empty(0), np.empty(0, bool)
        self.start, self.length, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.held = 0

    def learn(self, segments: list[str]) -> None:
        """Keep the best paths of segments that are not yet kept."""
        if self.held > KEPT:
            self.forget()
        new = sorted(set(segments).difference(self.place), key=len)
        if not new:
            return
        cut = next((k for k, s in enumerate(new) if len(s) > LONG), len(new))
        made = [self._read(new[k : min(cut, k + 4096)]) for k in range(0, cut, 4096)] + [self._one(s) for s in new[cut:]]
        score, loss, length, ids, size = (np.concatenate(x) for x in zip(*made, strict=True))
        # A path that does not spell its segment, by two strings with one hash, is read again without hashes.
        begin = np.cumsum(length) - length
        right = np.add.reduceat(self.bytes_of[ids], begin) == size
        if right.all() and b"".join(map(self.v.spelling.__getitem__, ids.tolist())) == self._plain("".join(new)):
            good = right
        else:
            rows = np.split(ids, begin[1:])
            good = np.array([self._spelled(r) == self._plain(x) for r, x in zip(rows, new, strict=True)])
            for k in np.flatnonzero(~good):
                (score[k],), (loss[k],), (length[k],), rows[k], _ = self._one(new[k])
                good[k] = self._spelled(rows[k]) == self._plain(new[k])
            ids = np.concatenate(rows)
        base = len(self.score)
        self.place.update(zip(new, range(base, base + len(new)), strict=True))
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(length) - length]
        self.score, self.loss, self.good = np.r_[self.score, score], np.r_[self.loss, loss], np.r_[self.good, good]
        self.length, self.ids = np.r_[self.length, length], np.r_[self.ids, ids]
        self.held += 240 * len(new) + 4 * sum(map(len, new)) + 4 * len(ids)

    def _plain(self, segment: str) -> bytes:
        return segment.replace(SPACE, " ").replace(OWN_SPACE, SPACE).encode("utf-8", "surrogatepass")

    def _spelled(self, ids: np.ndarray) -> bytes:
        return b"".join(self.v.spelling[i] for i in ids)

    def _one(self, segment: str) -> tuple[np.ndarray, ...]:
        score, ids, loss = self.v.best(segment)
        return np.array([score]), np.array([loss]), np.array([len(ids)]), np.array(ids, np.int32), np.array([len(self._plain(segment))])

    def _read(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """(scores, losses, numbers of ids, ids, bytes) of segments in ascending order of length."""
        t, m = self.v.table, len(segments)
        size = np.array([len(s) for s in segments])
        codes = _spread(np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32), size, 0)
        width = codes.shape[1]
        wide = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        wide[codes == ord(OWN_SPACE)] = len(SPACE.encode())
        size_in_bytes = (np.where(codes == ord(SPACE), 1, wide) * (np.arange(width) < size[:, None])).sum(1)
        one, two = np.full((m, width + 1), -inf), np.full((m, width + 1), -inf)
        back, piece = np.zeros((m, width + 1), np.int16), np.full((m, width + 1), -1, np.int32)
        one[:, 0] = 0.0

        def reach(rows: np.ndarray, i: int, j: int, s: np.ndarray, entry: np.ndarray | int) -> None:
            v, second = one[rows, i] + s, two[rows, i] + s
            before = one[rows, j]
            better = v > before
            two[rows, j] = np.where(better, np.maximum(before, second), np.maximum(two[rows, j], v))
            up = rows[better]
            one[up, j], back[up, j] = v[better], i
            piece[up, j] = entry[better] if isinstance(entry, np.ndarray) else entry

        for i in range(width):
            rows = np.arange(np.searchsorted(size, i, "right"), m)
            h = np.zeros(len(rows), np.uint64)
            for j in range(i + 1, min(width, i + self.v.longest) + 1):
                if j > i + 1:
                    long = size[rows] >= j
                    rows, h = rows[long], h[long]
                if not len(rows):
                    break
                h = t.grow(h, codes[rows, j - 1])
                entry = t.find(h)
                some = entry >= 0
                if j == i + 1 and len(bare := rows[~some | (t.id[entry] < 0)]):
                    reach(bare, i, j, self.v.unknown * (wide[bare, i] if self.v.by_byte else np.ones(len(bare))), -1)
                rows, h, entry = rows[some], h[some], entry[some]
                whole = t.id[entry] >= 0
                reach(rows[whole], i, j, t.score[entry[whole]], t.id[entry[whole]])
        # Back from the ends, ids are filled in from the right.
        ids = np.zeros((m, int(wide.sum(1).max(initial=1))), np.int32)
        free = np.full(m, ids.shape[1])
        rows, at = np.arange(m), size.copy()
        while len(rows):
            here = at[rows]
            got, start = piece[rows, here], back[rows, here].astype(np.int64)
            whole = got >= 0
            free[rows[whole]] -= 1
            ids[rows[whole], free[rows[whole]]] = got[whole]
            for r, c in zip(rows[~whole].tolist(), codes[rows[~whole], start[~whole]].tolist(), strict=True):
                raw = self.v.raw(chr(c))
                free[r] -= len(raw)
                ids[r, free[r] : free[r] + len(raw)] = t.bytes_[list(raw)]
            at[rows] = start
            rows = rows[start > 0]
        end = one[np.arange(m), size]
        return end, end - two[np.arange(m), size], ids.shape[1] - free, ids[np.arange(ids.shape[1]) >= free[:, None]], size_in_bytes

    def least(self, at: np.ndarray, base: int = 0) -> list[tuple[float, int, int]]:
        """(loss, place in the text, row) of the n - 1 segments that lose least, of equal losses the first."""
        loss = self.loss[at]
        some = np.arange(len(loss))
        if len(loss) > self.n:
            some = np.flatnonzero(loss <= np.partition(loss, self.n - 2)[self.n - 2]) if self.n > 1 else some[:0]
        some = some[np.argsort(loss[some], kind="stable")][: self.n - 1]
        return [(loss[k], base + int(k), int(at[k])) for k in some if loss[k] < inf]

    def paths(self, total: float, few: list[tuple[float, int, str]]) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
        """The n best paths as (score, replaced segments (place, ids)), of the segments (loss, place, segment) that lose least."""
        options = []  # for each segment that may change: (loss, ids), no loss first
        for _, k, s in few:
            if s not in self.searched:
                found = self.v.n_best(s, self.n)
                self.searched[s] = [(found[0][0] - score, p) for score, p in found]
                self.held += 300 + 4 * len(s) + sum(60 + 40 * len(p) for _, p in found)
            options.append((k, self.searched[s]))
        # Combinations of options in the order of their loss; each has one parent: the last raised or a later one goes up.
        heap, out = [(0.0, (0,) * len(options), 0)], []
        while heap and len(out) < self.n:
            loss, choice, last = heapq.heappop(heap)
            out.append((total - loss, [(options[x][0], options[x][1][c][1]) for x, c in enumerate(choice) if c]))
            for x in range(last, len(options)):
                if choice[x] + 1 < len(options[x][1]):
                    up = (*choice[:x], choice[x] + 1, *choice[x + 1 :])
                    heapq.heappush(heap, (sum(options[y][1][c][0] for y, c in enumerate(up)), up, x))
        return out

    def encode_all(self, texts: list[str]) -> Iterator[tuple[Iterator[np.ndarray], float, list, bool]]:
        """For each text: its best ids in parts, its score, its paths and whether the ids decode to it."""
        for run, lists in self._runs(texts):
            if run is None:
                yield self._long(lists)
                continue
            flat = list(chain.from_iterable(lists))
            self.learn(flat)
            at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
            ids, length, score, good = self.ids[_ragged(self.start[at], self.length[at])], self.length[at], self.score[at], self.good[at]
            ends, stop = np.cumsum([len(x) for x in lists]), np.r_[0, np.cumsum(length)]
            for text, segments, end in zip(run, lists, ends.tolist(), strict=True):
                begin = end - len(segments)
                here = at[begin:end]
                total = float(score[begin:end].sum())
                few = [(d, k, segments[k]) for d, k, _ in self.least(here)]
                yield iter((ids[stop[begin] : stop[end]],)), total, self.paths(total, few), bool(good[begin:end].all()) and self._spells(segments, text)

    def _spells(self, segments: list[str], text: str) -> bool:
        """Whether segments, each of which its ids spell, are the text."""
        joined = "".join(segments).replace(SPACE, " ").replace(OWN_SPACE, SPACE)
        return (joined[1:] if self.v.prefix and joined else joined) == text

    def _runs(self, texts: list[str]) -> Iterator[tuple[list[str] | None, list | str]]:
        """Runs of texts with their segments; a text of more than RUN characters comes alone, as it is."""
        run, size = [], 0
        for t in texts:
            if len(t) > RUN:
                if run:
                    yield run, [self.v.segments(x) for x in run]
                    run, size = [], 0
                yield None, t
                continue
            run.append(t)
            size += len(t)
            if size >= RUN:
                yield run, [self.v.segments(x) for x in run]
                run, size = [], 0
        if run:
            yield run, [self.v.segments(x) for x in run]

    def _long(self, text: str) -> tuple[Iterator[np.ndarray], float, list, bool]:
        """A long text, read part by part; its ids are made again, part by part, as they are taken."""
        total, few, base, good, seen = 0.0, [], 0, True, 0
        for segments in self.v.parts(text):
            self.learn(segments)
            at = np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))
            total += float(self.score[at].sum())
            few = sorted([*few, *((d, k, segments[k - base]) for d, k, _ in self.least(at, base))])[: self.n - 1]
            plain = "".join(segments).replace(SPACE, " ").replace(OWN_SPACE, SPACE)
            plain = plain[1:] if self.v.prefix and not base else plain
            good &= bool(self.good[at].all()) and text.startswith(plain, seen)
            seen += len(plain)
            base += len(segments)

        def ids() -> Iterator[np.ndarray]:
            for segments in self.v.parts(text):
                self.learn(segments)
                at = np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))
                yield self.ids[_ragged(self.start[at], self.length[at])]

        return ids(), total, self.paths(total, few), good and seen == len(text)

    def encode(self, text: str) -> tuple[list[int], list[tuple[float, list[tuple[int, tuple[int, ...]]]]], list[str]]:
        """(best ids, paths as (score, replaced segments (place, ids)), best first, segments)."""
        ids, _, paths, _ = next(self.encode_all([text]))
        return list(chain.from_iterable(x.tolist() for x in ids)), paths, self.v.segments(text)

    def spelled(self, segments: list[str], changes: list[tuple[int, tuple[int, ...]]]) -> list[int]:
        """The ids of a path."""
        new = dict(changes)
        return [i for k, s in enumerate(segments) for i in (new[k] if k in new else self.v.best(s)[1])]


def _segmenter(held, n: int) -> Segmenter:
    """The worker's segmenter for a broadcast vocabulary; one at a time is kept."""
    key = ("pieces", held.value.key, n)
    if key not in KEEP:
        KEEP.clear()
        KEEP[key] = Segmenter(held.value, n)
    return KEEP[key]


def _texts(batch: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch, null as empty, in lists of about RUN bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + RUN, "right")))
        yield [t or "" for t in batch.slice(at, end - at).to_pylist()]
        at = end


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text", n: int = 4) -> DataFrame:
    """docs with ids array<int>, score double, paths array<struct<score, ids of the changed segments>> and round_trip boolean.

    ids is the best segmentation of the whole text; paths are the n best, best first, each as its score and the
    segments in which it differs from the best one (place in the text's segments, ids). round_trip tells whether the
    ids decode to the text. A null or empty text has no ids and one path of score 0. Of equal paths those whose pieces
    start first are taken, so repeated rows have the same result; each stays a row. Long texts are read in parts; their ids
    are one value, as the column needs. No shuffle; other columns stay, but those named like a result give way to it. An
    empty table gives no rows.
    """
    require(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = "struct<ids:array<int>,score:double,paths:array<struct<score:double,changes:array<struct<place:int,ids:array<int>>>>>,round_trip:boolean>"

    @F.arrow_udf(kind)
    @trimmed(keep=True)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = _segmenter(held, n)
        kinds = pa.struct([("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("paths", pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("place", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))), ("round_trip", pa.bool_())])
        for batch in batches:
            out = []
            for texts in _texts(batch):
                for ids, score, paths, good in work.encode_all(texts):
                    changed = [{"score": s, "changes": [{"place": k, "ids": list(x)} for k, x in c]} for s, c in paths]
                    out.append({"ids": np.concatenate([np.empty(0, np.int32), *ids]), "score": score, "paths": changed, "round_trip": good})
            yield pa.array(out, kinds)

    return _with_results(docs, run(F.col(text_col)), ("ids", "score", "paths", "round_trip"))


def digests(docs: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text", n: int = 4) -> DataFrame:
    """docs with n_pieces, score, ids_sha256 (of the ids as 32-bit integers), path_scores and round_trip; the ids stay in Python.

    Nulls, empty and long texts, repeated rows and clashing names as in encode_documents(), but memory is bounded for long texts too.
    """
    require(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("struct<n_pieces:bigint,score:double,ids_sha256:string,path_scores:string,round_trip:boolean>")
    @trimmed(keep=True)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = _segmenter(held, n)
        kinds = pa.struct([("n_pieces", pa.int64()), ("score", pa.float64()), ("ids_sha256", pa.string()), ("path_scores", pa.string()), ("round_trip", pa.bool_())])
        for batch in batches:
            rows = []
            for texts in _texts(batch):
                for ids, score, paths, good in work.encode_all(texts):
                    digest, count = hashlib.sha256(), 0
                    for part in ids:
                        digest.update(part.astype("<i4").tobytes())
                        count += len(part)
                    rows.append((count, score, digest.hexdigest(), ",".join(f"{s:.4f}" for s, _ in paths), good))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kinds[i].type) for i in range(len(kinds))], fields=list(kinds))

    return _with_results(docs, run(F.col(text_col)), ("n_pieces", "score", "ids_sha256", "path_scores", "round_trip"))


def _with_results(docs: DataFrame, made: F.Column, names: tuple[str, ...]) -> DataFrame:
    """docs with the fields of made, which replace columns of their names."""
    kept = [c for c in docs.columns if c not in names]
    return docs.select(*[F.col(f"`{c}`") for c in kept], made.alias("_made_")).select(*[F.col(f"`{c}`") for c in kept], "_made_.*")


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return materialize(digests(docs, Vocabulary.load()).drop("text"), "pieces")
