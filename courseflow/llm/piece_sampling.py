"""Distinct sampled segmentations into the pieces of a SentencePiece model, and back.

A text becomes U+2581 + text with spaces as U+2581, cut before every such mark that follows another character
and around line feeds (no piece crosses those cuts, which is checked when a model is read); the pieces that fit each stretch form a lattice, a character without a piece
being one edge of byte pieces. A piece weighs -log(2 - score), score being the model's (the merge rank
with the sign turned), and backward sums over the lattice turn weights into the probability of every
edge given its place, so a segmentation's probability is the product of its edges'.

Gumbel top-k without replacement: the root gets a Gumbel value, the best child of a node inherits it, and
all other children together keep a value drawn below it (their largest). A-star search over these values
is exact: the k segmentations of largest perturbed log-probability come out in order, each node being
opened only on the way to one of them. The largest value left over is the threshold of the inclusion
score, log(1 - exp(-exp(log_prob - threshold))), zero where nothing is left.

All draws are hashes of (seed, row key, sample, stretch, step), so rows do not depend on batches.
Defined cases: null or empty text has one empty segmentation; texts with fewer than k segmentations give
fewer rows; a null key is a key; rows that repeat key and text repeat their samples; U+2581 in the text
becomes byte pieces; an empty table gives no rows; further columns are ignored. Long stretches cost time
and memory in proportion to their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courseflow.llm import textblock as tb
from courseflow.llm.shared import text_batches

MARK, OWN_MARK, CUT = "▁", "\ud800", "\ud801"  # the last two cannot be in a valid text
SAMPLES, SEED = 2, 20_240
PART = 3 << 17  # bytes of text that are worked on at once, about
#: A prefix this much less likely (natural logarithm) than where its sample begins holds less than the resolution of a
#: double of what is left there, so no value is drawn for what turns off below it.
DEEP = 50.0
_BASE = np.uint64(0xA24BAED4963EE407)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODE = tb.mix(np.arange(1 << 16, dtype=np.uint64), 5)
_TOP = np.uint64(47)  # the upper 17 bits of a hash choose its place in a table


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _code_hash(codes: np.ndarray) -> np.ndarray:
    out = _CODE[np.minimum(codes, 65_535)]
    high = np.flatnonzero(codes > 65_535)
    out[high] = tb.mix(codes[high].astype(tb.U), 5)
    return out


class Pieces:
    """A model's pieces. ``prefixes`` holds, by length, the sorted hashes of all beginnings of pieces, the piece
    that each is (-1 if none), where the hashes of equal upper bits begin, and how many there are at most."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        self.surface: list[bytes] = [b""] * n
        weight, plain = np.zeros(n), []
        for i in range(n):
            piece = model.id_to_piece(i)
            weight[i] = -np.log(2.0 - min(model.get_score(i), 0.0))
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} crosses the cuts between stretches")
                plain.append((i, piece))
                self.surface[i] = piece.replace(MARK, " ").encode()
        self.weight, self.byte_weight = weight, -np.log(2.0 + n)
        ids = np.array([i for i, _ in plain], np.int32)
        lengths = np.array([len(x) for _, x in plain])
        code, begin = _code_hash(_codes("".join(x for _, x in plain))), np.cumsum(lengths) - lengths
        self.prefixes, h = [], np.zeros(len(ids), tb.U)
        for length in range(1, int(lengths.max(initial=0)) + 1):
            on = lengths >= length
            h[on] = h[on] * _BASE + code[begin[on] + length - 1]
            hashes, at = np.unique(h[on], return_inverse=True)
            piece = np.full(len(hashes), -1, np.int32)
            whole = lengths[on] == length
            piece[at[whole]] = ids[on][whole]
            top = hashes >> _TOP
            first = np.searchsorted(top, np.arange(1 << 17, dtype=tb.U)).astype(np.int32)
            self.prefixes.append((np.append(hashes, tb.U(0)), np.append(piece, np.int32(-1)), first, int(np.bincount(top.astype(np.int64)).max())))
        self.size = n
        self.bytes_of = np.frombuffer(b"".join(self.surface), np.uint8)
        self.byte_bounds = np.concatenate([[0], np.cumsum([len(s) for s in self.surface])])


class Lattice:
    """The lattices of all distinct stretches of a part. Nodes are numbered by their distance from the end of
    their stretch, then by the stretch's rank (longest first), so the nodes of one distance lie together and
    the ends come first. Edges lie by their start node, longest piece first: ``log_prob``, ``upto`` (probability of the
    node's edges up to this one), ``to``, and ``id`` (of a byte sequence if past the pieces)."""

    def __init__(self, stretches: list[str], pieces: Pieces):
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        codes, ends = _codes("".join(stretches)), np.cumsum(lengths)
        order = np.argsort(-lengths, kind="stable")
        lengths, ends = lengths[order], ends[order]
        longest = int(lengths[0]) if len(lengths) else 0
        level = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest + 1))
        base = np.concatenate([[0], np.cumsum(level)]).astype(np.int32)
        self.ends, self.nodes = len(lengths), int(base[-1])
        far = np.repeat(np.arange(longest + 1, dtype=np.int32), level)
        rank = np.arange(self.nodes, dtype=np.int32) - base[far]
        self.start = np.empty(len(order), np.int32)
        self.start[order] = base[lengths] + np.arange(len(order), dtype=np.int32)
        code = np.zeros(self.nodes, np.uint32)
        code[self.ends :] = codes[ends[rank[self.ends :]] - far[self.ends :]]
        after = np.arange(self.nodes, dtype=np.int32)  # the node one code point on
        after[self.ends :] -= np.repeat(level[:-1].astype(np.int32), level[1:])
        mixed, count = _code_hash(code), np.zeros(self.nodes, np.int32)
        found, alone = [], np.ones(self.nodes, bool)
        node = last = np.arange(self.ends, self.nodes, dtype=np.int32)
        h = np.zeros(len(node), tb.U)
        for length, (hashes, piece, first, most) in enumerate(pieces.prefixes, 1):
            h = h * _BASE + mixed[last]
            slot = first[h >> _TOP]
            hit = hashes[slot] == h
            for more in range(1, most):
                miss = np.flatnonzero(~hit)
                further = np.minimum(slot[miss] + more, len(piece) - 1)
                good = hashes[further] == h[miss]
                slot[miss[good]], hit[miss[good]] = further[good], True
            on = np.flatnonzero(hit)
            node, h, to, ids = node[on], h[on], after[last[on]], piece[slot[on]]
            whole = np.flatnonzero(ids >= 0)
            here = node[whole]
            nth = count[here]
            found.append((here, to[whole], ids[whole], nth))
            count[here] = nth + 1
            if length == 1:
                alone[here] = False
            on = np.flatnonzero(to >= self.ends)
            node, h, last = node[on], h[on], to[on]
        bare = self.ends + np.flatnonzero(alone[self.ends :])
        kinds, which = np.unique(code[bare], return_inverse=True)
        raw = [(MARK if c == 0xD800 else chr(c)).encode() for c in kinds]
        self.sequence = [pieces.byte_id[list(x)] for x in raw]
        found.append((bare, after[bare], (pieces.size + which).astype(np.int32), count[bare]))
        count[bare] += 1
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        n = int(self.first[-1])
        self.to, self.id, weight = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n)
        weights = np.append(pieces.weight, [pieces.byte_weight * len(x) for x in raw])
        for here, to, ids, nth in found:
            at = self.first[here + 1] - 1 - nth
            self.to[at], self.id[at], weight[at] = to, ids, weights[ids]
        beta, self.log_prob, self.upto = np.zeros(self.nodes), np.empty(n), np.empty(n)
        for d in range(1, longest + 1):  # backward sums, all nodes of one distance at once
            a, b = base[d], base[d + 1]
            e, size, at = slice(self.first[a], self.first[b]), count[a:b], self.first[a:b] - self.first[a]
            value = weight[e] + beta[self.to[e]]
            top = np.maximum.reduceat(value, at)
            x = np.exp(value - np.repeat(top, size))
            total = np.add.reduceat(x, at)
            beta[a:b] = top + np.log(total)
            x /= np.repeat(total, size)
            run = np.cumsum(x)
            np.minimum(value - np.repeat(beta[a:b], size), 0.0, out=self.log_prob[e])
            self.upto[e] = run - np.repeat(run[at] - x[at], size)
        self.upto[self.first[self.ends + 1 :] - 1] = 2.0  # rounding must not lead past a node's last edge
        self.is_end = np.arange(self.nodes) < self.ends

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each state: the one whose span of the cumulated probability holds u."""
        edge = self.first[state]
        open_ = np.flatnonzero(u >= self.upto[edge])
        while len(open_):
            e = edge[open_] + 1
            edge[open_] = e
            open_ = open_[u[open_] >= self.upto[e]]
        return edge


def _uniform(seeds: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each seed."""
    return ((tb.mix(seeds) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _seed(seeds: np.ndarray, purpose: int, place=0) -> np.ndarray:
    return seeds + np.asarray(place).astype(tb.U) * _BASE + np.array([purpose], tb.U) * _BACK


def _below(value: np.ndarray, mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel of log mass ``mass``, given that it is at most ``value``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-value, np.log(-np.log(u)) - mass)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (n[i] of them) for each i, in a row."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Sample:
    """One segmentation of each row: ``edge`` in order and the stretch ``at`` of each, rows by ``bounds``; from
    ``begin`` on a row is its own, before that it is an earlier sample's. ``rest`` is the value of all that
    turns off at each ``open`` place."""

    def __init__(self, at, edge, bounds, begin, value, lattice, seeds, number):
        self.at, self.edge, self.bounds, self.value = at, edge, bounds, value
        run = np.concatenate([[0.0], np.cumsum(lattice.log_prob[edge])])
        self.log_prob = run[bounds[1:]] - run[bounds[:-1]]
        own = bounds[1:] - begin
        place = _ranges(begin, own)
        row = np.repeat(np.arange(len(value), dtype=np.int32), own)
        near = np.flatnonzero(run[place] >= run[begin][row] - DEEP)
        self.open, self.row = place[near], row[near]
        self.before = run[self.open] - run[bounds[self.row]]
        with np.errstate(divide="ignore"):
            others = np.log(-np.expm1(lattice.log_prob[edge[self.open]]))
        u = _uniform(_seed(seeds[self.row], number * 4 + 1, self.open - bounds[self.row]))
        self.rest = _below(value[self.row], self.before + others, u)
        self.taken = np.zeros(0, np.int64)
        self._find()

    def _find(self) -> None:
        """The largest value left of each row."""
        self.best = np.full(len(self.value), -np.inf)
        if len(self.row):
            first = np.flatnonzero(np.concatenate([[True], self.row[1:] != self.row[:-1]]))
            self.best[self.row[first]] = np.maximum.reduceat(self.rest, first)

    def turn(self, rows: np.ndarray, value: np.ndarray, lattice: Lattice, seeds: np.ndarray, number: int):
        """Opens the largest value left of each of ``rows``, which becomes ``value``: the place where it turns off and
        the edge taken there. What still turns off there keeps a value of its own."""
        top = np.flatnonzero(self.rest == self.best[self.row])
        got, first = np.unique(self.row[top], return_index=True)
        j = top[first[np.searchsorted(got, rows)]]
        place = self.open[j]
        node = np.searchsorted(lattice.first, self.edge[place], "right") - 1
        size = lattice.first[node + 1] - lattice.first[node]
        option, group = _ranges(lattice.first[node], size), np.repeat(np.arange(len(j)), size)
        free = option != self.edge[place][group]
        if len(self.taken):
            free &= ~np.isin(place[group].astype(np.int64) << 32 | option, self.taken)
        at = np.cumsum(size) - size
        log_prob = np.where(free, lattice.log_prob[option], -np.inf)
        largest = np.maximum.reduceat(log_prob, at)
        x = np.exp(log_prob - largest[group])
        total, run = np.add.reduceat(x, at), np.cumsum(x)
        run -= (run[at] - x[at])[group]
        u = _uniform(_seed(seeds[rows], number * 4 + 2)) * total
        # The first free option whose sum passes u; by rounding none may, then the last free one.
        passes = np.where(free & (run > u[group]), option, np.iinfo(np.int32).max)
        chosen = np.minimum.reduceat(passes, at)
        last = np.maximum.reduceat(np.where(free, option, -1), at)
        chosen = np.minimum(chosen, last).astype(np.int32)
        others = np.add.reduceat(np.where(option == chosen[group], 0.0, x), at)
        with np.errstate(divide="ignore"):
            mass = self.before[j] + largest + np.log(others)
        self.rest[j] = _below(value[rows], mass, _uniform(_seed(seeds[rows], number * 4 + 3)))
        self.taken = np.concatenate([self.taken, place.astype(np.int64) << 32 | chosen])
        self._find()
        return place, chosen


def _walk(lattice: Lattice, state: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges from each state to its end, in order, and how many each has."""
    n, got = np.zeros(len(state), np.int32), []
    at = np.flatnonzero(state >= lattice.ends).astype(np.int32)
    state, seeds = state[at], seeds[at]
    while len(at):
        edge = lattice.draw(state, _uniform(_seed(seeds, 0, [len(got)])))
        got.append((at, edge))
        n[at] += 1
        state = lattice.to[edge]
        on = np.flatnonzero(state >= lattice.ends)
        at, state, seeds = at[on], state[on], seeds[on]
    first = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int32)
    for order, (at, edge) in enumerate(got):
        out[first[at] + order] = edge
    return out, n


def _stretches(text: str) -> list[str]:
    marked = (MARK + text.replace(MARK, OWN_MARK).replace(" ", CUT + MARK)).replace(MARK + CUT, MARK).replace("\n", f"{CUT}\n{CUT}")
    return list(filter(None, marked.split(CUT))) if text else []


def sample_texts(texts: list[str], keys: np.ndarray, pieces: Pieces, k: int, seed: int, no_key: np.ndarray | None = None):
    """The lattice and, best first, samples of all rows; a row without a further one has value -inf."""
    cuts = list(map(_stretches, texts))
    counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
    flat = list(chain.from_iterable(cuts))
    known: dict[str, int] = {}
    kind = np.fromiter(map(known.setdefault, flat, count()), np.int32, len(flat))  # where each was first met
    kind = (np.cumsum(kind == np.arange(len(flat)), dtype=np.int32) - 1)[kind]
    lattice = Lattice(list(known), pieces)
    del cuts, flat, known
    row = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    nth = np.arange(len(kind)) - bounds[row]
    seeds = tb.mix(keys.astype(np.int64).view(tb.U) ^ np.uint64(seed), 8)
    if no_key is not None:  # a null key has a seed that no key has by rule
        seeds = np.where(no_key, tb.mix(seeds ^ _BACK), seeds)
    value = -np.log(-np.log(_uniform(_seed(seeds, 3))))
    edge, n = _walk(lattice, lattice.start[kind], _seed(seeds[row], 0, nth << 20))
    starts = np.concatenate([[0], np.cumsum(n)])[bounds]
    samples = [Sample(np.repeat(np.arange(len(n), dtype=np.int32), n), edge, starts, starts[:-1], value, lattice, seeds, 0)]
    for number in range(1, k):
        best = np.array([s.best for s in samples])
        parent, value = best.argmax(0), best.max(0)
        shared, turned, chosen = np.zeros(len(texts), np.int64), np.full(len(texts), len(kind)), np.zeros(len(texts), np.int32)
        copies = []
        for p, s in enumerate(samples):
            rows = np.flatnonzero((parent == p) & np.isfinite(value))
            if len(rows):
                place, chosen[rows] = s.turn(rows, value, lattice, seeds, number)
                shared[rows], turned[rows] = place - s.bounds[rows], s.at[place]
                copies.append((s, rows))
        todo = np.flatnonzero(np.arange(len(kind)) >= turned[row])
        state, turns = lattice.start[kind[todo]], turned[row[todo]] == todo
        state[turns] = lattice.to[chosen[row[todo[turns]]]]
        later, n = _walk(lattice, state, _seed(seeds[row[todo]], number * 4, nth[todo] << 20))
        walked = np.bincount(row[todo], n, len(texts)).astype(np.int64)
        some = turned < len(kind)
        starts = np.concatenate([[0], np.cumsum(shared + some + walked)])
        at, edge = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.int32)
        for s, rows in copies:
            here, there = _ranges(starts[rows], shared[rows]), _ranges(s.bounds[rows], shared[rows])
            at[here], edge[here] = s.at[there], s.edge[there]
        begin = starts[:-1] + shared + some
        at[begin[some] - 1], edge[begin[some] - 1] = turned[some], chosen[some]
        here = _ranges(begin, walked)
        at[here], edge[here] = np.repeat(todo, n), later
        samples.append(Sample(at, edge, starts, begin, value, lattice, seeds, number))
    return lattice, samples


def _expand(lattice: Lattice, pieces: Pieces, s: Sample) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows of a sample, and their bounds by row."""
    number = lattice.id[s.edge]
    if not len(lattice.sequence):
        return number, s.bounds
    lengths = np.concatenate([np.ones(pieces.size, np.int64), [len(x) for x in lattice.sequence]])
    flat, first = np.concatenate([np.arange(pieces.size, dtype=np.int32), *lattice.sequence]), np.cumsum(lengths) - lengths
    n = lengths[number]
    return flat[_ranges(first[number], n)], np.concatenate([[0], np.cumsum(n)])[s.bounds]


def decode(ids: np.ndarray, bounds: np.ndarray, pieces: Pieces) -> list[bytes]:
    """The texts (UTF-8) of rows of piece ids: surfaces joined, without the mark put before the text."""
    lengths = np.diff(pieces.byte_bounds)[ids]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    raw = pieces.bytes_of[np.repeat(pieces.byte_bounds[ids] - ends[:-1], lengths) + np.arange(ends[-1])]
    return [raw[ends[a] + (b > a) : ends[b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


_loaded: dict[str, Pieces] = {}
_SCHEMA = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, decoded boolean, ids array<int>"


def sampled_pieces(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """Up to k rows a document: sample (from 1, best first), pieces, scores, and whether they decode to
    the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded.setdefault(model, None) or Pieces(model)
        _loaded[model] = pieces
        for batch in batches:
            for part in tb.parts(batch, "text", PART):
                texts = part.column("text").fill_null("").to_pylist()
                keys = part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
                no_key = part.column("doc_id").is_null().to_numpy(zero_copy_only=False) if part.column("doc_id").null_count else None
                lattice, samples = sample_texts(texts, keys, pieces, k, seed, no_key)
                left = np.max([s.best for s in samples], axis=0)
                for j, s in enumerate(samples):
                    real = np.isfinite(s.value)
                    ids, bounds = _expand(lattice, pieces, s)
                    with np.errstate(divide="ignore", over="ignore"):
                        ratio = s.log_prob - left
                        score = np.where(np.isfinite(left), np.where(ratio < -30, ratio, np.log(-np.expm1(-np.exp(np.minimum(ratio, 700))))), 0.0)
                    back = decode(ids, bounds, pieces)
                    words = ids.astype("<i4")
                    crc = [zlib.crc32(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                    same = [b == t.encode() for b, t in zip(back, texts)]
                    id_lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words)) if with_ids else pa.nulls(len(real), pa.list_(pa.int32()))
                    table = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(real), j + 1, np.int32)), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(s.log_prob), pa.array(s.value), pa.array(score), pa.array(same, pa.bool_()), id_lists], [f.split()[0] for f in _SCHEMA.split(", ")])
                    yield table.filter(pa.array(real))

    return text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, _SCHEMA)
