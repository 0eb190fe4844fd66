"""SentencePiece encoding with sampled segmentations (Gumbel top-k without replacement), and decoding.

A text's segmentations are the paths through the lattice of its vocabulary pieces. Forward sums (alpha) over the lattice give every path its
probability and let a path be drawn from its end backwards, edge by edge. Samples without replacement come from a perturbed A* search: the
agenda holds disjoint subtrees of paths, each with the largest Gumbel-perturbed log probability in it; the best one is popped, a path is
drawn in it, and what is left of it splits into one subtree for each edge where a path could have turned off, whose maxima are Gumbel
variates truncated at the popped value. The k popped paths are an exact sample without replacement in order of their perturbed values; with
the (k+1)-th value as threshold t, a path of log probability p was included with probability 1 - exp(-exp(p - t)).

The model file holds merge ranks and no probabilities, so a piece of rank r weighs as 1 / (r + 2) (Zipf), normalised over the vocabulary and
raised to the power THETA; a code point without a piece becomes its bytes. No piece spans a blank's left edge or a line feed, so the lattice
falls apart into units between them, and each distinct unit of a batch is expanded once; the units met first stay for later batches. Draws are hashes of (row key, sample, place), so a
row's samples depend on nothing but its key, its text and the parameters.

Defined results: a null text is the empty text, which has one segmentation, of no pieces; a text with fewer than k segmentations gets them
all, with inclusion probability 1; repeated rows with one key get equal samples, and rows without id share a key; ties of perturbed values
go to the earlier place; a very long text is a lattice of its own size; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidewell.llm.common import texts_of
from tidewell.llm.textarrays import Table, text_slices

SAMPLES, THETA, SEED = 2, 1.0, 20
BLANK = "▁"
#: Edges of the lattices that a worker keeps from batch to batch.
KEEP = 1 << 21
_UNIT = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
_MULT, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_open: dict[tuple, "Lattices"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _STEP
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _uniform(key: np.ndarray, sample: int, place: np.ndarray, use: int) -> np.ndarray:
    """Values in (0, 1) from row key, sample number, place in the text and what they are for."""
    h = _mix(key + np.uint64((2 * sample + use) * 0x2545F4914F6CDD1D % 2**64))
    return ((_mix(h + place.astype(np.uint64) * _MULT) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattices:
    """The vocabulary, and the lattices of a batch of units."""

    def __init__(self, path: str, theta: float = THETA):
        from sentencepiece import SentencePieceProcessor

        self.sp, self.shelf = SentencePieceProcessor(model_file=path), Shelf()
        sp = self.sp
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        low = min(normal)
        rank = np.array([i - low if sp.get_score(i) > -1e8 else n for i in normal], dtype=np.float64)
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.floor = float(theta * -np.log((n + 2) * np.sum(1 / (rank + 2))))  # of a byte
        weight = theta * -np.log((rank + 2) * np.sum(1 / (rank + 2)))
        pieces = [sp.id_to_piece(i) for i in normal]
        self.longest = max(map(len, pieces))
        # one table of hashes of pieces, told apart by length
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        hashes = []
        for size in range(1, self.longest + 1):
            mine = [pieces[k] for k in order if len(pieces[k]) == size]
            h = np.zeros(len(mine), np.uint64)
            for j in range(size):
                h = h * _MULT + np.frombuffer("".join(mine).encode("utf-32-le"), "<u4").reshape(-1, size)[:, j]
            hashes.append(h * _STEP + np.uint64(size))
        self.lengths = set(map(len, pieces))
        keys = np.concatenate(hashes)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.table, self.ids, self.weight = Table(_mix(keys)), np.array(normal)[order], weight[order]
        self.maybe = np.zeros(1 << 18, dtype=bool)  # by the upper bits of a hash: most substrings are no pieces, which this tells at once
        self.maybe[keys >> np.uint64(46)] = True

    @classmethod
    def at(cls, path: str, theta: float) -> "Lattices":
        if (path, theta) not in _open:
            _open[path, theta] = cls(path, theta)
        return _open[path, theta]

    def build(self, units: list[str]) -> "Lattice":
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        unit = np.repeat(np.arange(len(units), dtype=np.int32), lengths)
        at = (np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        rem = (np.repeat(lengths, lengths) - at).astype(np.int32)
        node = np.arange(len(chars), dtype=np.int32) + unit  # a unit of n code points has n + 1 nodes
        starts, sizes, rows = [], [], []
        h, covered, live = np.zeros(len(chars), np.uint64), np.zeros(len(chars), dtype=bool), np.arange(len(chars), dtype=np.int32)
        for n in range(1, min(self.longest, int(lengths.max(initial=0))) + 1):
            if n in (4, 8, 12):  # what is left of short units is dropped now and then
                keep = np.flatnonzero(rem >= n)
                live, h, rem = live[keep], h[keep], rem[keep]
            h = h * _MULT + chars[np.minimum(live + n - 1, len(chars) - 1)]
            if n not in self.lengths:
                continue
            key = h * _STEP + np.uint64(n)
            p = np.flatnonzero(self.maybe[(key >> np.uint64(46)).astype(np.int32)] & (rem >= n))
            row = self.table.find(_mix(key[p]))
            hit = np.flatnonzero(row >= 0)
            starts.append(live[p[hit]])
            rows.append(row[hit])
            sizes.append(np.full(len(hit), n, dtype=np.int32))
            if n == 1:
                covered[starts[0]] = True
        ids, weights = [self.ids[r] for r in rows], [self.weight[r] for r in rows]
        bare = np.flatnonzero(~covered)  # as bytes; the id is minus the code point
        width = 1 + (chars[bare] > 0x7F) + (chars[bare] > 0x7FF) + (chars[bare] > 0xFFFF)
        starts, sizes, ids = np.concatenate([*starts, bare]), np.concatenate([*sizes, np.ones(len(bare), np.int32)]), np.concatenate([*ids, -chars[bare].astype(np.int64) - 1])
        return Lattice(lengths, node[starts], node[starts] + sizes, at[starts] + sizes, ids, np.concatenate([*weights, self.floor * width]))

    def expand(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids with bytes in place of code points that have no piece, and how many each became."""
        bare = np.flatnonzero(ids < 0)
        count = np.ones(len(ids), dtype=np.int64)
        if not len(bare):
            return ids, count
        data = [chr(-int(x) - 1).encode("utf-8", "surrogatepass") for x in ids[bare]]
        count[bare] = [len(d) for d in data]
        out = np.repeat(ids, count)
        first = np.cumsum(count) - count
        for b, d in zip(first[bare].tolist(), data, strict=True):
            out[b : b + len(d)] = self.byte[list(d)]
        return out, count


class Lattice:
    """Edges into each node with their probabilities given the node, for drawing paths from the end of a unit."""

    def __init__(self, lengths: np.ndarray, start: np.ndarray, end: np.ndarray, depth: np.ndarray, ids: np.ndarray, weight: np.ndarray):
        # by depth of the end node, then end node, then from the longest piece to the shortest, which is drawn least
        order = np.argsort((depth.astype(np.int64) * (int(end.max(initial=0)) + 1) + end) * 64 - (end - start))
        self.start, self.end, self.ids, weight, depth = start[order], end[order], ids[order], weight[order], depth[order]
        alpha = np.zeros(int((lengths + 1).sum()))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]]) if len(depth) else [0]
        heads = np.concatenate([[0], np.flatnonzero(np.diff(self.end)) + 1]) if len(self.end) else np.zeros(0, np.int64)
        inside = np.searchsorted(heads, cuts)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            h = heads[inside[k] : inside[k + 1]]
            alpha[self.end[h]] = np.logaddexp.reduceat(alpha[self.start[a:b]] + weight[a:b], h - a)
        self.last = np.cumsum(lengths + 1) - 1  # the end node of each unit
        self.log_p = alpha[self.start] + weight - alpha[self.end]
        self.heads = np.concatenate([heads, [len(self.end)]])
        self.nth = np.full(len(alpha), -1, dtype=np.int64)
        self.nth[self.end[heads]] = np.arange(len(heads))
        # cumulated edge by edge and in whole numbers, so that a draw depends on its node alone and on no other unit of the batch
        within, many, at = np.exp(self.log_p), np.diff(self.heads), heads
        for k in range(1, int(many.max(initial=1))):
            at = heads[many > k] + k
            within[at] += within[at - 1]
        self.cum = np.floor(np.minimum(within, 1.0) * 2.0**32).astype(np.int64)
        self.cum[self.heads[1:] - 1] = 1 << 32  # the last edge of a node takes what rounding leaves

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge into each node."""
        edge, u = self.heads[self.nth[node]], (u * 2.0**32).astype(np.int64)
        on = np.flatnonzero(self.cum[edge] <= u)
        while len(on):
            edge[on] += 1
            on = on[self.cum[edge[on]] <= u[on]]
        return edge

    def edges_into(self, node: int) -> tuple[int, int]:
        n = self.nth[node]
        return int(self.heads[n]), int(self.heads[n + 1])

    def root(self, node: np.ndarray) -> np.ndarray:
        """Whether nodes are where their unit begins."""
        return self.nth[node] < 0


class Shelf:
    """Lattices one after another: those of the first KEEP edges' units, which a worker keeps, and those of the batch at hand. A draw depends on
    its node alone, so what is kept changes no result."""

    def __init__(self):
        self.units: dict[str, int] = {}
        self.nodes = self.edges = self.groups = 0
        self.room: dict[str, np.ndarray] = {}

    def of(self, units: list[str], lattices: "Lattices") -> tuple["Lattice", np.ndarray]:
        """A lattice that holds all the units, and the number of each."""
        new = [u for u in dict.fromkeys(units) if u not in self.units]
        known = len(self.units)
        fresh = {u: known + i for i, u in enumerate(new)}
        part = lattices.build(new)
        out = object.__new__(Lattice)
        for name, at, add in (("start", self.edges, self.nodes), ("end", self.edges, self.nodes), ("ids", self.edges, 0), ("log_p", self.edges, 0), ("cum", self.edges, 0), ("heads", self.groups, self.edges), ("nth", self.nodes, self.groups), ("last", known, self.nodes)):
            values = getattr(part, name)
            upto = at + len(values)
            if name not in self.room or len(self.room[name]) < upto:
                room = np.zeros(2 * upto, dtype=values.dtype)
                room[:at] = self.room[name][:at] if at else 0
                self.room[name] = room
            self.room[name][at:upto] = np.where(values < 0, -1, values + add) if name == "nth" else values + add if add else values
            setattr(out, name, self.room[name][:upto])
        place = self.units | fresh
        if self.edges + len(part.start) <= KEEP:
            self.units = place
            self.nodes, self.edges, self.groups = self.nodes + len(part.nth), self.edges + len(part.start), self.groups + len(part.heads) - 1
        return out, np.fromiter(map(place.__getitem__, units), np.int64, len(units))


def _truncated(phi: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variates of location phi, truncated at the bound."""
    return phi - np.log(np.exp(phi - bound) - np.log(u))


class _Paths:
    """One drawn path for each of some texts, as edges in drawing order: unit after unit, each from its end."""

    def __init__(self, texts: np.ndarray, edge: np.ndarray, unit: np.ndarray, start: np.ndarray, value: np.ndarray):
        self.texts, self.edge, self.unit, self.start, self.value = texts, edge, unit, start, value  # start: of each text's edges, and the end
        self.turn: np.ndarray | None = None  # perturbed maximum of what turns off at each edge
        self.taken: dict[int, tuple[int, list[int]]] = {}  # text -> place of its first own edge and the edges that it may not take there


def sample(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text, up to k distinct (piece ids, log probability, perturbed value, log inclusion probability), the largest value first."""
    units_of = [_UNIT.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
    flat = [u for us in units_of for u in us]
    lattice, which = lattices.shelf.of(flat, lattices) if flat else (None, np.zeros(0, np.int64))
    bounds = np.concatenate([[0], np.cumsum([len(u) for u in units_of])]).astype(np.int64)
    keys = _mix(keys.astype(np.uint64))
    n = len(texts)
    value = -np.log(-np.log(_uniform(keys, 0, np.zeros(n, np.uint64), 1)))  # the root's maximum: a Gumbel variate
    text_of = np.repeat(np.arange(n), np.diff(bounds))
    out: list[list] = [[] for _ in range(n)]
    if lattice is None:
        return [[(np.zeros(0, np.int64), 0.0, float(v), 0.0)] for v in value]

    def drawn(units: np.ndarray, node: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the paths that end at the nodes, unit after unit, and how many each unit has. units: numbers of occurrences."""
        rounds, live, steps = [], np.flatnonzero(~lattice.root(node)), np.zeros(len(units), np.int64)
        node = node.copy()
        while len(live):
            place = units[live].astype(np.uint64) - bounds[text_of[units[live]]].astype(np.uint64)
            u = _uniform(keys[text_of[units[live]]], number, place * np.uint64(65537) + steps[live].astype(np.uint64), 0)
            e = lattice.draw(node[live], u)
            rounds.append((live, e))
            node[live] = lattice.start[e]
            steps[live] += 1
            live = live[~lattice.root(node[live])]
        first, edges = np.cumsum(steps) - steps, np.zeros(int(steps.sum()), np.int64)
        for r, (at, e) in enumerate(rounds):
            edges[first[at] + r] = e
        return edges, steps

    def bound_turns(paths: _Paths, number: int) -> None:
        """Perturbed maxima of the subtrees that turn off a path."""
        log_p = lattice.log_p[paths.edge]
        sizes = np.diff(paths.start)
        total = np.cumsum(log_p) - log_p
        prefix = total - np.repeat(total[np.minimum(paths.start[:-1], len(total) - 1)] if len(total) else np.zeros(len(sizes)), sizes)
        rest = -np.expm1(np.minimum(log_p, 0.0))
        at = np.arange(len(log_p)) - np.repeat(paths.start[:-1], sizes)
        only = np.repeat(np.zeros(len(sizes), np.int64), sizes)
        for j, t in enumerate(paths.texts.tolist()):
            if t in paths.taken:
                own, barred = paths.taken[t]
                i = paths.start[j] + own
                only[paths.start[j] : i] = 1  # what turns off before belongs to the path that this one came from
                a, b = lattice.edges_into(lattice.end[paths.edge[i]])
                left = np.ones(b - a, dtype=bool)
                left[[x - a for x in (*barred, int(paths.edge[i]))]] = False
                rest[i] = np.exp(lattice.log_p[a:b][left]).sum() if left.any() else 0.0
        # a node with one edge leaves nothing, whatever rounding says
        alone = np.diff(lattice.heads)[lattice.nth[lattice.end[paths.edge]]] == 1
        with np.errstate(divide="ignore"):
            phi = np.where(alone | (only == 1), -np.inf, prefix + np.log(rest))
            owner = np.repeat(paths.texts, sizes)
            u = _uniform(keys[owner], number, at.astype(np.uint64), 1)
            paths.turn = np.where(np.isneginf(phi), -np.inf, _truncated(np.where(np.isneginf(phi), 0.0, phi), np.repeat(paths.value, sizes), u))

    edges, steps = drawn(np.arange(len(flat)), lattice.last[which], 1)
    by_text = np.concatenate([[0], np.cumsum(np.bincount(text_of, steps, n).astype(np.int64))])
    paths = _Paths(np.arange(n), edges, np.repeat(np.arange(len(flat)), steps), by_text, value)
    bound_turns(paths, 1)
    found = [paths]
    emitted: list[list[tuple[int, int]]] = [[(0, t)] for t in range(n)]  # (paths, row) by text
    threshold = np.full(n, -np.inf)
    for number in range(2, k + 2):
        best, where = np.full(n, -np.inf), np.full((n, 2), -1, dtype=np.int64)
        for f, p in enumerate(found):
            rows = np.flatnonzero(np.diff(p.start) > 0)
            if not len(rows):
                continue
            top = np.maximum.reduceat(p.turn, p.start[rows])
            hit = p.turn == np.repeat(top, np.diff(p.start)[rows])
            place = np.flatnonzero(hit)
            row = np.searchsorted(p.start, place, side="right") - 1
            row, first = np.unique(row, return_index=True)
            better = (p.turn[place[first]] > best[p.texts[row]])
            t = p.texts[row[better]]
            best[t] = p.turn[place[first[better]]]
            where[t] = np.stack([np.full(len(t), f), place[first[better]]], axis=1)
        if number == k + 1:
            threshold = best
            break
        go = np.flatnonzero(best > -np.inf)
        # one new edge at each place of turning, then the rest of that unit and all units after it
        own, nodes, units, heads, taken = [], [], [], [], {}
        for t in go.tolist():
            f, i = where[t]
            p = found[f]
            row = int(np.searchsorted(p.texts, t))
            barred = [int(p.edge[i])] + (p.taken[t][1] if t in p.taken and p.start[row] + p.taken[t][0] == i else [])
            a, b = lattice.edges_into(lattice.end[p.edge[i]])
            share = np.exp(lattice.log_p[a:b])
            share[[x - a for x in barred]] = 0
            u = _uniform(keys[t : t + 1], number, np.array([2**40], np.uint64), 0)[0]
            pick = a + int(min(np.searchsorted(np.cumsum(share), u * share.sum(), side="right"), np.flatnonzero(share)[-1]))
            heads.append(np.concatenate([p.edge[p.start[row] : i], [pick]]))
            taken[t] = (int(i - p.start[row]), barred)
            rest = np.arange(p.unit[i], bounds[t + 1])
            units.append(rest)
            nodes.append(np.concatenate([[lattice.start[pick]], lattice.last[which[rest[1:]]]]))
            own.append(p.unit[p.start[row] : i + 1])
            p.turn[i] = -np.inf
        if not len(go):
            continue
        all_units = np.concatenate(units)
        edges, steps = drawn(all_units, np.concatenate(nodes), number)
        per = np.concatenate([[0], np.cumsum([len(x) for x in units])])
        cut = np.concatenate([[0], np.cumsum(steps)])[per]
        new_unit = np.repeat(all_units, steps)
        edge = np.concatenate([x for j, h in enumerate(heads) for x in (h, edges[cut[j] : cut[j + 1]])])
        unit = np.concatenate([x for j, o in enumerate(own) for x in (o, new_unit[cut[j] : cut[j + 1]])])
        sizes = np.array([len(h) + cut[j + 1] - cut[j] for j, h in enumerate(heads)])
        paths = _Paths(go, edge, unit, np.concatenate([[0], np.cumsum(sizes)]), best[go])
        paths.taken = taken
        bound_turns(paths, number)
        for row, t in enumerate(go.tolist()):
            emitted[t].append((len(found), row))
        found.append(paths)

    for f, p in enumerate(found):
        # a path's edges run backwards inside a unit
        position = np.arange(len(p.edge))
        turn = np.concatenate([[0], np.flatnonzero(np.diff(p.unit)) + 1, [len(p.edge)]]) if len(p.edge) else np.zeros(1, np.int64)
        sizes = np.diff(turn)
        flipped = np.repeat(turn[:-1] + turn[1:] - 1, sizes) - position
        ids, count = lattices.expand(lattice.ids[p.edge[flipped]])
        cut = np.concatenate([[0], np.cumsum(count)])[p.start]
        log_p = np.concatenate([[0.0], np.cumsum(lattice.log_p[p.edge])])[p.start]
        for row, t in enumerate(p.texts.tolist()):
            total = float(log_p[row + 1] - log_p[row])
            x = total - threshold[t]
            inclusion = 0.0 if threshold[t] == -np.inf else (x if x < -30 else float(np.log(-np.expm1(-np.exp(x)))))
            out[t].append((ids[cut[row] : cut[row + 1]], total, float(p.value[row]), inclusion))
    return out


def row_key(doc_id: object, seed: int = SEED) -> int:
    return xxhash.xxh64_intdigest(str(doc_id).encode(), seed)


SCHEMA = "doc_id long, sample int, n_pieces int, log_prob double, perturbed double, log_inclusion double, ids array<int>"


def sampled_encodings(docs: DataFrame, k: int = SAMPLES, theta: float = THETA, seed: int = SEED, path: str | None = None) -> DataFrame:
    """Up to k rows per row of docs: doc_id, sample (from 1), n_pieces, log_prob, perturbed, log_inclusion, ids."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices.at(path, theta)
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in text_slices(texts, 1 << 18):
                found = sample(lattices, texts[a:b], np.array([row_key(d, seed) for d in doc_ids[a:b]], dtype=np.uint64), k)
                rows = [(d, i + 1, *s) for d, samples in zip(doc_ids[a:b], found, strict=True) for i, s in enumerate(samples)]
                ids = [r[2].astype(np.int32) for r in rows]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(np.diff(offsets), pa.int32()),
                        pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.float64()), pa.array([r[5] for r in rows], pa.float64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))),
                    ],
                    names=["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids"],
                )

    return texts_of(docs).mapInArrow(run, SCHEMA)


def decoded(encodings: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, sample and the text that the ids stand for."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Lattices.at(path, THETA).sp
        for batch in batches:
            texts = [sp.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), pa.array(texts, pa.string())], names=["doc_id", "sample", "text"])

    return encodings.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")
