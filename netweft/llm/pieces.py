"""SentencePiece encoding and decoding, with distinct sampled segmentations by Gumbel top-k without replacement.

Encoding. The text, with spaces as U+2581, is cut before every run of spaces and around line ends. No piece of the
vocabulary crosses such a cut (checked when the model is loaded), so encoding the units one by one with the library, each
distinct unit once, gives the ids that the library gives for the whole text.

Lattice. Of a unit: every vocabulary piece that matches at a position is an edge; a character without a piece has one edge,
its bytes. The lattice of the text is the chain of its units' lattices, which hold every segmentation of the text, as no
piece crosses a cut. A piece of rank r has weight (r + 1)^-alpha, a segmentation the product of its weights, and the weights
of the segmentations of the text are normalised to probabilities. The lattices of all distinct units of some texts are built
together: forward sums, position after position for all units at once, give the probability of every edge among those
that end where it ends, so nothing is listed, however long the unit.

Sampling. Choices are made unit by unit, and from a unit's end to its start. A prefix of choices stands for all segmentations
that begin with it; its log-probability is known exactly, so is the distribution of the largest Gumbel-perturbed
log-probability below it. A-star search pops the prefix with the largest perturbed bound: the child that carries the bound
is followed to the end, and the other children of each step enter the frontier with a bound drawn below it (truncated
Gumbel). The first k ends are k distinct segmentations, sampled without replacement. With kappa the (k+1)-th bound, a
segmentation's inclusion score is 1 - exp(-exp(logp - kappa)). The searches of many texts go round by round, so that all
units of all texts are drawn side by side. Draws are a counter-based hash of the seed, the row key and the place in the
search, so they don't depend on the texts beside.

A narrow map without shuffle; memory holds a batch of rows, the lattices of about ``CHARACTERS`` characters of text (or of one
longer text) and a bounded cache of encoded units.

Defined results: null and empty texts have no ids, one (empty) segmentation, and decode to ''; a text with fewer than k
segmentations gives all of them with inclusion score 1; a null key counts as 0; repeated rows repeat their samples;
U+2581 in a text decodes to a space (round_trip is then false); extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweft.llm.common import giving_back

SPACE = "▁"
CACHE = 500_000
GROUP = 64
CHARACTERS = 2_000_000
STEP, UNITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
ONE = int(UNITS)
SLOTS = 18  # log of the size of the table of the pieces' beginnings


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The model's pieces, and encoding and decoding with them."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.alpha = alpha
        self.plain = {self.sp.id_to_piece(i): i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.plain):
            raise ValueError("a piece crosses a unit's bound")
        self.names = {i: p for p, i in self.plain.items()}
        self.bytes_of = [bytes([int(self.sp.id_to_piece(i)[3:-1], 16)]) if self.sp.is_byte(i) else self.names.get(i, "").replace(SPACE, " ").encode() for i in range(n)]
        self.raw = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.raw_size = np.array([len(b) for b in self.bytes_of], np.int32)
        self.raw_begin = np.cumsum(self.raw_size, dtype=np.int32) - self.raw_size
        self.line_end = self.sp.encode("\n")[-1:]
        self.lead = len(self.sp.encode("\n")) - 1  # ids that a text has before its first line end
        self.forget()
        self.weight = -alpha * np.log1p(-np.array([self.sp.get_score(i) for i in range(n)]))
        self.byte_of = np.array([self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        # The beginnings of pieces are numbered from 1 (0: nothing yet). A table with open addressing leads from the number of
        # a beginning and the next character to the longer beginning's number.
        begun = {p[:i] for p in self.plain for i in range(1, len(p) + 1)}
        number = {b: i for i, b in enumerate(sorted(begun, key=lambda b: (len(b), b)), 1)}
        if len(number) >= 1 << SLOTS - 1:
            raise ValueError("the table of beginnings is too small for this vocabulary")
        self.complete = np.full(len(number) + 1, -1, np.int32)  # the piece that a beginning is
        self.steps = np.full(1 << SLOTS, -1, np.int64)
        for b, i in number.items():
            self.complete[i] = self.plain.get(b, -1)
            key = number.get(b[:-1], 0) << 21 | ord(b[-1])
            slot = key * int(STEP) % 2**64 >> 64 - SLOTS
            while self.steps[slot] >= 0:
                slot = (slot + 1) % (1 << SLOTS)
            self.steps[slot] = key << 20 | i

    def longer(self, begun: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Numbers of the beginnings that the characters make of these; 0 where no piece begins so."""
        key = begun << 21 | points
        slot = (key.view(np.uint64) * STEP >> np.uint64(64 - SLOTS)).view(np.int64)
        got = self.steps[slot]
        same = got >> 20 == key
        other = np.flatnonzero(~same & (got >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) % (1 << SLOTS)
            got[other] = self.steps[slot[other]]
            same[other] = got[other] >> 20 == key[other]
            other = other[~same[other] & (got[other] >= 0)]
        return np.where(same, got & 0xFFFFF, 0)

    def matches(self, points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: places of the characters where a piece of that length begins, and the pieces."""
        out, live, begun = [], np.arange(len(points)), np.zeros(len(points), np.int64)
        padded = np.append(points, np.zeros(1, np.int64))
        while len(live):
            begun = self.longer(begun, padded[live + len(out)])
            on = np.flatnonzero(begun)
            live, begun = live[on], begun[on]
            piece = self.complete[begun]
            whole = np.flatnonzero(piece >= 0)
            out.append((live[whole], piece[whole]))
            on = np.flatnonzero(live + len(out) < len(points))
            live, begun = live[on], begun[on]
        return out

    def forget(self) -> None:
        """Empties the cache of encoded units: their numbers, their ids one unit after the other, and where a unit's ids begin."""
        self.units: dict[str, int] = {"\n": 0}
        self.flat, self.begins = [np.array(self.line_end, np.int32)], [np.array([0, len(self.line_end)])]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of encoded units in one array, and where those of each of the units begin and end. Line ends part new units,
        so the library encodes many in one text."""
        if len(self.units) > CACHE:
            self.forget()
        new = [u for u in units if u not in self.units]
        if new:
            groups = ["\n" + "\n".join(new[i : i + GROUP]) for i in range(0, len(new), GROUP)]
            flat = np.array(list(chain.from_iterable(self.sp.encode(groups, num_threads=1))), np.int32)
            # a group is a space of its own, then a line end before each unit
            ends = flat == self.line_end[0]
            if int(ends.sum()) != len(new):
                raise RuntimeError("a unit's ids hold a line end")
            ends = np.flatnonzero(ends)
            past = np.append(ends[1:], len(flat))
            past[GROUP - 1 : -1 : GROUP] -= self.lead
            self.units.update(zip(new, range(len(self.units), len(self.units) + len(new))))
            base = sum(map(len, self.flat))
            self.flat.append(flat)
            self.begins.append(np.stack([ends + 1 + base, past + base], axis=1).ravel())
        self.flat, self.begins = [np.concatenate(self.flat)], [np.concatenate(self.begins)]
        found = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        return self.flat[0], self.begins[0][2 * found], self.begins[0][2 * found + 1]

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids stand for, and where those of each id end."""
        sizes = self.raw_size[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat(self.raw_begin[ids] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.raw[at], ends

    def decode(self, ids) -> str:
        raw = b"".join(itemgetter(*ids)(self.bytes_of)) if len(ids) > 1 else b"".join(self.bytes_of[i] for i in ids)
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")

    def spelt(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the edges' pieces, where a character's edge gives the ids of its bytes, and how many each edge gives."""
        n, sizes = len(self.weight), np.ones(len(pieces), np.int64)
        chars = np.flatnonzero(pieces >= n)
        if not len(chars):
            return pieces.astype(np.int32), sizes
        codes = pieces[chars] - n
        sizes[chars] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        begins = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        out[begins] = np.where(pieces < n, pieces, 0)
        out[begins[chars]] = self.byte_of[np.minimum(codes, 255)]
        for i in np.flatnonzero(codes >= 0x80):
            at = int(begins[chars[i]])
            raw = list(chr(codes[i]).encode())
            out[at : at + len(raw)] = self.byte_of[raw]
        return out, sizes


@lru_cache(2)
def vocabulary_of(path: str, alpha: float) -> Vocabulary:
    """A Python worker loads a model once."""
    return Vocabulary(path, alpha)


def cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of some texts, the place of every text's units among them, and the number of units before each text
    (and before the end). A text that isn't empty begins with a space of its own."""
    raw = [(" " + t.replace(SPACE, " ")).encode() if t else b"" for t in texts]
    joined = b"".join(raw)
    given = np.frombuffer(joined, np.uint8)
    past = np.cumsum([0, *map(len, raw)])
    begun = np.zeros(len(given) + 1, bool)
    begun[past] = True
    line, space = given == 10, given == 32
    begun[:-1] |= line
    begun[1:] |= line
    begun[1:-1] |= space[1:] & ~space[:-1]
    begins = np.flatnonzero(begun).astype(np.int64)
    begins, ends, n = begins[:-1], begins[1:], len(given)
    # Equal units have one polynomial hash of 64 bits, whatever their place; that units of one hash are equal is checked.
    power = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((given + np.uint64(1)) * power[:n], out=sums[1:])
    index, distinct = pd.factorize((sums[ends] - sums[begins]) * power[n - begins])
    first = np.zeros(len(distinct), np.int64)
    first[index[::-1]] = np.arange(len(index) - 1, -1, -1)
    sizes = ends - begins
    same = np.repeat(begins[first[index]] - begins, sizes)
    same += np.arange(n)
    if (sizes != sizes[first[index]]).any() or (given != given[same]).any():
        raise RuntimeError("different units have one hash")
    return [joined[a:b].decode() for a, b in zip(begins[first].tolist(), ends[first].tolist())], index, np.searchsorted(np.append(begins, n), past)


@lru_cache(1)
def _powers_of(size: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(size, STEP)))


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, 0 to n at least."""
    return _powers_of(1 << max(20, n.bit_length()))


def _hash(z: np.ndarray) -> np.ndarray:
    z = z ^ z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _hash_one(z: int) -> int:
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & 2**64 - 1
    z = (z ^ z >> 27) * 0x94D049BB133111EB & 2**64 - 1
    return z ^ z >> 31


def _uniform_one(z: int) -> float:
    return ((_hash_one(z & 2**64 - 1) >> 11) + 0.5) * 2.0**-53


def _uniform(z: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), one for each counter."""
    u = (_hash(z) >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


class Lattices:
    """The lattices of some units. A node is a place between characters; a node's edges are the pieces that end there, the
    longest first."""

    def __init__(self, vocabulary: Vocabulary, units: list[str]) -> None:
        joined = "\n".join([*units, ""]).replace(" ", SPACE)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = starts + sizes
        found = vocabulary.matches(points)
        n = len(vocabulary.weight)
        # characters without a piece of their own
        alone = np.ones(len(points), bool)
        alone[self.ends] = False
        if found:
            alone[found[0][0]] = False
        alone = np.flatnonzero(alone)
        found.append((alone, points[alone] + n))
        lengths = [*range(1, len(found)), 1]

        # nodes in the order of the distance from their unit's start; edges grouped by the node where they end
        self.counts = np.zeros(len(points) + 1, np.int32)
        for (at, _), size in zip(found, lengths):
            self.counts[at + size] += 1
        nodes = np.flatnonzero(self.counts)
        depth = nodes - np.repeat(starts, sizes + 1)[nodes - 1]
        kind = np.int16 if len(depth) == 0 or depth.max() < 32_000 else np.int64
        nodes = nodes[np.argsort(depth.astype(kind), kind="stable")]
        counts = self.counts[nodes].astype(np.int64)
        ends = np.cumsum(counts)
        begins, total = ends - counts, int(counts.sum())
        self.first = np.zeros(len(points) + 1, np.int64)
        self.first[nodes] = begins
        place, packed = self.first.copy(), np.zeros(total, np.int64)
        for (at, piece), size in [*reversed(list(zip(found, lengths))[:-1]), (found[-1], 1)]:
            edge = place[at + size]
            place[at + size] += 1
            packed[edge] = at << 21 | piece
        before, self.piece = packed >> 21, packed & 0x1FFFFF
        weight = vocabulary.weight[np.minimum(self.piece, n - 1)]
        chars = np.flatnonzero(self.piece >= n)
        if len(chars):
            which, at = np.unique(self.piece[chars], return_inverse=True)
            weight[chars] = np.array([vocabulary.weight[vocabulary.byte_of[list(chr(c - n).encode())]].sum() for c in which])[at]

        # forward sums, for all nodes at the same distance at once
        own = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
        mass, probs, logs, a = np.zeros(len(points) + 1), np.zeros(total), np.zeros(total), 0
        for b in (np.cumsum(np.bincount(depth)) if len(depth) else [0])[1:]:
            e, f = int(begins[a]), int(ends[b - 1])
            group, which = begins[a:b] - e, own[e:f] - a
            x = mass[before[e:f]]
            x += weight[e:f]
            top = np.maximum.reduceat(x, group)
            x -= top[which]
            p = np.exp(x)
            sums = np.add.reduceat(p, group)
            p /= sums[which]
            probs[e:f] = p
            sums = np.log(sums)
            x -= sums[which]
            logs[e:f] = x
            mass[nodes[a:b]] = top + sums
            a = int(b)
        self.logs, self.probs = np.minimum(logs, 0.0, out=logs), probs
        sums = np.cumsum(probs)
        sums -= np.repeat(sums[begins] - probs[begins], counts)
        sums[ends - 1] = 1
        self.sums, self.nodes, self.own = sums, nodes, own
        # what is left beside a probable edge is added up, not subtracted from 1
        self.left = np.add.reduceat(np.where(probs > 0.5, 0.0, probs), begins) if total else probs
        begun = np.zeros(len(points) + 1, bool)
        begun[starts] = True
        self.next = np.where(begun[before], -1, before)  # the node that an edge leads to, -1 past the unit

    def rests(self, edges: np.ndarray) -> np.ndarray:
        """Log of the probability of all other edges that end where these end."""
        p = self.probs[edges]
        with np.errstate(divide="ignore"):
            return np.where(p > 0.5, np.log(self.left[self.own[edges]]), np.log1p(-np.minimum(p, 0.5)))

    def draw(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one path from each of the nodes, one path after the other, and the number of each path's edges."""
        live, at, n, steps = np.arange(len(nodes)), nodes, np.zeros(len(nodes), np.int64), []
        while len(live):
            seeds = seeds + STEP
            u = _uniform(seeds)
            found = self.first[at]
            on = np.flatnonzero(u >= self.sums[found])
            while len(on):
                found[on] += 1
                on = on[u[on] >= self.sums[found[on]]]
            steps.append((live, found))
            n[live] += 1
            to = self.next[found]
            on = np.flatnonzero(to >= 0)
            live, at, seeds = live[on], to[on], seeds[on]
        out, begin = np.zeros(int(n.sum()), np.int64), np.cumsum(n) - n
        for i, (who, found) in enumerate(steps):
            out[begin[who] + i] = found
        return out, n


def _below(mass, limit, u):
    """Largest of Gumbel variables whose log-masses add up to ``mass``, given that it is below ``limit``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.log(np.exp(np.minimum(mass - limit, 700.0)) - np.log(u)))


def _below_one(mass: float, limit: float, u: float) -> float:
    return mass - math.log(math.exp(min(mass - limit, 700.0)) - math.log(u))


class _Path:
    """A path: its edges, how many each unit has, its perturbed log-probability, and the bounds of the children that were not
    taken at its steps (steps past the end of ``bound`` can't come into play)."""

    __slots__ = ("edges", "counts", "value", "bound", "taken", "best")

    def __init__(self, edges, counts, value, bound) -> None:
        self.edges, self.counts, self.value, self.bound, self.taken = edges, counts, value, bound, {}
        self.best = float(bound.max(initial=-np.inf))


class _Search:
    """The search of one text, a round at a time. ``units``: places of its units among those of the lattices."""

    def __init__(self, lattices: Lattices, units: np.ndarray, k: int, seed: int) -> None:
        self.lattices, self.ends, self.k, self.key = lattices, lattices.ends[units], k, seed
        self.paths: list[_Path] = []
        self.kappa, self.round = -np.inf, 0
        # the prefix from which the current path goes on: its edges, the counts of its units, the node within the last of
        # them (-1: its end), its log-probability and the perturbed bound
        self.head, self.head_counts, self.node, self.prefix = np.zeros(0, np.int64), np.zeros(0, np.int64), -1, 0.0
        self.value = -math.log(-math.log(_uniform_one(self.seed(0))))

    def seed(self, purpose: int) -> int:
        return _hash_one((4 * self.round + purpose + 1) * int(STEP) + self.key & 2**64 - 1)

    def wanted(self) -> np.ndarray:
        """Nodes from which the rest of the current path is drawn."""
        nodes = self.ends[len(self.head_counts) :]
        return np.append(self.node, nodes) if self.node >= 0 else nodes

    def drawn(self, edges: np.ndarray, counts: np.ndarray, bound: np.ndarray) -> None:
        """Takes the rest of the path, with the bounds of the children that were not taken."""
        own = self.head_counts
        if len(self.head):
            edges, bound = np.concatenate([self.head, edges]), np.concatenate([np.full(len(self.head), -np.inf), bound])
            if self.node >= 0:
                own, counts = np.append(own[:-1], own[-1] + counts[0]), counts[1:]
            counts = np.concatenate([own, counts])
        self.paths.append(_Path(edges, counts, self.value, bound))

    def advance(self) -> bool:
        """Pops the best prefix of the frontier; whether another path is to be drawn."""
        path = max(self.paths, key=lambda p: p.best)
        value = path.best
        if value == -np.inf:
            return False
        if len(self.paths) == self.k:
            self.kappa = value
            return False
        self.round += 1
        lattices, j = self.lattices, int(path.bound.argmax())
        node = int(lattices.nodes[lattices.own[path.edges[j]]])
        low = int(lattices.first[node])
        each = lattices.logs[low : low + int(lattices.counts[node])].tolist()
        taken = path.taken.setdefault(j, [int(path.edges[j]) - low])
        left = [0.0 if i in taken else math.exp(x) for i, x in enumerate(each)]
        seed = self.seed(3)
        u = _uniform_one(seed) * sum(left)
        for i, x in enumerate(left):
            if x:
                c = i
                u -= x
                if u < 0:
                    break
        taken.append(c)
        left[c] = 0.0
        prefix, mass = float(lattices.logs[path.edges[:j]].sum()), sum(left)
        path.bound[j] = _below_one(prefix + math.log(mass), value, _uniform_one(seed + ONE)) if len(taken) < len(each) and mass > 0 else -np.inf
        path.best = float(path.bound.max())
        past = np.cumsum(path.counts)
        unit = int(np.searchsorted(past, j, "right"))
        own = path.counts[: unit + 1].copy()
        own[unit] = j + 1 - (past[unit] - path.counts[unit])
        self.head, self.head_counts = np.append(path.edges[:j], low + c), own
        self.node, self.prefix, self.value = int(lattices.next[low + c]), prefix + each[c], value
        return True


def _bounds(active: list[_Search], edges: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Bounds of the children that were not taken, for the new path of each search.

    A Gumbel draw from 53 random bits lies within (-4, 37) of its log-mass, so steps far below the best ones can't be among
    the first k + 1. Log-masses fall below that of the prefix, so most texts are settled by the beginning of the path;
    others are looked at again with more steps.
    """
    lattices, k = active[0].lattices, active[0].k
    begins, sizes = ends[:-1], np.diff(ends)
    out: list[np.ndarray] = [np.zeros(0)] * len(active)
    todo, m = np.arange(len(active)), 56
    prefix, value = np.array([s.prefix for s in active]), np.array([s.value for s in active])
    seeds = np.array([s.seed(2) for s in active], np.uint64)
    while len(todo):
        m = min(m, max(1, int(sizes[todo].max())))
        column = np.arange(m)
        inside = column < sizes[todo, None]
        at = np.where(inside, begins[todo, None] + column, 0)
        some = edges[at] if len(edges) else at
        logs = np.where(inside, lattices.logs[some], 0.0) if len(edges) else np.zeros(at.shape)
        mass = np.cumsum(logs, axis=1)
        mass += prefix[todo, None]
        last = mass[:, -1].copy()
        mass -= logs
        if len(edges):
            mass += lattices.rests(some)
        mass[~inside] = -np.inf
        least = np.partition(mass, m - k - 1, axis=1)[:, m - k - 1] - 45 if m > k else np.full(len(todo), -np.inf)
        settled = (sizes[todo] <= m) | (last < least)
        row, at = np.nonzero((mass >= least[:, None]) & inside & settled[:, None])
        bound = np.full(mass.shape, -np.inf)
        who = todo[row]
        bound[row, at] = _below(mass[row, at], value[who], _uniform(seeds[who] + at.astype(np.uint64) * UNITS))
        for i in np.flatnonzero(settled).tolist():
            out[todo[i]] = bound[i, : sizes[todo[i]]]
        todo, m = todo[~settled], 4 * m
    return out


def sample(lattices: Lattices, vocabulary: Vocabulary, units: np.ndarray, bounds: np.ndarray, keys: list[int | None], k: int, seed: int) -> tuple[list[list[tuple[float, float]]], list[float], np.ndarray, np.ndarray]:
    """For each text, given by its units: up to k (log-probability, perturbed log-probability), the largest first, and kappa
    (-inf if there are no more). Then the ids of all samples, one after the other, and the bounds of the samples."""
    base = _hash_one(seed + int(STEP) & 2**64 - 1)
    seeds = [_hash_one(base + int(key or 0) * int(STEP) & 2**64 - 1) for key in keys]
    every = [_Search(lattices, units[a:b], k, s) for a, b, s in zip(bounds, bounds[1:], seeds)]
    active = every
    while active:
        wanted = [s.wanted() for s in active]
        sizes = np.array([len(w) for w in wanted])
        past = np.cumsum(sizes)
        walkers = np.repeat(np.array([s.seed(1) for s in active], np.uint64), sizes)
        walkers += (np.arange(len(walkers)) - np.repeat(past - sizes, sizes)).astype(np.uint64) * UNITS
        edges, counts = lattices.draw(np.concatenate(wanted), walkers)
        past = np.append(0, past)
        ends = np.append(0, np.cumsum(counts))[past]
        limits = _bounds(active, edges, ends)
        past, ends = past.tolist(), ends.tolist()
        for s, bound, a, b, x, y in zip(active, limits, past, past[1:], ends, ends[1:]):
            s.drawn(edges[x:y], counts[a:b], bound)
        active = [s for s in active if s.advance()]

    # every path's edges in the order of the text: a unit's are drawn from its end
    paths = [p for s in every for p in s.paths]
    edges, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([p.edges for p in paths], [p.counts for p in paths]))
    ends = np.cumsum(counts)
    order = np.repeat(2 * ends - counts - 1, counts) - np.arange(len(edges))
    ids, sizes = vocabulary.spelt(lattices.piece[edges[order]])
    bounds = np.append(0, np.cumsum(sizes))[np.cumsum([0, *(len(p.edges) for p in paths)])]
    return [[(float(lattices.logs[p.edges].sum()), p.value) for p in s.paths] for s in every], [s.kappa for s in every], ids, bounds


def inclusion(log_prob: float, kappa: float) -> float:
    """Log of the inclusion score 1 - exp(-exp(logp - kappa))."""
    if kappa == -np.inf:
        return 0.0
    x = log_prob - kappa
    return float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x


def segment(vocabulary: Vocabulary, texts: list[str], keys: list[int | None], k: int, seed: int) -> list[tuple[np.ndarray, list[tuple[np.ndarray, float, float]], float, bool]]:
    """For each text: its ids, up to k samples (ids, log-probability, perturbed log-probability), kappa, and whether all of
    them decode to the text."""
    distinct, units, bounds = cut(texts)
    flat, begins, ends = vocabulary.encode_units(distinct)
    each = (ends - begins)[units]
    past = np.cumsum(each)
    own = flat[np.repeat(begins[units] - past + each, each) + np.arange(int(each.sum()))]
    own_bounds = np.append(0, past)[bounds]
    found, kappas, ids, ends = sample(Lattices(vocabulary, distinct), vocabulary, units, bounds, keys, k, seed)

    def parts(ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, bytes]]:
        raw, past = vocabulary.spell(ids)
        at = np.append(0, past)[bounds].tolist()
        bounds = bounds.tolist()
        for a, b, x, y in zip(bounds, bounds[1:], at, at[1:]):
            yield ids[a:b], raw[x:y].tobytes()

    encoded, sampled, out = parts(own, own_bounds), parts(ids, ends), []
    for text, ways, kappa, (mine, raw) in zip(texts, found, kappas, encoded):
        want = (" " + text).encode() if text else b""
        same, samples = raw == want, []
        for (log_prob, value), (way, raw) in zip(ways, sampled):
            same &= raw == want
            samples.append((way, log_prob, value))
        out.append((mine, samples, kappa, same))
    return out


def _rows(vocabulary: Vocabulary, keys: list, texts: list[str], k: int, seed: int, characters: int = CHARACTERS):
    """``segment`` for so many texts at a time as make up ``characters`` characters."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= characters):
            size += len(texts[end])
            end += 1
        # many small objects and no cycles: the collector would walk them over and over
        was_on = gc.isenabled()
        gc.disable()
        try:
            found = segment(vocabulary, texts[begin:end], keys[begin:end], k, seed)
        finally:
            if was_on:
                gc.enable()
        yield from found
        begin = end


SAMPLES = "samples array<struct<ids:array<int>,log_prob:double,perturbed:double,log_inclusion:double>>"


def _full(model: str, k: int, alpha: float, seed: int):
    kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model, alpha)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            ids, samples = [], []
            for own, found, kappa, _ in _rows(vocabulary, keys, texts, k, seed):
                ids.append(own)
                samples.append([{"ids": x, "log_prob": p, "perturbed": g, "log_inclusion": inclusion(p, kappa)} for x, p, g in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(samples, kind)], ["doc_id", "ids", "samples"])

    return run


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str | None = None, k: int = 3, alpha: float = 1.0, seed: int = 7) -> DataFrame:
    """doc_id, ids of the text, and its sampled segmentations."""
    return _given(docs).mapInArrow(giving_back(_full(model or default_model(), k, alpha, seed)), f"doc_id long, ids array<int>, {SAMPLES}")


def decode(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id and the text that the ids spell."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path, 1.0)
        for batch in batches:
            texts = [vocabulary.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, n_samples int, sample_tokens array<long>, sample_sha256 array<string>, log_probs array<double>, log_inclusion array<double>, round_trip boolean"


def _digest(model: str, k: int, alpha: float, seed: int, characters: int):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.bool_()]
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model, alpha)
        sha = lambda ids: hashlib.sha256(ids.astype("<i4", copy=False)).hexdigest()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for key, (ids, found, kappa, same) in zip(keys, _rows(vocabulary, keys, texts, k, seed, characters)):
                rows.append((key, len(ids), sha(ids), len(found), [len(x) for x, _, _ in found], [sha(x) for x, _, _ in found], [p for _, p, _ in found], [inclusion(p, kappa) for _, p, _ in found], same))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return run


def digest(docs: DataFrame, model: str | None = None, k: int = 3, alpha: float = 1.0, seed: int = 7, characters: int = CHARACTERS) -> DataFrame:
    """``encode`` followed by ``decode`` in one map: token counts, SHA-256 of the ids (little-endian int32) of the encoding
    and of every sample, log-probabilities, log inclusion scores, and whether all of them decode to the text. With
    fewer ``characters`` at a time a worker holds less and takes some 7 percent longer; results are the same."""
    return _given(docs).mapInArrow(giving_back(_digest(model or default_model(), k, alpha, seed, characters)), DIGEST)
