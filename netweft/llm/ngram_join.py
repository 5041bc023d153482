"""N-gram Jaccard join by prefix trees, with the classes that its links form.

A text's set holds its distinct shingles of ``size`` words (fewer words: the whole sequence as one; no words: empty, linked
with nothing). Two texts link when 100 * intersection >= percent * union.

1. Sets. Each input block turns texts into sets of 64-bit shingle hashes; equal sets of a task are kept once.
2. Document frequencies. Shingles are dealt by the high bits of their hash, in packed blocks, to owners that count them. An
   owner answers with the shingles that occur in more than one set; a shingle of one set can't be in an intersection, so
   it only counts towards the size. Shingles keep all 64 bits throughout.
3. Prefix filter. A set of n shingles that links with another shares one of its n - ceil(percent * n) + 1 rarest shingles
   with it. Sets whose rarest shingles are all their own are done. The others, equal ones merged, are put into candidate
   classes: components of the graph in which sets that share a prefix shingle are chained in the order of their sizes, as
   long as neighbouring sizes can link. No link can cross two candidate classes.
4. Prefix tree. The sets of a candidate class, ordered by frequency inside the class, are stored in a trie one after the
   other, each after it has been joined with those before it. A join walks the trie, adds up the overlap that all sets below
   a node share, and leaves a subtree when even the remaining lengths can't give the overlap needed. Links merge classes at
   once, and a subtree whose sets are all in the class of the set that asks is left, so a group of m near copies costs
   about m short walks and not m^2 comparisons.
5. A candidate class of more than ``most`` sets or ``room`` bytes is joined block by block (see ``_large``); no task holds
   more than one block and a chunk of the sets that ask it. Blocks are dealt by counts of sizes, never by a sort of the class.

Links between sets are never listed in full; every link is honoured in the classes.

Defined results: null text is empty; repeated rows and equal texts are one set; component_id is the smallest doc_id of
the class, null only where all its ids are null; an empty table gives no rows; extra columns are ignored. Different shingles
count as equal only if their 64-bit hashes are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweft.llm.common import giving_back, materialise
from netweft.operators.components import connected_components
from netweft.operators.tables import cut, discard, release

#: Lower-cases A-Z and maps the blanks to a space; other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
WORD_SEED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
BLOCK_TOKENS = 1_000_000
OWNER_TOKENS = 2_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sets of shingle hashes; word hashes are kept in a bounded cache."""

    def __init__(self, size: int) -> None:
        self.size, self.words = size, {}

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.words
        if len(cache) > 300_000:
            cache.clear()
        while True:
            try:
                h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                break
            except KeyError:
                for w in words:
                    if w not in cache:
                        cache[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        k = min(self.size, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = (out + h[j : j + n]) * WORD_SEED[j % 8]
        return np.unique(_mix(out))


def needed(a, b, percent: int):
    """Smallest overlap with which sets of a and b shingles link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


PACKED = "target long, block long, data binary"


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["target", "block", "data"])


def _sets(size: int, owners: int):
    """Blocks of sets: for each owner the shingles it counts, and one row with the rows of the block (target -1 - block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        shingler, seen = Shingler(size), {}
        row = block = tokens = 0
        meta, sets = [], []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, tokens, meta, sets
            at = part << 33 | block
            out = [(-1 - at, at, pickle.dumps(meta))]
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            doc = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            owner = ((flat >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            flat, doc = flat[order], doc[order]
            ends = np.searchsorted(owner[order], np.arange(owners + 1))
            for o in range(owners):
                a, b = ends[o], ends[o + 1]
                if b > a:
                    counts = np.bincount(doc[a:b], minlength=len(sets)).astype(np.uint16 if b - a < 65_536 else np.uint32)
                    out.append((o, at, pickle.dumps((counts, flat[a:b]))))
            block, tokens, meta, sets = block + 1, 0, [], []
            for i in range(0, len(out), 64):
                yield _packed(out[i : i + 64])

        for batch in batches:
            ids, texts, keys = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for k in range(batch.num_rows):
                own = shingler.of(texts[k].as_py())
                same = blake2b(own.tobytes(), digest_size=16).digest()
                rid = part << 33 | row
                row += 1
                rep = seen.setdefault(same, rid)
                if len(seen) > 300_000:
                    seen.clear()
                meta.append((rid, ids[k], len(own), same, rep, keys[k]))
                if rep == rid:
                    sets.append(own)
                    tokens += len(own)
                if tokens >= BLOCK_TOKENS or len(meta) >= 100_000:
                    yield from close()
        yield from close()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owners: shingles of each block that occur in more than one set, with their frequency; block rows pass through."""
    held: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for target, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if target < 0:
                yield _packed([(target, block, data)])
            else:
                held.setdefault(target, []).append((block, *pickle.loads(data)))
    for target in sorted(held):
        pieces = held.pop(target)
        every = np.sort(np.concatenate([tokens for _, _, tokens in pieces]))
        starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        times = np.diff(np.append(starts, len(every)))
        more = times > 1
        shared, times = every[starts[more]], np.minimum(times[more], 65_535).astype(np.uint16)
        del every, starts, more
        for block, counts, tokens in pieces:
            if len(shared):
                at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
                hit = shared[at] == tokens
                doc = np.repeat(np.arange(len(counts)), counts)[hit]
                yield _packed([(target, block, pickle.dumps((np.bincount(doc, minlength=len(counts)).astype(counts.dtype), tokens[hit], times[at[hit]])))])


SETS = "rid long, doc_id long, n long, key binary, rep long, row long, prefix array<long>, shared binary"


def _filter(percent: int):
    """Blocks put together again: the rows, with the shared shingles of sets that the prefix filter leaves."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("rep", pa.int64()), ("row", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shared", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas: dict[int, list] = {}
        parts: dict[int, list] = {}
        for batch in batches:
            for target, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if target < 0:
                    metas[block] = pickle.loads(data)
                else:
                    parts.setdefault(block, []).append(pickle.loads(data))
        for block in sorted(metas):
            meta, found = metas.pop(block), parts.pop(block, [])
            n_sets = sum(m[0] == m[4] for m in meta)
            doc = np.concatenate([np.zeros(0, np.int64), *(np.repeat(np.arange(n_sets), c) for c, _, _ in found)])
            token = np.concatenate([np.zeros(0, np.int64), *(tokens.view(np.int64) for _, tokens, _ in found)])
            times = np.concatenate([np.zeros(0, np.uint16), *(x for *_, x in found)])
            order = np.lexsort((token, times, doc))
            token = token[order]
            ends = np.searchsorted(doc[order], np.arange(n_sets + 1))
            out, k, size = [], 0, 0
            for rid, doc_id, n, key, rep, own_row in meta:
                row = {"rid": rid, "doc_id": doc_id, "n": n, "key": key, "rep": rep, "row": own_row, "prefix": None, "shared": None}
                if rid == rep:
                    own = token[ends[k] : ends[k + 1]]
                    k += 1
                    # rarest first: shingles of this set alone, then the shared ones
                    left = n + (-percent * n // 100) + 1 - (n - len(own))
                    if n and left > 0:
                        row["prefix"], row["shared"] = own[:left], own.tobytes()
                        size += len(own)
                out.append(row)
                if size > 500_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


class _Node:
    __slots__ = ("of", "start", "end", "kids", "ids", "low", "high", "longest", "one")

    def __init__(self, of: int, start: int, end: int, n: int, longest: int, ids: list[int]) -> None:
        self.of, self.start, self.end, self.kids, self.ids = of, start, end, {}, ids
        self.low = self.high = n  # sizes of the sets below
        self.longest = longest  # most shared shingles that a set below has after this node
        self.one = of  # a set below, where all are in its class; else -1


class PrefixTree:
    """A compressed trie of ordered sets that are joined as they come, and the classes of their links."""

    def __init__(self, sets: list[np.ndarray], n: list[int], percent: int, width: int, parent: list[int] | None = None) -> None:
        self.sets, self.n, self.percent = sets, n, percent
        self.parent = list(range(len(sets))) if parent is None else parent
        self.mark = np.zeros(width + 1, bool)
        self.top: dict[int, _Node] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def merge(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def join(self, x: int) -> None:
        """Merge the classes of x and of all sets in the tree that link with it."""
        own, n, percent, find = self.sets[x], self.n[x], self.percent, self.find
        self.mark[own] = True
        stack = [(node, 0) for node in self.top.values()]
        while stack:
            node, overlap = stack.pop()
            if node.high * 100 < percent * n or n * 100 < percent * node.low:
                continue
            if node.one >= 0 and find(node.one) == find(x):
                continue
            seg = self.sets[node.of][node.start : node.end]
            if len(seg):
                overlap += int(np.count_nonzero(self.mark[seg]))
                after = len(own) - int(np.searchsorted(own, seg[-1], "right"))
            else:
                after = len(own)
            least = needed(n, max(node.low, -(-percent * n // 100)), percent)
            if overlap + min(after, node.longest) < least:
                continue
            for y in node.ids:
                if overlap >= needed(n, self.n[y], percent):
                    self.merge(x, y)
            # the kid with the next shingle of x is taken first
            first = int(own[len(own) - after]) if after else -1
            kids = node.kids
            stack.extend((kid, overlap) for c, kid in kids.items() if c != first)
            if first in kids:
                stack.append((kids[first], overlap))
        self.mark[own] = False

    def insert(self, x: int) -> None:
        own, n = self.sets[x], self.n[x]
        kids, at = self.top, 0
        while at < len(own):
            c = int(own[at])
            node = kids.get(c)
            if node is None:
                kids[c] = _Node(x, at, len(own), n, 0, [x])
                return
            size = min(node.end - node.start, len(own) - at)
            differ = np.flatnonzero(self.sets[node.of][node.start : node.start + size] != own[at : at + size])
            same = int(differ[0]) if len(differ) else size
            if same < node.end - node.start:
                upper = _Node(node.of, node.start, node.start + same, n, 0, [])
                upper.low, upper.high, upper.one = node.low, node.high, node.one
                upper.longest = node.longest + node.end - node.start - same
                node.start += same
                upper.kids[int(self.sets[node.of][node.start])] = node
                kids[c] = upper
                node = upper
            node.low, node.high = min(node.low, n), max(node.high, n)
            at += same
            node.longest = max(node.longest, len(own) - at)
            if node.one >= 0 and self.find(node.one) != self.find(x):
                node.one = -1
            if at == len(own):
                node.ids.append(x)
            kids = node.kids


def _ordered(raw: list[bytes]) -> tuple[list[np.ndarray], int]:
    """Shingles as places in the order of frequency, the most frequent first, so that similar sets share long beginnings."""
    lists = [np.frombuffer(r, np.int64) for r in raw]
    names, places, times = np.unique(np.concatenate([np.zeros(0, np.int64), *lists]), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int32)
    rank[np.lexsort((names, -times))] = np.arange(len(names), dtype=np.int32)
    ends = np.cumsum([0, *map(len, lists)])
    return [np.sort(rank[places[a:b]]) for a, b in zip(ends, ends[1:])], len(names)


def join_class(rids: list[int], n: list[int], shared: list[bytes], percent: int) -> list[int]:
    """The root (smallest rid) of each set of a candidate class."""
    order = sorted(range(len(rids)), key=lambda i: (n[i], rids[i]))
    sets, width = _ordered([shared[i] for i in order])
    tree = PrefixTree(sets, [n[i] for i in order], percent, width)
    for x in range(len(order)):
        tree.join(x)
        tree.insert(x)
    smallest: dict[int, int] = {}
    for x, i in enumerate(order):
        r = tree.find(x)
        smallest[r] = min(smallest.get(r, rids[i]), rids[i])
    out = [0] * len(rids)
    for x, i in enumerate(order):
        out[i] = smallest[tree.find(x)]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows of a sorted stream by their first column."""
    now, rows, started = None, [], False
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if started and row[0] != now:
                yield now, rows
                rows = []
            now, started = row[0], True
            rows.append(row[1:])
    if started:
        yield now, rows


def _join_classes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, root = [], []
        for _, rows in _groups(batches):
            rid += [r[0] for r in rows]
            root += join_class([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], percent)
            if len(rid) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(root, pa.int64())], ["rid", "root"])
                rid, root = [], []
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(root, pa.int64())], ["rid", "root"])

    return run


def _ask_blocks(percent: int):
    """Edges from sets that ask (asks = 1) to sets of the block that link with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            stored, asking = [r for r in rows if not r[4]], [r for r in rows if r[4]]
            edges: set[tuple[int, int]] = set()
            if stored and asking:
                every = stored + asking
                sets, width = _ordered([r[2] for r in every])
                first: dict[int, int] = {}
                parent = [first.setdefault(r[3], i) for i, r in enumerate(every)]
                tree = PrefixTree(sets, [r[1] for r in every], percent, width, parent)
                for x in range(len(stored)):
                    tree.insert(x)
                for x in range(len(stored), len(every)):
                    tree.join(x)
                for i, r in enumerate(every):
                    edges.add((r[3], every[tree.find(i)][3]))
            edges = {e for e in edges if e[0] != e[1]}
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return run


def _by_comp(rows: DataFrame, percent: int, *keys: str) -> DataFrame:
    """(rid, root) of rows (rid, n, shared) whose sets are joined with those of equal keys."""
    keyed = rows.withColumn("key", F.xxhash64(*keys)).select("key", "rid", "n", "shared")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(giving_back(_join_classes(percent)), "rid long, root long")


def _blocks(light: DataFrame, most: int, room: int) -> DataFrame:
    """comp, rid, n, bytes and part: blocks of like size with about ``most`` sets or ``room`` bytes, whichever is less.

    Counts by (comp, n) give each size its stretch of block numbers; a hash places a set inside it.
    """
    sizes = light.groupBy("comp", "n").agg((F.count("*") / most + F.sum("bytes") / room).alias("share"))
    before = Window.partitionBy("comp").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("start", F.coalesce(F.sum("share").over(before), F.lit(0.0)))
    within = F.shiftrightunsigned(F.xxhash64("rid"), 40) / F.lit(float(1 << 24))
    return light.join(sizes, ["comp", "n"]).select("comp", "rid", "n", "bytes", F.floor(F.col("start") + F.col("share") * within).alias("part"))


def _large(light: DataFrame, payload: DataFrame, tokens: DataFrame, percent: int, most: int, room: int) -> DataFrame:
    """(rid, root) for large candidate classes; ``light``: comp, rid, n, bytes; ``payload``: rid, shared; ``tokens``: rid, token.

    Blocks of sets of like size are joined by themselves. One set of each class found then stands for it in a second join of
    that kind, which merges the blocks' parts of one tight group. Sets outside the largest class of their candidate class
    then ask the blocks that hold a set of matching size with a common prefix shingle; sets of the largest class need not
    ask each other. Sets that ask one block are cut into chunks of ``most`` sets or ``room`` bytes too.
    """
    placed = cut(_blocks(light, most, room), "ngram-large")
    inside = cut(_by_comp(placed.join(payload, "rid"), percent, "comp", "part"), "ngram-large")
    heads = placed.join(inside.select(F.col("root").alias("rid")).distinct(), "rid", "left_semi").drop("part")
    between = _by_comp(_blocks(heads, most, room).join(payload, "rid"), percent, "comp", "part")
    pairs = lambda df: df.select(F.col("rid").alias("a"), F.col("root").alias("b"))
    merged = cut(connected_components(pairs(inside).unionByName(pairs(between))).select(F.col("id").alias("rid"), F.col("component").alias("root")), "ngram-large")
    known = placed.join(merged, "rid")
    main = known.groupBy("comp", "root").count().groupBy("comp").agg(F.max_by("root", F.struct("count", "root")).alias("main"))

    met = tokens.join(placed, "rid").groupBy("token", "comp", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    outside = known.join(main, "comp").where("root <> main").select("comp", F.col("part").alias("own"), "rid", "n", "bytes", "root")
    asking = tokens.join(outside, "rid").join(met, ["token", "comp"])
    asking = asking.where(F.expr(f"own <> part and high * 100 >= {percent} * n and n * 100 >= {percent} * low"))
    asking = cut(asking.select("comp", "part", "rid", "n", "bytes", "root").distinct(), "ngram-asking")
    chunks = asking.groupBy("comp", "part").agg(F.ceil(F.count("*") / most + F.sum("bytes") / room).alias("chunks"))
    asked = asking.join(chunks, ["comp", "part"]).withColumn("chunk", F.pmod(F.xxhash64("rid"), "chunks"))
    stored = known.join(chunks, ["comp", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cols = ["comp", "part", "chunk", "rid", "n", "root"]
    every = stored.select(*cols, F.lit(0).alias("asks")).unionByName(asked.select(*cols, F.lit(1).alias("asks"))).join(payload, "rid")
    keyed = every.withColumn("key", F.xxhash64("comp", "part", "chunk")).select("key", "rid", "n", "shared", "root", "asks")
    across = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(giving_back(_ask_blocks(percent)), "a long, b long")
    return connected_components(pairs(merged).unionByName(across)).select(F.col("id").alias("rid"), F.col("component").alias("root"))


def _candidates(tokens: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components are the candidate classes; ``tokens``: rid, n, token. Of the sets with a token and a size
    one stands for all, and it is chained to the one of the next size if sets of these sizes can link."""
    heads = tokens.groupBy("token", "n").agg(F.min("rid").alias("m"), F.count("*").alias("c"))
    following = Window.partitionBy("token").orderBy("n")
    heads = heads.withColumn("next", F.lead("n").over(following)).withColumn("after", F.lead("m").over(following))
    heads = cut(heads, "ngram-heads")  # so that the join below can split a token with very many sets
    chained = heads.where(F.expr(f"100 * n >= {percent} * next and m <> after")).select(F.col("m").alias("a"), F.col("after").alias("b"))
    same = tokens.join(heads.where("c > 1").select("token", "n", "m"), ["token", "n"]).where("rid <> m").select(F.col("rid").alias("a"), F.col("m").alias("b"))
    return same.unionByName(chained).distinct()


def _set_table(docs: DataFrame, size: int, percent: int, key: str | None) -> DataFrame:
    """The sets as a written table; the shuffles that made it may go."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(key) if key else F.lit(0)).cast("long").alias("row"))
    chars = given.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    owners = max(4, -(-chars // (6 * OWNER_TOKENS)))  # about six bytes a word
    blocks = max(4, -(-chars // (6 * BLOCK_TOKENS)))
    # an owner has a task of its own; rows of blocks only pass through
    own = F.when(F.col("target") >= 0, F.col("target")).otherwise(F.pmod(F.xxhash64("block"), F.lit(owners))).cast("int")
    packed = given.mapInArrow(giving_back(_sets(size, owners)), PACKED).repartitionById(owners, own).mapInArrow(giving_back(_count), PACKED)
    return materialise(packed.repartition(blocks, "block").mapInArrow(giving_back(_filter(percent)), SETS), "ngram-sets")


def classes(docs: DataFrame, size: int = 4, percent: int = 85, most: int = 1_000, room: int = 16_000_000, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    If a ``key`` (a long) is named, it comes too, and ``kept``: true for one row of each class, the one with the smallest
    doc_id (nulls last), of equal ids the one with the smallest key.
    """
    spark = docs.sparkSession
    sets = _set_table(docs, size, percent, key)
    release(spark)

    left = sets.where("shared is not null").select("rid", "n", "key", "prefix", "shared")
    first = cut(left.groupBy("key").agg(F.min("rid").alias("rid"), F.min("n").alias("n"), F.min(F.octet_length("shared")).alias("bytes")), "ngram-first")
    tokens = left.join(first.select("rid"), "rid", "left_semi").select("rid", "n", F.explode("prefix").alias("token"))
    # a token of one set makes no candidates
    met = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    tokens = cut(tokens.join(met, "token").select("rid", "n", "token"), "ngram-tokens")
    comps = cut(connected_components(_candidates(tokens, percent)).select(F.col("id").alias("rid"), F.col("component").alias("comp")), "ngram-comps")
    light = comps.join(first.select("rid", "n", "bytes"), "rid")
    big = light.groupBy("comp").agg(F.count("*").alias("c"), F.sum("bytes").alias("b")).where((F.col("c") > most) | (F.col("b") > room)).select("comp")
    some_big = bool(big.take(1))
    payload = left.select("rid", "shared")
    normal = light.join(big, "comp", "left_anti") if some_big else light
    roots = _by_comp(normal.join(payload, "rid"), percent, "comp")
    if some_big:
        large = cut(light.join(big, "comp", "left_semi"), "ngram-large")
        roots = roots.unionByName(_large(large, payload, tokens.select("rid", "token"), percent, most, room))

    # key -> root, for the sets that were joined; all others are linked with nothing but their equals
    joined = first.join(roots, "rid", "left").select("key", F.coalesce("root", "rid").alias("root"))
    whole = sets.select("rid", "doc_id", "n", "key", "rep", "row").join(joined, "key", "left").withColumn("root", F.when(F.col("n") == 0, F.col("rid")).otherwise(F.coalesce("root", "rep")))
    whole = materialise(whole.select("doc_id", F.col("n").alias("n_shingles"), "root", "row"), "ngram-roots")
    # written, so that the join below can split a root with very many rows
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    names = materialise(whole.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min_by("row", order).alias("keep")), "ngram-names")
    discard(sets, first, tokens, comps)
    release(spark)
    named = whole.join(names, "root")
    more = [F.col("row").alias(key), (F.col("row") == F.col("keep")).alias("kept")] if key else []
    return named.select("doc_id", "n_shingles", "component_id", *more)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 3], 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(w.doc_id, coalesce(m.m, w.doc_id)) AS BIGINT) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) m USING (doc_id)"""
