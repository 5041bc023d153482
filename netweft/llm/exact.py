"""Exact duplicates by Patricia tries over whole byte strings.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the
most code points in its original text stays, then the one with the smallest doc_id.

1. Every input partition puts its normalised texts into a trie of its own. A full trie is emitted and started afresh, so
   memory is bounded; one row per distinct text of a trie comes out, with the ids of its rows. A text that a third of all
   rows share thus leaves a task as a few rows.
2. These rows are written to the shared folder and dealt by (length, content hash) of the text. The owner of such a
   partition inserts the full byte strings into a trie whose terminal nodes hold the best row so far; byte equality, not
   the hash, decides. Past its memory budget the trie spills its largest subtree to a file and works that off later.
3. Owners answer for each local group with the row that stays and the size of the whole group; ids are exploded last.

Defined results: null text counts as empty, and all empty texts are one group; of fully equal rows (same text length and
id) the one in the first local group stays; a null doc_id loses against any other; an empty table gives no rows; extra
columns are ignored. A spilled subtree is a temporary file of its task, which is done again with the task if that is lost.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweft.llm.common import giving_back, materialise

BLANKS = b" \t\n\x0b\x0c\r"


class Node:
    __slots__ = ("key", "end", "kids", "rec", "spill")

    def __init__(self, key: bytes, end: int, rec=None) -> None:
        self.key, self.end, self.kids, self.rec, self.spill = key, end, None, rec, None


def first_difference(a: bytes, b: bytes, lo: int, hi: int) -> int:
    """The first place in [lo, hi) where a and b differ, or hi; by halving, with whole-slice comparisons."""
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Compressed radix trie of byte strings. Edges point into the inserted strings, so each is held once.

    ``merge(old, new)`` joins the records of equal strings. With a ``budget`` the largest subtree goes to a file when the
    strings held exceed it; ``items`` works spilled subtrees off one by one.
    """

    def __init__(self, merge, budget: int | None = None) -> None:
        self.root, self.merge, self.budget, self.held = Node(b"", 0), merge, budget, 0

    def insert(self, text: bytes, rec) -> None:
        node, n = self.root, len(text)
        while True:
            if node.spill is not None:
                pickle.dump((text, rec), node.spill)
                return
            if node.end == n:
                if node.rec is None:
                    node.key, node.rec = text, rec
                    self.held += n + 200
                else:
                    node.rec = self.merge(node.rec, rec)
                return
            kids = node.kids
            if kids is None:
                kids = node.kids = {}
            kid = kids.get(text[node.end])
            if kid is None:
                kids[text[node.end]] = Node(text, n, rec)
                self.held += n + 300
                break
            lo, hi = node.end, min(kid.end, n)
            if kid.end <= n and text[lo:hi] == kid.key[lo:hi]:
                node = kid
                continue
            at = first_difference(text, kid.key, lo, hi)
            fork = Node(text, at)
            fork.kids = {kid.key[at]: kid}
            kids[text[lo]] = fork
            if at == n:
                fork.rec = rec
            else:
                fork.kids[text[at]] = Node(text, n, rec)
            self.held += n + 600
            break
        if self.budget is not None and self.held > self.budget:
            self._spill()

    def _walk(self, node: Node) -> Iterator[Node]:
        stack = [node]
        while stack:
            at = stack.pop()
            yield at
            if at.kids:
                stack.extend(at.kids.values())

    def _spill(self) -> None:
        top = self.root
        while top.rec is None and top.kids and len(top.kids) == 1:  # what all strings share
            top = next(iter(top.kids.values()))
        sizes = [(sum(len(x.key) + 300 for x in self._walk(kid) if x.rec is not None), c) for c, kid in (top.kids or {}).items() if kid.spill is None]
        if not sizes:
            return
        size, c = max(sizes)
        kid = top.kids[c]
        nodes = list(self._walk(kid))
        # files of stubs below the subtree go on in the new one: the smaller are appended to the largest
        files = sorted((x.spill for x in nodes if x.spill is not None), key=lambda f: f.tell())
        file = files.pop() if files else tempfile.TemporaryFile(dir=os.environ.get("TMPDIR"))
        for nested in files:
            nested.seek(0)
            shutil.copyfileobj(nested, file, 1 << 20)
            nested.close()
        for x in nodes:
            if x.rec is not None:
                pickle.dump((x.key, x.rec), file)
        stub = Node(kid.key[: kid.end], kid.end)
        stub.spill = file
        if kid.kids is None:  # a single string: its equals and its extensions still pass through the stub
            stub.end = kid.end
        top.kids[c] = stub
        self.held -= size

    def items(self) -> Iterator[tuple[bytes, object]]:
        spilled = []
        for x in self._walk(self.root):
            if x.spill is not None:
                spilled.append(x.spill)
            elif x.rec is not None:
                yield x.key, x.rec
        self.root = Node(b"", 0)
        for file in spilled:
            file.seek(0)
            part = PatriciaTrie(self.merge, self.budget)
            while True:
                try:
                    text, rec = pickle.load(file)
                except EOFError:
                    break
                part.insert(text, rec)
            file.close()
            yield from part.items()


LOCAL = "lid long, key_len long, key_hash long, norm binary, sha string, n long, cp long, id long, ids array<long>, rows array<long>, best int"
LOCAL_ARROW = pa.schema(
    [("lid", pa.int64()), ("key_len", pa.int64()), ("key_hash", pa.int64()), ("norm", pa.binary()), ("sha", pa.string()), ("n", pa.int64()), ("cp", pa.int64()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("best", pa.int32())]
)


def _rank(cp: int, doc) -> tuple:
    """Smaller is better."""
    return (-cp, doc is None, doc or 0)


def _local(budget: int):
    def merge(old: list, new: list) -> list:
        # a record: ids of the rows, code points and place of the best of them, keys of the rows
        ids, cp, best, keys = old
        if _rank(new[1], new[0][0]) < _rank(cp, ids[best]):
            old[1], old[2] = new[1], len(ids)
        ids.append(new[0][0])
        keys.append(new[3][0])
        return old

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 33
        trie, rows = PatriciaTrie(merge), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            out, size = [], 0
            for norm, (ids, cp, best, keys) in trie.items():
                digest = hashlib.sha256(norm).digest()
                out.append({"lid": next_id, "key_len": len(norm), "key_hash": int.from_bytes(digest[:8], "big", signed=True), "norm": norm, "sha": digest.hex(), "n": len(ids), "cp": cp, "id": ids[best], "ids": ids, "rows": keys, "best": best})
                next_id += 1
                size += len(norm) + 16 * len(ids)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, LOCAL_ARROW)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, LOCAL_ARROW)

        for batch in batches:
            ids, texts, keys = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                trie.insert(text.encode("utf-8").translate(None, BLANKS), [[ids[k]], len(text), 0, [keys[k]]])
                rows += 1
                if trie.held + 24 * rows > budget:
                    yield from flush()
                    trie, rows = PatriciaTrie(merge), 0
        yield from flush()

    return run


def _owners(budget: int):
    def merge(old: tuple, new: tuple) -> tuple:
        # a record: (rank of the best, its local group, its id, rows, local groups)
        best = min(old, new, key=lambda r: (r[0], r[1]))
        old[4].extend(new[4])
        return (*best[:3], old[3] + new[3], old[4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, came, left = PatriciaTrie(merge, budget), 0, 0
        for batch in batches:
            came += batch.num_rows
            lids, n, cp, ids = (batch.column(i).to_pylist() for i in range(1, 5))
            norms = batch.column(0)
            for k in range(batch.num_rows):
                trie.insert(norms[k].as_py(), (_rank(cp[k], ids[k]), lids[k], ids[k], n[k], [lids[k]]))
        out: list[list] = [[], [], [], []]
        names = ["lid", "keep_lid", "keep_id", "group_size"]
        for _, (_, keep_lid, keep_id, n, lids) in trie.items():
            left += len(lids)
            for column, value in zip(out, (lids, [keep_lid] * len(lids), [keep_id] * len(lids), [n] * len(lids))):
                column.extend(value)
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
                out = [[], [], [], []]
        if left != came:
            raise RuntimeError(f"{came} local groups came in, {left} were answered")
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return run


def exact_groups(docs: DataFrame, local_budget: int = 64_000_000, owner_budget: int = 192_000_000, key: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, and its ``key`` (a long) if one is named.

    Budgets: bytes of text that a task's trie may hold.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(key) if key else F.lit(0)).cast("long").alias("row"))
    groups = materialise(given.mapInArrow(giving_back(_local(local_budget)), LOCAL), "exact-local")
    dealt = groups.repartition("key_len", "key_hash").select("norm", "lid", "n", "cp", "id")
    owners = dealt.mapInArrow(giving_back(_owners(owner_budget)), "lid long, keep_lid long, keep_id long, group_size long")
    members = groups.select("lid", "sha", F.arrays_zip("ids", "rows").alias("members"), "best").join(owners, "lid")
    return members.select("*", F.posexplode("members").alias("at", "member")).select(
        *([F.col("member.rows").alias(key)] if key else []),
        F.col("member.ids").alias("doc_id"),
        "keep_id",
        "group_size",
        ((F.col("lid") == F.col("keep_lid")) & (F.col("at") == F.col("best"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY cp DESC, doc_id)"""
