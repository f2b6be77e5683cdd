"""The prefix trie of conversations, from a global sort of their turn arrays.

1. Turns become 16 bytes (MD5 of role and text) and a word count; a conversation is one row, the array of its turns. Each is rebuilt
   with the first turns of the conversation that opens its block.
2. Equal arrays become one row with their number, smallest member and the hash of all members. Members are joined in runs of 4096
   numbers before they meet, and the runs are hashed one after the other, so no group is ever whole in memory.
3. The arrays are sorted into ranges. In a range, neighbours' longest common prefixes open and close nodes on a stack. What holds
   neither the first nor the last array of its range is complete when it closes. The two paths to those are left open.
4. The open paths of all ranges (two for each) are swept in order by one task in the same way, adding up what the ranges found,
   which closes the rest. Nodes below an open one learn their parent's member from it by a join.

Turns of equal number are ordered by their hash; turns without a number come first; a null role or text is empty. Rows without a conv_id belong to no
conversation. Repeated rows are turns like any other. An empty table has no nodes, not even a root. Other columns are not looked at.
A conversation has 60 million turns at most (one row).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import parts, scratch

BLOCK, HEADS, SIZE = 20, 4, 16
RANGE_TURNS = 50_000
_RUN = 4096
_WORD = r"[^\x20\x09-\x0D]+"
_NOBODY = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: open paths: what a range knows of each depth from `low` on
_PATH = "p long, side long, turns binary, words array<long>, low long, n array<long>, conv array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<string>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (hex, 32 digits each) and words of every conversation as it is rebuilt."""
    text = lambda c: F.coalesce(c, F.lit(""))
    role, said = text(F.col("role")), text(F.col("text"))
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, said))
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"), name.alias("name"), F.regexp_count(said, F.lit(_WORD)).alias("words"))
    own = turns.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("own"))
    own = own.select("conv_id", F.transform("own", lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words"))).alias("own"))
    base = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base")
    heads = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    whole = F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h), rest)
    joined = own.select("conv_id", "own", base).join(heads, "base", "left").select("conv_id", whole.alias("t"))
    return joined.select("conv_id", F.array_join(F.transform("t", lambda t: t["name"]), "").alias("turns"), F.transform("t", lambda t: t["words"].cast("long")).alias("words"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of members in order become one row for each array of turns."""
    name, row, digest, first = None, None, None, True

    def done() -> tuple:
        return (*row, digest.hexdigest())

    for batch in batches:
        rows = []
        for own, members, n, conv, turns, words in zip(*(batch.column(c).to_pylist() for c in ("name", "members", "n", "conv", "turns", "words")), strict=True):
            if own != name:
                if row is not None:
                    rows.append(done())
                name, row, digest, first = own, [turns, words, 0, conv], hashlib.sha256(), True
            digest.update((members if first else f",{members}").encode())
            first = False
            row[2] += n
        yield _distinct_batch(rows)
    if row is not None:
        yield _distinct_batch([done()])


_DISTINCT = "turns binary, words array<long>, n long, conv long, ends string"


def _distinct_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], names=["turns", "words", "n", "conv", "ends"])


def distinct_turns(convs: DataFrame) -> DataFrame:
    """turns, words, n (members), conv (the smallest) and ends (the members' hash) of each distinct array."""
    run = F.floor(F.col("conv_id") / _RUN).alias("run")
    runs = convs.groupBy(F.md5("turns").alias("name"), run).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("members"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"),
        F.first("turns").alias("turns"), F.first("words").alias("words"),
    )
    return runs.withColumn("turns", F.unhex("turns")).repartition("name").sortWithinPartitions("name", "run").mapInArrow(_members, _DISTINCT)


def common(a: bytes, b: bytes) -> int:
    """Turns that two arrays begin with alike."""
    low, high = 0, min(len(a), len(b)) // SIZE
    if a[: high * SIZE] == b[: high * SIZE]:
        return high
    while high - low > 1:  # the first `low` turns are alike, the first `high` are not
        middle = (low + high) // 2
        low, high = (middle, high) if a[low * SIZE : middle * SIZE] == b[low * SIZE : middle * SIZE] else (low, middle)
    return low


class _Node:
    """A node on the stack. `open`: it holds the first array of its range, so others may add to it."""

    __slots__ = ("words", "open", "n", "conv", "children", "leaves", "saved", "ends", "below")

    def __init__(self, words: int, open_: bool):
        self.words, self.open = words, open_
        self.n, self.conv, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.below = None, []

    def meet(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)

    def complete(self) -> None:
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.words

    def take(self, child: _Node) -> None:
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved

    def row(self, depth: int) -> list:
        return [self.conv, depth, None, self.n, self.children, self.leaves, self.saved, self.ends or _NOBODY]


class _Range:
    """Sweeps one range; `rows`: (node row, side of an open parent or None), `paths`: the open paths."""

    def __init__(self, p: int):
        self.p, self.stack, self.rows, self.last, self.left = p, [], [], None, None

    def add(self, turns: bytes, words: list[int], n: int, conv: int, ends: str) -> None:
        first = self.last is None
        self.close(0 if first else common(self.last[0], turns) + 1)
        for d in range(len(self.stack), len(words) + 1):
            self.stack.append(_Node(words[d - 1] if d else 0, first))
        self.stack[-1].meet(n, conv)
        self.stack[-1].ends = ends
        self.last = turns, words
        if first:
            self.left = turns, words, list(self.stack)

    def close(self, depth: int) -> None:
        """Closes nodes deeper than the first `depth` ones."""
        while len(self.stack) > depth:
            node, parent = self.stack.pop(), self.stack[-1] if self.stack else None
            if parent is not None:
                parent.meet(node.n, node.conv)
            if node.open:
                self.give(node, 0)
                continue
            node.complete()
            row = node.row(len(self.stack))
            for child in node.below:
                child[2] = node.conv
                self.rows.append((child, None))
            node.below = []
            parent.take(node)
            parent.below.append(row)

    def give(self, node: _Node, side: int) -> None:
        self.rows += [(child, side) for child in node.below]
        node.below = []

    def end(self) -> list[tuple]:
        """Leaves the last path open; the open paths."""
        rest = list(self.stack)
        for above, node in zip(rest[-2::-1], rest[:0:-1], strict=True):
            above.meet(node.n, node.conv)
        for node in rest:
            self.give(node, 0 if node.open else 1)
        turns, words, path = self.left
        low = sum(node.open for node in rest)
        paths = [self._path(0, turns, words, 0, path)]
        return paths if low == len(rest) else [*paths, self._path(1, *self.last, low, rest[low:])]

    def _path(self, side: int, turns: bytes, words: list[int], low: int, nodes: list[_Node]) -> tuple:
        return self.p, side, turns, words, low, *([getattr(x, c) for x in nodes] for c in ("n", "conv", "children", "leaves", "saved", "ends"))


_SWEPT = f"{_NODE}, {_PATH}"


def _kinds(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return [(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = _kinds(schema)
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of complete nodes (with p and side where the parent is an open one) and of open paths (without a depth)."""
    range_, gap = None, (None,) * 9
    for batch in batches:
        for p, *values in zip(*(batch.column(c).to_pylist() for c in ("p", "turns", "words", "n", "conv", "ends")), strict=True):
            range_ = range_ or _Range(p)
            range_.add(*values)
        yield _batch([(*row, range_.p, side, *gap) for row, side in range_.rows] if range_ else [], _SWEPT)
        if range_:
            range_.rows = []
    if range_:
        paths = range_.end()
        yield _batch([(*row, range_.p, side, *gap) for row, side in range_.rows] + [((None,) * 8) + path for path in paths], _SWEPT)


_STITCHED = f"{_NODE}, p long, side long"


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open paths in order: their nodes, complete, and for each path's depths (p, side) the member that children there name as parent's."""
    stack: list[tuple[_Node, int]] = []
    rows, parent, uses, last = [], [], [], None

    def close(depth: int) -> None:
        while len(stack) > depth:
            node, at = stack.pop()
            node.complete()
            rows[at] = node.row(len(stack))
            if stack:
                parent[at] = stack[-1][1]
                stack[-1][0].take(node)

    for batch in batches:
        for p, side, turns, words, low, *known in zip(*(batch.column(c).to_pylist() for c, _ in _kinds(_PATH)), strict=True):
            close(0 if last is None else common(last, turns) + 1)
            for d in range(len(stack), len(words) + 1):
                stack.append((_Node(words[d - 1] if d else 0, True), len(rows)))
                rows.append(None)
                parent.append(None)
            for (node, at), n, conv, children, leaves, saved, ends in zip(stack[low:], *known, strict=True):
                node.meet(n, conv)
                node.children, node.leaves, node.saved, node.ends = node.children + children, node.leaves + leaves, node.saved + saved, ends or node.ends
                if children:
                    uses.append((at, p, side))
            last = turns
    close(0)
    for row, above in zip(rows, parent, strict=True):
        row[2] = None if above is None else rows[above][0]
    found = [(*row, None, None) for row in rows] + [(*rows[at], p, side) for at, p, side in uses]
    for i in range(0, len(found), 10_000):
        yield _batch(found[i : i + 10_000], _STITCHED)


def prefix_trie(turns: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """The nodes of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    folder = f"{scratch(spark)}/trie-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    arrays = kept(distinct_turns(conversations(turns)), "arrays")
    size = arrays.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    ranges = arrays.repartitionByRange(parts(size, range_turns), "turns").sortWithinPartitions("turns").withColumn("p", F.spark_partition_id().cast("long"))
    swept = kept(ranges.mapInArrow(_sweep, _SWEPT), "swept")
    paths = swept.where("depth is null").select(*(c for c, _ in _kinds(_PATH)))
    stitched = kept(paths.repartition(1).sortWithinPartitions("p", "side").mapInArrow(_stitch, _STITCHED), "stitched")
    nodes = [c for c, _ in _kinds(_NODE)]
    complete = swept.where("depth is not null")
    above = stitched.where("p is not null").select("p", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    below = complete.where("side is not null").join(above, ["p", "side", "depth"]).withColumn("parent_conv_id", F.col("above"))
    return complete.where("side is null").select(*nodes).unionByName(below.select(*nodes)).unionByName(stitched.where("p is null").select(*nodes))

