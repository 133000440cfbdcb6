"""Prefix trie of conversations: every distinct beginning of turns is a node with what is known of its subtree.

A turn (role, text) has a 128-bit id, a conversation is the key of its turns' ids in big-endian bytes.  Keys are sorted
into ranges over all tasks, each range is cut into chunks of bounded size, and every chunk becomes an adaptive radix
tree, of which only the depths at whole turns count.  A node that is neither a beginning of its chunk's first key nor of
its last one is whole there.  All others, two paths a chunk, are added up over chunks: members, least ids and sums of
subtrees add; what two neighbouring chunks both hold is the common beginning of the last key of one and the first key of
the other, and is taken off once.  So a beginning that a third of all conversations share, or very many copies of one
conversation, are spread like all others, and depth costs no rounds.

Turns are ordered by ``turn``, null first, equal ones by their ids; null role or text is empty; rows without conv_id
belong to no conversation; repeated rows are repeated turns; further columns are ignored; no conversations, no nodes.  A
conversation (not a group of them) has to fit into a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched, chain

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.artree import Tree
from trailmark.llm.common import stored

#: Bytes of a turn id; conversations and turns at which a chunk is closed, the last conversation whole.
WIDTH, CHUNK_KEYS, CHUNK_TURNS = 16, 20_000, 200_000
#: Conversations of one family start alike: so many ids, and fewer shared turns than this.
FAMILY, SHARED_TURNS = 5, 9


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that name a turn, in hexadecimal digits; the role's length keeps role and text apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): each conversation's turn ids and the UTF-8 bytes of its texts, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), turn_id(role, text).alias("id"), F.octet_length(text).alias("size")).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c as the first h turns of conversation c - c % 5 and its own after its first h.

    h = crc32(c) % 9; a conversation that is not there has no turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    shared = convs.select(F.col("conv_id").alias("base"), *[F.slice(c, 1, SHARED_TURNS - 1).alias(f"base_{c}") for c in ("ids", "sizes")])
    rows = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": h}).join(shared.where(f"base % {FAMILY} = 0"), "base", "left")

    def joined(c: str) -> Column:
        begin = F.slice(F.coalesce(f"base_{c}", F.expr(f"slice({c}, 1, 0)")), F.lit(1), F.col("h"))
        return F.concat(begin, F.slice(c, F.col("h") + 1, F.size(c)))

    return rows.select("conv_id", joined("ids").alias("ids"), joined("sizes").alias("sizes"))


class Sums:
    """What adds up over a subtree: members, least member, childless nodes, bytes of last texts by node and by member."""

    __slots__ = ("bytes", "least", "leaves", "members", "nodes", "weighted")

    def __init__(self):
        self.members, self.least, self.nodes, self.leaves, self.weighted, self.bytes = 0, None, 0, 0, 0, 0

    def add(self, other: Sums) -> None:
        """Take in a part of the subtree whose top is ``other``'s nodes."""
        self.members += other.members
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.nodes += other.nodes
        self.leaves += other.leaves
        self.weighted += other.weighted
        self.bytes += other.bytes


NODES = (
    "chunk bigint, whole boolean, name binary, parent_name binary, depth int, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, weighted bigint, bytes bigint, ends string, ends_sha256 string"
)
#: The first and the last key of a task, and the text bytes of the first one's turns.
EDGES = "first binary, last binary, sizes array<int>"
_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in f"{NODES}, {EDGES}".split(", "))])


def _names(key: bytes) -> list[bytes]:
    """128-bit names of all beginnings of a key, by their number of turns."""
    state = hashlib.md5()
    made = [state.digest()]
    for at in range(0, len(key), WIDTH):
        state.update(key[at : at + WIDTH])
        made.append(state.digest())
    return made


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def chunk_nodes(chunk: int, keys: list[tuple[bytes, int]], sizes: dict[bytes, int]) -> Iterator[tuple]:
    """The nodes of a chunk of (key, conv_id) in order; ``sizes`` has the bytes of each turn's text."""
    tree, first, last = Tree(), keys[0][0], keys[-1][0]
    for key, conv in keys:
        tree.insert(key, conv)
    sums: dict[int, Sums] = {}  # by node: the turn nodes that hang below it, or of it
    path_turns: dict[int, list[tuple[int, bytes]]] = {}  # (byte depth, turn) of turn nodes on a node's path, deepest first
    turns_of: dict[int, list[tuple[int, int, Sums]]] = {}  # the same with their numbers of children and their sums
    starts: dict[int, int] = {}
    own_values: dict[int, list[int]] = {}
    order = list(tree.postorder())
    begun: dict[int, bytes] = {id(tree.root): b""}  # the bytes since the last whole turn, up to the node
    for node, depth, parent, byte in reversed(order):
        if parent is not None:
            span = bytes([byte]) + node.path
            start = depth - len(span)
            head = begun[id(parent)]
            whole = head + span
            begun[id(node)] = whole[len(whole) - depth % WIDTH :] if depth % WIDTH else b""
            starts[id(node)] = start
            cuts = range(start - start % WIDTH + WIDTH, depth + 1, WIDTH)
            offset = start - len(head)
            path_turns[id(node)] = [(d, whole[d - WIDTH - offset : d - offset]) for d in cuts][::-1]
        else:
            path_turns[id(node)] = [(0, b"")]
    for node, _, parent, _ in order:
        now = sums.pop(id(node), None) or Sums()
        if node.values:
            node.values.sort()
            own_values[id(node)] = node.values
            now.members += len(node.values)
            now.least = node.values[0] if now.least is None else min(now.least, node.values[0])
        made = []
        for d, turn in path_turns[id(node)]:
            top = Sums()
            size = sizes[turn] if turn else 0
            top.members, top.least, top.nodes = now.members, now.least, 1
            top.leaves = now.leaves or 1
            top.weighted, top.bytes = now.weighted + now.members * size, now.bytes + size
            made.append((d, now.nodes, top))
            now = top
        turns_of[id(node)] = made
        if parent is not None:
            sums.setdefault(id(parent), Sums()).add(now)
    # from the root down: the turn node above, and whether a node lies on the first or the last key's path
    nearest: dict[int, tuple[int | None, bytes | None]] = {}
    names = _names(first), _names(last)
    on: dict[int, tuple[bool, bool]] = {id(tree.root): (True, True)}
    for node, depth, parent, byte in reversed(order):
        conv_above, name_above = nearest[id(parent)] if parent is not None else (None, None)
        if parent is not None:
            start = starts[id(node)]
            span = bytes([byte]) + node.path
            on[id(node)] = tuple(o and key[start:depth] == span for o, key in zip(on[id(parent)], (first, last), strict=True))
        on_first, on_last = on[id(node)]
        path = names[0] if on_first else names[1] if on_last else None
        for d, n_children, top in reversed(turns_of[id(node)]):
            ends = own_values.get(id(node), []) if d == depth else []
            name = None if path is None else path[d // WIDTH]
            listed = ",".join(map(str, ends)) if path is not None and ends else None
            saved = (top.members, n_children, top.leaves, top.weighted, top.bytes)
            yield (chunk, path is None, name, name_above, d // WIDTH, top.least, conv_above, *saved, listed, _digest(ends) if path is None else None)
            conv_above, name_above = (top.least, None) if path is None else (None, name)
        nearest[id(node)] = (conv_above, name_above)


def _overlap(chunk: int, before: bytes, first: bytes, sizes: dict[bytes, int]) -> Iterator[tuple]:
    """What a chunk and the one before it, which ends in the key ``before``, both hold: rows that take it off once."""
    same = 0
    while same < min(len(before), len(first)) and before[same : same + WIDTH] == first[same : same + WIDTH]:
        same += WIDTH
    doubled = 1 if same == len(before) else 0  # the last node before is a leaf there, and again or not at all a leaf here
    size = sum(sizes[first[d : d + WIDTH]] for d in range(0, same, WIDTH))
    names = _names(first[:same])
    for d in range(0, same + 1, WIDTH):
        size -= sizes[first[d - WIDTH : d]] if d else 0
        own = sizes[first[d - WIDTH : d]] if d else 0
        yield (chunk, False, names[d // WIDTH], None, d // WIDTH, None, None, 0, -1 if d < same else 0, -doubled, 0, -size - own, None, None)


def _chunks(frames: Iterator[pa.RecordBatch], most_keys: int, most_turns: int) -> Iterator[pa.RecordBatch]:
    """The nodes of each chunk of a task's sorted conversations, what neighbouring chunks share, and the task's range."""
    task = TaskContext.get().partitionId()
    keys, sizes, turns, count, before, beginning = [], {}, 0, 0, None, None

    def closed() -> Iterator[pa.RecordBatch]:
        chunk = (task << 32) + count
        rows = chunk_nodes(chunk, keys, sizes)
        if before is not None:
            rows = chain(rows, _overlap(chunk, before, keys[0][0], sizes))
        for some in batched(rows, 10_000):
            yield pa.RecordBatch.from_pylist([dict(zip(_COLUMNS, row, strict=True)) for row in some], _ARROW)

    for frame in frames:
        for conv, key, own in zip(*(frame.column(n) for n in ("conv_id", "key", "sizes")), strict=True):
            key, own = key.as_py(), own.as_py()
            keys.append((key, conv.as_py()))
            sizes.update((key[WIDTH * i : WIDTH * (i + 1)], s) for i, s in enumerate(own))
            turns += len(own)
            beginning = (key, own) if beginning is None else beginning
            if len(keys) >= most_keys or turns >= most_turns:
                yield from closed()
                before, count = keys[-1][0], count + 1
                keys, sizes, turns = [], {}, 0
    if keys:
        yield from closed()
        before = keys[-1][0]
    if beginning is not None:  # the range of the task, as a row without depth
        edge = {"chunk": task << 32, "first": beginning[0], "last": before, "sizes": beginning[1]}
        yield pa.RecordBatch.from_pylist([edge], _ARROW)


def _task_overlaps(rows: DataFrame) -> DataFrame:
    """What neighbouring tasks share; there is one row a task with conversations."""
    order = Window.orderBy("chunk")
    ranges = rows.where("depth is null").select("chunk", "first", "last", "sizes")
    beside = ranges.select("chunk", "first", "sizes", F.lag("last").over(order).alias("before")).where("before is not null")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = {row["first"][WIDTH * i : WIDTH * (i + 1)]: s for i, s in enumerate(row["sizes"])}
                made = _overlap(row["chunk"], row["before"], row["first"], sizes)
                yield pa.RecordBatch.from_pylist([dict(zip(_COLUMNS, r, strict=True)) for r in made], _ARROW)

    return beside.mapInArrow(shared, f"{NODES}, {EDGES}")


def _joined_ends(parts: DataFrame) -> DataFrame:
    """(name, ends_sha256) of nodes whose ending conversations lie in one or more chunks, listed chunk after chunk.

    A digest is worked out from beginning to end; the lists of a node come one at a time.
    """

    def digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for frame in frames:
            made = []
            for own, listed in zip(frame["name"], frame["ends"], strict=True):
                own = bytes(own)
                if own != name:
                    if name is not None:
                        made.append((name, state.hexdigest()))
                    name, state = own, hashlib.sha256(listed.encode())
                else:
                    state.update(b"," + listed.encode())
            yield pd.DataFrame(made, columns=["name", "ends_sha256"])
        if name is not None:
            yield pd.DataFrame([(name, state.hexdigest())], columns=["name", "ends_sha256"])

    ordered = parts.select("name", "chunk", "ends").repartition("name").sortWithinPartitions("name", "chunk")
    return ordered.mapInPandas(digested, "name binary, ends_sha256 string")


def trie(convs: DataFrame, most_keys: int = CHUNK_KEYS, most_turns: int = CHUNK_TURNS) -> DataFrame:
    """Nodes of the prefix trie of (conv_id, ids, sizes).

    One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless
    nodes of the subtree), saved_tokens (members but one times bytes of the last text, over the subtree), ends_sha256
    (digest of the ids that end here, comma-joined, ascending).
    """
    keyed = convs.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key"), "sizes")
    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = stored(ordered.mapInArrow(lambda b: _chunks(b, most_keys, most_turns), f"{NODES}, {EDGES}"), "trie-chunks")
    paths = made.where("depth is not null and not whole")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weighted", "bytes")]
    added = paths.unionByName(_task_overlaps(made)).groupBy("name", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_name").alias("parent_name"), *sums
    )
    merged = stored(added, "trie-paths")
    least = merged.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("least"))
    ends = _joined_ends(paths.where("ends is not null"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    saved = (F.col("weighted") - F.col("bytes")).alias("saved_tokens")
    counts = ["n_convs", "n_children", "n_leaves"]
    top = merged.join(least, "parent_name", "left").join(ends, "name", "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), F.col("least").alias("parent_conv_id"), *counts, saved,
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    # the least member of a node on a path, beside each chunk that has children of it
    of_chunk = paths.where("n_convs > 0").select("chunk", F.col("name").alias("parent_name")).distinct().join(least, "parent_name")
    whole = made.where("whole").join(of_chunk, ["chunk", "parent_name"], "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), F.coalesce("parent_conv_id", "least").alias("parent_conv_id"), *counts, saved,
        "ends_sha256",
    )
    return whole.unionByName(top)
