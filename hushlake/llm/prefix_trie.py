"""The trie of conversation prefixes: ternary search trees in shards of a sorted range, border nodes merged afterwards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushlake.plans.storage import materialize

FAMILY = 5  # conversations that share the head of one of them
HEADS = 9  # a head has 0 to 8 turns
MOST_ROWS, MOST_TURNS = 100_000, 500_000  # of a shard
FAN = 64  # neighbouring shards that one merge takes
LEFT, RIGHT = 1, 2  # the border of a shard that a node lies on
NODE, BORDER, ENDS = 0, 1, 2  # kinds of rows
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = (
    "kind int, shard long, side int, depth long, key binary, parent_key binary, parent_conv_id long, "
    "first long, size long, n long, children long, leaves long, saved long, ends string"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def coded(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of a conversation in order, as ``code`` and ``size`` (UTF-8 bytes of the text).

    A dictionary gives every distinct (role, text) a code; texts are told apart by 128 bits of SHA-256 and never moved. Turns are
    ordered by ``turn`` (null first), equal ones by that hash. A conversation's codes are one row.
    """
    role, text = F.coalesce(conversations["role"], F.lit("")), F.coalesce(conversations["text"], F.lit(""))
    told = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        F.unhex(F.substring(told, 1, 32)).alias("key"), F.octet_length(text).cast("long").alias("size"),
    )
    turns = materialize(turns, "turns")
    codes = turns.select("key").distinct().withColumn("code", F.monotonically_increasing_id())
    rows = turns.join(materialize(codes, "codes"), "key")
    placed = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "key", "code", "size")
    turns = F.transform(F.array_sort(F.collect_list(placed)), lambda t: F.struct(t["code"].alias("code"), t["size"].alias("size")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, codes, sizes`` of every conversation, its first turns taken from the first of its family.

    The first ``h`` turns are those of conversation ``c - c % 5`` (all if fewer, none if there is no such conversation), the others its
    own after its first ``h``, with ``h = crc32(c) % 9``. Rows without ``conv_id`` belong to no conversation.
    """
    own = materialize(coded(conversations), "conversations")
    heads = own.select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("head"))
    rows = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "family", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.slice("turns", 1, 0)
    path = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice(F.col("turns"), h + 1, F.size("turns")))
    return rows.select("conv_id", path.alias("path")).select("conv_id", F.col("path.code").alias("codes"), F.col("path.size").alias("sizes"))


def _key(parent: bytes, code: int) -> bytes:
    return hashlib.sha256(parent + code.to_bytes(8, "little")).digest()[:16]


class Tree:
    """Ternary search tree over code sequences: ``low`` and ``high`` lead to sisters, ``down`` to the first child."""

    def __init__(self) -> None:
        self.code, self.size, self.up, self.depth = [-1], [0], [0], [0]
        self.low, self.high, self.down = [0], [0], [0]
        self.ids: dict[int, list[int]] = {}

    def _made(self, code: int, size: int, parent: int) -> int:
        self.code.append(code)
        self.size.append(size)
        self.up.append(parent)
        self.depth.append(self.depth[parent] + 1)
        for links in (self.low, self.high, self.down):
            links.append(0)
        return len(self.code) - 1

    def insert(self, codes: list[int], sizes: list[int]) -> int:
        """The node of a whole sequence, with what is missing on the way made."""
        parent = 0
        for code, size in zip(codes, sizes, strict=True):
            at = self.down[parent]
            if not at:
                at = self.down[parent] = self._made(code, size, parent)
            while self.code[at] != code:
                links = self.low if code < self.code[at] else self.high
                if not links[at]:
                    links[at] = self._made(code, size, parent)
                at = links[at]
            parent = at
        return parent


def _medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before its halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            yield (a + b) // 2
            ranges += [((a + b) // 2 + 1, b), (a, (a + b) // 2)]


def _shard(number: int, paths: list[tuple[list[int], list[int], list[int]]]) -> list[tuple]:
    """Rows of one shard: its finished nodes, and those on its first or last path, which other shards can share."""
    tree = Tree()
    for i in _medians(len(paths)):
        codes, sizes, ids = paths[i]
        tree.ids[tree.insert(codes, sizes)] = ids
    side, key = [0] * len(tree.code), {0: ROOT}
    for (codes, sizes, _), flag in ((paths[0], LEFT), (paths[-1], RIGHT)):
        at, way = tree.insert(codes, sizes), []
        while at:
            way.append(at)
            at = tree.up[at]
        side[0] |= flag
        for node in reversed(way):
            side[node] |= flag
            key[node] = _key(key[tree.up[node]], tree.code[node])
    nodes = len(tree.code)
    n, first = [0] * nodes, [1 << 63] * nodes
    children, leaves, saved = [0] * nodes, [0] * nodes, [0] * nodes
    out: list[tuple] = []
    below: list[list[int]] = [[] for _ in range(nodes)]  # rows of finished children, which wait for their parent's smallest member
    for at in range(nodes - 1, -1, -1):  # a child is always made after its parent
        ids = tree.ids.get(at, [])
        n[at] += len(ids)
        if ids:
            first[at] = min(first[at], ids[0])
        up = tree.up[at]
        if at:
            n[up] += n[at]
            first[up] = min(first[up], first[at])
        text = ",".join(map(str, ids)) if ids else None
        if side[at]:
            if text:
                out.append((ENDS, number, None, None, key[at], None, None, None, None, None, None, None, None, text))
            out.append((BORDER, number, side[at], tree.depth[at], key[at], key[up] if at else None, None, first[at], tree.size[at], n[at], children[at], leaves[at], saved[at], None))
            parent = (key[at], None)
        else:
            leaves[at] = leaves[at] or 1
            saved[at] += (n[at] - 1) * tree.size[at]
            children[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
            ends = hashlib.sha256(text.encode()).hexdigest() if text else NO_ENDS
            out.append((NODE, number, None, tree.depth[at], None, None, None, first[at], tree.size[at], n[at], children[at], leaves[at], saved[at], ends))
            below[up].append(len(out) - 1)
            parent = (None, first[at])
        for i in below[at]:
            out[i] = (*out[i][:5], *parent, *out[i][7:])
    return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    kinds = [types[c.split()[1]] for c in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def _shards(batches: Iterator[pa.RecordBatch], most_rows: int, most_turns: int) -> Iterator[pa.RecordBatch]:
    """Cut sorted ``codes, conv_id, sizes`` into shards of bounded size."""
    number = TaskContext.get().partitionId() << 32
    paths: list[tuple[list[int], list[int], list[int]]] = []
    rows = turns = 0
    for batch in batches:
        codes, sizes = batch.column("codes"), batch.column("sizes")
        for i, conv in enumerate(batch.column("conv_id").to_pylist()):
            path = codes[i].as_py()
            if rows >= most_rows or turns >= most_turns:
                yield _table(_shard(number, paths))
                paths, rows, turns, number = [], 0, 0, number + 1
            rows += 1
            if paths and paths[-1][0] == path:
                paths[-1][2].append(conv)
            else:
                paths.append((path, sizes[i].as_py(), [conv]))
                turns += len(path)
    if paths:
        yield _table(_shard(number, paths))


def _merged(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Border nodes of the shards of a group, in order: nodes of one path become one, and those inside the group are finished."""
    group, shard, stack, out = None, None, [], []

    def close(node: dict, border: int) -> None:
        parent = stack[-1] if stack else None
        if border:
            out.append((BORDER, group, border, node["depth"], node["key"], node["parent_key"], None, *(node[c] for c in NAMES[7:13]), None))
            return
        leaves = node["leaves"] or 1
        saved = node["saved"] + (node["n"] - 1) * node["size"]
        if parent:
            parent["children"] += 1
            parent["leaves"] += leaves
            parent["saved"] += saved
        out.append((NODE, group, None, node["depth"], node["key"], node["parent_key"], None, node["first"], node["size"], node["n"], node["children"], leaves, saved, None))

    def end() -> None:
        while stack:
            node = stack.pop()
            close(node, 0 if last else node["left"] | RIGHT)

    for batch in batches:
        for row in batch.to_pylist():
            if row["group"] != group:
                end()
                group, shard = row["group"], row["shard"]
            left = 0 if last or row["shard"] != shard else row["side"] & LEFT
            depth = row["depth"]
            if len(stack) > depth and stack[depth]["key"] == row["key"]:
                node = stack[depth]
                for c in ("n", "children", "leaves", "saved"):
                    node[c] += row[c]
                node["first"] = min(node["first"], row["first"])
                continue
            while len(stack) > depth:
                node = stack.pop()
                close(node, node["left"])
            stack.append(row | {"left": left})
        if out:
            yield _table(out)
            out.clear()
    end()
    if out:
        yield _table(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a key of the texts that follow each other, joined by commas."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if state:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out])], ["key", "digest"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "digest"])


def prefix_trie(paths: DataFrame, most_rows: int = MOST_ROWS, most_turns: int = MOST_TURNS, fan: int = FAN) -> DataFrame:
    """Nodes of the trie of ``paths`` (``conv_id, codes, sizes``): ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Paths are sorted by codes and id over all tasks, so that copies of one path or a common beginning spread over as many shards as they fill. A
    task cuts its range into shards of ``most_rows`` conversations or ``most_turns`` turns and builds a ternary search tree in each, inserting medians first.
    Only nodes on a shard's first and last path can lie in other shards too; these are merged by groups of ``fan`` neighbours,
    round by round, until one group is left. The ids that end at such a node are hashed in order, piece by piece.

    A conversation without turns ends at the root. Without conversations there is no node.
    """
    sorted_ = paths.repartitionByRange("codes", "conv_id").sortWithinPartitions("codes", "conv_id").select("codes", "conv_id", "sizes")
    made = materialize(sorted_.mapInArrow(lambda batches: _shards(batches, most_rows, most_turns), COLUMNS), "shards")
    nodes, border = [made.filter(F.col("kind") == NODE)], made.filter(F.col("kind") == BORDER)
    shards = border.select("shard").distinct().withColumn("nth", F.row_number().over(Window.orderBy("shard")) - 1)  # a row for each shard
    left = shards.count()
    border = border.join(shards, "shard").drop("shard").withColumnRenamed("nth", "shard")
    while left:
        last = left <= fan
        rows = border.withColumn("group", F.expr(f"shard div {fan}")).repartition("group")
        # a shard's nodes in the order of a walk: shared beginning, rest of the first path, rest of the last
        rows = rows.sortWithinPartitions("group", "shard", F.col("side") == RIGHT, "depth")
        found = materialize(rows.mapInArrow(lambda batches, last=last: _merged(batches, last), COLUMNS), "merged")
        nodes.append(found.filter(F.col("kind") == NODE))
        border = found.filter(F.col("kind") == BORDER)
        left = 0 if last else -(-left // fan)
    return _joined(made, nodes)


def _joined(made: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """Finished nodes with the smallest member of a shared parent and the digest of ids that end at a shared node."""
    inner, shared = nodes[0], nodes[0].filter("false")
    for found in nodes[1:]:
        shared = shared.unionByName(found)
    pieces = made.filter(F.col("kind") == ENDS).select("key", "shard", "ends")
    digests = pieces.repartition("key").sortWithinPartitions("key", "shard").select("key", "ends").mapInArrow(_hashed, "key binary, digest string")
    shared = materialize(shared.join(digests, "key", "left").withColumn("ends", F.coalesce("digest", F.lit(NO_ENDS))).drop("digest"), "shared")
    named = shared.select(F.col("key").alias("parent_key"), F.col("first").alias("named"))
    open_ = inner.filter("parent_key IS NOT NULL").unionByName(shared)
    open_ = open_.join(named, "parent_key", "left").withColumn("parent_conv_id", F.col("named")).drop("named")
    return inner.filter("parent_key IS NULL").unionByName(open_).select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of the :func:`rebuilt` conversations. Null roles and texts are empty; repeated rows are turns of their own."""
    return prefix_trie(rebuilt(conversations))
