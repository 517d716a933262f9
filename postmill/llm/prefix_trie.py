"""The prefix trie of conversations: turn arrays in one global order, LCPs of neighbours, a stack sweep in each range, and one over the ranges' open stacks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, Scratch, crc32_sql

#: Bytes of a turn's digest, of which a conversation's key is made, and bytes of keys that a range aims at.
WIDTH, RANGE_BYTES = 32, 8 << 20
#: How many turns a conversation may take over from the first of its five (a family), and that family's size.
SHARED_MOST, FAMILY = 9, 5
#: Bytes of a piece of a list of ids, and rows of an output batch.
_PIECE, _ROWS = 1 << 16, 8192

_NODE = "conv_id:long,depth:long,parent_conv_id:long,parent_slot:string,n_convs:long,n_children:long,n_leaves:long,saved_tokens:long,ends_sha256:string,ends_key:binary"
_STATE = "n_convs:long,least:long,bytes:long,children:long,leaves:long,saved:long,ends:string,ends_key:binary"
_EDGE = f"part:int,first_key:binary,last_key:binary,shared:int,first_path:array<struct<{_STATE}>>,last_path:array<struct<{_STATE}>>"
#: What the sweep of a range gives: whole nodes, pieces of the lists of ids of its first and last key, and one row of the two paths that lie open.
SWEPT = f"node struct<{_NODE}>, piece struct<key:binary,part:int,seq:long,ids:string>, edge struct<{_EDGE}>"
#: What the sweep over ranges gives: the nodes on those paths, and the least member of the node that a slot names.
STITCHED = f"node struct<{_NODE}>, slot struct<parent_slot:string,slot_conv_id:long>"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from its family's first."""
    return (F.crc32(conv_id.cast("string")) % SHARED_MOST).cast("int")


def turn_keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, key, sizes) of every conversation: a digest and the text's UTF-8 bytes of each turn in order.

    Only digests and sizes are gathered, 36 bytes a turn; texts stay where they are read.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).alias("size"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), lambda a, b: _compare(a, b)).alias("t"))
    return convs.select("conv_id", F.size("t").alias("n"), F.unhex(F.array_join(F.transform("t", lambda x: x["digest"]), "")).alias("key"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def _compare(a: Column, b: Column) -> Column:
    """By turn, null first, then by digest."""
    x, y = F.struct(a["turn"].isNotNull(), F.coalesce(a["turn"], F.lit(0)), a["digest"]), F.struct(b["turn"].isNotNull(), F.coalesce(b["turn"], F.lit(0)), b["digest"])
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def rebuilt(convs: DataFrame) -> DataFrame:
    """``convs`` of :func:`turn_keys` whose first turns are those of their family's first conversation."""
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", shared_turns(F.col("conv_id")))
    first = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("key").alias("base_key"), F.col("sizes").alias("base_sizes"))
    both = own.join(first, "base", "left")
    key = F.concat(F.coalesce(F.expr(f"substring(base_key, 1, h * {WIDTH})"), F.unhex(F.lit(""))), F.expr(f"substring(key, h * {WIDTH} + 1)"))
    rest = F.when(F.col("n") > F.col("h"), F.expr("slice(sizes, h + 1, n - h)")).otherwise(F.array().cast("array<int>"))
    sizes = F.concat(F.coalesce(F.expr("slice(base_sizes, 1, h)"), F.array().cast("array<int>")), rest)
    return both.select("conv_id", key.alias("key"), sizes.alias("sizes"))


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at the front, by halving."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    if a[:WIDTH] != b[:WIDTH]:
        return 0
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * WIDTH : mid * WIDTH] == b[lo * WIDTH : mid * WIDTH]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Node:
    """An open node: sums over what has been seen below it.

    ``done`` holds the rows of closed children, which wait for this node's least member; children of a
    node with slots are handed out at once, under one of them.
    """

    __slots__ = ("n_convs", "least", "bytes", "children", "leaves", "saved", "ends", "ends_key", "done", "slots")

    def __init__(self, size: int, slot: str | None = None):
        self.n_convs, self.least, self.bytes, self.children, self.leaves, self.saved = 0, None, size, 0, 0, 0
        self.ends, self.ends_key, self.done, self.slots = None, None, [], [slot] if slot else []

    def below(self, least: int | None) -> None:
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def add(self, state: dict) -> None:
        """Take up what another range has seen below this node."""
        for k in ("n_convs", "children", "leaves", "saved"):
            setattr(self, k, getattr(self, k) + state[k])
        self.below(state["least"])
        self.ends, self.ends_key = self.ends or state["ends"], self.ends_key or state["ends_key"]

    def state(self) -> dict:
        return {k: getattr(self, k) for k in ("n_convs", "least", "bytes", "children", "leaves", "saved", "ends", "ends_key")}

    def close(self, depth: int, parent: Node | None) -> dict:
        """This node's row but for its parent, which takes up its sums."""
        leaves, saved = self.leaves or 1, self.saved + (self.n_convs - 1) * self.bytes
        if parent is not None:
            parent.n_convs += self.n_convs
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
            parent.below(self.least)
        ends = None if self.ends_key else self.ends or _NO_ENDS
        return {"conv_id": self.least, "depth": depth, "parent_conv_id": None, "parent_slot": None, "n_convs": self.n_convs, "n_children": self.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "ends_key": self.ends_key}


class Sweep:
    """The sweep over one range of keys in order; ``stack`` is the path to the current key.

    A node on neither the range's first nor its last path is whole when it is popped. The others are
    handed on with the sums of what hangs below them beside both paths, and named by a slot. A
    range's memory holds its closed nodes that wait for a parent, and the ids of one key.
    """

    def __init__(self, part: int):
        self.part, self.stack, self.key, self.ids, self.first_key, self.first_path = part, [], None, [], None, []
        self.left = -1  # depth to which the stack lies on the first path
        self.nodes, self.pieces = [], []

    def _out(self, children: list[dict], parent: int | None, slot: str | None) -> None:
        self.nodes += [row | {"parent_conv_id": parent, "parent_slot": slot} for row in children]

    def _pop(self) -> None:
        depth, node = len(self.stack) - 1, self.stack.pop()
        if depth <= self.left:  # open to the left
            self.left, self.first_path[depth] = depth - 1, node
            return
        parent = self.stack[-1]
        row = node.close(depth, parent)
        self._out(node.done, node.least, None)
        if parent.slots:
            self._out([row], None, parent.slots[0])
        else:
            parent.done.append(row)

    def _ended(self, last: bool) -> None:
        """All of the current key's ids in this range have been seen; a key that may go on beyond the range leaves its ids in pieces."""
        node = self.stack[-1]
        if not last and self.key != self.first_key:
            node.ends = hashlib.sha256(b",".join(self.ids)).hexdigest()
        else:
            node.ends_key = hashlib.sha256(self.key).digest()
            room = max(1, _PIECE // 20)
            for i in range(0, len(self.ids), room):
                self.pieces.append({"key": node.ends_key, "part": self.part, "seq": len(self.pieces), "ids": b",".join(self.ids[i : i + room]).decode()})
        self.ids = []

    def row(self, key: bytes, sizes: list[int], conv_id: int) -> None:
        """The next conversation, in order of keys and ids."""
        if key != self.key:
            depth, shared = len(key) // WIDTH, -1
            if self.key is None:
                self.first_key, self.left, self.first_path = key, depth, [None] * (depth + 1)
            else:
                self._ended(False)
                shared = lcp(self.key, key)
                while len(self.stack) - 1 > shared:
                    self._pop()
            for d in range(shared + 1, depth + 1):
                self.stack.append(Node(sizes[d - 1] if d else 0, f"{self.part}f{d}" if self.key is None else None))
            self.key = key
        self.stack[-1].n_convs += 1
        self.stack[-1].below(conv_id)
        self.ids.append(b"%d" % conv_id)

    def end(self) -> dict | None:
        """The paths that lie open at the range's ends; the last one from where it leaves the first."""
        if self.key is None:
            return None
        self._ended(True)
        for d, node in enumerate(self.stack):
            if not node.slots:
                node.slots = [f"{self.part}l{d}"]
                self._out(node.done, None, node.slots[0])
        shared = lcp(self.first_key, self.key)
        first = [node or self.stack[d] for d, node in enumerate(self.first_path)]
        return {"part": self.part, "first_key": self.first_key, "last_key": self.key, "shared": shared, "first_path": [x.state() for x in first], "last_path": [x.state() for x in self.stack[shared + 1 :]]}


def _table(schema: pa.Schema, **lists: list[dict]) -> Iterator[pa.RecordBatch]:
    """A row for each entry, with its column filled and the others null."""
    for name, rows in lists.items():
        for i in range(0, len(rows), _ROWS):
            part = rows[i : i + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part if f.name == name else [None] * len(part), f.type) for f in schema], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _sweep(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(TaskContext.get().partitionId())
        for batch in batches:
            for key, sizes, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sweep.row(key, sizes, conv_id)
            if len(sweep.nodes) >= _ROWS:
                yield from _table(schema, node=sweep.nodes)
                sweep.nodes = []
        edge = sweep.end()
        yield from _table(schema, node=sweep.nodes, piece=sweep.pieces, edge=[edge] if edge else [])

    return run


def _stitch(schema: pa.Schema):
    """The sweep over the ranges' open paths in order: equal nodes of neighbouring ranges become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, current, nodes, slots = [], None, [], []

        def pop(shared: int) -> None:
            while len(stack) - 1 > shared:
                depth, node = len(stack) - 1, stack.pop()
                parent = stack[-1] if stack else None
                row = node.close(depth, parent)
                nodes.extend(child | {"parent_conv_id": node.least} for child in node.done)
                slots.extend({"parent_slot": s, "slot_conv_id": node.least} for s in node.slots)
                (nodes if parent is None else parent.done).append(row)

        def push(path: list[dict], base: int, side: str) -> None:
            for d, state in enumerate(path, base):
                if d == len(stack):
                    stack.append(Node(state["bytes"]))
                stack[d].add(state)
                stack[d].slots.append(f"{side}{d}")

        for batch in batches:
            for e in batch.to_pylist():
                if current is not None:
                    pop(lcp(current, e["first_key"]))
                push(e["first_path"], 0, f"{e['part']}f")
                pop(e["shared"])
                push(e["last_path"], e["shared"] + 1, f"{e['part']}l")
                current = e["last_key"]
            yield from _table(schema, node=nodes, slot=slots)
            nodes, slots = [], []
        pop(-1)
        yield from _table(schema, node=nodes, slot=slots)

    return run


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ids) in order to one SHA-256 a key."""
    key, state, out = None, None, []
    for batch in batches:
        for k, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if state:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state:
        out.append((key, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["ends_key", "hashed"])


def prefix_trie(spark: SparkSession, conversations: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The nodes of the trie of rebuilt conversations from ``conversations`` (conv_id, turn, role, text).

    Every conversation takes its first turns from its family's first (:func:`rebuilt`). A node is a sequence
    of first turns (role, text), the root the empty one. Per node: conv_id, its smallest member; depth;
    parent_conv_id, its parent's smallest member; n_convs, members; n_children; n_leaves, childless nodes
    in its subtree; saved_tokens, UTF-8 bytes that need not be stored again in its subtree;
    ends_sha256, of the ids that end at it.

    Keys of digests are ranged with the ids as second key, so copies of one conversation are dealt to
    many ranges. A range is swept with one stack; what lies open at its ends, two paths, is stitched by
    one more sweep, which gets one row a range. Ids of a key that may span ranges go on in pieces of some
    kilobytes and are hashed in order, as they stream by.

    Edge cases: turns are ordered by turn, null first, equal ones by digest; repeated rows stay; null role
    and text are empty. Rows with a null conv_id are left out. ``%`` is SQL's, so the family of a negative
    id is the next multiple towards zero. A conversation of no turns belongs to the root. Extra
    columns are ignored; an empty table gives no node. One conversation's digests are one row.
    """
    scratch = Scratch(spark, "trie")
    convs = scratch.keep(turn_keys(conversations), "keys")
    table = scratch.keep(rebuilt(convs), "rebuilt")
    size = table.agg(F.sum(F.octet_length("key").cast("long") + 64)).first()[0] or 0
    ranged = table.repartitionByRange(max(1, -(-size // range_bytes)), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = scratch.keep(ranged.select("key", "sizes", "conv_id").mapInArrow(_sweep(_arrow(SWEPT)), SWEPT), "swept")
    edges = swept.where("edge is not null").select("edge.*").coalesce(1).sortWithinPartitions("part")
    stitched = scratch.keep(edges.mapInArrow(_stitch(_arrow(STITCHED)), STITCHED), "stitched")
    pieces = swept.where("piece is not null").select("piece.*").repartition("key").sortWithinPartitions("key", "part", "seq")
    hashed = pieces.select("key", "ids").mapInArrow(_hash_pieces, "ends_key binary, hashed string")
    slots = stitched.where("slot is not null").select("slot.*")
    inner = swept.where("node is not null").select("node.*").join(slots, "parent_slot", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "slot_conv_id")).drop("slot_conv_id")
    path = stitched.where("node is not null").select("node.*").join(hashed, "ends_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "hashed")).drop("hashed")
    return inner.unionByName(path).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE = f"""
WITH crc AS ({CRC_TABLE_SQL}),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
shares AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, ({crc32_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % {SHARED_MOST})::BIGINT AS h FROM ids, crc),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) AS size FROM conversations WHERE conv_id IS NOT NULL),
parts AS (SELECT s.conv_id, t.pos, digest, size FROM shares s JOIN turns t ON t.conv_id = s.base AND t.pos <= s.h
  UNION ALL SELECT s.conv_id, t.pos, digest, size FROM shares s JOIN turns t ON t.conv_id = s.conv_id AND t.pos > s.h),
paths AS (SELECT conv_id, coalesce(list(digest ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path, coalesce(list(size ORDER BY pos) FILTER (pos IS NOT NULL), []) AS sizes FROM ids LEFT JOIN parts USING (conv_id) GROUP BY conv_id),
steps AS (SELECT conv_id, path, sizes, unnest(range(0, len(path) + 1)) AS depth FROM paths),
nodes AS (SELECT list_slice(path, 1, depth) AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(sizes[depth]), 0) AS size,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends FROM steps GROUP BY 1, 2),
children AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix)),
below AS (SELECT prefix, unnest(range(0, depth + 1)) AS d, depth, (n_children = 0)::INTEGER AS leaf, (n_convs - 1) * size AS saved FROM full_nodes),
sums AS (SELECT list_slice(prefix, 1, d) AS prefix, sum(leaf) AS n_leaves, sum(saved) AS saved FROM below GROUP BY 1)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums ON sums.prefix = n.prefix LEFT JOIN full_nodes p ON n.depth > 0 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)
"""
