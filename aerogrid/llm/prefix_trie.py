"""Trie of conversation prefixes by adaptive radix trees.

A turn is an id of fixed width: four big-endian bytes with the length of its text and the md5 of its role and text.  A
conversation is the string of its turns' ids.  Equal conversations are one key; the keys are sorted into ranges, and
each range becomes a radix tree in a task, whose byte depths at whole turns are the nodes.

Every number of a node is a sum over ranges, given how many turns a range's first and last key have in common with their
neighbours: a node is introduced (counted as a child, its text counted once) by the first key that has it.
So only the nodes that lie on a border between ranges are put together afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerogrid.llm.common import broadcast_if_small
from aerogrid.llm.radix import RadixTree, common_start
from aerogrid.session import settle

TURN = 20  # bytes of a turn's id
RANGE_BYTES = 4_000_000  # of keys that one tree holds
CUT_TURNS = 64  # first turns by which keys are dealt to ranges
SHARED_TURNS = 8  # the most that a rebuilt conversation takes over


def turn_id(role: Column, text: Column) -> Column:
    """The turn's id as 40 hexadecimal digits."""
    name = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(F.lpad(F.hex(F.octet_length(text)), 8, "0"), name)


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv, ids (its turns' ids in order)."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.struct(F.col(f"`{turn_col}`").alias("turn"), turn_id(role, text).alias("id")).alias("t"))
    ordered = turns.where("conv IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv", F.col("t.id").alias("ids"))


def shared_starts(found: DataFrame) -> DataFrame:
    """Conversation c becomes the first h turns of c - c % 5 and its own after its first h; h is crc32(c) % 9."""
    heads = found.select(F.col("conv").alias("_head"), F.slice("ids", 1, SHARED_TURNS).alias("_start"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(SHARED_TURNS + 1)).cast("int")
    joined = found.join(heads, F.col("conv") - F.col("conv") % 5 == F.col("_head"), "left").withColumn("_h", h)
    start = F.slice(F.coalesce("_start", F.array().cast("array<string>")), F.lit(1), F.col("_h"))
    own = F.slice("ids", F.col("_h") + 1, F.greatest(F.size("ids"), F.lit(1)))
    return joined.select("conv", F.concat(start, own).alias("ids"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, n, conv, ends) of each key from its sorted conversations, of which one batch is held at a time."""
    name, n, least, digest = None, 0, 0, hashlib.sha256()
    for batch in batches:
        names, convs, out = batch["name"].to_pylist(), batch["conv"].to_pylist(), []
        starts = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
        for i, j in zip(starts, starts[1:], strict=False):
            if names[i : i + 1] != [name]:
                if n:
                    out.append((name, n, least, digest.hexdigest()))
                name, n, least, digest = names[i], 0, convs[i], hashlib.sha256()
            digest.update(("," * (n > 0) + ",".join(map(str, convs[i:j]))).encode())
            n += j - i
        if out:
            yield _rows(out, _ENDS)
    if n:
        yield _rows([(name, n, least, digest.hexdigest())], _ENDS)


_ENDS = pa.schema([("name", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
_BORDER = pa.schema([("part", pa.int32()), ("first", pa.binary()), ("last", pa.binary())])
_SHARED = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("after", pa.int64())])
_NODES = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("node", pa.binary()), ("above", pa.binary())]
)
_NODES_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, above binary"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = first = last = None
    for batch in batches:
        if len(batch):
            part = batch["part"][0].as_py() if part is None else part
            first = batch["key"][0].as_py() if first is None else first
            last = batch["key"][len(batch) - 1].as_py()
    if part is not None:
        yield _rows([(part, first, last)], _BORDER)


def _shared_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many turns each range's first key shares with the key before, and its last with the key after; -1 without one."""
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("part", "first", "last", "before", "after")]
        rows = []
        for part, first, last, before, after in zip(*columns, strict=True):
            rows.append((part, *(-1 if b is None else common_start(a, b, 0) // TURN for a, b in ((first, before), (last, after)))))
        if rows:
            yield _rows(rows, _SHARED)


def _node_names(key: bytes, upto: int) -> list[bytes]:
    """Names of the nodes on the path of a key, to depth `upto`."""
    digest, names = hashlib.md5(), []
    for depth in range(upto + 1):
        names.append(digest.digest())
        digest.update(key[depth * TURN : (depth + 1) * TURN])
    return names


def tree_nodes(keys: list[bytes], counts: list[int], least: list[int], ends: list[str], before: int, after: int) -> Iterator[tuple]:
    """The nodes of one range's sorted distinct keys, as rows of `_NODES`; those shared with other ranges bear a name."""
    above, depths, widths, last_at, at_end = [-1], [0], [0], {}, [-1] * len(keys)
    for node, number, parent, depth in RadixTree(keys).walk():
        at, start = (last_at[parent] if parent >= 0 else 0), depths[last_at[parent]] if parent >= 0 else 0
        key = keys[node.some]
        for d in range(start + 1, depth // TURN + 1):  # byte depths at whole turns
            above.append(at)
            depths.append(d)
            widths.append(int.from_bytes(key[(d - 1) * TURN : (d - 1) * TURN + 4], "big"))
            at = len(above) - 1
        last_at[number] = at
        if node.end >= 0:
            at_end[node.end] = at
    size = len(above)
    convs, first, shown = [0] * size, [None] * size, [None] * size
    for i, at in enumerate(at_end):
        convs[at], first[at], shown[at] = counts[i], least[i], ends[i]
    names: list[bytes | None] = [None] * size
    introduced = [True] * size
    for key, end, upto, known in ((keys[0], at_end[0], before, True), (keys[-1], at_end[-1], after, False)):
        at, path = end, _node_names(key, upto)
        while at >= 0:
            if depths[at] <= upto:
                names[at] = path[depths[at]]
                introduced[at] = introduced[at] and not known
            at = above[at]
    children, below, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size
    for at in range(size - 1, -1, -1):  # parents come before their children
        if not below[at] and not (at == at_end[-1] and after == depths[at]):
            leaves[at] = 1
        saved[at] += (convs[at] - introduced[at]) * widths[at]
        up = above[at]
        if up >= 0:
            convs[up] += convs[at]
            first[up] = first[at] if first[up] is None else min(first[up], first[at])
            children[up] += introduced[at]
            below[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    for at in range(size):
        up = above[at]
        yield first[at], depths[at], first[up] if up >= 0 else None, convs[at], children[at], leaves[at], saved[at], shown[at], names[at], names[up] if up >= 0 else None


def _trees(shared: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in batches if len(b)]
        if not filled:
            return
        held = pa.Table.from_batches(filled)
        before, after = shared[held["part"][0].as_py()]
        out = []
        for row in tree_nodes(*(held[c].to_pylist() for c in ("key", "n", "least", "ends")), before, after):
            out.append(row)
            if len(out) == 10_000:
                yield _rows(out, _NODES)
                out = []
        if out:
            yield _rows(out, _NODES)

    return run


def prefix_nodes(found: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per distinct start of the sequences (conv, ids): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = found.sparkSession
    keyed = settle(found.select("conv", F.unhex(F.array_join("ids", "")).alias("key")).withColumn("name", F.unhex(F.md5("key"))))
    ended = keyed.select("name", "conv").repartition("name").sortWithinPartitions("name", "conv").mapInArrow(_ends, "name binary, n long, least long, ends string")
    distinct = settle(ended.select("n", "least", "ends").join(keyed.select(F.col("conv").alias("least"), "key"), "least"))
    total = distinct.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // range_bytes + 1)
    dealt = distinct.repartitionByRange(parts, F.substring("key", 1, CUT_TURNS * TURN)).sortWithinPartitions("key")
    ordered = settle(dealt.withColumn("part", F.spark_partition_id()))

    side = Window.orderBy("part")  # over one row per range
    borders = ordered.select("part", "key").mapInArrow(_borders, "part int, first binary, last binary")
    beside = borders.withColumn("before", F.lag("last").over(side)).withColumn("after", F.lead("first").over(side))
    shared = {r.part: (r.before, r.after) for r in beside.mapInArrow(_shared_turns, "part int, before long, after long").collect()}

    nodes = settle(ordered.mapInArrow(_trees(shared), _NODES_SQL))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = nodes.where("node IS NOT NULL").groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.max("above").alias("above"))
    merged = settle(merged)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    names = broadcast_if_small(merged.select(F.col("node").alias("above"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")))
    inside = nodes.where("node IS NULL AND above IS NULL").select(columns)
    at_border = nodes.where("node IS NULL AND above IS NOT NULL").drop("parent_conv_id", "node").unionByName(merged.drop("node"))
    known = at_border.join(names, ["above", "depth"], "left").select(columns)
    return inside.unionByName(known).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def conversation_trie(conversations: DataFrame, range_bytes: int = RANGE_BYTES, **columns: str) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, as `prefix_nodes` gives them.

    Turns are ordered by turn (null first), ties by the turn's id; null roles and texts count as empty; rows
    without a conversation id belong to none and are left out; repeated rows are repeated turns; other columns are ignored.  An
    empty table gives no nodes, not even a root, as no conversation would be its member.  A conversation's ids are one value
    of 20 bytes a turn.
    """
    return prefix_nodes(shared_starts(settle(sequences(conversations, **columns))), range_bytes)
