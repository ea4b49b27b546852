"""Trie nodes against brute force over all prefixes, and the tree against a dictionary."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from aerogrid.llm.prefix_trie import conversation_trie
from aerogrid.llm.radix import RadixTree

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_name(role, text):
    return f"{len(text.encode()):08X}" + hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def expected(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, turn_name(role or "", text or ""), role or "", text or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - int(abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)

    def below(seq):
        stack = [seq]
        while stack:
            yield (s := stack.pop())
            stack.extend(children[s])

    out = []
    for seq, own in members.items():
        subtree = list(below(seq))
        saved = sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in subtree if s)
        shown = ",".join(map(str, sorted(ends[seq])))
        leaves = sum(not children[s] for s in subtree)
        out.append((min(own), len(seq), min(members[seq[:-1]]) if seq else None, len(own), len(children[seq]), leaves, saved, hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string, n int, `key` binary"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


@pytest.mark.parametrize("keys", [64, 3000])
def test_tree_holds_keys_in_order(keys):
    rng = random.Random(3)
    made = {bytes(rng.choices(range(rng.choice([2, 20, 256])), k=rng.randrange(0, 9))) for _ in range(keys)}
    made |= {b"x" * n for n in range(0, 4000, 97)} | {bytes([b]) + b"tail" for b in range(256)}
    order = list(made)
    rng.shuffle(order)
    walked = [order[n.end] for n, *_ in RadixTree(order).walk() if n.end >= 0]
    assert walked == sorted(made)


def test_layouts_grow_with_the_children():
    for n, name, room in ((3, "_Sorted", 4), (16, "_Sorted", 16), (17, "_Indexed", 48), (48, "_Indexed", 48), (49, "_Direct", 256), (256, "_Direct", 256)):
        keys = [bytes([b]) for b in random.Random(n).sample(range(256), n)]
        tree = RadixTree(keys)
        assert type(tree.root.layout).__name__ == name and getattr(tree.root.layout, "room", room) == room
        assert [keys[node.end] for node, *_ in tree.walk() if node.end >= 0] == sorted(keys)


def test_whole_table_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert got(conversation_trie(table)) == expected([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_shared_starts_over_many_ranges(spark):
    """Few different turns, so that nodes lie on many borders and keys are starts of others."""
    rng = random.Random(7)
    rows = []
    for c in rng.sample(range(-40, 400), 260):
        hot = rng.random() < 0.4
        rows += [(c, t, "user" if t % 2 else "assistant", "same" if hot else rng.choice(["a", "bé", "", "same"])) for t in range(rng.randrange(1, 14))]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert got(conversation_trie(frame(spark, rows), range_bytes=200)) == expected(rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark):
    rows = [
        (5, None, None, None),
        (5, 1, "user", "x" * 100_000),
        (5, 1, "user", "a"),
        (5, 1, "user", "a"),
        (6, 3, "", "é\n"),
        (7, 1, "user", "only here"),
        (None, 1, "user", "of none"),
        (-3, None, "system", ""),
        (-3, None, "system", None),
        (1000, 1, "u", "long"),
        *[(10, t, "user", str(t % 7)) for t in range(1500)],
        *[(11, t, "user", str(t % 7)) for t in range(1500)],
    ]
    assert got(conversation_trie(frame(spark, rows))) == expected(rows)


def test_empty_table(spark):
    assert got(conversation_trie(frame(spark, []))) == []
