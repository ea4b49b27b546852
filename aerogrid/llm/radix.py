"""Adaptive radix tree: a byte trie with path compression and node layouts that grow with the children.

A node keeps its children in the smallest of four layouts: 4 or 16 sorted bytes beside their children, 48
children behind an index of 256 bytes, or 256 places.  Only the layout is exchanged when a node grows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class _Sorted:
    """Up to `room` children beside their sorted bytes."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self, room: int, pairs: Iterator[tuple[int, Node]] = iter(())):
        self.room, self.bytes, self.nodes = room, bytearray(), []
        for byte, node in pairs:
            self.bytes.append(byte)
            self.nodes.append(node)

    def find(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return None if at < 0 else self.nodes[at]

    def full(self) -> bool:
        return len(self.nodes) == self.room

    def put(self, byte: int, node: Node) -> None:
        at = bisect_left(self.bytes, byte)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)

    def grown(self) -> _Sorted | _Indexed:
        return _Sorted(16, self.pairs()) if self.room == 4 else _Indexed(self.pairs())

    def pairs(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.nodes, strict=True)


class _Indexed:
    """Up to 48 children; a byte's entry in the index is its child's place plus one."""

    __slots__ = ("index", "nodes")

    def __init__(self, pairs: Iterator[tuple[int, Node]]):
        self.index, self.nodes = bytearray(256), []
        for byte, node in pairs:
            self.put(byte, node)

    def find(self, byte: int) -> Node | None:
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def full(self) -> bool:
        return len(self.nodes) == 48

    def put(self, byte: int, node: Node) -> None:
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)

    def grown(self) -> _Direct:
        return _Direct(self.pairs())

    def pairs(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.nodes[at - 1]) for byte, at in enumerate(self.index) if at)


class _Direct:
    """A place for every byte."""

    __slots__ = ("nodes",)

    def __init__(self, pairs: Iterator[tuple[int, Node]]):
        self.nodes: list[Node | None] = [None] * 256
        for byte, node in pairs:
            self.nodes[byte] = node

    def find(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def full(self) -> bool:
        return False

    def put(self, byte: int, node: Node) -> None:
        self.nodes[byte] = node

    def pairs(self) -> Iterator[tuple[int, Node]]:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


class Node:
    """The bytes up to this node after its parent's branch, the key that ends here (or -1), one key below it, and the children."""

    __slots__ = ("prefix", "end", "some", "layout")

    def __init__(self, prefix: bytes, end: int, some: int):
        self.prefix, self.end, self.some, self.layout = prefix, end, some, _Sorted(4)

    def add(self, byte: int, child: Node) -> None:
        if self.layout.full():
            self.layout = self.layout.grown()
        self.layout.put(byte, child)


def common_start(prefix: bytes, key: bytes, at: int) -> int:
    """Length of the common start of `prefix` and `key` from `at` on."""
    low, high = 0, min(len(prefix), len(key) - at)
    if prefix[:high] == key[at : at + high]:
        return high
    while low + 1 < high:  # equal up to low, not up to high
        mid = (low + high) // 2
        low, high = (mid, high) if prefix[low:mid] == key[at + low : at + mid] else (low, mid)
    return low


class RadixTree:
    """Keys are distinct byte strings, of which one may begin another; they are known by their number."""

    def __init__(self, keys: list[bytes]):
        self.keys = keys
        self.root = Node(b"", -1, 0)
        for number, key in enumerate(keys):
            self._insert(number, key)

    def _insert(self, number: int, key: bytes) -> None:
        node, at = self.root, 0
        while True:
            same = common_start(node.prefix, key, at)
            if same < len(node.prefix):  # the compressed path splits here
                lower = Node(node.prefix[same + 1 :], node.end, node.some)
                lower.layout = node.layout
                byte, node.prefix, node.end, node.layout = node.prefix[same], node.prefix[:same], -1, _Sorted(4)
                node.add(byte, lower)
            at += same
            if at == len(key):
                node.end = number
                return
            child = node.layout.find(key[at])
            if child is None:
                node.add(key[at], Node(key[at + 1 :], number, number))
                return
            node, at = child, at + 1

    def walk(self) -> Iterator[tuple[Node, int, int, int]]:
        """(node, its number, its parent's number or -1, bytes from the root to its end), parents first, in key order."""
        stack, number = [(self.root, -1, len(self.root.prefix))], 0
        while stack:
            node, parent, depth = stack.pop()
            yield node, number, parent, depth
            for _, child in reversed(list(node.layout.pairs())):
                stack.append((child, number, depth + 1 + len(child.prefix)))
            number += 1
