"""Adaptive radix tree over byte strings made of fixed-width pieces.

Nodes have one of four layouts and move to the next when they are full: 4 or 16 sorted edge bytes beside their children,
48 children behind a table of 256 bytes, 256 children.  Bytes that all keys below a node share are kept in the node and
not as nodes of their own.  A key may be the beginning of another one; values hang on the node where their key ends.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Sorted:
    """Up to ``room`` edge bytes in order, and their children in the same order."""

    __slots__ = ("children", "edges", "room")

    def __init__(self, room: int, edges: bytes = b"", children: list | None = None):
        self.room, self.edges, self.children = room, bytearray(edges), children or []

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.edges, byte)
        return self.children[at] if at < len(self.edges) and self.edges[at] == byte else None

    def put(self, byte: int, child: Node) -> Sorted | Indexed:
        at = bisect_left(self.edges, byte)
        if at < len(self.edges) and self.edges[at] == byte:
            self.children[at] = child
            return self
        if len(self.edges) < self.room:
            self.edges.insert(at, byte)
            self.children.insert(at, child)
            return self
        larger = Sorted(16, self.edges, self.children) if self.room == 4 else Indexed(self)
        return larger.put(byte, child)

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.edges, self.children, strict=True)


class Indexed:
    """Up to 48 children in order of arrival, found by a table of 256 places."""

    __slots__ = ("children", "places")

    def __init__(self, smaller: Sorted):
        self.places, self.children = bytearray(256), list(smaller.children)
        for place, byte in enumerate(smaller.edges, 1):
            self.places[byte] = place

    def get(self, byte: int) -> Node | None:
        place = self.places[byte]
        return self.children[place - 1] if place else None

    def put(self, byte: int, child: Node) -> Indexed | Full:
        if place := self.places[byte]:
            self.children[place - 1] = child
            return self
        if len(self.children) == 48:
            return Full(self).put(byte, child)
        self.children.append(child)
        self.places[byte] = len(self.children)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.children[place - 1]) for byte, place in enumerate(self.places) if place)


class Full:
    """A child for every byte."""

    __slots__ = ("children",)

    def __init__(self, smaller: Indexed):
        self.children = [None] * 256
        for byte, child in smaller.items():
            self.children[byte] = child

    def get(self, byte: int) -> Node | None:
        return self.children[byte]

    def put(self, byte: int, child: Node) -> Full:
        self.children[byte] = child
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, child) for byte, child in enumerate(self.children) if child)


class Node:
    """``path``: the bytes between the edge to the node and the node itself; ``values`` of the key that ends here."""

    __slots__ = ("layout", "path", "values")

    def __init__(self, path: bytes):
        self.path, self.values, self.layout = path, [], Sorted(4)

    def put(self, byte: int, child: Node) -> None:
        self.layout = self.layout.put(byte, child)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


class Tree:
    """Keys with any number of values each; the root has no path."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.layout.get(key[at])
            if child is None:
                leaf = Node(key[at + 1 :])
                node.put(key[at], leaf)
                leaf.values.append(value)
                return
            rest = key[at + 1 : at + 1 + len(child.path)]
            same = _shared(child.path, rest)
            if same < len(child.path):  # the path is cut where the key leaves it
                upper = Node(child.path[:same])
                upper.put(child.path[same], child)
                child.path = child.path[same + 1 :]
                node.put(key[at], upper)
                child = upper
            node, at = child, at + 1 + same
        node.values.append(value)

    def postorder(self) -> Iterator[tuple[Node, int, Node | None, int]]:
        """(node, its byte depth, the node above, the edge's byte), children before their parent; depth is no recursion."""
        stack = [(self.root, 0, None, 0, False)]
        while stack:
            node, depth, parent, byte, done = stack.pop()
            if done:
                yield node, depth, parent, byte
                continue
            stack.append((node, depth, parent, byte, True))
            stack += [(child, depth + 1 + len(child.path), node, b, False) for b, child in node.layout.items()]
