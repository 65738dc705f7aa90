"""An adaptive radix tree over byte keys: node layouts grow with their children, and paths without branches are one edge."""

from __future__ import annotations

from collections.abc import Iterator


class Small:
    """Up to 4, then up to 16 children: their bytes beside each other."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self):
        self.bytes, self.nodes, self.room = bytearray(), [], 4

    def find(self, byte: int) -> Node | None:
        i = self.bytes.find(byte)
        return self.nodes[i] if i >= 0 else None

    def put(self, byte: int, node: Node) -> Small | Indexed:
        i = self.bytes.find(byte)
        if i >= 0:
            self.nodes[i] = node
            return self
        if len(self.nodes) == 16:
            return Indexed(self).put(byte, node)
        if len(self.nodes) == self.room:
            self.room = 16
        self.bytes.append(byte)
        self.nodes.append(node)
        return self

    def children(self) -> list[Node]:
        return self.nodes


class Indexed:
    """Up to 48 children: a place for every byte, which tells where its child is."""

    __slots__ = ("index", "nodes")

    def __init__(self, small: Small):
        self.index, self.nodes = bytearray(256), list(small.nodes)
        for i, byte in enumerate(small.bytes):
            self.index[byte] = i + 1

    def find(self, byte: int) -> Node | None:
        i = self.index[byte]
        return self.nodes[i - 1] if i else None

    def put(self, byte: int, node: Node) -> Indexed | Full:
        i = self.index[byte]
        if i:
            self.nodes[i - 1] = node
        elif len(self.nodes) == 48:
            return Full(self).put(byte, node)
        else:
            self.nodes.append(node)
            self.index[byte] = len(self.nodes)
        return self

    def children(self) -> list[Node]:
        return self.nodes


class Full:
    """A child for each byte."""

    __slots__ = ("nodes",)

    def __init__(self, indexed: Indexed):
        self.nodes = [indexed.nodes[i - 1] if i else None for i in indexed.index]

    def find(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Full:
        self.nodes[byte] = node
        return self

    def children(self) -> list[Node]:
        return [n for n in self.nodes if n is not None]


class Node:
    """``depth`` bytes of key ``key`` lead here; the key that ends here is ``end``, or -1. Callers may keep values in ``held``."""

    __slots__ = ("depth", "key", "end", "layout", "held")

    def __init__(self, depth: int, key: int, end: int):
        self.depth, self.key, self.end, self.layout, self.held = depth, key, end, None, None

    def put(self, byte: int, node: Node) -> None:
        self.layout = (self.layout or Small()).put(byte, node)

    def children(self) -> list[Node]:
        return self.layout.children() if self.layout else []


class Tree:
    """Distinct keys by their place in a list; keys may begin with other keys."""

    def __init__(self, keys: list[bytes]):
        self.keys, self.root = keys, Node(0, 0, -1)

    def insert(self, i: int) -> None:
        key, node, above, depth = self.keys[i], self.root, None, 0
        while True:
            stop = min(node.depth, len(key))
            same = _same(key, self.keys[node.key], depth, stop)
            if same < node.depth:  # the edge to node is parted where the keys part, or where this one ends
                fork = Node(same, i, -1)
                fork.put(self.keys[node.key][same], node)
                if same == len(key):
                    fork.end = i
                else:
                    fork.put(key[same], Node(len(key), i, i))
                above.put(key[above.depth], fork)
                return
            if len(key) == node.depth:
                if node.end >= 0:
                    raise ValueError("a key occurs twice")
                node.end = i
                return
            found = node.layout.find(key[node.depth]) if node.layout else None
            if found is None:
                node.put(key[node.depth], Node(len(key), i, i))
                return
            above, depth, node = node, node.depth, found

    def path(self, key: bytes) -> Iterator[Node]:
        """The nodes from the root to the one where this key, which is in the tree, ends."""
        node = self.root
        yield node
        while node.depth < len(key):
            node = node.layout.find(key[node.depth])
            yield node

    def walk(self) -> Iterator[tuple[Node, Node | None]]:
        """All nodes with the one above, each before those below it."""
        todo: list[tuple[Node, Node | None]] = [(self.root, None)]
        while todo:
            pair = todo.pop()
            yield pair
            todo.extend((child, pair[0]) for child in pair[0].children())


def _same(a: bytes, b: bytes, start: int, stop: int) -> int:
    """Where two keys that agree up to start part, at stop at the latest."""
    x, y = a[start:stop], b[start:stop]
    if x == y:
        return stop
    return stop - (((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) >> 3)
