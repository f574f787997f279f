"""Patricia tries of whole byte strings, whose terminal nodes own their copies.

An edge holds all bytes up to the next branching, so a trie has at most two nodes per string.
The bytes held are counted. Beyond a budget the largest subtree below the root is taken out and
its place is marked; strings that lead there later are refused, so all copies of a string are
either in the trie at its end or outside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Counted per node and per terminal besides its bytes: what Python's objects take.
NODE_BYTES = 400


class Node:
    __slots__ = ("edge", "below", "entry", "moved")

    def __init__(self, edge: bytes, entry: list | None = None):
        self.edge = edge
        self.below: dict[int, Node] = {}
        self.entry = entry
        self.moved = False


def shared_prefix(text: bytes, at: int, edge: bytes) -> int:
    """How many bytes of ``edge`` stand in ``text`` from ``at`` on."""
    if text.startswith(edge, at):
        return len(edge)
    n = min(len(edge), len(text) - at)
    if n > 64:
        differ = np.frombuffer(text, np.uint8, n, at) != np.frombuffer(edge, np.uint8, n)
        return int(differ.argmax()) if differ.any() else n
    i = 0
    while i < n and text[at + i] == edge[i]:
        i += 1
    return i


class Trie:
    """Strings with the rank of their best owner and the number of their copies.

    A smaller rank (any tuple) is better. ``held`` is the number of bytes that the trie takes.
    """

    def __init__(self) -> None:
        self.root = Node(b"")
        self.held = 0

    def insert(self, text: bytes, rank: tuple, copies: int, mark: object) -> bool:
        """Puts a string at its terminal node. False if its subtree has been taken out.

        ``mark`` stays with a new terminal.
        """
        node, at = self.root, 0
        while True:
            if node.moved:
                return False
            if at == len(text):
                return self._own(node, rank, copies, mark)
            child = node.below.get(text[at])
            if child is None:
                leaf = Node(text[at:])
                node.below[text[at]] = leaf
                self.held += len(leaf.edge) + NODE_BYTES
                return self._own(leaf, rank, copies, mark)
            same = shared_prefix(text, at, child.edge)
            if same < len(child.edge):
                upper = Node(child.edge[:same])
                node.below[text[at]] = upper
                child.edge = child.edge[same:]
                upper.below[child.edge[0]] = child
                self.held += NODE_BYTES
                child = upper
            node, at = child, at + same

    def _own(self, node: Node, rank: tuple, copies: int, mark: object) -> bool:
        if node.entry is None:
            node.entry = [rank, copies, mark]
        else:
            if rank < node.entry[0]:
                node.entry[0] = rank
            node.entry[1] += copies
        return True

    def terminals(self, top: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """(string, [rank, copies, mark]) of all terminals at and below ``top``."""
        # One buffer holds the path; what was pushed with a node says how much of it leads there.
        path, todo = bytearray(before), [(top or self.root, len(before))]
        while todo:
            node, start = todo.pop()
            del path[start:]
            path += node.edge
            if node.entry is not None:
                yield bytes(path), node.entry
            todo += [(child, len(path)) for child in node.below.values()]

    def entries(self) -> Iterator[list]:
        """[rank, copies, mark] of all terminals; their strings are not put together."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.entry is not None:
                yield node.entry
            todo += node.below.values()

    def take_largest(self) -> Iterator[tuple[bytes, list]] | None:
        """The terminals of the subtree that holds most, which is taken out: its strings are refused from now on.

        Where one child holds everything, the subtree is looked for below it. None if only a
        single terminal is left, so that every trie comes to an end with some string.
        """
        node, before = self.root, b""
        while True:
            before += node.edge
            open_below = [c for c in node.below.values() if not c.moved]
            if len(open_below) != 1 or node.entry is not None:
                break
            node = open_below[0]
        if not open_below:
            return None
        weights = self._weights()
        best = max(open_below, key=lambda c: weights[id(c)])
        apart = Node(best.edge, best.entry)
        apart.below = best.below
        self.held -= weights[id(best)] - len(best.edge) - NODE_BYTES
        best.below, best.entry, best.moved = {}, None, True
        return self.terminals(apart, before)

    def _weights(self) -> dict[int, int]:
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.below.values()
        weights: dict[int, int] = {}
        for node in reversed(order):
            weights[id(node)] = len(node.edge) + NODE_BYTES + sum(weights[id(c)] for c in node.below.values())
        return weights
