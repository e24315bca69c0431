"""An adaptive radix tree over byte strings, and what a task reads off it.

Inner nodes hold 4, 16, 48 or 256 children and are resized as they fill. The
bytes that lead to a node without a branch are kept in it as one path. Nothing
here uses Spark; a tree holds the distinct sequences of one task.
"""

from __future__ import annotations

from bisect import bisect_left

#: children that the layouts of a node hold
SMALL, MEDIUM, INDEXED = 4, 16, 48
#: bytes of a turn id
TURN = 16


class Node:
    """``path``: the bytes that lead here from the parent; ``end``: the sequence that ends here, or -1.

    Up to 16 children: ``index`` holds their first bytes in order, beside them.
    Up to 48: ``index`` gives the place of each first byte plus one. Beyond that
    there is a place for each byte and no index.
    """

    __slots__ = ("path", "end", "room", "index", "children")

    def __init__(self, path: bytes, end: int = -1):
        self.path, self.end = path, end
        self.room, self.index, self.children = SMALL, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room <= MEDIUM:
            at = self.index.find(byte)
            return self.children[at] if at >= 0 else None
        if self.room == INDEXED:
            at = self.index[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def replace(self, byte: int, child: Node) -> None:
        if self.room <= MEDIUM:
            self.children[self.index.find(byte)] = child
        elif self.room == INDEXED:
            self.children[self.index[byte] - 1] = child
        else:
            self.children[byte] = child

    def add(self, child: Node) -> None:
        byte = child.path[0]
        if self.room <= INDEXED and len(self.children) == self.room:
            self.grow()
        if self.room <= MEDIUM:
            at = bisect_left(self.index, byte)
            self.index.insert(at, byte)
            self.children.insert(at, child)
        elif self.room == INDEXED:
            self.children.append(child)
            self.index[byte] = len(self.children)
        else:
            self.children[byte] = child

    def grow(self) -> None:
        """The next larger layout."""
        if self.room == SMALL:
            self.room = MEDIUM
        elif self.room == MEDIUM:
            index = bytearray(256)
            for at, byte in enumerate(self.index):
                index[byte] = at + 1
            self.room, self.index = INDEXED, index
        else:
            spread: list[Node | None] = [None] * 256
            for byte, at in enumerate(self.index):
                if at:
                    spread[byte] = self.children[at - 1]
            self.room, self.index, self.children = 256, None, spread

    def below(self) -> list[Node]:
        return self.children if self.room <= INDEXED else [c for c in self.children if c is not None]


def common(a: bytes, b: bytes) -> int:
    """How many bytes both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def insert(root: Node, key: bytes, end: int) -> None:
    """Adds a key that is not there yet; ``root`` has an empty path."""
    parent, node, at = None, root, 0
    while True:
        shared = common(node.path, key[at : at + len(node.path)])
        if shared < len(node.path):
            upper = Node(node.path[:shared])
            node.path = node.path[shared:]
            upper.add(node)
            parent.replace(upper.path[0], upper)
            node = upper
        at += shared
        if at == len(key):
            node.end = end
            return
        child = node.child(key[at])
        if child is None:
            node.add(Node(key[at:], end))
            return
        parent, node = node, child


def build(keys: list[bytes]) -> Node:
    root = Node(b"")
    for place, key in enumerate(keys):
        insert(root, key, place)
    return root


def post_order(root: Node):
    """(node, bytes up to it) of the whole tree, children before their parent."""
    stack = [(root, 0, False)]
    while stack:
        node, depth, seen = stack.pop()
        if seen:
            yield node, depth
        else:
            stack.append((node, depth, True))
            stack.extend((child, depth + len(child.path), False) for child in node.below())


class TurnNodes:
    """The nodes at turn-aligned depths, as parallel lists; a parent comes after its children.

    ``children``, ``leaves`` and ``saved`` count only what lies below children
    that no other task can hold (``holds`` 0); for a node that no other task can
    hold they are complete, its own part included.
    """

    def __init__(self, keys: list[bytes], counts: list[int], convs: list[int], points: list[list[int]], goes_on: list[bool]):
        first = min(range(len(keys)), key=keys.__getitem__)
        last = max(range(len(keys)), key=keys.__getitem__)
        self.first, self.last = first, last
        self.depth, self.parent, self.end, self.holds = [], [], [], []
        self.n, self.conv, self.point = [], [], []
        self.children, self.leaves, self.saved = [], [], []
        done: dict[int, tuple] = {}
        for node, stop in post_order(build(keys)):
            below = [done.pop(id(child)) for child in node.below()]
            tops = [top for own in below for top in own[0]]
            n, holds = sum(own[1] for own in below), 0
            for own in below:
                holds |= own[3]
            end = node.end
            if end >= 0:
                n += counts[end]
                holds |= (end == first) | (end == last) << 1
            # any sequence through here tells the turns of the path
            some = end if end >= 0 else below[0][4]
            conv = min([own[2] for own in below] + ([convs[end]] if end >= 0 else []))
            start = stop - len(node.path)
            for turns in range(stop // TURN, start // TURN if stop else -1, -1):
                here = end if end >= 0 and turns * TURN == stop else -1
                tops = [self._add(turns, tops, here, n, conv, holds, points[some][turns - 1] if turns else 0, here >= 0 and goes_on[here])]
            done[id(node)] = (tops, n, conv, holds, some)

    def _add(self, depth, tops, end, n, conv, holds, point, goes_on) -> int:
        at = len(self.depth)
        children = leaves = saved = 0
        for top in tops:
            self.parent[top] = at
            if not self.holds[top]:
                children += 1
                leaves += self.leaves[top]
                saved += self.saved[top]
        if not holds:
            children += goes_on
            leaves += goes_on or not tops
            saved += (n - 1) * point
        values = (depth, -1, end, holds, n, conv, point, children, leaves, saved)
        lists = (self.depth, self.parent, self.end, self.holds, self.n, self.conv, self.point, self.children, self.leaves, self.saved)
        for kept, value in zip(lists, values, strict=True):
            kept.append(value)
        return at
