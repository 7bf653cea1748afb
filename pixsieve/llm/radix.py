"""A compressed radix trie over byte strings whose terminal nodes carry a value, with eviction of whole subtrees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

LABEL, CHILDREN, VALUE = range(3)
#: What a node takes beside its label: a list, a dictionary, a value, a bytes object.
NODE_BYTES = 400


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving: every step compares slices at C speed."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTrie:
    """Full byte strings, path compressed: a node is [label, children by first byte, value or None].

    merge joins a terminal's value with the value of an equal string. `size` counts the bytes held: labels and NODE_BYTES a node.
    """

    def __init__(self, merge: Callable):
        self.merge = merge
        self.root: list = [b"", {}, None]
        self.size = 0
        self.held: dict[int, int] = {}

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[CHILDREN].get(key[at])
            if child is None:
                node[CHILDREN][key[at]] = [key[at:], {}, value]
                self.grow(key, len(key) - at + NODE_BYTES)
                return
            label = child[LABEL]
            same = len(label) if key.startswith(label, at) else common_prefix(label, key[at : at + len(label)])
            if same < len(label):  # split the edge
                lower = [label[same:], child[CHILDREN], child[VALUE]]
                child[LABEL], child[CHILDREN], child[VALUE] = label[:same], {label[same]: lower}, None
                self.grow(key, NODE_BYTES)
            node, at = child, at + same
        node[VALUE] = value if node[VALUE] is None else self.merge(node[VALUE], value)

    def grow(self, key: bytes, n: int) -> None:
        self.size += n
        self.held[key[0]] = self.held.get(key[0], 0) + n

    def items(self, node: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """(string, value) of every terminal, in no set order."""
        todo = [(node or self.root, prefix)]
        while todo:
            node, prefix = todo.pop()
            prefix += node[LABEL]
            if node[VALUE] is not None:
                yield prefix, node[VALUE]
            todo.extend((child, prefix) for child in node[CHILDREN].values())

    def evict(self) -> Iterator[tuple[bytes, object]]:
        """Cuts off the largest subtree under the root and gives its terminals."""
        first = max(self.held, key=self.held.get)
        self.size -= self.held.pop(first)
        return self.items(self.root[CHILDREN].pop(first))
