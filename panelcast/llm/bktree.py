"""BK-trees over 64-bit fingerprints: children are keyed by their integer Hamming distance to the parent."""

from __future__ import annotations


class BKTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert and return the node's number; a value that is there already keeps its node."""
        if not self.values:
            return self._node(value)
        at = 0
        while True:
            distance = (self.values[at] ^ value).bit_count()
            if distance == 0:
                return at
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = node = self._node(value)
                return node
            at = below

    def _node(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of all nodes within ``radius``; only edges within it of the node's distance are followed."""
        found, pending = [], [0] if self.values else []
        while pending:
            at = pending.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) <= 2 * radius + 1:
                pending += [node for key, node in edges.items() if abs(key - distance) <= radius]
            else:
                pending += [edges[k] for k in range(max(1, distance - radius), distance + radius + 1) if k in edges]
        return found


def groups(values: list[int], radius: int) -> list[int]:
    """For each of the distinct ``values``, the place of the first value of its group of linked values."""
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = BKTree()
    for i, value in enumerate(values):
        for other in tree.near(value, radius):
            a, b = find(i), find(other)
            root[max(a, b)] = min(a, b)
        tree.add(value)
    return [find(i) for i in range(len(values))]
