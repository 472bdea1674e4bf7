"""A minimal acyclic transducer from words to numbers, as flat arrays in one file.

Sorted words share their beginnings while they are inserted and their endings once a
branch is closed: a closed node equal to an earlier one is replaced by it. Each arc
outputs how many words come before its branch, so the outputs along a word add up to
its row in a table of ids.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable

import numpy as np

MAGIC = 0x4C455831


class _Node:
    __slots__ = ("final", "arcs", "words")

    def __init__(self):
        self.final = False
        self.arcs: dict[int, _Node] = {}
        self.words = 0

    def key(self):
        return self.final, tuple((label, id(node)) for label, node in self.arcs.items())


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file of the transducer; ``entries`` are sorted by their distinct words."""
    root, register = _Node(), {}
    path: list[tuple[_Node, int, _Node]] = []
    previous, ids, ends = b"", [], [0]

    def close(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            child.words = child.final + sum(n.words for n in child.arcs.values())
            parent.arcs[label] = register.setdefault(child.key(), child)

    for word, output in entries:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        close(shared)
        node = path[-1][2] if path else root
        for label in word[shared:]:
            child = _Node()
            node.arcs[label] = child
            path.append((node, label, child))
            node = child
        node.final = True
        previous = word
        ids += output
        ends.append(len(ids))
    close(0)

    order, index = [root], {id(root): 0}
    first, finals, labels, targets, outputs = [0], [], [], [], []
    for node in order:
        before = int(node.final)
        finals.append(int(node.final))
        for label, child in node.arcs.items():
            if id(child) not in index:
                index[id(child)] = len(order)
                order.append(child)
            labels.append(label)
            targets.append(index[id(child)])
            outputs.append(before)
            before += child.words
        first.append(len(labels))
    parts = [first, finals, labels, targets, outputs, ends, ids]
    head = np.asarray([MAGIC, *map(len, parts)], "<u4")
    return b"".join([head.tobytes(), *(np.asarray(p, "<u4").tobytes() for p in parts)])


class Lexicon:
    """Looks words up in a memory-mapped transducer, many at a time."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        numbers = np.frombuffer(self.map, "<u4")
        if numbers[0] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        ends = 8 + np.cumsum([0, *numbers[1:8].tolist()])
        parts = [numbers[a:b] for a, b in zip(ends[:-1], ends[1:])]
        self.first, self.finals, labels, self.targets, self.outputs, self.ends, self.ids = parts
        # Arcs are in the order of their nodes, and of their labels within one.
        nodes = np.repeat(np.arange(len(self.finals), dtype=np.int64), np.diff(self.first.astype(np.int64)))
        self.arcs = nodes << 8 | labels

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as 32-bit numbers, or None where the lexicon lacks it."""
        found: list[bytes | None] = [None] * len(words)
        size = np.array([*map(len, words)], np.int64)
        begin = np.cumsum(size) - size
        letters = np.frombuffer(b"".join(words), np.uint8)
        node, row = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.nonzero(size)[0]
        depth = 0
        while len(live) and len(self.arcs):
            key = node[live] << 8 | letters[begin[live] + depth]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            goes = self.arcs[arc] == key
            live, arc = live[goes], arc[goes]
            row[live] += self.outputs[arc]
            node[live] = self.targets[arc]
            depth += 1
            ended = size[live] == depth
            for i in live[ended & (self.finals[node[live]] == 1)].tolist():
                found[i] = self.ids[self.ends[row[i]] : self.ends[row[i] + 1]].tobytes()
            live = live[~ended]
        return found
