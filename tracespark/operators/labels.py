"""Hashes of the texts of subtrees without the texts.

A subtree is spelt with a line for each opening and closing, indented by depth, and its signature is the FNV-1a
hash of that text. One byte takes a state h to (h ^ byte) * prime, and as the exclusive or touches the low
byte alone, a whole string takes h to h * prime ** length + add[h & 255], with 256 numbers `add` that depend on
the string. So a line costs the same however far it is indented, and one walk of a tree carries the states of
all open subtrees in an array. Trees that have occurred in the task are looked up: labels number
subtrees from below by name and labels of children, and only trees with a new label are walked.
"""

from __future__ import annotations

import numpy as np

# Start and prime of FNV-1a with 64 bits.
START, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
LOW = np.uint64(255)
#: Labels that are kept by a task.
KEPT = 1_000_000
#: Trees of at most so many levels are walked in whole numbers of Python, which cost less than arrays so short, by at most so
#: many lines at once.
SHALLOW, LINES = 12, 4096
ALL = 2**64 - 1


def function_of(text: bytes) -> tuple[np.uint64, np.ndarray]:
    """(prime ** length, add): what a string does to a state."""
    h, power = np.arange(256, dtype=np.uint64), np.ones(1, np.uint64)
    for b in text:
        h = (h ^ np.uint64(b)) * PRIME
        power = power * PRIME
    return power[0], h - np.arange(256, dtype=np.uint64) * power[0]


class Indents:
    """The functions of 0, 2, 4, ... spaces, as many as are asked for."""

    def __init__(self):
        self.power, self.add = np.ones(1, np.uint64), np.zeros((1, 256), np.uint64)

    def upto(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        have = len(self.power)
        if have < depth:
            low = np.arange(256, dtype=np.uint64)
            power, add = np.empty(max(depth, 2 * have), np.uint64), np.empty((max(depth, 2 * have), 256), np.uint64)
            power[:have], add[:have] = self.power, self.add
            square = np.full(1, PRIME) * PRIME
            for k in range(have, len(power)):
                h = low * power[k - 1] + add[k - 1]
                h = ((((h ^ np.uint64(32)) * PRIME) ^ np.uint64(32)) * PRIME)
                power[k] = (power[k - 1 : k] * square)[0]
                add[k] = h - low * power[k]
            self.power, self.add = power, add
        return self.power, self.add


class Labels:
    """What a task knows of subtrees: a number for each different one, and its hash."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.hash: list[int | np.uint64] = []
        self.lines: dict[str, tuple[np.uint64, np.ndarray]] = {}
        self.indents = Indents()
        self.whole: dict[str, tuple[int, list[int]]] = {}
        self.spaces = [(int(p), a.tolist()) for p, a in zip(*(x[:SHALLOW] for x in self.indents.upto(SHALLOW)), strict=True)]

    def line(self, text: str) -> tuple[np.uint64, np.ndarray]:
        if text not in self.lines:
            self.lines[text] = function_of((text + "\n").encode())
        return self.lines[text]

    def of_tree(self, names: list[str], sizes: list[int], depths: list[int]) -> list[int | np.uint64]:
        """The hash of every subtree of one tree, whose spans come in the order of a walk: their names, numbers of
        spans below and with them, and depths from 1 on."""
        if len(self.number) > KEPT:
            self.number.clear()
            self.hash.clear()
        known = len(self.hash)
        labels = [0] * len(names)
        for i in range(len(names) - 1, -1, -1):
            kids, at = [], i + 1
            while at < i + sizes[i]:
                kids.append(labels[at])
                at += sizes[at]
            labels[i] = self.number.setdefault((names[i], *kids), len(self.number))
        if labels[0] >= known or max(labels) >= known:
            self.hash.extend([START] * (len(self.number) - known))
            walk = self.walk if max(depths) > SHALLOW else self.walk_shallow
            for label, h in zip(labels, walk(names, sizes, depths), strict=True):
                self.hash[label] = h
        return [self.hash[x] for x in labels]

    def whole_line(self, text: str) -> tuple[int, list[int]]:
        if (found := self.whole.get(text)) is None:
            if len(self.whole) >= LINES:
                self.whole.clear()
            factor, table = self.lines.get(text) or function_of((text + "\n").encode())
            found = self.whole[text] = (int(factor), table.tolist())
        return found

    def walk_shallow(self, names: list[str], sizes: list[int], depths: list[int]) -> list[int]:
        """walk() for trees of at most SHALLOW levels."""
        spaces, states, out = self.spaces, [0] * SHALLOW, [0] * len(names)

        def write(depth: int, text: str) -> None:
            factor, table = self.whole_line(text)
            for k in range(depth):
                power, add = spaces[depth - 1 - k]
                h = states[k]
                h = (h * power + add[h & 255]) & ALL
                states[k] = (h * factor + table[h & 255]) & ALL

        pending: list[tuple[int, int]] = []  # as in walk()

        def close(upto: int) -> None:
            while pending and pending[-1][1] <= upto:
                i, _ = pending.pop()
                write(depths[i], "]")
                out[i] = states[depths[i] - 1]

        for i, name in enumerate(names):
            if pending:
                close(i)
            states[depths[i] - 1] = int(START)
            if sizes[i] > 1:
                write(depths[i], name + "[")
                pending.append((i, i + sizes[i]))
            else:
                write(depths[i], name)
                out[i] = states[depths[i] - 1]
        close(len(names))
        return out

    def walk(self, names: list[str], sizes: list[int], depths: list[int]) -> list[np.uint64]:
        deepest = max(depths)
        power, add = self.indents.upto(deepest)
        power, flat = power[:deepest][::-1], add[:deepest].ravel()
        rows = np.arange(deepest)[::-1] * 256  # where the functions of the indents of depth .. 1 begin
        states = np.zeros(deepest, np.uint64)  # of the open subtrees, by the depth of their tops
        out = [START] * len(names)

        def write(depth: int, text: str) -> None:
            open_ = states[:depth]
            shift = deepest - depth
            open_[:] = open_ * power[shift:] + flat[rows[shift:] + (open_ & LOW).astype(np.int64)]
            factor, table = self.line(text)
            open_[:] = open_ * factor + table[(open_ & LOW).astype(np.int64)]

        pending: list[tuple[int, int]] = []  # open spans that have children, and where their subtrees end

        def close(upto: int) -> None:
            while pending and pending[-1][1] <= upto:
                i, _ = pending.pop()
                write(depths[i], "]")
                out[i] = states[depths[i] - 1]

        for i, name in enumerate(names):
            close(i)
            states[depths[i] - 1] = START
            if sizes[i] > 1:
                write(depths[i], name + "[")
                pending.append((i, i + sizes[i]))
            else:
                write(depths[i], name)
                out[i] = states[depths[i] - 1]
        close(len(names))
        return out
