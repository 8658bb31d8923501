"""A minimal acyclic transducer from words (bytes) to sequences of numbers.

Built from sorted words: outputs move as far to the front as they can,
and states with equal arcs and outputs are one state, so suffixes are shared.
The arrays lie in one file that readers map into memory.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable

import numpy as np

_MAGIC = b"MAT1"
_PARTS = ("labels", "first", "target", "arc_out", "final", "out_first", "outs")


class _State:
    __slots__ = ("arcs", "final", "out")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # label -> [target, output]
        self.final = False
        self.out: tuple = ()


def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Builder:
    """Takes words in strictly rising order."""

    def __init__(self):
        self.path = [_State()]
        self.last: bytes | None = None
        self.known: dict[tuple, int] = {}
        self.frozen: list[tuple] = []

    def add(self, word: bytes, out: tuple) -> None:
        if self.last is not None and word <= self.last:
            raise ValueError("words must rise")
        same = _shared(word, self.last or b"")
        self._freeze(same)
        for i in range(same):
            arc = self.path[i].arcs[word[i]]
            n = _shared(arc[1], out)
            moved, arc[1], out = arc[1][n:], arc[1][:n], out[n:]
            if moved:
                below = self.path[i + 1]
                for other in below.arcs.values():
                    other[1] = moved + other[1]
                if below.final:
                    below.out = moved + below.out
        for label in word[same:]:
            self.path[-1].arcs[label] = [None, out]
            out = ()
            self.path.append(_State())
        self.path[-1].final = True
        self.path[-1].out = out
        self.last = word

    def _freeze(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            number = self._number(self.path.pop())
            self.path[-1].arcs[self.last[len(self.path) - 1]][0] = number

    def _number(self, state: _State) -> int:
        key = (state.final, state.out, tuple((label, to, out) for label, (to, out) in sorted(state.arcs.items())))
        if key not in self.known:
            self.known[key] = len(self.frozen)
            self.frozen.append(key)
        return self.known[key]

    def to_bytes(self) -> bytes:
        self._freeze(0)
        self._number(self.path[0])
        pool: dict[tuple, int] = {(): 0}

        def place(out: tuple) -> int:
            return pool.setdefault(out, len(pool))

        labels, first, target, arc_out, final = bytearray(), [0], [], [], []
        for is_final, out, arcs in self.frozen:
            final.append(place(out) + 1 if is_final else 0)
            for label, to, arc in arcs:
                labels.append(label)
                target.append(to)
                arc_out.append(place(arc))
            first.append(len(labels))
        lengths = np.array([len(x) for x in pool], np.int64)
        parts = {
            "labels": bytes(labels),
            "first": np.array(first, "<u4").tobytes(),
            "target": np.array(target, "<u4").tobytes(),
            "arc_out": np.array(arc_out, "<u4").tobytes(),
            "final": np.array(final, "<u4").tobytes(),
            "out_first": np.concatenate(([0], np.cumsum(lengths))).astype("<u4").tobytes(),
            "outs": np.array([i for x in pool for i in x], "<i4").tobytes(),
        }
        head = np.array([len(parts[p]) for p in _PARTS] + [len(self.frozen) - 1], "<i8").tobytes()
        padded = [parts[p] + b"\0" * (-len(parts[p]) % 8) for p in _PARTS]
        return _MAGIC + b"\0" * 4 + head + b"".join(padded)


def compile_words(words: Iterable[tuple[bytes, tuple]]) -> bytes:
    builder = Builder()
    for word, out in sorted(words):
        builder.add(word, out)
    return builder.to_bytes()


class Transducer:
    """A file of ``Builder``, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:4] != _MAGIC:
            raise ValueError(f"{path} is no transducer")
        view, at = memoryview(self.map), 8 + 8 * (len(_PARTS) + 1)
        *sizes, self.root = view[8:at].cast("q").tolist()
        parts = {}
        for name, size in zip(_PARTS, sizes, strict=True):
            parts[name] = (at, view[at : at + size])
            at += size + -size % 8
        self.labels = parts["labels"][0]
        self.first, self.target, self.arc_out, self.final, self.out_first = (
            parts[p][1].cast("I") for p in ("first", "target", "arc_out", "final", "out_first")
        )
        self.outs = parts["outs"][1].cast("i")
        self.states, self.arcs = len(self.final), len(self.target)
        self.of = {p: np.frombuffer(v, "u1" if p == "labels" else "<i4" if p == "outs" else "<u4") for p, (_, v) in parts.items()}
        # Arcs are in order of state and label.
        owner = np.repeat(np.arange(self.states, dtype=np.int64), np.diff(self.of["first"].astype(np.int64)))
        self.keys = owner << 8 | self.of["labels"]

    def get(self, word: bytes) -> list[int] | None:
        """The numbers of a word, or None if it is not in the lexicon."""
        state, found, labels, first = self.root, [], self.labels, self.first
        for k in range(len(word)):
            arc = self.map.find(word[k : k + 1], labels + first[state], labels + first[state + 1]) - labels
            if arc < 0:
                return None
            if out := self.arc_out[arc]:
                found += self.outs[self.out_first[out] : self.out_first[out + 1]]
            state = self.target[arc]
        last = self.final[state]
        if not last:
            return None
        return found + self.outs[self.out_first[last - 1] : self.out_first[last]].tolist()

    def get_all(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(found, numbers, counts)`` for words that are rows of bytes with the given
        sizes: which are in the lexicon, and for those their numbers in one array
        and how many each one has."""
        rows, width = words.shape
        state, found = np.full(rows, self.root, np.int64), np.ones(rows, bool)
        outs = np.zeros((rows, width + 1), np.int64)
        for k in range(width if self.arcs else 0):
            inside = found & (k < sizes)
            key = state << 8 | words[:, k]
            arc = np.minimum(np.searchsorted(self.keys, key), self.arcs - 1)
            step = inside & (self.keys[arc] == key)
            found &= step | (k >= sizes)
            state = np.where(step, self.of["target"][arc], state)
            outs[:, k] = np.where(step, self.of["arc_out"][arc], 0)
        last = self.of["final"][state].astype(np.int64)
        found &= (last > 0) & ((sizes == 0) | (self.arcs > 0))
        outs[:, width] = last - 1
        outs = outs[found]
        first = self.of["out_first"].astype(np.int64)
        counts = np.diff(first)[outs]
        flat = counts.ravel()
        place = np.repeat(first[outs].ravel() - (np.cumsum(flat) - flat), flat) + np.arange(flat.sum())
        return found, self.of["outs"][place], counts.sum(axis=1)
