"""Functions from whole numbers to whole numbers that are constant or a translation on each of finitely many intervals.

The rows of a token bucket or a cache key, however many, do this to the state that enters them, and so do any two such runs of
rows one after the other: the functions are closed under composition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEVER = -(2**62)  # an entering place before all others: nothing has happened yet
TOP = 2**62


@dataclass
class Shifts:
    """On (upto[i-1], upto[i]] the function is `by[i]` if `fixed[i]`, else its argument plus `by[i]`. Beyond the last bound the last part holds."""

    upto: np.ndarray
    fixed: np.ndarray
    by: np.ndarray

    def __call__(self, x: np.ndarray | int) -> np.ndarray:
        x = np.asarray(x, np.int64)
        at = np.minimum(np.searchsorted(self.upto, x, "left"), len(self.upto) - 1)
        fixed, by = self.fixed[at], self.by[at]
        # A translation leaves what has not begun as it is.
        return np.where(fixed, by, np.where(x <= NEVER // 2, x, x + by))

    def then(self, after: Shifts, back: int = 0) -> Shifts:
        """after(self(x) - back)."""
        low = np.concatenate([[NEVER], self.upto[:-1]])
        # Bounds of `after` that lie inside the image of each translated part cut that part.
        first = np.searchsorted(after.upto, low + self.by - back, "right")
        past = np.searchsorted(after.upto, self.upto + self.by - back, "left")
        counts = np.where(self.fixed, 0, np.maximum(past - first, 0))
        owner = np.repeat(np.arange(len(self.upto)), counts)
        cut = after.upto[np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]] - self.by[owner] + back
        upto = np.concatenate([self.upto, cut])
        part = np.concatenate([np.arange(len(self.upto)), owner])
        order = np.lexsort((upto, part))
        upto, part = upto[order], part[order]
        fixed, by = self.fixed[part], self.by[part]
        image = np.where(fixed, by, upto + by) - back
        at = np.minimum(np.searchsorted(after.upto, image, "left"), len(after.upto) - 1)
        whole = fixed | after.fixed[at]
        made = np.where(after.fixed[at], after.by[at], np.where(fixed, image + after.by[at], by - back + after.by[at]))
        return _joined(upto, whole, made)


def _joined(upto: np.ndarray, fixed: np.ndarray, by: np.ndarray) -> Shifts:
    """Neighbours that go on in the same way become one part."""
    last = np.append((fixed[1:] != fixed[:-1]) | (by[1:] != by[:-1]), True)
    return Shifts(upto[last], fixed[last], by[last])


def constant(value: int) -> Shifts:
    return Shifts(np.array([TOP]), np.array([True]), np.array([value], np.int64))


def identity() -> Shifts:
    return Shifts(np.array([TOP]), np.array([False]), np.array([0], np.int64))


def from_steps(lo: np.ndarray, out: np.ndarray) -> Shifts:
    """An argument up to lo[i] (and above lo[i-1]) gives out[i]; one above all stays."""
    return Shifts(np.append(lo, TOP).astype(np.int64), np.append(np.ones(len(lo), bool), False), np.append(out, 0).astype(np.int64))


class Run:
    """Builds the function of rows that each do this: raise the argument to `a`, then add `unit` if it is at most `b` (not below `a`).

    While all that can come out lies on one side of both bounds, a row costs a comparison.
    """

    def __init__(self, unit: int, low: int, high: int):
        """Arguments from `low` to `high` can come in."""
        self.unit, self.low, self.high, self.added = unit, low, high, 0
        self.parts: list[tuple[int, bool, int]] = [(high, False, 0)]

    def add(self, a: int, b: int) -> None:
        if self.low > b:
            return
        if self.low >= a and self.high <= b:
            self.added += self.unit
            self.low += self.unit
            self.high += self.unit
            return
        a, b, unit = a - self.added, b - self.added, self.unit
        made: list[tuple[int, bool, int]] = []
        below, least, most = NEVER, TOP, NEVER
        for upto, fixed, by in self.parts:
            if fixed:
                value = max(by, a)
                pieces = ((upto, True, value + unit if value <= b else value),)
            else:
                pieces = ((min(upto, a - 1 - by), True, a + unit), (min(upto, b - by), False, by + unit), (upto, False, by))
            for piece in pieces:
                if piece[0] <= below:
                    continue
                # What can come out of this part, for the quick tests above.
                least = min(least, piece[2] if piece[1] else max(below + 1, NEVER // 2) + piece[2])
                most = max(most, piece[2] if piece[1] else piece[0] + piece[2])
                below = piece[0]
                if made and made[-1][1:] == piece[1:]:
                    made[-1] = piece
                else:
                    made.append(piece)
        self.parts, self.low, self.high = made, least + self.added, most + self.added

    def function(self) -> Shifts:
        upto, fixed, by = zip(*self.parts)
        return Shifts(np.array(upto, np.int64), np.array(fixed), np.array(by, np.int64) + self.added)
