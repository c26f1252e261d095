"""Votes and flicker removal over reads that come one by one: each is given out once the reads that it depends on are there."""

from __future__ import annotations

from functools import lru_cache

from ..functions.fuzzy import ratio

#: Characters from which on a read is no mere speck.
SPECK = 12


@lru_cache(100_000)
def pair_ratio(a: str, b: str) -> float:
    return ratio(a, b)


def alike(a: str, b: str, threshold: float) -> bool:
    if a == b:
        return True
    if not a or not b or 2 * min(len(a), len(b)) < threshold * (len(a) + len(b)):
        return False
    return pair_ratio(a, b) >= threshold


def replaces(new: tuple[str, float], old: tuple[str, float]) -> bool:
    if abs(new[1] - old[1]) > 0.015:
        return new[1] > old[1]
    return len(new[0]) > len(old[0])


def voted(own: tuple[str, float], near: list[tuple[str, float]], need: int, threshold: float) -> tuple[str, float]:
    """A read (text, score), or the best of the largest group of alike ones among it and those around it, if that has enough members."""
    said = [x for x in near if x[0]]
    groups = [[x for x in said if alike(x[0], c[0], threshold)] for c in said] if own[0] else []
    group = max(groups, key=lambda g: (len(g), sum(x[1] for x in g)), default=[])
    if len(group) < need:
        return own
    best = group[0]
    for x in group[1:]:
        if replaces(x, best):
            best = x
    return best


def unflickered(before: tuple[str, float] | None, read: tuple[str, float], after: tuple[str, float] | None, threshold: float) -> tuple[str, float]:
    """What ``drop_flicker`` makes of one read (text, score) between two others; null for a neighbour that isn't there."""
    text = read[0]
    if before is None or after is None or not text or alike(text, before[0], threshold) or alike(text, after[0], threshold):
        return read
    if before[0] and after[0] and alike(before[0], after[0], threshold):
        return before if replaces(before, after) else after
    return ("", 0.0) if len(text) < SPECK and 2 * len(text) < max(len(before[0]), len(after[0])) else read


class Smoothing:
    """The reads (stamp, text, score) of a video in order, delayed by the radius of ``stabilize_reads`` and of ``drop_flicker``.

    What it remembers is plain data (``memory``), at most 2 * votes + 1 reads.
    """

    def __init__(self, votes: int, flicker: bool, threshold: float, memory: dict | None = None):
        self.need, self.flicker, self.threshold = max(1, min(5, votes)), flicker, threshold
        self.memory = memory or {"near": [], "done": 0, "seen": 0, "before": None, "this": None}

    def take(self, read: tuple[float, str, float]) -> list[tuple[float, str, float]]:
        """The smoothed reads that are settled with this one."""
        m = self.memory
        m["near"].append(list(read))
        m["seen"] += 1
        return self._settled(lambda: len(m["near"]) - m["done"] >= self.need)

    def end(self) -> list[tuple[float, str, float]]:
        """The smoothed reads that are left when no read follows."""
        m = self.memory
        out = self._settled(lambda: m["done"] < len(m["near"]))
        if m["this"] is not None:
            out.append(tuple(m["this"]))
            m["this"] = None
        return out

    def _settled(self, more) -> list[tuple[float, str, float]]:
        m, out = self.memory, []
        while more():
            at = m["done"]
            stamp, text, score = m["near"][at]
            if self.need > 1 and m["seen"] >= self.need:
                around = [tuple(r[1:]) for r in m["near"][max(0, at - self.need + 1): at + self.need]]
                text, score = voted((text, score), around, self.need, self.threshold)
            m["done"] += 1
            if m["done"] >= self.need:
                del m["near"][0]
                m["done"] -= 1
            out += self._unflickered([stamp, text, score])
        return out

    def _unflickered(self, read: list) -> list[tuple[float, str, float]]:
        if not self.flicker:
            return [tuple(read)]
        m = self.memory
        before, this = m["before"], m["this"]
        m["before"], m["this"] = this, read
        if this is None:
            return []
        return [(this[0], *unflickered(before and tuple(before[1:]), (this[1], this[2]), (read[1], read[2]), self.threshold))]
