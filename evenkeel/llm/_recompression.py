"""Recompression of a sequence into a run-length grammar, and longest common extensions on it.

Two steps alternate until few symbols are left. Block compression replaces each maximal block of a symbol
by a symbol for (symbol, count). Pair compression divides the symbols into left and right ones and replaces
every left symbol that is followed by a right one by a symbol for the pair. Equal symbols have equal names,
numbered by sorting, so equality of names is equality of what they stand for. Where two symbols meet
decides alone whether they are joined, so equal stretches are parsed alike but for their ends.

An extension query climbs from the words: at each level it takes at most one symbol (or the rest of a
block) until both places begin a symbol of the next level, and climbs; where the symbols differ it descends
again, taking the part that is equal. That is a constant number of steps a level, for all queries at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from evenkeel.llm._text import mix

#: Symbols at which the grammar ends; the last level is read one by one.
_TOP = 8


@dataclass
class Level:
    """Symbols of a level, how many words each has, and how they are joined at the next level."""

    symbols: np.ndarray
    words: np.ndarray
    blocks: bool = False
    parent: np.ndarray | None = None
    first: np.ndarray | None = None
    last: np.ndarray | None = None

    def mirrored(self) -> Level:
        if self.parent is None:
            return Level(self.symbols[::-1], self.words[::-1])
        n, m = len(self.symbols), len(self.first)
        return Level(
            self.symbols[::-1],
            self.words[::-1],
            self.blocks,
            (m - 1 - self.parent)[::-1],
            (n - 1 - self.last)[::-1],
            (n - 1 - self.first)[::-1],
        )


def _join(level: Level, begins: np.ndarray, blocks: bool, names: np.ndarray, next_name: int) -> tuple[Level, int]:
    """The next level, where symbols begin at the flagged places; `names` tell the joined ones apart."""
    level.blocks, level.first = blocks, np.flatnonzero(begins)
    level.parent = np.cumsum(begins) - 1
    level.last = np.append(level.first[1:], len(level.symbols)) - 1
    symbols = level.symbols[level.first]
    joined = level.last > level.first
    unique, number = np.unique(names[joined], return_inverse=True)
    symbols[joined] = next_name + number
    return Level(symbols, np.add.reduceat(level.words, level.first)), next_name + len(unique)


def grammar(symbols: np.ndarray) -> list[Level]:
    """The levels over non-negative `symbols`, of which the first and the last are found nowhere else."""
    level = Level(symbols.astype(np.int64), np.ones(len(symbols), dtype=np.int64))
    levels, next_name, salt = [level], int(symbols.max(initial=0)) + 1, 0
    while len(level.symbols) > _TOP:
        s = level.symbols
        begins = np.r_[True, s[1:] != s[:-1]]
        if not begins.all():
            first = np.flatnonzero(begins)
            counts = np.diff(np.append(first, len(s)))
            level, next_name = _join(level, begins, True, s[first] << 32 | counts, next_name)
            levels.append(level)
            s = level.symbols
        salt += 1
        right = mix(s.astype(np.uint64) + np.uint64(salt << 40)) & np.uint64(1) == 1
        pairs = ~right[:-1] & right[1:]
        if pairs.any():
            begins = np.r_[True, ~pairs]
            first = np.flatnonzero(begins)
            second = s[np.minimum(first + 1, len(s) - 1)]
            level, next_name = _join(level, begins, False, s[first] << 32 | second, next_name)
            levels.append(level)
    return levels


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar read from its end."""
    return [level.mirrored() for level in levels]


def _taken(level: Level, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many equal symbols from x and y on go at once, and whether both are at the end of theirs then."""
    if not level.blocks:
        return np.ones(len(x), dtype=np.int64), np.ones(len(x), dtype=bool)
    rest_x, rest_y = level.last[px] - x + 1, level.last[py] - y + 1
    return np.minimum(rest_x, rest_y), rest_x == rest_y


def extensions(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from place x on equal those from place y on. No query has x = y."""
    x, y = x.copy(), y.copy()
    total = np.zeros(len(x), dtype=np.int64)
    stop = np.zeros(len(x), dtype=np.int64)
    at = np.arange(len(x))
    for number, level in enumerate(levels):
        differs = level.symbols[x[at]] != level.symbols[y[at]]
        stop[at[differs]] = number
        at = at[~differs]
        if number == len(levels) - 1:
            while len(at):
                total[at] += level.words[x[at]]
                x[at] += 1
                y[at] += 1
                stop[at] = number
                at = at[level.symbols[x[at]] == level.symbols[y[at]]]
            break
        px, py = level.parent[x[at]], level.parent[y[at]]
        loose = (level.first[px] != x[at]) | (level.first[py] != y[at])
        some = at[loose]
        if len(some):
            n, even = _taken(level, x[some], y[some], px[loose], py[loose])
            total[some] += n * level.words[x[some]]
            x[some] += n
            y[some] += n
            stop[some[~even]] = number
            going = np.ones(len(at), dtype=bool)
            going[np.flatnonzero(loose)[~even]] = False
            at = at[going]
        x[at], y[at] = level.parent[x[at]], level.parent[y[at]]
    order = np.argsort(-stop, kind="stable")
    reached = np.searchsorted(-stop[order], -np.arange(len(levels)), side="right")
    for number in range(len(levels) - 1, 0, -1):
        at = order[: reached[number]]
        if not len(at):
            continue
        below = levels[number - 1]
        px, py = x[at], y[at]
        x[at], y[at] = below.first[px], below.first[py]
        same = below.symbols[x[at]] == below.symbols[y[at]]
        some = at[same]
        if len(some):
            n, _ = _taken(below, x[some], y[some], px[same], py[same])
            total[some] += n * below.words[x[some]]
            x[some] += n
            y[some] += n
    return total
