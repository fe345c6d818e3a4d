"""The alignment of two lists of words by their longest common blocks, in about the time of reading them."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence


class Blocks:
    """All blocks of a list, as a suffix automaton: a state stands for blocks that end at the same places, and knows the first of these."""

    def __init__(self, words: Sequence[Hashable]) -> None:
        self.to: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        last = 0
        for at, word in enumerate(words):
            last = self._add(word, at, last)

    def _state(self, to: dict, size: int, first: int) -> int:
        self.to.append(to)
        self.link.append(0)
        self.size.append(size)
        self.first.append(first)
        return len(self.to) - 1

    def _add(self, word: Hashable, at: int, last: int) -> int:
        new, p = self._state({}, self.size[last] + 1, at), last
        while p >= 0 and word not in self.to[p]:
            self.to[p][word] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.to[p][word]
        if self.size[q] == self.size[p] + 1:
            self.link[new] = q
            return new
        # Shorter blocks of q end at more places than the longer ones from now on.
        part = self._state(dict(self.to[q]), self.size[p] + 1, self.first[q])
        self.link[part], self.link[q], self.link[new] = self.link[q], part, part
        while p >= 0 and self.to[p].get(word) == q:
            self.to[p][word] = part
            p = self.link[p]
        return new

    def longest(self, words: Sequence[Hashable], low: int, high: int) -> tuple[int, int, int]:
        """(place in words, place in the list, length) of the longest block of words[low:high] in the list: of several, the first in words, and then in the list."""
        state = n = 0
        best = (low, 0, 0)
        for at in range(low, high):
            word = words[at]
            while state and word not in self.to[state]:
                state = self.link[state]
                n = self.size[state]
            state = self.to[state].get(word, 0)
            n = n + 1 if state else 0
            if n > best[2]:
                # Of a block as long as n the state may hold longer ones, too: all end at the same places.
                best = (at - n + 1, self.first[state] - n + 1, n)
        return best


def blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """Common blocks (place in a, place in b, length) in order: the longest of all, then those before and after it, in the same way."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        low, high, first, end = todo.pop()
        if low >= high or first >= end:
            continue
        i, j, n = Blocks(b[first:end]).longest(a, low, high)
        if n:
            found.append((i, first + j, n))
            todo += [(low, i, first, first + j), (i + n, high, first + j + n, end)]
    return sorted(found)


def changes(a: Sequence[Hashable], b: Sequence[Hashable]) -> Iterator[tuple[int, int, int, int]]:
    """What differs, in order: words from..to of a stand where those of b do."""
    i = j = 0
    for x, y, n in [*blocks(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            yield i, x, j, y
        i, j = x + n, y + n
