"""Double-array tries over bytes, and a longest-match automaton with failure links on top of one."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: A symbol beside the 256 byte values.
MARK = 256
ALPHABET = 257


@dataclass
class DoubleArray:
    """Node s has the child base[s] + c for symbol c if check of that is s; value is a key's number or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(child, whether there is one) for arrays of states and symbols."""
        to = self.base[state] + symbol
        return to, self.check[to] == state


def children_of(keys: Iterable[tuple[tuple[int, ...], int]]) -> tuple[list[dict[int, int]], list[int]]:
    """An ordinary trie: for each node its children by symbol, and its value."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, value in keys:
        node = 0
        for c in key:
            nxt = children[node].get(c)
            if nxt is None:
                nxt = children[node][c] = len(children)
                children.append({})
                values.append(-1)
            node = nxt
        values[node] = value
    return children, values


def double_array(keys: Iterable[tuple[tuple[int, ...], int]]) -> DoubleArray:
    """Place the nodes of the keys' trie, breadth first, at the first base where all children's places are free."""
    children, values = children_of(keys)
    size = 4 * len(children) + 4 * ALPHABET
    base, check, value = [0] * size, [-1] * size, [-1] * size
    value[0], check[0] = values[0], -2
    before, after = list(range(-1, size)), list(range(1, size + 1))  # the free places, linked
    todo = deque([(0, 0)])
    while todo:
        node, place = todo.popleft()
        own = sorted(children[node])
        if not own:
            continue
        first, slot = own[0], after[0]
        while slot <= first or any(check[slot - first + c] != -1 for c in own[1:]):
            slot = after[slot]
        at = base[place] = slot - first
        for c in own:
            child, here = children[node][c], at + c
            check[here], value[here] = place, values[child]
            after[before[here]], before[after[here]] = after[here], before[here]
            todo.append((child, here))
    top = max(i for i in range(size) if check[i] != -1) + ALPHABET + 1
    return DoubleArray(*(np.array((x + [-1] * ALPHABET)[:top], np.int32) for x in (base, check, value)))


@dataclass
class LongestMatch:
    """Counts of greedy longest-match tokens in one pass over a word.

    ``fail[s]`` is where to go on when s has no child for the next symbol, and ``popped[s]`` how many
    tokens that completes; -1 means that the text read so far cannot be cut into tokens.
    """

    trie: DoubleArray
    start: int
    rest: int
    fail: np.ndarray
    popped: np.ndarray

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, 1 for a word that cannot be cut into tokens, 0 for an empty one."""
        n = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-n, kind="stable")
        text, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n
        at, n = at[order], n[order]
        state, count, dead = np.full(len(n), self.start, np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        for i in range(int(n[0]) if len(n) else 0):
            todo = np.flatnonzero(~dead[: np.searchsorted(-n, -i)])  # the words longer than i
            symbol = text[at[todo] + i].astype(np.int64)
            while len(todo):
                to, ok = self.trie.step(state[todo], symbol)
                state[todo[ok]] = to[ok]
                todo, symbol = todo[~ok], symbol[~ok]
                back = self.fail[state[todo]]
                dead[todo[back < 0]] = True
                todo, symbol, back = todo[back >= 0], symbol[back >= 0], back[back >= 0]
                count[todo] += self.popped[state[todo]]
                state[todo] = back
        todo = np.flatnonzero(~dead & (n > 0))
        while len(todo):
            back = self.fail[state[todo]]
            dead[todo[back < 0]] = True
            todo, back = todo[back >= 0], back[back >= 0]
            count[todo] += self.popped[state[todo]]
            state[todo] = back
            todo = todo[back != self.rest]
        out = np.empty(len(n), np.int64)
        out[order] = np.where(dead, 1, count)
        return out


def longest_match(first: Iterable[bytes], later: Iterable[bytes]) -> LongestMatch:
    """The automaton of tokens that begin a word and tokens that continue one."""
    keys = [(tuple(t), i) for i, t in enumerate(first) if t] + [((MARK, *t), i) for i, t in enumerate(later) if t]
    trie = double_array([*keys, ((MARK,), -1)])
    base, check, value = (x.tolist() for x in (trie.base, trie.check, trie.value))
    own: dict[int, list[int]] = {}
    for place, parent in enumerate(check):
        if parent >= 0:
            own.setdefault(parent, []).append(place)
    rest = base[0] + MARK
    fail, popped = [-1] * len(base), [0] * len(base)
    todo = deque([0])
    while todo:
        node = todo.popleft()
        for place in own.get(node, ()):
            todo.append(place)
            if place == rest:
                continue
            if value[place] >= 0:
                fail[place], popped[place] = rest, 1
                continue
            c, z, n = place - base[node], fail[node], popped[node]
            while z >= 0 and check[base[z] + c] != z:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[place], popped[place] = base[z] + c, n
    return LongestMatch(trie, 0, rest, np.array(fail, np.int32), np.array(popped, np.int64))
