"""Levenshtein automata of many terms at once, intersected with the trie that holds the terms."""

from __future__ import annotations

from collections.abc import Collection, Iterable


#: Entries of states and moves between states kept at once; beyond it they are worked out anew (results do not change).
MOST_HELD, MOST_MOVES = 300_000, 100_000


def tolerance(term: str) -> int:
    """Edits allowed: none in short terms, one from five letters on, two from nine."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class TermAutomaton:
    """Finds the terms within a few edits of a word: letters put in, left out, replaced, or two neighbours swapped.

    ``terms`` match whole words, ``stems`` the beginning of a longer word, terms that are not ``loose`` only as they are
    written (all are, if none are named). A state is the set of trie nodes that the letters read so far may have led to, each
    with the edits spent, and of nodes that a swap leads to once its second letter is read; states and their successors are
    worked out when first met and kept, so a word costs one dictionary look-up a letter and most end after a few. The empty
    word is near no term.
    """

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = (), loose: Collection[str] | None = None) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.slack: list[int] = [0]  # most edits that a term below still allows
        self.allowed = {w: tolerance(w) if loose is None or w in loose else 0 for w in terms}
        for word in sorted(self.allowed):
            self.term[self._path(word, self.allowed[word])] = word
        for word in sorted(set(stems)):
            self.stem[self._path(word, 0)] = word
        self._forget()

    def _forget(self) -> None:
        self.moves: dict[tuple[int, str], int] = {}
        self.states: list[dict[int | tuple[int, str], int]] = []
        self.held = 0
        self.numbers: dict[frozenset, int] = {}
        self.prefixes: list[str | None] = []
        self.start = self._state({0: 0})

    def _path(self, word: str, slack: int) -> int:
        node = 0
        self.slack[0] = max(self.slack[0], slack)
        for c in word:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.term.append(None)
                self.stem.append(None)
                self.slack.append(0)
            node = self.children[node][c]
            self.slack[node] = max(self.slack[node], slack)
        return node

    def _state(self, spent: dict[int | tuple[int, str], int]) -> int:
        """Number of a state, -1 for the dead one; letters of the term that the word lacks are skipped here."""
        todo = [n for n in spent if isinstance(n, int)]
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                cost = spent[node] + 1
                if cost <= self.slack[child] and cost < spent.get(child, 99):
                    spent[child] = cost
                    todo.append(child)
        if not spent:
            return -1
        key = frozenset(spent.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(spent)
            self.held += len(spent)
            stems = [self.stem[n] for n, e in spent.items() if e == 0 and isinstance(n, int) and self.stem[n]]
            self.prefixes.append(stems[0] if stems else None)
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int | tuple[int, str], int] = {}

        def reach(node: int, cost: int) -> None:
            if cost <= self.slack[node] and cost < after.get(node, 99):
                after[node] = cost

        for node, cost in self.states[state].items():
            if not isinstance(node, int):  # a swap whose second letter is due
                if node[1] == c:
                    reach(node[0], cost)
                continue
            if c in self.children[node]:
                child = self.children[node][c]
                if cost == 0 or cost <= self.slack[child]:
                    after[child] = min(cost, after.get(child, 99))
            for first, child in self.children[node].items():
                reach(child, cost + 1)
                swapped = self.children[child].get(c)
                if swapped is not None and first != c and cost + 1 <= self.slack[swapped]:
                    key = (swapped, first)
                    after[key] = min(cost + 1, after.get(key, 99))
            reach(node, cost + 1)
        return self._state(after)

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term (ties: first by code point) and its edits; a stem counts as no edit. None if nothing is near."""
        if self.held > MOST_HELD or len(self.moves) > MOST_MOVES:
            self._forget()
        state, moves, stem = self.start, self.moves, None
        for c in word:
            key = (state, c)
            state = moves.get(key)
            if state is None:
                state = moves[key] = self._step(key[0], c)
            if state < 0:
                return (stem + "*", 0) if stem else None
            stem = self.prefixes[state] or stem
        ends = [(e, self.term[n]) for n, e in self.states[state].items() if isinstance(n, int) and self.term[n]]
        near = [(e, term) for e, term in ends if e <= self.allowed[term]]
        if near and (min(near)[0] == 0 or not stem):
            return min(near)[::-1]
        return (stem + "*", 0) if stem else None
