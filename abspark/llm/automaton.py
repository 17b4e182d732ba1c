"""A lexicon trie intersected with Levenshtein automata.

The intersection is a non-deterministic automaton over pairs (trie node, edits so far); it is
made deterministic as words are read, so each word costs one table lookup per character and
most words leave the automaton after a few."""

from __future__ import annotations

CACHED_STATES = 20_000  # tables are built anew beyond this; results do not change


class FuzzyLexicon:
    """Finds the nearest term within a number of edits (insert, delete, substitute). With
    added_only a word may have letters more than the term, but none less or other."""

    def __init__(self, terms: list[str], edits: int, added_only: bool = False):
        self.edits, self.added_only = edits, added_only
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in sorted(set(terms)):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = term
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[dict[str, frozenset[str]]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.start = self.number(self.closed({0: 0}))

    def closed(self, best: dict[int, int]) -> frozenset:
        """Add nodes reached by leaving out characters of the term; fewest edits per node."""
        todo = [] if self.added_only else list(best.items())
        while todo:
            node, edits = todo.pop()
            if edits < self.edits and best[node] == edits:
                for child in self.children[node].values():
                    if best.get(child, self.edits + 1) > edits + 1:
                        best[child] = edits + 1
                        todo.append((child, edits + 1))
        return frozenset(best.items())

    def number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.sets)
            self.sets.append(state)
            self.steps.append({})
            self.ends.append({})
            ends = [(edits, self.term[node]) for node, edits in state if self.term[node] is not None]
            self.accepts.append(min(ends, default=None))
        return self.numbers[state]

    def step(self, at: int, c: str) -> int:
        best: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.edits and best.get(node, self.edits + 1) > edits:
                best[node] = edits

        for node, edits in self.sets[at]:
            reach(node, edits + 1)
            for letter, child in self.children[node].items():
                if letter == c or not self.added_only:
                    reach(child, edits + (letter != c))
        self.steps[at][c] = found = self.number(self.closed(best)) if best else -1
        return found

    def find(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term, the first by name among equals; else None."""
        if len(self.sets) > CACHED_STATES:
            self.forget()
        at = self.start
        for c in word:
            to = self.steps[at].get(c)
            at = self.step(at, c) if to is None else to
            if at < 0:
                return None
        return self.accepts[at]

    def near_starts(self, word: str) -> frozenset[str]:
        """Terms within the edits of a start of the word. The last letter of the term must
        stand there unchanged: otherwise a term would fit all that starts like the term
        without it."""
        if len(self.sets) > CACHED_STATES:
            self.forget()
        at, found = self.start, frozenset()
        for c in word:
            to = self.steps[at].get(c)
            if to is None:
                to = self.step(at, c)
            if c not in self.ends[at]:
                over = (self.children[node].get(c) for node, _ in self.sets[at])
                self.ends[at][c] = frozenset(self.term[n] for n in over if n and self.term[n] is not None)
            if self.ends[at][c]:
                found |= self.ends[at][c]
            at = to
            if at < 0:
                break
        return found
