"""Search for many words at once (Aho-Corasick), as a plain Python object to be used inside Arrow functions."""

from __future__ import annotations

from collections import deque


class Automaton:
    """All occurrences of a set of words in a text, overlapping ones included."""

    def __init__(self, words):
        self.words = sorted(set(w for w in words if w))
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[str]] = [[]]
        for word in self.words:
            at = 0
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][c]
            self.ends[at].append(word)
        self.fail = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for c, child in self.next[at].items():
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0) if self.next[back].get(c, 0) != child else 0
                self.ends[child] = self.ends[child] + self.ends[self.fail[child]]
                queue.append(child)

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """(start, inclusive end, word) in the order of their ends, longer ones first."""
        out, at = [], 0
        for i, c in enumerate(text):
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            out += [(i - len(w) + 1, i, w) for w in self.ends[at]]
        return out

    def longest(self, text: str) -> list[tuple[int, int, str]]:
        """The matches left when of overlapping ones the longest (of equally long ones the first) is kept, in the order of their starts."""
        kept: list[tuple[int, int, str]] = []
        for a, b, w in sorted(self.matches(text), key=lambda m: (m[0] - m[1], m[0])):
            if all(b < c or a > d for c, d, _ in kept):
                kept.append((a, b, w))
        return sorted(kept)

    def is_prefix(self, text: str) -> bool:
        """Whether some word starts with ``text``."""
        at = 0
        for c in text:
            if c not in self.next[at]:
                return False
            at = self.next[at][c]
        return True
