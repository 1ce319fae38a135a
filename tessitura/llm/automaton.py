"""Suffix automata of bounded depth, over whole numbers instead of letters.

The states of a suffix automaton are the classes of substrings that end at the same places; their suffix links form the tree of the reversed
contexts. Bounded to ``depth``, that tree is built level by level from arrays: a phrase of k words that ends at a place is named by the phrase of
k - 1 words that ends there (its suffix link) and the word in front, so one sort of such pairs gives a level's phrases, links and endpos counts.
An automaton is generalised: many pieces are laid end to end, and no phrase crosses GAP, which stands between them.
"""

from __future__ import annotations

import numpy as np

GAP = 0


class Automaton:
    """Phrases of up to ``depth`` words that end at the places ``ends`` (all, if None) of ``words``.

    ``first[k]``, ``link[k]`` and ``count[k]`` belong to the phrases of k + 1 words: the word in front, the row of the phrase without it on the level
    above (-1 on the first), and the number of places they end at.
    """

    def __init__(self, words: np.ndarray, depth: int, ends: np.ndarray | None = None):
        at = np.flatnonzero(words != GAP) if ends is None else ends
        self.first, self.link, self.count = [], [], []
        state = np.full(len(at), -1, np.int64)
        most = int(words.max(initial=0)) + 1
        for k in range(depth):
            here = at >= k
            at, state = at[here], state[here]
            front = words[at - k].astype(np.int64)
            here = front != GAP
            at, state, front = at[here], state[here], front[here]
            pairs, state, count = np.unique((state + 1) * most + front, return_inverse=True, return_counts=True)
            self.first.append(pairs % most)
            self.link.append(pairs // most - 1)
            self.count.append(count)

    def phrases(self, k: int) -> list[np.ndarray]:
        """The words of all phrases of k words, one array for each position."""
        rows = np.arange(len(self.count[k - 1]))
        out = []
        for level in range(k - 1, -1, -1):
            out.append(self.first[level][rows])
            rows = self.link[level][rows]
        return out
