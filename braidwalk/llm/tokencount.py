"""Token counts under a unigram segmentation, by dynamic programming shared along a trie.

Distinct pre-tokens (white-space words with the word mark in front) are inserted in a trie.  A node's forward score is
the best log-probability of segmenting the path from the root, so it is computed once for all pre-tokens that share the
prefix; a terminal stores the number of pieces of the best path.  Pieces come from a public vocabulary file; their
log-probabilities follow Zipf's law in the vocabulary's order (piece k of n: -log((k + 1) H_n)); nothing is trained.
Characters in no piece fall back to one token a byte at ``BYTE_SCORE`` each.  Ties take fewer pieces.

Texts: null counts as empty (0 tokens); repeated rows give repeated results; an empty table gives an empty result; columns
of the input pass through, but those with the name of a result give way to it.  The trie is a bounded table per task (``NODES``; dropped and rebuilt when full,
which changes no result); pre-tokens over ``LONG`` characters use the same recurrence with a rolling window instead.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

MARK = "▁"
NODES, LONG = 1_000_000, 64
BYTE_SCORE = -20.0


def zipf_scores(path: str) -> dict[str, float]:
    """Pieces of a vocabulary file with their scores; control and byte pieces are left out."""
    import sentencepiece

    v = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(v.get_piece_size()) if not (v.is_control(i) or v.is_byte(i) or v.is_unknown(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(ids))))
    return {v.id_to_piece(i): -math.log(k + 1) - total for k, i in enumerate(ids)}


class Trie:
    """Nodes in parallel lists: children, piece scores ending here by length, forward score, pieces used."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        #: Every end of a piece, with the score if it is a piece itself: where an end is missing, no longer piece can end.
        self.ends: dict[str, float | None] = dict.fromkeys(p[k:] for p in scores for k in range(len(p)))
        self.ends.update(scores)
        self.terminal: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]
        self.used: list[int] = [0]
        self.terminal.clear()

    def step(self, path: str, best: list[float], used: list[int]) -> tuple[float, int]:
        """Forward score and pieces of ``path`` from those of its prefixes (aligned at the end of the lists)."""
        n = len(path)
        size = len(path[-1].encode())
        top, count = best[-1] + BYTE_SCORE * size, used[-1] + size
        ends = self.ends
        for k in range(1, n + 1):
            end = path[n - k :]
            if end not in ends:
                break
            s = ends[end]
            if s is not None:
                x = best[-k] + s
                if x > top or x == top and used[-k] + 1 < count:
                    top, count = x, used[-k] + 1
        return top, count

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of a pre-token."""
        got = self.terminal.get(word)
        if got is not None:
            return got
        if len(word) > LONG:
            best, used, keep = [0.0], [0], self.longest
            for i in range(len(word)):
                x, c = self.step(word[max(0, i + 1 - keep) : i + 1], best, used)
                best.append(x), used.append(c)
                if len(best) > 4 * keep:
                    del best[:-keep], used[:-keep]
            return used[-1]
        if len(self.child) > NODES:
            self.clear()
        node, path = 0, [0]
        for i, ch in enumerate(word):
            nxt = self.child[node].get(ch)
            if nxt is None:
                x, c = self.step(word[: i + 1], [self.best[p] for p in path[-self.longest :]], [self.used[p] for p in path[-self.longest :]])
                nxt = self.child[node][ch] = len(self.child)
                self.child.append({}), self.best.append(x), self.used.append(c)
            node = nxt
            path.append(node)
        self.terminal[word] = self.used[node]
        return self.used[node]


_tries: dict[str, Trie] = {}


def trie_of(path: str) -> Trie:
    """One per worker process."""
    if path not in _tries:
        _tries[path] = Trie(zipf_scores(path))
    return _tries[path]


def count_documents(docs: DataFrame, path: str) -> DataFrame:
    """All columns of ``docs`` but ``text``, and n_words, n_tokens (long); no shuffle."""
    from .common import each_text

    def work():
        trie = trie_of(path)

        def one(text: str) -> tuple[int, int]:
            words = [MARK + w for w in text.split()]
            get, count = trie.terminal.get, trie.count
            return len(words), sum([get(w) or count(w) for w in words])

        return one

    return each_text(docs, work, "n_words long, n_tokens long")
