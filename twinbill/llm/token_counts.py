"""Token counts of a unigram tokenizer, by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens of a few MB of text are inserted in a trie, one level of
letters at a time. The best segmentation of a prefix (forward score) is worked
out once per trie node, for all nodes of a level together, from the nodes above
it: walking up from a node spells the tokens that may end there, which a trie of
reversed tokens recognises. Nodes where a pre-token ends hold its token count,
and a text's count is the sum over its pre-tokens.

The vocabulary file orders its tokens by frequency of use but gives no
probabilities; they follow Zipf's law of the rank. Scores are whole numbers
(millionths of a natural logarithm), so equal scores are equal in any order of
work; of equal scores the segmentation with fewer tokens wins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import byte_symbols
from .pretokens import distinct, pretokens
from .scratch import only
from .text import column_bytes, row_of, steps

#: Longer pre-tokens are segmented one by one.
SHORT = 256
#: A token costs this much on top of its score when scores are compared: the tie rule.
_PER_TOKEN = 1 << 20


class Unigram:
    """Tokens with Zipf scores, as a trie of their reversed bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            names = json.load(file)["model"]["vocab"]
        symbols = byte_symbols()
        ranked = sorted(names.items(), key=lambda item: item[1])
        harmonic = float(np.sum(1.0 / np.arange(1, len(ranked) + 1)))
        cost = np.round(1e6 * np.log(np.arange(1, len(ranked) + 1) * harmonic)).astype(np.int64)
        self.cost = {bytes(symbols[c] for c in name): int(cost[k]) for k, (name, _) in enumerate(ranked)}
        self.longest = max(map(len, self.cost))
        child: dict[int, int] = {}
        ends = [-1]
        for token, value in self.cost.items():
            state = 0
            for byte in reversed(token):
                key = state << 8 | byte
                if key not in child:
                    child[key] = len(ends)
                    ends.append(-1)
                state = child[key]
            ends[state] = value
        self.state_cost = np.array(ends)
        self.child_keys = np.array(sorted(child), np.int64)
        self.child_states = np.array([child[k] for k in self.child_keys.tolist()])

    def _down(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next state in the reversed trie, or -1."""
        keys = state << 8 | byte
        at = np.minimum(np.searchsorted(self.child_keys, keys), len(self.child_keys) - 1)
        return np.where(self.child_keys[at] == keys, self.child_states[at], -1)

    def counts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token count and cost of the best segmentation of each span."""
        size = ends - starts
        count, cost = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for k in np.flatnonzero(size > SHORT).tolist():
            count[k], cost[k] = self.one(raw[starts[k] : ends[k]].tobytes())
        short = np.flatnonzero(size <= SHORT)
        node = np.zeros(len(short), np.int64)
        # By level: parent node, byte, forward cost and count of every node.
        parents, letters = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        best, tokens = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        live = np.arange(len(short))
        depth = 0
        while len(live):
            done = size[short[live]] == depth
            over = live[done]
            count[short[over]], cost[short[over]] = tokens[depth][node[over]], best[depth][node[over]]
            live = live[~done]
            if not len(live):
                break
            byte = raw[starts[short[live]] + depth].astype(np.int64)
            keys, node[live] = np.unique(node[live] << 8 | byte, return_inverse=True)
            parents.append(keys >> 8)
            letters.append(keys & 255)
            depth += 1
            low, few = self._level(parents, letters, best, tokens, depth)
            best.append(low)
            tokens.append(few)
        return count, cost

    def _level(self, parents, letters, best, tokens, depth: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(parents[depth])
        low = np.full(n, np.iinfo(np.int64).max)
        live = np.arange(n)
        at = live  # the ancestor reached, in its own level
        state = np.zeros(n, np.int64)
        for level in range(depth, max(0, depth - self.longest), -1):
            state = self._down(state, letters[level][at])
            on = state >= 0
            live, at, state = live[on], parents[level][at[on]], state[on]
            if not len(live):
                break
            price = self.state_cost[state]
            whole = price >= 0
            total = (best[level - 1][at] + price) * _PER_TOKEN + tokens[level - 1][at] + 1
            low[live[whole]] = np.minimum(low[live[whole]], total[whole])
        return low // _PER_TOKEN, low % _PER_TOKEN

    def one(self, word: bytes) -> tuple[int, int]:
        best = [(0, 0)] + [(1 << 62, 0)] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                price = self.cost.get(word[start:end])
                if price is not None:
                    cost, count = best[start]
                    best[end] = min(best[end], (cost + price, count + 1))
        return best[-1][1], best[-1][0]


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(path)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_bytes and log_prob of each row's whole text; no shuffle.

    ``path`` names a byte-level vocabulary file that all executors can read.
    ``log_prob`` is the natural logarithm of the best segmentation's
    probability. A null or empty text has no tokens and log_prob 0. A null
    doc_id stays null, rows may repeat, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        for batch in steps(batches):
            raw, offsets = column_bytes(batch.column("text"))
            starts, ends = pretokens(raw, offsets)
            at, which = distinct(raw, starts, ends)
            count, cost = model.counts(raw, starts[at], ends[at])
            n = len(offsets) - 1
            edges = np.searchsorted(row_of(offsets, starts), np.arange(n + 1))
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[which])])[edges])
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(edges)),
                    pa.array(total(count)),
                    pa.array(np.diff(offsets)),
                    pa.array(-total(cost) / 1e6 + 0.0),
                ],
                names=["doc_id", "n_pretokens", "n_tokens", "n_bytes", "log_prob"],
            )

    return only(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, n_pretokens long, n_tokens long, n_bytes long, log_prob double"
    )
