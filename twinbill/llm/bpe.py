"""Exact byte-pair encoding in linear time, and decoding by an offset table.

Encoding takes the longest token at a position (Aho-Corasick over the
vocabulary) and goes on if it may stand after the previous one; else it tries
the token's next shorter prefix, and steps back when none is left. Positions
that led nowhere are remembered, so no position is tried twice.

Two tokens may be neighbours if no merge across their border would have come
before the merges that built them. The tokens that touch the border while a
token is built are its edge: the token, the half of it at the border, that
half's half, and so on. A merge of two edge parts wins if it comes before
either part is used up; on equal rank the left one wins. Answers are kept in
the pair-compatibility table.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import distinct, gather, pretokens
from .scratch import only
from .text import column_bytes, row_of, steps

#: Longer pre-tokens are encoded one by one, shorter ones all together.
SHORT = 64
#: Short pre-tokens that are encoded in one step.
TOGETHER = 1 << 15
#: Ids that are decoded in one step, about.
IDS = 1 << 17
#: Pairs in the compatibility table of a worker (it starts anew when full).
PAIRS = 2_000_000
_NEVER = 1 << 40


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, to that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges of a byte-level vocabulary file, as tables for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        symbols = byte_symbols()
        as_bytes = lambda name: bytes(symbols[c] for c in name)
        names = data["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in data["added_tokens"]}
        size = 1 + max([*names.values(), *self.special.values()])
        token = [b""] * size
        for name, i in names.items():
            token[i] = as_bytes(name)
        for content, i in self.special.items():
            token[i] = content
        self.length = np.array([len(t) for t in token])
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.blob = np.frombuffer(b"".join(token), np.uint8)

        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(data["model"]["merges"]):
            whole = names[left + right]
            if whole not in halves:
                halves[whole] = (names[left], names[right])
                self.rank[whole] = rank
            self.merge[names[left], names[right]] = whole
        self.halves = halves
        self._forget()

        usable = set()
        for i in sorted(names.values(), key=lambda i: len(token[i])):
            if i not in halves or (set(halves[i]) <= usable and self._neighbours(*halves[i], self.rank[i])):
                usable.add(i)
        ids = {token[i]: i for i in usable}
        self.size = [len(t) for t in token]
        self.shorter = [-1] * size
        for text, i in ids.items():
            self.shorter[i] = next((ids[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in ids), -1)
        self.shorter_array = np.array([*self.shorter, -1])
        self._search_tables(ids)

    def _forget(self) -> None:
        self.pair_keys = np.array([-1], np.int64)
        self.pair_fits = np.array([False])

    def _search_tables(self, ids: dict[bytes, int]) -> None:
        """Aho-Corasick over reversed tokens.

        Read from a word's end, the state at a position tells the longest
        token that starts there.
        """
        child: dict[int, int] = {}
        best, depth = [-1], [0]
        for text, i in ids.items():
            state = 0
            for byte in reversed(text):
                key = state << 8 | byte
                if key not in child:
                    child[key] = len(best)
                    best.append(-1)
                    depth.append(depth[state] + 1)
                state = child[key]
            best[state] = i
        fail = [0] * len(best)
        for key, state in sorted(child.items(), key=lambda item: depth[item[1]]):
            parent, byte = key >> 8, key & 255
            if parent:
                at = fail[parent]
                while at and at << 8 | byte not in child:
                    at = fail[at]
                fail[state] = child.get(at << 8 | byte, 0)
            if best[state] < 0:
                best[state] = best[fail[state]]
        self.state_best, self.state_fail = np.array(best), np.array(fail)
        self.child_keys = np.array(sorted(child), np.int64)
        self.child_list = array("q", self.child_keys.tobytes())
        self.child_states = np.array([child[k] for k in self.child_keys.tolist()])

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Edge parts of a token, each with the rank of the merge that uses it up."""
        out = [(token, _NEVER)]
        while token in self.halves:
            used, token = self.rank[token], self.halves[token][side]
            out.append((token, used))
        return out

    def _neighbours(self, left: int, right: int, before: int = _NEVER) -> bool:
        """Whether no merge across the border comes first (and earlier than ``before``)."""
        border = self._edge(right, 0)
        for a, a_used in self._edge(left, 1):
            for b, b_used in border:
                whole = self.merge.get((a, b))
                if whole is not None:
                    rank = self.rank[whole]
                    if rank < a_used and rank <= b_used and rank < before:
                        return False
        return True

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pair-compatibility table, filled with the pairs that come up."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        new = np.unique(keys[self.pair_keys[at] != keys])
        if len(new):
            if len(self.pair_keys) > PAIRS:
                self._forget()
                new = np.unique(keys)
            answers = [self._neighbours(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()]
            place = np.searchsorted(self.pair_keys, new)
            self.pair_keys = np.insert(self.pair_keys, place, new)
            self.pair_fits = np.insert(self.pair_fits, place, answers)
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_fits[at]

    def _next_states(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = np.zeros_like(state)
        live = np.arange(len(state))
        while len(live):
            keys = state[live] << 8 | byte[live]
            at = np.minimum(np.searchsorted(self.child_keys, keys), len(self.child_keys) - 1)
            found = self.child_keys[at] == keys
            out[live[found]] = self.child_states[at[found]]
            live = live[~found & (state[live] > 0)]
            state[live] = self.state_fail[state[live]]
        return out

    def encode_short(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most SHORT bytes, and how many each has.

        All words take their next step together: accept the token, try its
        next shorter prefix, or step back.
        """
        count = len(starts)
        size = ends - starts
        width = int(size.max(initial=0)) + 1
        base = np.arange(count) * width
        longest = np.full(count * width, -1)
        state = np.zeros(count, np.int64)
        for back in range(1, width):
            live = np.flatnonzero(size >= back)
            state[live] = self._next_states(state[live], raw[ends[live] - back].astype(np.int64))
            longest[base[live] + size[live] - back] = self.state_best[state[live]]
        open_end = np.ones(count * width, bool)
        out = np.zeros((count, width), np.int64)
        depth, at = np.zeros(count, np.int64), np.zeros(count, np.int64)
        token = longest[base].copy()
        live = np.flatnonzero(size > 0)
        while len(live):
            t = token[live]
            stuck = t < 0
            back = live[stuck]
            if len(back):
                if not depth[back].all():
                    raise ValueError("the vocabulary lacks a byte of the text")
                open_end[base[back] + at[back]] = False
                depth[back] -= 1
                token[back] = out[back, depth[back]]
                at[back] -= self.length[token[back]]
            go, t = live[~stuck], t[~stuck]
            end = at[go] + self.length[t]
            good = open_end[base[go] + end]
            check = np.flatnonzero(good & (depth[go] > 0))
            good[check] = self.fits(out[go[check], depth[go[check]] - 1], t[check])
            taken, end = go[good], end[good]
            out[taken, depth[taken]] = t[good]
            depth[taken] += 1
            at[taken] = end
            token[taken] = longest[base[taken] + end]
            token[go[~good]] = self.shorter_array[t[~good]]
            live = live[at[live] < size[live]]
        return out[np.arange(width) < depth[:, None]], depth

    def _child(self, state: int, byte: int) -> int:
        at = bisect_left(self.child_list, state << 8 | byte)
        if at < len(self.child_list) and self.child_list[at] == state << 8 | byte:
            return int(self.child_states[at])
        return -1

    def encode_long(self, word: bytes) -> list[int]:
        """The same for one word of any length."""
        n, state, longest = len(word), 0, [-1] * (len(word) + 1)
        for i in range(n - 1, -1, -1):
            found = self._child(state, word[i])
            while state and found < 0:
                state = int(self.state_fail[state])
                found = self._child(state, word[i])
            state = max(found, 0)
            longest[i] = int(self.state_best[state])
        out: list[int] = []
        open_end = bytearray(b"\1") * (n + 1)
        pairs: dict[tuple[int, int], bool] = {}
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                if open_end[at + self.size[token]]:
                    key = (out[-1], token) if out else None
                    if key is None or pairs.get(key) or (key not in pairs and pairs.setdefault(key, self._neighbours(*key))):
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.size[token]
                token = longest[at]
            elif not out:
                raise ValueError("the vocabulary lacks a byte of the text")
            else:
                open_end[at] = 0
                token = out.pop()
                at -= self.size[token]
        return out

    def encoded(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all spans one after the other, with the first place and count of each."""
        short = ends - starts <= SHORT
        for content in self.special:
            like = np.flatnonzero(ends - starts == len(content))
            letters = raw[starts[like, None] + np.arange(len(content))]
            short[like[(letters == np.frombuffer(content, np.uint8)).all(axis=1)]] = False
        parts, count = [], np.zeros(len(starts), np.int64)
        first = np.zeros(len(starts), np.int64)
        total = 0
        # Words of like length together keep the tables of a step narrow.
        by_size = np.flatnonzero(short)
        by_size = by_size[np.argsort((ends - starts)[by_size], kind="stable")]
        for low in range(0, len(by_size), TOGETHER):
            own = by_size[low : low + TOGETHER]
            flat, some = self.encode_short(raw, starts[own], ends[own])
            parts.append(flat.astype(np.int32))
            count[own], first[own] = some, total + np.cumsum(some) - some
            total += len(flat)
        for k in np.flatnonzero(~short).tolist():
            word = raw[starts[k] : ends[k]].tobytes()
            ids = [self.special[word]] if word in self.special else self.encode_long(word)
            parts.append(np.array(ids, np.int32))
            first[k], count[k] = total, len(ids)
            total += len(ids)
        return np.concatenate(parts) if parts else np.empty(0, np.int32), first, count


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _cut_special(raw: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Further cuts, so that special tokens in a text are pieces of their own."""
    text, cuts = raw.tobytes(), [offsets]
    for content in special:
        at = text.find(content)
        while at >= 0:
            if not np.any((offsets > at) & (offsets < at + len(content))):
                cuts.append(np.array([at, at + len(content)]))
                at = text.find(content, at + len(content))
            else:
                at = text.find(content, at + 1)
    return np.unique(np.concatenate(cuts)) if len(cuts) > 1 else offsets


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in steps(batches):
            raw, offsets = column_bytes(batch.column("text"))
            cuts = _cut_special(raw, offsets, list(vocab.special))
            starts, ends = pretokens(raw, cuts)
            if len(cuts) != len(offsets):  # a special token is one piece, whatever is in it
                whole = [c for c in cuts[:-1] if any(raw[c : c + len(s)].tobytes() == s for s in vocab.special)]
                for c in whole:
                    end = cuts[np.searchsorted(cuts, c) + 1]
                    kept = (starts <= c) | (starts >= end)
                    starts, ends = starts[kept], np.append(starts[kept][1:], len(raw))
            at, which = distinct(raw, starts, ends)
            flat, first, count = vocab.encoded(raw, starts[at], ends[at])
            ids = gather(flat, first[which], count[which])
            per_row = np.bincount(row_of(offsets, starts), weights=count[which], minlength=len(offsets) - 1)
            edges = np.concatenate([[0], np.cumsum(per_row.astype(np.int64))]).astype(np.int32)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))],
                names=["doc_id", "ids"],
            )

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text; no shuffle.

    ``path`` names a vocabulary file that all executors can read. Special
    tokens that occur in a text become their ids. A null or empty text has no
    ids. A null doc_id stays null; rows may repeat; other columns are ignored.
    """
    return only(docs, "doc_id", "text").mapInArrow(_encode(path), "doc_id long, ids array<int>")


def _decode(path: str, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            sizes = np.asarray(whole.column("ids").value_lengths().fill_null(0)).astype(np.int64)
            group = (np.cumsum(sizes) - sizes) // IDS
            edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), whole.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                batch = whole.slice(start, stop - start)
                column = batch.column("ids")
                ids = np.asarray(column.flatten())
                rows = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
                length = vocab.length[ids]
                raw = gather(vocab.blob, vocab.offset[ids], length)
                ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(rows)]
                # A text that ends inside a character reads as the library shows it.
                text, at, out = raw.tobytes(), 0, []
                for end in ends.tolist():
                    out.append(text[at:end].decode("utf-8", "replace"))
                    at = end
                yield pa.record_batch(
                    [*[batch.column(c) for c in passed], pa.array(out, pa.large_string()).cast(pa.string())],
                    names=[*passed, "text"],
                )

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """The columns of ``tokens`` (ids among them) and the text its ids stand for.

    Null or no ids give an empty text. Other columns pass through, but for one
    named text, which the decoded text replaces.
    """
    tokens = tokens.drop("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(_decode(path, tokens.columns), f"{fields}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and the text decoded from those ids: ``decode`` of ``encode`` in one pass of one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decode(path, ["doc_id", "ids"])(_encode(path)(batches))

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
