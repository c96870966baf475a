"""Encoding of whole texts in workers, with a bounded memo of white-space-delimited chunks.

The word-level tokenizer drops white space and never joins across it, so a text's ids are the ids of
its chunks in order. Chunks are told apart by 64-bit hashes, found for many texts at once in numpy; only
chunks that the memo lacks are encoded. The memo is an open-addressed table, emptied when half full.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np

from canopy.llm.shared import as_bytes, spans_hash, word_spans

BITS = 21  #: the memo has 2**BITS places
AT_ONCE = 200_000  #: chunks that are looked up together


def word_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(1 << BITS, np.uint64), np.zeros(1 << BITS, np.int32)
        self.start, self.size = np.zeros(1 << (BITS - 1), np.int64), np.zeros(1 << (BITS - 1), np.int32)
        self.ids, self.held, self.n_ids = np.zeros(1 << 20, np.uint32), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key in the memo, or -1. A key is never 0."""
        slot = (keys >> np.uint64(64 - BITS)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.place[slot], -1)
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << BITS) - 1)
            there = self.keys[slot[todo]]
            out[todo] = np.where(there == keys[todo], self.place[slot[todo]], -1)
            todo = todo[(there != keys[todo]) & (there != 0)]
        return out

    def learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        each = [e.ids for e in self.t.encode_batch_fast(chunks, add_special_tokens=False)]
        size = np.fromiter(map(len, each), np.int32, len(each))
        upto = np.cumsum(size, dtype=np.int64)
        while self.n_ids + upto[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.n_ids : self.n_ids + upto[-1]] = np.fromiter(chain.from_iterable(each), np.uint32, upto[-1])
        own = slice(self.held, self.held + len(size))
        self.start[own], self.size[own] = self.n_ids + upto - size, size
        self.held, self.n_ids = self.held + len(size), self.n_ids + int(upto[-1])
        number = np.arange(self.held - len(keys), self.held)
        slot = (keys >> np.uint64(64 - BITS)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            # Of the keys at a free place one takes it; all others move on by one.
            _, first = np.unique(slot[todo], return_index=True)
            first = todo[first][self.keys[slot[todo[first]]] == 0]
            self.keys[slot[first]], self.place[slot[first]] = keys[first], number[first]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << BITS) - 1)

    def chunks(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks in order, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(starts), AT_ONCE):
            a, b = starts[at : at + AT_ONCE], ends[at : at + AT_ONCE]
            keys = np.maximum(spans_hash(raw, a, b), np.uint64(1))
            code = self.find(keys)
            if (code < 0).any():
                new, first = np.unique(keys[code < 0], return_index=True)
                if self.held + len(new) > 1 << (BITS - 1):
                    self.clear()
                    new, first = np.unique(keys, return_index=True)
                    where = first
                else:
                    where = np.flatnonzero(code < 0)[first]
                self.learn(new, [raw[i:j].tobytes().decode() for i, j in zip(a[where].tolist(), b[where].tolist(), strict=True)])
                code = self.find(keys)
            size = self.size[code]
            upto = np.cumsum(size)
            ids.append(self.ids[np.arange(upto[-1]) + np.repeat(self.start[code] - upto + size, size)])
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def texts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, text k being the bytes from at[k] to at[k + 1], and where each text's ids start."""
        low, high = int(at[0]), int(at[-1])
        starts, ends = word_spans(raw[low:high])
        edges = at[1:-1] - low
        # A text may end where the next begins, without white space between: its last chunk ends there.
        inner = np.unique(edges[(np.searchsorted(starts, edges) > np.searchsorted(ends, edges, "right"))])
        starts, ends = np.sort(np.concatenate((starts, inner))) + low, np.sort(np.concatenate((ends, inner))) + low
        ids, sizes = self.chunks(raw, starts, ends)
        before = np.concatenate(([0], np.cumsum(sizes)))
        return ids, before[np.searchsorted(starts, at)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        rows = [as_bytes(t) for t in texts]
        ids, at = self.texts(np.concatenate([np.zeros(0, np.uint8), *rows]), np.cumsum([0, *map(len, rows)]))
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)
