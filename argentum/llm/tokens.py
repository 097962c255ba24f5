"""Token ids of whole texts, for Arrow batches, by a public tokenizer file.

A text is cut where the tokenizer itself always cuts: at ASCII white space, and
between an ASCII letter or digit and punctuation that cannot begin a contraction
or a special token.  Ids of a part are then the same wherever it stands, so each
worker keeps those of the parts it has met and calls the tokenizer for new ones
only.  Parts are looked up by a hash and then compared byte by byte: parts that
only share a hash are kept under their bytes.  What a worker keeps is bounded and never
changes a result.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa

from argentum.llm import textops

#: Parts whose ids a worker keeps before it starts afresh, and their bytes.
KEPT, KEPT_BYTES = 1 << 20, 1 << 26
OTHER, SPACE, LETTER, POINT = range(4)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[list(b" \t\n\x0b\x0c\r")] = SPACE
_KIND[[b for b in range(128) if chr(b).isalnum()]] = LETTER
_KIND[list(b'.,;:!?#$%&*()-/"~`@+[]{}^\\_')] = POINT


def parts(data: np.ndarray, cuts: np.ndarray):
    """(start bytes, end bytes, first part of each text and the end)."""
    kind = _KIND[data]
    inked = kind != SPACE
    fresh = np.ones(len(data), bool)
    before, after = kind[:-1], kind[1:]
    fresh[1:] = (before == SPACE) | ((before == LETTER) & (after == POINT)) | ((before == POINT) & (after == LETTER))
    fresh[cuts[cuts < len(data)]] = True
    a = np.flatnonzero(fresh & inked)
    # a part ends before the next fresh byte or space
    stops = np.flatnonzero(fresh | ~inked)
    at = np.searchsorted(stops, a, "right")
    b = np.append(stops, len(data))[at]
    return a, b, np.searchsorted(a, cuts)


class Encoder:
    """Ids of the texts of a chunk, by the tokenizer file at ``path``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.hasher = textops.Hasher()
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)  # hashes in order, and the slot of each
        self.slots = np.zeros(0, np.int64)
        self.others: dict[bytes, int] = {}  # slots of parts whose hash another part has
        self.pool, self.first = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)
        self.text, self.begin = np.zeros(1 << 18, np.uint8), np.zeros(1, np.int64)

    def _learn(self, parts_: list[bytes]) -> np.ndarray:
        """Keep the ids and bytes of new parts; their slots."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in parts_], add_special_tokens=False)]
        self.pool, ends = _append(self.pool, self.first, list(itertools.chain.from_iterable(found)), [len(x) for x in found])
        self.first = np.concatenate([self.first, ends])
        self.text, ends = _append(self.text, self.begin, np.frombuffer(b"".join(parts_), np.uint8), [len(p) for p in parts_])
        self.begin = np.concatenate([self.begin, ends])
        return len(self.first) - 1 - len(parts_) + np.arange(len(parts_))

    def _differ(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Parts [a, b) whose bytes are not those kept in their slot."""
        size = b - a
        wrong = self.begin[slot + 1] - self.begin[slot] != size
        same = np.flatnonzero(~wrong)
        own = size[same]
        starts = np.cumsum(own) - own
        step = np.arange(own.sum()) - np.repeat(starts, own)
        unlike = data[step + np.repeat(a[same], own)] != self.text[step + np.repeat(self.begin[slot[same]], own)]
        if unlike.any():
            wrong[same] = np.logical_or.reduceat(unlike, starts)
        return np.flatnonzero(wrong)

    def ids(self, data: np.ndarray, cuts: np.ndarray):
        """(ids, offset of each text and the end) of texts that lie at ``cuts``."""
        a, b, firsts = parts(data, cuts)
        if not len(a):
            return np.zeros(0, np.uint32), np.zeros(len(cuts), np.int64)
        hashes, at, back = np.unique(self.hasher.spans(data, a, b), return_index=True, return_inverse=True)
        if len(self.first) > KEPT or self.begin[-1] > KEPT_BYTES:
            self._forget()
        place = np.searchsorted(self.known, hashes)
        here = place < len(self.known)
        here[here] = self.known[place[here]] == hashes[here]
        new = np.flatnonzero(~here)
        if len(new):
            raw = data.tobytes()
            slots = self._learn([raw[x:y] for x, y in zip(a[at[new]].tolist(), b[at[new]].tolist())])
            self.slots = np.insert(self.slots, place[new], slots)
            self.known = np.insert(self.known, place[new], hashes[new])
            place = np.searchsorted(self.known, hashes)
        slot = self.slots[place][back]
        wrong = self._differ(data, a, b, slot)
        if len(wrong):
            spans = [data[x:y].tobytes() for x, y in zip(a[wrong].tolist(), b[wrong].tolist())]
            fresh = sorted({p for p in spans if p not in self.others})
            if fresh:
                self.others.update(zip(fresh, self._learn(fresh).tolist()))
            slot[wrong] = [self.others[p] for p in spans]
        begin, size = self.first[slot], self.first[slot + 1] - self.first[slot]
        ends = np.cumsum(size)
        take = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return self.pool[take], np.concatenate([[0], ends])[firsts]


def _append(pool: np.ndarray, ends: np.ndarray, values, sizes: list[int]):
    """(pool with values behind what it holds, their ends)."""
    added = ends[-1] + np.cumsum(np.array(sizes, np.int64))
    while added[-1] > len(pool):
        pool = np.concatenate([pool, np.zeros_like(pool)])
    pool[ends[-1] : added[-1]] = values
    return pool, added


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder: tasks that follow each other in a worker share what it has met."""
    return Encoder(path)


def encoded(texts: pa.Array, by: Encoder):
    """(row, ids) of each text, in order; null counts as empty."""
    for row, data, cuts in textops.chunks(texts, lower=False):
        ids, offsets = by.ids(data, cuts)
        for i, (x, y) in enumerate(zip(offsets, offsets[1:])):
            yield row + i, ids[x:y]
