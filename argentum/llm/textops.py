"""Word and shingle hashes for whole Arrow batches, in numpy.

A word is a longest run of letters, digits, ``_`` and characters outside ASCII, in
lower case.  Hashes are the same on every machine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Spans that are longer than this and cross the end of a window are hashed one by one, window by window.
OVERLAP = 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
#: A second polynomial, modulo a prime: what cancels modulo 2**64 does not cancel here.
PRIME, PRIME_BASE = (1 << 31) - 1, 1_234_567_891
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _prime_powers(base: int, size: int) -> np.ndarray:
    """base**0, base**1, ... modulo PRIME, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:size]


class Hasher:
    """Hashes of spans of bytes.  Texts are gone through in windows, so tables and sums stay small however long a text is."""

    def __init__(self):
        self.up = self.down = self.prime_up = self.prime_down = np.ones(1, np.uint64)

    def powers(self, n: int):
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + OVERLAP + 1)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE_INVERSE)]))
            self.prime_up = _prime_powers(PRIME_BASE, size)
            self.prime_down = _prime_powers(pow(PRIME_BASE, -1, PRIME), size)
        return self.up, self.down

    def words(self, data: np.ndarray, cuts: np.ndarray):
        """Hash and first word of each text; data: bytes, cuts: its texts' offsets from 0, with the end.

        Returns (hashes, first word of each text and the end, start byte, end byte).
        """
        n = len(data)
        word = WORD_BYTE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = cuts[cuts < n]
        begins[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        last = inner[inner > 0] - 1
        ends[last] = word[last]
        a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return self.spans(data, a, b), np.searchsorted(a, cuts), a, b

    def spans(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span [a, b), which depends on nothing else."""
        if len(data) <= CHUNK_BYTES + OVERLAP:
            return self._window(data, a, b)
        out = np.zeros(len(a), np.uint64)
        order = np.argsort(a, kind="stable") if len(a) and (a[1:] < a[:-1]).any() else None
        starts = a if order is None else a[order]
        for at in range(0, len(data), CHUNK_BYTES):
            low, high = np.searchsorted(starts, [at, at + CHUNK_BYTES])
            own = np.arange(low, high) if order is None else order[low:high]
            end = at + CHUNK_BYTES + OVERLAP
            inside = b[own] <= end
            near = own[inside]
            out[near] = self._window(data[at:end], a[near] - at, b[near] - at)
            for i in own[~inside]:
                out[i] = self._long(data[a[i] : b[i]])
        return out

    def _window(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(data)
        up, down = self.powers(n + 1)
        value = data.astype(np.uint64) + np.uint64(1)
        sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(value * up[:n], out=sums[1:])
            code = mix((sums[b] - sums[a]) * down[a] + ODD * (b - a).astype(np.uint64))
            # terms below 2**40, so the sums of a window fit
            np.cumsum(value * self.prime_up[:n], out=sums[1:])
            rest = (sums[b] - sums[a]) % np.uint64(PRIME) * self.prime_down[a] % np.uint64(PRIME)
            return mix(code + ODD * rest)

    def _long(self, data: np.ndarray) -> np.uint64:
        """The same hash of one long span: the sums of its windows, each moved by the power of where it begins."""
        plain = prime = 0
        self.powers(CHUNK_BYTES + 1)
        for at in range(0, len(data), CHUNK_BYTES):
            value = data[at : at + CHUNK_BYTES].astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                plain += int((value * self.up[: len(value)]).sum()) * pow(int(BASE), at, 1 << 64)
                prime += int((value * self.prime_up[: len(value)]).sum()) * pow(PRIME_BASE, at, PRIME)
        with np.errstate(over="ignore"):
            code = mix(np.array([plain % (1 << 64)], np.uint64) + ODD * np.array([len(data)], np.uint64))
            return mix(code + ODD * np.array([prime % PRIME], np.uint64))[0]


def word_digests(data: np.ndarray, cuts: np.ndarray, a: np.ndarray, b: np.ndarray, firsts: np.ndarray):
    """(first, second) halves of a 128-bit BLAKE2 digest of each text's words, in order; a, b: their bytes.

    Texts have equal digests when their words are the same: what stands between words does
    not count.
    """
    inked = WORD_BYTE[data]  # bytes of words; words that touch at a cut stay apart by text
    kept = inked.copy()
    after = b[b < len(data)]
    kept[after] = True  # one byte behind each word parts it from the next
    raw = np.where(inked, data, 32).astype(np.uint8)[kept].tobytes()
    at = np.concatenate([[0], np.cumsum([np.count_nonzero(kept[x:y]) for x, y in zip(cuts.tolist(), cuts[1:].tolist())])])
    out = np.zeros((len(cuts) - 1, 2), np.int64)
    for i, (x, y) in enumerate(zip(at.tolist(), at[1:].tolist())):
        out[i] = np.frombuffer(hashlib.blake2b(raw[x:y].strip(b" "), digest_size=16).digest(), "<i8")
    return out[:, 0], out[:, 1]


def chunks(texts: pa.Array, lower: bool = True):
    """(first row, data, cuts) of runs of texts of about CHUNK_BYTES; null counts as empty.

    A text longer than that is a chunk of its own: no text is cut.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, body = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def windows(hashes: np.ndarray, firsts: np.ndarray, width: int):
    """(text, word, hash) of every run of ``width`` words inside a text.

    A text with fewer words, but any, has one run: all its words.
    """
    counts = np.diff(firsts)
    n = len(hashes)
    text_of = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        if n >= width:
            total = np.zeros(n - width + 1, np.uint64)
            for k in range(width):
                total = total * ODD + hashes[k : n - width + 1 + k]
            full = np.flatnonzero(text_of[: n - width + 1] == text_of[width - 1 :])
            text, word, code = text_of[full], full, mix(total[full])
        else:
            text, word, code = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for i, t in enumerate(short):
                h = np.uint64(width)
                for x in hashes[firsts[t] : firsts[t + 1]]:
                    h = h * ODD + x
                whole[i] = h
            text, word, code = (
                np.concatenate(x) for x in ((text, short), (word, firsts[short]), (code, mix(whole)))
            )
            order = np.argsort(text, kind="stable")
            text, word, code = text[order], word[order], code[order]
    return text, word, code


def multiset(text: np.ndarray, code: np.ndarray):
    """(text, code, count) of distinct codes of each text, in order."""
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], code[at], np.diff(np.append(at, len(code)))


def occurrences(code: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the k-th occurrence of a code has a hash of its own."""
    code = np.sort(code)
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    at = np.flatnonzero(new)
    nth = np.arange(len(code)) - np.repeat(at, np.diff(np.append(at, len(code))))
    with np.errstate(over="ignore"):
        return np.sort(mix(code + ODD * nth.astype(np.uint64)).astype(np.int64))


def list_array(values: np.ndarray, counts: np.ndarray, kind=pa.int64()) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
