"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint is cut into three segments.  Two fingerprints that differ in at most two bits agree
in one segment at least, and differ in at most two bits of the segment after it.  The
binary Golay code parts all words of 23 bits into balls of radius 3: the codewords of a segment's
neighbours at one bit are its keys (one, or six), and two segments that differ in at most two bits
have a neighbour and so a key in common.  Candidates share a whole segment and a
key of the next one, and are verified.

A bucket of very many fingerprints is not compared pair by pair: each of its members tells the
words that differ from it in one bit, and fingerprints that tell the same word are linked to
the least of them.  They differ in at most two bits, and all that do have such a word in common.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.llm.common import materialise, salted_lookup, small_batches
from argentum.llm.components import components

WIDTH, SEED, BITS = 3, 42, 2
#: First bit and length of each segment.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
#: The Golay code's generator polynomial (fixed value).
GENERATOR = 0b101011100011
#: Members of a bucket that are compared pair by pair.
HELD = 64
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
BLANK = re.compile(rb"[ \t-\r]")
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 16


def _pieces(text: bytes):
    """The words of a text, piece by piece, lower-cased from A to Z; pieces end at blanks."""
    at = 0
    while at < len(text):
        found = BLANK.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes):
    """Arrays of XXH64 of all runs of WIDTH words; of all words where they are fewer; none without words."""
    held: list[bytes] = []
    told = False
    for words in _pieces(text):
        held += words
        n = len(held) - WIDTH + 1
        if n > 0:
            told = True
            joined = b" ".join(held)
            ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
            first = np.concatenate([[0], ends[: n - 1]]).tolist()
            hash_, seed = xxhash.xxh64_intdigest, SEED
            yield np.array([hash_(joined[a:b], seed) for a, b in zip(first, (ends[WIDTH - 1 :] - 1).tolist())], np.uint64)
            held = held[n:]
    if held and not told:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text: a bit is set where more than half of its hashes have it."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, of, n = [], [], 0

    def count():
        hashes, lengths = np.concatenate(held), np.array([len(h) for h in held])
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(lengths) - lengths
        np.add.at(ones, of, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        np.add.at(total, of, lengths)

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text):
            held.append(hashes)
            of.append(i)
            n += len(hashes)
            if n >= COUNTED:
                count()
                held, of, n = [], [], 0
    if held:
        count()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprinted(batches):
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.string()), "").cast(pa.binary()).to_pylist()
        marks = fingerprints(texts).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(len(texts))), pa.array(marks)], names=["id", "nth", "mark"])


def _remainders() -> np.ndarray:
    """The remainder of each of the 23 bits modulo the generator polynomial."""
    out, x = [], 1
    for _ in range(23):
        out.append(x)
        x <<= 1
        if x >> 11:
            x ^= GENERATOR
    return np.array(out, np.int64)


REMAINDERS = _remainders()


def _leaders() -> np.ndarray:
    """The error of at most three bits for each of the 2048 remainders; each has just one."""
    out = np.zeros(1 << 11, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            out[np.bitwise_xor.reduce(REMAINDERS[list(bits)])] = sum(1 << b for b in bits)
    return out


LEADERS = _leaders()


def codewords(words: np.ndarray) -> np.ndarray:
    """(n, 24) numbers of the codewords nearest to each 23-bit word and to its neighbours at one bit."""
    rest = np.zeros(len(words), np.int64)
    for b, remainder in enumerate(REMAINDERS):
        rest ^= np.where(words >> b & 1, remainder, 0)
    flips = np.concatenate([[0], 1 << np.arange(23)])
    leaders = LEADERS[rest[:, None] ^ np.concatenate([[0], REMAINDERS])]
    return (words[:, None] ^ flips ^ leaders) >> 11


def keys(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the bucket keys of each fingerprint, each once."""
    marks = marks.view(np.uint64)
    parts = [(marks >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, found = [], []
    for i, own in enumerate(parts):
        numbers = np.sort(codewords(parts[(i + 1) % len(parts)]), axis=1)
        new = np.ones(numbers.shape, bool)
        new[:, 1:] = numbers[:, 1:] != numbers[:, :-1]
        row, at = np.nonzero(new)
        rows.append(row)
        found.append((i << 40) + (own[row] << 12) + numbers[row, at])
    return np.concatenate(rows), np.concatenate(found)


def _keyed(batches):
    for batch in batches:
        marks = batch.column(0).to_numpy(zero_copy_only=False)
        row, key = keys(marks)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(marks[row])], names=["key", "mark"])


def links(marks: DataFrame, held: int = HELD) -> DataFrame:
    """(a, b) over distinct fingerprints (column mark): links that join all which differ in at most BITS bits.

    Buckets of at most ``held`` members give every such pair; larger ones enough of them to keep
    all their members' components.
    """
    keyed = materialise(marks.mapInArrow(_keyed, "key long, mark long"), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialise(keyed.join(sizes, "key"), "buckets")
    few = shared.where(F.col("members") <= held)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    met = few.select("key", F.col("mark").alias("a")).join(few.select("key", F.col("mark").alias("b")), "key")
    pairs = met.where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()

    crowded = shared.where(F.col("members") > held).select("mark").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    told = crowded.select("mark", F.explode(F.transform(flips, lambda f: F.col("mark").bitwiseXOR(f))).alias("word"))
    # at most 65 fingerprints tell a word
    stars = told.select(F.min("mark").over(Window.partitionBy("word")).alias("a"), F.col("mark").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(stars)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Words are cut at the characters of ``[\\x20\\x09-\\x0D]`` and lower-cased from A to Z only.  The
    hashes of all runs of three words, repeats included, vote on each bit.  A text of one or two words
    is one run; texts without words (null, empty, blank) have the fingerprint zero and are linked like
    any others.  Fingerprints that differ in at most two bits are linked, and ``component_id`` is the
    least id that links reach.  Null ids have no part in that: their rows get their
    component's id, null where it has none.  Repeated rows and ids repeat their answer.
    Texts may be of any length.  An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = materialise(rows.mapInArrow(_fingerprinted, "id long, nth long, mark long"), "fingerprints")
    marks = materialise(marked.groupBy("mark").agg(F.min("id").alias("low")), "marks")
    joined = components(materialise(links(marks.select("mark"), held), "links"))
    labelled = marks.join(joined, F.col("mark") == F.col("node"), "left").select("mark", "low", F.coalesce("component", "mark").alias("label"))
    labelled = materialise(labelled, "labelled")
    lows = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    answers = labelled.select("mark", "label").join(lows, "label").select("mark", "component_id")
    return salted_lookup(marked, "mark", "nth", answers).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id"
    )
