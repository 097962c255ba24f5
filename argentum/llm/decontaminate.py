"""Benchmark decontamination: rare seeds find passages, Smith-Waterman scores them.

1. How often the corpus holds each pair of neighbouring words of the test items, next
   to each other or with one word between them, is counted over all documents.
2. The rarest pairs of an item are its seeds.  A document that holds a seed is a
   candidate at the place where the item would begin; places close together are one
   passage.  A matched word after another one adds at most 1 where their pair is not a
   seed or is found, and at most 1/4 for each pair that is passed otherwise (a match
   two words on, less a replaced word, is 1/2 for two pairs; two words put between cost
   the match).  So a passage with h of an item's c seeds scores at most
   ``n - 3/4 (c - h)`` of n: there are enough seeds that none of them is not enough, and
   passages with too few of them are left.  Items too short for that have all their
   words as seeds.
3. A passage whose words, as a multiset, cannot reach the threshold is left; the
   others are aligned with the item, word by word: a match counts 1, another word or
   a gap costs ``COST``.  The score is the best local alignment over the item's
   length, so a whole copy has 1, and edits lower it gently.

The test items are a stated query set: they are read in blocks of at most
``BLOCK_WORDS`` words, and each block is sent to the tasks that read the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm import textops
from argentum.llm.common import small_batches

#: Words from one word of a pair to the other, in a document.
STEPS = (1, 2)
#: What a passage loses at least for a seed that it does not hold.
LOSS = 0.75
THRESHOLD = 0.5
COST = 0.5
#: An item with fewer words counts, in a document of more than twice its words, only word for word
#: (a few common words would make half of it); 0 scores all items alike.
MIN_WORDS = 8
#: Words of the items in a block: about 60 MB in each task.
BLOCK_WORDS = 1_000_000
#: One seed for so many words of an item, beyond those that are needed: fewer passages by chance.
SPARE = 8

FOUND = "doc_id long, item_id long, score double, start_word long, end_word long"


def pairs(hashes: np.ndarray, firsts: np.ndarray, step: int):
    """(text, word, hash) of every word and the one ``step`` words on in its text; of single words for 0."""
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    with np.errstate(over="ignore"):
        if not step:
            return text, np.arange(len(hashes)), textops.mix(hashes + textops.ODD)
        word = np.flatnonzero(text[:-step] == text[step:])
        return text[word], word, textops.mix(hashes[word] * textops.ODD + hashes[word + step])


class Block:
    """Test items, with their seeds: all that may be one and, once the corpus is counted, the rarest."""

    def __init__(self, ids: list, texts: pa.Array, threshold: float):
        self.ids, self.words = ids, []
        hasher, runs, owners, places = textops.Hasher(), [], [], []
        for row, data, cuts in textops.chunks(texts):
            hashes, firsts, _, _ = hasher.words(data, cuts)
            n = np.diff(firsts)
            for step in (0, 1):
                text, word, code = pairs(hashes, firsts, step)
                own = (n - 1 > (1 - threshold) * n / LOSS)[text] == bool(step)
                runs.append(code[own])
                owners.append(text[own] + row)
                places.append((word - firsts[text])[own])
            self.words += [hashes[a:b] for a, b in zip(firsts, firsts[1:])]
        empty = np.zeros(0, np.int64)
        self.runs = np.concatenate([empty.astype(np.uint64), *runs])
        self.owners, self.places = np.concatenate([empty, *owners]), np.concatenate([empty, *places])
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        spare = (1 - threshold) * self.sizes / LOSS  # seeds that may be missing
        paired = self.sizes - 1 > spare
        some = np.ceil(spare) + 1 + self.sizes // SPARE
        #: Seeds of each item, and how many of them a passage holds at least.
        self.seeds = np.where(paired, np.minimum(self.sizes - 1, some), self.sizes).astype(np.int64)
        self.need = np.where(paired, np.maximum(1, np.ceil(self.seeds - spare - 1e-9)), 1).astype(np.int64)
        self.steps = STEPS if paired[self.sizes > 0].all() else (0, *STEPS)

    def choose(self, counts: dict[int, int]) -> None:
        """Keep the rarest seeds of each item, sorted by hash; those that no document holds need no look-up."""
        seen = np.array([counts.get(int(r), 0) for r in self.runs.astype(np.int64)])
        order = np.lexsort((self.places, seen, self.owners))
        size = np.bincount(self.owners, minlength=len(self.ids))
        rank = np.arange(len(order)) - (np.cumsum(size) - size)[self.owners[order]]
        kept = order[(rank < self.seeds[self.owners[order]]) & (seen[order] > 0)]
        kept = kept[np.argsort(self.runs[kept], kind="stable")]
        self.runs, self.owners, self.places = self.runs[kept], self.owners[kept], self.places[kept]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """(best local score, end in the passage), by Smith-Waterman with linear gaps."""
    best, end = 0.0, 0
    row = np.zeros(len(passage) + 1)
    slope = COST * np.arange(len(passage) + 1)
    for word in item:
        fresh = np.maximum(0, row - COST)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + np.where(passage == word, 1.0, -COST))
        row = np.maximum.accumulate(fresh + slope) - slope  # gaps along the passage
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
    return best, end


def reachable(item: np.ndarray, passage: np.ndarray) -> float:
    """The share of the item's words, as a multiset, that the passage has: a bound of the score."""
    names, need = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(names, passage), len(names) - 1)
    have = np.bincount(at[names[at] == passage], minlength=len(names))
    return float(np.minimum(need, have).sum()) / len(item)


class Finder:
    """Leaks in the texts of a task."""

    def __init__(self, block: Block, threshold: float, min_words: int = MIN_WORDS):
        self.block, self.threshold, self.min_words, self.hasher = block, threshold, min_words, textops.Hasher()
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(block.runs & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, code: np.ndarray):
        """(position in code, seed) of every seed in code."""
        at = np.flatnonzero(self.maybe[(code & np.uint64((1 << 22) - 1)).astype(np.int64)])
        low = np.searchsorted(self.block.runs, code[at], "left")
        n = np.searchsorted(self.block.runs, code[at], "right") - low
        ends = np.cumsum(n)
        seed = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)
        return np.repeat(at, n), seed

    def found(self, hashes: np.ndarray, firsts: np.ndarray):
        """(text, word, item, place in the item) of every seed in the texts."""
        out = []
        for step in self.block.steps:
            text, word, code = pairs(hashes, firsts, step)
            at, seed = self.hits(code)
            out.append((text[at], word[at], self.block.owners[seed], self.block.places[seed]))
        return [np.concatenate(x) for x in zip(*out)]

    def leaks(self, texts: pa.Array):
        """(row, item, score, start word, end word) of each text and item, the best passage of each."""
        block = self.block
        for row, data, cuts in textops.chunks(texts):
            hashes, firsts, _, _ = self.hasher.words(data, cuts)
            text, word, item, place = self.found(hashes, firsts)
            begin = word - place
            order = np.lexsort((begin, item, text))
            text, item, begin, place = text[order], item[order], begin[order], place[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(begin) > block.sizes[item[1:]])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(text))
            passage, _, _ = textops.multiset(np.cumsum(new) - 1, place)
            held = np.bincount(passage, minlength=len(starts))
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            n = block.sizes[item[starts]]
            whole = (n < self.min_words) & (np.diff(firsts)[text[starts]] > 2 * n)
            for i in np.flatnonzero(held >= np.where(whole, block.seeds[item[starts]], block.need[item[starts]])):
                t, k = int(text[starts[i]]), int(item[starts[i]])
                n = len(block.words[k])
                low = max(int(firsts[t]), int(begin[starts[i]]) - n)  # at most n words are put in
                high = min(int(firsts[t + 1]), int(begin[ends[i] - 1]) + 2 * n)
                found = self.judge(block.words[k], hashes[low:high], int(firsts[t + 1] - firsts[t]))
                if found and found[0] > best.get((t, k), (0.0,))[0]:
                    score, start, end = found
                    best[t, k] = score, low - int(firsts[t]) + start, low - int(firsts[t]) + end
            for (t, k), (score, start, end) in best.items():
                yield row + t, k, score, start, end

    def judge(self, item, passage, text_words: int):
        n = len(item)
        threshold = max(1.0, self.threshold) if n < self.min_words and text_words > 2 * n else self.threshold
        if reachable(item, passage) < threshold:
            return None
        best, end = align(item, passage)
        if best / n < threshold:
            return None
        back, length = align(item[::-1], passage[:end][::-1])
        return best / n, end - length, end


def blocks(spark, benchmark: DataFrame, id_col: str, text_col: str, threshold: float):
    """The items in blocks of bounded size, one after the other."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (4 * BLOCK_WORDS)))
    for k in range(n):
        got = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
        if len(got):
            yield Block(got.column("id").to_pylist(), got.column("text").combine_chunks(), threshold)


def count_runs(docs: DataFrame, block: Block, text_col: str) -> dict[int, int]:
    """How often all documents hold each seed of the block, added up in the tasks first."""
    names = np.unique(block.runs)

    def count(batches):
        hasher, total = textops.Hasher(), np.zeros(len(names), np.int64)
        maybe = np.zeros(1 << 22, bool)
        maybe[(names & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches:
            for _, data, cuts in textops.chunks(batch.column(0)):
                hashes, firsts, _, _ = hasher.words(data, cuts)
                for step in block.steps:
                    _, _, code = pairs(hashes, firsts, step)
                    code = code[maybe[(code & np.uint64((1 << 22) - 1)).astype(np.int64)]]
                    at = np.minimum(np.searchsorted(names, code), max(0, len(names) - 1))
                    total += np.bincount(at[names[at] == code], minlength=len(names))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[some].astype(np.int64)), pa.array(total[some])], names=["run", "n"])

    if not len(names):
        return {}
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "run long, n long")
    return {r["run"]: r["n"] for r in counted.groupBy("run").agg(F.sum("n").alias("n")).collect()}  # at most the block's runs


def _seeded(docs: DataFrame, benchmark: DataFrame, threshold: float, item_col: str, text_col: str, item_text_col: str):
    small_batches(docs.sparkSession)
    for block in blocks(docs.sparkSession, benchmark, item_col, item_text_col, threshold):
        block.choose(count_runs(docs, block, text_col))
        yield block


def find(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per document row and test item found in it: doc_id, item_id, score, start_word, end_word.

    Words are numbered from 0; ``end_word`` is behind the last.  Null and empty texts
    and items have no words and are never found.  Whole texts of any length are read.  Items of
    fewer than ``min_words`` words count in longer texts only word for word; 0 scores them all alike.
    Repeated rows repeat their answer.  An empty table, of documents or of items,
    gives an empty result.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    for block in _seeded(docs, benchmark, threshold, item_col, text_col, item_text_col):

        def search(batches, block=block):
            finder = Finder(block, threshold, min_words)
            for batch in batches:
                names = batch.column(0).to_pylist()
                got = [(names[r], block.ids[k], s, a, b) for r, k, s, a, b in finder.leaks(batch.column(1))]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in FOUND.split(", ")]
                )

        out = out.unionByName(rows.mapInArrow(search, FOUND))
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS,
) -> DataFrame:
    """The rows of docs that hold no test item, with all columns and repeats; nothing is joined or moved.

    See ``find`` for null, empty and very long texts and short items.  Without items all rows stay; an
    empty table gives an empty result.  Other columns may have any name.
    """
    at, out = docs.columns.index(text_col), docs
    for block in _seeded(docs, benchmark, threshold, item_col, text_col, item_text_col):

        def keep(batches, block=block):
            finder = Finder(block, threshold, min_words)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, *_ in finder.leaks(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out
