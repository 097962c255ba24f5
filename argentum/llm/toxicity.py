"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

The units of a text are its words, and the words that punctuation or single-letter
spelling has pulled apart, joined again.  The kernel of two units is the normalised
inner product over their subsequences of three letters, each counted with
``DECAY`` to the number of letters it skips, so inserted letters and gaps cost a
little instead of everything.  The machine lives in the span of landmarks chosen
among the training units (Nyström).  As the kernel is an inner product over finitely
many subsequences, the landmarks' expansion adds up to one weight for each
subsequence; scoring a unit with these weights gives the very numbers of the
expansion.

A text is as toxic as its worst unit, and a long unit as its worst window.  Labels belong to texts, so training
alternates: the machine picks the worst window of each toxic text, and is fitted
again on those against the windows of clean texts.  A logistic curve turns the
text's margin into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.llm import textops
from argentum.llm.common import small_batches

GAPS, DECAY = 3, 0.5
#: Letters of a unit that are looked at together; longer units are cut with overlap.
SPAN, STEP = 22, 11
WIDTHS = (6, 10, 14, SPAN + 2)
SYMBOLS, EDGE, BLANK = 32, 0, 31
LANDMARKS = 128
#: Labelled texts of each class from which the classifier is fitted, on average.
SAMPLE = 2500
#: Windows of one text from which it learns, at most, drawn by their hash from all of them.
PER_TEXT = 20000
#: Clean windows (and first candidates) of a machine, and those that each round adds because they look toxic.
NEGATIVES, HARD = 20000, 2000
ROUNDS = 6
#: A candidate is more than this many times as frequent in toxic texts as in clean ones.
LIFT = 10
#: Units whose margins a worker keeps before it starts afresh.
KEPT = 1 << 20

_SYMBOL = np.full(256, BLANK, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[[ord(c) for c in "0134578"]] = [ord(c) - 96 for c in "oieastb"]  # digits that stand for letters
_SYMBOL[[ord(c) for c in "269_"]] = 27
_SYMBOL[128:] = 28 + np.arange(128) % 3
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_OFFSETS = [(d, e) for d in range(1, GAPS + 2) for e in range(1, GAPS + 3 - d)]


def units(hasher: textops.Hasher, data: np.ndarray, cuts: np.ndarray):
    """(bytes, start, end, text, hash) of the words and the joined words."""
    hashes, firsts, a, b = hasher.words(data, cuts)
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(firsts))
    if len(a) < 2:
        return data, a, b, text, hashes
    # spaces before each byte tell whether a gap has any
    spaces = np.concatenate([[0], np.cumsum(_SPACE[data])])
    gap = a[1:] - b[:-1]
    tight = spaces[a[1:]] == spaces[b[:-1]]
    single = (b - a) == 1
    joined = (text[1:] == text[:-1]) & (gap <= 3) & (tight | (single[1:] & single[:-1]))
    lead = np.concatenate([[True], ~joined])  # begins a group
    group = np.cumsum(lead) - 1
    size = np.bincount(group)
    inside = size[group] > 1
    if not inside.any():
        return data, a, b, text, hashes
    length = b[inside] - a[inside]
    ends = np.cumsum(length)
    take = np.arange(ends[-1]) + np.repeat(a[inside] - (ends - length), length)
    glued = data[take]
    opens = np.flatnonzero(lead[inside])
    g_a = (ends - length)[opens]
    g_b = np.append(g_a[1:], len(glued))
    g_text = text[inside][opens]
    g_hash = hasher.spans(glued, g_a, g_b)
    n = len(data)
    return (
        np.concatenate([data, glued]),
        np.concatenate([a, g_a + n]),
        np.concatenate([b, g_b + n]),
        np.concatenate([text, g_text]),
        np.concatenate([hashes, g_hash]),
    )


def windows(data: np.ndarray, a: np.ndarray, b: np.ndarray):
    """(owner, start, end) of the windows of each unit: one, or several that overlap."""
    length = b - a
    count = np.where(length <= SPAN, 1, -(-(length - SPAN) // STEP) + 1)
    owner = np.repeat(np.arange(len(a)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = a[owner] + nth * STEP
    return owner, start, np.minimum(start + SPAN, b[owner])


def subsequences(data: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Blocks (rows, codes, values): each window's subsequences, with unit length."""
    length = b - a + 2
    low = 0
    for width in WIDTHS:
        all_rows = np.flatnonzero((length > low) & (length <= width))
        low = width
        for at in range(0, len(all_rows), 20000):
            rows = all_rows[at : at + 20000]
            column = np.arange(width)
            place = a[rows, None] + column - 1
            letters = _SYMBOL[data[np.clip(place, 0, max(0, len(data) - 1))]].astype(np.int32)
            letters[:, 0] = EDGE
            last = (b[rows] - a[rows] + 1)[:, None]
            letters[column == last] = EDGE
            letters[column > last] = BLANK
            codes, decay = [], []
            for d, e in _OFFSETS:
                k = width - d - e
                if k > 0:
                    x, y, z = letters[:, :k], letters[:, d : d + k], letters[:, d + e :]
                    lost = (x == BLANK) | (y == BLANK) | (z == BLANK)
                    codes.append(np.where(lost, -1, (x * SYMBOLS + y) * SYMBOLS + z))
                    decay.append(np.full(k, DECAY ** (d + e - 2)))
            codes = np.concatenate(codes, 1)
            values = np.where(codes < 0, 0.0, np.concatenate(decay))
            order = np.argsort(codes, 1)
            codes = np.take_along_axis(codes, order, 1)
            values = np.take_along_axis(values, order, 1)
            # equal codes of a row are summed at their last place
            total = np.cumsum(values, 1)
            final = np.ones(codes.shape, bool)
            final[:, :-1] = codes[:, 1:] != codes[:, :-1]
            upto = np.where(final, total, 0.0)
            seen = np.maximum.accumulate(upto, 1)
            values = np.where(final, total, 0.0)
            values[:, 1:] -= np.where(final[:, 1:], seen[:, :-1], 0.0)
            norm = np.sqrt((values**2).sum(1, keepdims=True))
            yield rows, np.maximum(codes, 0), (values / np.maximum(norm, 1e-9)).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # one for each subsequence
    bias: float
    slope: float
    offset: float

    def margins(self, data, a, b) -> np.ndarray:
        """The margin of each unit: the largest of its windows."""
        out = np.full(len(a), -np.inf)
        owner, start, end = windows(data, a, b)
        for rows, codes, values in subsequences(data, start, end):
            np.maximum.at(out, owner[rows], (self.weights[codes] * values).sum(1) + self.bias)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))


def _joined(strings: list[bytes]):
    """(bytes, start, end) of strings of at most SPAN letters."""
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(strings), np.uint8), ends - sizes, ends


def _kernel(strings: list[bytes], table: np.ndarray):
    """Kernel of each window with the landmarks whose subsequences table holds."""
    out = np.zeros((len(strings), table.shape[1]), np.float32)
    for rows, codes, values in subsequences(*_joined(strings)):
        for i in range(0, len(rows), 2000):
            r, c, v = rows[i : i + 2000], codes[i : i + 2000], values[i : i + 2000]
            sums = np.zeros((len(r), table.shape[1]), np.float32)
            for j in range(c.shape[1]):
                sums += table[c[:, j]] * v[:, j, None]
            out[r] = sums
    return out


def _table(strings: list[bytes]) -> np.ndarray:
    table = np.zeros((SYMBOLS**3, len(strings)), np.float32)
    for rows, codes, values in subsequences(*_joined(strings)):
        np.add.at(table, (codes, rows[:, None]), values)
    return table


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 50.0):
    """Squared-hinge linear machine by Newton steps; (weights, bias)."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    value = lambda w: 0.5 * (ridge * w * w).sum() + cost * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(30):
        on = y * (x @ w) < 1
        xa = x[on] * (weight[on] * 2 * cost)[:, None]
        gradient = ridge * w + xa.T @ (x[on] @ w - y[on])
        step = np.linalg.solve(np.diag(ridge) + xa.T @ x[on], gradient)
        size, now = 1.0, value(w)
        while size > 1e-4 and value(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-5:
            break
    return w[:-1], w[-1]


def _logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Slope and offset of a logistic curve, with targets softened by the class sizes."""
    up, down = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([f, np.ones_like(f)], 1)
    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * v
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1, 5 / max(1e-9, np.abs(step).max()))
        v = v - step
        if np.abs(step).max() < 1e-8:
            break
    return float(v[0]), float(v[1])


def _blame(bags: list[np.ndarray], kinds: int) -> np.ndarray:
    """How many bags each window is to blame for: a bag's one part is shared by the number of bags that hold each of its windows.

    So the many ordinary words of a text that is repeated don't outweigh the one insult that many texts share.
    """
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    window = np.concatenate(bags)
    part = np.bincount(window, minlength=kinds)[window].astype(float)
    return np.bincount(window, part / np.bincount(owner, part)[owner], minlength=kinds)


def fit_units(texts: list[list[bytes]], labels: list[int], share: float, landmarks: int = LANDMARKS, seed: int = 7) -> Model:
    """Fit on the distinct units of texts; share: that of toxic ones among all labelled texts.

    Long units count as their windows.  See ``fit_bags``.
    """
    cut = [sorted({u[i : i + SPAN] for u in t for i in range(0, max(1, len(u) - SPAN + STEP), STEP)}) for t in texts]
    names = sorted({w for t in cut for w in t})
    number = {w: i for i, w in enumerate(names)}
    return fit_bags(names, [np.array([number[w] for w in t], np.int64) for t in cut], labels, share, landmarks, seed)


def fit_bags(names: list[bytes], texts: list[np.ndarray], labels: list[int], share: float, landmarks: int = LANDMARKS, seed: int = 7) -> Model:
    """Fit on texts that are given as the numbers of their distinct windows in ``names``.

    A window that clean texts share is no candidate for what makes a text toxic, unless it is ``LIFT`` times as frequent in toxic
    ones: then a few clean texts have it by a wrong label.  The first machine learns from the windows with the
    most blame (``_blame``), each next one from the worst window of each toxic text, against a draw of
    clean windows and all that an earlier machine took for toxic.  The round whose curve fits the texts best stays.
    With one class only, or without units, the score is the share everywhere.
    """
    rng = np.random.default_rng(seed)
    flat = Model(np.zeros(SYMBOLS**3, np.float32), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    y = np.array(labels, float)
    counts = lambda kind: np.bincount(
        np.concatenate([np.zeros(0, np.int64), *(t for t, l in zip(texts, labels) if bool(l) == kind)]), minlength=len(names)
    )
    of_toxic, of_clean = counts(True), counts(False)
    clean = np.flatnonzero(of_clean)
    known = LIFT * of_clean * np.maximum(1, y.sum() / max(1, len(y) - y.sum()))  # both in numbers and in shares of texts
    candidate = of_toxic > known
    bags = [b for b in (t[candidate[t]] for t, l in zip(texts, labels) if l) if len(b)]
    if not len(clean) or not bags:
        return flat
    blame = _blame(bags, len(names))
    positive = np.argsort(-blame, kind="stable")[:NEGATIVES]
    positive = positive[blame[positive] > 0]
    strength = blame[positive]
    some_clean = rng.permutation(clean)[:NEGATIVES]
    top = hard = np.zeros(0, np.int64)
    filled = [t for t in texts if len(t)]
    whose, firsts = np.concatenate(filled), np.cumsum([0, *(len(t) for t in filled[:-1])])
    has = np.array([len(t) > 0 for t in texts])
    prior = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    best, least = flat, np.inf
    pick = lambda at: [names[i] for i in at]
    for _ in range(ROUNDS):
        order = np.argsort(-strength, kind="stable")
        marks = positive[order[: landmarks // 2]]
        marks = pick(np.unique(np.concatenate([marks, np.concatenate([top, some_clean])[: landmarks - len(marks)]])))
        table = _table(marks)
        values, vectors = np.linalg.eigh(_kernel(marks, table).astype(np.float64) + 1e-4 * np.eye(len(marks)))
        root = vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T
        negative = np.concatenate([some_clean, hard])
        x = np.concatenate([_kernel(pick(positive), table), _kernel(pick(negative), table)]) @ root.astype(np.float32)
        side = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([strength / strength.sum(), np.full(len(negative), 1 / len(negative))]) * len(bags)
        w, bias = _svm(x, side, weight)
        model = Model((table @ (root @ w)).astype(np.float32), float(bias), 1.0, 0.0)
        margin = model.margins(*_joined(names))
        f = np.full(len(texts), model.bias)
        f[has] = np.maximum.reduceat(margin[whose], firsts)
        model.slope, model.offset = _logistic(f, y, prior)
        p = np.clip(model.probability(f), 1e-9, 1 - 1e-9)
        loss = -(prior * np.where(y > 0, np.log(p), np.log(1 - p))).sum()
        if loss < least:
            best, least = model, loss
        worst = np.array([b[np.argmax(margin[b])] for b in bags])
        positive, times = np.unique(worst, return_counts=True)
        strength = times.astype(float)
        top = clean[np.argsort(-margin[clean], kind="stable")[:HARD]]
        hard = np.concatenate([hard, np.setdiff1d(top, hard)])
    return best


def _distinct_windows(batches):
    hasher = textops.Hasher()
    for batch in batches:
        labels, out = batch.column(1), []
        for _, data, cuts in textops.chunks(batch.column(0)):
            whole, a, b, text, hashes = units(hasher, data, cuts)
            raw = whole.tobytes()
            for t in range(len(cuts) - 1):
                own = np.flatnonzero(text == t)
                names, at = np.unique(hashes[own], return_index=True)
                owner, start, end = windows(whole, a[own[at]], b[own[at]])
                nth = (start - a[own[at]][owner]).astype(np.uint64)
                drawn = np.argsort(textops.mix(names[owner] ^ (textops.ODD + nth)), kind="stable")[:PER_TEXT]
                out.append(sorted({raw[start[i] : end[i]] for i in drawn}))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary())), labels], names=["windows", "label"])


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """Fit on labelled texts: about ``sample`` of each class, drawn by a hash of the id.

    Labels other than 0 and 1 are ignored, and an id with both counts as toxic.  An id counts once,
    however often it is repeated, and a text with PER_TEXT windows at most.  The
    sample's windows (SPAN bytes each) come to the driver; nothing else does.  Without labels the score is the same everywhere.
    """
    small_batches(docs.sparkSession)
    marked = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("l_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("fit"), "l_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = marked.where(
        draw < F.when(F.col("label") == 1, sample / max(1, sizes.get(1, 0))).otherwise(sample / max(1, sizes.get(0, 0)))
    )
    rows = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).cast("string").alias("text"))
    got = (
        rows.join(F.broadcast(drawn), F.col("d_id") == F.col("l_id"))  # about 2 * sample rows at any size
        .groupBy("d_id")
        .agg(F.min(F.struct("text", "label")).alias("one"))
        .select("one.text", "one.label")
        .mapInArrow(_distinct_windows, "windows array<binary>, label int")
        .toArrow()
    )
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    listed = got.column("windows").combine_chunks()
    coded = listed.flatten().dictionary_encode()
    place = np.argsort(np.array(coded.dictionary.to_pylist(), object), kind="stable")
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    numbers = rank[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int64)
    bags = np.split(numbers, np.cumsum(listed.value_lengths().to_numpy())[:-1]) if len(listed) else []
    y = got.column("label").to_pylist()
    order = sorted(range(len(bags)), key=lambda i: (y[i], bags[i].tobytes()))  # the order in which rows arrive doesn't matter
    return fit_bags(coded.dictionary.take(pa.array(place)).to_pylist(), [bags[i] for i in order], [y[i] for i in order], share)


class Scorer:
    """Scores of whole texts in a task; keeps the margins of units it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.hasher, self.kept = model, textops.Hasher(), {}

    def scores(self, texts: pa.Array) -> np.ndarray:
        worst = [self._worst(data, cuts) for _, data, cuts in textops.chunks(texts)]
        return self.model.probability(np.concatenate([np.zeros(0), *worst]))

    def _worst(self, data, cuts) -> np.ndarray:
        if len(self.kept) > KEPT:
            self.kept.clear()
        whole, a, b, text, hashes = units(self.hasher, data, cuts)
        names, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        listed = names.tolist()
        new = np.array([i for i, h in enumerate(listed) if h not in self.kept], np.int64)
        if len(new):
            margins = self.model.margins(whole, a[at[new]], b[at[new]])
            self.kept.update(zip((listed[i] for i in new), margins.tolist()))
        each = np.fromiter((self.kept[h] for h in listed), np.float64, len(listed))[back]
        top = np.full(len(cuts) - 1, -np.inf)
        np.maximum.at(top, text, each)
        return np.where(np.isfinite(top), top, self.model.bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted.

    Whole texts are scored, of any length.  A null, empty or wordless text has the score of the
    machine's bias alone.  Repeated rows repeat their answer.  An empty table gives an empty
    result.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def judge(batches):
        scorer = Scorer(model)
        for batch in batches:
            p = scorer.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "score", "predicted"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(judge, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def held_out(id_: str | Column, parts: int = 4, part: int = 2) -> Column:
    """Whether an id is kept from training; a null id is not."""
    id_ = F.col(id_) if isinstance(id_, str) else id_
    return F.coalesce(F.crc32(id_.cast("string")) % parts == part, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose own text is not rejected, with all columns and repeats.

    Learns from the labels of ids that are not held out.  Rows are judged where they
    lie: nothing is joined or moved.  Nulls and empty texts: as in ``score``; an empty table gives an
    empty result, and other columns may have any name.
    """
    model = fit(docs, labels.where(~held_out(id_col)), id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def keep(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(keep, docs.schema)
