"""Toxic passages as maximal scoring segments over token log-odds.

A word's tokens are the word and its prefixes of a few lengths.  Training
counts, per token, the labelled documents of either class that hold it.  A
token's score is its log-odds ratio with an informative Dirichlet prior in
proportion to its frequency in both classes; tokens whose ratio differs
significantly from none, to either side and by a factor of e at least, form the table, which the labelled
sample bounds.  A word scores as its longest token in the table, those typical
of clean texts below nought, and every other word costs a constant drift.  A
linear scan (Ruzzo and Tompa's) finds all maximal scoring segments of a text.
Under clean text the greatest segment score follows an extreme-value law; with
its two constants each segment gets an expectation, and the evidence of the
segments beyond chance, summed, is calibrated to a probability.  Drift,
constants and calibration come from a fifth of the labelled texts, which the
table doesn't see (from all where a class has fewer than ``LEAST_APART`` there).

Null texts, empty texts and texts without a scored word have no segments and
the probability of no evidence.  Labels that are null, and labelled ids that
are missing from the documents, are left out; of several labels of an id the
greater counts.  Repeated rows each get their row; a null id is that of the
empty text.  Other columns are ignored.
Without labelled rows of both classes every text has the same score below one half.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T
from .store import map_rows, parallelism, settle

#: Labelled documents learnt from at most, the least by a hash of their id (12 bytes each are broadcast).
TRAIN_ROWS = 200_000
#: A token's least z, log-odds ratio (to either side) and documents that hold it; texts of each class that calibrate apart from the table's.
#: Significant odds below a factor of e are the frequent words' of longer texts: with them 356 of 427 held-out toxic texts of the 0.1 GB input are found and 39 of 3634 clean ones hit, without them 427 and 1.
LEAST_Z, LEAST_ODDS, LEAST_DOCS, LEAST_APART = 4.0, 1.0, 5, 20
#: Words of the shingle by which near copies are told, and the share of both texts' shingles that they have in common.
SHINGLE, SIMILAR = 5, 0.8
#: Bytes of text that a task takes up and hands on at once; distinct words of a class whose counts it holds, and rows of those that it hands on at once.
PIECE_BYTES, HELD_WORDS, COUNT_ROWS = 500_000, 1 << 20, 1 << 16
#: Steps of the histogram of word scores.
STEPS = 50
#: Lengths of the prefixes, in bytes.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Weight of the Dirichlet prior, in documents.
PRIOR = 50.0
EULER = 0.5772156649


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = 0.05
    lam: float = 1.0
    log_k: float = 0.0
    intercept: float = -3.0
    slope: float = 1.0

    def __post_init__(self):
        #: Whether any table word has these 20 high bits: most tokens are told by one look.
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.words >> np.uint64(44)).astype(np.int64)] = True

    def word_scores(self, tokens: list[np.ndarray]) -> np.ndarray:
        """Each word's score: that of its longest token in the table (``tokens``: words, then prefixes by rising length), less than none the drift."""
        out = np.full(len(tokens[0]), -self.drift)
        if not len(self.words):
            return out
        left = None
        for h in (tokens[0], *tokens[:0:-1]):
            word = np.flatnonzero(self.sieve[h >> np.uint64(44)] if left is None else left & self.sieve[h >> np.uint64(44)])
            at = np.searchsorted(self.words, h[word])
            at[at == len(self.words)] = 0
            found = self.words[at] == h[word]
            if left is None:
                left = np.ones(len(h), bool)
            out[word[found]] = self.scores[at[found]]
            left[word[found]] = False
        return out

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Sum, over segments beyond chance, of minus the log of how many such a clean text of n words is expected to have."""
        return sum(max(0.0, self.lam * s - self.log_k - np.log(n)) for _, _, s in segments)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.asarray(evidence, float))))


def scan(at: list[int], before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word + 1, score), by the words of positive score and the text's total score before and after each; linear time."""
    held: list[tuple[int, int, float, float]] = []  # first, last + 1, total before it, total after it
    for p, low, high in zip(at, before, after):
        seg = (p, p + 1, low, high)
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= seg[2]:
                j -= 1
            if j < 0 or held[j][3] >= seg[3]:
                held.append(seg)
                break
            seg = (held[j][0], seg[1], held[j][2], seg[3])
            del held[j:]
    return [(a, z, r - l) for a, z, l, r in held]


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """The maximal scoring segments of a text by the scores of all its words."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    at = np.flatnonzero(score > 0)
    return scan(at.tolist(), total[at].tolist(), total[at + 1].tolist())


def _pieces(batches, at: int = 0):
    """Batches of about ``PIECE_BYTES`` of the texts in column ``at``, or of one longer text, so that no task holds more, whatever rows a batch has."""
    for batch in batches:
        for a, z, _, _ in T.text_slices(batch.column(at), PIECE_BYTES):
            yield batch.slice(a, z - a)


def _segments(column, model: Model):
    """(segments, number of words) of every text."""
    for _, _, data, offsets in T.text_slices(column):
        starts, ends, first = T.words(data, offsets)
        score = model.word_scores(T.word_and_prefix_hashes(data, starts, ends, PREFIXES))
        total = np.concatenate([[0.0], np.cumsum(score)])
        at = np.flatnonzero(score > 0)
        rows = np.searchsorted(at, first).tolist()
        before, after = total[at].tolist(), total[at + 1].tolist()
        place, words = at.tolist(), first.tolist()
        for i in range(len(offsets) - 1):
            a, z = rows[i], rows[i + 1]
            yield (scan([p - words[i] for p in place[a:z]], before[a:z], after[a:z]) if a < z else []), words[i + 1] - words[i]


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether an id is held out of training (none counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _first_copies(texts: pa.Array) -> list[int]:
    """The places of the texts that none before them is a copy of: ``SIMILAR`` of the shingles of both in common.

    A place list per shingle finds how many each kept text shares.
    """
    places: dict[int, list[int]] = {}
    sizes: list[int] = []
    keep = []
    for i, held in enumerate(s for _, _, data, offsets in T.text_slices(texts) for s in T.shingle_sets(data, offsets, SHINGLE)):
        shingles = held.tolist()
        near = np.fromiter(itertools.chain.from_iterable(map(places.get, shingles, itertools.repeat(()))), np.int64)
        if len(near):
            shared = np.bincount(near, minlength=len(sizes))
            if (shared >= SIMILAR * (np.array(sizes) + len(shingles) - shared)).any():
                continue
        elif not shingles and 0 in sizes:
            continue
        for s in shingles:
            places.setdefault(s, []).append(len(sizes))
        sizes.append(len(shingles))
        keep.append(i)
    return keep


def _without_copies(batches):
    """Of rows (h, y, id, text), sorted, those that aren't copies of one before them with the same h and y; most are alone with theirs."""
    held: list[pa.RecordBatch] = []
    key = lambda rows, i: (rows.column(0)[i].as_py(), rows.column(1)[i].as_py())
    for batch in itertools.chain(_pieces(batches, 3), [None]):
        if batch is not None and held and key(held[0], 0) == key(batch, -1):  # the run goes on
            held.append(batch)
            continue
        rows = pa.Table.from_batches([*held, *([batch] if batch is not None else [])]).combine_chunks().to_batches() if held or batch is not None else []
        rows, held = (rows[0] if rows else None), []
        if rows is None:
            continue
        h, y = (rows.column(k).to_numpy() for k in (0, 1))
        cut = np.append(0, np.flatnonzero((h[1:] != h[:-1]) | (y[1:] != y[:-1])) + 1)
        if batch is not None:  # the last run may go on
            held = [rows.slice(int(cut[-1]))]
            rows, cut = rows.slice(0, int(cut[-1])), cut[:-1]
        if not rows.num_rows:
            continue
        size = np.diff(np.append(cut, rows.num_rows))
        keep = [cut[size == 1]]
        for a, n in zip(cut[size > 1].tolist(), size[size > 1].tolist()):
            keep.append(a + np.array(_first_copies(rows.column(3).slice(a, n)), np.int64))
        take = pa.array(np.sort(np.concatenate(keep)))
        yield pa.RecordBatch.from_arrays([rows.column(k).take(take) for k in (0, 1, 3)], names=["h", "y", "text"])


def _text_counts(batches):
    """Of rows (text, y), how many texts of each class (1 or 0) hold a token: word, k, n, summed over the task's texts as far as ``HELD_WORDS`` reach."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new, held = ([], []), [none, none]

    def merge(k: int) -> None:
        if new[k]:
            w, n = np.unique(np.concatenate(new[k]), return_counts=True)
            new[k].clear()
            w, n = np.concatenate([held[k][0], w]), np.concatenate([held[k][1], n])
            order = np.argsort(w, kind="stable")
            w, n = w[order], n[order]
            start = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            held[k] = w[start], np.add.reduceat(n, start)

    def rows(k: int):
        (w, n), held[k] = held[k], none
        for a in range(0, len(w), COUNT_ROWS):
            part = w[a : a + COUNT_ROWS].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), k)), pa.array(n[a : a + COUNT_ROWS])], names=["word", "k", "n"])

    for batch in _pieces(batches):
        y = batch.column(1).to_numpy(zero_copy_only=False)
        row = 0
        for _, _, data, offsets in T.text_slices(batch.column(0)):
            starts, ends, first = T.words(data, offsets)
            h = np.stack(T.word_and_prefix_hashes(data, starts, ends, PREFIXES))
            for i in range(len(offsets) - 1):
                new[int(y[row] > 0)].append(np.unique(h[:, first[i] : first[i + 1]]))
                row += 1
        for k in (0, 1):
            if sum(map(len, new[k])) > HELD_WORDS // 2:
                merge(k)
            if len(held[k][0]) > HELD_WORDS:
                yield from rows(k)
    for k in (0, 1):
        merge(k)
        yield from rows(k)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows outside the held-out fold (at most ``TRAIN_ROWS``, by hash)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    # Copies and near copies of a text say no more than one of them.
    def sketch(batches):
        for batch in _pieces(batches):
            least = [int(s[:1].view(np.int64)[0]) if len(s) else 0 for _, _, data, offsets in T.text_slices(batch.column(0)) for s in T.shingle_sets(data, offsets, SHINGLE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["text", "y", "id", "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"), (F.col("y") > 0).cast("int").alias("y"), "id").mapInArrow(sketch, f"text string, y int, id {kind}, h bigint")
    texts = texts.select("h", "y", "id", "text").repartition(parallelism(docs.sparkSession), "h", "y").sortWithinPartitions("h", "y", "id", "text").mapInArrow(_without_copies, "h bigint, y int, text string")
    texts = settle(texts.select("text", "y", (F.pmod(F.xxhash64("h", F.lit(5)), F.lit(5)) == 0).alias("apart")), "labelled")

    size = {(r[0] > 0, r[1]): r[2] for r in texts.groupBy("y", "apart").count().collect()}
    if not all(any(size.get((k, x)) for x in (True, False)) for k in (True, False)):
        return Model()
    apart = all(size.get((k, True), 0) >= LEAST_APART and size.get((k, False)) for k in (True, False))
    n1, n0 = (float(size.get((k, False), 0) + (0 if apart else size.get((k, True), 0))) for k in (True, False))
    seen, rest = (texts.where("not apart"), texts.where("apart")) if apart else (texts, texts)
    counts = seen.select("text", "y").mapInArrow(_text_counts, "word bigint, k bigint, n bigint").groupBy("word").agg(
        F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).alias("y0")
    )
    rate = (F.col("y1") + F.col("y0")) / (n1 + n0)
    a = F.lit(PRIOR) * rate
    odds = lambda y, n: F.log((y + a) / (F.lit(n + PRIOR) - y - a + F.lit(0.5)))
    delta = odds(F.col("y1"), n1) - odds(F.col("y0"), n0)
    z = delta / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    rows = counts.where(F.col("y1") + F.col("y0") >= LEAST_DOCS).select("word", delta.alias("delta"), z.alias("z")).where((F.abs("z") >= LEAST_Z) & (F.abs("delta") >= LEAST_ODDS)).toPandas()
    if not len(rows):
        return Model()
    words = rows["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    model = Model(words[order], rows["delta"].to_numpy(float)[order])
    _calibrate(model, rest.select("text", "y"))
    return model


def _calibrate(model: Model, texts: DataFrame) -> None:
    """Drift, extreme-value constants and the logistic map, from sums and histograms of bounded size."""

    def shares(batches):
        cells: dict[tuple[int, int], int] = {}
        for batch in _pieces(batches):
            y = batch.column(1).to_numpy(zero_copy_only=False)
            row = 0
            for _, _, data, offsets in T.text_slices(batch.column(0)):
                starts, ends, first = T.words(data, offsets)
                step = np.round(model.word_scores(T.word_and_prefix_hashes(data, starts, ends, PREFIXES)) * STEPS).astype(np.int64)
                kind = np.repeat(y[row : row + len(offsets) - 1] > 0, np.diff(first))
                row += len(offsets) - 1
                for k in (0, 1):
                    for c, n in zip(*(x.tolist() for x in np.unique(step[kind == k], return_counts=True))):
                        cells[k, c] = cells.get((k, c), 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.int64()), pa.array(list(cells.values()), pa.float64())], names=["k", "c", "n"])

    # First with a drift of nought: the words without a token then score nought.
    model.drift = 0.0
    rows = texts.mapInArrow(shares, "k bigint, c bigint, n double").groupBy("k", "c").agg(F.sum("n").alias("n")).toPandas().sort_values(["k", "c"])
    s = rows["c"].to_numpy(float) / STEPS
    n = np.stack([np.where(rows["k"] == k, rows["n"], 0.0) for k in (0, 1)])
    p = n / np.maximum(n.sum(1, keepdims=True), 1)
    toxic = min(p[1][s > 0].sum(), 0.9)
    none = max(p[0][s == 0].sum(), 1e-9)
    # Clean text must lose by and large.
    model.drift = float(min(5.0, max(min(0.5, max(1e-3, -np.log1p(-toxic))), 2 * (p[0] * s).sum() / none)))
    # Karlin and Altschul's lambda: the root of sum p exp(lambda s) = 1 over clean words.
    p, s = p[0], np.where(s == 0, -model.drift, s)
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * s, 500))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 500))).sum() < 1 else (low, mid)
    model.lam = float(high)

    def best(batches):
        out = np.zeros(2)
        for batch in _pieces(batches):
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for row, (segments, n) in enumerate(_segments(batch.column(0), model)):
                if segments and not y[row]:
                    out += (model.lam * max(x[2] for x in segments) - np.log(n), 1)
        yield pa.RecordBatch.from_arrays([pa.array(out[:1]), pa.array(out[1:])], names=["total", "n"])

    total, n = texts.mapInArrow(best, "total double, n double").agg(F.sum("total"), F.sum("n")).first()
    model.log_k = round(float((total or 0.0) / n - EULER), 9) if n else 0.0  # the sum's last bits depend on the partitions
    cells = 256

    def histogram(batches):
        out = np.zeros((2, cells))
        for batch in _pieces(batches):
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for row, (segments, n) in enumerate(_segments(batch.column(0), model)):
                e = model.evidence(segments, max(n, 1))
                out[int(y[row] > 0), min(cells - 1, int(np.log1p(e) * 32))] += 1
        k, c = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(out[k, c])], names=["k", "c", "n"])

    seen = np.zeros((2, cells))
    for r in texts.mapInArrow(histogram, "k bigint, c bigint, n double").groupBy("k", "c").agg(F.sum("n")).collect():
        seen[r[0], r[1]] = r[2]
    x = np.expm1((np.arange(cells) + 0.5 * (np.arange(cells) > 0)) / 32)
    w = np.zeros(2)
    for _ in range(50):  # Newton's steps for the logistic map, with a light ridge
        q = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        n = seen.sum(0)
        grad = np.array([(seen[1] - n * q).sum(), ((seen[1] - n * q) * x).sum()]) - 1e-2 * w
        v = n * q * (1 - q)
        hess = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 2.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    model.intercept, model.slope = float(w[0]), float(max(w[1], 0.0))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), predicted (1 from 0.5 on), and segments beyond chance as (start, end, score, expected)."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches):
        m = held.value
        for batch in _pieces(batches, 1):
            evidence, found = [], []
            for segments, n in _segments(batch.column(1), m):
                evidence.append(m.evidence(segments, max(n, 1)))
                expected = [float(np.exp(min(700.0, m.log_k + np.log(n) - m.lam * s))) for _, _, s in segments]
                found.append([{"start": a, "end": z, "score": s, "expected": e} for (a, z, s), e in zip(segments, expected) if e < 1])
            score = m.probability(np.array(evidence))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(found, pa.list_(item))],
                names=[id_col, "score", "predicted", "segments"],
            )

    schema = f"`{id_col}` {kind}, score double, predicted int, segments array<struct<start:bigint,end:bigint,score:double,expected:double>>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts score below one half."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = held.value
        for batch in _pieces(batches, at):
            evidence = [m.evidence(segments, max(n, 1)) for segments, n in _segments(batch.column(at), m)]
            yield batch.filter(pa.array(m.probability(np.array(evidence)) < 0.5))

    return map_rows(docs, run, docs.schema)
