"""An n-gram language model by deleted interpolation.

Words are lower-cased (A-Z) runs without white space; every text ends in one end
token.  Training documents outside a deleted fold are counted; the fold's tokens,
under those counts, give the weights by expectation-maximisation: a weight per
order (order 0 is uniform over the known words and one unknown) and per bucket of
the longest context's frequency.  Scores use the counts of all training documents.

Counting is dealt out by gram.  A task cuts its documents into blocks and sends
each block's distinct grams, sorted, to shards by hash range.  A shard adds up
all blocks' counts and answers every block with the totals of the grams it sent,
in their order, so a frequent gram is one row per block and no table is held
whole.  The blocks' tokens meet the answers, and the tokens' counts are written
once; weights and scores are narrow passes over them.  The blocks are cut twice,
from the same plan of ``docs``; should a plan not give the same rows twice, the
answers don't meet their blocks and the job fails rather than scores wrong.

Null and empty texts hold the end token only.  Repeated rows each count and each
get a row.  Ids may repeat, be null (the empty string's remainder then counts)
or be of any type that casts to text and back.
Without training tokens every probability is uniform.  Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from . import text as T
from .groups import by_group, sorted_groups
from .store import parallelism, settle

#: Bytes of text in a block, characters of text that a shard counts (about 2 million grams), and those whose grams or blocks a task meets.
BLOCK_BYTES, SHARD_CHARS, TASK_CHARS = 8_000_000, 16_000_000, 4_000_000
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Buckets of the context's frequency: 0, 1, 2, 3-4, 5-8 and so on, the last without end.
BUCKETS = 24
#: Steps per octave of the probabilities' histogram, and the rounds of expectation-maximisation.
STEPS, ROUNDS = 4, 40
START, END = (np.uint64(x) for x in T.mix64(np.array([11, 13], np.uint64)))


def pack(a: np.ndarray) -> bytes:
    """Integers as byte planes, which compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.zeros(1, a.dtype)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def fold_of(doc_id) -> int:
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % FOLDS


class Block:
    """Some documents' tokens."""

    def __init__(self, ids: list, tokens: np.ndarray, first: np.ndarray):
        self.ids, self.tokens, self.first = ids, tokens, first
        self.folds = np.array([fold_of(i) for i in ids], np.int64)
        named = zlib.crc32("\n".join(map(str, ids)).encode())
        self.key = int((T.mix64(tokens + np.arange(len(tokens), dtype=np.uint64)).sum(dtype=np.uint64) ^ np.uint64(named << 20)).view(np.int64))

    def grams(self, order: int) -> np.ndarray:
        """Each token's gram: it and the ``order - 1`` before it, starts standing for those before the text."""
        out = self.tokens
        past = self.tokens
        for _ in range(order - 1):
            past = np.concatenate([[START], past[:-1]])
            past[self.first[:-1]] = START
            out = T.mix64(out * np.uint64(0x9FB21C651E98DF25) + past)
        return out


def _blocks(batches):
    """The blocks of a partition of (id, text)."""
    ids, tokens, size, held = [], [], [], 0
    for batch in batches:
        names = batch.column(0).to_pylist()
        for a, z, data, offsets in T.text_slices(batch.column(1)):
            if ids and held + len(data) > BLOCK_BYTES:
                yield Block(ids, np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(size))]))
                ids, tokens, size, held = [], [], [], 0
            starts, ends, first = T.words(data, offsets)
            n = z - a
            out = np.full(len(starts) + n, END, np.uint64)
            out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))] = T.word_hashes(data, starts, ends)
            ids += names[a:z]
            tokens.append(out)
            size.append(np.diff(first) + 1)
            held += len(data)
    if ids:
        yield Block(ids, np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(size))]))


def _send(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """shard, block, order, grams (sorted), counted and deleted (their counts in the block)."""

    def run(batches):
        for block in _blocks(batches):
            size = np.diff(block.first)
            counted = np.repeat((block.folds != HELD_OUT) & (block.folds != DELETED), size)
            deleted = np.repeat(block.folds == DELETED, size)
            for k in range(1, order + 1):
                grams, back = np.unique(block.grams(k), return_inverse=True)
                a = np.bincount(back[counted], minlength=len(grams)).astype(np.uint32)
                d = np.bincount(back[deleted], minlength=len(grams)).astype(np.uint32)
                shard = (grams >> np.uint64(64 - bits)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                rows = list(zip(cut.tolist(), [*cut[1:].tolist(), len(grams)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[cut] * (order + 1) + k),
                        pa.array(np.full(len(cut), block.key)),
                        pa.array([pack_sorted(grams[i:j]) for i, j in rows], pa.binary()),
                        pa.array([pack(a[i:j]) for i, j in rows], pa.binary()),
                        pa.array([pack(d[i:j]) for i, j in rows], pa.binary()),
                    ],
                    names=["shard", "block", "grams", "counted", "deleted"],
                )

    return docs.mapInArrow(run, "shard bigint, block bigint, grams binary, counted binary, deleted binary")


def _answer(sent: DataFrame, parts: int) -> DataFrame:
    """block, shard, counted, deleted: the totals of the grams that the block sent; known: on a shard's first answer its distinct training grams."""

    def run(batches):
        for group in sorted_groups(batches):
            grams = [unpack_sorted(b) for b in group.column("grams").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
            uniq, back = np.unique(np.concatenate(grams), return_inverse=True)
            total = []
            for name in ("counted", "deleted"):
                own = np.concatenate([unpack(b, np.uint32) for b in group.column(name).to_pylist()])
                total.append(np.bincount(back, weights=own, minlength=len(uniq)).astype(np.uint32))
            known = [int(((total[0] > 0) | (total[1] > 0)).sum()), *[0] * (len(grams) - 1)]
            known_a = [int((total[0] > 0).sum()), *[0] * (len(grams) - 1)]
            parts = [back[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    group.column("block").combine_chunks() if group.column("block").num_chunks == 1 else pa.array(group.column("block").to_pylist()),
                    pa.array(np.full(len(grams), group.column("shard")[0].as_py())),
                    pa.array([pack(total[0][p]) for p in parts], pa.binary()),
                    pa.array([pack(total[1][p]) for p in parts], pa.binary()),
                    pa.array(known),
                    pa.array(known_a),
                ],
                names=["block", "shard", "counted", "deleted", "known", "known_counted"],
            )

    return by_group(sent, run, "block bigint, shard bigint, counted binary, deleted binary, known bigint, known_counted bigint", parts)


def _meet(docs: DataFrame, answers: DataFrame, order: int, parts: int) -> DataFrame:
    """id, fold, n_tokens, and per order the tokens' counts as byte planes: all training documents', and without the deleted fold (that fold's documents only)."""

    def tokens(batches):
        for block in _blocks(batches):
            words, back = np.unique(block.tokens, return_inverse=True)
            ids = json.dumps(block.ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.key]),
                    pa.array([-1], pa.int64()),
                    pa.array([pack_sorted(words)], pa.binary()),
                    pa.array([pack(back.astype(np.uint32))], pa.binary()),
                    pa.array([pack(np.diff(block.first).astype(np.uint32))], pa.binary()),
                    pa.array([ids.encode()], pa.binary()),
                ],
                names=["block", "shard", "a", "b", "c", "d"],
            )

    def run(batches):
        for group in sorted_groups(batches):
            shard = group.column("shard").to_numpy()
            column = {c: group.column(c) for c in "abcd"}
            for copy in range(int((shard < 0).sum())):  # equal blocks share their answers
                if copy == len(shard):
                    raise RuntimeError("the documents' plan gave other rows the second time: write them to a table first")
                ids = json.loads(column["d"][copy].as_py())
                words = unpack_sorted(column["a"][copy].as_py())
                first = np.concatenate([[0], np.cumsum(unpack(column["c"][copy].as_py(), np.uint32).astype(np.int64))])
                block = Block(ids, words[unpack(column["b"][copy].as_py(), np.uint32)], first)
                counts = []
                for k in range(1, order + 1):
                    rows = np.flatnonzero((shard >= 0) & (shard % (order + 1) == k))
                    _, keep = np.unique(shard[rows], return_index=True)
                    counted = np.concatenate([unpack(column["a"][i].as_py(), np.uint32) for i in rows[keep].tolist()] or [np.zeros(0, np.uint32)])
                    deleted = np.concatenate([unpack(column["b"][i].as_py(), np.uint32) for i in rows[keep].tolist()] or [np.zeros(0, np.uint32)])
                    grams, back = np.unique(block.grams(k), return_inverse=True)
                    if len(grams) != len(counted):
                        raise RuntimeError("the documents' plan gave other rows the second time: write them to a table first")
                    counts.append((counted[back], deleted[back]))
                out = [[] for _ in range(5)]
                for i, doc in enumerate(ids):
                    a, z = first[i], first[i + 1]
                    fold = int(block.folds[i])
                    out[0].append(doc)
                    out[1].append(fold)
                    out[2].append(z - a)
                    out[3].append([pack((c[a:z] + d[a:z]).astype(np.uint32)) for c, d in counts])
                    out[4].append([pack(c[a:z].astype(np.uint32)) for c, d in counts] if fold == DELETED else None)
                planes = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64() if kind == "bigint" else pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], planes), pa.array(out[4], planes)],
                    names=["id", "fold", "n_tokens", "counts", "counted"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    sent = docs.mapInArrow(tokens, "block bigint, shard bigint, a binary, b binary, c binary, d binary")
    none = F.lit(None).cast("binary")
    rows = sent.union(answers.select("block", "shard", "counted", "deleted", none, none))
    return settle(by_group(rows, run, f"id {kind}, fold bigint, n_tokens bigint, counts array<binary>, counted array<binary>", parts), "token-counts")


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.ceil(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def estimates(counts: list[np.ndarray], documents: float, tokens: float, words: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of every order (rows; order 0 first), and the longest context's frequency, of one text's tokens."""
    out = [np.full(len(counts[0]), 1 / (words + 1)), counts[0] / max(tokens, 1)]
    context = np.full(len(counts[0]), tokens)
    for k in range(1, len(counts)):
        context = np.concatenate([[documents], counts[k - 1][:-1]]).astype(float)
        out.append(np.divide(counts[k], context, out=np.zeros(len(context)), where=context > 0))
    return np.stack(out), context


def _weights(met: DataFrame, order: int, documents: float, tokens: float, words: float) -> np.ndarray:
    """Weights by bucket and order from the deleted fold's tokens, as a histogram over rounded estimates (of bounded size)."""

    def run(batches):
        cells: dict[tuple, int] = {}
        for batch in batches:
            for planes in batch.column(0).to_pylist():
                p, context = estimates([unpack(b, np.uint32).astype(float) for b in planes], documents, tokens, words)
                level = np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * STEPS), -1).astype(np.int64)
                rows, n = np.unique(np.concatenate([bucket_of(context)[None], level[1:]]), axis=1, return_counts=True)
                for row, count in zip(map(tuple, rows.T.tolist()), n.tolist()):
                    cells[row] = cells.get(row, 0) + count
        yield pa.RecordBatch.from_arrays([pa.array([list(c) for c in cells], pa.list_(pa.int64())), pa.array(list(cells.values()), pa.int64())], names=["cell", "n"])

    rows = met.where("counted is not null").select("counted").mapInArrow(run, "cell array<bigint>, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    if not len(rows):
        return weights
    cells = np.array(rows["cell"].tolist(), np.int64)
    n = rows["n"].to_numpy(float)
    p = np.concatenate([np.full((len(n), 1), 1 / (words + 1)), np.where(cells[:, 1:] >= 0, 2.0 ** (-np.maximum(cells[:, 1:], 0) / STEPS), 0.0)], axis=1)
    at = cells[:, 0]
    for _ in range(ROUNDS):
        part = weights[at] * p
        part *= (n / part.sum(1))[:, None]
        total = np.stack([np.bincount(at, part[:, k], BUCKETS) for k in range(order + 1)], axis=1)
        # A trace of uniform counts keeps every weight of a seen bucket above nought, and gives unseen ones the even mix.
        total += 1e-3
        weights = total / total.sum(1, keepdims=True)
    return weights


def score_documents(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text)."""
    given = docs.schema[id_col].dataType
    kind = "bigint" if isinstance(given, IntegralType) else "string"
    docs = docs.select(F.col(f"`{id_col}`").cast(kind).alias("id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(1, int(max(4 * parallelism(docs.sparkSession), chars / SHARD_CHARS) - 1).bit_length())
    parts = -(-chars // TASK_CHARS)
    answers = settle(_answer(_send(docs, order, bits), parts), "answers")
    words = answers.where(F.col("shard") % (order + 1) == 1).agg(F.sum("known"), F.sum("known_counted")).first()
    met = _meet(docs, answers.select("block", "shard", "counted", "deleted"), order, parts)
    trains = {r[0]: (r[1], r[2]) for r in met.groupBy("fold").agg(F.count("*"), F.sum("n_tokens")).collect()}
    size = lambda folds: tuple(float(sum(trains.get(f, (0, 0))[i] for f in folds)) for i in (0, 1))
    fit = [f for f in range(FOLDS) if f not in (HELD_OUT, DELETED)]
    weights = _weights(met, order, *size(fit), float((words[1] or 0) if words else 0))
    documents, tokens = size([*fit, DELETED])
    vocabulary = float((words[0] or 0) if words else 0)

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for planes in batch.column(3).to_pylist():
                counts = [unpack(b, np.uint32).astype(float) for b in planes]
                p, context = estimates(counts, documents, tokens, vocabulary)
                out[0].append(int((counts[0] > 0).sum()))
                out[1].append(float(np.log10((counts[0] + 1) / (tokens + vocabulary + 1)).sum()))
                out[2].append(float(np.log10((weights[bucket_of(context)].T * p).sum(0)).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.asarray(batch.column(1)) == HELD_OUT), batch.column(2), pa.array(out[0], pa.int64()), pa.array(np.full(batch.num_rows, int(tokens))), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scored = met.select("id", "fold", "n_tokens", "counts").mapInArrow(run, schema)
    return scored.withColumn("id", F.col("id").cast(given)).withColumnRenamed("id", id_col)
