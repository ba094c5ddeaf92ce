"""Alignment of two tokenizers' outputs over the same bytes, by skipping along diagonals.

Both encodings of a text are arrays of byte ends.  At a shift (the difference of
the two indices) a window of both arrays is compared, and doubles as long as all
of it is equal: one token stands for one token there, and the whole stretch is
jumped.  At the first difference the irregular group is resolved by steps of the
array whose end comes first, until both meet again; that sets the new shift.
Texts lie one after another, so text ends are common ends; long texts are
entered at further common ends, and all these lanes proceed side by side in numpy.

A step, and a place of an equal stretch, is a link: a token of each whose bytes
overlap.  Links are counted per pair of ids over all texts: a task keeps the
distinct pairs of a block of texts, Spark adds up the blocks' counts, and each
block gets the counts of its own pairs back.  Rows between tasks are distinct
pairs per block and distinct pairs per text, never single links; a pair has at
most one row a block, so frequent pairs make no large group.  Only the highest
count per id of the second vocabulary, whose size bounds it, is broadcast.

Null and empty texts, and texts whose tokens don't spell them (with a space in
front), have no tokens, zeros and an empty digest.  Special tokens' strings in a
text are plain text.  Repeated rows are counted and returned each, whatever their
ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import byte_alphabet, split_texts
from .packing import ByteBpe
from .store import settle

#: Tokens of a lane, the first window of a probe, links of a block, and pairs in a row of a block.
LANE, PROBE, LINKS, PAIRS = 256, 8, 8_000_000, 65_536
#: Characters of texts that are aligned at once, and lanes' tokens tried for a common end.
SLICE, TRIES = 1_000_000, 16
MARK = "▁"


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices from each start on, so many each, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _lanes(a: np.ndarray, b: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at which both arrays can be entered: behind a common end, about every ``lane`` tokens."""
    at = np.arange(lane, len(a) - TRIES, lane)[:, None] + np.arange(TRIES)
    to = np.minimum(np.searchsorted(b, a[at]), len(b) - 1)
    hit = b[to] == a[at]
    row = np.flatnonzero(hit.any(1))
    first = hit[row].argmax(1)
    i, k = np.unique(at[row, first] + 1, return_index=True)
    return np.append(0, i), np.append(0, to[row, first][k] + 1)


def align(a: np.ndarray, b: np.ndarray, lane: int = LANE, probe: int = PROBE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (indices into each array of rising ends; the last ends are equal), and which tokens of each close a group."""
    close_a, close_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(a):
        return links_a[0], links_b[0], close_a, close_b
    i, j = _lanes(a, b, lane)
    end_i, end_j = np.append(i[1:], len(a)), np.append(j[1:], len(b))
    width = np.full(len(i), probe)
    while len(i):
        size = np.minimum(width, np.minimum(end_i - i, end_j - j))
        at, shift = ragged(i, size), np.repeat(j - i, size)
        off = np.cumsum(size) - size
        place = np.arange(len(at)) - np.repeat(off, size)
        whole_size = np.repeat(size, size)
        run = np.minimum.reduceat(np.where(a[at] == b[at + shift], whole_size, place), off)
        equal = place < np.repeat(run, size)
        one, two = at[equal], (at + shift)[equal]
        links_a.append(one)
        links_b.append(two)
        close_a[one] = close_b[two] = True
        i, j = i + run, j + run
        whole = run == size
        width = np.where(whole, width * 2, probe)
        k = np.flatnonzero(~whole)
        x, y = i[k], j[k]
        while len(k):
            links_a.append(x)
            links_b.append(y)
            left, right = a[x], b[y]
            met = left == right
            if met.any():
                close_a[x[met]] = close_b[y[met]] = True
                i[k[met]], j[k[met]] = x[met] + 1, y[met] + 1
                k, x, y, left, right = k[~met], x[~met], y[~met], left[~met], right[~met]
            x, y = x + (left < right), y + (right < left)
        live = i < end_i
        if not live.all():
            i, j, end_i, end_j, width = i[live], j[live], end_i[live], end_j[live], width[live]
    return np.concatenate(links_a), np.concatenate(links_b), close_a, close_b


def byte_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, where each starts, and its length."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


class TokenPair:
    """A byte-level BPE and a piece model with byte fallback, which puts the space in front by itself."""

    def __init__(self, path: str, ranks_path: str, piece_path: str):
        import sentencepiece

        self.first = ByteBpe(path, ranks_path)
        self.first.library.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = self.first.library.get_vocab()
        tokens = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            tokens[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_a = byte_table(tokens)
        pieces = [self.second.id_to_piece(k) for k in range(self.second.vocab_size())]
        self.bytes_b = byte_table([bytes([int(p[3:5], 16)]) if self.second.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)])
        self.digits = len(str(max(len(tokens), len(pieces))))
        self.decimal = np.zeros((max(len(tokens), len(pieces)), self.digits + 1), np.uint8)
        self.decimal_size = np.zeros(len(self.decimal), np.int64)
        for k in range(len(self.decimal)):
            s = str(k).encode()
            self.decimal[k, : len(s)] = list(s)
            self.decimal_size[k] = len(s)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = []
        for t in texts:
            # Bytes from 0xC9 on start characters from U+0240 on, whose classes depend on the library's Unicode data.
            fast = t.isascii() or max(t.encode()) < 0xC9
            ids = self.first.fast.encode_ordinary(" " + t) if fast else self.first.library.encode(" " + t, add_special_tokens=False).ids
            a.append(np.array(ids, np.int64))
        return a, [np.array(ids, np.int64) for ids in self.second.encode(texts, num_threads=1)]

    def group_digests(self, ids_a, ids_b, close_a, close_b, tokens_a, tokens_b) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` per text, of which ``tokens_a`` and ``tokens_b`` tell the numbers of tokens."""
        group_a, group_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
        own_a, own_b = np.bincount(group_a), np.bincount(group_b)
        place_a = np.arange(len(ids_a)) + (np.cumsum(own_b) - own_b)[group_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(own_a)[group_b]
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        ids[place_a], ids[place_b] = ids_a, ids_b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[place_a[close_a]], mark[place_b[close_b]] = ord("|"), ord(";")
        rows, size = self.decimal[ids], self.decimal_size[ids]
        rows[np.arange(len(ids)), size] = mark
        flat = rows[np.arange(self.digits + 1) <= size[:, None]]
        ends = np.append(0, np.cumsum(size + 1))[np.append(0, np.cumsum(tokens_a + tokens_b))]
        return [hashlib.sha256(flat[s : e - 1]).hexdigest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _spells(ids: list[np.ndarray], table: tuple[np.ndarray, np.ndarray, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Whether each text's tokens, joined, are its bytes."""
    data, start, size = table
    flat = np.concatenate(ids)
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    length = np.bincount(row, size[flat], len(ids)).astype(np.int64)
    ok = length == [len(t) for t in texts]
    if not ok.all():
        flat, texts = np.concatenate([x for x, k in zip(ids, ok) if k] or [flat[:0]]), [t for t, k in zip(texts, ok) if k]
        length = length[ok]
    if len(flat):
        wrong = data[ragged(start[flat], size[flat])] != np.frombuffer(b"".join(texts), np.uint8)
        ok[np.flatnonzero(ok)[np.add.reduceat(wrong, np.cumsum(length) - length) > 0]] = False
    return ok


class Block:
    """Texts whose links are looked up together."""

    def __init__(self, number: int):
        self.number, self.links, self.parts = number, 0, []

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.concatenate([p["pairs"] for p in self.parts]))
        n = np.zeros(len(pairs), np.int64)
        for p in self.parts:
            at = np.searchsorted(pairs, p["pairs"])
            n[at] += p["n"]
            cut = np.searchsorted(p["doc"], np.arange(len(p["ids"]) + 1))
            gap = np.diff(at[p["local"]], prepend=0)
            first = cut[:-1][cut[:-1] < cut[1:]]
            gap[first] = at[p["local"][first]]
            arrays = [pa.array(np.full(len(p["ids"]), self.number)), p["ids"], *(pa.array(c) for c in p["counts"]), pa.array(p["digests"], pa.string())]
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, pa.int32())) for v in (gap, p["times"])]
            nothing = [pa.nulls(len(p["ids"]), schema.field(k).type) for k in ("pairs", "pair_n")]
            yield pa.RecordBatch.from_arrays([*arrays, *lists, *nothing], schema=schema)
        for k in range(0, len(pairs), PAIRS):
            nothing = [pa.nulls(1, f.type) for f in list(schema)[1:-2]]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (pairs[k : k + PAIRS], n[k : k + PAIRS])]
            yield pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), *nothing, *lists], schema=schema)


def _linked(model: TokenPair, ids: pa.Array, texts: list[str]) -> dict:
    """Counts, digest and distinct pairs of each text."""
    n = len(texts)
    data = [(" " + t).encode() if t else b"" for t in texts]
    a, b = model.encode(texts)
    spelt = _spells(a, model.bytes_a, data) & _spells(b, model.bytes_b, data) & np.fromiter(map(bool, texts), bool, n)
    a, b = [x if k else x[:0] for x, k in zip(a, spelt)], [x if k else x[:0] for x, k in zip(b, spelt)]
    tokens_a, tokens_b = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    ids_a, ids_b = np.concatenate(a), np.concatenate(b)
    link_a, link_b, close_a, close_b = align(np.cumsum(model.bytes_a[2][ids_a]), np.cumsum(model.bytes_b[2][ids_b]))
    doc = np.repeat(np.arange(n), tokens_a)
    pairs, local = np.unique(ids_a[link_a] << 32 | ids_b[link_b], return_inverse=True)
    link_doc = doc[link_a]
    own, times = np.unique(link_doc * max(len(pairs), 1) + local, return_counts=True)
    digests = iter(model.group_digests(ids_a, ids_b, close_a, close_b, tokens_a[spelt], tokens_b[spelt])) if spelt.any() else iter(())
    return {
        "ids": ids, "pairs": pairs, "n": np.bincount(local, minlength=len(pairs)), "doc": own // max(len(pairs), 1), "local": own % max(len(pairs), 1), "times": times,
        "counts": [tokens_a, tokens_b, np.bincount(doc[close_a], minlength=n), np.bincount(link_doc, minlength=n)],
        "digests": [next(digests) if k else "" for k in spelt.tolist()],
    }


def align_tokens(docs: DataFrame, path: str, ranks_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", block_links: int = LINKS) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of links of all texts that hold it; ``n_best``
    counts a text's links whose count is the highest of their second id, and
    ``count_sum`` adds up the counts of its links.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"block bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string, place array<int>, times array<int>, pairs array<bigint>, pair_n array<bigint>"

    def run(batches):
        from pyspark import TaskContext

        model, number, block = TokenPair(path, ranks_path, piece_path), TaskContext.get().partitionId() << 32, None
        for batch in batches:
            done = 0
            held = pa.schema([("block", pa.int64()), ("id", batch.column(0).type), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("sha", pa.string()), ("place", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("pair_n", pa.list_(pa.int64()))])
            for texts in split_texts([t or "" for t in batch.column(1).to_pylist()], SLICE):
                part = _linked(model, batch.column(0).slice(done, len(texts)), texts)
                done += len(texts)
                block = block or Block(number)
                block.parts.append(part)
                block.links += int(part["counts"][3].sum())
                if block.links >= block_links:
                    yield from block.rows(held)
                    block, number = None, number + 1
        if block:
            yield from block.rows(held)

    rows = settle(docs.select(id_col, text_col).mapInArrow(run, schema), "aligned")
    pairs = rows.where("pairs is not null").select("block", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("pair_n").alias("n"))))
    counted = settle(pairs.select("block", "pair", F.sum("n").over(Window.partitionBy("pair")).alias("count")), "pairs")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("second")
    highest = counted.groupBy(second).agg(F.max("count").alias("highest"))
    known = counted.withColumn("second", second).join(F.broadcast(highest), "second").select("block", "pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    texts = rows.where("pairs is null").drop("pairs", "pair_n")
    out = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_looked_up, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _looked_up(texts: pa.Table, known: pa.Table) -> pa.Table:
    """The sums of each text of a block over its pairs' counts."""
    order = np.argsort(known.column("pair").to_numpy())
    count, best = known.column("count").to_numpy()[order], known.column("best").to_numpy()[order].astype(np.int64)
    place, times = (texts.column(c).combine_chunks() for c in ("place", "times"))
    size = place.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at, times = place.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
    off = np.cumsum(size) - size
    total = np.cumsum(at)
    before = np.where(off > 0, total[np.maximum(off, 1) - 1], 0) if len(total) else off
    at = total - np.repeat(before, size)
    doc = np.repeat(np.arange(len(size)), size)
    sums = [np.zeros(len(size), np.int64) for _ in range(2)]
    np.add.at(sums[0], doc, times * best[at])
    np.add.at(sums[1], doc, times * count[at])
    return pa.table([*(texts.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), texts.column("sha")], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
