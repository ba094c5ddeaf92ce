"""Repeated passages across and within documents, found by a sparse suffix array.

A passage is ``length`` words (A-Z as a-z, whatever the white space).  Suffixes
are retained only where the k-word gram that starts them is the least of ``w``
neighbouring grams (k + w - 1 = length), so any two occurrences of a passage
retain a suffix that starts with the same gram.

1. The retained suffixes of all texts are sorted by gram, text and place, in
   range partitions, and compared with their neighbours: those that share their
   gram with one recur, the others drop out.
2. A recurring suffix is extended left and right by as much as a passage that
   holds its gram can reach.  The passages there, told by 96 bits of two hashes,
   are sorted with their places and compared with their neighbours again: all
   but the first of equal ones are repeats, and adjacent repeats merge into
   spans, which are maximal.

The ranges end within equal keys, so a passage that a third of the rows hold
spreads over many tasks; what reaches over an end is settled by one row per
partition.

A span of a document is a repeat if each passage in it also occurs in an earlier
document or, with ``within``, earlier in its own document.  Documents are in the
order of their ids (then of a hash of the text).  Documents with equal word
sequences are compared as one.  The first occurrence of a passage is never in a
span; where a passage overlaps its first occurrence, only the words after that
one are.

Null and empty texts and texts of fewer than ``length`` words have no spans.
Ids may be of any type that has an order.  Rows of one id with different texts
are different documents, equal rows (id and text) are one; rows without an id
take no part and stay.  Other columns, whatever their names, pass through
``without_repeats`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from . import text as T
from .groups import by_group, in_order, join_classes, sorted_groups
from .store import map_rows, settle

#: Words of a passage, and of the gram that a retained suffix starts with.
LENGTH, GRAM = 50, 25
#: Ids (8 bytes each) and cuts (about 20 bytes) that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS, BROADCAST_CUTS = 1_000_000, 500_000


def _slide(a: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` over each ``w`` neighbours."""
    s = 1
    while 2 * s <= w:
        a = pick(a[:-s], a[s:])
        s *= 2
    return pick(a[: len(a) - (w - s)], a[w - s :]) if s < w else a


def suffix_starts(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The retained places of a text's word hashes, and the gram hash at each."""
    n, w = len(h) - gram + 1, length - gram + 1
    at = np.arange(n)
    g = T.span_hashes(h, at, at + gram)
    least = _slide(g, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    kept = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), w, np.maximum) == g)
    return kept, g[kept]


def sequence_key(h: np.ndarray) -> int:
    return int(T.span_hashes(h, np.zeros(1, int), np.array([len(h)])).view(np.int64)[0])


def _documents(column, length: int):
    """Word hashes of each text that has ``length`` words, else None."""
    for _, _, data, offsets in T.text_slices(column):
        starts, ends, first = T.words(data, offsets)
        h = T.word_hashes(data, starts, ends)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            yield h[a:z] if z - a >= length else None


def _profiles(docs: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    """id, th, n_words, sequence, and for the first of a sequence in its partition the places and grams of its retained suffixes."""

    def run(batches):
        seen = set()
        for batch in batches:
            at, count, sequence, starts, grams = [], [], [], [], []
            for i, h in enumerate(_documents(batch.column(2), length)):
                if h is None:
                    continue
                key = sequence_key(h)
                at.append(i)
                count.append(len(h))
                sequence.append(key)
                p, g = suffix_starts(h, length, gram) if key not in seen else (None, None)
                starts.append(None if p is None else p.astype(np.int32))
                grams.append(None if g is None else g.view(np.int64))
                seen.add(key)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(count, pa.int64()), pa.array(sequence, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.int64()))],
                names=["id", "th", "n_words", "sequence", "start", "gram"],
            )

    return settle(docs.mapInArrow(run, f"id {kind}, th bigint, n_words bigint, sequence bigint, start array<int>, gram array<bigint>"), "suffixes")


def _recurring(batches):
    """Of suffixes (gram, sequence, start) in order: those whose gram another one holds, and the partition's first and last, whose neighbours lie elsewhere."""
    held, shared = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if held:
            columns = [np.concatenate([np.array([x], c.dtype), c]) for x, c in zip(held, columns)]
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        gram, sequence, start = (c[new] for c in columns)
        before = np.concatenate([[shared], gram[1:] == gram[:-1]])
        both = np.flatnonzero(before[:-1] | before[1:])
        yield pa.RecordBatch.from_arrays([pa.array(sequence[both]), pa.array(start[both])], names=["sequence", "start"])
        held, shared = (gram[-1], sequence[-1], start[-1]), before[-1]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held[1:2]), pa.array(held[2:])], names=["sequence", "start"])


def _passages(docs: DataFrame, kind: str, recurring: DataFrame, length: int, gram: int) -> DataFrame:
    """``recurring``: id, th, starts of the suffixes that recur.  Hashes, document and start of each passage that holds one's gram."""
    ids = recurring.select("id")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(batches):
        for batch in batches:
            for part, h in enumerate(_documents(batch.column(2), length)):
                if h is None:
                    continue
                at = np.array(batch.column(3)[part].as_py(), np.int64)
                near = np.zeros(len(h) + 2, np.int64)  # passages that reach the suffix: from length - gram words before it on
                np.add.at(near, np.maximum(at - (length - gram), 0), 1)
                np.add.at(near, at + 1, -1)
                start = np.flatnonzero(np.cumsum(near)[: len(h) - length + 1] > 0)
                if len(start):
                    rows = pa.array(np.full(len(start), part))
                    more = (T.second_span_hashes(h, start, start + length) >> np.uint64(32)).astype(np.uint32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(T.span_hashes(h, start, start + length).view(np.int64)), pa.array(more.view(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32))],
                        names=["p", "q", "id", "th", "start"],
                    )

    rows = texts.join(recurring, ["id", "th"]).select("id", "th", "text", "starts")
    return settle(rows.mapInArrow(run, f"p bigint, q int, id {kind}, th bigint, start int"), "passages")


HIT, FIRST, LAST = range(3)


def _repeats(passages: DataFrame, kind: str) -> DataFrame:
    """id, th, start of every passage but the first of equal ones, and that one's source, source_th and source_start.

    A partition can't tell where its first run of equal passages began.  It notes
    its first passage, and its last with the start of that one's run; from these
    two rows of every partition the runs are put together.
    """
    schema = f"what int, part int, open boolean, id {kind}, th bigint, start int, source {kind}, source_th bigint, source_start int, p bigint, q int"

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = [x.split()[0] for x in schema.split(", ")]
        last = head = None  # the last row (one row as a batch), and the first row of its run
        open_ = True

        def edge(what, row, single):
            fixed = [pa.array([what], pa.int32()), pa.array([part], pa.int32()), pa.array([single])]
            none = [pa.nulls(1, row.column(2).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())]
            return pa.RecordBatch.from_arrays([*fixed, row.column(2), row.column(3), row.column(4), *none, row.column(0), row.column(1)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield edge(FIRST, batch.slice(0, 1), True)
                last = head = batch.slice(0, 1)
            every = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            c = [x.to_numpy(zero_copy_only=False) for x in every.columns]
            same = (c[0][1:] == c[0][:-1]) & (c[1][1:] == c[1][:-1])
            twice = same & (c[2][1:] == c[2][:-1]) & (c[3][1:] == c[3][:-1]) & (c[4][1:] == c[4][:-1])
            begin = np.maximum.accumulate(np.where(same, 0, np.arange(1, len(same) + 1)))  # the run's first row in ``every``; 0: head
            hit = np.flatnonzero(same & ~twice)
            source = pa.Table.from_batches([head, batch]).combine_chunks().to_batches()[0].take(pa.array(begin[hit]))
            rows = batch.take(pa.array(hit))
            k = len(hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, HIT, np.int32)), pa.array(np.full(k, part, np.int32)), pa.array(open_ & (begin[hit] == 0)), *rows.columns[2:5], *source.columns[2:5], pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())], names=names
            )
            if begin[-1]:
                head, open_ = batch.slice(int(begin[-1]) - 1, 1), False
            last = batch.slice(batch.num_rows - 1, 1)
        if last is not None:
            row = pa.RecordBatch.from_arrays([last.column(0), last.column(1), *head.columns[2:5]], names=last.schema.names)
            yield edge(LAST, row, open_)

    out = settle(in_order(passages, run, schema, passages.count()), "repeats")
    ends: dict[int, dict] = {}
    for r in out.where(F.col("what") != HIT).select("what", "part", "open", "id", "th", "start", "p", "q").collect():
        ends.setdefault(r["part"], {})[r["what"]] = r
    carried, passage, head = [], None, None
    for part in sorted(ends):
        first, end = ends[part][FIRST], ends[part][LAST]
        goes_on = passage == (first["p"], first["q"])
        if goes_on:
            carried.append((part, *head))
        if not (end["open"] and goes_on):
            head = (end["id"], end["th"], end["start"])
        passage = (end["p"], end["q"])
    carried = F.broadcast(passages.sparkSession.createDataFrame(carried, f"part int, c_id {kind}, c_th bigint, c_start int"))
    rows = out.where(F.col("what") != LAST).join(carried, "part", "left")
    began = F.col("open") & F.col("c_id").isNotNull()
    pick = lambda a, b: F.when(began, F.col(a)).otherwise(F.col(b)).alias(b)
    return rows.where((F.col("what") == HIT) | began).select("id", "th", "start", pick("c_id", "source"), pick("c_th", "source_th"), pick("c_start", "source_start"))


def _merge(length: int):
    def run(batches):
        for group in sorted_groups(batches):  # th, id, begin, start, source
            group = group.combine_chunks()
            _, code = np.unique(group.column("id").to_numpy(), return_inverse=True)
            begin = group.column("begin").to_numpy()
            order = np.lexsort((begin, code))
            code, begin, end = code[order], begin[order], group.column("start").to_numpy()[order] + length
            out = []
            for d in range(int(code[-1]) + 1):
                rows = np.flatnonzero(code == d)
                reach = np.maximum.accumulate(end[rows])
                cut = np.flatnonzero(np.concatenate([[True], begin[rows][1:] > reach[:-1]]))
                to = reach[np.append(cut[1:], len(rows)) - 1]
                out.append((rows[cut], begin[rows][cut], to))
            at, first, to = (np.concatenate(x) for x in zip(*out))
            rows = group.take(pa.array(order[at]))
            one = lambda name: rows.column(name).combine_chunks()
            yield pa.RecordBatch.from_arrays([one("id"), one("th"), pa.array(first.astype(np.int64)), pa.array((to - first).astype(np.int64)), one("source")], names=["id", "th", "start_word", "n_words", "source"])

    return run


def _spans(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str, within: bool) -> DataFrame:
    """id, th (xxhash64 of the text), start_word, n_words, source."""
    kind = docs.schema[id_col].dataType
    kind = "bigint" if isinstance(kind, IntegralType) else kind.simpleString()
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(kind).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    profiles = _profiles(docs, kind, length, gram)
    place = F.struct("id", "th")
    first = settle(profiles.groupBy("sequence").agg(F.min(place).alias("first"), F.count("*").alias("size")), "sequences")
    kept = profiles.where("gram is not null")
    suffixes = kept.select("sequence", F.inline(F.arrays_zip("gram", "start"))).select("gram", "sequence", "start")
    recurring = in_order(suffixes, _recurring, "sequence bigint, start int", kept.agg(F.sum(F.size("gram"))).first()[0] or 0)
    recurring = recurring.groupBy("sequence").agg(F.collect_set("start").alias("starts")).join(first.drop("size"), "sequence")
    recurring = settle(recurring.select("first.id", "first.th", "starts"), "recurring")
    hits = _repeats(_passages(docs, kind, recurring, length, gram), kind)
    own = (F.col("source") == F.col("id")) & (F.col("source_th") == F.col("th"))
    if not within:
        hits = hits.where(~own)
    hits = hits.select("th", "id", F.when(own, F.greatest("start", F.col("source_start") + length)).otherwise(F.col("start")).alias("begin"), "start", "source")
    spans = by_group(hits, _merge(length), f"id {kind}, th bigint, start_word bigint, n_words bigint, source {kind}")
    copies = join_classes(profiles.select("id", "th", "n_words", "sequence"), first.where("size > 1"), "sequence", "size", profiles.count()).where(place > F.col("first"))
    whole = copies.select("id", "th", F.lit(0).cast("bigint").alias("start_word"), "n_words", F.col("first.id").alias("source")).distinct()
    return whole.unionByName(spans)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """Per repeated span: id, start_word (from 0), n_words, source (an earlier document, or ``within`` the same, that holds the span's first passage)."""
    kind = docs.schema[id_col].dataType
    out = _spans(docs, length, gram, id_col, text_col, within)
    return out.select(F.col("id").cast(kind).alias(id_col), "start_word", "n_words", F.col("source").cast(kind).alias("source_" + id_col))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated spans, across and within documents, cut from their texts (each cut closes up to the next word); rows that lose all their words go."""
    names = [next(name for n in range(len(docs.columns) + 1) if (name := f"__{x}{n}") not in docs.columns) for x in ("id", "th", "cuts")]
    spans = _spans(docs, length, gram, id_col, text_col, within=True)
    cuts = spans.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias("cuts"))
    cuts = settle(cuts.select(F.col("id").alias(names[0]), F.col("th").alias(names[1]), F.col("cuts").alias(names[2])), "cuts")
    size = cuts.agg(F.sum(F.size(names[2]))).first()[0] or 0
    same = (F.col(f"`{id_col}`") == F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1]))
    out = docs.join(F.broadcast(cuts) if size <= BROADCAST_CUTS else cuts, same, "left")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            cut = batch.column(batch.num_columns - 1).to_pylist()
            keep = np.ones(len(texts), bool)
            for i, spans in enumerate(cut):
                if not spans:
                    continue
                raw = texts[i].encode()
                starts, ends, _ = T.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                left, pieces = 0, []
                for s in spans:
                    a, z = s["start_word"], s["start_word"] + s["n_words"]
                    pieces.append(raw[left : starts[a]])
                    left = int(starts[z]) if z < len(starts) else int(ends[-1])
                pieces.append(raw[left:])
                texts[i] = b"".join(pieces).decode()
                keep[i] = bool(texts[i].strip(" \t\n\v\f\r"))
            columns = [batch.column(j) for j in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep))

    return map_rows(out.select(*[F.col(f"`{c}`") for c in docs.columns], names[2]), run, docs.schema)
