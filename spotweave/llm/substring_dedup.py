"""Passages that occur earlier in a corpus, by suffix automata of reference shards.

Every window of ``length`` words has an anchor, the ``gram``-word sequence in it
with the least hash, so equal windows have equal anchors at equal places.
Windows whose anchor occurs once in the corpus are unique.  The others form
spans, and a span goes to the shard of the place at which its anchor occurs
first: the spans of copies of one passage stay whole and meet in one shard.

A shard's reference is its distinct spans in order of (id, start).  One task
builds its suffix automaton, which tells for each word sequence where it ends
first, and streams the spans through it for matching statistics: a window is
removed if it is matched whole and ends earlier somewhere.  The automaton goes to
no more tasks than its shard's spans lie in, which is one: as a whole, the
reference grows with the corpus, so no table of automata is broadcast to all.

A shard takes only anchors of up to ``HOT`` places, so its size is bounded
however often a passage occurs.  Windows of more frequent anchors are told by
128 bits of their hash instead: the first place of each is found by an
aggregate that combines before the shuffle.  Anchors that a sample of texts shows
to be very frequent (10,000 at most) never meet in one task; the sample decides
the way, not the result.

Order is by id (null first), then, for ids with several texts, by the texts'
xxhash64, then by place.  Rows of one id and one text are one document and get
equal results.  Null and empty texts have no words.  Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import text as T
from .groups import join_classes, sorted_groups
from .store import map_rows, parallelism, settle

LENGTH, GRAM = 20, 8
#: Places of an anchor that a shard takes, and words of a text whose anchors may share a shard.
HOT, SECTION = 200, 512
#: One in so many texts shows the most frequent anchors: those it holds so often, and no more than so many.
SAMPLE, OFTEN, FREQUENT = 16, 64, 10_000
_EXACT = T._symbol_table(256, fold=False)


class SuffixAutomaton:
    """All substrings of the sequences added; of each the place where its first occurrence ends.

    A state's strings end at the same places.  Sequences are added in order, so
    the place at which a state is made is its first.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]

    def _state(self, size: int, first: int, link: int, onward: dict) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """A state for the strings of ``q`` that are no longer than those of ``p`` and the symbol."""
        clone = self._state(self.size[p] + 1, self.first[q], self.link[q], self.next[q].copy())
        self.link[q] = clone
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list[int], begin: int) -> None:
        """A sequence whose first symbol is at place ``begin``, behind all places so far."""
        onward, link, size = self.next, self.link, self.size
        last = 0
        for place, symbol in enumerate(symbols, begin):
            q = onward[last].get(symbol)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, symbol, q)
                continue
            state = self._state(size[last] + 1, place, 0, {})
            p = last
            while p != -1 and symbol not in onward[p]:
                onward[p][symbol] = state
                p = link[p]
            if p != -1:
                q = onward[p][symbol]
                link[state] = q if size[q] == size[p] + 1 else self._split(p, symbol, q)
            last = state

    def first_ends(self, symbols: list[int], length: int) -> list[int]:
        """For each symbol the first end of the ``length`` symbols up to it; -1 where they don't occur."""
        onward, link, size, first = self.next, self.link, self.size, self.first
        state = matched = 0
        out = []
        for symbol in symbols:
            while state and symbol not in onward[state]:
                state = link[state]
                matched = size[state]
            if symbol in onward[state]:
                state = onward[state][symbol]
                matched += 1
            while state and size[link[state]] >= length:
                state = link[state]
                matched = size[state]
            out.append(first[state] if matched >= length else -1)
        return out


def _anchors(docs: DataFrame, kind: str, length: int, gram: int, frequent: np.ndarray) -> DataFrame:
    """part, hot, id, h, start, n: anchors of the windows from ``start`` on, so many; ``part`` is the anchor, or a place's hash if it is one of ``frequent``."""

    def run(batches):
        for batch in batches:
            for row, _, data, offsets in T.text_slices(batch.column(2)):
                starts, ends, first = T.words(data, offsets)
                windows = len(starts) - length + 1
                if windows <= 0:
                    continue
                grams = T.gram_hashes(T.span_hashes(data, starts, ends, _EXACT), gram)
                least, place = grams[:windows].copy(), np.arange(windows)
                for k in range(1, length - gram + 1):
                    less = np.flatnonzero(grams[k : k + windows] < least)
                    least[less] = grams[k : k + windows][less]
                    place[less] = less + k
                doc = np.searchsorted(first, np.arange(windows), "right") - 1
                inside = np.flatnonzero(np.arange(windows) + length <= first[doc + 1])
                if not len(inside):
                    continue
                new = np.flatnonzero((np.diff(place[inside], prepend=-1) != 0) | (np.diff(doc[inside], prepend=-1) != 0))
                at = inside[new]
                n = np.diff(np.append(new, len(inside)))
                anchor, start = grams[place[at]], at - first[doc[at]]
                hot = np.isin(anchor, frequent)
                rows = pa.array(row + doc[at])
                ids, h = batch.column(0).take(rows), batch.column(1).take(rows)
                part = np.where(hot, _places(ids, h.to_numpy(), start), anchor) if hot.any() else anchor
                arrays = [pa.array(part.view(np.int64)), pa.array(hot), ids, h, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "hot", "id", "h", "start", "n"])

    return docs.select("id", "h", "text").mapInArrow(run, f"part bigint, hot boolean, id {kind}, h bigint, start int, n int")


def _places(ids: pa.Array, h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each place, by which it is dealt out."""
    if pa.types.is_integer(ids.type):
        own = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64)
    else:
        own = np.fromiter((zlib.crc32(str(x).encode()) for x in ids.to_pylist()), np.uint64, len(ids))
    return T.mix64(T.mix64(own) + T.mix64(h.view(np.uint64)) * T.U64(3) + start.astype(np.uint64))


def _recurring(batches):
    """Of sorted rows (part, hot, id, h, start, n): those of parts with several rows, with the part's shard; none where the part has too many rows for one."""
    held, over = None, None
    for batch in itertools.chain(batches, [None]):
        if batch is None and held is None:
            break
        rows = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks().to_batches()
        rows, held, last = (rows[0] if rows else None), None, batch is None
        if rows is None:
            continue
        part, hot = rows.column(0).to_numpy(), rows.column(1).to_numpy(zero_copy_only=False)
        cut = np.append(0, np.flatnonzero(part[1:] != part[:-1]) + 1)
        size = np.diff(np.append(cut, len(part)))
        large = (size > HOT) | (part[cut] == over if over is not None else False)
        if not last:
            if large[-1]:
                over = part[-1]
            else:  # may go on in the next batch
                held = rows.slice(int(cut[-1]))
                cut, size, large = cut[:-1], size[:-1], large[:-1]
                over = None
        count = int(size.sum())
        if not count:
            continue
        h, start = rows.column(3).to_numpy()[cut], rows.column(4).to_numpy()[cut]
        shard = np.repeat(_places(rows.column(2).take(pa.array(cut)), h, start // SECTION).view(np.int64), size)
        plain = hot[:count] | np.repeat(large, size)
        keep = np.flatnonzero(plain | np.repeat(size > 1, size))
        take = pa.array(keep)
        yield pa.RecordBatch.from_arrays([*(rows.column(k).take(take) for k in (2, 3, 4, 5)), pa.array(shard[keep], mask=plain[keep])], names=["id", "h", "start", "n", "shard"])


def _spans(length: int):
    """Of texts with their anchors: spans with their words, and windows of frequent anchors with their hash."""

    def run(batches):
        for batch in batches:
            rows, key, start, count, words, digests = [], [], [], [], [], []
            for i, (text, anchors) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                held = text.encode().split()
                anchors = sorted({(a["start"], a["n"], a["shard"]) for a in anchors}, key=lambda a: a[0])
                spans: list[list] = []
                for at, n, shard in anchors:
                    if shard is None:
                        for k in range(at, at + n):
                            rows.append(i)
                            key.append(None)
                            start.append(k)
                            count.append(1)
                            words.append(None)
                            digests.append(hashlib.blake2b(b" ".join(held[k : k + length]), digest_size=16).digest())
                    elif spans and spans[-1][2] == shard and spans[-1][0] + spans[-1][1] == at:
                        spans[-1][1] += n
                    else:
                        spans.append([at, n, shard])
                for at, n, shard in spans:
                    rows.append(i)
                    key.append(shard)
                    start.append(at)
                    count.append(n)
                    words.append(b" ".join(held[at : at + n + length - 1]))
                    digests.append(None)
            take = pa.array(rows, pa.int64())
            arrays = [pa.array(key, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(words, pa.binary()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "id", "h", "start", "n", "words", "digest"])

    return run


def _ranges(flags: list[bool]) -> list[tuple[int, int]]:
    """(start, length) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def _matched(length: int):
    """Of spans (key, id, h, start, n, words), sorted: the windows that end earlier in their shard's reference."""

    def run(batches):
        for group in sorted_groups(batches):
            if group.num_rows == 1 and group.column("n")[0].as_py() == 1:
                continue  # one window alone
            known: dict[bytes, int] = {}
            number: dict[bytes, int] = {}
            automaton, begin = SuffixAutomaton(), 0
            spans, rows, start, count = [], [], [], []
            own = list(zip(group.column("id").to_pylist(), group.column("h").to_pylist(), group.column("start").to_pylist()))
            places = list(zip(group.column("start").to_pylist(), group.column("n").to_pylist()))
            for i, words in enumerate(group.column("words").to_pylist()):
                if i and own[i] == own[i - 1]:  # a row that repeats is the same place
                    spans.append(spans[-1])
                    continue
                if words in known:  # the whole span has ended before
                    spans.append(None)
                    continue
                known[words] = i
                symbols = [number.setdefault(w, len(number)) for w in words.split(b" ")]
                automaton.add(symbols, begin)
                spans.append((symbols, begin))
                begin += len(symbols)
            for i, (span, (at, n)) in enumerate(zip(spans, places)):
                if span is None:
                    found = [(0, n)]
                else:
                    ends = automaton.first_ends(span[0], length)
                    found = _ranges([0 <= e < p for p, e in enumerate(ends, span[1])][length - 1 :])
                for a, k in found:
                    rows.append(i)
                    start.append(at + a)
                    count.append(k)
            if rows:
                group = group.combine_chunks()
                take = pa.array(rows, pa.int64())
                one = lambda c: group.column(c).take(take).combine_chunks()
                yield pa.RecordBatch.from_arrays([one("id"), one("h"), pa.array(start, pa.int32()), pa.array(count, pa.int32())], names=["id", "h", "start", "n"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h, text; h tells texts of one id apart, and is 0 where no id has several rows."""
    several = docs.groupBy(F.col(f"`{id_col}`")).count().where("count > 1").limit(1).count()
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), (F.xxhash64(text) if several else F.lit(0).cast("bigint")).alias("h"), text.alias("text"))


def _joined(docs: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
    """``docs`` with the column ``name`` of their (id, h)."""
    lists = lists.select(F.col("id").alias("own"), F.col("h").alias("own_h"), name)
    return docs.join(lists, docs["id"].eqNullSafe(lists["own"]) & (docs["h"] == lists["own_h"]), how).select("id", "h", "text", name)


def _removed(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """id, h, start, n of the windows that start earlier too; ``docs`` as ``_keyed`` makes them."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    sample = _anchors(docs.where(F.pmod(F.xxhash64("id", "h"), F.lit(SAMPLE)) == 0), kind, length, gram, np.zeros(0, np.uint64))
    counts = sample.groupBy("part").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "part").limit(FREQUENT)
    frequent = np.array([r[0] for r in counts.collect()], np.int64).view(np.uint64)
    parts = parallelism(spark)
    anchors = _anchors(docs, kind, length, gram, frequent).repartition(parts, "part").sortWithinPartitions("part", "id", "h", "start")
    recurring = anchors.mapInArrow(_recurring, f"id {kind}, h bigint, start int, n int, shard bigint")
    lists = recurring.groupBy("id", "h").agg(F.collect_list(F.struct("start", "n", "shard")).alias("anchors"))
    spans = _joined(docs, lists, "anchors", "inner").mapInArrow(_spans(length), f"key bigint, id {kind}, h bigint, start int, n int, words binary, digest binary")
    spans = settle(spans, "spans")
    sharded = spans.where("digest is null").drop("digest").repartition(parts, "key").sortWithinPartitions("key", "id", "h", "start")
    matched = sharded.mapInArrow(_matched(length), f"id {kind}, h bigint, start int, n int")
    windows = spans.where("digest is not null").select("digest", "id", "h", "start")
    place = F.struct("id", "h", "start")
    first = settle(windows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1"), "windows")
    later = join_classes(windows, first, "digest", "size", windows.count()).where(place > F.col("first"))
    return matched.unionByName(later.select("id", "h", "start", F.lit(1).alias("n")))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h, start, n: from word ``start`` (from 0) on, so many windows whose words start earlier too; h tells texts of one id apart."""
    out = _removed(_keyed(docs, id_col, text_col), length, gram).distinct()
    return out.withColumnRenamed("id", id_col)


def _kept(length: int, texts: bool):
    def run(batches):
        for batch in batches:
            total, gone, out = [], [], []
            for text, windows in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = (text or "").encode().split()
                kept, at = [], 0
                for start, n in sorted((w["start"], w["n"]) for w in windows or ()):
                    if start > at:
                        kept += words[at:start]
                    at = max(at, start + n + length - 1)
                kept = kept + words[at:] if at else words
                total.append(len(words))
                gone.append(len(words) - len(kept))
                held = b" ".join(kept)
                out.append(held.decode() if texts else hashlib.sha256(held).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=["c0", "c1", "c2", "c3"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, and the words kept, joined by spaces (``kept``), or their ``kept_sha256``.

    A word goes if a window of ``length`` words that holds it starts earlier too,
    in a smaller id or before in the same text; windows are those of the input.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be from 1 to length")
    docs = _keyed(docs, id_col, text_col)
    lists = _removed(docs, length, gram).groupBy("id", "h").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    schema = docs.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.lit("").alias("kept_sha256" if digest else "kept")).schema
    return map_rows(_joined(docs, lists, "windows", "left"), _kept(length, not digest), schema)
