"""Best-fit packing of token sequences by a grouping genetic algorithm.

Texts become pieces of at most ``capacity`` tokens; full pieces are sequences of
their own.  The others are dealt by hash into colonies of bounded size.  Several
islands evolve each colony, on any executor, from best fits of unsorted orders:
a child takes well-filled bins of one parent whole, the other parent's bins that
hold a duplicate dissolve, and the displaced documents go where they fit best,
in falling order.  An island rests once no fewer bins can hold its items.  After
an epoch each island receives its neighbour's elite and evolves on.  Bins that a
colony doesn't fill well meet those of the others in a last round of colonies.
The elites tell the bins of each island's first population and its crossovers.

Null and empty texts are the separator alone.  Repeated rows are packed each.
An empty table gives no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .groups import by_group, sorted_groups
from .store import parallelism, settle

CAPACITY, SEPARATOR = 2048, 0
#: Items of a colony, islands of each, epochs between migrations, and generations of an epoch.
COLONY, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 2, 2, 30, 5
#: Bins at least so full stay after the first round of colonies.
KEEP = 0.995


class Space:
    """Bins by free space; finds the least free space that fits by the lowest set bit of a mask."""

    def __init__(self, free: list[int]):
        self.free = free
        self.at: dict[int, list[int]] = {}
        self.mask = 0
        for b, f in enumerate(free):
            self.put(b, f)

    def put(self, b: int, f: int) -> None:
        held = self.at.get(f)
        if held:
            held.append(b)
        else:
            self.at[f] = [b]
            self.mask |= 1 << f

    def best_fit(self, size: int, capacity: int) -> int:
        """The bin that takes an item of this size, a new one if it fits in none."""
        over = self.mask >> size
        if over:
            f = size + (over & -over).bit_length() - 1
            b = self.at[f].pop()
            if not self.at[f]:
                self.mask ^= 1 << f
        else:
            b, f = len(self.free), capacity
            self.free.append(capacity)
        self.free[b] = f - size
        self.put(b, f - size)
        return b


def insert(bins: np.ndarray, sizes: np.ndarray, items: np.ndarray, capacity: int, noise: np.random.Generator | None = None, falling: bool = True) -> np.ndarray:
    """``bins`` with ``items`` (bin -1) placed by best fit in falling order (or as they come); bins are numbered anew without gaps."""
    placed = bins >= 0
    _, number = np.unique(bins[placed], return_inverse=True)
    out = np.full(len(bins), -1, np.int64)
    out[placed] = number
    space = Space((capacity - np.bincount(number, weights=sizes[placed])).astype(int).tolist() if placed.any() else [])
    key = sizes[items] * (1 + 0.15 * noise.random(len(items))) if noise is not None else sizes[items]
    order = items[np.argsort(-key, kind="stable")] if falling else items
    out[order] = [space.best_fit(s, capacity) for s in sizes[order].tolist()]
    return out


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewest bins first, then unevenly filled ones: full bins leave room elsewhere."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return -len(fill), float((fill * fill).sum())


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``a`` with some well-filled bins of ``b`` injected whole, duplicates' bins dissolved and the displaced items placed by best fit."""
    fill = np.bincount(b, weights=sizes)
    good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // 2), replace=False)] = True
    injected = chosen[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[injected]] = True
    child = np.where(hit[a], -1, a)
    child[injected] = b[injected] + a.max() + 1
    return insert(child, sizes, np.flatnonzero(child < 0), capacity)


def mutate(a: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The emptiest bins and as many others dissolve."""
    fill = np.bincount(a, weights=sizes)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill, kind="stable")[: max(3, len(fill) // 10)]] = True
    gone[rng.choice(len(fill), max(1, len(fill) // 10), replace=False)] = True
    child = np.where(gone[a], -1, a)
    return insert(child, sizes, np.flatnonzero(child < 0), capacity, rng)


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray] = (), generations: int | None = None) -> tuple[np.ndarray, int, int]:
    """A bin for each item, after some generations from ``elites`` and best fits of unsorted orders; the fewest bins at the start, and the crossovers made.

    A population that hasn't reached the bound by half the time takes in a newcomer, the best fit of the falling order.
    """
    rng = np.random.default_rng(seed)
    none = np.full(len(sizes), -1, np.int64)
    least = -(-int(sizes.sum()) // capacity)
    people = list(elites)
    if not people or max(fitness(x, sizes, capacity) for x in people)[0] < -least:
        people += [insert(none, sizes, rng.permutation(len(sizes)), capacity, falling=False) for _ in range(POPULATION - len(people))]
    grades = [fitness(x, sizes, capacity) for x in people]
    start, made = -max(grades)[0], 0
    pick = random.Random(seed)
    generations = GENERATIONS if generations is None else generations
    for n in range(generations):
        if -max(grades)[0] <= least or len(people) < 2:
            break
        if n == generations // 2:
            worst = min(range(len(people)), key=grades.__getitem__)
            people[worst] = insert(none, sizes, np.arange(len(sizes)), capacity)
            grades[worst] = fitness(people[worst], sizes, capacity)
        i, j = pick.sample(range(len(people)), 2)
        child = crossover(people[i], people[j], sizes, capacity, rng)
        made += 1
        if pick.random() < 0.3:
            child = mutate(child, sizes, capacity, rng)
        g = fitness(child, sizes, capacity)
        worst = min(range(len(people)), key=grades.__getitem__)
        if g > grades[worst]:
            people[worst], grades[worst] = child, g
    return people[max(range(len(people)), key=grades.__getitem__)], start, made


def _colonies(items: DataFrame, count: int, salt: int) -> DataFrame:
    """colony, uids and sizes (as bytes): one row per colony."""

    def run(batches):
        for group in sorted_groups(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([group.column(0)[0].as_py()]), pa.array([group.column(1).to_numpy().tobytes()]), pa.array([group.column(2).to_numpy().astype(np.int32).tobytes()])],
                names=["colony", "uids", "sizes"],
            )

    rows = items.select(F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(max(1, -(-count // COLONY)))).alias("colony"), "uid", "length")
    return settle(by_group(rows, run, "colony bigint, uids binary, sizes binary"), "colonies")


def _epoch(colonies: DataFrame, elites: DataFrame | None, capacity: int, epoch: int) -> DataFrame:
    """colony, island, bins (as bytes), n_bins, n_start and crossovers, after one epoch; ``elites`` are the islands' bests so far."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                held = {e["island"]: np.frombuffer(e["bins"], np.int32).astype(np.int64) for e in row["elites"] or []}
                own = [held[i] for i in (row["island"], (row["island"] + 1) % ISLANDS) if i in held]
                bins, start, made = evolve(sizes, capacity, seed=(row["colony"] * ISLANDS + row["island"]) * EPOCHS + epoch, elites=own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["colony"]]), pa.array([row["island"]]), pa.array([bins.astype(np.int32).tobytes()]), pa.array([int(bins.max()) + 1]), pa.array([start]), pa.array([made])],
                    names=["colony", "island", "bins", "n_bins", "n_start", "crossovers"],
                )

    spark = colonies.sparkSession
    if elites is None:
        rows = colonies.withColumn("elites", F.lit(None).cast("array<struct<island:bigint,bins:binary>>"))
    else:
        rows = colonies.join(elites.groupBy("colony").agg(F.collect_list(F.struct("island", "bins")).alias("elites")), "colony")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ISLANDS - 1).cast("bigint"))).alias("island"))
    return settle(rows.repartition(parallelism(spark), "colony", "island").mapInArrow(run, "colony bigint, island bigint, bins binary, n_bins bigint, n_start bigint, crossovers bigint"), "elites")


def _round(items: DataFrame, count: int, capacity: int, salt: int) -> DataFrame:
    """uid, length, bin, fill, at: the best island's packing of every colony."""
    colonies = _colonies(items, count, salt)
    elites = None
    for epoch in range(EPOCHS):
        elites = _epoch(colonies, elites, capacity, epoch)
    best = elites.groupBy("colony").agg(F.min_by("bins", F.struct("n_bins", "island")).alias("bins"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                bins = np.frombuffer(row["bins"], np.int32).astype(np.int64)
                fill = np.bincount(bins, weights=sizes).astype(np.int64)
                order = np.argsort(bins, kind="stable")
                total = np.cumsum(sizes[order]) - sizes[order]
                start = np.concatenate([[0], np.cumsum(fill)])[bins[order]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["uids"], np.int64)[order]),
                        pa.array(sizes[order]),
                        pa.array(((salt * (1 << 36) + row["colony"]) << 16) + bins[order]),
                        pa.array(fill[bins[order]]),
                        pa.array(total - start),
                    ],
                    names=["uid", "length", "bin", "fill", "at"],
                )

    return settle(colonies.join(best, "colony").mapInArrow(run, "uid bigint, length bigint, bin bigint, fill bigint, at bigint"), "packed")


def pack_items(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items``: uid (unique), length (1 to capacity).  Per item: uid, sequence_id, offset; sequences are gapless from 0."""
    small = items.where(F.col("length") < capacity).select("uid", F.col("length").cast("bigint").alias("length"))
    first = _round(small, small.count(), capacity, 0)
    kept, loose = first.where(F.col("fill") >= KEEP * capacity), first.where(F.col("fill") < KEEP * capacity)
    again = _round(loose.select("uid", "length"), loose.count(), capacity, 1)
    bins = lambda df: df.select("bin").distinct().count()
    rest = again if bins(again) < bins(loose) else loose
    packed = kept.union(rest).select("uid", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    alone = items.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.union(alone)


class ByteBpe:
    """Ids of byte-level BPE texts, one after the other.

    The ranks give the tokenizer library's ids for Latin texts; texts with other
    characters or a special token's string take the library itself.
    """

    def __init__(self, path: str, ranks_path: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        # Bytes from 0xC9 on start characters from U+0240 on.
        if (text.isascii() or max(text.encode()) < 0xC9) and not any(s in text for s in self.specials):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, path: str, ranks_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, uid (unique), and with ``with_ids`` its ids.

    A document longer than ``capacity`` is cut so that only its first piece may be shorter.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, uid bigint" + ", ids array<int>" * with_ids

    def run(batches):
        from pyspark import TaskContext

        model = ByteBpe(path, ranks_path)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = [[] for _ in range(7)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*model.encode(text or ""), SEPARATOR], "<u4")
                head = len(ids) % capacity or capacity
                for k, start in enumerate([0, *range(head, len(ids), capacity)]):
                    part = ids[start : start + (capacity if k else head)]
                    for column, v in zip(out, (i, k, start, len(part), zlib.crc32(part.tobytes()), uid, part.astype(np.int32) if with_ids else None)):
                        column.append(v)
                    uid += 1
            columns = [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:6])]
            names = [id_col, "piece", "start", "length", "ids_crc32", "uid"]
            if with_ids:
                columns.append(pa.array(out[6], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return settle(docs.select(id_col, text_col).mapInArrow(run, schema), "pieces")


def pack_documents(docs: DataFrame, path: str, ranks_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``pieces`` of the documents with sequence_id and offset."""
    cut = pieces(docs, path, ranks_path, capacity, id_col, text_col, with_ids)
    return cut.join(pack_items(cut.select("uid", "length"), capacity), "uid").drop("uid")
