"""Spelling variants: words one edit apart, and the frequent form each rare one goes back to.

Words are counted per task first, then over all tasks.  Two words that differ by
one inserted, deleted or replaced code point agree on two of three parts of the
shorter one, and the first place where they differ tells which; so every word
goes to six groups (three as the shorter or equal one, three as the longer one)
and a pair of near words is met in one group only.

A group's words are columns of a bit-sliced index: for each position and letter
the set of words that have it there.  For many words at once the recurrences walk
along the positions and keep four sets: words equal so far, and words with one
error so far, replaced (same position), added (position + 1) or left out
(position - 1).  Small groups share an index, told apart by a set per group.
Groups of more than ``LIMIT`` words are dealt into blocks whose pairs are groups
of their own, so no task holds more than two blocks.

Only a count and the best near word leave a group, never its pairs.  Null and
empty texts have no words; a null id is written as nothing before the colon; rows
that repeat count each time; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import parallelism, settle

#: Words of a group that stay together, words of a shared index, and words looked up at once.
LIMIT, SHARED, AT_ONCE = 16_384, 1_024, 256
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000


def word_counts(docs: DataFrame, least: int = 7, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of ``least`` code points or more.

    ``noise`` deletes one code point of a run where it divides the crc32 of
    ``<id>:<run>`` (0: of none).
    """
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                begun = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(pattern.findall(text.encode().lower().decode())).items():
                    if noise:
                        h = zlib.crc32(word.encode(), begun)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    held[word] += n
                if len(held) > COUNTED:
                    yield _counted(held)
                    held = Counter()
        if held:
            yield _counted(held)

    return docs.select(id_col, text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _grouped(words: DataFrame, limit: int) -> DataFrame:
    """part, m, kind, block, own, word, n: every word in its groups for shorter words of ``m`` letters; ``own`` is false where only pairs across blocks count."""
    size = F.length("word")
    rows = words.withColumn("m", F.explode(F.array(size, size - 1))).where("m >= 3")
    a, b = F.floor(F.col("m") / 3).cast("int"), F.floor(F.col("m") * 2 / 3).cast("int")
    left, tail = lambda k: F.substring("word", F.lit(1), k), lambda k: F.substring("word", size - k + 1, k)
    keys = [(0, left(b), F.lit("")), (1, left(a), tail(F.col("m") - b)), (2, F.lit(""), tail(F.col("m") - a))]
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.xxhash64("m", F.lit(k), x, y).alias("part")) for k, x, y in keys])
    rows = rows.select("m", F.explode(keys).alias("key"), "word", "n").select("key.part", "m", "key.kind", "word", "n")
    large = rows.groupBy("part").count().where(F.col("count") > limit).select("part", F.ceil(F.col("count") / limit).cast("int").alias("blocks"))
    rows = rows.join(large, "part", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("word", F.lit(7)), "blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("*", other.alias("other"))
    part = F.when(F.col("blocks").isNull(), F.col("part")).otherwise(F.xxhash64("part", F.least("block", "other"), F.greatest("block", "other")))
    return rows.select(part.alias("part"), "m", "kind", "block", (F.col("block") == F.col("other")).alias("own"), "word", "n")


class PositionIndex:
    """Bit-sliced index of words of ``m`` or ``m + 1`` letters: a bitset over the words per (position, letter), length and group."""

    def __init__(self, words: list[str], m: int, group: np.ndarray):
        self.m, self.count = m, len(words)
        points = np.frombuffer("".join(w.ljust(m + 1, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), m + 1)
        _, code = np.unique(points, return_inverse=True)
        self.code = code.reshape(points.shape)
        self.letters = int(self.code.max()) + 1
        self.longer = points[:, m] != 0
        self.at = [self._sets(self.code[:, i], self.letters) for i in range(m + 1)]
        self.has_more, self.group = self._pack(self.longer[None])[0], group
        self.of_group = self._sets(group, int(group.max()) + 1)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.packbits(bits, axis=1, bitorder="little")
        return np.pad(out, ((0, 0), (0, -out.shape[1] % 8))).view(np.uint64)

    def _sets(self, values: np.ndarray, kinds: int) -> np.ndarray:
        out = np.zeros((kinds, -(-self.count // 64) * 8), np.uint8)
        np.bitwise_or.at(out, (values, np.arange(self.count) >> 3), (1 << (np.arange(self.count) & 7)).astype(np.uint8))
        return out.view(np.uint64)

    def near(self, rows: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, word) one edit apart of words ``rows`` of ``m`` letters; ``kind`` is the part, from the last, in which they first differ."""
        m, code = self.m, self.code[rows]
        zero = self.of_group[self.group[rows]]
        replaced, added = np.zeros_like(zero), np.zeros_like(zero)
        cuts = {}
        for i in range(m):
            cuts[i] = zero
            here, next_one = self.at[i][code[:, i]], self.at[i + 1][code[:, i]]
            # One letter more in the word: what was equal up to here may skip its letter at i, and goes on one place further.
            added = (added | zero) & next_one
            replaced = replaced & here | zero & ~here
            zero = zero & here
        cuts[m] = zero
        hit = replaced & ~self.has_more | (added | zero) & self.has_more
        a, b = m // 3, m * 2 // 3
        hit &= cuts[b] if kind == 0 else cuts[a] & ~cuts[b] if kind == 1 else ~cuts[a]
        # Bits beyond the words are never set: every set starts from the group's.
        at, word = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little", count=self.count))
        return rows[at], word


def _best(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray, counts: np.ndarray, best: np.ndarray, rank: np.ndarray) -> None:
    """Count pairs (a, b) for a, and keep a's best b: ``rank`` is the order by falling n, then by word."""
    np.add.at(counts, a, 1)
    np.minimum.at(best, a, rank[b])


def _match(part: np.ndarray, m: int, kind: int, block: np.ndarray, own: np.ndarray, words: list[str], n: np.ndarray) -> pa.RecordBatch:
    """word, n_near, best_n, best: near words within the parts (a sorted column) of these rows."""
    _, group = np.unique(part, return_inverse=True)
    index = PositionIndex(words, m, group)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    counts, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    shorter = np.flatnonzero(~index.longer)
    for i in range(0, len(shorter), AT_ONCE):
        a, b = index.near(shorter[i : i + AT_ONCE], kind)
        across = own[a] | (block[a] != block[b])
        a, b = a[across], b[across]
        _best(words, n, a, b, counts, best, rank)
        more = index.longer[b]  # words of one length find each other; the longer ones are told here
        _best(words, n, b[more], a[more], counts, best, rank)
    found = np.flatnonzero(counts)
    top = np.array(order, np.int64)[best[found]]
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in found.tolist()], pa.string()), pa.array(counts[found]), pa.array(n[top]), pa.array([words[i] for i in top.tolist()], pa.string())], names=["word", "n_near", "best_n", "best"]
    )


def _matches(batches):
    """Runs of rows (part, m, kind, block, own, word, n), sorted by m, kind and part: small parts of one m and kind share an index."""
    held: list[list] = []
    size, key = 0, None

    def flush():
        part, block, own, words, n = (sum((h[k] for h in held), []) for k in range(5))
        if len(words) > 1:
            yield _match(np.array(part, np.int64), *key, np.array(block), np.array(own, bool), words, np.array(n, np.int64))

    last: list | None = None
    for batch in batches:
        part, m, kind, block, own, word, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(part):
            continue
        cut = np.flatnonzero((part[1:] != part[:-1]) | (m[1:] != m[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(part)]):
            now = (int(m[a]), int(kind[a]))
            rows = [part[a:z].tolist(), block[a:z].tolist(), own[a:z].tolist(), word[a:z].tolist(), n[a:z].tolist()]
            if last is not None and key == now and last[0][0] == rows[0][0]:
                for x, y in zip(last, rows):
                    x += y
                continue
            # The part before is whole now; single words have no near one.
            if last is not None and len(last[0]) > 1:
                held.append(last)
                size += len(last[0])
            if held and (key != now or size >= SHARED):
                yield from flush()
                held, size = [], 0
            key, last = now, rows
    if last is not None and len(last[0]) > 1:
        held.append(last)
    if held:
        yield from flush()


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n_near, best_n, best of every word that has a near one: how many, and the most frequent (ties: the least word).

    ``words``: word (distinct, three code points or more), n.
    """
    rows = _grouped(words, limit)
    found = rows.repartition(parallelism(words.sparkSession), "part").sortWithinPartitions("m", "kind", "part").mapInArrow(_matches, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n).

    ``form`` is the most frequent near word, where it is at least ``factor`` (2
    or more) times as frequent; ``root`` follows forms to the last.  Counts grow
    by the factor at each step, so a chain has at most 63 forms and six rounds
    that each follow twice as many end it.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, or chains of forms needn't end")
    words = settle(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    near = near_words(words)
    joined = settle(words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("best_n") >= factor * F.col("n"), F.lit(False))), "near")
    forms = joined.where("has").select("word", F.col("best").alias("root"))
    for k in range(6):
        step = forms.join(forms.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        step = settle(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        forms = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    out = joined.join(forms, "word", "left")
    return out.select("word", F.when(F.col("has"), F.col("best")).alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("has"), F.col("best_n")).alias("form_n"))


def spelling_variants(docs: DataFrame, least: int = 7, repeats: int = 2, factor: int = 10, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the words of ``docs`` that have ``least`` code points and occur ``repeats`` times, or more."""
    return variants(word_counts(docs, least, noise, id_col, text_col).where(F.col("n") >= repeats), factor)
