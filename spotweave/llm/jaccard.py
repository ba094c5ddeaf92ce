"""Exact n-gram Jaccard self-join with signature trees.

1. Every text becomes its set of distinct word shingles (64-bit hashes).  Equal
   sets are one class, told by a 64-bit key over the set.
2. Two sets of Jaccard t or more share a token among the first n - ceil(t n) + 1
   of each, in any order common to all.  Tokens that are frequent in a hashed
   sample of the documents come last in that order, which keeps the groups
   small; the order changes no result.  The classes of one such token form a
   group, named by its least class, and equal names are one group.
3. In each group a signature tree joins the classes by bitmap and size: its
   nodes hold OR-combined bitmaps and size ranges, and pairs of nodes are left
   out by the most tokens they can share.  What remains connected is a
   neighbourhood.
4. The texts of a neighbourhood meet, and the same tree joins them again, now
   confirming with the sets themselves.  Pairs already connected are skipped,
   so a group of n near copies costs about n confirmations, not n squared.
5. The links' components over all classes give each document its class.

No group is collected whole: beyond a size, groups are dealt in block pairs,
and neighbourhoods in blocks that share two members; only texts that these
leave in different components are compared across blocks.

Null and empty texts, and texts without words, have no shingles, link with
nothing and are their own component.  Texts with fewer than n words are one
shingle.  Repeated rows stay; each gets its row.  Ids may be of any type that
has an order; rows of one id with different texts each link by their own text.
A row without an id links, but gives its class no id.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import text as T
from .components import connected_components
from .groups import block_pairs, by_group, join_classes, sorted_groups
from .signature_tree import Labels, bitmap, join_group
from .store import settle

#: Documents (by hash of the id) that tell which tokens are frequent, and how many tokens that list may hold.
SAMPLE_DOCS, FREQUENT_TOKENS, FREQUENT_FROM = 40_000, 1 << 18, 3
#: Members of a group that one task joins; larger groups are dealt out.
GROUP, NEIGHBOURHOOD = 16_384, 4_096
#: Text hashes or documents that are broadcast at most (8 or 16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def set_key(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(T.mix64(tokens).sum(dtype=np.uint64) ^ np.uint64(len(tokens) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))))


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def frequent_last(tokens: np.ndarray, frequent: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` of a set in the common order: tokens outside ``frequent``, then the others, each by hash."""
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        late = frequent[at] == tokens
        if late.any():
            return np.concatenate([tokens[~late], tokens[late]])[:count]
    return tokens[:count]


def _frequent_tokens(docs: DataFrame, n: int) -> np.ndarray:
    rate = max(1, -(-docs.count() // SAMPLE_DOCS))

    def run(batches):
        for batch in batches:
            seen = set()
            out = []
            for _, _, data, offsets in T.text_slices(batch.column(0)):
                for s in T.shingle_sets(data, offsets, n):
                    if len(s) and (k := set_key(s)) not in seen:
                        seen.add(k)
                        out.append(s)
            tokens = np.concatenate(out) if out else np.zeros(0, np.uint64)
            tokens, count = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(count)], names=["token", "n"])

    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0).select("text")
    top = sample.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    rows = top.orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(rows.view(np.uint64))


def _profiles(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """id, th, n_shingles, key (null: no shingles), and for the first of a class in its partition prefix and bits."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent_tokens(docs, n))

    def run(batches):
        seen = set()
        for batch in batches:
            size, keys, prefixes, bits = [], [], [], []
            for _, _, data, offsets in T.text_slices(batch.column(2)):
                for s in T.shingle_sets(data, offsets, n):
                    m = len(s)
                    key = set_key(s) if m else None
                    size.append(m)
                    keys.append(key)
                    if key is None or key in seen:
                        prefixes.append(None)
                        bits.append(None)
                    else:
                        seen.add(key)
                        prefixes.append(frequent_last(s, frequent.value, prefix_size(m, num, den)).view(np.int64))
                        bits.append(bitmap(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(keys, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["id", "th", "n_shingles", "key", "prefix", "bits"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return settle(docs.mapInArrow(run, f"id {kind}, th bigint, n_shingles bigint, key bigint, prefix array<bigint>, bits binary"), "profiles")


def _groups(profiles: DataFrame) -> DataFrame:
    """group, key: the classes that share a prefix token, named by the least of them."""
    tokens = profiles.where("prefix is not null").select(F.explode("prefix").alias("token"), "key")
    same = Window.partitionBy("token")
    spans = tokens.select("key", F.min("key").over(same).alias("group"), F.max("key").over(same).alias("last"))
    return spans.where("group <> last").select("group", "key").distinct()


def _neighbourhoods(groups: DataFrame, profiles: DataFrame, num: int, den: int) -> DataFrame:
    """hood, key: classes of a group that the bounds connect, named by a hash of the members' keys; single ones are left out."""

    def run(batches):
        for group in sorted_groups(batches):
            if group.num_rows < 2:
                continue
            keys = group.column("key").to_numpy()
            size = group.column("n_shingles").to_numpy()
            labels = Labels(len(keys))
            join_group([np.frombuffer(b, np.uint64) for b in group.column("bits").to_pylist()], size, num, den, labels)
            root = labels.all()
            order = np.argsort(root, kind="stable")
            hash_of = T.mix64(keys.view(np.uint64))[order]
            cut = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1]]))
            count = np.diff(np.append(cut, len(order)))
            name = np.repeat(np.add.reduceat(hash_of, cut), count).view(np.int64)
            keep = np.repeat(count > 1, count)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(keys[order][keep])], names=["hood", "key"])

    classes = profiles.where("prefix is not null").select("key", "n_shingles", "bits").dropDuplicates(["key"])
    rows = block_pairs(groups, "group", "key", GROUP).select("part", "key").join(classes, "key").select("part", "key", "n_shingles", "bits")
    return settle(by_group(rows, run, "hood bigint, key bigint").distinct(), "neighbourhoods")


def _confirm(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``rows``: part, key, label, text.  Links (a, b) that connect what is connected in a part; equal labels count as connected (null: none)."""

    def run(batches):
        for group in sorted_groups(batches):
            if group.num_rows < 2:
                continue
            keys = group.column("key").to_numpy()
            sets: list[np.ndarray] = []
            for _, _, data, offsets in T.text_slices(group.column("text")):
                sets += T.shingle_sets(data, offsets, n)
            labels = Labels(len(keys))
            first: dict[int, int] = {}
            for i, x in enumerate(group.column("label").to_pylist()):
                if x is not None:
                    labels.join(first.setdefault(x, i), i)
            links = []

            def confirm(i: int, j: int) -> bool:
                a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                if den * both >= num * (len(a) + len(b) - both):
                    links.append((keys[i], keys[j]))
                    return True
                return False

            join_group([bitmap(s) for s in sets], np.array([len(s) for s in sets]), num, den, labels, confirm)
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return by_group(rows, run, "a bigint, b bigint")


def _with_texts(hoods: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each class of ``hoods`` (that of its first document, told by id and hash of the text)."""
    wanted = settle(hoods.select("key").distinct().join(classes, "key").select("key", F.col("first.id").alias("first_id"), F.col("first.th").alias("th")), "wanted")
    hashes = wanted.select("th")
    few = hashes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(hashes) if few else hashes, "th", "left_semi").dropDuplicates(["id", "th"])
    return wanted.join(found, (wanted["th"] == found["th"]) & wanted["first_id"].eqNullSafe(found["id"])).select("key", "text")


def _links(hoods: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    texts = _with_texts(hoods, classes, docs)
    ends = hoods.groupBy("hood").agg(F.count("*").alias("c"), F.min("key").alias("low"), F.max("key").alias("high"))
    large = ends.where(F.col("c") > NEIGHBOURHOOD).select("hood", "low", "high", F.ceil(F.col("c") / NEIGHBOURHOOD).cast("int").alias("blocks"))
    large = settle(large, "large-neighbourhoods")
    small = hoods.join(large, "hood", "left_anti") if (any_large := not large.isEmpty()) else hoods
    none = F.lit(None).cast("bigint")
    rows = small.select(F.col("hood").alias("part"), "key", none.alias("label"))
    if any_large:
        dealt = hoods.join(large, "hood")
        hub = (F.col("key") == F.col("low")) | (F.col("key") == F.col("high"))
        own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int")
        block = F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
        rows = rows.union(dealt.select("hood", "key", block.alias("block")).select(F.xxhash64("hood", "block"), "key", none))
    links = settle(_confirm(rows.join(texts, "key").select("part", "key", "label", "text"), n, num, den), "links")
    if not any_large:
        return links
    # Across blocks: only what isn't in a neighbourhood's largest component yet meets all the others.
    roots = connected_components(links)
    held = hoods.join(large.select("hood", "blocks"), "hood").join(roots.withColumnRenamed("node", "key"), "key", "left")
    held = held.select("hood", "blocks", "key", F.coalesce("root", "key").alias("label"))
    count = held.groupBy("hood", "label").count()
    main = count.groupBy("hood").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    held = settle(held.join(main.select("hood", "main"), "hood").withColumn("own", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int")), "open")
    if held.isEmpty():
        return links
    rest = held.where("label <> main")
    rest_blocks = rest.groupBy("hood").agg(F.ceil(F.count("*") / NEIGHBOURHOOD).cast("int").alias("rests"))
    rest = rest.join(rest_blocks, "hood").withColumn("r", F.pmod(F.xxhash64("key", F.lit(11)), F.col("rests")).cast("int"))
    left = rest.select("hood", "key", "label", "r", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    right = held.join(rest_blocks, "hood").select("hood", "key", "label", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("r"), "own")
    across = left.union(right).select(F.xxhash64("hood", "r", "own").alias("part"), "key", "label").distinct()
    return links.union(_confirm(across.join(texts, "key").select("part", "key", "label", "text"), n, num, den))


def _components(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """id, th, n_shingles and least: null (whether there's no id), id and th of the first document that links reach, null where that is the row's own."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    profiles = _profiles(docs, n, num, den)
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "th")).alias("first")
    classes = settle(profiles.where("key is not null").groupBy("key").agg(first, F.count("*").alias("size")), "classes")
    hoods = _neighbourhoods(_groups(profiles), profiles, num, den)
    roots = connected_components(_links(hoods, classes, docs, n, num, den)).withColumnRenamed("node", "key")
    reach = roots.join(classes, "key").groupBy("root").agg(F.min("first").alias("least"))
    known = roots.join(reach, "root").select("key", "least")
    shared = classes.join(known, "key", "left").where("size > 1 or least is not null")
    shared = settle(shared.select("key", F.coalesce("least", "first").alias("least"), "size"), "shared")
    members = profiles.select("id", "th", "n_shingles", "key")
    return join_classes(members, shared, "key", "size", members.count(), "left")


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles (its set's size) and component_id, the least id that links of Jaccard >= num / den reach (2 num >= den)."""
    out = _components(docs, n, num, den, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("least.id", "id").alias("component_id"))


def one_per_component(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each component of ``docs``, by id (none last), then by a hash of the text; equal rows (id and text) are one document."""
    names = [next(name for n in range(len(docs.columns) + 1) if (name := f"__{x}{n}") not in docs.columns) for x in ("id", "th")]
    found = _components(docs, n, num, den, id_col, text_col)
    later = F.struct(F.col("id").isNull().alias("null"), "id", "th") > F.col("least")
    gone = settle(found.where(later).select(F.col("id").alias(names[0]), F.col("th").alias(names[1])).distinct(), "near-duplicates")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1]))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
