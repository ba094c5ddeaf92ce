"""Communities of a weighted graph by the Leiden method, as joins over written tables.

Nodes move to the neighbouring community with the greatest gain, many at once:
a round's moves stand if they raise the quality, else they are taken back and
fewer nodes move; one node alone always raises it.  Communities are then refined:
starting from single nodes, a node joins a part of its community that doesn't
move itself, so parts are connected.  The parts are the nodes of the next level,
which begins with the communities that they come from.  It ends when no part
joins another; communities that hold several components are split at last.

Quality is that of modularity with a resolution: the weight inside communities
less ``resolution`` times what the nodes' strengths let expect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.io import cut_lineage

#: Gains below this share of all weights are none.
EPS = 1e-12


def _coin(seed: int, turn: int, column: str = "node") -> Column:
    """A number from 0 to 1 by node and turn."""
    return F.pmod(F.xxhash64(F.col(column).cast("string"), F.lit(seed), F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)


def quality(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """The quality of ``labels`` (node, label) over ``edges`` (src, dst, w, each in both directions; a loop once, with twice its weight)."""
    whole = edges.agg(F.sum("w")).first()[0] or 0.0
    if not whole:
        return 0.0
    named = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    row = named.groupBy("a").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    row = row.agg(F.sum("inside"), F.sum(F.col("total") * F.col("total"))).first()
    return row[0] / whole - resolution * row[1] / (whole * whole)


def _touch(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, own, strength, c, w: the weight from each node to each community it touches, without its loop; its own community has a row in any case."""
    to = edges.where("src <> dst").join(nodes.select(F.col("node").alias("dst"), F.col("own").alias("c")), "dst").select(F.col("src").alias("node"), "c", "w")
    none = nodes.select("node", F.col("own").alias("c"), F.lit(0.0).alias("w"))
    return to.unionByName(none).groupBy("node", "c").agg(F.sum("w").alias("w")).join(nodes, "node").select("node", "own", "strength", "loop", "c", "w")


def _moves(edges: DataFrame, nodes: DataFrame, resolution: float, whole: float, seed: int) -> DataFrame:
    """``nodes`` (node, own, strength, loop) after moves between communities until none gains.

    A round moves nodes to lower-named communities only, or to higher-named ones
    if more want that, so no two change places.
    """
    best, share, turn, kept, proposed, lower, wanted = None, 0.5, 0, nodes, None, True, 0
    loops = nodes.agg(F.sum("loop")).first()[0] or 0.0
    while True:
        state = cut_lineage(_touch(edges, nodes))
        totals = cut_lineage(state.where("c = own").groupBy("c").agg(F.sum("w").alias("inside"), F.sum("strength").alias("total")))
        inside, squares = totals.agg(F.sum("inside"), F.sum(F.col("total") * F.col("total"))).first()
        now = (inside + loops) / whole - resolution * squares / (whole * whole)
        if best is not None and now <= best + EPS:
            if share == 0.0:  # not even the best move gains
                return kept
            share = share / 2 if share * wanted > 2 else 0.0
        else:
            best, kept = now, nodes
            here = state.where("c = own").join(totals, "c").select("node", "own", (F.col("w") - resolution * F.col("strength") * (F.col("total") - F.col("strength")) / whole).alias("stay"))
            there = state.where("c <> own").join(totals, "c").select("node", "c", (F.col("w") - resolution * F.col("strength") * F.col("total") / whole).alias("go"))
            choice = there.groupBy("node").agg(F.max(F.struct("go", (-F.col("c")).alias("c"))).alias("x")).join(here, "node")
            gain = F.col("x.go") - F.col("stay")
            proposed = cut_lineage(choice.select("node", "own", (-F.col("x.c")).alias("c"), gain.alias("gain")).where(F.col("gain") > EPS * whole))
            every, down = proposed.agg(F.count("*"), F.count(F.when(F.col("c") < F.col("own"), 1))).first()
            if not every:
                return kept
            lower, wanted = 2 * down >= every, max(down, every - down)
            share = min(0.5, share * 2) or 0.5
        turn += 1
        way = F.col("c") < F.col("own") if lower else F.col("c") > F.col("own")
        movers = proposed.orderBy(F.desc("gain"), "node").limit(1) if share == 0.0 else proposed.where(way & (_coin(seed, turn) < share))
        nodes = cut_lineage(kept.join(movers.select("node", "c"), "node", "left").select("node", F.coalesce("c", "own").alias("own"), "strength", "loop"))


def _refined(edges: DataFrame, nodes: DataFrame, resolution: float, whole: float, seed: int) -> DataFrame:
    """node, part, own: connected parts of each community, named by one of their nodes.

    A round tosses a coin per node.  A single one may join a part that stays in
    this round and that it is tied to by more than expectation; parts of several
    nodes never move.
    """
    inner = edges.where("src <> dst").join(nodes.select(F.col("node").alias("src"), F.col("own").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("own").alias("b")), "dst").where("a = b").select("src", "dst", "w")
    inner = cut_lineage(inner)
    parts = nodes.select("node", "own", "strength", F.col("node").alias("part"))
    quiet, turn = 0, 0
    while quiet < 2:
        turn += 1
        sizes = parts.groupBy("part").agg(F.count("*").alias("size"), F.sum("strength").alias("total"))
        flag = parts.join(sizes, "part").withColumn("mover", (F.col("size") == 1) & (_coin(seed, 1000 + turn) < 0.5))
        flag = cut_lineage(flag)
        to = inner.join(flag.where("mover").select(F.col("node").alias("src"), "strength"), "src").join(flag.where("not mover").select(F.col("node").alias("dst"), F.col("part").alias("target"), "total"), "dst")
        gain = F.sum("w") - resolution * F.first("strength") * F.first("total") / whole
        best = to.groupBy("src", "target").agg(gain.alias("gain")).where(F.col("gain") > EPS * whole).groupBy("src").agg(F.max(F.struct("gain", (-F.col("target")).alias("t"))).alias("x"))
        moved = cut_lineage(best.select(F.col("src").alias("node"), (-F.col("x.t")).alias("to")))
        if not moved.limit(1).count():
            quiet += 1  # other coins may still find one
            continue
        quiet = 0
        parts = cut_lineage(parts.join(moved, "node", "left").select("node", "own", "strength", F.coalesce("to", "part").alias("part")))
    return parts.select("node", "part", "own")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component; ``edges``: src, dst in both directions.

    A round takes the least label around, then the label's own: far nodes meet in few rounds.
    """
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    while True:
        around = edges.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(around, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("to"))
        new = cut_lineage(new)
        jump = new.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = cut_lineage(new.join(jump, "to", "left").select("node", "label", F.least("to", F.coalesce("further", "to")).alias("to")))
        done = not new.where("to <> label").limit(1).count()
        labels = new.select("node", F.col("to").alias("label"))
        if done:
            return labels


def leiden(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """node, cluster (from 0, by falling size, ties by the least node): connected communities.

    ``edges``: src, dst, w > 0, in both directions (node ids of an integer type);
    ``nodes`` adds those without edges, which are communities of their own.
    """
    edges = cut_lineage(edges.groupBy(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).agg(F.sum("w").alias("w")))
    every = edges.select(F.col("src").alias("node")).distinct()
    if nodes is not None:
        every = every.union(nodes.select(F.col(nodes.columns[0]).cast("bigint"))).distinct()
    every = cut_lineage(every)
    whole = edges.agg(F.sum("w")).first()[0]
    if not whole:
        return _numbered(every.select("node", F.col("node").alias("label")))
    strengths = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("strength"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("loop"))
    start = cut_lineage(every.join(strengths, "node", "left").select("node", F.col("node").alias("own"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce("loop", F.lit(0.0)).alias("loop")))
    labels, best = None, None
    while True:
        found = cut_lineage(_levels(edges, start, resolution, whole, seed))
        now = quality(edges, found, resolution)
        if best is not None and now <= best + EPS:
            break
        labels, best, seed = found, now, seed + 1000
        # Again, from the communities found, each named by its least node, as long as that gains.
        names = labels.join(labels.groupBy("label").agg(F.min("node").alias("own")), "label").select("node", "own")
        start = cut_lineage(start.drop("own").join(names, "node").select("node", "own", "strength", "loop"))
    inside = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b and src <> dst").select("src", "dst")
    return _numbered(components(cut_lineage(inside), every))


def _levels(edges: DataFrame, level: DataFrame, resolution: float, whole: float, seed: int) -> DataFrame:
    """node, label: moves, refinement and aggregation from the communities of ``level`` (node, own, strength, loop) until no part joins another."""
    labels = level.select("node", F.col("node").alias("at"))
    for depth in range(64):  # each level has fewer nodes than the one before
        moved = _moves(edges, level, resolution, whole, seed + depth)
        parts = cut_lineage(_refined(edges, moved, resolution, whole, seed + depth))
        size = parts.agg(F.count("*"), F.countDistinct("part"), F.countDistinct("own")).first()
        if size[1] == size[0] or size[2] == size[0]:
            labels = labels.join(parts.select(F.col("node").alias("at"), F.col("own").alias("label")), "at").select("node", "label")
            break
        labels = cut_lineage(labels.join(parts.select(F.col("node").alias("at"), "part"), "at").select("node", F.col("part").alias("at")))
        names = parts.select("node", "part")
        joined = edges.join(names.select(F.col("node").alias("src"), F.col("part").alias("a")), "src").join(names.select(F.col("node").alias("dst"), F.col("part").alias("b")), "dst")
        edges = cut_lineage(joined.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        totals = moved.join(names, "node").groupBy(F.col("part").alias("node")).agg(F.sum("strength").alias("strength"))
        # A community is named by a node of its own level, and the next level has only the parts' names: take the least part's.
        owner = parts.select("part", "own").distinct()
        owner = owner.join(owner.groupBy("own").agg(F.min("part").alias("name")), "own").select(F.col("part").alias("node"), F.col("name").alias("own"))
        loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("w").alias("loop"))
        level = cut_lineage(totals.join(owner, "node").join(loops, "node", "left").select("node", "own", "strength", F.coalesce("loop", F.lit(0.0)).alias("loop")))
    else:
        labels = labels.withColumnRenamed("at", "label")
    return labels


def _numbered(labels: DataFrame) -> DataFrame:
    """Labels as numbers from 0 by falling size, then by the label."""
    from .stats import with_global_rank

    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    # Two keys in one: labels of a size follow each other by their own rank.
    ranked = with_global_rank(sizes, "label", "rank").withColumn("key", -F.col("size").cast("double") + F.col("rank") / (2.0 * sizes.count() + 2))
    ranked = with_global_rank(ranked, "key", "cluster").select("label", (F.col("cluster") - 1).cast("bigint").alias("cluster"))
    return labels.join(ranked, "label").select("node", "cluster")


def cluster_observations(counts: DataFrame, top: int = 2000, n_components: int = 10, n_neighbors: int = 15, resolution: float = 0.4, seed: int = 0) -> DataFrame:
    """obs, cluster (from 0, by falling size): communities of the fuzzy neighbour graph of log-normalised counts.

    ``counts``: obs, gene, value; the ``top`` genes by normalised dispersion give
    ``n_components`` principal components; ``n_neighbors`` counts the point
    itself.  Observations without any of these genes have no cluster.
    """
    from . import embed, matrix

    log = cut_lineage(matrix.log_normalize(counts))
    genes = matrix.highly_variable_genes(log, log.select("obs").distinct().count(), top).select("gene")
    scores, _, _ = embed.pca(log.join(genes, "gene", "left_semi"), n_components)
    scores = cut_lineage(scores)
    near = cut_lineage(embed.nearest(scores, n_neighbors - 1))
    graph = cut_lineage(embed.fuzzy_graph(near.select("obs", "neighbor", "distance"), n_neighbors))
    names = scores.select("obs", _node(scores).alias("node"))
    if names.select(F.countDistinct("node") < F.count("*")).first()[0]:
        raise ValueError("observations repeat, or two of them share a hash")
    a, b = names.select(F.col("obs").alias("src"), F.col("node").alias("a")), names.select(F.col("obs").alias("dst"), F.col("node").alias("b"))
    edges = graph.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    return leiden(edges, names.select("node"), resolution, seed).join(names, "node").select("obs", "cluster")


def _node(rows: DataFrame) -> Column:
    """An integer for each observation: itself, or its hash."""
    whole = rows.schema["obs"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.col("obs").cast("bigint") if whole else F.xxhash64("obs")
