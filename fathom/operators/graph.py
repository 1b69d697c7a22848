"""Dependency graphs: resolving names to edges, neighbours, PageRank, ordering, version ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import scalars
from fathom.storage import BROADCAST_IDS, bucketed, forget, small, stored

#: A node with more edges out than this is a hub: its rank goes to the tasks that have its edges' ends, not to each end.
HUB = 64
#: With more nodes than this, ranks are joined by hash tables of their buckets; with fewer, Spark may broadcast them.
MANY_NODES = 100_000


def resolved_edges(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(src, dst, state) of symbols (id, symbol) and wanted names (src, name).

    A name is a symbol itself, or else the last segment of exactly one row; several rows make it ambiguous,
    none unresolved, and a node's reference to itself is self.
    """
    exact = symbols.groupBy("symbol").agg(F.min("id").alias("exact"))
    last = F.element_at(F.split("symbol", r"\."), -1)
    tails = symbols.groupBy(last.alias("tail")).agg(F.count("*").alias("n"), F.min("id").alias("by_tail"))
    rows = wanted.join(exact, wanted["name"] == exact["symbol"], "left").join(tails, F.element_at(F.split("name", r"\."), -1) == tails["tail"], "left")
    dst = F.coalesce("exact", F.when(F.col("n") == 1, F.col("by_tail")))
    state = F.when(dst == F.col("src"), "self").when(dst.isNotNull(), "edge").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return rows.select("src", "name", dst.alias("dst"), state.alias("state"))


def neighbours(edges: DataFrame, most: int = 50, most_out: int | None = None) -> DataFrame:
    """(id, dependents, dependencies): sorted different neighbours; `most` dependents at most, and all dependencies unless most_out is set."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.slice(F.array_sort(F.collect_set("src")), 1, most).alias("dependents"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))
    if most_out is not None:
        out = out.withColumn("dependencies", F.slice("dependencies", 1, most_out))
    empty = F.array().cast("array<bigint>")
    return into.join(out, "id", "full").select("id", F.coalesce("dependents", empty).alias("dependents"), F.coalesce("dependencies", empty).alias("dependencies"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank). Ranks of nodes without edges out are dealt out evenly; stops when the change per node is below the tolerance.

    The change is looked at every fourth round; raises if it is still above after all rounds. A tolerance of 0 asks for all rounds.
    A round is one job, which also sums up the rank of nodes without edges out in the round before; older rounds are deleted.
    Edges are dealt out twice before the rounds, all by their source and those of hubs by their end too, and stay where they are: a round shuffles ranks only, and
    for each task and end one sum of what the sources there give it.
    """
    n_parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = bucketed(edges.select("src", "dst").repartition(n_parts, "src").distinct(), "links", "src")
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    nodes = stored(nodes.select("id").distinct().join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")), "nodes")
    if not (n := nodes.count()):
        return nodes.select("id", F.lit(0.0).alias("rank"))
    hubs = nodes.where(F.col("degree") > HUB).select(F.col("id").alias("src"))
    few = 0 < hubs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    spread = bucketed(links.join(F.broadcast(hubs), "src", "left_semi"), "hub-links", "dst") if few else None
    rank, moved = stored(nodes.select("id", "degree", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("change")), "rank"), 0.0
    for i in range(rounds):
        share = rank.where("degree > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("share"), (F.col("degree") > HUB).alias("hub"))
        by_source = share.where("NOT hub") if few else share
        shared = links.join(by_source.hint("shuffle_hash") if n > MANY_NODES else by_source, "src").groupBy("dst").agg(F.sum("share").alias("got"))
        new = rank.join(shared.withColumnRenamed("dst", "id"), "id", "left")
        got = F.coalesce("got", F.lit(0.0))
        if few:
            from_hubs = spread.join(F.broadcast(share.where("hub")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("more"))
            new, got = new.join(from_hubs, "id", "left"), got + F.coalesce("more", F.lit(0.0))
        lost = F.broadcast(rank.where("degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")))  # one row
        value = alpha * (got + F.col("lost") / n) + (1 - alpha) / n
        before, rank = rank, stored(new.crossJoin(lost).select("id", "degree", value.alias("rank"), F.abs(value - F.col("rank")).alias("change")), "rank")
        forget(before)
        if tolerance and (i % 4 == 3 or i == rounds - 1):
            moved = rank.agg(F.sum("change")).first()[0]
            if moved < n * tolerance:
                break
    else:
        if tolerance:
            raise RuntimeError(f"ranks still change by {moved} after {rounds} rounds")
    return rank.select("id", "rank")


def hubs(ranks: DataFrame, nodes: DataFrame, top: int = 20) -> DataFrame:
    """(file, pagerank) of the files whose nodes (id, file) have most rank (id, rank) together."""
    sums = ranks.join(nodes.select("id", F.coalesce("file", F.lit("unknown")).alias("file")), "id").groupBy("file").agg(F.round(F.sum("rank"), 6).alias("pagerank"))
    return sums.orderBy(F.desc("pagerank"), "file").limit(top)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Topological levels: (id, level) of the nodes (id) whose dependencies (src needs dst) are all on lower levels; a node in or behind a cycle has none."""
    left = stored(nodes.select("id").distinct(), "left")
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    out, level = left.limit(0).withColumn("level", F.lit(0)), 0
    while True:
        blocked = edges.join(left.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        free = stored(left.join(blocked, "id", "left_anti"), "free")
        if free.isEmpty():
            return out
        out, level = out.unionByName(free.withColumn("level", F.lit(level))), level + 1
        left = stored(left.join(free, "id", "left_anti"), "left")


def in_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the nodes that have no topological level: those in a cycle, and those that need one."""
    return nodes.select("id").distinct().join(levels(nodes, edges), "id", "left_anti")


def components(pairs: DataFrame) -> DataFrame:
    """(id, comp) of the ends of pairs (a, b): comp is the greatest node that pairs lead to, whichever way they are read.

    Labels go to neighbours and then to their labels' labels, so the rounds grow with the logarithm of the longest path.
    """
    both = stored(pairs.select("a", "b").union(pairs.select("b", "a")), "both")
    comps = stored(both.groupBy(F.col("a").alias("id")).agg(F.max("b").alias("near")).select("id", F.greatest("id", "near").alias("comp")), "comps")
    while True:
        near = both.join(comps.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.max("comp").alias("near"))
        step = comps.join(near, "id").select("id", F.col("comp").alias("was"), F.greatest("comp", "near").alias("next"))
        above = step.join(comps.select(F.col("id").alias("next"), F.col("comp").alias("above")), "next")
        before, comps = comps, stored(above.select("id", F.greatest("next", "above").alias("comp"), (F.greatest("next", "above") > F.col("was")).alias("moved")), "comps")
        forget(before)
        moved, comps = comps.where("moved").limit(1).count(), comps.select("id", "comp")
        if not moved:
            forget(both)
            return comps


def _links(edges: DataFrame, back: str | None) -> DataFrame:
    """(a, b, up, down): two neighbours a <= b once, whether an edge leads from a to b, and from b to a. A node's edge to itself or to null is (a, a), without either."""
    way = lambda x, y: F.coalesce(F.col(x) < F.col(y), F.lit(False))
    also = F.coalesce(F.col(back), F.lit(False)) if back else F.lit(False)
    up, down = way("src", "dst"), way("dst", "src")
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (up | (down & also)).alias("up"), (down | (up & also)).alias("down"))
    return ends.where("a IS NOT NULL").groupBy("a", "b").agg(F.max("up").alias("up"), F.max("down").alias("down"))


def _seen(links: DataFrame) -> DataFrame:
    """(id, inner, high, low) of the ends of links: whether edges lead in and out; the greatest and the least neighbour with edges both ways."""
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("other"), F.col("up").alias("out"), F.col("down").alias("into")).union(links.select("b", "a", "down", "up"))
    mutual = F.when(F.col("out") & F.col("into"), F.col("other"))
    return ends.groupBy("id").agg((F.max("out") & F.max("into")).alias("inner"), F.max(mutual).alias("high"), F.min(mutual).alias("low"))


def _merged(links: DataFrame, comps: DataFrame) -> DataFrame:
    """links (see _links) between different components of nodes (id, comp); those of other nodes are left out."""
    ends = links.where("a <> b").join(comps.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b").join(comps.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a").where("x <> y")
    turn = F.col("x") > F.col("y")
    ends = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(turn, F.col("down")).otherwise(F.col("up")).alias("up"), F.when(turn, F.col("up")).otherwise(F.col("down")).alias("down"))
    return ends.groupBy("a", "b").agg(F.max("up").alias("up"), F.max("down").alias("down"))


def _coloured(left: DataFrame) -> DataFrame:
    """(id, comp) of some components of edges (src, dst), where all nodes have edges in and out.

    Each node takes the greatest node that reaches it as its colour, and those of a colour that reach its own node are a component.
    Both walks go on from what changed until nothing does, so rounds follow the longest shortest path; a round is stored, and the one before is deleted.
    """
    colour = stored(left.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("colour"), F.lit(True).alias("moved")), "colour")
    while True:
        reached = left.join(colour.where("moved").select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("near"))
        new = colour.join(reached, "id", "left").select("id", F.greatest("colour", "near").alias("colour"), F.coalesce(F.col("near") > F.col("colour"), F.lit(False)).alias("moved"))
        before, colour = colour, stored(new, "colour")
        forget(before)
        if not colour.where("moved").limit(1).count():
            break
    # Within a colour, from its own node against the edges.
    inside = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst")
    inside = stored(inside.where("cs = cd").select("src", "dst"), "inside")
    found = newest = stored(colour.where("id = colour").select("id", F.col("colour").alias("comp")), "found")
    while True:
        back = inside.join(newest.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "comp").distinct()
        newest = stored(back.join(found, "id", "left_anti"), "newest")
        if newest.isEmpty():
            forget(inside)
            return found
        before, found = found, stored(found.union(newest), "found")
        forget(before)


def strong_components(edges: DataFrame, back: str | None = None) -> DataFrame:
    """(id, comp) of the nodes of edges (src, dst): comp is the greatest node that a node reaches and is reached by (itself, if no other).

    back: a boolean column, true for edges that lead back as well. Null ends are left out.

    Two nodes with edges both ways are in one component. So a round drops nodes without edges in or out among those left, which are components
    of their own, and makes one node of all that are joined by such pairs: first by each node's pairs with its greatest and its least neighbour,
    which are two a node, however many edges there are. At least half of the nodes that have a pair are merged in a round.
    Where no pair is left and no node to drop, colours find components of longer cycles, which are taken out.
    """
    links, maps, nodes = stored(_links(edges, back), "links"), [], None
    while True:
        seen = stored(_seen(links), "seen")
        nodes = seen if nodes is None else nodes
        inner, outer, paired = seen.agg(F.count_if("inner"), F.count_if(~F.col("inner")), F.count("high")).first()
        if not inner:
            break
        before = links
        if paired:
            pairs = seen.where("high IS NOT NULL")
            comps = components(pairs.select(F.col("id").alias("a"), F.col("high").alias("b")).union(pairs.where("low < high").select("id", "low")))
            maps.append(comps.where("id <> comp"))
            comps = seen.where("inner").select("id").join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
            links = stored(_merged(links, small(stored(comps, "comps"), BROADCAST_IDS // 4)), "links")
        elif outer:
            kept = small(stored(seen.where("inner").select("id"), "inner"))
            links = stored(links.join(kept.withColumnRenamed("id", "b"), "b", "left_semi").join(kept.withColumnRenamed("id", "a"), "a", "left_semi").where("a <> b").select("a", "b", "up", "down"), "links")
        else:
            found = _coloured(stored(links.select(F.when(F.col("up"), F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("up"), F.col("b")).otherwise(F.col("a")).alias("dst")), "edges"))
            maps.append(found.where("id <> comp"))
            links = stored(links.join(found.select(F.col("id").alias("b")), "b", "left_anti").join(found.select(F.col("id").alias("a")), "a", "left_anti").select("a", "b", "up", "down"), "links")
        forget(before)
        if seen is not nodes:
            forget(seen)
    nodes = nodes.select("id", F.col("id").alias("comp"))
    for i, found in enumerate(maps):  # each map's nodes are components of the maps before
        nodes = nodes.join(found.select(F.col("id").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"))
        nodes = stored(nodes, "nodes") if i % 8 == 7 else nodes
    return nodes


def cycles(edges: DataFrame) -> DataFrame:
    """(id, comp) of the nodes that lie on a cycle themselves: components of several nodes, and nodes with an edge to themselves."""
    comps = stored(strong_components(edges), "components")
    large = comps.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").select("comp")
    own = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    return comps.join(large, "comp", "left_semi").select("id", "comp").union(comps.join(own, "id", "left_semi").select("id", "comp")).distinct()


def version_range(spec: Column, zero_minor: bool = True) -> Column:
    """Half-open (low, high) of ^1.2.3, ~1.2.3, >=1.2.3 or 1.2.3. ^0.0.3 allows nothing but itself, or all of 0.0 if not zero_minor."""
    op, v = F.regexp_extract(spec, r"^(\^|~|>=)?", 1), scalars.semver(F.regexp_replace(spec, r"^(\^|~|>=)", ""))
    make = lambda a, b, c: F.struct(a.cast("int").alias("major"), b.cast("int").alias("minor"), c.cast("int").alias("patch"))
    z, top = F.lit(0), F.lit(2**31 - 1)
    caret = F.when(v["major"] > 0, make(v["major"] + 1, z, z)).when((v["minor"] > 0) | (not zero_minor), make(z, v["minor"] + 1, z)).otherwise(make(z, z, v["patch"] + 1))
    high = F.when(op == "^", caret).when(op == "~", make(v["major"], v["minor"] + 1, z)).when(op == ">=", make(top, z, z)).otherwise(make(v["major"], v["minor"], v["patch"] + 1))
    return F.when(v.isNotNull(), F.struct(v.alias("low"), high.alias("high")))


def conflicts(requirements: DataFrame) -> DataFrame:
    """Pairs of different ranges (dep, spec) that no version meets, of one dependency: (dep, a, b)."""
    ranges = requirements.select("dep", "spec").distinct().withColumn("r", version_range(F.col("spec")))
    a, b = ranges.alias("a"), ranges.alias("b")
    meet = (F.col("a.r.low") < F.col("b.r.high")) & (F.col("b.r.low") < F.col("a.r.high"))
    return a.join(b, (F.col("a.dep") == F.col("b.dep")) & (F.col("a.spec") < F.col("b.spec")) & ~meet).select("a.dep", F.col("a.spec").alias("a"), F.col("b.spec").alias("b"))
