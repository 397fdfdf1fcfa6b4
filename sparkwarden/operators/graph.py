"""Iterative graph operators: loops of joins whose state is a table in shared storage.

Every round reads the state that the round before wrote, so plans stay short and a lost
executor costs one round at most.  A loop ends when its state no longer changes; each of
its rounds adds, removes or settles a node, so it always ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import counted, forget, stored

#: Rounds of longest_path, which cycles would keep going.
MAX_ROUNDS = 1024
#: Levels that a loop takes one by one before it contracts what is left.
PLAIN_ROUNDS = 8
#: Ways from the starts of cycles that a round looks at: for each link, and in any case.
WAYS_PER_LINK, FEW_WAYS = 4, 1_000_000


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").distinct()


def contracted(links: DataFrame, keep: DataFrame | None, pick) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Takes all nodes with a single inbound link out of a graph.

    links (source, target, w), one a pair; keep (node_id): nodes that stay in any case; pick:
    which of parallel links' weights stands (F.min or F.max).  Returns followers (node_id,
    anchor, off: the way to the nearest node above that stays), lost (node_id: those that hang
    on a loop of such nodes), the links between what stays and from lost nodes, and how many
    nodes were taken out.

    Pointers are doubled: a chain of n nodes takes about log2(n) rounds.
    """
    single = links.groupBy("target").agg(F.count("*").alias("k"), F.min("source").alias("anchor"), F.min("w").alias("off")).where("k = 1").select(F.col("target").alias("node_id"), "anchor", "off")
    if keep is not None:
        single = single.join(keep.select("node_id"), "node_id", "left_anti")
    state, seen = counted(single.withColumn("done", F.lit(False)), "followers", n=F.count(F.lit(1)))
    n, before, left = seen["n"], None, seen["n"]
    while left and left != before:
        before = left
        ahead = state.select(F.col("node_id").alias("anchor"), F.col("anchor").alias("next"), F.col("off").alias("more"))
        jumped = state.where("not done").join(ahead, "anchor", "left").select("node_id", F.coalesce("next", "anchor").alias("anchor"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), F.col("next").isNull().alias("done"))
        after, seen = counted(jumped.unionByName(state.where("done")), "followers", left=F.count_if(~F.col("done")))
        forget(state)
        state, left = after, seen["left"]
    followers, lost = state.where("done").select("node_id", "anchor", "off"), state.where("not done").select("node_id")
    above = followers.select(F.col("node_id").alias("source"), "anchor", "off")
    rest = links.join(state.select(F.col("node_id").alias("target")), "target", "left_anti").join(above, "source", "left")
    rest = rest.select(F.coalesce("anchor", "source").alias("source"), "target", (F.col("w") + F.coalesce("off", F.lit(0))).alias("w"))
    return followers, lost, stored(rest.groupBy("source", "target").agg(pick("w").alias("w")), "links"), n


def _contracted_fully(links: DataFrame, keep: DataFrame | None, pick) -> tuple[list[DataFrame], DataFrame]:
    """contracted() for as long as it takes out a tenth of the nodes with an inbound link; what
    lost nodes lead to is left out with them."""
    levels = []
    while True:
        size = links.select("target").distinct().count()
        followers, lost, rest, n = contracted(links, keep, pick)
        levels.append(followers)
        links = rest.join(lost.select(F.col("node_id").alias("source")), "source", "left_anti")
        if n * 10 < size or n == size:
            return levels, stored(links, "links")


def _expanded(depths: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Depths of the nodes that stayed -> of the followers too; those of unreached ones lack."""
    for followers in reversed(levels):
        above = depths.select(F.col("node_id").alias("anchor"), "depth")
        depths = stored(depths.unionByName(followers.join(above, "anchor").select("node_id", (F.col("depth") + F.col("off")).alias("depth"))), "depths")
    return depths


def _settled(state: DataFrame, links: DataFrame, pick) -> DataFrame:
    """state (node_id, depth, moved), links (source, target and, if depths grow, w): depths that
    no link improves.  Only nodes that moved in the round before have anything new to push."""
    value = F.col("depth") + F.col("w") if "w" in links.columns else F.col("depth")
    while True:
        pushed = state.where("moved").join(links, state.node_id == links.source).select(F.col("target").alias("node_id"), value.alias("depth"), F.lit(True).alias("moved"))
        both = pushed.unionByName(state.select("node_id", "depth", F.lit(False).alias("moved")))
        best = both.groupBy("node_id").agg(pick("depth").alias("depth"), pick(F.when(~F.col("moved"), F.col("depth"))).alias("had"))
        after, seen = counted(best.select("node_id", "depth", (F.col("had").isNull() | (F.col("had") != F.col("depth"))).alias("moved")), "depths", moved=F.count_if("moved"))
        forget(state)
        state = after
        if not seen["moved"]:
            return state.select("node_id", "depth")


def reach(edges: DataFrame, starts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Breadth-first reachability: node_id, depth.  Starts that are no node are left out
    where nodes are given.

    Level by level at first; a graph that is deeper is then contracted, so that chains and
    trees of any depth take rounds by the logarithm of it.  What stays is a round a level of
    nodes with several inbound links.
    """
    seed = starts.select("node_id").distinct()
    if nodes is not None:
        seed = seed.join(nodes.select("node_id").distinct(), "node_id", "left_semi")
    seen = stored(seed.withColumn("depth", F.lit(0)), "reach")
    # Links from nodes that no start is and nothing leads to are never taken.
    raw = edges.select("source", "target")
    taken = seen.select(F.col("node_id").alias("source")).union(raw.select("target")).distinct()
    links = stored(raw.join(taken, "source", "left_semi").distinct(), "links")
    frontier = seen
    for depth in range(1, PLAIN_ROUNDS + 1):
        found = frontier.join(links, frontier.node_id == links.source).select(F.col("target").alias("node_id")).distinct()
        frontier, new = counted(found.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(depth)), "reach", n=F.count(F.lit(1)))
        if not new["n"]:
            forget(links, frontier)
            return seen
        seen = seen.union(frontier)
    seen = stored(seen, "reach")
    # Nothing beyond hangs on what stands before the frontier.
    beyond = links.join(seen.select(F.col("node_id").alias("target")), "target", "left_anti").where("source <> target").withColumn("w", F.lit(1))
    levels, rest = _contracted_fully(stored(beyond, "links"), None, F.min)
    forget(links)
    far = _settled(stored(frontier.withColumn("moved", F.lit(True)), "depths"), rest, F.min)
    return seen.unionByName(_expanded(far, levels).join(seen, "node_id", "left_anti"))


def peel(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes left when nodes without an incoming edge are removed again and again: those on
    a cycle and all behind one.  node_id.  Deep graphs are contracted on the way."""
    alive = nodes.select("node_id").distinct()
    return _peeled(stored(alive, "peel"), stored(_links(edges).withColumn("w", F.lit(1)), "links"), None, PLAIN_ROUNDS)


def _peeled(alive: DataFrame, links: DataFrame, sure: DataFrame | None, rounds: int) -> DataFrame:
    """alive without what a removal round after another takes; links from sure nodes, which are
    not among alive, hold their targets in any case."""
    n = large = alive.count()
    for k in range(rounds):
        holders = alive if sure is None else alive.union(sure)
        held = links.join(holders, links.source == holders.node_id, "left_semi").select(F.col("target").alias("node_id")).distinct()
        still, seen = counted(alive.join(held, "node_id", "left_semi"), "peel", n=F.count(F.lit(1)))
        forget(alive)
        alive = still
        if seen["n"] == n:
            forget(links)
            return alive
        n = seen["n"]
        # Links go with their ends, but not every round.
        if n * 2 < large or k == rounds - 1:
            holders = alive if sure is None else alive.union(sure)
            inside = stored(links.join(holders, links.source == holders.node_id, "left_semi").join(alive.select(F.col("node_id").alias("target")), "target", "left_semi"), "links")
            forget(links)
            links, large = inside, n
    followers, lost, rest, taken = contracted(links, None, F.min)
    if taken * 10 < n:
        return _peeled(alive, links, sure, 2 * rounds)
    held = lost if sure is None else lost.union(sure)
    stay = stored(alive.join(followers.select("node_id").union(lost), "node_id", "left_anti"), "peel")
    left = _peeled(stay, rest, stored(held, "peel"), rounds)
    above = left if sure is None else left.union(sure)
    hung = followers.join(above.select(F.col("node_id").alias("anchor")), "anchor", "left_semi").select("node_id")
    return stored(left.union(lost).union(hung), "peel")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of the graph induced by the nodes: node_id, component (least member)."""
    n = nodes.select("node_id").distinct()
    inside = edges.select("source", "target").join(n.withColumnRenamed("node_id", "source"), "source", "left_semi").join(n.withColumnRenamed("node_id", "target"), "target", "left_semi")
    groups = connected_components(inside.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return n.join(groups.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def islands(components: DataFrame, isolated: DataFrame, cyclic: DataFrame) -> DataFrame:
    """component, size, kind: isolated_module (all members allow it), cyclic_island, orphan_subgraph."""
    c = components.join(isolated.select("node_id").distinct().withColumn("i", F.lit(True)), "node_id", "left").join(cyclic.select("node_id").distinct().withColumn("c", F.lit(True)), "node_id", "left")
    flags = c.groupBy("component").agg(F.count("*").alias("size"), F.bool_and(F.coalesce("i", F.lit(False))).alias("i"), F.bool_or(F.coalesce("c", F.lit(False))).alias("c"))
    return flags.select("component", "size", F.when(F.col("i"), "isolated_module").when(F.col("c"), "cyclic_island").otherwise("orphan_subgraph").alias("kind"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, component (least member) of strongly connected components.

    Forward colouring: every node takes the least node that reaches it; within a colour the
    nodes that reach the colour's root are its component; they are taken out and the rest
    goes on.  Orzan (2004).
    """
    spark = nodes.sparkSession
    rest = stored(nodes.select("node_id").distinct(), "scc")
    links = stored(edges.select("source", "target").where("source <> target").distinct(), "links")
    done: list[DataFrame] = []
    while not rest.isEmpty():
        live = peel(rest, links)
        live = peel(live, links.select(F.col("target").alias("source"), F.col("source").alias("target")).join(live.withColumnRenamed("node_id", "source"), "source", "left_semi"))
        done.append(stored(rest.join(live, "node_id", "left_anti").withColumn("component", F.col("node_id")), "scc-done"))
        if live.isEmpty():
            break
        inside = links.join(live.withColumnRenamed("node_id", "source"), "source", "left_semi").join(live.withColumnRenamed("node_id", "target"), "target", "left_semi")
        links = stored(inside.select("source", "target"), "links")
        start = live.select("node_id", F.col("node_id").alias("depth"), F.lit(True).alias("moved"))
        colour = _settled(stored(start, "colour"), links, F.min).withColumnRenamed("depth", "colour")
        same = links.join(colour.select(F.col("node_id").alias("source"), F.col("colour").alias("cs")), "source").join(colour.select(F.col("node_id").alias("target"), F.col("colour").alias("ct")), "target").where("cs = ct")
        roots = colour.where("node_id = colour").select("node_id")
        back = reach(same.select(F.col("target").alias("source"), F.col("source").alias("target")), roots)
        found = stored(colour.join(back.select("node_id"), "node_id", "left_semi").select("node_id", F.col("colour").alias("component")), "scc-done")
        done.append(found)
        rest, left = counted(live.join(found, "node_id", "left_anti"), "scc", n=F.count(F.lit(1)))
        if not left["n"]:
            break
        links = stored(links.join(rest.withColumnRenamed("node_id", "source"), "source", "left_semi").join(rest.withColumnRenamed("node_id", "target"), "target", "left_semi").select("source", "target"), "links")
    out = spark.createDataFrame([], nodes.select("node_id", F.col("node_id").alias("component")).schema)
    for d in done:
        out = out.union(d)
    return out


def longest_path(nodes: DataFrame, edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """node_id, depth: most edges of a path that ends there.  On and behind cycles, where paths
    have no end, it is the number of nodes or rounds, whichever is less.

    Relaxation, at first level by level; what then still moves is contracted as in reach.
    """
    n, seen = counted(nodes.select("node_id").distinct(), "nodes", n=F.count(F.lit(1)))
    raw = edges.select("source", "target").where("source <> target")
    # Without links from elsewhere, which is the rule, no join has to look for them.
    strange, figures = counted(raw.select(F.col("source").alias("node_id")).distinct().join(n, "node_id", "left_anti"), "strange", n=F.count(F.lit(1)))
    if figures["n"]:
        raw = raw.join(strange.withColumnRenamed("node_id", "source"), "source", "left_anti")
    # Who ends a path of k + 1 links ends one of k too: of the links only those from such nodes
    # are kept, and a node's depth is the number of rounds that it was in.
    moved, figures = counted(raw.select(F.col("target").alias("node_id")).distinct().join(n, "node_id", "left_semi"), "moved", n=F.count(F.lit(1)))
    rounds_of, left = [moved], raw
    for _ in range(PLAIN_ROUNDS - 1):
        if not figures["n"]:
            break
        after = stored(left.join(rounds_of[-1].withColumnRenamed("node_id", "source"), "source", "left_semi").select("source", "target").distinct(), "links")
        forget(left)
        left = after
        moved, figures = counted(left.select(F.col("target").alias("node_id")).distinct().join(n, "node_id", "left_semi"), "moved", n=F.count(F.lit(1)))
        rounds_of.append(moved)
    if not figures["n"]:
        forget(left, strange)
        every = n
        for m in rounds_of:
            every = every.unionByName(m)
        return every.groupBy("node_id").agg((F.count("*") - 1).cast("int").alias("depth"))
    forget(left, *rounds_of)
    links = stored(_links(raw).withColumn("w", F.lit(1)), "links")
    endless = peel(n, links)
    plain = stored(n.join(endless, "node_id", "left_anti"), "nodes")
    acyclic = links.join(plain.select(F.col("node_id").alias("target")), "target", "left_semi").join(plain.select(F.col("node_id").alias("source")), "source", "left_semi")
    levels, rest = _contracted_fully(stored(acyclic.select("source", "target", "w"), "links"), None, F.max)
    followers = levels[0].select("node_id")
    for f in levels[1:]:
        followers = followers.union(f.select("node_id"))
    stay = plain.join(followers, "node_id", "left_anti").select("node_id", F.lit(0).alias("depth"), F.lit(True).alias("moved"))
    depths = _expanded(_settled(stored(stay, "depths"), rest, F.max), levels)
    return depths.unionByName(endless.withColumn("depth", F.lit(min(rounds, seen["n"]))))


def cycles(edges: DataFrame, longest: int = 8) -> DataFrame:
    """Simple cycles of at most ``longest`` edges: cycle (array of its nodes, the least first, so
    that each stands once, in its canonical rotation), size.

    A path starts at the least node of its cycle and grows by a link a round; it only goes on
    to greater nodes that are not on it and that lead back to the start in the links it has
    left.  Where the ways from the starts are not many more than the links, they are looked at
    alone, in at most ``longest`` rounds; else only those within strong components.  A self-loop
    is a cycle of one node.  A graph can have very many cycles of a length; all of them are rows.
    """
    links = stored(_links(edges).where("source is not null and target is not null"), "links")
    one = lambda c: F.array(c).alias("cycle")
    found = links.where("source = target").select(one("source"))
    inner, keys = _ways_out(links.where("source <> target"), longest), ["start", "source"]
    if inner is not None:
        back = _ways_back(inner.where("target = start").select("start", "source"), inner, keys, longest)
    else:
        inner, keys = _inner_links(links), ["source"]
        back = _ways_back(inner.where("source > target").select(F.col("target").alias("start"), "source"), inner, keys, longest)
    # Only on to where a way back of the links that are left is known.
    near = lambda left: back.where(F.col("hops") <= left).select("start", F.col("source").alias("target"))
    first = links.where("source < target").select(F.col("source").alias("start"), "target").join(near(longest - 1), ["start", "target"], "left_semi")
    paths = first.select(F.array("start", "target").alias("path"))
    for size in range(2, longest + 1):
        at = paths.select("path", F.element_at("path", 1).alias("start"), F.element_at("path", -1).alias("source"))
        grown = at.join(inner, keys).where("target = start or (target > start and not array_contains(path, target))")
        onward = grown.where("target <> start").join(near(longest - size), ["start", "target"], "left_semi")
        state, seen = counted(grown.where("target = start").select("path", F.lit(None).cast(grown.schema["target"].dataType).alias("target")).union(onward.select("path", "target")), "paths", open=F.count("target"))
        found = found.union(state.where("target is null").select(F.col("path").alias("cycle")))
        if not seen["open"]:
            break
        paths = state.where("target is not null").select(F.concat("path", F.array("target")).alias("path"))
    return found.select("cycle", F.size("cycle").alias("size"))


def _inner_links(links: DataFrame) -> DataFrame:
    """The links between different nodes of a strong component."""
    ends = stored(links.select(F.explode(F.array("source", "target")).alias("node_id")).distinct(), "nodes")
    groups = stored(strong_components(ends, links), "scc")
    forget(ends)
    of = lambda c: groups.select(F.col("node_id").alias(c), F.col("component").alias(f"c{c}"))
    return stored(links.where("source <> target").join(of("source"), "source").join(of("target"), "target").where("csource = ctarget").select("source", "target"), "links")


def _ways_out(links: DataFrame, longest: int) -> DataFrame | None:
    """start, source, target: the links, on from its greater neighbours, that a start can take
    through nodes greater than it, and those back to it; a source is at most longest - 1 links
    away.  None where a round would look at very many more than there are links: how many is
    known before it begins.
    """
    fan = links.groupBy("source").agg(F.count("*").alias("fan")).withColumnRenamed("source", "target")
    onward, seen = counted(links.join(fan, "target").select("source", "target", "fan"), "links", n=F.count(F.lit(1)))
    most = max(FEW_WAYS, WAYS_PER_LINK * seen["n"])
    fresh, seen = counted(onward.where("source < target").select(F.col("source").alias("start"), F.col("target").alias("source"), "fan"), "out", ahead=F.sum("fan"))
    known = fresh
    for _ in range(2, longest):
        if not seen["ahead"] or seen["ahead"] > most:
            break
        step = fresh.select("start", "source").join(onward, "source").where("target > start").select("start", F.col("target").alias("source"), "fan").distinct()
        fresh, seen = counted(step.join(known, ["start", "source"], "left_anti"), "out", ahead=F.sum("fan"))
        known = known.unionByName(fresh)
    if (seen["ahead"] or 0) > most:
        return None
    known = known.select("start", "source")
    taken = known.join(links, "source").where("target >= start")
    kept = known.select("start", F.col("source").alias("target")).union(known.select("start", F.col("start").alias("target")).distinct())
    return stored(taken.join(kept, ["start", "target"], "left_semi").select("start", "source", "target"), "ways")


def _ways_back(last: DataFrame, links: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """start, source, hops: the fewest links from source to a start through nodes greater than
    it.  last (start, source): links to a start; links: source, target, and start if among keys."""
    known = stored(last.withColumn("hops", F.lit(1)), "back")
    fresh = known
    ends = ["target" if k == "source" else k for k in keys]
    for hops in range(2, longest):
        step = fresh.select("start", F.col("source").alias("target")).join(links, ends).where("source > start").select("start", "source").distinct()
        fresh, seen = counted(step.join(known, ["start", "source"], "left_anti").withColumn("hops", F.lit(hops)), "back", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        known = known.unionByName(fresh)
    return known
