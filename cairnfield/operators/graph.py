"""Graph operators over files(node, ...) and edges(source, target, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Edges that are collected for a sequential SCC at most; more go the distributed way.
SMALL_GRAPH = 200_000


def reverse(edges: DataFrame) -> DataFrame:
    """Importers by file, deduplicated."""
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """A3: node, fan_in, fan_out, total, level (high > 20, medium > 10); nodes without edges have 0."""
    ends = edges.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("source", F.lit(0), F.lit(1)))
    d = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    out = files.select("node").join(d, "node", "left").fillna(0, ["fan_in", "fan_out"]).withColumn("total", F.col("fan_in") + F.col("fan_out"))
    return out.withColumn("level", coupling_level(F.col("total")))


def coupling_level(total: Column) -> Column:
    return F.when(total > 20, "high").when(total > 10, "medium").otherwise("low")


def bfs(edges: DataFrame, start: DataFrame, depth: int, stop: DataFrame | None = None) -> DataFrame:
    """(root, node, level, via) along edges(source, target) from start(root, node); the first visit counts.

    Each level is a join of the frontier with the edges and an anti-join with what was seen; via is the smallest path
    among the shortest. Nodes in stop(node) are reached but not left, a start node excepted. The depth is small, so the
    plan stays lazy and is one job.
    """
    e = edges.select("source", "target").distinct()
    seen = start.select("root", "node", F.lit(0).alias("level"), F.array("node").alias("via"))
    frontier = seen
    for level in range(1, depth + 1):
        base = frontier if stop is None or level == 1 else frontier.join(stop.select("node"), "node", "left_anti")
        step = base.join(e, F.col("node") == F.col("source")).select("root", F.col("target").alias("node"), F.lit(level).alias("level"), F.concat("via", F.array("target")).alias("via"))
        step = step.groupBy("root", "node").agg(F.min("level").alias("level"), F.min("via").alias("via"))
        frontier = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        seen = seen.union(frontier.select("root", "node", "level", "via"))
    return seen


def frontier_levels(edges: DataFrame, start: DataFrame, depth: int, stop: DataFrame | None = None) -> DataFrame:
    """(root, node, level) without paths: level by level, by their minimum. What bfs() gives, for many roots at once."""
    e = edges.select("source", "target").distinct()
    seen = start.select("root", "node", F.lit(0).alias("level"))
    frontier = seen
    for level in range(1, depth + 1):
        base = frontier if stop is None or level == 1 else frontier.join(stop.select("node"), "node", "left_anti")
        step = base.join(e, F.col("node") == F.col("source")).select("root", F.col("target").alias("node")).distinct()
        frontier = step.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(level).alias("level"))
        seen = seen.union(frontier)
        if level % 3 == 0 and level < depth:
            seen = cut(seen)
            frontier = seen.filter(F.col("level") == level)
    return seen


def impact_radius(files: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """Who depends on the start(root, node), up to depth; expansion stops at entry files. reason is direct at
    level 1 and transitive beyond."""
    entries = files.filter("is_entry").select("node")
    out = frontier_levels(reverse(edges), start, depth, entries).filter("level > 0")
    return out.withColumn("reason", F.when(F.col("level") == 1, "direct").otherwise("transitive"))


def impact_stats(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """Direct and transitive dependencies and dependents of each root, the root excluded."""

    def side(e: DataFrame, name: str) -> DataFrame:
        found = frontier_levels(e, start, depth).filter("node <> root")
        return found.groupBy("root").agg(F.sum((F.col("level") == 1).cast("long")).alias(f"direct_{name}"), F.count("*").alias(f"all_{name}"))

    out = start.select("root").distinct().join(side(edges, "dependencies"), "root", "left").join(side(reverse(edges), "dependents"), "root", "left")
    return out.fillna(0)


def affected_tests(files: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """Test files among the dependents, with their distance."""
    found = frontier_levels(reverse(edges), start, depth).filter("level > 0")
    return found.join(files.filter("is_test").select("node"), "node").select("root", F.col("node").alias("test"), F.col("level").alias("distance"))


def entry_paths(files: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 4, most: int = 50) -> DataFrame:
    """Simple reverse paths from each root to non-test entries, at most `most` a root, shortest first, then by path.

    Paths grow only towards nodes from which an entry may be in reach, and a root that has `most` paths is done, as what
    it would still give is longer: neither changes the result.
    """
    e = reverse(edges)
    good = files.filter("is_entry AND NOT is_test").select("node")
    # Entries, and nodes that are one step from one: only those can be next to last and last.
    near = good.withColumn("left", F.lit(0)).union(edges.join(good, F.col("source") == F.col("node")).select("target", F.lit(1))).groupBy("node").agg(F.min("left").alias("left"))
    e = cut(e.join(near.withColumnRenamed("node", "target"), "target", "left"))
    paths = start.select("root", "node", F.array("node").alias("path"))
    found, done = None, None
    for level in range(1, depth + 1):
        step = paths.join(e.filter(F.coalesce("left", F.lit(2)) <= depth - level), F.col("node") == F.col("source")).filter(~F.array_contains("path", F.col("target")))
        step = step.select("root", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        step = step if done is None else step.join(done, "root", "left_anti")
        paths = cut(step) if level == 3 and depth > 3 else step
        hit = paths.join(good, "node").select("root", F.col("node").alias("entry"), "path", F.lit(level).alias("depth"))
        found = hit if found is None else found.union(hit)
        if level >= 3 and level < depth:
            done = found.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("root")
    return first_of(found, "root", [F.col("depth"), F.col("path")], most, 1 if depth < 3 else 32)


def affected_routes(files: DataFrame, edges: DataFrame, routes: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """routes(file, method, route) of the start and of its dependents, once, at the smallest level; implicit
    if every way of length <= depth has a tier3 edge."""
    e = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), (F.col("tier") == "tier3").alias("soft"))
    ways = start.select("root", "node", F.lit(0).alias("level"), F.lit(False).alias("implicit"))
    seen = ways
    for level in range(1, depth + 1):
        step = ways.join(e, F.col("node") == F.col("source")).select("root", F.col("target").alias("node"), F.lit(level).alias("level"), (F.col("implicit") | F.col("soft")).alias("implicit"))
        ways = step.groupBy("root", "node", "level").agg(F.min("implicit").alias("implicit"))
        seen = seen.union(ways)
    best = seen.groupBy("root", "node").agg(F.min("level").alias("level"), F.min("implicit").alias("implicit"))
    return best.join(routes, F.col("node") == F.col("file")).select("root", "file", "method", "route", "level", "implicit")


def dependency_tree(edges: DataFrame, start: DataFrame, depth: int = 3, fan_out: int = 5) -> DataFrame:
    """(root, path, depth) of the tree of dependencies; a branch ends before a node it holds already, and each
    node shows its `fan_out` smallest targets."""
    w = Window.partitionBy("source").orderBy("target")
    e = edges.select("source", "target").distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= fan_out).drop("n")
    level = start.select("root", "node", F.array("node").alias("path"))
    out = level.select("root", "path", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        level = level.join(e, F.col("node") == F.col("source")).filter(~F.array_contains("path", F.col("target")))
        level = level.select("root", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        out = out.union(level.select("root", "path", F.lit(d).alias("depth")))
    return out


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, epsilon: float | None = None, previous: DataFrame | None = None) -> DataFrame:
    """G1: (node, rank). Self-loops and unknown ends are dropped, parallel edges count once, dangling mass is spread.

    epsilon stops when the sum of changes falls below it, at a job a round; without it the rounds are fixed. previous
    (node, rank) starts warm if its ranks sum up to more than 1/2; missing or non-positive ranks start at 1/n. A cold
    start of fixed rounds goes by power_series, any other by rounds over all nodes.
    """
    nodes = nodes.select("node").distinct()
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    e = edges.filter("source <> target").select("source", "target").distinct()
    e = e.join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node", "target"), "target", "left_semi")
    links = cut(e.join(e.groupBy("source").agg(F.count("*").alias("out")), "source"))
    base = nodes.join(links.select(F.col("source").alias("node"), F.lit(False).alias("dangling")).distinct(), "node", "left")
    base = cut(base.select("node", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    if epsilon is None and previous is None:
        return power_series(base, links, n, rounds, damping)
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    if previous is not None and (previous.agg(F.sum("rank")).first()[0] or 0) > 0.5:
        p = previous.select("node", F.col("rank").alias("p"))
        ranks = base.join(p, "node", "left").select("node", "dangling", F.when(F.col("p") > 0, F.col("p")).otherwise(1.0 / n).alias("rank"))
        total = ranks.agg(F.sum("rank").alias("t"))
        ranks = ranks.withColumn("rank", F.col("rank") / total.scalar())
    for k in range(1, rounds + 1):
        flow = ranks.join(links, F.col("node") == F.col("source")).groupBy("target").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        lost = ranks.filter("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        new = base.join(flow, F.col("node") == F.col("target"), "left").select("node", "dangling", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + lost.scalar() / n)).alias("rank"))
        if epsilon is not None or k % 2 == 0:
            new = cut(new)
        if epsilon is not None:
            change = new.join(ranks.select("node", F.col("rank").alias("old")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            ranks = new
            if change < epsilon:
                break
        ranks = new
    return ranks.select("node", "rank")


def power_series(base: DataFrame, links: DataFrame, n: int, rounds: int, damping: float) -> DataFrame:
    """(node, rank) after fixed rounds from a uniform start, of base(node, dangling) and links(source, target, out).

    What a round adds to all nodes alike, teleport and dangling mass, is one number. So the ranks are a weighted sum of
    the terms v(j) = (damping x transition)^j 1, and a round is a join and an aggregation alone, over nodes that links
    still reach. The weights follow from the dangling mass of each term, one number a round, by a recurrence on the driver.
    """
    term = base.select("node", F.lit(1.0).alias("v"))
    terms = term.select("node", F.lit(0).alias("j"), "v")
    share = links.select(F.col("source").alias("node"), "target", (damping / F.col("out")).alias("share"))
    for j in range(1, rounds + 1):
        term = cut(term.join(share, "node").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("v") * F.col("share")).alias("v")))
        terms = terms.union(term.select("node", F.lit(j).alias("j"), "v"))
    mass = dict(terms.join(base.filter("dangling").select("node"), "node", "left_semi").groupBy("j").agg(F.sum("v")).collect())
    added: list[float] = []
    for k in range(rounds):
        lost = sum(added[k - 1 - j] * mass.get(j, 0.0) for j in range(k)) + mass.get(k, 0.0) / n
        added.append(((1 - damping) + damping * lost) / n)
    weights = [*reversed(added), 1.0 / n]
    return terms.groupBy("node").agg(F.sum(F.col("v") * F.get(F.array(*map(F.lit, weights)), F.col("j"))).alias("rank"))


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges that count for cycles: neither lazy nor tier3."""
    return edges.filter("NOT is_lazy AND tier <> 'tier3'").select("source", "target")


def trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges without those whose end has no way in or no way out; each round peels one layer."""
    e = edges.filter("source <> target").distinct()
    for _ in range(rounds):
        e = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        e = cut(e.select("source", "target"))
    return e


def scc(edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(node, scc) of the strongly connected components of two nodes or more; scc is the smallest node.

    What trimming leaves is collected if it has `small` edges at most, else coloured in Spark. Both give the same.
    """
    e = trimmed(edges.select("source", "target"))
    if e.count() <= small:
        pairs = [(r.source, r.target) for r in e.collect()]
        kind = e.schema["source"].dataType.simpleString()
        return e.sparkSession.createDataFrame(_tarjan(pairs), f"node {kind}, scc {kind}")
    return _coloured(e)


def _tarjan(pairs: list[tuple]) -> list[tuple]:
    out: dict = {}
    for s, t in pairs:
        out.setdefault(s, []).append(t)
    index, low, stack, on, found, counter = {}, {}, [], set(), [], 0
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out.get(root, ())))]
        index[root] = low[root] = counter
        counter += 1
        stack.append(root)
        on.add(root)
        while work:
            node, targets = work[-1]
            for t in targets:
                if t not in index:
                    index[t] = low[t] = counter
                    counter += 1
                    stack.append(t)
                    on.add(t)
                    work.append((t, iter(out.get(t, ()))))
                    break
                if t in on:
                    low[node] = min(low[node], index[t])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        group.append(x)
                        if x == node:
                            break
                    if len(group) > 1:
                        least = min(group)
                        found += [(x, least) for x in group]
    return found


def _coloured(edges: DataFrame) -> DataFrame:
    """Forward colouring: every node takes the largest node that reaches it; a colour's root, with all of its colour
    that reach it, is a component. What is left goes again."""
    left, done = edges, None
    while not left.isEmpty():
        nodes = left.select(F.col("source").alias("node")).union(left.select("target")).distinct()
        colour = cut(nodes.withColumn("c", F.col("node")))
        while True:
            got = colour.join(left, F.col("node") == F.col("source")).groupBy("target").agg(F.max("c").alias("g"))
            new = cut(colour.join(got, F.col("node") == F.col("target"), "left").select("node", F.greatest("c", F.coalesce("g", "c")).alias("c")))
            moved = not new.join(colour.withColumnRenamed("c", "b"), "node").filter("c <> b").isEmpty()
            colour = new
            if not moved:
                break
        a, b = colour.select(F.col("node").alias("source"), F.col("c").alias("cs")), colour.select(F.col("node").alias("target"), F.col("c").alias("ct"))
        same = cut(left.join(a, "source").join(b, "target").filter("cs = ct").select("source", "target", F.col("cs").alias("c")))
        inside = cut(colour.filter("node = c").select("node", "c"))
        while True:
            more = same.join(inside.select(F.col("node").alias("target"), F.col("c")), ["target", "c"], "left_semi").select(F.col("source").alias("node"), "c").distinct()
            new = cut(inside.union(more).distinct())
            grown = new.count() > inside.count()
            inside = new
            if not grown:
                break
        done = inside if done is None else done.union(inside)
        gone = inside.select("node")
        left = left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
        left = cut(left.select("source", "target"))
    groups = done.groupBy("c").agg(F.min("node").alias("scc"), F.count("*").alias("n")).filter("n > 1")
    return done.join(groups, "c").select("node", "scc")


def first_of(df: DataFrame, key: str, order: list[Column], most: int, salts: int = 32) -> DataFrame:
    """The `most` first rows of each key, with `rank`. A key's rows are first cut in `salts` groups, so that no task sorts
    all rows of a frequent key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if salts == 1:
        return df.withColumn("rank", rank).filter(F.col("rank") <= most)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy(key, "__salt").orderBy(*order))).filter(F.col("rank") <= most)
    return near.withColumn("rank", rank).filter(F.col("rank") <= most).drop("__salt")


def cycles(edges: DataFrame, longest: int = 8, per_scc: int = 25, most: int | None = None, beam: int | None = None) -> DataFrame:
    """(scc, path, truncated): simple cycles of up to `longest` nodes, each written from its smallest node.

    A cycle of n nodes is a way out of its smallest node of n/2 edges, rounded up, and a way back of the others, neither
    through smaller nodes; so no way of more than `longest`/2 edges is ever written. Per component the `per_scc` first by
    length and path are kept, `most` in all if it is given. A component that has more than `per_scc` cycles is done: what
    it would still give is longer. With `beam`, others keep so many ways a round at most. truncated tells that a component
    may hold cycles that aren't returned: beyond `per_scc`, beyond the beam, beyond `most`, or longer than `longest` as it
    has more nodes. A component that is cut and has no cycle to show is a row with an empty path.
    """
    groups = cut(scc(edges))
    inside = edges.join(groups.select(F.col("node").alias("source"), "scc"), "source").join(groups.select(F.col("node").alias("target"), F.col("scc").alias("other")), "target").filter("scc = other").select("scc", "source", "target").distinct()
    inside = cut(inside)
    salts = 1 if inside.count() <= SMALL_GRAPH else 32
    steps = inside.drop("scc")
    out = inside.filter("target > source").select("scc", F.col("source").alias("s"), F.array("source", "target").alias("path"))
    back = inside.filter("source > target").select("scc", F.col("target").alias("s"), F.array("source").alias("path"))
    found, dropped = None, groups.select("scc").limit(0)
    over = dropped

    def longer(ways: DataFrame, end: Column, here: str, there: str, grown: Column) -> DataFrame:
        nonlocal dropped
        free = (F.col(there) > F.col("s")) & ~F.array_contains("path", F.col(there))
        more = ways.join(over, "scc", "left_anti").withColumn(here, end).join(steps, here).filter(free).select("scc", "s", grown.alias("path"))
        if beam is None:
            return cut(more)
        more = cut(first_of(more, "scc", [F.col("path")], beam + 1, salts))
        dropped = dropped.union(more.filter(F.col("rank") > beam).select("scc"))
        return more.filter(F.col("rank") <= beam).drop("rank")

    for n in range(2, longest + 1):
        if n > 2 and n % 2:
            out = longer(out, F.element_at("path", -1), "source", "target", F.concat("path", F.array("target")))
        elif n > 2:
            back = longer(back, F.col("path")[0], "target", "source", F.concat(F.array("source"), "path"))
        if out.isEmpty() or back.isEmpty():
            break
        rest = back.select("s", F.col("path")[0].alias("last"), F.slice("path", 2, longest).alias("rest"))
        met = out.join(over, "scc", "left_anti").withColumn("last", F.element_at("path", -1)).join(rest, ["s", "last"])
        met = met.filter(~F.arrays_overlap("path", "rest")).select("scc", F.concat("path", "rest").alias("path"))
        new = cut(first_of(met, "scc", [F.col("path")], per_scc + 1, salts).select("scc", "path"))
        found = new if found is None else found.union(new)
        over = found.groupBy("scc").agg(F.count("*").alias("n")).filter(F.col("n") > per_scc).select("scc")
    if found is None:
        found = out.select("scc", "path").limit(0)
    large = groups.groupBy("scc").agg(F.count("*").alias("n")).filter(F.col("n") > longest).select("scc")
    partial = (over.union(dropped).union(large).distinct().withColumn("partial", F.lit(True)))
    kept = first_of(found, "scc", [F.size("path"), F.col("path")], per_scc, salts)
    none = partial.join(found.select("scc").distinct(), "scc", "left_anti").select("scc", F.array().cast(found.schema["path"].dataType).alias("path"), F.lit(0).alias("rank"))
    kept = cut(kept.select("scc", "path", "rank").union(none))
    many = most is not None and kept.count() > most
    if many:
        kept = kept.orderBy("rank", "scc").limit(most)
    kept = kept.join(partial, "scc", "left")
    return kept.select("scc", "path", (F.coalesce("partial", F.lit(False)) | F.lit(many)).alias("truncated"))


def cycle_break(cycles_: DataFrame, degrees_: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each cycle the edge of the least cost, 2 x dependents + dependencies of its source."""
    closed = F.concat("path", F.array(F.col("path")[0]))
    pairs = cycles_.select("scc", "path", F.posexplode(F.arrays_zip(F.col("path").alias("source"), F.slice(closed, 2, F.size("path")).alias("target"))).alias("at", "x"))
    cost = pairs.select("scc", "path", "at", "x.source", "x.target").join(degrees_, F.col("source") == F.col("node")).withColumn("cost", 2 * F.col("fan_in") + F.col("fan_out"))
    w = Window.partitionBy("path").orderBy("cost", "source", "target")
    return cost.withColumn("r", F.row_number().over(w)).filter("r = 1").select("scc", "path", "source", "target", "cost")
