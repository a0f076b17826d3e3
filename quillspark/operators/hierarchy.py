"""Parent-child links to full hierarchies: root, depth, path and cycle of every node.

Links of inner nodes (nodes that are somebody's parent) go through weighted disjoint-set forests. Each task
builds the forest of its own links: every node knows its local root and its distance to it (path
compression adds the distances up). A local root whose parent lies in another task is open; the links of
open roots, contracted to local roots, form the same problem over far fewer nodes and are merged level by
level in fewer tasks until none is open. A link that would close a circle is left out and marks its root.
Roots and distances then go down the levels again. Leaves never enter the forest; they take over what their
parent has. Paths are materialised through the index of parents by doubling: after k rounds a node knows
the last 2**k names of its path, so a chain of a million nodes needs twenty joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut

#: Links that one task holds, at every level of the merge.
LINKS_PER_TASK = 250_000
SEPARATOR = " > "

_FOREST = "node string, root string, dist bigint, outside string, gap bigint, cyclic int"


def forest(children: list[str], parents: list[str], weights: list[int]) -> list[tuple[str, str, int, str | None, int, int]]:
    """Weighted disjoint-set forest over the links of one task. Each child comes once.

    Returns (node, root, distance to root, the root's parent where that is no child here else None, the
    weight of that link, 1 if the root's link would close a circle) for each child.
    """
    link = {c: (p, w) for c, p, w in zip(children, parents, weights)}
    up: dict[str, tuple[str, int]] = {}
    outside: dict[str, str | None] = {}
    cyclic: set[str] = set()
    for start in link:
        if start in up:
            continue
        chain, at = [], start
        on_chain = set()
        while at not in up:
            chain.append(at)
            on_chain.add(at)
            parent, weight = link[at]
            if parent in on_chain:
                cyclic.add(at)
                up[at], outside[at] = (at, 0), None
            elif parent not in link:
                up[at], outside[at] = (at, 0), parent
            else:
                at = parent
        root, dist = up[at]
        if chain and chain[-1] == at:
            chain.pop()
        for node in reversed(chain):
            dist += link[node][1]
            up[node] = (root, dist)
    return [(n, r, d, outside[r], link[r][1], int(r in cyclic)) for n, (r, d) in up.items()]


def _forest_of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if parts:
        links = pd.concat(parts)
        rows = forest(links["node"].tolist(), links["parent"].tolist(), links["weight"].tolist())
        yield pd.DataFrame(rows, columns=["node", "root", "dist", "outside", "gap", "cyclic"])


def _resolve(links: DataFrame, tasks: int, level: int = 0) -> DataFrame:
    """links (node, parent, weight), each node once -> (node, root, dist, cyclic): where the links from
    node end, either at a name that is no child in links, or (cyclic = 1) at the marked node of a circle."""
    # The first level keeps neighbouring names together; later levels deal anew, so that every level joins
    # at least a share of 1 / tasks of the open links and their number falls geometrically.
    dealt = links.repartitionByRange(tasks, "node") if not level else links.repartition(tasks, F.xxhash64(F.lit(level), "node"))
    local = cut(dealt.mapInPandas(_forest_of_partition, _FOREST))
    tops = local.where("outside is not null and dist = 0").select(F.col("node").alias("top"), "outside", "gap")
    if tasks == 1:
        closed = tops.select("top", F.col("outside").alias("final"), F.col("gap").alias("more"), F.lit(0).alias("circle"))
    else:
        home = local.select(F.col("node").alias("outside"), F.col("root").alias("next"), F.col("dist").alias("more"), F.lit(1).alias("inner"))
        contracted = cut(tops.join(home, "outside", "left"))
        onward = contracted.where("inner = 1").select(F.col("top").alias("node"), F.col("next").alias("parent"), (F.col("gap") + F.col("more")).alias("weight"))
        closed = contracted.where("inner is null").select("top", F.col("outside").alias("final"), F.col("gap").alias("more"), F.lit(0).alias("circle"))
        open_links = onward.count()
        if open_links:
            # At most three quarters as many tasks as before: levels end even if few links close.
            higher = _resolve(onward, max(1, min(-(-open_links // LINKS_PER_TASK), tasks * 3 // 4)), level + 1)
            # A top ends at a closed top, which knows the true root, or else on a circle of some level.
            ends = higher.join(closed.select(F.col("top").alias("root"), "final", F.col("more").alias("rest")), "root", "left").select(
                F.col("node").alias("top"),
                F.coalesce("final", "root").alias("final"),
                (F.col("dist") + F.coalesce("rest", F.lit(0))).alias("more"),
                F.when(F.col("final").isNull(), 1).otherwise(0).alias("circle"),
            )
            closed = closed.unionByName(ends)
    return local.join(closed.withColumnRenamed("top", "root"), "root", "left").select(
        "node",
        F.coalesce("final", "root").alias("root"),
        (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"),
        F.coalesce("circle", "cyclic").alias("cyclic"),
    )


def resolve_hierarchy(nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """nodes (tree, node, parent) -> tree, node, root, depth, path, on_cycle; parent null for a root. The
    number of tasks of the first level follows from the number of links unless given.

    Defined cases: a node repeated letter for letter is one node (of different parents of one node, the
    smallest counts); a parent that is no node of the tree counts as none; a node that is its own parent is a cycle of one;
    on_cycle is 1 on a cycle, 2 for what leads into one, and both have empty root and path and depth -1;
    an empty table gives no rows. Node names must not be null (such rows are left out).
    """
    # Trees are told apart inside the node names: one key column serves all joins.
    named = (
        nodes.where("node is not null and tree is not null")
        .groupBy("tree", "node")
        .agg(F.min("parent").alias("parent"))
        .select("tree", F.concat_ws("\u0001", "tree", "node").alias("id"), F.col("node").alias("name"), F.concat(F.col("tree"), F.lit("\u0001"), F.col("parent")).alias("parent"))
    )
    known = named.select(F.col("id").alias("parent"), F.lit(1).alias("there"))
    all_nodes = cut(named.join(known, "parent", "left").withColumn("parent", F.when(F.col("there") == 1, F.col("parent"))).drop("there"))
    inner_ids = all_nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    inner = cut(all_nodes.join(inner_ids, "id", "left_semi"))

    links = inner.where("parent is not null").select(F.col("id").alias("node"), "parent", F.lit(1).cast("bigint").alias("weight"))
    resolved = _resolve(links, tasks or max(1, -(-links.count() // LINKS_PER_TASK))).withColumnRenamed("node", "id")
    placed = cut(
        inner.join(resolved, "id", "left").select(
            "id",
            "name",
            "parent",
            F.coalesce("root", "id").alias("root"),
            F.coalesce("dist", F.lit(0)).cast("bigint").alias("depth"),
            F.coalesce("cyclic", F.lit(0)).alias("cyclic"),
        )
    )
    sound, tainted = placed.where("cyclic = 0"), placed.where("cyclic = 1")
    paths = _paths(sound)
    on_circle = _on_circle(tainted)
    of_inner = (
        paths.select("id", "root", "depth", "path", F.lit(0).alias("on_cycle"))
        .unionByName(
            tainted.join(on_circle, "id", "left").select(
                "id", F.lit("").alias("root"), F.lit(-1).cast("bigint").alias("depth"), F.lit("").alias("path"), F.coalesce("circle", F.lit(2)).alias("on_cycle")
            )
        )
    )
    of_inner = cut(of_inner)
    leaves = all_nodes.join(inner_ids, "id", "left_anti")
    of_leaves = leaves.join(of_inner.withColumnRenamed("id", "parent"), "parent", "left").select(
        "tree",
        F.col("name").alias("node"),
        F.when(F.col("parent").isNull(), F.col("id")).otherwise(F.col("root")).alias("root"),
        F.when(F.col("parent").isNull(), 0).when(F.col("on_cycle") > 0, -1).otherwise(F.col("depth") + 1).alias("depth"),
        F.when(F.col("parent").isNull(), F.col("name")).when(F.col("on_cycle") > 0, "").otherwise(F.concat("path", F.lit(SEPARATOR), "name")).alias("path"),
        F.when(F.col("on_cycle") > 0, 2).otherwise(0).alias("on_cycle"),
    )
    of_parents = all_nodes.join(of_inner, "id").select("tree", F.col("name").alias("node"), "root", "depth", "path", "on_cycle")
    return of_parents.unionByName(of_leaves).select(
        "tree",
        "node",
        F.when(F.col("on_cycle") > 0, "").otherwise(F.substring_index("root", "\u0001", -1)).alias("root"),
        F.col("depth").cast("bigint").alias("depth"),
        "path",
        F.col("on_cycle").cast("bigint").alias("on_cycle"),
    )


def _paths(sound: DataFrame) -> DataFrame:
    """Paths of nodes that end at a root, by doubling. ``above`` is the node just above the known part."""
    deepest = sound.agg(F.max("depth")).first()[0] or 0
    state = sound.select("id", "root", "depth", F.col("name").alias("path"), F.when(F.col("depth") > 0, F.col("parent")).alias("above"))
    for _ in range(int(deepest).bit_length()):
        index = state.select(F.col("id").alias("above"), F.col("path").alias("upper"), F.col("above").alias("beyond"))
        done, going = state.where("above is null"), state.where("above is not null")
        going = going.join(index, "above").select("id", "root", "depth", F.concat("upper", F.lit(SEPARATOR), "path").alias("path"), F.col("beyond").alias("above"))
        state = cut(done.unionByName(going))
    return state


def _on_circle(tainted: DataFrame) -> DataFrame:
    """(id, circle = 1) of the nodes on circles: what is reached upwards from each circle's marked node.
    The reached set doubles with the length of the jumps, so long circles take few rounds."""
    jumps = tainted.select("id", F.col("parent").alias("far"))
    reached = cut(tainted.where("id = root").select("id"))
    size = reached.count()
    while size:
        further = reached.join(jumps, "id").select(F.col("far").alias("id"))
        reached = cut(reached.union(further).distinct())
        now = reached.count()
        if now == size:
            break
        size = now
        jumps = cut(jumps.join(jumps.select(F.col("id").alias("far"), F.col("far").alias("farther")), "far").select("id", F.col("farther").alias("far")))
    return reached.select("id", F.lit(1).alias("circle"))


def descendant_pairs(nodes: DataFrame) -> DataFrame:
    """nodes (tree, node, parent) -> tree, node, descendant, distance: one row per node and node below it,
    with the number of links between them.

    Defined cases: a leaf has one row with descendant and distance null; on a cycle every node is below
    every other and, once around, below itself, and what leads into the cycle is below all of it, each at
    its shortest distance; nodes and parents as in ``resolve_hierarchy``.
    By doubling: round k adds, to the ancestors within 2**k links, those of the node exactly 2**k links up.
    """
    named = cut(nodes.where("node is not null and tree is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent")))
    links = named.join(named.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
    jumps = cut(links.select("tree", "node", F.col("parent").alias("far")))
    pairs = cut(jumps.select("tree", F.col("far").alias("node"), F.col("node").alias("descendant"), F.lit(1).cast("bigint").alias("distance")))
    size, length = pairs.count(), 1
    while size:
        higher = pairs.select("tree", F.col("node").alias("higher"), F.col("descendant").alias("far"), (F.col("distance") + length).alias("distance"))
        further = jumps.join(higher, ["tree", "far"]).select("tree", F.col("higher").alias("node"), F.col("node").alias("descendant"), "distance")
        pairs = cut(pairs.unionByName(further).groupBy("tree", "node", "descendant").agg(F.min("distance").alias("distance")))
        now = pairs.count()
        if now == size:
            break
        size, length = now, 2 * length
        jumps = cut(jumps.join(jumps.select("tree", F.col("node").alias("far"), F.col("far").alias("farther")), ["tree", "far"]).select("tree", "node", F.col("farther").alias("far")))
    return named.select("tree", "node").join(pairs, ["tree", "node"], "left").select("tree", "node", "descendant", "distance")


def descendants(hierarchy: DataFrame) -> DataFrame:
    """How many nodes hang below each node, directly and at all, from the paths: a node counts once for
    each name above it. Counts only: leaves, and nodes on or into cycles, which have no path, are left out;
    ``descendant_pairs`` has them."""
    above = hierarchy.where("on_cycle = 0").select("tree", "depth", F.split("path", SEPARATOR).alias("names"))
    pairs = above.where("depth > 0").select("tree", F.posexplode(F.slice("names", 1, F.size("names") - 1)).alias("level", "node"), "depth")
    return pairs.groupBy("tree", "node").agg(F.count("*").alias("descendants"), F.sum(F.when(F.col("level") == F.col("depth") - 1, 1).otherwise(0)).alias("children"))


def flatten_nested(text: str | None, prefix: str) -> list[tuple[str, str | None]]:
    """(node, parent) of each node of a JSON list of nodes {id, children}, nested to any depth; node names
    get the prefix. Null, empty and broken JSON give nothing; nodes without id hand their children up."""
    import json

    try:
        top = json.loads(text) if text else None
    except ValueError:
        return []
    out: list[tuple[str, str | None]] = []
    stack = [(x, None) for x in reversed(top)] if isinstance(top, list) else [(top, None)] if isinstance(top, dict) else []
    while stack:
        node, parent = stack.pop()
        if not isinstance(node, dict):
            continue
        name = parent
        if node.get("id") is not None:
            name = f"{prefix}{node['id']}"
            out.append((name, parent))
        children = node.get("children")
        if isinstance(children, list):
            stack.extend((x, name) for x in reversed(children))
    return out


def nested_nodes(rules: DataFrame) -> DataFrame:
    """rules (prefix, nested) -> node, parent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, n in zip(batch["prefix"], batch["nested"]) for r in flatten_nested(n, p or "")]
            yield pd.DataFrame(rows, columns=["node", "parent"])

    return rules.select("prefix", "nested").mapInPandas(run, "node string, parent string")
