"""Breadth-first traversal: one join per level for all starts together, instead of a query per visited node; radii are walked inside tasks, each over whole groups of repos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.model import EXPANDABLE, TRAVERSED, confidence_rank
from graphloom.session import stored

#: Kinds whose files count as reached.
INTERNAL = (*EXPANDABLE, "DOCSECTION")
#: Groups of linked repos with more rows than this, or more links between repos than that, are walked by joins; a task keeps about so many visited nodes at a time.
GROUP_ROWS, LINKS, VISITS = 2_000_000, 200_000, 4_000_000
#: At most so many names of groups are broadcast.
ROOTS = 200_000
CONFIDENCES = ("exact", "strong", "resolved", "heuristic")
RADIUS = "seed string, direction string, id string, kind string, qname string, path string, distance int, confidence string, position int, conservative boolean, n_reached long"
PARTS = RADIUS.replace("n_reached long", "line int, here long")
COUNTERS = "seed string, upstream long, downstream long, files long, internal_files long, entrypoints long, conservative long, max_distance int, reached long"


def steps(edges: DataFrame, nodes: DataFrame, direction: str) -> DataFrame:
    """(id, next, next_kind, rank, conservative, path, line): the moves of a traversal; up goes from dst to src. Dangling ends are dropped."""
    near, far = ("src", "dst") if direction == "down" else ("dst", "src")
    e = edges.filter(F.col("kind").isin(*TRAVERSED)).select(F.col(near).alias("id"), F.col(far).alias("next"), confidence_rank("confidence").alias("rank"), (F.col("kind") == "IMPORTS").alias("conservative"))
    e = e.groupBy("id", "next").agg(F.min("rank").alias("rank"), F.min("conservative").alias("conservative"))
    n = nodes.select(F.col("id").alias("next"), F.col("kind").alias("next_kind"), F.col("path").alias("next_path"), F.col("start_line").alias("next_line"))
    return e.join(n, "next")


def reach(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, direction: str = "down", depth: int | None = 3, max_nodes: int | None = None) -> DataFrame:
    """(seed, id, distance, rank, conservative): nodes within ``depth`` moves of each seed (None: all that can be reached), with the least distance, over the paths of that
    distance the weakest confidence of the best path, and whether only imports of files lead into it there. seeds: (seed, id). Nodes that are not expandable are reached, not left.

    A seed that has more than ``max_nodes`` after a level takes no further one: whatever came later would be farther than these.
    Each level is written to the shared folder, so the plan stays short and a lost executor costs one level.
    """
    moves = stored(steps(edges, nodes, direction), "steps")
    found = seeds.select("seed", "id").distinct().withColumn("distance", F.lit(0)).withColumn("rank", F.lit(0)).withColumn("conservative", F.lit(False)).withColumn("expand", F.lit(True))
    frontier = out = stored(found, "reach-0")
    level = 0
    while depth is None or level < depth:
        level += 1
        near = frontier.filter("expand").select("seed", "id", F.col("rank").alias("so_far")).join(moves, "id")
        new = near.groupBy("seed", F.col("next").alias("id")).agg(F.min(F.greatest("so_far", "rank")).alias("rank"), F.min("conservative").alias("conservative"), F.max(F.col("next_kind").isin(*EXPANDABLE)).alias("expand"))
        new = new.join(out.select("seed", "id"), ["seed", "id"], "left_anti")
        frontier = stored(new.select("seed", "id", F.lit(level).alias("distance"), "rank", "conservative", F.coalesce("expand", F.lit(False)).alias("expand")), f"reach-{level}")
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
        if max_nodes is not None:
            full = out.filter("distance > 0").groupBy("seed").agg(F.count("*").alias("c")).filter(F.col("c") > max_nodes)
            frontier = frontier.join(full, "seed", "left_anti")
    return out.drop("expand")


def radius_starts(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, direction: str) -> DataFrame:
    """(seed, id): seeds with what stands for them: a file has the nodes it DEFINES in both directions, anything else its file upwards."""
    at = _placed(seeds, nodes)
    out = seeds.select("seed", "id").unionByName(_defined(edges, at))
    return (out.unionByName(_own_files(at, nodes)) if direction == "up" else out).distinct()


def _placed(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    return seeds.select("seed", "id").distinct().join(nodes.select("id", "repo_id", "kind", "path"), "id")


def _defined(edges: DataFrame, at: DataFrame) -> DataFrame:
    defined = edges.filter("kind = 'DEFINES'").select("repo_id", F.col("src").alias("id"), "dst")
    return at.filter("kind = 'FILE'").join(defined, ["repo_id", "id"]).select("seed", F.col("dst").alias("id"))


def _own_files(at: DataFrame, nodes: DataFrame) -> DataFrame:
    files = nodes.filter("kind = 'FILE'").groupBy("repo_id", "path").agg(F.min("id").alias("file"))
    inside = at.filter(F.coalesce(F.col("kind") != "FILE", F.lit(True))).join(files, ["repo_id", "path"])
    return inside.select("seed", F.col("file").alias("id"))


def radius_files(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, path, distance): the files of reached nodes, each at its least distance."""
    n = nodes.filter(F.col("kind").isin(*EXPANDABLE)).select("id", "path")
    return reached.join(n, "id").filter("path is not null").groupBy("seed", "path").agg(F.min("distance").alias("distance"))


def blast_radius(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int | None = None, max_nodes: int = 1000) -> DataFrame:
    """(seed, direction, id, kind, qname, path, distance, confidence, position, conservative, n_reached): both directions, at most ``max_nodes`` a seed and direction.

    n_reached is what the direction held before the limit, as far as it was walked. Starts are those of ``radius_starts``. The limit is the operator's feature: nearest first, then better confidence, path, line and id.
    """
    grouped = _grouped(edges, nodes, seeds)
    if grouped is not None:
        rows = grouped[0].mapInArrow(_walker(depth, max_nodes, "rows"), RADIUS)
        return rows if grouped[1] is None else rows.unionByName(_across(*grouped[1:], depth, max_nodes))
    return _by_joins(edges, nodes, seeds, depth, max_nodes)


def _by_joins(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int | None, max_nodes: int) -> DataFrame:
    names = F.array(*[F.lit(x) for x in CONFIDENCES])
    parts = []
    for direction in ("up", "down"):
        r = reach(edges, nodes, radius_starts(edges, nodes, seeds, direction), direction, depth, max_nodes).filter("distance > 0").join(nodes.select("id", "kind", "qname", "path", "start_line"), "id")
        w = Window.partitionBy("seed").orderBy("distance", "rank", F.coalesce("path", F.lit("")), "start_line", "id")
        r = r.withColumn("position", F.row_number().over(w)).withColumn("n_reached", F.count("*").over(Window.partitionBy("seed"))).filter(F.col("position") <= max_nodes)
        parts.append(r.select("seed", F.lit(direction).alias("direction"), "id", "kind", "qname", "path", "distance", F.element_at(names, F.col("rank") + 1).alias("confidence"), "position", "conservative", "n_reached"))
    return parts[0].unionByName(parts[1])


def radius_counters(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int | None = None, max_nodes: int = 1000) -> DataFrame:
    """(seed, upstream, downstream, files, internal_files, entrypoints, conservative, max_distance, reached) of each seed's blast radius, counted where it is walked.

    files counts the paths of reached nodes, internal_files those of reached internal nodes and of the seed itself, if it is one; reached is the larger n_reached.
    """
    grouped = _grouped(edges, nodes, seeds)
    if grouped is None:
        return _counted(stored(_by_joins(edges, nodes, seeds, depth, max_nodes), "radius"), seeds, nodes)
    counts = grouped[0].mapInArrow(_walker(depth, max_nodes, "counters"), COUNTERS)
    if grouped[1] is None:
        return counts
    return counts.unionByName(_counted(stored(_across(*grouped[1:], depth, max_nodes), "radius-across"), grouped[2], nodes))


def _counted(radius: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    up, own = F.col("direction") == "up", seeds.select("seed").distinct().join(nodes.select(F.col("id").alias("seed"), "kind", "path"), "seed", "left")
    internal = lambda rows: rows.filter(F.col("kind").isin(*INTERNAL) & (F.col("path") != "")).select("seed", "path")
    files = internal(own).unionByName(internal(radius)).groupBy("seed").agg(F.countDistinct("path").alias("internal_files"))
    counts = radius.groupBy("seed").agg(
        F.count_if(up).alias("upstream"), F.count_if(~up).alias("downstream"), F.countDistinct("path").alias("files"), F.count_if(up & (F.col("kind") == "ROUTE")).alias("entrypoints"),
        F.count_if("conservative").alias("conservative"), F.max("distance").alias("max_distance"), F.max("n_reached").alias("reached"),
    )
    return own.select("seed").join(counts, "seed", "left").join(files, "seed", "left").na.fill(0).select(*[x.split()[0] for x in COUNTERS.split(", ")])


def _grouped(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> tuple | None:
    """(root, tag, a, b, x, c, kind, qname, path, line): edges (0), starts up (1), nodes (3) and starts both ways (4), each group of linked repos in one partition; and what ``_across`` needs.

    Repos are linked where an edge or a start leads from one node into another's repo; such links are few and merged on the driver. None if they are not few, or if a group is too large for a task.
    A start that is no node links none, as it is never reached: its edges lie in the groups of their other ends, and seeds that it leads into a group other than their own are walked by parts.
    """
    placed = stored(_placed(seeds, nodes), "placed-seeds")
    both, up = seeds.select("seed", "id").unionByName(_defined(edges, placed)).distinct(), _own_files(placed, nodes)
    tagged = lambda d, t: d.select("seed", "id", F.lit(t).alias("tag"))
    starts = stored(tagged(both, 4).unionByName(tagged(up, 1)), "radius-starts")
    absent = stored(starts.select("id").distinct().join(nodes.select("id"), "id", "left_anti"), "absent-starts")
    ends = nodes.select("id", F.coalesce("repo_id", F.lit("")).alias("label")).unionByName(absent.select("id", F.lit(None).cast("string").alias("label")))
    at = lambda end, name: ends.select(F.col("id").alias(end), F.col("label").alias(name))
    e = edges.filter(F.col("kind").isin(*TRAVERSED)).select("src", "dst", confidence_rank("confidence").alias("x"), (F.col("kind") == "IMPORTS").cast("int").alias("c")).join(at("src", "label"), "src")
    # They lie by src now, so that equal ones are found without another shuffle.
    e = e.groupBy("src", "dst").agg(F.min("x").alias("x"), F.min("c").alias("c"), F.min("label").alias("label"))
    e = stored(e.join(at("dst", "other"), "dst").filter("label is not null or other is not null"), "walked-edges")
    s = starts.join(at("id", "label"), "id").join(at("seed", "home"), "seed", "left").withColumn("home", F.coalesce("home", F.concat(F.lit("\x00"), "seed")))
    s = stored(s, "labelled-starts")
    links = [tuple(r) for r in e.select("label", "other").unionByName(s.select("label", F.col("home").alias("other"))).filter("label <> other").distinct().limit(LINKS + 1).collect()]
    if len(links) > LINKS:
        return None
    spark, roots = edges.sparkSession, _merged(links)
    known = spark.createDataFrame(list(roots.items()), "label string, root string") if roots else None

    def rooted(d: DataFrame, label) -> DataFrame:
        d = d.withColumn("_at", label)
        if known is None:
            return d.withColumnRenamed("_at", "root")
        return d.join(F.broadcast(known.withColumnsRenamed({"label": "_at", "root": "_root"})), "_at", "left").withColumn("root", F.coalesce("_root", "_at")).drop("_at", "_root")

    # In each group a start that is no node has a name of its own.
    there = lambda root, end: F.concat(F.lit("\x00"), root, F.lit("\x00"), end)
    named = lambda end, label: F.when(F.col(label).isNull(), there("root", end)).otherwise(F.col(end))
    e = rooted(e, F.coalesce("label", "other"))
    s = rooted(s, F.col("home"))
    own = s.select("root", "tag", F.col("seed").alias("a"), named("id", "label").alias("b"))
    lines = [
        e.select("root", F.lit(0).alias("tag"), named("src", "label").alias("a"), named("dst", "other").alias("b"), "x", "c"),
        rooted(nodes, F.coalesce("repo_id", F.lit(""))).select("root", F.lit(3).alias("tag"), F.col("id").alias("a"), "kind", "qname", "path", F.col("start_line").cast("int").alias("line")),
    ]
    parts, hot = None, None
    if not absent.isEmpty():
        leads = e.filter("label is null or other is null").select(F.when(F.col("label").isNull(), F.col("src")).otherwise(F.col("dst")).alias("id"), F.col("root").alias("to")).distinct()
        away = stored(s.filter("label is null").select("seed", "root", "id").join(leads, "id"), "starts-away")
        # Seeds with the same such starts share the parts that lie elsewhere; the starts are told by their number and two hashes.
        same = F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64(F.lit("\x00"), "id")))
        hot = away.filter("to <> root").select("seed").distinct().join(away.select("seed", "root", "id").distinct(), "seed").groupBy("seed", "root").agg(same.alias("key"))
        hot = stored(hot, "seeds-away")
        hot = None if hot.isEmpty() else hot
    if hot is not None:
        far = away.drop("root").join(hot.groupBy("key").agg(F.min("seed").alias("seed")), "seed").withColumnRenamed("to", "root")
        far = far.select("root", F.lit(4).alias("tag"), F.concat(F.lit("x"), "key", F.lit("\x00"), "root").alias("a"), there("root", "id").alias("b"))
        mine = F.col("a") == F.col("seed")
        far = stored(own.join(hot.select("seed"), mine, "left_semi").withColumn("a", F.concat(F.lit("s"), "a")).unionByName(far), "parts-starts")
        own = own.join(hot.select("seed"), mine, "left_anti")
        at_hand = far.select("root").distinct()
        at_hand = F.broadcast(stored(at_hand, "parts-roots")) if at_hand.count() <= ROOTS else at_hand
        parts = far.unionByName(lines[0].join(at_hand, "root", "left_semi"), True).unionByName(lines[1].join(at_hand, "root", "left_semi"), True)
    sizes = [d.select("root") for d in (own, *lines)] + ([] if hot is None else [far.select("root")])
    size = sizes[0]
    for d in sizes[1:]:
        size = size.unionByName(d)
    if not size.groupBy("root").count().filter(F.col("count") > GROUP_ROWS).isEmpty():
        return None
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = lambda d: d.select("root", "tag", "a", "b", "x", "c", "kind", "qname", "path", "line").repartition(n, "root")
    return dealt(own.unionByName(lines[0], True).unionByName(lines[1], True)), None if hot is None else dealt(parts), hot


def _across(parts: DataFrame, hot: DataFrame, depth: int | None, max_nodes: int) -> DataFrame:
    """The radii of seeds that lead into several groups, out of their parts there. hot: (seed, root, key), root being the seed's own group and key what leads elsewhere.

    A part is one row longer than the limit, so that it holds the level at which the walk ends, and its first rows are those of the whole. ``here`` counts what a part holds at a distance, before the limit.
    """
    r = stored(parts.mapInArrow(_walker(depth, max_nodes, "parts"), PARTS), "radius-parts")
    names = F.array(*[F.lit(x) for x in CONFIDENCES])
    order = ["distance", F.array_position(names, F.col("confidence")), F.coalesce("path", F.lit("")), "line", "id"]
    cols = ["direction", "id", "kind", "qname", "path", "distance", "confidence", "conservative", "line"]
    name = F.split(F.expr("substring(seed, 2)"), "\x00", 2)
    own, away = r.filter("seed like 's%'").withColumn("seed", F.expr("substring(seed, 2)")), r.filter("seed like 'x%'").withColumns({"key": name[0], "to": name[1]})
    # Each seed leaves out what lies in its own group, so that so many more rows are kept.
    most = away.groupBy("key", "direction", "to").count().groupBy("key", "direction").agg(F.max("count").alias("most"))
    near = away.select("key", "to", *cols).withColumn("n", F.row_number().over(Window.partitionBy("key", "direction").orderBy(*order)))
    near = near.filter(F.col("n") <= 2 * (max_nodes + 1)).join(most, ["key", "direction"]).filter(F.col("n") <= max_nodes + 1 + F.col("most"))
    rows = own.select("seed", *cols).unionByName(hot.join(near, "key").filter("root <> to").select("seed", *cols))
    levels = r.select("seed", "direction", "distance", "here").distinct()
    levels = levels.withColumns({"key": F.when(F.col("seed").startswith("x"), name[0]), "to": F.when(F.col("seed").startswith("x"), name[1])})
    elsewhere, each = levels.filter("key is not null").groupBy("key", "direction", "distance").agg(F.sum("here").alias("here")), ["seed", "direction", "distance", "here"]
    levels = levels.filter("key is null").withColumn("seed", F.expr("substring(seed, 2)")).select(*each).unionByName(hot.join(elsewhere, "key").select(*each)).unionByName(
        hot.join(levels.filter("key is not null").drop("seed").withColumnRenamed("to", "root"), ["key", "root"]).withColumn("here", -F.col("here")).select(*each))
    levels = levels.groupBy("seed", "direction", "distance").agg(F.sum("here").alias("here"))
    levels = levels.withColumn("so_far", F.sum("here").over(Window.partitionBy("seed", "direction").orderBy("distance")))
    reached = levels.filter(F.col("so_far") - F.col("here") <= max_nodes).groupBy("seed", "direction").agg(F.max("so_far").alias("n_reached"))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("seed", "direction").orderBy(*order))).filter(F.col("position") <= max_nodes)
    return rows.join(reached, ["seed", "direction"]).select(*[x.split()[0] for x in RADIUS.split(", ")])


def _merged(links: list[tuple[str, str]]) -> dict[str, str]:
    """The group of each label that is linked to another one."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    return {x: root(x) for x in list(up)}


def _walker(depth: int | None, max_nodes: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := [b for b in batches if b.num_rows]:
            yield from _walk(pa.Table.from_batches(got).combine_chunks(), depth, max_nodes, out)

    return run


def _walk(rows: pa.Table, depth: int | None, max_nodes: int, out: str) -> Iterator[pa.RecordBatch]:
    """The radii of all seeds of a partition, level by level for as many seeds at once as VISITS allows. out: rows, parts (see ``_across``) or counters."""
    tag = rows["tag"].to_numpy()
    at = np.flatnonzero((tag == 1) | (tag == 4))
    way = np.append(np.ones(len(at), np.int64), np.full(int((tag == 4).sum()), 2))
    at = np.append(at, np.flatnonzero(tag == 4))
    edge, start, node = (rows.take(x) for x in (np.flatnonzero(tag == 0), at, np.flatnonzero(tag == 3)))
    if not start.num_rows:
        return
    flat = lambda *cs: pa.chunked_array([k for c in cs for k in c.chunks], pa.string()).combine_chunks()
    ids = flat(node["a"], edge["a"], edge["b"], start["b"]).dictionary_encode()
    code, n = ids.indices.to_numpy(zero_copy_only=False), len(ids.dictionary)
    node_at, src, dst, start_at = np.split(code, np.cumsum([node.num_rows, edge.num_rows, edge.num_rows]))
    group = np.zeros(n, np.int64)
    root = rows["root"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    group[np.concatenate([node_at, src, dst, start_at])] = np.concatenate([root[tag == 3], root[tag == 0], root[tag == 0], root[at]])
    size = np.bincount(group)
    attr = np.full(n, -1, np.int64)
    attr[node_at] = np.arange(node.num_rows)
    there = attr >= 0
    path = pc.fill_null(node["path"], "")
    order = np.zeros(n, np.int64)
    if node.num_rows:
        order[node_at[pc.sort_indices(pa.table({"p": path, "l": node["line"], "a": node["a"]}), sort_keys=[("p", "ascending"), ("l", "ascending"), ("a", "ascending")], null_placement="at_start").to_numpy()]] = np.arange(node.num_rows)
    is_in = lambda kinds: np.append(pc.fill_null(pc.is_in(node["kind"], pa.array(kinds)), False).to_numpy(), False)[attr]
    expand, internal, route = is_in(EXPANDABLE), is_in(INTERNAL), is_in(["ROUTE"])
    files = pa.chunked_array(node["path"].chunks, pa.string()).combine_chunks().dictionary_encode()
    file = np.append(pc.fill_null(files.indices, -1).to_numpy(zero_copy_only=False), -1)[attr].astype(np.int64)
    named = np.append(pc.not_equal(files.dictionary, "").to_numpy(zero_copy_only=False).astype(bool), False)[file]
    rank, cons = edge["x"].to_numpy().astype(np.int64), edge["c"].to_numpy().astype(np.int64)

    def moves(near: np.ndarray, far: np.ndarray) -> tuple:
        k = np.flatnonzero(there[far])
        k = k[np.argsort(near[k], kind="stable")]
        return np.searchsorted(near[k], np.arange(n + 1)), far[k], rank[k], cons[k]

    ways = {1: moves(dst, src), 2: moves(src, dst)}
    seeds = pa.chunked_array(start["a"].chunks, pa.string()).combine_chunks().dictionary_encode()
    seed = seeds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # What a seed may visit: its first moves, and then no more than its group holds or, but for the last level, than the limit.
    visits = np.zeros(len(seeds.dictionary), np.int64)
    visits[seed] = np.minimum(size[group[start_at]], max_nodes)
    for w, (first, *_) in ways.items():
        np.add.at(visits, seed[way == w], np.diff(first)[start_at[way == w]])
    visits = np.cumsum(visits)
    own = pc.fill_null(pc.index_in(seeds.dictionary, ids.dictionary), n).to_numpy(zero_copy_only=False)
    low = 0
    while low < len(visits):
        high = max(low + 1, int(np.searchsorted(visits, (visits[low - 1] if low else 0) + VISITS, "right")))
        found = []
        for w in (1, 2):
            mine = (way == w) & (seed >= low) & (seed < high)
            found.append((w, *_levels(seed[mine] - low, start_at[mine], high - low, expand, ways[w], depth, max_nodes, order, out == "parts")))
        names = seeds.dictionary.slice(low, high - low)
        if out == "counters":
            m, tops = high - low, np.append(file, -1)[own[low:high]]
            one = lambda s: np.bincount(s, minlength=m)
            pairs = lambda s, f: one(np.unique(s * (len(files.dictionary) + 1) + f) // (len(files.dictionary) + 1))
            s, v, far = (np.concatenate([x[i] for x in found]) for i in (1, 2, 3))
            kept, most, reached = file[v] >= 0, np.zeros(m, np.int64), np.zeros(m, np.int64)
            np.maximum.at(most, s, far)
            for x in found:
                np.maximum.at(reached, x[1], x[7])
            inside, self_inside = internal[v] & kept & named[v], np.append(internal & (file >= 0) & named, False)[own[low:high]]
            up_s, up_v = found[0][1], found[0][2]
            columns = [names, one(up_s), one(found[1][1]), pairs(s[kept], file[v][kept]), pairs(np.concatenate([s[inside], np.flatnonzero(self_inside)]), np.concatenate([file[v][inside], tops[self_inside]])), one(up_s[route[up_v]]),
                       one(s[np.concatenate([x[5] for x in found]) == 1]), most.astype(np.int32), reached]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in COUNTERS.split(", ")])
        else:
            for w, *cols in found:
                for k in range(0, len(cols[0]), 50_000):
                    s, v, far, r, c, place, total, *here = (x[k : k + 50_000] for x in cols)
                    take = lambda name: node[name].take(pa.array(attr[v])).combine_chunks()  # noqa: B023, E731
                    columns = [names.take(pa.array(s)), pa.array(["up" if w == 1 else "down"] * len(s)), take("a"), take("kind"), take("qname"), take("path"), pa.array(far.astype(np.int32)), pa.array(CONFIDENCES).take(pa.array(r)), pa.array(place.astype(np.int32)), pa.array(c == 1)]
                    columns += [take("line"), pa.array(here[0])] if here else [pa.array(total)]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in (PARTS if here else RADIUS).split(", ")])
        low = high


def _levels(s, v, m, expand, way, depth, max_nodes, order, more=False) -> tuple:
    """(seed, node, distance, rank, conservative, position, n_reached) of what the m seeds reach, in order, at most ``max_nodes`` each; see ``reach``. Of parts one more, and how many are as far.

    Visited nodes are kept as sorted keys, so memory and time go by what is visited, not by the size of the group."""
    first, far, rank, cons = way
    n = len(expand)
    seen, count, r = np.unique(s * n + v), np.zeros(m, np.int64), np.zeros(len(s), np.int64)
    parts, level = [[np.zeros(0, np.int64)] * 5], 0
    while len(s) and (depth is None or level < depth):
        level += 1
        degree = first[v + 1] - first[v]
        rep = np.repeat(np.arange(len(s)), degree)
        e = first[v][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(degree) - degree, degree)
        key = s[rep] * n + far[e]
        new = seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] != key
        rep, e, key = rep[new], e[new], key[new]
        by = np.argsort(key, kind="stable")
        rep, e, key = rep[by], e[by], key[by]
        if not len(key):
            break
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        r, c = np.minimum.reduceat(np.maximum(r[rep], rank[e]), at), np.minimum.reduceat(cons[e], at)
        s, v = s[rep][at], far[e][at]
        seen = np.sort(np.concatenate([seen, key[at]]), kind="stable")
        count += np.bincount(s, minlength=len(count))
        parts.append([s, v, np.full(len(s), level), r, c])
        on = expand[v] & (count[s] <= max_nodes)
        s, v, r = s[on], v[on], r[on]
    s, v, distance, r, c = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((order[v], r, distance, s))
    s, v, distance, r, c = s[by], v[by], distance[by], r[by], c[by]
    place = np.arange(len(s)) - np.searchsorted(s, s) + 1
    kept, out = place <= max_nodes + more, (s, v, distance, r, c, place, count[s])
    if more:
        far = s * (level + 1) + distance
        out += (np.searchsorted(far, far, "right") - np.searchsorted(far, far),)
    return tuple(x[kept] for x in out)


def impact_summary(radius: DataFrame) -> DataFrame:
    """Counters of a blast radius per seed: nodes up and down, files, entry points, strongest distance."""
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    return radius.groupBy("seed").agg(
        F.count_if(up).alias("n_upstream"), F.count_if(down).alias("n_downstream"), F.countDistinct("path").alias("n_files"),
        F.count_if(up & (F.col("kind") == "ROUTE")).alias("n_entrypoints"), F.max("distance").alias("max_distance"),
    )
