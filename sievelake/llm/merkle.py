"""A Merkle manifest of a dataset: leaves, subroots by group, a root over the groups, and a proof for every row.

Leaves are range-partitioned by group and order key, so a partition holds a contiguous stretch of each of its groups, and the
stretches' first indexes follow from their sizes. A partition runs a mountain range over each stretch: a stack of unfinished runs
by level, where a run that fills up carries its hash one level higher. Completed nodes are records; what is left of runs that a
border cuts are edges. Edges of neighbouring partitions meet in rounds of `MERGE` partitions a task until all runs are whole. The
last run of a level is hashed as it is, without padding.

A row's proof needs the nodes beside its path. Those that its partition cannot work out itself lie on the edges, a few a level
and border, and are joined to the partition; the path is then folded there. The groups' subroots form a tree by the same steps.

Defined results: a null field is `-`; rows are ordered by id, null first, then by leaf; a null group comes first; a group of one
leaf is its own subroot, a table of one group its own root, and the proof of a lone leaf the hash of nothing; repeated rows are
leaves each; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sievelake.llm.common import batches, written

#: Leaves of a partition, and partitions whose edges meet in a task of one round.
SEGMENT_ROWS, MERGE = 131_072, 32
#: monotonically_increasing_id() counts rows of a partition in its lower bits.
POSITION_BITS = 33
Path = list[tuple[str, str]]
SIDES = "array<struct<left: string, right: string>>"
NODE = "team long, level int, idx long, digest string, part long, open boolean"


def digest_of(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def sizes(n: int, fanout: int) -> list[int]:
    """How many nodes each level has, from the leaves to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def mountains(digests: Iterable[str], start: int, n: int, fanout: int) -> Iterator[tuple[int, int, str, bool]]:
    """(level, index, digest, open) of a stretch of leaves: completed nodes, and nodes whose run a border cuts, which are open.

    Leaves of completed runs are not repeated. A peak is a node that no run above it completes; it stays on the stack until the end.
    """
    levels = sizes(n, fanout)
    stack: list[list[tuple[int, str]]] = [[] for _ in levels]  # the unfinished run of each level
    for index, digest in enumerate(digests, start):
        for level, run in enumerate(stack):
            if level == len(levels) - 1:
                yield level, index, digest, False
                break
            run.append((index, digest))
            if index % fanout < fanout - 1 and index < levels[level] - 1:
                break
            whole = run[0][0] % fanout == 0  # else it begins in an earlier partition
            if level or not whole:
                yield from ((level, i, x, not whole) for i, x in run)
            parent = digest_of(x for _, x in run)
            run.clear()
            if not whole:
                break
            index, digest = index // fanout, parent
    for level, run in enumerate(stack):
        yield from ((level, i, x, True) for i, x in run)


def merge(edges: list[tuple[int, int, str]], n: int, fanout: int) -> Iterator[tuple[int, int, str, bool]]:
    """Complete what runs can be: (level, index, digest, open) of new nodes, and of edges that stay open."""
    levels = sizes(n, fanout)
    waiting: dict[int, dict[int, str]] = {}
    for level, index, digest in edges:
        waiting.setdefault(level, {})[index] = digest
    for level in range(len(levels)):
        nodes = waiting.pop(level, {})
        if level == len(levels) - 1:
            yield from ((level, i, x, False) for i, x in nodes.items())
            continue
        runs: dict[int, list[int]] = {}
        for index in sorted(nodes):
            runs.setdefault(index // fanout, []).append(index)
        for parent, run in runs.items():
            whole = len(run) == min(fanout, levels[level] - parent * fanout)
            yield from ((level, i, nodes[i], not whole) for i in run)
            if whole:
                waiting.setdefault(level + 1, {})[parent] = digest_of(nodes[i] for i in run)


def paths(digests: list[str], start: int, n: int, fanout: int, near: dict[tuple[int, int], str]) -> Iterator[Path]:
    """For each leaf of a stretch the digests left and right of its path in every run, from the leaves up."""
    levels = sizes(n, fanout)
    above: list[Path] = []  # by level, for each node on a path
    first = [start]
    nodes = digests
    for level in range(len(levels) - 1):
        begin, reach = first[-1], first[-1] + len(nodes)
        low, high = begin // fanout * fanout, min(-(-reach // fanout) * fanout, levels[level])
        row = [near[level, i] for i in range(low, begin)] + nodes + [near[level, i] for i in range(reach, high)]
        sides, parents = [], []
        for at in range(0, len(row), fanout):
            run = row[at : at + fanout]
            parents.append(digest_of(run))
            sides += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
        above.append(sides[begin - low : reach - low])
        first.append(low // fanout)
        nodes = parents
    for i in range(start, start + len(digests)):
        yield [side[i // fanout**level - first[level]] for level, side in enumerate(above)]


def leaf(columns: list[str], replaced: dict[str, Column] | None = None) -> Column:
    """The hash of a row's fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""

    def field(name: str) -> Column:
        x = (replaced or {}).get(name, F.col(f"`{name}`")).cast("string")
        return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)), 256)


@dataclass
class Forest:
    """Trees by group. `rows` has part, place, leaf and the leaves' other columns; `segments` a row for each stretch of a group in a
    partition; `nodes` the completed nodes above the leaves; `spine` those that a border of partitions touches, leaves too; `roots`
    team, group_key, n and subroot of each group."""

    rows: DataFrame
    segments: DataFrame
    nodes: DataFrame
    spine: DataFrame
    roots: DataFrame
    fanout: int


def as_table(found: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*found, strict=True) if found else ([] for _ in schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def powers(fanout: int) -> Column:
    """How many leaves a node of each level covers at most."""
    out = [1]
    while out[-1] * fanout < 1 << 62:
        out.append(out[-1] * fanout)
    return F.array(*(F.lit(x).cast("long") for x in out))


def plant(leaves: DataFrame, group: str | None, order: list[str], fanout: int = 3, segment_rows: int = SEGMENT_ROWS) -> Forest:
    """Build the trees over column `leaf`. `leaves` should be a written table, as it is counted, sampled and sorted."""
    spark = leaves.sparkSession
    batches(spark)
    n = leaves.count()
    parts = max(-(-n // segment_rows), min(spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    # equal leaves may stand in any order, so a number of their own lets a border fall between them
    keys = [F.col("group_key").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("turn")]
    rows = leaves.withColumns({"group_key": F.col(group) if group else F.lit(1), "turn": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("turn").withColumn("place", F.monotonically_increasing_id())
    rows = written(rows.withColumn("part", F.shiftright("place", POSITION_BITS)), "merkle-rows")

    whole = Window.partitionBy("group_key")
    segments = rows.groupBy("part", "group_key").agg(F.min("place").alias("begins"), F.count(F.lit(1)).alias("size"))
    segments = written(segments.withColumns({"start": F.sum("size").over(whole.orderBy("part")) - F.col("size"), "n": F.sum("size").over(whole), "team": F.min("begins").over(whole)}), "merkle-segments")
    teams = segments.where("start = 0").select("team", "group_key", "n")
    parts = (segments.agg(F.max("part")).first()[0] or 0) + 1
    node_schema = arrow(NODE)

    def climb(left: pa.Table, right: pa.Table) -> pa.Table:
        left, found = left.sort_by("place"), []
        digests, base = left["leaf"].to_pylist(), left["place"][0].as_py()
        for s in right.to_pylist():
            at = s["begins"] - base
            found += [(s["team"], *x[:3], s["part"], x[3]) for x in mountains(digests[at : at + s["size"]], s["start"], s["n"], fanout)]
        return as_table(found, node_schema)

    def join_edges(table: pa.Table) -> pa.Table:
        teams: dict[tuple[int, int], list] = {}
        for r in table.to_pylist():
            teams.setdefault((r["team"], r["n"]), []).append((r["level"], r["idx"], r["digest"]))
        bucket = table["bucket"][0].as_py()
        return as_table([(team, *x[:3], bucket, x[3]) for (team, n), edges in teams.items() for x in merge(edges, n, fanout)], node_schema)

    stretches = segments.select("part", "begins", "size", "start", "n", "team")
    first = written(rows.select("part", "place", "leaf").groupBy("part").cogroup(stretches.groupBy("part")).applyInArrow(climb, NODE), "merkle-nodes")
    spine, last = [first.where("open")], first
    while parts > 1:  # only the first and the last group of a partition have edges, so a task gets few rows
        edges = last.where("open").join(teams.select("team", "n"), "team").withColumn("bucket", F.expr(f"part div {MERGE}"))
        last = written(edges.groupBy("bucket").applyInArrow(join_edges, NODE), "merkle-merge")
        spine.append(last)
        parts = -(-parts // MERGE)
    closed = reduce(DataFrame.unionByName, spine[1:], first).where("not open")
    roots = closed.join(teams, "team").where(F.col("level") == F.size(F.filter(powers(fanout), lambda p: p < F.col("n")))).select("team", "group_key", "n", F.col("digest").alias("subroot"))
    touched = reduce(DataFrame.unionByName, spine).groupBy("team", "level", "idx").agg(F.min("digest").alias("digest"))  # open first, joined later
    return Forest(rows, segments, closed.where("level > 0").select("team", "level", "idx", "digest"), touched, written(roots, "merkle-roots"), fanout)


def beside(forest: Forest) -> DataFrame:
    """part, team, level, idx, digest: what stands beside the paths of a stretch and is not an ancestor of its leaves."""
    wanted = forest.segments.where("size < n").select("*", F.posexplode(powers(forest.fanout)).alias("level", "span")).where("span < n")
    wanted = wanted.withColumns({"low": F.expr("start div span"), "high": F.expr("(start + size - 1) div span"), "most": F.expr("(n + span - 1) div span")})
    runs = wanted.withColumn("run", F.explode(F.expr(f"array_distinct(array(low div {forest.fanout}, high div {forest.fanout}))")))
    children = runs.withColumn("idx", F.explode(F.expr(f"sequence(run * {forest.fanout}, run * {forest.fanout} + {forest.fanout - 1})")))
    return children.where("idx < most and (idx < low or idx > high)").select("part", "team", "level", "idx").join(forest.spine, ["team", "level", "idx"])


def walk(forest: Forest, columns: list[str], schema: str, finish: Callable[[list, Path, dict], tuple], upper: DataFrame | None = None) -> DataFrame:
    """A row for each leaf: finish(leaf and the values of columns, its path, the row of its stretch). `upper` joins team with more columns for the stretch."""
    stretches = forest.segments.select("part", "team", "begins", "size", "start", "n")
    around = beside(forest).groupBy("part", "team").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("near"))  # a few for each level
    context = stretches.join(around, ["part", "team"], "left")
    context = context.join(upper, "team") if upper is not None else context
    fanout, names, out = forest.fanout, ["leaf", *columns], arrow(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, found = left.sort_by("place"), []
        base, own = left["place"][0].as_py(), [left[c].to_pylist() for c in names]
        for s in right.to_pylist():
            near = {(x["level"], x["idx"]): x["digest"] for x in s["near"] or ()}
            at, end = s["begins"] - base, s["begins"] - base + s["size"]
            found += [finish(list(values), path, s) for *values, path in zip(*(c[at:end] for c in own), paths(own[0][at:end], s["start"], s["n"], fanout, near), strict=True)]
        return as_table(found, out)

    return forest.rows.select("part", "place", *names).groupBy("part").cogroup(context.groupBy("part")).applyInArrow(run, schema)


def folded(digest: str, path: Path) -> str:
    for left, right in path:
        digest = digest_of((left, digest, right))
    return digest


def manifest(docs: DataFrame, columns: list[str], id_column: str, group_column: str, tampered: dict[str, Column] | None = None, fanout: int = 3, segment_rows: int = SEGMENT_ROWS) -> tuple[Forest, DataFrame]:
    """The forest of all groups, and a row for each row of `docs`: id, leaf, subroot, root, proof_sha256, and the check of the row as
    `tampered` has it (columns in place of those in `docs`): folded_root, verified."""
    changed = leaf(columns, tampered) if tampered else F.lit(None).cast("string")
    leaves = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{group_column}`").alias("team_name"), leaf(columns).alias("leaf"), changed.alias("now"))
    leaves = written(leaves.withColumn("now", F.nullif("now", "leaf")), "merkle-leaves")
    forest = plant(leaves, "team_name", ["id", "leaf"], fanout, segment_rows)
    top = plant(forest.roots.select("team", "group_key", F.col("subroot").alias("leaf")).withColumnRenamed("group_key", "name"), None, ["name"], fanout, segment_rows)
    one = walk(top, ["team"], f"team long, subroot string, root string, upper {SIDES}", lambda own, path, _: (own[1], own[0], folded(own[0], path), [{"left": a, "right": b} for a, b in path]))
    kind = docs.schema[id_column].dataType.simpleString()

    def prove(own: list, path: Path, s: dict) -> tuple:
        found, known, now = own
        path = path + [(x["left"], x["right"]) for x in s["upper"]]
        root = folded(now or found, path)
        return known, found, s["subroot"], s["root"], digest_of(x for side in path for x in side), root, root == s["root"]

    schema = f"`{id_column}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return forest, walk(forest, ["id", "now"], schema, prove, written(one, "merkle-top"))
