"""A Merkle tree over a dataset by supersteps of messages: digests climb to the root, sibling paths come down to the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.common import fresh, shared_folder, stored

#: Consecutive nodes below a node of the next level; levels that a superstep climbs; vertices that a task takes in a superstep,
#: at least and at most; supersteps between checkpoints.
FAN_OUT, LEVELS, LEAST_OF_A_TASK, MOST_OF_A_TASK, CHECKPOINT_STEPS = 3, 3, 1_000, 20_000, 2
SPAN = FAN_OUT**LEVELS

Key = tuple[int, int]  # group, place among the vertices of a superstep


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 over digests, each as lowercase hex."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes' count, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(f) for f in fields)), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str], place: str) -> DataFrame:
    """`rows` with `place`, gapless from 0 in each group by `order`, nulls first.

    Rows are dealt out by ranges of group and order, so a large group lies in many ranges; each range is numbered on its own,
    and the counts of the groups in earlier ranges are added. Rows equal in all of these are told apart by where they are read.
    """
    part, inside, before, n, tie = fresh(rows, "part", "inside", "before", "n", "tie")
    order = [*order, tie]
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*(F.col(c).asc_nulls_first() for c in [*group, *order]))
    ranged = stored(ranged.withColumn(part, F.spark_partition_id()))
    counts = ranged.groupBy(*group, part).agg(F.count("*").alias(n))
    behind = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, part, F.coalesce(F.sum(n).over(behind), F.lit(0)).alias(before))
    within = ranged.withColumn(inside, F.row_number().over(Window.partitionBy(*group, part).orderBy(*(F.col(c).asc_nulls_first() for c in order))) - 1)
    names = dict(zip(group, fresh(within, *(f"{g}_of" for g in group)), strict=True))
    few = counts.select(*(F.col(g).alias(names[g]) for g in group), F.col(part).alias(f"{part}_of"), before)
    same = [F.col(g).eqNullSafe(F.col(names[g])) for g in group]
    joined = within.join(few, [F.col(part) == F.col(f"{part}_of"), *same])
    return joined.select(*rows.columns, (F.col(inside) + F.col(before)).cast("long").alias(place))


def _tasks(nodes: int, parallel: int) -> int:
    return max(-(-nodes // MOST_OF_A_TASK), min(parallel, -(-nodes // LEAST_OF_A_TASK)), 1)


def vertices(sizes: DataFrame, size: str) -> list[int]:
    """The vertices of all groups in each superstep, from the leaves up to the one in which every group has a single one."""
    found = sizes.agg(*(F.sum(F.ceil(F.col(size) / SPAN**step)).alias(str(step)) for step in range(14))).first()
    counts = [int(n or 0) for n in found]
    return counts[: counts.index(counts[-1]) + 1]


def levels_of(digests: list[bytes], nodes: int) -> tuple[list[list[bytes]], bytes, int]:
    """The levels that a vertex hashes, from the digests it was told up; its own digest; the nodes that its group has then.

    A group of one node is complete: it isn't hashed again.
    """
    levels = []
    while nodes > 1 and len(levels) < LEVELS:
        levels.append(digests)
        digests, nodes = [digest(digests[k : k + FAN_OUT]) for k in range(0, len(digests), FAN_OUT)], -(-nodes // FAN_OUT)
    return levels, digests[0], nodes


def climb(leaves: RDD, counts: list[int]) -> tuple[list[RDD], RDD]:
    """Upward supersteps over `leaves`: ((group, place), (digest, nodes of the group)).

    Every node messages its digest to the vertex that stands for its ancestor LEVELS above; a vertex that has been told by all
    hashes the levels between and is a node of the next superstep. A group of one node is complete, its digest is the group's
    root. `counts` are the vertices of each superstep. Returns for each superstep the vertices with what they were told
    ((group, place), (digests, nodes)), and the roots ((group, 0), digest). Every few supersteps, and the roots, are written
    to the shared folder, so that a lost executor costs a few supersteps at most.
    """
    told: list[RDD] = []
    parallel, now = leaves.context.defaultParallelism, leaves
    done = [now.filter(lambda x: x[1][1] == 1)]
    for step, expected in enumerate(counts[1:], 1):
        messages = now.filter(lambda x: x[1][1] > 1).map(lambda x: ((x[0][0], x[0][1] // SPAN), (x[0][1] % SPAN, *x[1])))
        vertex = messages.groupByKey(_tasks(expected, parallel)).mapValues(_ordered)
        if step % CHECKPOINT_STEPS == 1:
            vertex.checkpoint()
        told.append(vertex)
        now = vertex.mapValues(lambda v: levels_of(*v)[1:])
        done.append(now.filter(lambda x: x[1][1] == 1))
    roots = leaves.context.union(done).mapValues(lambda v: v[0]).partitionBy(_tasks(counts[-1], parallel))
    roots.checkpoint()
    return told, roots


def _ordered(messages: Iterable[tuple]) -> tuple[list[bytes], int]:
    found = sorted(messages)
    return [d for _, d, _ in found], found[0][2]


def descend(told: list[RDD], roots: RDD) -> RDD:
    """Downward supersteps: from ((group, 0), (mark, path)) of the roots to ((group, place), (mark, path)) of the leaves.

    A vertex messages each node that told it the siblings' digests of the levels between, before its own path. A path is a
    list of (place in its run, siblings in their order), from the node up to the root. What no vertex of a superstep waits
    for are roots of lower groups: they stay until their superstep comes.
    """
    now = roots
    for vertex in reversed(told):
        now = vertex.cogroup(now.partitionBy(vertex.getNumPartitions()), numPartitions=vertex.getNumPartitions()).flatMap(_tell)
    return now


def _tell(node: tuple[Key, tuple]) -> Iterator[tuple[Key, tuple]]:
    (group, place), (known, told) = node
    mark, path = next(iter(told))
    found = list(known)
    for digests, nodes in found:
        levels = levels_of(digests, nodes)[0]
        for k in range(len(digests)):
            own, at = [], k
            for level in levels:
                first = at - at % FAN_OUT
                own.append((at % FAN_OUT, level[first:at] + level[at + 1 : first + FAN_OUT]))
                at //= FAN_OUT
            yield (group, place * SPAN + k), (mark, own + path)
    if not found:
        yield (group, place), (mark, path)


PATH = "array<struct<place: int, siblings: array<binary>>>"


def merkle_manifest(docs: DataFrame, leaf: Column, group_column: str = "source", id_column: str = "doc_id") -> DataFrame:
    """All columns of `docs`, then leaf, subroot, root (lowercase hex) and path (array of place, siblings), from the leaf up.

    `leaf` is the SHA-256 of a row, as lowercase hex. Rows of a group ascend by id, then by leaf, nulls first; groups ascend,
    null first, strings by their bytes. Three consecutive nodes make one of the next level, and the last ones what is left. A
    group of one row has its leaf as subroot, a table of one group its subroot as root. Repeated rows are leaves of their own,
    with paths of their own. A column whose name clashes with one of the added keeps its name, and the added one gets a
    longer name. An empty table gives an empty result. Only the root comes to the driver.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    g, place, own, size, binary_path, sub = fresh(docs, "g", "place", "own", "size_of", "binary_path", "sub")
    added = fresh(docs, "leaf", "subroot", "root", "path")
    rows = stored(docs.withColumn(own, F.unhex(leaf)))
    sizes = numbered(rows.groupBy(group_column).agg(F.count("*").alias(size)), [], [group_column], g)
    key = fresh(rows, "key")[0]
    sizes = stored(sizes.withColumnRenamed(group_column, key))
    placed = rows.join(sizes, F.col(group_column).eqNullSafe(F.col(key))).drop(key)
    placed = stored(numbered(placed, [g], [id_column, own], place))
    leaves = placed.select(g, place, own, size).rdd.map(lambda r: ((r[0], r[1]), (bytes(r[2]), r[3])))
    told, subroots = climb(leaves, vertices(sizes, size))
    groups = sizes.count()
    upper, roots = climb(subroots.map(lambda x: ((0, x[0][0]), (x[1], groups))), vertices(sizes.agg(F.count("*").alias(size)), size))
    found = roots.values().collect()
    root = found[0].hex() if found else None
    down = descend(upper, spark.sparkContext.parallelize([((0, 0), (None, []))] if found else [], 1))
    marked = down.map(lambda x: ((x[0][1], 0), x[1][1])).join(subroots).map(lambda x: (x[0], (x[1][1], x[1][0])))
    paths = descend(told, marked).map(lambda x: (*x[0], bytearray(x[1][0]), [(k, [bytearray(d) for d in siblings]) for k, siblings in x[1][1]]))
    found_paths = spark.createDataFrame(paths, f"`{g}` long, `{place}` long, `{sub}` binary, `{binary_path}` {PATH}")
    hexed = F.transform(binary_path, lambda s: F.struct(s["place"].alias("place"), F.transform(s["siblings"], lambda d: F.lower(F.hex(d))).alias("siblings")))
    values = (F.lower(F.hex(own)), F.lower(F.hex(sub)), F.lit(root).cast("string"), hexed)
    return placed.join(found_paths, [g, place]).select(*docs.columns, *(v.alias(a) for v, a in zip(values, added, strict=True)))


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings' digests, level by level from the leaf up."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["siblings"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path: at each level the siblings around it are hashed with it."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(F.array_join(F.slice(s["siblings"], F.lit(1), s["place"]), ""), own, F.array_join(F.slice(s["siblings"], s["place"] + 1, F.lit(FAN_OUT)), "")), 256))
