"""Pairs within groups: dealt out to tasks by their number, and what two values say together worked out once for these values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.session import cut

#: Pairs that a task makes, about; a group of more is dealt to several.
TASK_PAIRS = 1 << 20
#: Pairs of distinct values at most that are worked out beforehand and looked up: so many rows are broadcast.
FEW = 1 << 17


def dealt(left: DataFrame, right: DataFrame, keys: list[str], row_id: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt out by groups, and the columns to join them on.

    Adaptive execution puts small inputs into few tasks, however many pairs they make. Here the number of tasks follows from
    the number of pairs, and the left rows of a large group are dealt by `row_id` to several blocks that each hold all right
    rows of the group. Columns of no other use should be left out before.
    """
    of = lambda rows, name: rows.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = of(left, "_l").join(of(right, "_r"), keys).withColumn("_pairs", F.col("_l").cast("double") * F.col("_r"))
    large = sizes.where(F.col("_pairs") > TASK_PAIRS).select(*keys, F.least(F.ceil(F.col("_pairs") / TASK_PAIRS), F.col("_l")).cast("int").alias("_blocks"))
    tasks = int((sizes.agg(F.sum("_pairs")).first()[0] or 0) // TASK_PAIRS) + left.sparkSession.sparkContext.defaultParallelism
    number = F.coalesce("_blocks", F.lit(1))
    left = left.join(large, keys, "left").withColumn("_block", F.pmod(F.xxhash64(*row_id), number).cast("int")).drop("_blocks")
    right = right.join(large, keys, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), number - 1))).drop("_blocks")
    on = [*keys, "_block"]
    return left.repartition(tasks, *on), right.repartition(tasks, *on), on


def paired(left: DataFrame, right: DataFrame, keys: list[str], row_id: list[str], where: Column | None = None) -> DataFrame:
    """Every left row with every right row of its group, with the left row's `_block`.

    A left row's pairs are in one task, so what goes by left row needs no exchange if it goes by `keys` and `_block` as well.
    """
    one, other, on = dealt(left, right, keys, row_id)
    pairs = one.join(other.hint("merge"), on)
    return pairs if where is None else pairs.where(where)


def pairs_with(left: DataFrame, right: DataFrame, keys: list[str], row_id: list[str], found: dict[str, tuple[list[str], list[str], Column]], keep: list[str], where: Column | None = None) -> DataFrame:
    """`keep`, `_block` and `found` of all pairs within groups. `found` has by name columns of either side and what they say together.

    Where the distinct values of both sides make FEW pairs at most, each of these is worked out once, and the pairs, which
    then carry two small numbers instead of the values, look it up; else it is worked out for each pair.
    """
    context, tables, direct, needed = left.sparkSession.sparkContext, [], {}, {*keys, *keep, *row_id}
    alike: dict[tuple[tuple[str, ...], tuple[str, ...]], dict[str, Column]] = {}
    for name, (ls, rs, said) in found.items():
        alike.setdefault((tuple(ls), tuple(rs)), {})[name] = said
    for k, ((ls, rs), said) in enumerate(alike.items()):
        values = [cut(side.select(*columns).distinct()) for side, columns in ((left, ls), (right, rs))]
        if values[0].count() * values[1].count() > FEW:
            direct |= said
            needed |= {*ls, *rs}
            continue
        a, b = f"_l{k}", f"_r{k}"
        one, other = _numbered(values[0], a), _numbered(values[1], b)
        left, right = _with_number(left, one, ls, a), _with_number(right, other, rs, b)
        tables.append((a, b, one.repartition(context.defaultParallelism, a).crossJoin(other).select(a, b, *(x.alias(n) for n, x in said.items()))))
        needed |= {a, b}
    narrow = lambda rows: rows.select(*(n for n in rows.columns if n in needed))
    pairs = paired(narrow(left), narrow(right), keys, row_id, where)
    for a, b, table in tables:
        pairs = pairs.join(F.broadcast(table), [a, b])
    return pairs.withColumns(direct).select(*keep, "_block", *found)


def alike(rows: DataFrame, keys: list[str], values: list[str], name: str, **told: Column) -> tuple[DataFrame, DataFrame]:
    """`rows` with the number `name` of their class in place of `values`, and the classes: `keys`, `values`, what is `told`, `name`.

    A class holds the rows that are alike in keys and values, nulls being alike. The numbers have no other meaning.
    """
    own = [*keys, *values]
    classes = cut(rows.groupBy(*own).agg(*(x.alias(n) for n, x in told.items())).withColumn(name, F.monotonically_increasing_id()))
    named = classes.select(*(F.col(n).alias(f"_of_{n}") for n in own), name)
    same = (F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in own)
    return rows.join(named, reduce(lambda p, q: p & q, same)).select(*(n for n in rows.columns if n not in values), name), classes


def tallied(left: DataFrame, right: DataFrame, keys: list[str], ls: list[str], rs: list[str]) -> DataFrame:
    """(ls, rs, pairs): how many pairs within groups have these values, counted without making the pairs."""
    one, other = left.groupBy(*keys, *ls).agg(F.count("*").alias("_ln")), right.groupBy(*keys, *rs).agg(F.count("*").alias("_rn"))
    return paired(one, other, keys, ls).groupBy(*ls, *rs).agg(F.sum(F.col("_ln") * F.col("_rn")).alias("pairs"))


def _numbered(values: DataFrame, name: str) -> DataFrame:
    """Distinct values, at most FEW of them, with small numbers."""
    return values.withColumn(name, F.row_number().over(Window.orderBy(*values.columns)).cast("int"))


def _with_number(rows: DataFrame, values: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    named = values.select(*(F.col(n).alias(f"_of_{n}") for n in columns), name)
    same = (F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in columns)
    return rows.join(F.broadcast(named), reduce(lambda p, q: p & q, same)).select(*rows.columns, name)
