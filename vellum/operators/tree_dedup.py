"""Nodes of several versions of a publication told apart by content: ids, full texts, subtree hashes, what is re-used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.similarity import let
from vellum.functions.text import clean_formatting
from vellum.operators.latex_lines import empty, fold
from vellum.session import cut

LISTS, TITLED = ("itemize", "enumerate"), ("document", "part", "chapter", "section", "appendix", "subsection", "subsubsection", "paragraph")
LEAVES = ("sentence", "math", "figure", "table", "listing")
VERSION = ("pub_id", "version")
#: Trees of fewer levels are hashed in a round for each level.
LEVELS = 16


def version_number(version: Column) -> Column:
    return F.regexp_extract(version, r"v(\d+)$", 1).try_cast("int")


def node_id(version: Column, preorder: Column) -> Column:
    return F.concat(version, F.lit("_"), F.lpad(preorder.cast("string"), 6, "0"))


def full_text(node_type: Column, title: Column, label: Column, content: Column, preorder: Column, children: Column) -> Column:
    """What a node says: its cleaned content, its title, or for a list its place and size (so lists match only in place)."""
    clean = clean_formatting(F.coalesce(content, F.lit("")))
    labelled = F.concat_ws(" | ", F.nullif(label, F.lit("")), F.nullif(clean, F.lit("")))
    listed = F.concat_ws(" | ", F.lpad(preorder.cast("string"), 6, "0"), node_type, F.concat(children.cast("string"), F.lit(" items")))
    return F.when(node_type.isin("figure", "table"), labelled).when(node_type.isin(*LISTS), listed).when(node_type.isin("sentence", "math", "listing"), clean).when(node_type.isin(*TITLED), F.coalesce(title, F.lit(""))).otherwise("")


def normalize_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with node_id, version_no, and full_text; the parser has given subtree_end, the place behind the last node below."""
    nodes = nodes.where("error is null")
    children = nodes.where("parent_preorder is not null").groupBy(*VERSION, F.col("parent_preorder").alias("preorder")).agg(F.count("*").alias("n_children"))
    rows = nodes.join(children, [*VERSION, "preorder"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    text = full_text(F.col("node_type"), F.col("title"), F.col("label"), F.col("content"), F.col("preorder"), F.col("n_children"))
    return rows.withColumns({"node_id": node_id(F.col("version"), F.col("preorder")), "version_no": version_number(F.col("version")), "full_text": text})


def subtree_hashes(rows: DataFrame) -> DataFrame:
    """subtree_hash: SHA-256 of type, full text and the children's hashes in their order."""
    seen = Observation()
    rows = cut(rows.observe(seen, F.coalesce(F.max("depth"), F.lit(0)).alias("deepest")))
    deepest = seen.get["deepest"]
    return _by_levels(rows, deepest) if deepest < LEVELS else _in_one_pass(rows)


def _by_levels(rows: DataFrame, deepest: int) -> DataFrame:
    """A round for each level, the deepest first: a node's children are gathered, not its version's nodes."""
    keys, levels = [F.col(k) for k in VERSION], []
    for depth in range(deepest, -1, -1):
        here = rows.where(F.col("depth") == depth)
        told = F.lit("")
        if levels:
            below = levels[-1].groupBy(*keys, F.col("parent_preorder").alias("preorder")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("preorder", "subtree_hash"))), lambda x: x["subtree_hash"]), "").alias("_told"))
            here, told = here.join(below, [*VERSION, "preorder"], "left"), F.coalesce("_told", F.lit(""))
        levels.append(cut(here.select(*rows.columns, F.sha2(F.concat("node_type", "full_text", told), 256).alias("subtree_hash"))))
    return reduce(DataFrame.union, levels)


def _in_one_pass(rows: DataFrame) -> DataFrame:
    """Trees of many levels.

    A version's nodes, which are one document, are read from the last to the first: when a node comes, all below it have
    been hashed, and the hashes that wait for it lie one level deeper. So a tree of any depth takes one pass, and the whole
    table one exchange.
    """
    waiting = lambda nodes: F.array_repeat(empty("string"), F.array_max(F.transform(nodes, lambda n: n["depth"])) + 2)

    def step(s: Column, n: Column) -> Column:
        own = F.sha2(F.concat(n["node_type"], n["full_text"], F.array_join(F.get(s["waiting"], n["depth"] + 1), "")), 256)

        def told(hash_: Column) -> Column:
            kept = F.transform(s["waiting"], lambda w, d: F.when(d == n["depth"], F.array_prepend(w, hash_)).when(d == n["depth"] + 1, empty("string")).otherwise(w))
            return F.struct(kept.alias("waiting"), F.array(hash_).alias("emit"))

        return let(own, told)

    found = rows.groupBy(*VERSION).agg(F.sort_array(F.collect_list(F.struct("preorder", F.struct(*rows.columns).alias("node")))).alias("all"))
    nodes = found.select(F.transform("all", lambda x: x["node"]).alias("nodes"))
    hashes = F.reverse(fold(F.reverse("nodes"), {"waiting": waiting(F.col("nodes"))}, "string", step))
    both = nodes.select(F.explode(F.arrays_zip(F.col("nodes").alias("node"), hashes.alias("subtree_hash"))).alias("x"))
    return cut(both.select("x.node.*", "x.subtree_hash"))


def deduplicate(hashed: DataFrame) -> DataFrame:
    """Nodes that stay in each version, with canonical_id: the id of the first node (by version and place) of the same content.

    Below a node that was met before nothing is looked at; nodes without text are never matched. A version whose root was
    met before keeps all its own ids, and so does a publication of one version.
    """
    many = hashed.groupBy("pub_id").agg(F.count_distinct("version").alias("versions"))
    rows = hashed.join(many, "pub_id")
    first = Window.partitionBy("pub_id", "subtree_hash", "full_text").orderBy("version_no", "preorder")
    rows = rows.withColumn("first_id", F.first("node_id").over(first))
    met = (F.col("versions") > 1) & (F.col("full_text") != "") & (F.col("first_id") != F.col("node_id"))
    own_root = F.max(F.when((F.col("depth") == 0) & met, 1).otherwise(0)).over(Window.partitionBy(*VERSION)) == 1
    rows = rows.withColumn("swapped", met & ~own_root)
    # a node goes if a swapped one began before it and ends behind it
    covered = F.max(F.when(F.col("swapped"), F.col("subtree_end"))).over(Window.partitionBy(*VERSION).orderBy("preorder").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("gone", F.coalesce(covered > F.col("preorder"), F.lit(False))).where("not gone")
    return rows.withColumn("canonical_id", F.when(F.col("swapped"), F.col("first_id")).otherwise(F.col("node_id"))).drop("versions", "first_id", "gone")


def elements(kept: DataFrame) -> DataFrame:
    """(pub_id, id, element): text of headings and lists; of leaves a JSON object of what they have."""
    own = kept.where("not swapped")
    leaf = F.to_json(F.struct("node_type", F.nullif("content", F.lit("")).alias("content"), F.nullif("title", F.lit("")).alias("title"), F.nullif("label", F.lit("")).alias("label")))
    return own.select("pub_id", F.col("node_id").alias("id"), F.when(F.col("node_type").isin(*LEAVES), leaf).otherwise(F.to_json(F.struct(F.col("full_text").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("full_text").alias("t")))) - 6)).alias("element"))


def hierarchy(kept: DataFrame) -> DataFrame:
    """(pub_id, version, id, parent_id): re-used nodes appear only in their own version, where the last parent counts."""
    parents = kept.select(*VERSION, F.col("preorder").alias("parent_preorder"), F.col("canonical_id").alias("parent_id"))
    rows = kept.join(parents, [*VERSION, "parent_preorder"], "left").where(F.startswith("canonical_id", F.concat(F.col("version"), F.lit("_"))))
    return rows.groupBy(*VERSION, F.col("canonical_id").alias("id")).agg(F.max_by("parent_id", "preorder").alias("parent_id"))


def publication_json(kept: DataFrame) -> DataFrame:
    """(pub_id, json): {"elements": {id: ...}, "hierarchy": {version: {id: parent}}}. A publication is one JSON text."""
    found = elements(kept).groupBy("pub_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "element"))), lambda e: F.concat(F.lit('"'), e["id"], F.lit('": '), e["element"])), ", ").alias("elements"))
    versions = hierarchy(kept).groupBy(*VERSION).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", F.coalesce("parent_id", F.lit("null")).alias("parent"))))).alias("parents"))
    trees = versions.groupBy("pub_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("version", F.to_json("parents").alias("parents")))), lambda v: F.concat(F.lit('"'), v["version"], F.lit('":'), v["parents"])), ","), F.lit("}")).alias("hierarchy"))
    whole = F.concat(F.lit('{"elements": {'), F.coalesce("elements", F.lit("")), F.lit('}, "hierarchy": '), F.replace(F.coalesce("hierarchy", F.lit("{}")), F.lit(':"null"'), F.lit(":null")), F.lit("}"))
    return found.join(trees, "pub_id", "full").select("pub_id", whole.alias("json"))
