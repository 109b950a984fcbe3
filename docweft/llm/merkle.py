"""Merkle manifest of a dataset: a tree for each source, one over the sources, and proofs for every row.

A row is a leaf: the SHA-256 of its fields, each with its length. The leaves of a source
stand in the order of their ids; ``WIDTH`` consecutive nodes have one parent, until one
node is left, the subroot of the source. The subroots, in the order of the sources, are
the lowest nodes of one more tree that ends in the root.

``build`` stores every level as rows that are linked to their parents: a node has its own
place, that of its parent, and what stands before and after it under that parent. ``climb``
is a recursive query over these rows. It starts from each leaf as it is found now (perhaps
tampered with), and at every step replaces the node by its parent, appends the siblings to
the proof and folds the hash of the leaf with them. Leaves under one parent have all higher
siblings in common; so they climb in one row, each with a hash of its own in an array.

Leaves get their places without a window over a source: the rows are sorted by ranges, and
the counts of (partition, source) say how many stand in front. Only hashes are moved, never
texts. Every level is a sixteenth of the one below.

Defined cases: a null field is ``-``; a null source is a source of its own and the first
one; rows of equal id stand in the order of their leaves, and a null id stands first;
repeated rows are leaves of their own; a lone leaf is its subroot, a lone subroot the root,
and a proof without siblings is the hash of nothing; texts of any length are hashed where
they are read; an empty table has no root and an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweft.session import stored

WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the sources; sources are numbered from 0.
TOP = -1
PLACE = ("tree", "level", "idx")


class Manifest(NamedTuple):
    #: ``tree, run, n, leaves``: up to ``WIDTH`` consecutive leaves of a source; ``n`` is the number of leaves of the source.
    runs: DataFrame
    #: ``tree, level, idx`` of a node above the leaves (or of a lone leaf), ``before, after`` it, ``up_tree, up_level, up_idx``.
    nodes: DataFrame
    #: ``tree, subroot``
    subroots: DataFrame
    #: ``tree, level, idx, digest`` of the root; None for an empty table.
    root: tuple | None


# --- leaves ---------------------------------------------------------------------------
def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def joint(digests: Column) -> Column:
    """Digests of an array as one text."""
    return F.array_join(digests, "")


def ranked(rows: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """Rows with their number in the group, from 0. No group is gathered in a task."""
    placed = stored(
        rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")),
        "placed",
    )
    spans = placed.groupBy("part", *group).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    # one row for each partition and group: small
    ahead = F.coalesce(F.sum("size").over(W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("part").alias("_part"), *(F.col(g).alias(f"_{g}") for g in group), (ahead - F.col("first")).alias("shift"))
    same = F.col("part") == F.col("_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return placed.join(spans, same).select(*rows.columns, (F.col("at") + F.col("shift")).alias(into))


# --- tree -----------------------------------------------------------------------------
def families(rows: DataFrame) -> DataFrame:
    """Nodes under one parent. ``rows``: ``tree, level, idx, digest``, the sequence they stand in, ``pos`` there and its length ``n``."""
    return stored(
        rows.groupBy("sequence", F.floor(F.col("pos") / WIDTH).cast("long").alias("up"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", *PLACE, "digest"))).alias("members"), F.max("n").alias("n")),
        "families",
    )


def linked(found: DataFrame, level: int) -> DataFrame:
    """The nodes of the families as rows with a link to their parents on ``level``."""
    one = found.select("sequence", "up", "members", F.posexplode("members").alias("at", "node"))
    digests = F.transform("members", lambda x: x["digest"])
    return one.select(
        *(F.col("node")[p].alias(p) for p in PLACE), joint(F.slice(digests, F.lit(1), F.col("at"))).alias("before"),
        joint(F.slice(digests, F.col("at") + 2, F.lit(WIDTH))).alias("after"),
        F.col("sequence").alias("up_tree"), F.lit(level).alias("up_level"), F.col("up").alias("up_idx"),
    )


def parents(found: DataFrame, level: int) -> DataFrame:
    return found.select(
        F.col("sequence").alias("tree"), F.lit(level).alias("level"), F.col("up").alias("idx"),
        F.sha2(joint(F.transform("members", lambda x: x["digest"])), 256).alias("digest"),
        "sequence", F.col("up").alias("pos"), F.ceil(F.col("n") / WIDTH).cast("long").alias("n"),
    )


def build(rows: DataFrame, group: str = "source", key: str = "doc_id") -> Manifest:
    """The manifest of rows ``group, key, leaf``; other columns stay with the leaves."""
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in (group, "leaf")]
    placed = ranked(rows, [group], [key, *[c for c in ("leaf",) if c != key]], "pos")
    per = stored(placed.groupBy(group).agg(F.count("*").alias("n")), "sources")
    sources = ranked(per.withColumn("all", F.lit(0)), ["all"], [group], "tree").select(F.col(group).alias("_group"), "n", "tree")
    count, most = per.agg(F.count("*"), F.max("n")).first()
    runs = stored(
        placed.join(sources, F.col(group).eqNullSafe(F.col("_group")))
        .groupBy("tree", F.floor(F.col("pos") / WIDTH).cast("long").alias("run"))
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "leaf", *rest))).alias("leaves")),
        "runs",
    )
    digests = F.transform("leaves", lambda x: x["leaf"])
    tops = [runs.filter("n = 1").select("tree", F.lit(0).alias("level"), F.col("run").alias("idx"), digests[0].alias("digest"))]
    nodes = []
    now = runs.filter("n > 1").select(
        "tree", F.lit(1).alias("level"), F.col("run").alias("idx"), F.sha2(joint(digests), 256).alias("digest"),
        F.col("tree").alias("sequence"), F.col("run").alias("pos"), F.ceil(F.col("n") / WIDTH).cast("long").alias("n"),
    )
    level, most = 1, -(-(most or 0) // WIDTH)
    tops.append(now.filter("n = 1").select(*PLACE, "digest"))
    while most > 1:
        level, most = level + 1, -(-most // WIDTH)
        found = families(now.filter("n > 1"))
        nodes.append(linked(found, level))
        now = parents(found, level)
        tops.append(now.filter("n = 1").select(*PLACE, "digest"))
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    subroots = stored(subroots, "subroots")
    now = subroots.select("*", F.lit(TOP).cast("long").alias("sequence"), F.col("tree").alias("pos"), F.lit(count).alias("n"))
    level = 0
    while count > 1:
        level, count = level + 1, -(-count // WIDTH)
        found = families(now)
        nodes.append(linked(found, level))
        now = parents(found, level)
    root = now.select(*PLACE, "digest").first()
    if nodes:
        every = nodes[0]
        for more in nodes[1:]:
            every = every.unionByName(more)
    else:
        places = "tree long, level int, idx long"
        every = spark.createDataFrame([], f"{places}, before string, after string, up_tree long, up_level int, up_idx long")
    return Manifest(runs, stored(every, "nodes"), subroots.select("tree", F.col("digest").alias("subroot")), tuple(root) if root else None)


# --- proofs ---------------------------------------------------------------------------
def climb(made: Manifest, found: str) -> DataFrame:
    """``tree, run, folds, proof``: what each leaf's hash in field ``found`` becomes at the root, and the siblings above a run."""
    spark = made.runs.sparkSession

    def swapped(x, i):
        return F.sha2(joint(F.transform("leaves", lambda y, j: F.when(i == j, x[found]).otherwise(y["leaf"]))), 256)

    lone = F.col("n") == 1
    starts = made.runs.select(
        F.col("tree").alias("at_tree"), F.when(lone, 0).otherwise(1).alias("at_level"), F.col("run").alias("at_idx"), "tree", "run",
        F.when(lone, F.transform("leaves", lambda x: x[found])).otherwise(F.transform("leaves", swapped)).alias("folds"),
    )
    tree, level, idx, _ = made.root
    limit, was = "spark.sql.cteRecursionRowLimit", None
    was = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")  # its default ends a query of over a million rows
    try:
        return stored(
            spark.sql(
                """
                WITH RECURSIVE climb AS (
                  SELECT at_tree, at_level, at_idx, tree, run, folds, '' AS proof FROM {starts}
                  UNION ALL
                  SELECT n.up_tree, n.up_level, n.up_idx, c.tree, c.run,
                    transform(c.folds, f -> sha2(concat(n.before, f, n.after), 256)), concat(c.proof, n.before, n.after)
                  FROM climb c JOIN {nodes} n ON c.at_tree = n.tree AND c.at_level = n.level AND c.at_idx = n.idx
                )
                SELECT tree, run, folds, proof FROM climb
                WHERE at_tree = {tree} AND at_level = {level} AND at_idx = {idx}
                """,
                starts=starts, nodes=made.nodes, tree=tree, level=level, idx=idx,
            ),
            "climbed",
        )
    finally:
        spark.conf.unset(limit) if was is None else spark.conf.set(limit, was)


def proofs(made: Manifest, found: str, key: str = "doc_id") -> DataFrame:
    """For every leaf ``key, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    spark = made.runs.sparkSession
    if made.root is None:
        kind = made.runs.schema["leaves"].dataType.elementType[key].dataType.simpleString()
        names = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return spark.createDataFrame([], f"`{key}` {kind}, {names}")
    full = made.runs.join(climb(made, found), ["tree", "run"]).join(made.subroots, "tree")
    one = full.select("subroot", "proof", "folds", "leaves", F.posexplode("leaves").alias("at", "one"))
    others = joint(F.transform(F.filter("leaves", lambda x, i: i != F.col("at")), lambda x: x["leaf"]))
    return one.select(
        F.col("one")[key].alias(key), F.col("one.leaf").alias("leaf"), "subroot", F.lit(made.root[3]).alias("root"),
        F.sha2(F.concat(others, "proof"), 256).alias("proof_sha256"), F.get("folds", "at").alias("folded_root"),
        (F.get("folds", "at") == made.root[3]).alias("verified"),
    )
