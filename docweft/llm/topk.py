"""Exact top-k inner products: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz pruning.

Vectors are cut into blocks by descending length. Within a task a block of queries meets a
block of candidates slice by slice: all vectors are rotated by the eigenvectors of the
candidates' second moments (the right singular vectors of their matrix), so the first few
coordinates carry most of a product and the rest is at most the product of the residual
lengths. Where partial sum plus that bound stays below the k-th score found so far, the
pair is dropped; what is left is scored in whole numbers. A first pass over the block of
the longest vectors gives each query its k-th score so far, with which later blocks are
entered; a block whose longest vector cannot reach it is not entered at all.

The moments are sums of d x d numbers, whatever the number of rows. A task holds one block
of candidates and one of queries, both bounded by parameters. Copies of one vector tie in
length and are spread over blocks by their id.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without id; vectors of different dimension are never compared; repeated
ids are separate candidates, as a query such an id stands for its smallest vector, and a
query meets no row of its own id; ties go to the smaller
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweft.session import stored

SCALE = 256.0
#: Rows of a block of candidates and of queries, rows scored at once, share of the dimensions in the partial sums.
BLOCK, QUERIES, SLICE, LEAD = 32768, 4096, 2048, 0.5
OUT = "query_id long, vec_id long, score long"


def whole(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component; null if any component is null or not finite."""
    doubles = vector.cast("array<double>")
    sound = ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(sound & (F.size(doubles) > 0), F.transform(doubles, lambda x: F.floor(x * scale)))


def moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Sum of outer products for each dimension, in doubles."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, rows in batch.groupby(batch["v"].map(len)):
                x = np.stack(rows["v"]).astype("f8")
                sums[size] = sums.get(size, 0) + x.T @ x
        for size, s in sums.items():
            d = np.arange(size)
            yield pd.DataFrame({"d": size, "i": np.repeat(d, size), "j": np.tile(d, size), "s": s.ravel()})

    rows = vectors.select("v").mapInPandas(partial, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s"))
    found: dict[int, np.ndarray] = {}
    for r in rows.orderBy("d", "i", "j").toLocalIterator():
        found.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["s"]
    return found


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the eigenvectors of the moments, largest first, as columns."""
    return {d: np.linalg.eigh(s / max(1.0, np.abs(s).max()))[1][:, ::-1].copy() for d, s in moments(vectors).items()}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole-number products of rows of ``a`` with rows of ``b``, pair by pair."""
    return np.einsum("ij,ij->i", a, b)


def best_of(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k best candidates of each query: query row, candidate row, score. ``floor``: scores below it are not needed."""
    lead = max(1, int(np.ceil(LEAD * q.shape[1])))
    qr, cr = q @ rotation, c @ rotation
    q_rest, c_rest = (np.sqrt((x[:, lead:] ** 2).sum(1)) for x in (qr, cr))
    q_len, c_len = (np.sqrt((x.astype("f8") ** 2).sum(1)) for x in (q, c))
    order = np.lexsort((c_ids, -c_len))
    bound = floor.astype("f8").copy()
    best_c = np.full((len(q), k), -1, "i8")
    best_s = np.full((len(q), k), np.iinfo("i8").min, "i8")
    for at in range(0, len(c), SLICE):
        rows = order[at : at + SLICE]
        slack = 1e-9 * q_len * c_len[rows[0]] + 1e-6  # rounding of the rotated sums
        live = np.flatnonzero(q_len * c_len[rows[0]] + slack >= bound)
        if not len(live):
            break
        upper = qr[live, :lead] @ cr[rows, :lead].T + np.outer(q_rest[live], c_rest[rows])
        near, hit = np.nonzero((upper + slack[live, None] >= bound[live, None]) & (q_ids[live, None] != c_ids[rows][None, :]))
        if not len(near):
            continue
        near, hit = live[near], rows[hit]
        score = np.concatenate([products(q[near[i : i + 65536]], c[hit[i : i + 65536]]) for i in range(0, len(near), 65536)])
        # the k best so far and the new ones: by score, then by id
        some = np.unique(near)
        old_q, old_c, old_s = np.repeat(some, k), best_c[some].ravel(), best_s[some].ravel()
        held = old_c >= 0
        all_q, all_c, all_s = (np.concatenate(x) for x in ((old_q[held], near), (old_c[held], hit), (old_s[held], score)))
        sort = np.lexsort((c_ids[all_c], -all_s, all_q))
        all_q, all_c, all_s = all_q[sort], all_c[sort], all_s[sort]
        rank = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
        take = rank < k
        best_c[some], best_s[some] = -1, np.iinfo("i8").min
        best_c[all_q[take], rank[take]], best_s[all_q[take], rank[take]] = all_c[take], all_s[take]
        full = some[best_c[some, -1] >= 0]
        bound[full] = np.maximum(bound[full], best_s[full, -1])
    row, place = np.nonzero(best_c >= 0)
    return row, best_c[row, place], best_s[row, place]


def matched(turn: dict[int, np.ndarray], k: int):
    """The function of one pair of blocks."""

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="i8")]
        if len(queries) and len(block):
            sizes = block["v"].map(len)
            for d, mine in queries.groupby(queries["v"].map(len)):
                other = block[sizes == d]
                if not len(other):
                    continue
                q, c = np.stack(mine["v"]).astype("i8"), np.stack(other["v"]).astype("i8")
                q_ids, c_ids = mine["id"].to_numpy("i8"), other["id"].to_numpy("i8")
                row, hit, score = best_of(q_ids, q, c_ids, c, turn[d], k, mine["floor"].to_numpy("f8"))
                out.append(pd.DataFrame({"query_id": q_ids[row], "vec_id": c_ids[hit], "score": score}))
        return pd.concat(out, ignore_index=True)

    return run


def top_k(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = SCALE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every row for which ``is_query`` holds."""
    v = whole(F.col(vector), scale)
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter("id is not null and v is not null").withColumn(
        "len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    )
    rows = stored(rows, "vectors")
    count, longest = rows.agg(F.count("*"), F.max("len")).first()
    if count and longest**2 >= 2.0**62:
        raise ValueError("inner products exceed 64-bit whole numbers")
    turn = rotations(rows)
    blocks = max(1, -(-count // BLOCK))
    # the range bounds come from a sample, so blocks vary in size around the parameter
    ranged = rows.repartitionByRange(blocks, F.desc("len"), F.col("id")).select(
        F.spark_partition_id().alias("block"), "id", "v", "len"
    )
    ranged = stored(ranged, "blocks")
    heads = ranged.groupBy("block").agg(F.max("len").alias("head"))
    asking = rows.filter("asks").groupBy("id").agg(F.min(F.struct("v", "len")).alias("x")).select("id", "x.v", "x.len")
    parts = max(1, -(-asking.count() // QUERIES))
    asking = asking.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    run = matched(turn, k)

    def meet(queries: DataFrame, block: DataFrame) -> DataFrame:
        # every part of the queries meets every block; both sides are dealt by the pair of numbers
        spread = block.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return (
            queries.groupBy("block", "part").cogroup(spread.groupBy("block", "part"))
            .applyInPandas(lambda a, b: run(a, b), OUT)
        )

    first = meet(asking.withColumns({"block": F.lit(0), "floor": F.lit(float("-inf"))}), ranged.filter("block = 0"))
    first = stored(first, "first")
    floors = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).filter(f"n >= {k}")
    known = asking.join(floors.withColumnRenamed("query_id", "id"), "id", "left").withColumn(
        "floor", F.coalesce(F.col("low").cast("double"), F.lit(float("-inf")))
    )
    # blocks are numbered by length: a query enters those whose longest vector can reach its floor
    lengths = heads.agg(F.sort_array(F.collect_list(F.struct("block", "head"))).alias("all")).scalar()
    entered = known.withColumn("heads", lengths).withColumn(
        "block",
        F.explode(
            F.transform(
                F.filter("heads", lambda x: (x["block"] > 0) & (x["head"] * F.col("len") * (1 + 1e-9) + 1 >= F.col("floor"))),
                lambda x: x["block"],
            )
        ),
    ).select("id", "v", "len", "part", "block", "floor")
    rest = meet(entered, ranged.filter("block > 0"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
