import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from docweft.llm import merkle as A
from tests.llm.common import empty_documents, odd_documents

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, level string, leaves int"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row) -> str:
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:5]))


def climb_plain(nodes: list[str], at: int, fold: str, proof: list[str]):
    """The top of a tree, what the node at a place becomes there, and the siblings on the way."""
    while len(nodes) > 1:
        low = at // A.WIDTH * A.WIDTH
        run = nodes[low : low + A.WIDTH]
        proof += run[: at - low] + run[at - low + 1 :]
        fold = digest("".join([*run[: at - low], fold, *run[at - low + 1 :]]))
        nodes = [digest("".join(nodes[k : k + A.WIDTH])) for k in range(0, len(nodes), A.WIDTH)]
        at //= A.WIDTH
    return nodes[0], fold


def plain(rows, found):
    """doc_id, leaf, subroot, root, proof, folded, verified of all rows, by the rules alone."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    inside = {
        s: sorted(((r[0], plain_leaf(r), found(r)) for r in rows if r[1] == s), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in sources
    }
    subroots = [climb_plain([x[1] for x in inside[s]], 0, "", [])[0] for s in sources]
    out = []
    for number, s in enumerate(sources):
        nodes = [x[1] for x in inside[s]]
        for at, (key, leaf, now) in enumerate(inside[s]):
            proof = []
            subroot, fold = climb_plain(nodes, at, now, proof)
            root, fold = climb_plain(subroots, number, fold, proof)
            out.append((key, leaf, subroot, root, digest("".join(proof)), fold, fold == root))
    return sorted(out, key=repr)


def tampered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 5:
        return plain_leaf(row)
    return plain_leaf((*row[:4], None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))


def proved(docs):
    key = F.col("doc_id").cast("string")
    low = F.when(F.crc32(key.cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fields = [F.col(c) for c in A.FIELDS]
    rows = docs.select("doc_id", "source", A.leaf(*fields).alias("leaf"), A.leaf(*fields[:-1], F.coalesce(low, "text")).alias("found"))
    return A.proofs(A.build(rows), "found")


def compare(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in proved(docs).collect()), key=repr)
    assert got == plain(rows, tampered)
    return got


def test_levels(spark):
    """Sources of one leaf, of a full run, of one more, and of three levels; more sources than a run."""
    sizes = [300, 1, 16, 17, 33, *[2] * 14]
    rows = [(7 * n % 5003, f"s{k}é", "en", n, f"Text {n} of {k}") for k, size in enumerate(sizes) for n in range(k * 1000, k * 1000 + size)]
    got = compare(spark, rows)
    wrong = [r for r in got if not r[6]]
    assert wrong and all(zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in wrong)


@pytest.mark.parametrize("sizes", [[1], [17], [1, 1]])
def test_small(spark, sizes):
    compare(spark, [(n, f"s{k}", None, None, "A") for k, size in enumerate(sizes) for n in range(size)])


def test_odd_rows(spark):
    long = "Ab " * 200_000
    rows = [
        (1, None, None, None, None), (None, None, "en", 3, "Abc"), (None, None, "en", 3, "Abc"), (5, None, "en", 3, "Abc"), (5, None, "en", 3, "Abd"),
        (5, "", "", 0, ""), (-3, "", "fr", -1, "ÀÉ 日本 -"), (2, "a", "en", 9, long), (2, "a", "en", 9, long), (10, "a", "-", 1, "1:5"), (11, "Z", "x", 1, "Q"),
    ]
    compare(spark, rows)
    docs = odd_documents(spark).withColumn("n_chars", F.length("text").cast("long"))
    compare(spark, [tuple(r) for r in docs.select(*A.FIELDS).collect()])


def test_empty(spark):
    docs = empty_documents(spark).withColumn("n_chars", F.lit(1).cast("long"))
    out = proved(docs)
    assert out.collect() == [] and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_links(spark):
    """Every node's parent is a node or the root, and the climb needs no more than these rows."""
    rows = [(n, f"s{n % 20}", "en", n, f"T{n}") for n in range(900)]
    docs = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], SCHEMA)
    made = A.build(docs.select("doc_id", "source", A.leaf(*[F.col(c) for c in A.FIELDS]).alias("leaf")))
    nodes = {(r["tree"], r["level"], r["idx"]): (r["up_tree"], r["up_level"], r["up_idx"]) for r in made.nodes.collect()}
    assert {up for up in nodes.values() if up not in nodes} == {tuple(made.root[:3])}
    kept = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")  # the climb is not ended by a limit of the session
    try:
        assert A.proofs(made, "leaf").filter("verified").count() == 900
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "10"
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", kept)
