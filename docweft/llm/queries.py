"""The registered queries of the subpackage, and their checking SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from docweft.llm import (
    bpe_lexicon, chat_format, divergence, language, licenses, merkle, minhash, packing, quality_rules, simhash, token_files, topk, warc,
)
from docweft.llm.columns import LOWER, UPPER
from docweft.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    facts = stored(quality_rules.quality_facts(docs).select("doc_id", "facts"), "facts")
    scored = quality_rules.score_quality(facts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return scored.select(
        "doc_id",
        *(F.col("facts")[n].alias(n) for n in names),
        F.col("quality.base_failed").alias("base_failed"),
        F.col("quality.kept").alias("kept"),
        F.round("quality.posterior", 6).alias("posterior"),
    )


def quality_sql() -> str:
    rules, n = quality_rules.RULES, len(quality_rules.RULES)
    word = r"[^\x20\x09-\x0D]"
    marks = "|".join(f"[{c}][{c}]+" for c in ("!", "?", "*", "$", "%", "&", "#", "<", ">", "_", "=", "~")) + r"|\|+|\^\^+|--+"
    votes = ", ".join(
        f"CASE WHEN {fact} {'>=' if good < bad else '<'} {bad} THEN -1 WHEN {fact} {'<=' if good < bad else '>='} {good} THEN 1 ELSE 0 END"
        for _, fact, good, bad in rules
    )
    start = [quality_rules.SHARE, *(quality_rules.GOOD * n), *(quality_rules.BAD * n)]
    weight = quality_rules.WEIGHT

    def chance(votes: str, model: str) -> str:
        good, bad = (f"list_sum(list_transform(range({n}), lambda j: ln({model}[{of * 3 * n + 3} + 3 * j + {votes}[j + 1]])))" for of in (0, 1))
        return f"(1 / (1 + exp(ln((1 - {model}[1]) / {model}[1]) + {bad} - {good})))"

    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '{word}+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
  FROM d
),
windows AS (SELECT k, i, w[i + 1:i + 5] AS x FROM (SELECT k, w, unnest(range(len(w) - 4)) AS i FROM w)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY k),
f AS (
  SELECT w.k, doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(t, '\\p{{L}}')) AS n_letters,
    len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(t, '{marks}')) AS n_marks
  FROM w LEFT JOIN covered ON w.k = covered.k
),
s AS (
  SELECT doc_id, n_words AS words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words::DOUBLE AS n_words,
    word_chars / nullif(n_words, 0)::DOUBLE AS word_length, n_symbols / nullif(n_words, 0)::DOUBLE AS symbol_share,
    n_capitals / nullif(n_letters, 0)::DOUBLE AS capital_share, n_marks / nullif(n_words, 0)::DOUBLE AS mark_share,
    n_dup_lines / nullif(n_lines, 0)::DOUBLE AS line_copy_share, n_repeat_words / nullif(n_words, 0)::DOUBLE AS repeat_share,
    n_letters / nullif(word_chars, 0)::DOUBLE AS letter_share
  FROM f
),
v AS (SELECT *, [{votes}] AS votes FROM s),
seen AS (SELECT list({{'v': votes, 'n': n}} ORDER BY votes) AS seen FROM (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes)),
em AS (
  SELECT 0 AS step, {start}::DOUBLE[] AS model
  UNION ALL
  SELECT step + 1, list_concat([(good + {weight * quality_rules.SHARE}) / (good + bad + {weight})], list_transform(range({6 * n}), lambda k:
    (list_sum(list_transform(p, lambda x: CASE WHEN x.v[(k % {3 * n}) // 3 + 1] = k % 3 - 1 THEN x.n * CASE WHEN k < {3 * n} THEN x.g ELSE 1 - x.g END ELSE 0 END))
      + {weight} * {start}[k + 2]) / (CASE WHEN k < {3 * n} THEN good ELSE bad END + {weight})))
  FROM (
    SELECT step, p, list_sum(list_transform(p, lambda x: x.n * x.g)) AS good, list_sum(list_transform(p, lambda x: x.n * (1 - x.g))) AS bad
    FROM (SELECT step, list_transform(seen, lambda x: {{'v': x.v, 'n': x.n, 'g': {chance('x.v', 'model')}}}) AS p FROM em, seen WHERE step < {quality_rules.STEPS})
  )
),
scored AS (
  SELECT v.*, words < 10 OR 100 * n_repeat_words > 20 * words AS base_failed, {chance('votes', 'model')} AS chance
  FROM v, em WHERE step = {quality_rules.STEPS}
)
SELECT doc_id, words AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND chance >= 0.5 AS kept, round(chance, 6) AS posterior
FROM scored
"""


ORACLE_SQL["op1_quality_rules"] = quality_sql()


@query
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    turns = chat_format.distinct_turns(rows, "conv_id", "turn", "role", "text")
    chosen = stored(chat_format.maximal(stored(chat_format.prefix_hashes(turns), "prefixes")), "chosen")
    return chat_format.render(turns, chosen).select(
        F.col("conv").alias("conv_id"), "n_turns", "copies", F.col("text").alias("rendered")
    )


ORACLE_SQL["op2_chat_format"] = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM t GROUP BY conv_id
),
u AS (SELECT min(conv_id) AS conv_id, n, count(*) AS copies, l FROM c GROUP BY l, n),
heads AS (SELECT DISTINCT l[1:k] AS head FROM (SELECT l, unnest(range(1, n)) AS k FROM u))
SELECT conv_id, n AS n_turns, copies,
  list_aggregate(list_transform(l, lambda x: '{chat_format.START}' || coalesce(x.role, '') || chr(10)
    || coalesce(x.text, '') || '{chat_format.END}' || chr(10)), 'string_agg', '') AS rendered
FROM u WHERE l NOT IN (SELECT head FROM heads)
"""


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    entries = token_files.write_shards(docs)
    index, buckets = token_files.write_index(entries)
    keys = docs.groupBy("doc_id").agg(F.count("*").alias("n")).select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    )
    found = token_files.lookup(keys, index, buckets)
    return token_files.read_ids(
        found, token_files.shard_list(entries), lambda x: zlib.crc32(x.astype("<u4").tobytes()), "long", "ids_crc32"
    ).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents", "doc_id", "text")).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


@query
def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    rows = licenses.scan(table(spark, folder, "documents", "doc_id", "text"))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    starts = F.transform("places", lambda x: x["start"])
    base = F.transform("places", lambda x: x["label"])
    added = F.transform("matches", lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, added)).alias("labels"),
        # a phrase found word for word counts as a whole match
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def license_sql() -> str:
    between = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    hits = " UNION ALL ".join(
        f"SELECT k, '{label}' AS label, n / {len(w)}::DOUBLE AS c FROM (SELECT k, len(list_intersect(b, {w})) AS n FROM b) "
        f"WHERE n >= {licenses.THRESHOLD} * {len(w)}"
        for label, text in licenses.TEMPLATES for w in [licenses.template_words(text)]
    )
    phrase = " ".join(
        f"WHEN {' AND '.join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(words))} THEN '{label}'"
        for words, label in licenses.PHRASES.items()
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents
),
w AS (SELECT k, doc_id, regexp_extract_all(low, '{between}') AS w FROM d),
p AS (
  SELECT k, doc_id, w, list_filter(list_transform(range(len(w)), lambda i: {{'s': i, 'l': CASE {phrase} END}}), lambda x: x.l IS NOT NULL) AS p
  FROM w
),
b AS (
  SELECT k, list_distinct(regexp_extract_all(line, '{between}')) AS b
  FROM (SELECT k, unnest(string_split(low, chr(10))) AS line FROM d)
),
m AS (SELECT k, list(label) AS labels, max(c) AS c FROM ({hits}) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base,
  list_min(list_transform(p, lambda x: x.s)) AS first_word, list_max(list_transform(p, lambda x: x.s)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.l))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.l), coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM p LEFT JOIN m USING (k)
"""


ORACLE_SQL["op5_licenses"] = license_sql()


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    prints = stored(simhash.fingerprints(table(spark, folder, "documents", "doc_id", "text")), "prints")
    return simhash.near_duplicates(prints).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op7_bpe_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return bpe_lexicon.round_trip(docs, bpe_lexicon.build_lexicon(docs)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    records = warc.read_archives(warc.write_archives(pages), content=False)

    def number(urn: str):
        return F.substring_index(urn, ":", -1).try_cast("long")

    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )


DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE_SQL["op9_warc"] = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, '')))  AS hex FROM pages
),
d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda k: substr('{DIGITS}',
      (bitstring_agg_value(hex, k)) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest)
""".replace(
    "bitstring_agg_value(hex, k)",
    # five bits from place 5 k: they lie within two hexadecimal digits
    "(('0x' || substr(hex || '0', 5 * k // 4 + 1, 2))::INTEGER // (2 ** (3 - 5 * k % 4))::INTEGER) % 32",
)


@query
def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


ORACLE_SQL["op10_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

@query
def op11_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


ORACLE_SQL["op11_minhash"] = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
),
s AS (
  SELECT k, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM d
),
named AS (SELECT k, doc_id, len(s) AS n, min(k) OVER (PARTITION BY list_sort(s)) AS c, s FROM s),
x AS (SELECT c, n, unnest(s) AS x FROM named WHERE k = c AND n > 0),
links AS (
  SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.x = b.x AND a.c <> b.c AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reached AS (SELECT DISTINCT c AS a, c AS b FROM x UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a, min(doc_id) AS component_id FROM reached JOIN named ON reached.b = named.c GROUP BY a)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM named LEFT JOIN least ON named.c = least.a
"""


@query
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", *merkle.FIELDS)
    key = F.col("doc_id").cast("string")
    changed = F.when(F.crc32(key.cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    fields = [F.col(c) for c in merkle.FIELDS]
    rows = docs.select("doc_id", "source", merkle.leaf(*fields).alias("leaf"), merkle.leaf(*fields[:-1], changed).alias("found"))
    return merkle.proofs(merkle.build(stored(rows, "leaves")), "found")


def merkle_sql() -> str:
    def leaf(text: str) -> str:
        values = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v} END" for v in values) + ")"

    bits = "list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"xor(list_reduce({bits}, lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295)"
    width = merkle.WIDTH
    up = f"level + 1, idx // {width}, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + {width - 1}) // {width})"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {leaf("text")} AS leaf,
    {leaf(f"(CASE WHEN {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END)")} AS found
  FROM documents
),
l AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM d
),
t AS (
  SELECT tree, 0 AS level, pos AS idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL
  SELECT tree, {up} FROM t WHERE n > 1 GROUP BY tree, level, idx // {width}
),
u AS (
  SELECT -1 AS tree, 0 AS level, tree AS idx, digest, count(*) OVER () AS n FROM t WHERE n = 1
  UNION ALL
  SELECT tree, {up} FROM u WHERE n > 1 GROUP BY tree, level, idx // {width}
),
runs AS (
  SELECT tree, level, idx // {width} AS up, list(digest ORDER BY idx) AS l
  FROM (SELECT * FROM t WHERE n > 1 UNION ALL SELECT * FROM u WHERE n > 1) GROUP BY ALL
),
climb AS (
  SELECT tree AS of, pos, tree, 0 AS level, pos AS idx, found AS fold, '' AS proof, false AS ended FROM l
  UNION ALL
  SELECT c.of, c.pos, CASE WHEN r.l IS NULL THEN -1 ELSE c.tree END, CASE WHEN r.l IS NULL THEN 0 ELSE c.level + 1 END,
    CASE WHEN r.l IS NULL THEN c.tree ELSE c.idx // {width} END,
    CASE WHEN r.l IS NULL THEN fold ELSE sha256(array_to_string(list_concat(r.l[:c.idx % {width}], [fold], r.l[c.idx % {width} + 2:]), '')) END,
    CASE WHEN r.l IS NULL THEN proof ELSE proof || array_to_string(list_concat(r.l[:c.idx % {width}], r.l[c.idx % {width} + 2:]), '') END,
    r.l IS NULL AND c.tree = -1
  FROM climb c LEFT JOIN runs r ON c.tree = r.tree AND c.level = r.level AND c.idx // {width} = r.up WHERE NOT ended
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(c.proof) AS proof_sha256, c.fold AS folded_root, c.fold = r.digest AS verified
FROM l JOIN climb c ON l.tree = c.of AND l.pos = c.pos AND c.ended JOIN (SELECT tree, digest FROM t WHERE n = 1) s ON l.tree = s.tree,
  (SELECT digest FROM u WHERE n = 1) r
"""


ORACLE_SQL["op12_merkle"] = merkle_sql()


@query
def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents", "text", "lang", "source"))


ORACLE_SQL["op13_divergence"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
x AS (SELECT k, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY ALL),
v AS (SELECT lang, term, count(*) AS total FROM x GROUP BY ALL HAVING count(DISTINCT k) >= {divergence.HOLDERS}),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, v.term, v.total, coalesce(c.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, 1 + ({divergence.UNITS} * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w)::BIGINT AS p,
    1 + ({divergence.UNITS} * (total + 2)) // (sum(total) OVER w + 2 * count(*) OVER w)::BIGINT AS q
  FROM cells WINDOW w AS (PARTITION BY lang, source)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
told AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value
  FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN pairs ON g.lang = pairs.lang AND g.source = pairs.source AND o.source = item
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM told QUALIFY part = 'pair' OR rank <= {divergence.TERMS}
"""

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
