"""Weak supervision: quality rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at counts of one text and votes 1 (good), -1 (bad) or 0 (no opinion).
Two classes are assumed; for each rule the chance of each vote given the class (its
accuracy on good and on bad texts) and the share of good texts are estimated by
expectation-maximisation over the vote patterns of all documents. A document is kept if
its posterior probability of being good reaches ``threshold`` and the hard base rule
holds.

The texts are read once, row by row: nothing but counts leaves a row. There are at most
3 ** len(RULES) vote patterns, whatever the input, so the estimation is one expression
over one array of patterns.

Defined cases: a null or blank text has no words, fails the base rule and takes part in
the estimation like any other; repeated rows count as often as they occur; an empty table
gives an empty result; other columns pass through, also those named like a fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweft.llm.columns import SPACE, free_name, let, words

WINDOW = 5
#: Name, fact, and the bounds: good up to the first, bad from the second on (falling where the first is larger).
RULES = [
    ("length", "n_words", 20, 10),
    ("word_length_low", "word_length", 3, 2),
    ("word_length_high", "word_length", 12, 20),
    ("symbols", "symbol_share", 0.1, 0.25),
    ("capitals", "capital_share", 0.25, 0.6),
    ("marks", "mark_share", 0.05, 0.25),
    ("line_copies", "line_copy_share", 0.2, 0.5),
    ("repetition", "repeat_share", 0.1, 0.2),
    ("letters", "letter_share", 0.75, 0.5),
]
#: First guess of the chances of the votes (-1, 0, 1) on a good and on a bad text, the share of good texts, and how many
#: documents the guess weighs in each step.
GOOD, BAD, SHARE, WEIGHT, STEPS = (0.02, 0.08, 0.9), (0.4, 0.2, 0.4), 0.8, 20.0, 25


def repeat_words(found: Column, hashes: Column) -> Column:
    """Words that lie in a window that occurs twice or more, from the windows' hashes in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(p: Column) -> Column:
        same = F.transform(
            p,
            lambda x, i: F.when(
                x["h"].eqNullSafe(F.get(p, i - 1)["h"]) | x["h"].eqNullSafe(F.get(p, i + 1)["h"]), x["i"]
            ),
        )
        return F.sort_array(F.array_compact(same))

    def covered(s: Column) -> Column:
        steps = F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(pairs, starts), covered)
    ).otherwise(0)


def quality_facts(docs: DataFrame, text: str = "text", into: str = "facts") -> DataFrame:
    """Adds a struct of counts and shares of the whole text; map-only."""
    got, found, hashes, lines = (free_name(docs, n) for n in ("_text", "_words", "_windows", "_lines"))
    step = docs.withColumn(got, F.coalesce(F.col(text), F.lit("")))
    step = step.withColumn(found, words(F.col(got))).withColumn(
        lines, F.filter(F.split(F.col(got), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    )
    w = F.col(found)
    step = step.withColumn(
        hashes,
        F.when(
            F.size(w) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - WINDOW),
                lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    t = F.col(got)
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size(F.col(lines)) - F.size(F.array_distinct(F.col(lines))),
        "n_repeat_words": repeat_words(w, F.col(hashes)),
        "n_lines": F.size(F.col(lines)),
        "n_letters": F.regexp_count(t, F.lit("\\p{L}")),
        "n_capitals": F.regexp_count(t, F.lit("\\p{Lu}")),
        "n_marks": F.regexp_count(t, F.lit("([!?*$%&|#<>_=~^-])\\1+|[|]")),
    }
    return step.withColumn(into, F.struct(*(c.cast("long").alias(n) for n, c in counts.items()))).select(
        *(F.col(f"`{c}`") for c in docs.columns), into
    )


def shares(facts: Column) -> dict[str, Column]:
    """What the rules look at."""

    def part(a: str, b: str) -> Column:
        return F.try_divide(facts[a].cast("double"), facts[b].cast("double"))

    return {
        "n_words": facts["n_words"].cast("double"),
        "word_length": part("word_chars", "n_words"),
        "symbol_share": part("n_symbols", "n_words"),
        "capital_share": part("n_capitals", "n_letters"),
        "mark_share": part("n_marks", "n_words"),
        "line_copy_share": part("n_dup_lines", "n_lines"),
        "repeat_share": part("n_repeat_words", "n_words"),
        "letter_share": part("n_letters", "word_chars"),
    }


def votes(facts: Column) -> Column:
    """The rules' votes as an array; a rule without a value (no words, no letters) abstains."""
    seen = shares(facts)

    def vote(fact: str, good: float, bad: float) -> Column:
        x = seen[fact]
        is_good, is_bad = (x <= good, x >= bad) if good < bad else (x >= good, x < bad)
        return F.when(is_bad, -1).when(is_good, 1).otherwise(0)

    return F.array(*(vote(fact, good, bad) for _, fact, good, bad in RULES))


def posterior(pattern: Column, model: Column) -> Column:
    """Chance that a text with these votes is good. ``model``: share, then the vote chances of all rules, good then bad."""
    n = len(RULES)

    def chance(of: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(n - 1)),
            F.lit(0.0),
            lambda s, j: s + F.log(F.get(model, 1 + of * 3 * n + 3 * j + F.get(pattern, j) + 1)),
        )

    share = F.get(model, F.lit(0))
    return 1 / (1 + F.exp(F.log((1 - share) / share) + chance(1) - chance(0)))


def estimate(patterns: DataFrame, steps: int = STEPS, weight: float = WEIGHT) -> DataFrame:
    """One row with the fitted ``model``, from rows ``votes, n``."""
    n = len(RULES)
    first = [SHARE, *(GOOD * n), *(BAD * n)]
    start = F.array(*(F.lit(float(x)) for x in first))

    def step(seen: Column, model: Column) -> Column:
        weighed = F.transform(
            seen,
            lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(p["votes"], model).alias("p")),
        )

        def again(w: Column) -> Column:
            def total(value) -> Column:
                return F.aggregate(w, F.lit(0.0), lambda s, p: s + value(p))

            def of_class(p: Column, of: Column) -> Column:
                return p["n"] * F.when(of == 0, p["p"]).otherwise(1 - p["p"])

            def entry(k: Column, sizes: Column) -> Column:
                of = F.floor((k - 1) / (3 * n)).cast("int")
                rule = F.floor(((k - 1) % (3 * n)) / 3).cast("int")
                vote = (k - 1) % 3 - 1
                hits = total(lambda p: F.when(F.get(p["votes"], rule) == vote, of_class(p, of)).otherwise(0.0))
                guess = F.get(start, k)
                return (hits + weight * guess) / (F.get(sizes, of) + weight)

            sizes = F.array(total(lambda p: of_class(p, F.lit(0))), total(lambda p: of_class(p, F.lit(1))))
            return let(
                sizes,
                lambda z: F.concat(
                    F.array((z[0] + weight * SHARE) / (z[0] + z[1] + weight)),
                    F.transform(F.sequence(F.lit(1), F.lit(6 * n)), lambda k: entry(k, z)),
                ),
            )

        return let(weighed, again)

    gathered = patterns.agg(
        F.sort_array(F.collect_list(F.struct(F.col("votes"), F.col("n").cast("double").alias("n")))).alias("seen")
    )
    return gathered.select(
        F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda m, _: step(F.col("seen"), m)).alias("model")
    )


def score_quality(
    seen: DataFrame, facts: str = "facts", into: str = "quality", threshold: float = 0.5
) -> DataFrame:
    """Adds a struct ``base_failed, votes, posterior, kept`` to rows that have facts.

    ``seen`` is read twice (estimation, scoring): pass a stored table.
    """
    f = F.col(facts)
    patterns = seen.select(votes(f).alias("votes")).groupBy("votes").agg(F.count("*").alias("n"))
    model = estimate(patterns).scalar()
    held, cast = free_name(seen, "_model"), free_name(seen, "_votes")
    step = seen.withColumn(held, model).withColumn(cast, votes(f))
    failed = (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])
    chance, base = free_name(seen, "_posterior"), free_name(seen, "_failed")
    step = step.withColumn(chance, posterior(F.col(cast), F.col(held))).withColumn(base, failed)
    return step.withColumn(
        into,
        F.struct(
            F.col(base).alias("base_failed"),
            F.col(cast).alias("votes"),
            F.col(chance).alias("posterior"),
            (~F.col(base) & (F.col(chance) >= threshold)).alias("kept"),
        ),
    ).select(*(F.col(f"`{c}`") for c in seen.columns), into)
