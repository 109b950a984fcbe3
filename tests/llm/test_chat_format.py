import random

from docweft.llm import chat_format as C
from docweft.session import stored

SCHEMA = "conv_id long, turn long, role string, text string, conv int, n int"


def collapse(df):
    turns = C.distinct_turns(df, "conv_id", "turn", "role", "text")
    chosen = stored(C.maximal(stored(C.prefix_hashes(turns))))
    return {r["conv"]: (r["n_turns"], r["copies"], r["text"]) for r in C.render(turns, chosen).collect()}


def plain(rows, order=lambda x: x[:4]):
    convs = {}
    for c, turn, role, text, *_ in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    lists = {c: [x[2:] for x in sorted(t, key=order)] for c, t in convs.items()}
    out = {}
    for c, t in lists.items():
        longer = any(len(o) > len(t) and o[: len(t)] == t for o in lists.values())
        equal = sorted(k for k, o in lists.items() if o == t)
        if not longer and equal[0] == c:
            shown = "".join(f"{C.START}{r}\n{x}{C.END}\n" for _, r, _, x in t)
            out[c] = (len(t), len(equal), shown)
    return out


def test_against_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for c in range(120):
        n, same = rng.randint(1, 6), rng.randint(0, 3)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"s{same} t{t}" + ("!" if rng.random() < 0.1 else ""), 1, 2) for t in range(n)]
    rows += [(500, t, "user", f"long {t}", 1, 2) for t in range(700)] + [(501, t, "user", f"long {t}", 1, 2) for t in range(300)]
    assert collapse(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None, 1, 2), (2, 0, "user", "", 1, 2), (3, 0, None, "x", 1, 2), (4, None, "user", "a", 1, 2), (4, 0, "user", "b", 1, 2),
        (None, 0, "user", "lost", 1, 2), (5, 0, "user", "twice", 1, 2), (5, 0, "user", "twice", 1, 2), (6, 7, "user", "twice", 1, 2),
        (7, -5, "user", "minus", 1, 2), (7, 3, "user", "y" * 50_000, 1, 2),
    ]
    got = collapse(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows)
    assert got[5][:2] == (1, 2) and 6 not in got and 1 in got and 2 in got
    assert collapse(spark.createDataFrame([], SCHEMA)) == {}


def test_turns_of_equal_number_and_role_are_in_order_of_text(spark):
    rng = random.Random(5)
    rows = []
    for c in range(40):
        texts = [f"{rng.choice('pqzäÉ')} {k}" for k in range(rng.randint(2, 5))]
        rng.shuffle(texts)
        rows += [(c, 0, "user", t, 1, 2) for t in texts] + [(c, rng.choice([None, 1]), None, t, 1, 2) for t in [*texts, None]]
    # one conversation is a snapshot of another only in the order of the texts
    rows += [(90, 0, "user", "a", 1, 2), (91, 0, "user", "b", 1, 2), (91, 0, "user", "a", 1, 2), (92, 0, "user", "b", 1, 2)]
    got = collapse(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows, order=lambda x: x) and 90 not in got and 92 in got
