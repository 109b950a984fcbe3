import re

from docweft.llm import licenses as L
from tests.llm.common import empty_documents, odd_documents


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for i in range(len(w)) for words, label in L.PHRASES.items() if tuple(w[i : i + len(words)]) == words]
    matches = set()
    for n, line in enumerate(low.split("\n")):
        have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for label, template in L.TEMPLATES:
            t = set(L.template_words(template))
            if len(have & t) / len(t) >= L.THRESHOLD:
                matches.add((label, round(len(have & t) / len(t), 9)))
    return len(w), places, matches


def held(docs):
    for r in L.scan(docs).collect():
        yield r["doc_id"], (r["n_words"], [tuple(x) for x in r["places"]], {(x["label"], round(x["containment"], 9)) for x in r["matches"]})


def test_against_plain_python(spark):
    texts = [t for _, t in L.TEMPLATES] + [
        "Released under the MIT license. Apache LICENSE, general\npublic license and general public license", "the licensed cc by 4.0", None, "",
        "MİT license, mit-license MIT\tLICENSE", "filler " * 500 + "All RIGHTS are reserved" + " filler" * 500,
        "\n".join(t for _, t in L.TEMPLATES), "permission is hereby granted free of charge to any person obtaining a copy",
        "version 3 public general gnu the under licensed is work", "license", "general public", "x general public license" * 3,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = dict(held(docs))
    assert got == {n: plain(t) for n, t in enumerate(texts)}
    assert {x[0] for x in got[len(L.TEMPLATES) + 6][2]} == {label for label, _ in L.TEMPLATES}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = sorted(held(docs), key=str)
    assert got == sorted(((r["doc_id"], plain(r["text"])) for r in docs.collect()), key=str)
    assert list(held(empty_documents(spark))) == []
