"""Phrases against a plain count of all of them."""

import random
import re
from collections import Counter

import duckdb
import pytest

from packetloom.llm import collocations, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, max_n, least, best, share):
    f, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, max_n + 1):
                f.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    out = []
    for lang in totals:
        found = {p: c for (of, p), c in f.items() if of == lang and len(p) > 1 and c >= least}
        rest = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * c >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in found.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rest)[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_against_a_plain_count(spark, max_n):
    rng = random.Random(max_n)
    vocabulary = ["New", "york", "city", "the", "é", "Ünder", "a", "日本", "x y"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
    rows = [(i, text(), rng.choice(["en", "fr", None, "und", ""])) for i in range(120)]
    rows += [(200, None, "en"), (201, "", None), (202, "new york " * 3000, "en"), *[(203, "same line again", "de")] * 5, (204, " \t\n", "xx")]
    got = collocations.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), max_n=max_n, least=4, best=25, share=50)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, max_n, 4, 25, 50)


def test_products_past_64_bits_are_exact(spark):
    big = 3_000_000_019
    counts = spark.createDataFrame([("x", 1, "a", big + 7), ("x", 1, "b", big + 1), ("x", 2, "a b", big)], "lang string, size int, phrase string, count long")
    row = collocations.scored(counts).first()
    assert (row.a, row.l, row.r, row.score) == (big, big + 7, big + 1, 1_000_000 * big * big // ((big + 7) * (big + 1)))


def test_no_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 12, "en", "clash", 3)], SCHEMA + ", phrase string, count int")
    assert {r.phrase for r in collocations.mine(df).collect()} == {"a b a", "b a b"}
    assert collocations.mine(df.where("false")).count() == 0


def test_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op13_collocations(spark, SF)
    want = con.execute(collocations.ORACLE_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
