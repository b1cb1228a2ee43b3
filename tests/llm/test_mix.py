"""Mixes against plain arithmetic on lists, and the query against its SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size long, key string, target double, weight int, v double, rest double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "k", 0.5, 3, 0.5, 1.0) for i, t, s in rows], DOCS)


def shares(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    bounded = set()
    while True:
        free = [s for s in order if s not in bounded]
        left = sum(sizes.values()) - sum(most * sizes[s] for s in bounded)
        level = Fraction(left, sum(weight[s] for s in free)) if free else Fraction(0)
        above = {s for s in free if weight[s] * level > most * sizes[s]}
        if not above:
            return {s: (most * sizes[s] if s in bounded else weight[s] * level) for s in order}
        bounded |= above


def brute(rows):
    docs = [(i, s, len(re.findall(r"[^ \t-\r]+", t or ""))) for i, t, s in rows]
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    target, out = shares(sizes), []
    by = defaultdict(list)
    for i, s, n in docs:
        by[s].append((i, n))
    for s, own in by.items():
        total, t = sizes[s], float(target[s])
        whole = int(t / total) if total else 0
        rest, at = t - whole * total, 0

        def rank(d, pi=rest / total if total else 0.0):
            text = f"{'' if d[0] is None else d[0]}|{d[1]}|mix-1"
            u = (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            odds = (u / (1 - u)) / (pi / (1 - pi)) if pi else 0.0
            return odds / (1 + odds), d[0] is not None, d[0] or 0, d[1]

        for i, n in sorted(own, key=rank):
            more = rest > 0 and n > 0 and 2 * at + n <= 2 * rest
            out.append((i, n, total, t, n * (whole + more)))
            at += n
    return sorted(out, key=repr), target, sizes


def made(rng):
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(int(200 * rng.random() ** 4) + rng.randint(0, 3))), rng.choice("aaaaaabcdé")) for i in range(400)]
    rows += [(1000 + i, "x y\tz\nv", None) for i in range(30)] + [(None, "same row", "a")] * 50 + [(7777, "again and again", "b")] * 20
    rows += [(2000, None, "a"), (2001, "", "empty"), (2002, " \r\n", "empty"), (2003, "long " * 50_000, "z"), (2004, "no\xa0break", "z")]
    return rows


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)


def test_mixes_are_those_of_plain_arithmetic(spark):
    from stintlab.llm.mix import mix

    rows = made(random.Random(2))
    expected, target, sizes = brute(rows)
    got = told(mix(table(spark, rows)))
    assert got == expected
    taken = Counter()
    source = {i: s for i, _, s in rows}
    for i, n, _, _, words in got:
        taken["a" if i is None else source[i]] += words
        assert words <= 3 * n
    for s, n in sizes.items():
        longest = max((size for i, size, *_ in got if (source[i] if i is not None else "a") == s), default=0)
        assert abs(taken[s] - target[s]) <= longest / 2 + 1e-6 * n, s


def test_ranks_found_in_many_steps_are_the_same(spark, monkeypatch):
    from stintlab.llm import mix

    rows = made(random.Random(3))
    monkeypatch.setattr(mix, "BITS", 2)
    monkeypatch.setattr(mix, "ORDERED", 3)
    monkeypatch.setattr(mix, "LEVELS", 7)
    assert told(mix.mix(table(spark, rows).repartition(5))) == brute(rows)[0]


def test_targets_stop_and_the_excess_is_shared_again(spark):
    from stintlab.llm.mix import targets

    for sizes in ({"a": 1, "b": 1000, "c": 10, "d": 500, None: 3}, {"a": 5}, {"a": 0, "b": 0}, {f"s{i:03}": 1 + (i * 7919) % 97 for i in range(60)}):
        keys = {("t" if s is None else "s" + s): s for s in sizes}
        df = spark.createDataFrame([(k, sizes[s]) for k, s in keys.items()], "key string, source_size long").repartition(3)
        expected = shares(sizes)
        got = {keys[r["key"]]: r["target"] for r in targets(df).collect()}
        assert got.keys() == expected.keys()
        assert all(abs(got[s] - float(expected[s])) < 1e-9 * (1 + sum(sizes.values())) for s in got)
        assert all(got[s] <= 3 * n for s, n in sizes.items())


def test_targets_of_many_words_are_exact(spark):
    from stintlab.llm.mix import targets

    # a weight times all words passes 32 bits, then all words do, then a weight times all words passes 2^60
    for n in (400_000_000, 1_500_000_000, 250_000_000_000_000_000):
        df = spark.createDataFrame([(k, n) for k in ("sa", "sb", "sc")], "key string, source_size long")
        got = {r["key"]: r["target"] for r in targets(df).collect()}
        assert got == {"sa": n / 2, "sb": float(n), "sc": n * 3 / 2}


def test_no_documents_and_no_words(spark):
    from stintlab.llm.mix import mix

    assert told(mix(table(spark, []))) == []
    assert told(mix(table(spark, [(1, None, None), (2, "", "a")]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_the_query_returns_what_its_sql_says(spark):
    duckdb = pytest.importorskip("duckdb")

    from stintlab.llm import queries

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = sorted(db.execute(queries.oracle_sql()["op12_mix"]).fetchall(), key=repr)
    assert told(queries.op12_mix(spark, SF)) == expected
