"""Phrases by pivot against counting all of them."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, phrase string, n long, pivot string, key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in held.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * c[p[i : i + m]]}
        found = []
        for p, a in held.items():
            if p not in gone:
                score, _, le, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), le, r))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made(rng):
    words = ["the", "of", "New", "york", "É", "é", "a\x0b", "x-1", "漢字", "to", "be", "ab", "cd"]
    rows = []
    for i in range(150):
        w = [words[int(len(words) * rng.random() ** 2)] for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(x + rng.choice([" ", " ", " ", "\t", ". ", "\n", ", ", "  "]) for x in w), rng.choice(["en", "en", "fr", None, "und"])))
    rows += [(500, None, "en"), (501, "", None), (502, " \t.;", "de"), (503, "one two three four five " * 40, "en"), (503, "one two three four five " * 40, "en")]
    rows += [(None, "to be or not to be, " * 35, "fr"), (504, "a " * 5000, "en")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 7, "y", "z") for i, t, lang in rows], DOCS)


def test_phrases_are_those_of_counting_all(spark):
    from stintlab.llm.phrases import collocations

    rows = made(random.Random(8))
    for least, top in ((30, 2000), (5, 2000), (3, 25)):
        got = sorted(tuple(r) for r in collocations(table(spark, rows), least=least, top=top).collect())
        assert got == brute([(t, lang) for _, t, lang in rows], least, top)
        assert len(got) > 10


def test_hot_pivots_small_chunks_and_shared_slots_alter_nothing(spark):
    from stintlab.llm import phrases

    rows = made(random.Random(9))
    expected = brute([(t, lang) for _, t, lang in rows], 5)
    docs = table(spark, rows).repartition(3)
    counts = phrases.word_counts(docs).where("f >= 5")
    # every word in one of four slots, pivots of over 40 occurrences dealt out
    slots = phrases.slot_counts(counts, 4)
    rank, _ = phrases._ranks("en", pa.array([f"w{i}" for i in range(50)]), slots)
    assert sorted(rank.tolist()) == list(range(50))
    found = phrases.fragments(docs, spark.sparkContext.broadcast(slots), pivot_rows=40)
    mined = {(r["lang"], r["phrase"]): r["a"] for r in phrases.mine(found, 5).collect()}
    assert found.where("parts > 1").count() > 0
    assert all(mined[e[0], e[2]] == e[3] for e in expected)


def test_chunks_end_where_pieces_do():
    from stintlab.llm.phrases import chunks, words_of

    texts = pa.array(["Ab cd. ef", "", "g" * 50 + " h", "i,j"])
    parts = [bytes(c) for c in chunks(texts, 10)]
    assert b"".join(parts) == b"ab cd. ef\n\n" + b"g" * 50 + b" h\ni,j"
    assert all(p[-1:] in b".,\n" for p in parts[:-1])
    codes, vocabulary, goes_on = words_of(np.frombuffer(b"ab  cd. ef ab", np.uint8))
    assert [vocabulary[c].as_py() for c in codes.tolist()] == ["ab", "cd", "ef", "ab"]
    assert goes_on.tolist() == [True, False, True, False]


def test_an_empty_table_has_no_phrases(spark):
    from stintlab.llm.phrases import collocations

    assert collocations(table(spark, [])).collect() == []
    assert collocations(table(spark, [(1, None, None)])).collect() == []


def test_the_query_returns_what_its_sql_says(spark):
    duckdb = pytest.importorskip("duckdb")

    from stintlab.llm import queries

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = sorted(db.execute(queries.oracle_sql()["op11_phrases"]).fetchall())
    assert sorted(tuple(r) for r in queries.op11_phrases(spark, SF).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == expected
