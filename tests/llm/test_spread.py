"""Rows of one id, or of none, don't meet in one task; short texts are judged by their own scatter."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_null_and_repeated_ids_spread(spark, tmp_path):
    from stintlab.llm import suffixes, token_files

    rng = random.Random(1)
    rows = [(None, words(rng, 40), "en") for _ in range(60)] + [(7, words(rng, 40), "en") for _ in range(60)] + [(8, words(rng, 60), "en")]
    docs = table(spark, rows)
    got = suffixes.remove_repeats(docs, bucket_docs=10)
    assert got.groupBy(F.col("doc_id").isNull()).count().count() == 2 and got.agg(F.sum("n_removed")).first()[0] == 0
    hashes = docs.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(13)).alias("b")).groupBy("b").count()
    assert hashes.agg(F.max("count")).first()[0] < 30
    index = token_files.write_tokens(docs, f"file://{tmp_path}/t", docs_a_file=10).collect()
    assert len(index) == len(rows)
    assert len(list((tmp_path / "t").rglob("*.arrow*"))) > 8


def test_earlier_ids_cut_whatever_their_bucket(spark):
    from stintlab.llm import suffixes

    rng = random.Random(2)
    shared = words(rng, 30)
    rows = [(5, f"{words(rng, 5)} {shared}", "en") for _ in range(8)] + [(3, shared, "en")] * 3 + [(9, shared, "en")]
    got = [(r.doc_id, r.n_removed >= len(shared)) for r in suffixes.remove_repeats(table(spark, rows), bucket_docs=2).collect()]
    assert sorted(got) == sorted([(3, False)] * 3 + [(5, True)] * 8 + [(9, True)])


def test_short_texts_are_judged_by_their_own_scatter(spark):
    from stintlab.llm import langid

    rng = random.Random(3)
    known = [(i, words(rng, 90), "en") for i in range(30)]
    foreign = "".join(rng.choice("αβγδεζηθικλμνξοπ ") for _ in range(3000))
    short = [(200 + i, words(rng, n), None) for i, n in enumerate((1, 2, 3, 5, 9, 20, 40))]
    odd = [(100 + i, foreign[:n], None) for i, n in enumerate((3000, 1500, 399, 401))]
    repeated = [(300, "ab cd " * 500, None)]
    kept = {r.doc_id for r in langid.keep_identified(table(spark, [*known, *short, *odd, *repeated])).collect()}
    assert {i for i, *_ in known + short + repeated} <= kept
    # long foreign texts go, and no length at which the rule changes
    assert not {100, 101} & kept and (102 in kept) == (103 in kept)
