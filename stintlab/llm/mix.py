"""Mixing sources to target weights by Pareto order sampling.

The words of all texts are shared out to the sources by weight; a source's share stops at ``most`` times its words and the
excess goes to the others by weight, until none is above. A source's documents are then taken as often as the share
needs: ``whole`` certain copies of every document, and for the words that remain a sample in which a document is included
with probability pi, the remaining words over the source's. Each document gets a random number u from a digest of its id and
size, and the documents are ranked by odds(u) / odds(pi): over all sources this orders a sample of unequal probabilities,
in each source the one of fixed size. That size is in words: documents are taken by rank while at least half
of the next one fits, so a source is off its share by half a document at most.

The rank at which a source ends is found by counting: words by the first bits of the rank, then by the next bits inside the
part where the share ends, until few documents are left to be ordered. No source is gathered or sorted whole.

Sizes are numbers of runs without blanks and line ends; null texts have none and are taken with 0 words. A null source is
a source, the last one. Rows alike in source, id and size are as one another: as many of them are taken as are due. Null
ids are treated like others. An empty table gives no rows; without any word all targets are 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlab.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix-1"
#: Bits of the rank by which words are counted at once, how often at most, and how many rows of a source are ordered at last.
BITS, LEVELS, ORDERED = 12, 4, 4096
#: How many tasks the documents of one source are dealt to where its numbers are joined to them.
SALTS = 32


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, key, size): sources as keys that sort by code point with null last."""
    source = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("key"),
        F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Rows with their place from 0 in the order of ``by``: sorted in ranges, whose lengths are added up."""
    rows = cut(df.orderBy(by).withColumn("place_", F.monotonically_increasing_id()), name)
    rows = rows.withColumns({"range_": F.shiftright("place_", 33), "place_": F.col("place_").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = rows.groupBy("range_").agg(F.count("*").alias("n_")).withColumn("start_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    return rows.join(starts, "range_").withColumn("place", F.col("start_") + F.col("place_")).drop("range_", "place_", "n_", "start_")


def _exact(value) -> Column:
    return (F.col(value) if isinstance(value, str) else F.lit(value)).cast("decimal(18,0)")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source_size, target) of (key, source_size); weights go round by the keys' order."""
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))  # a weight times all words passes 32 bits
    own = cut(numbered(sizes, "key", "ordered").withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))), "sources")
    # every unbounded source gets num / den words for a weight of 1; what is bounded stays so as that grows
    first = own.agg(F.sum("source_size"), F.sum("weight")).first()
    num, den = int(first[0] or 0), int(first[1] or 1)
    while True:
        above = _exact("weight") * _exact(num) > _exact("source_size") * _exact(most) * _exact(den)
        held = own.agg(F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(~above, F.col("weight")))).first()
        now = (int(first[0] or 0) - int(held[0] or 0), int(held[1] or 1))
        if now == (num, den):
            break
        num, den = now
    share = (F.col("weight") * F.lit(num)).cast("double") / F.lit(float(den))
    return own.select("key", "source_size", F.when(above, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def with_sources(rows: DataFrame, sources: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows (doc_id, size, ...) with what ``sources`` says of them: each source stands ``SALTS`` times, so that a source with
    a third of all rows isn't one task's."""
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    dealt = sources.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(dealt, [*on, "salt_"], how).drop("salt_")


def ranked(docs: DataFrame, due: DataFrame) -> DataFrame:
    """Documents (doc_id, key, size) with their source's numbers and, where a sample is due, the rank v in (0, 1): Pareto's
    odds over one plus them."""
    out = with_sources(docs, due, ["key"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.nullif("source_size", F.lit(0))).otherwise(F.lit(0.0))
    out = out.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.lit(SEED))
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    out = out.withColumn("u", F.when((F.col("rest") > 0) & (F.col("size") > 0), u))
    pi = F.col("rest") / F.nullif("source_size", F.lit(0))
    odds = (F.col("u") / (1 - F.col("u"))) / (pi / (1 - pi))
    return out.withColumn("odds", F.when(F.col("u").isNotNull(), odds)).withColumn("v", F.col("odds") / (1 + F.col("odds"))).drop("u", "odds")


def _prefix(bits: int) -> Column:
    return F.floor(F.col("v") * float(1 << bits))


def ends(rows: DataFrame) -> DataFrame:
    """(key, last_v, last_id, last_size, last_n): the last row of each source's sample and how many rows like it are in."""
    drawn = rows.where("v IS NOT NULL").select("key", "v", "size", "rest", "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    left, marks = drawn.withColumn("before", F.lit(0).cast("long")), None
    for level in range(LEVELS):
        bits = BITS * (level + 1)
        order = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = left.groupBy("key", _prefix(bits).alias("part")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("rest").alias("rest"), F.first("before").alias("base")
        )
        counts = counts.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(order), F.lit(0)))
        last = F.max(F.struct("part", "before", "rows")).alias("m")
        marks = cut(counts.where("before <= rest").groupBy("key").agg(last).select("key", "m.*"), "marks")
        left = with_sources(drawn.withColumn("part", _prefix(bits)), marks.select("key", "part", "before"), ["key", "part"])
        if (marks.agg(F.max("rows")).first()[0] or 0) <= ORDERED:
            break
    order = Window.partitionBy("key").orderBy("v", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    taken = left.withColumn("at", before).where(2 * F.col("at") + F.col("size") <= 2 * F.col("rest"))
    alike = taken.groupBy("key", "v", "id", "size").agg(F.count("*").alias("n"))
    last = alike.groupBy("key").agg(F.max(F.struct("v", "id", "size", "n")).alias("m"))
    # where not one of the documents left is in, the sample ends before them
    last = marks.select("key", (F.col("part") / float(1 << bits)).alias("start")).join(last, "key", "left")
    return last.select("key", F.coalesce("m.v", "start").alias("last_v"), F.col("m.id").alias("last_id"), F.col("m.size").alias("last_size"), F.coalesce("m.n", F.lit(0)).alias("last_n"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), copies and taken (words, repeats counted)."""
    sizes = cut(sized(docs, id_col, text_col, source_col), "sizes")
    due = targets(sizes.groupBy("key").agg(F.sum("size").alias("source_size")), weights, most)
    rows = cut(ranked(sizes, due), "ranked")
    out = with_sources(rows, ends(rows), ["key"], "left")
    id_ = F.coalesce("doc_id", F.lit(-(1 << 63)))
    alike = F.col("last_id").isNotNull() & (F.col("v") == F.col("last_v")) & (id_ == F.col("last_id")) & (F.col("size") == F.col("last_size"))
    out = out.withColumn("alike", F.coalesce(alike, F.lit(False)))
    below = (F.col("v") < F.col("last_v")) | ((F.col("v") == F.col("last_v")) & ((id_ < F.col("last_id")) | ((id_ == F.col("last_id")) & (F.col("size") < F.col("last_size")))))
    clear = out.where("NOT alike").withColumn("more", F.coalesce(below, F.lit(False)).cast("long"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))  # rows alike only
    equal = out.where("alike").withColumn("more", (nth <= F.col("last_n")).cast("long"))
    both = clear.unionByName(equal).withColumn("copies", F.col("whole") + F.col("more"))
    return both.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
