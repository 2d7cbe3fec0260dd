"""What each of several filters removes, alone and in every order, and exact duplicates by partition refinement.

Duplicates: all rows are one class at first, which is split by code-point length, then by the hash of one block of the text
after another (256 code points, then blocks that grow sixteenfold, so eight rounds do for any text). Each round counts the
classes (an aggregate that combines before its shuffle, so a group of copies that holds a third of all rows costs one row a
task) and drops those of one row. What is left after the last block is compared by whole texts; the smallest id of each
text stays, every larger one fails the duplicate filter. Hashes only drop rows, they never decide that two texts are equal.

Block hashes are taken while the texts are read for the other filters, as reading them again costs more than hashing.
Rounds run on narrow rows (id, length, hashes). The classes that go on are kept as a bitmap of ``FILTER_BITS`` bits: its
table has ``FILTER_BITS`` / 64 rows whatever the input, so it may be broadcast, and no row moves to learn whether its class goes
on. A class that passes by chance is harmless, since its one text has its own id as the smallest. Only texts of
surviving classes are shuffled, one per text and task.

Masks: every row has one bit a filter. Rows are counted by (part, mask, labels); all orders and steps follow from these counts.

Cases: a null text is empty, and empty texts are copies of each other; a null part is the empty string; rows without an id
never fail the duplicate filter and are no one's original; rows of one id and text are all originals or all copies; a
document with several labels has a property if any label says so; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.durable import checkpoint, hot_keys, join_split

#: Starts of the blocks whose hashes refine a class of equal lengths.
BLOCK_STARTS = [0] + [256 * 16**k for k in range(6)]
FILTER_BITS = 1 << 24
#: All orders of filters are returned, so their number is bounded.
MOST_FILTERS = 6


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


#: Failure conditions of a text and its words.
TEXT_FILTERS = {
    "A": lambda t, w: F.size(w) < 50,
    "B": lambda t, w: 100 * F.size(F.array_distinct(w)) < 65 * F.size(w),
    "C": lambda t, w: 100 * F.regexp_count(t, F.lit("[A-Z]")) > 5 * F.char_length(t),
    "D": lambda t, w: t.rlike("[#$%&*|]"),
}


def _signed(docs: DataFrame, filters: Mapping, text: str, key: str, part: str) -> DataFrame:
    """(id, part, mask of the text filters, length, block hashes) of every row: the one pass over all texts."""
    t, n = F.col("t"), F.char_length("t")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    mask = sum((F.when(fails(t, F.col("w")), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    return rows.withColumn("w", words(t)).select("id", "part", mask.cast("int").alias("mask"), n.alias("n"), block_hashes(t).alias("blocks"))


def block_hashes(text: Column) -> Column:
    """64-bit hashes of the blocks of a text, first block first; an empty text has none."""
    starts = F.array(*[F.lit(x) for x in BLOCK_STARTS])
    return F.transform(F.filter(starts, lambda s: s < F.char_length(text)), lambda s: F.xxhash64(F.substr(text, s + 1, F.greatest(F.lit(BLOCK_STARTS[1]), 15 * s))))


def _class(n: Column, blocks: Column, rounds: int) -> Column:
    """Name of a class after so many blocks."""
    return F.xxhash64(n, F.slice(blocks, 1, rounds)) if rounds else F.xxhash64(n)


def bitmap(classes: DataFrame) -> DataFrame:
    """(word, bits): at most FILTER_BITS / 64 rows that say which values of ``class`` may be there."""
    at = F.pmod(F.col("class"), F.lit(FILTER_BITS))
    return classes.select(F.floor(at / 64).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(class, {FILTER_BITS}) % 64 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def maybe_in(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows whose ``class`` may be in the bitmap; its size is bounded, so it is broadcast."""
    word = F.floor(F.pmod(F.col("class"), F.lit(FILTER_BITS)) / 64)
    hit = F.expr(f"bits & shiftleft(1L, CAST(pmod(class, {FILTER_BITS}) % 64 AS INT))") != 0
    return rows.join(F.broadcast(bits), word == F.col("word")).filter(hit).drop("word", "bits")


def refine(rows: DataFrame) -> DataFrame | None:
    """Bitmap of the classes, after all blocks, that hold at least two of ``rows`` (n, blocks); None if none does."""
    rounds = rows.agg(F.max(F.size("blocks")).alias("k")).first().k
    if rounds is None:
        return None
    bits: DataFrame | None = None
    for k in range(rounds + 1):
        left = rows
        if bits is not None:
            left = maybe_in(rows.withColumn("class", _class(F.col("n"), F.col("blocks"), k - 1)), bits)
        several = left.groupBy(_class(F.col("n"), F.col("blocks"), k).alias("class")).agg(F.count("*").alias("c")).filter("c > 1")
        bits = checkpoint(bitmap(several))
    return bits


def originals(docs: DataFrame, bits: DataFrame, text: str, key: str) -> DataFrame:
    """(class, id): the smallest id of each whole text among the rows whose class may hold several."""
    t = F.col("t")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("class", _class(F.char_length(t), block_hashes(t), len(BLOCK_STARTS)))
    return maybe_in(rows, bits).groupBy("class", "t").agg(F.min("id").alias("id")).filter("id IS NOT NULL").select("class", "id").distinct()


def count_masks(docs: DataFrame, labels: DataFrame, filters: Mapping = TEXT_FILTERS, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, rows): how many rows fail which filters; the duplicate filter is the highest bit."""
    signed = checkpoint(_signed(docs, filters, text, key, part))
    events = signed.select("id", "part", "mask", F.lit(1).alias("rows"))
    if (bits := refine(signed.select("n", "blocks"))) is not None:
        first = originals(docs, bits, text, key)
        named = signed.filter("id IS NOT NULL").withColumn("class", _class(F.col("n"), F.col("blocks"), len(BLOCK_STARTS)))
        copies = maybe_in(named, bits).join(first, ["class", "id"], "left_anti")
        move = F.explode(F.array(F.struct(F.col("mask"), F.lit(-1).alias("rows")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), F.lit(1).alias("rows"))))
        events = events.unionByName(copies.select("id", "part", move.alias("m")).select("id", "part", "m.mask", "m.rows"))
    said = labels.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = join_split(events, said, "id", "part", hot_keys(signed, "id"), how="left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return known.groupBy("part", "mask", yes("good"), yes("toxic")).agg(F.sum("rows").alias("rows"))


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping = TEXT_FILTERS, duplicate: str = "E", text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """One row per part, order of all filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters``: a letter to a failure condition of (text, words); ``duplicate`` is the letter of the filter of exact copies, which comes last."""
    letters = [*filters, duplicate]
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters: all their orders are returned")
    masks = 1 << len(letters)
    counts = count_masks(docs, labels, filters, text, key, part)
    held = [F.sum(F.when(F.col("mask") == m, F.col("rows")).otherwise(0)) for m in range(masks)]
    lost = lambda c: [F.sum(F.when((F.col("mask") == m) & F.col(c), F.col("rows")).otherwise(0)) for m in range(masks)]
    parts = counts.groupBy("part").agg(F.array(*held).alias("n"), F.array(*lost("good")).alias("good"), F.array(*lost("toxic")).alias("toxic"))
    orders = list(permutations(range(len(letters))))
    steps = [("".join(letters[f] for f in o), k + 1, o[k], sum(1 << f for f in o[:k])) for o in orders for k in range(len(letters))]
    plan = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, before int")

    def over(column: str, keep) -> Column:
        return F.aggregate(F.zip_with(column, F.sequence(F.lit(0), F.lit(masks - 1)), lambda n, m: F.when(keep(m), n).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)

    bit, before = F.expr("shiftleft(1, f)"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    share = F.aggregate(F.zip_with("n", F.sequence(F.lit(0), F.lit(masks - 1)), lambda n, m: F.when(fails(m), n * F.floor(F.lit(len(orders)) / F.greatest(F.bit_count(m), F.lit(1)))).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    return parts.join(F.broadcast(plan)).select(
        "part", "filter_order", "step",
        over("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), over("n", here).alias("removed"),
        over("n", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"), over("n", lambda m: m == bit).alias("unique_fails"),
        over("good", here).alias("good_lost"), over("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )
