"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.common import named, staged, unused

WORD = r"[^\x20\x09-\x0D]+"


def letter_share(text: Column) -> Column:
    """The share of letters in a text, 0.05 at least: prose weighs more than markup and digits."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.greatest(F.lit(0.05), F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sample_key(key: Column, text: Column, weight: Column, seed: int) -> Column:
    """An exponential waiting time with rate ``weight``: the heavier a document, the earlier it tends to come.

    Its uniform number is the md5 of the key (of the text for a null key), so reruns agree.
    """
    name = F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 1.0) / float(1 << 52)
    return -F.log(uniform) / weight


def bucket_of(waiting: Column, buckets: int) -> Column:
    """Ranges of the waiting time that follow its order, a quarter of ``buckets`` for each doubling.

    A weight only shifts them: whatever the weights in a source, a range is expected to hold at most
    4 ln(2) / (e x ``buckets``) of its documents, which is 1.02 / ``buckets``.
    """
    held = F.greatest(F.least(waiting, F.lit(2.0**1000)), F.lit(2.0**-1000))
    return F.floor(F.log2(held) * (buckets / 4)).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source.

    Sources in code point order, null last, take ``weights`` in turn. They split ``share`` times the whole
    size by weight; none gets over ``most`` times its own size, and what is cut goes to the others by weight
    until none is above. That is min(cap, level x weight) for one level, found among the sources sorted by
    cap per weight.
    """
    if share > most:
        raise ValueError("the sources cannot hold that share")
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*(F.lit(int(w)) for w in weights))
    s = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    rising = before.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    filled = F.coalesce(F.sum("cap").over(rising), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0))
    s = s.withColumn("level", (F.col("total") - filled) / heavy)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    # the first level that no later cap undercuts; without one every source is full
    first = F.first(fits, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least("cap", F.coalesce(first * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def plan(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
    weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, buckets: int | None = None, seed: int = 7,
) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``epochs``, ``taken``.

    Whole epochs of a source come first: ``epochs`` times every document. The rest of the target goes to its
    documents in the order of their waiting times, prefix-summed; the document at the end of the budget gives
    the words that are left of it. Null texts have size 0, a null source is a source; equal rows are documents
    of their own. ``source_size`` and the others are zero where a source has no words. Other columns are dropped.

    No source is sorted as a whole: documents are summed by source and bucket of the waiting time first, and
    only the bucket in which a budget ends is sorted, about a ``buckets``-th part of its source at most: by default 1024,
    or as many as leave it about 50,000 documents. Rows that
    repeat a key and a text have one waiting time; there they are one row with their number. An empty table gives none.
    """
    if buckets is None:
        buckets = max(1024, docs.count() // 50_000)
    rate = weight if weight is not None else letter_share(named(text))
    skinny = docs.select(
        named(key).alias("doc_id"), named(source).alias("source"), size_of(named(text)).alias("size"),
        sample_key(named(key), named(text), rate, seed).alias("waiting"),
    )
    skinny = staged(skinny.withColumn("bucket", bucket_of(F.col("waiting"), buckets)), "sized")
    return _taken(skinny, _ends(skinny, weights, share, most))


def _ends(skinny: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per source: its target, whole epochs, and the bucket in which the rest ends, with what comes before."""
    sums = skinny.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("end", F.sum("words").over(upto))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn(
        "rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    )
    renamed = sums.withColumnRenamed("source", "s")
    at = renamed.join(goals, renamed["s"].eqNullSafe(goals["source"]))
    ended = F.when(F.col("end") > F.col("rest"), F.col("bucket"))
    ended = at.groupBy("source", "source_size", "target", "epochs", "rest").agg(
        F.min(ended).alias("last"), F.min(F.when(F.col("end") > F.col("rest"), F.col("end") - F.col("words"))).alias("before")
    )
    return staged(ended.withColumnRenamed("source", "of"), "budgets")


def _taken(skinny: DataFrame, ends: DataFrame) -> DataFrame:
    joined = skinny.join(ends, skinny["source"].eqNullSafe(ends["of"]))
    upto = Window.partitionBy("source").orderBy("waiting", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "source", "size", "source_size", "target", "epochs", "waiting"]
    partly = joined.where("bucket = last").groupBy(*columns, "rest", "before").agg(F.count(F.lit(1)).alias("copies"))
    partly = partly.withColumn("ahead", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(upto), F.lit(0)))
    partly = partly.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    left = F.col("rest") - F.col("ahead") - F.col("nth") * F.col("size")
    partly = partly.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    whole = joined.where("last IS NULL OR bucket <> last").withColumn(
        "part", F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(F.lit(0))
    )
    both = whole.select(*columns, "part").unionByName(partly.select(*columns, "part"))
    return both.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long")).drop("part")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **options) -> DataFrame:
    """``docs`` as the mix takes them, whole: each document as often as its epochs say, and once more where half or
    more of it is taken in the rest. All columns are returned as they are, whatever their names. Null and empty texts have
    no words and come with the whole epochs alone; repeated rows are documents of their own; an empty table gives an empty one.

    Texts are not shuffled: what they meet is a row per source, with the waiting time at which the budget ends.
    """
    planned = staged(plan(docs, key=key, text=text, source=source, seed=seed, **options), "plan")
    more = (F.col("taken") - F.col("epochs") * F.col("size")) * 2
    # documents up to this waiting time are in; nothing is, if none is
    of, epochs, until, copy = unused(docs, "__of", "__epochs", "__until", "__copy")
    ends = planned.groupBy("source").agg(
        F.max("epochs").alias(epochs), F.max(F.when((more >= F.col("size")) & (F.col("size") > 0), F.col("waiting"))).alias(until)
    ).withColumnRenamed("source", of)
    # as a table its size is known when the join is planned: a few rows are broadcast, many are not
    ends = staged(ends, "ends")
    rate = options.get("weight")
    rate = rate if rate is not None else letter_share(named(text))
    waiting = sample_key(named(key), named(text), rate, seed)
    joined = docs.join(ends, named(source).eqNullSafe(F.col(of)))
    once = F.when(waiting <= F.col(until), 1).otherwise(0)
    copies = F.explode(F.array_repeat(F.lit(1), (F.col(epochs) + once).cast("int")))
    return joined.withColumn(copy, copies).select(*(named(c) for c in docs.columns))
