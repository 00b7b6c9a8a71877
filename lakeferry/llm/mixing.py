"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source has the same number of expected copies, ``target / source_size``. The documents of a source are
laid in a fixed order, their expected copies are summed up from the first on, one offset per source is added, and a document
is emitted once for each integer that its stretch of the sum crosses. As neighbours in that order are of about equal size,
the words taken come close to the target.

The order within a source is (size rounded down to two digits, a hash of the document's id, the id). A document's place in it
is its place in its bucket (source, rounded size, first bits of the hash) plus the rows of the buckets before. So no task ever
holds a source: a bucket holds 1 / 2**SALT_BITS of the rows of one rounded size of one source. Buckets are added up first over the
2**SALT_BITS of a rounded size, then over a source's rounded sizes, of which there are at most 90 a decade.
Sources themselves are ranked in ranges, and what each gets is settled by sums over all of them, so that their number doesn't matter either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeferry.llm.ranks import ranked
from lakeferry.runtime import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
WORD = "[^\\x20\\x09-\\x0D]+"
#: A bucket's share of one rounded size of one source is 2**-SALT_BITS of it.
SALT_BITS = 8
SEED = "mix"


def _unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first eight hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])), 1, 8), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Target words of every source: ``sizes(source, source_size)`` -> ``source, source_size, target``.

    Sources in code-point order, null last, get the weights in turn. A target above ``max_epochs`` times its source's size
    is held there and the rest is shared anew by weight until none is above. Sources without words get 0.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    t = ranked(sizes, "source").withColumn("_w", F.element_at(table, (F.col("_place") % len(weights) + 1).cast("int")))
    t = materialize(t.select("source", "source_size", "_w", (max_epochs * F.col("source_size")).alias("_cap")), "caps")
    level, held = None, -1
    while True:
        # sources whose cap is below their share are held; the others share what is left. Sums of whole numbers, so exact in any order
        full = F.lit(False) if level is None else F.col("_cap") < level * F.col("_w")
        total, caps, w, n = t.agg(F.sum("source_size"), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w"))), F.count_if(full)).first()
        if n == held or not w:
            break
        level, held = ((total or 0) - (caps or 0.0)) / w, n
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), level * F.col("_w"))
    return t.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED, salt_bits: int = SALT_BITS) -> DataFrame:
    """``docs(doc_id, text, source)`` -> ``doc_id, source, size, source_size, target, copies, taken`` and ``_row``, a hash of the three columns; a row per document.

    Null or empty texts have size 0 (and get copies as others do, which take no words). A null source is a source of its own.
    Rows that repeat are drawn apart, though equal ids stand side by side in the order. An empty table gives no rows.
    Columns other than the three named are not looked at. Calls on the same rows agree.
    """
    # sources are coded as strings so that a null one is a key like any other; what is read of the texts is read once
    sized = docs.select(
        "doc_id",
        "source",
        F.xxhash64("doc_id", "source", "text").alias("_row"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    sized = materialize(sized, "sizes")
    spark_targets = source_targets(sized.groupBy("source", "_key").agg(F.sum("size").alias("source_size")).drop("_key"), weights, max_epochs)
    targets = spark_targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_key"), "source_size", "target")
    digits = F.length(F.col("size").cast("string"))
    step = F.pow(F.lit(10), F.greatest(digits - 2, F.lit(0))).cast("bigint")
    placed = sized.withColumn("_bin", F.col("size") - F.col("size") % step).withColumn("_hash", _unit(seed, F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = placed.withColumn("_salt", F.floor(F.col("_hash") / F.lit(1 << (32 - salt_bits))).cast("int"))
    bucket = ["_key", "_bin", "_salt"]
    counts = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_low", F.sum("_n").over(Window.partitionBy("_key", "_bin").orderBy("_salt")) - F.col("_n"))
    bins = counts.groupBy("_key", "_bin").agg(F.sum("_n").alias("_n"))
    bins = bins.withColumn("_high", F.sum("_n").over(Window.partitionBy("_key").orderBy("_bin")) - F.col("_n")).drop("_n")
    plan = counts.join(bins, ["_key", "_bin"]).join(targets, "_key").select(*bucket, (F.col("_low") + F.col("_high")).alias("_before"), "source_size", "target")
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy("_hash", F.col("doc_id").asc_nulls_last()))
    ranked = placed.withColumn("_place", place).join(plan, bucket)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(seed, F.lit("+"), F.col("_key")) / F.lit(float(1 << 32))
    upto = F.col("_before") + F.col("_place")
    copies = (F.floor(upto * ratio + offset) - F.floor((upto - 1) * ratio + offset)).cast("bigint")
    copies = F.least(copies, F.lit(int(max_epochs)).cast("bigint"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "_row").withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it was drawn, with the columns of ``docs``, whatever they are called.

    Rows meet what was drawn by a hash of id, source and text. Of rows that repeat in all three, none gets above the cap: what they were drawn in all is shared
    evenly. Null ids, sources and texts are values like others. An empty table gives no rows.
    """
    names = docs.columns
    drawn = mix_sources(docs, **options).groupBy("_row").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0")
    key = F.xxhash64("doc_id", "source", "text")
    out = docs.select(key.alias("_row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc")).join(drawn, "_row")
    place = F.when(F.col("_rows") > 1, F.row_number().over(Window.partitionBy("_row").orderBy("_row"))).otherwise(F.lit(1))
    share = lambda k: F.floor(k * F.col("_copies") / F.col("_rows"))
    out = out.withColumn("_place", place).withColumn("_n", share(F.col("_place")) - share(F.col("_place") - 1)).filter("_n > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in names])
