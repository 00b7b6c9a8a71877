"""Similarity join of documents on word n-grams, as a blocked sparse matrix product of the document by n-gram incidence.

Texts with one set of shingles are one row of the incidence matrix. Rows i and j link when 100 |i & j| >= SIMILARITY |i | j|. In any one
order of all shingles, linked rows share one among the first n - ceil(0.8 n) + 1 of each; that prefix is what is shuffled, and the order
puts the shingles last that many documents of some batch have, so that common passages stay out of prefixes. A shingle that stands in
one prefix only is dropped. So is one that more than HOT_ROWS rows have, for rows whose hot shingles are too few to make a link: all their links have
another shingle in common too, by which they meet. A row's family is the shingle of its prefix that most rows share.

First product: each family is dealt to blocks of up to BLOCK_ROWS rows, to each of which the family's few most central rows are
added; a block multiplies its part of the incidence by its transpose, n-gram by n-gram, adding up the overlaps, discards pairs below the
bound that the sizes give, and returns links that span what is connected. Second product: wherever a shingle has rows of two
blocks that are not yet known to be connected, those rows of the two blocks are multiplied. Links that would join what is joined already
are never looked for, so a large group of near copies costs as many links as it has rows, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd, lcm

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeferry.llm.anchors import sieve
from lakeferry.llm.components import components
from lakeferry.llm.docstats import text_rows
from lakeferry.llm.textcore import shingle_hashes, slices, word_hashes
from lakeferry.runtime import materialize, ship

WORDS, SIMILARITY = 5, 80
#: Prefixes are longer than need be by a share 1 / EXTRA: linked sets then have several shingles in common there, which chance seldom gives.
EXTRA = 20
#: Rows of a block, and central rows of the family that each of its blocks also has.
BLOCK_ROWS, LEADERS = 256, 8
#: Shingles of a block, about, unless one row alone has more.
BLOCK_GRAMS = 1 << 22
#: In families of up to so many rows, pairs whose prefixes have too little in common are discarded before whole sets are read.
SMALL = 64
#: A shingle is common if this share of some batch's documents has it, and COMMON_LEAST of them; as many common shingles are known at most.
COMMON_SHARE, COMMON_LEAST, COMMON_MAX = 1 / 400, 8, 1 << 18
#: A shingle of more prefixes is hot.
HOT_ROWS = 256
#: Blocks of a family whose central rows are compared at a time.
LEADER_BLOCKS = 512


def prefix_length(n, similarity: int = SIMILARITY):
    """Shingles of a set's prefix: the least number, of n, that holds one which a linked set has in its own prefix, and EXTRA of n more."""
    return n - -(-n * similarity // 100) + 1 + n // EXTRA


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row, of lower-cased A-Z words."""
    for i, j, buf, bounds in slices(column):
        h, per = word_hashes(buf, bounds, lower=True)
        s, at = shingle_hashes(h, per, words)
        for k in range(j - i):
            x = np.sort(s[at[k] : at[k + 1]])
            yield i + k, x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def common_shingles(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of shingles that are common in some batch, the commonest COMMON_MAX. All documents are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for _, x in shingle_sets(batch.column(1), words)]
            least = max(COMMON_LEAST, int(len(sets) * COMMON_SHARE))
            x = np.sort(np.concatenate([np.zeros(0, np.uint64), *sets]))
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([edge, [len(x)]]))
            yield pa.RecordBatch.from_arrays([pa.array(x[edge][n >= least].view(np.int64)), pa.array(n[n >= least])], ["tok", "n"])

    got = text_rows(docs).mapInArrow(run, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tok").limit(COMMON_MAX).select("tok").toPandas()
    return np.sort(got["tok"].to_numpy(np.int64).view(np.uint64))


def _signatures(docs: DataFrame, common: np.ndarray, words: int, similarity: int) -> DataFrame:
    """doc_id, hash of the text, n, digest of the set, prefix: a row per row of ``docs``."""
    late = docs.sparkSession.sparkContext.broadcast(common)  # COMMON_MAX hashes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, prefixes = [], [], []
            for _, x in shingle_sets(batch.column(1), words):
                n.append(len(x))
                digest.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else b"")
                if len(x) and len(late.value):
                    i = np.minimum(np.searchsorted(late.value, x), len(late.value) - 1)
                    last = late.value[i] == x
                    x = np.concatenate([x[~last], x[last]])
                prefixes.append(x[: prefix_length(len(x), similarity)] if len(x) else x)
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *prefixes]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], ["doc_id", "like", "n", "digest", "prefix"])

    return text_rows(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("like")).mapInArrow(run, "doc_id long, like long, n long, digest binary, prefix array<long>")


def product_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, group: np.ndarray, similarity: int = SIMILARITY) -> list[tuple[int, int]]:
    """Links between rows ``left`` and rows ``right`` (positions in ``sets``) that connect what ``group`` has apart.

    The product of the two incidence matrices, a row of ``left`` at a time: its n-grams' columns in ``right`` are added up.
    A pair is discarded whose overlap is below what the sizes ask for: 100 o >= s (a + b - o).
    """
    group = np.unique(group, return_inverse=True)[1]
    size = np.array([len(s) for s in sets], np.int64)
    grams = np.concatenate([np.zeros(0, np.uint64), *[sets[r] for r in right]])
    column = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(grams, kind="stable")
    grams, column = grams[order], column[order]
    out = []
    for i in left:
        apart = group[right] != group[i]
        if not apart.any():
            continue
        low, high = np.searchsorted(grams, sets[i], "left"), np.searchsorted(grams, sets[i], "right")
        n = high - low
        hit = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        overlap = np.bincount(column[hit], minlength=len(right))
        linked = apart & ((100 + similarity) * overlap >= similarity * (size[right] + size[i])) & (overlap > 0)
        for j in np.flatnonzero(linked):
            if group[right[j]] != group[i]:
                group[group == group[right[j]]] = group[i]
                out.append((int(i), int(right[j])))
    return out


def _to_sets(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [values[at[k] : at[k + 1]] for k in range(len(at) - 1)]


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, grams: the whole sets of the documents in ``wanted(id)``. Others are kept out by a sieve, as far as one can be had, and a join that follows."""
    some = sieve(wanted.select(F.col("id").alias("doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if some is not None:
                batch = batch.filter(pa.array(some.holds(batch.column(2).to_numpy())))
            for i, j, _, _ in slices(batch.column(1)):
                sets = [x for _, x in shingle_sets(batch.column(1).slice(i, j - i), words)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "grams"])

    rows = text_rows(docs.filter("doc_id IS NOT NULL"))
    if some is None:
        rows = rows.join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
    rows = rows.withColumn("at", F.lit(0).cast("long") if some is None else some.place("doc_id"))
    return rows.mapInArrow(run, "id long, grams array<long>")


def _in_several(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` whose tok stands more than once, with the number of ``rows`` that have it. Counts are added up before they are shuffled."""
    counts = rows.groupBy("tok").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return rows.drop("rows").join(counts, "tok")


def _by_row(shared: DataFrame) -> DataFrame:
    """id, n, p, of: each row with a list of its shingles and how many rows have each."""
    return shared.groupBy("id").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.collect_list(F.struct("tok", "rows")).alias("of"))


def linked_components(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_shingles, component_id; a row per row of ``docs``. doc_id must be a whole number.

    A document of fewer words than a shingle has its whole sequence as one; one without words, or a null text, has an empty set and is linked with
    nothing. Rows that repeat an id are taken as one document (each is returned), which links as any of its rows does. Very long texts are taken
    whole. Of equal sets the least doc_id stands for all; a row without a doc_id has the component of
    documents with an equal set, or none. An empty table gives no rows. Other columns are not looked at.
    """
    return _members(docs, words, similarity).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _members(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """doc_id, hash of the text, n, digest, component_id: a row per row of ``docs``."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = common_shingles(docs, words)
    signed = materialize(_signatures(docs, common, words, similarity), "signed")
    # rows of the incidence matrix: one for each set, named by its least document
    rows = signed.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("id"), F.first("prefix").alias("prefix"))
    entries = rows.filter("id IS NOT NULL").select("id", "n", F.size("prefix").alias("p"), F.explode("prefix").alias("tok"))
    shared = materialize(_in_several(entries), "shared")
    # a row whose prefix shares too little with all others together can't link; without it some shingles are shared no more
    least, most = F.ceil(F.col("n") * similarity / 100), F.floor(F.col("n") * 100 / similarity)
    able = _by_row(shared).filter(_may_link_some(F.col("n"), least, most, F.size("of").cast("long"), similarity))
    shared = materialize(_in_several(able.select("id", "n", "p", F.explode("of.tok").alias("tok"))), "able")
    # hot shingles go from rows that can't link by them alone; how many went is reckoned with as if all were common
    cool = F.filter("of", lambda x: x["rows"] <= HOT_ROWS)
    hot = (F.size("of") - F.size(cool)).cast("long")
    rows = _by_row(shared).withColumn("gone", F.when(_may_link_some(F.col("n"), least, most, hot, similarity), 0).otherwise(hot).cast("long"))
    rows = rows.select("id", "n", "p", "gone", F.explode(F.when(F.col("gone") > 0, cool).otherwise(F.col("of"))["tok"]).alias("tok"))
    shared = materialize(_in_several(rows), "cool")
    edges = _span(docs, shared, words, similarity)
    joined = components(edges)
    named = signed.select("doc_id", "like", "n", "digest")
    rows = named.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("id"))
    rows = rows.join(joined.select(F.col("node").alias("id"), "component"), "id", "left").select("digest", "n", F.coalesce("component", "id").alias("component_id"))
    out = named.join(rows, ["digest", "n"], "left")
    return out.select("doc_id", "like", "n", "digest", F.coalesce("component_id", "doc_id").alias("component_id"))


def _may_link(n: Column, m: Column, common: Column, similarity: int) -> Column:
    """Whether sets of n and m shingles can link if their prefixes have ``common`` shingles at most in common.

    Of the two prefixes one ends first in the order of shingles. What that set has beyond its prefix is all that can be common besides.
    """
    rest = lambda x: F.floor((x * similarity + 99) / 100) - 1 - F.floor(x / EXTRA)
    return (common + F.greatest(rest(n), rest(m))) * (100 + similarity) >= (n + m) * similarity


def _may_link_some(n: Column, low: Column, high: Column, common: Column, similarity: int) -> Column:
    """Whether ``_may_link`` holds for some size from ``low`` to ``high``; they may be the wrong way round if no size is in range.

    What n has beyond its prefix helps most at ``low``. What the other has grows with its size but for steps of both roundings, which
    come again after ``period`` sizes; over a period the bound rises (or falls) by the same everywhere, so one period at that end has the best size.
    """
    period = lcm(EXTRA, 100 // gcd(similarity, 100))
    rises = (100 + similarity) * (similarity * EXTRA - 100) >= 100 * EXTRA * similarity
    low, high = low.cast("long"), high.cast("long")
    first, last = (F.greatest(low, high - (period - 1)), high) if rises else (low, F.least(high, low + (period - 1)))
    other = F.exists(F.sequence(first, F.greatest(first, last)), lambda m: _may_link(n, m, common, similarity))
    return _may_link(n, low, common, similarity) | other


def _span(docs: DataFrame, shared: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links u, v that connect all linked rows."""
    # family: the prefix shingle that most rows share; central: the larger the share of the prefix that others share
    row = shared.groupBy("id").agg(
        F.max(F.struct("rows", "tok")).alias("top"),
        (F.count(F.lit(1)) / F.first("p")).alias("central"),
        F.first("n").alias("n"),
    )
    row = row.select("id", "n", "central", F.col("top.tok").alias("family"))
    size = row.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("grams"))
    row = row.join(size, "family").withColumn("blocks", F.ceil(F.greatest(F.col("members") / BLOCK_ROWS, F.col("grams") / BLOCK_GRAMS)).cast("long"))
    row = materialize(row.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "row")
    big = row.filter("blocks > 1")
    # the most central rows of a family of several blocks: the best of each block first, so that no task sees the family
    best = Window.partitionBy("family", "block").orderBy(F.desc("central"), "id")
    best = big.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= LEADERS)
    for part in (F.pmod("block", F.lit(LEADER_BLOCKS)), F.lit(0)):
        best = best.withColumn("r", F.row_number().over(Window.partitionBy("family", part).orderBy(F.desc("central"), "id"))).filter(F.col("r") <= LEADERS)
    leaders = best.select("id", "family", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    # of small families those rows whose overlap within the prefixes leaves a link possible
    small = row.filter(F.col("members").between(2, SMALL)).select("id", "family")
    post = shared.select("tok", "id", "n", "gone").join(small, "id")
    left, right = (post.select("tok", "family", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("gone").alias(f"g{x}")) for x in "ab")
    pairs = left.join(right, ["tok", "family"]).filter("a < b").filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similarity))
    pairs = pairs.groupBy("a", "b", "family").agg((F.count(F.lit(1)) + F.first(F.greatest("ga", "gb"))).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = pairs.filter(_may_link(F.col("na"), F.col("nb"), F.col("c"), similarity))
    hopeful = pairs.select(F.explode(F.array("a", "b")).alias("id"), "family", F.lit(0).cast("long").alias("block"))
    large = row.filter(F.col("members") > SMALL).select("id", "family", "block")
    dealt = materialize(large.unionByName(leaders.select("id", "family", "block")).unionByName(hopeful).distinct(), "dealt")
    grams = _full_sets(docs, dealt.select("id").distinct(), words)

    def within(table: pa.Table) -> pa.Table:
        ids, sets = table.column("id").to_numpy(), _to_sets(table.column("grams"))
        every = np.arange(len(ids))
        links = product_links(sets, every, every, every.copy(), similarity)
        return pa.table({"u": pa.array([ids[a] for a, _ in links], pa.int64()), "v": pa.array([ids[b] for _, b in links], pa.int64())})

    first = dealt.join(grams, "id").groupBy("family", "block").applyInArrow(within, "u long, v long")
    first = materialize(first, "first")
    joined = components(first)
    # what a shingle still has apart: rows of other blocks whose component is another
    at = row.select("id", "family", "block", "members").join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
    at = at.select("id", F.when(F.col("members") > SMALL, F.xxhash64("family", "block")).otherwise(F.xxhash64("id")).alias("blk"), F.coalesce("component", "id").alias("comp"))
    live = materialize(shared.select("tok", "id", "n", "gone").join(at, "id").select("tok", "id", "n", "gone", "blk", "comp"), "placed")
    apart = live.groupBy("tok").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("tok")
    live = materialize(live.join(apart, "tok"), "live")
    cells = live.groupBy("tok", "blk").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("gone").alias("g1"))
    other = cells.select("tok", F.col("blk").alias("blk2"), "c0", "c1", "n0", "n1", "g1")
    sent = live.join(other, "tok").filter(
        (F.col("blk") != F.col("blk2"))
        & ((F.col("c0") != F.col("comp")) | (F.col("c1") != F.col("comp")))
        & (F.col("n") * 100 >= F.col("n0") * similarity)
        & (F.col("n1") * 100 >= F.col("n") * similarity)
    )
    sent = sent.groupBy("id", "blk", "blk2").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), (F.count(F.lit(1)) + F.greatest(F.first("gone"), F.max("g1"))).alias("c"), F.min("n0").alias("n0"), F.max("n1").alias("n1"))
    low = F.greatest(F.col("n0"), F.ceil(F.col("n") * similarity / 100))
    high = F.least(F.col("n1"), F.floor(F.col("n") * 100 / similarity))
    sent = sent.filter(_may_link_some(F.col("n"), low, high, F.col("c"), similarity))
    sent = sent.select("id", "comp", "n", F.least("blk", "blk2").alias("x"), F.greatest("blk", "blk2").alias("y"), (F.col("blk") < F.col("blk2")).alias("is_x"))
    sides = sent.groupBy("x", "y").agg(F.min("is_x").alias("lo"), F.max("is_x").alias("hi")).filter("lo <> hi").select("x", "y")
    # pairs of blocks are gathered at the least block that either side has to do with, so that a row isn't sent once for each pair
    sides = materialize(sides, "sides")
    near = sides.unionByName(sides.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    hub = sides.join(near, "x").join(near.select(F.col("x").alias("y"), F.col("m").alias("m2")), "y").select("x", "y", F.least("m", "m2").alias("hub"))
    sent = materialize(sent.join(hub, ["x", "y"]).select("id", "comp", "n", "x", "y", "is_x", "hub"), "sent")
    met = sent.select("hub", "id", "comp", "n").distinct()
    load = met.groupBy("hub").agg((F.count(F.lit(1)) > 2 * BLOCK_ROWS).alias("many"), (F.sum("n") > BLOCK_GRAMS).alias("long"))
    load = load.select("hub", (F.col("many") | F.col("long")).alias("apart"))
    # a hub that too much meets at is left to its pairs
    whole = met.join(load.filter("not apart"), "hub").select("id", "comp", F.col("hub").alias("x"), F.lit(None).cast("long").alias("y"), F.lit(None).cast("boolean").alias("is_x"))
    sent = whole.unionByName(sent.join(load.filter("apart"), "hub").select("id", "comp", "x", "y", "is_x"))

    def between(table: pa.Table) -> pa.Table:
        ids, sets = table.column("id").to_numpy(), _to_sets(table.column("grams"))
        if table.column("y").null_count:
            left = right = np.arange(len(ids))
        else:
            side = table.column("is_x").to_numpy(zero_copy_only=False).astype(bool)
            left, right = np.flatnonzero(side), np.flatnonzero(~side)
        links = product_links(sets, left, right, table.column("comp").to_numpy(), similarity)
        return pa.table({"u": pa.array([ids[a] for a, _ in links], pa.int64()), "v": pa.array([ids[b] for _, b in links], pa.int64())})

    grams = _full_sets(docs, sent.select("id").distinct(), words)
    second = sent.join(grams, "id").groupBy("x", "y").applyInArrow(between, "u long, v long")
    return first.unionByName(second)


def keep_one(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: of each component the document of least id.

    Of rows with that id and equal sets the one whose text has the least hash stays, and of rows equal in id and text the first by their other columns;
    rows of that id with unlike sets all stay. A row without an id goes if a document has its set, else one row for each set stays. Texts without words
    are like no others: they all stay, but for rows equal in id and text. An empty table gives no rows. Columns may have any names.
    """
    names = docs.columns
    found = _members(docs, words, similarity).filter("doc_id <=> component_id")
    # the null id has a key of its own, so that the join need not ask for nulls
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("_id"), F.col("like")]
    keep = found.groupBy("doc_id", "digest", F.when(F.col("n") == 0, F.col("like")).alias("alone")).agg(F.min("like").alias("like")).select(*key).distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("like"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    other = [F.col("_doc").getField(f.name).asc_nulls_last() for f in docs.schema.fields if f.name not in ("doc_id", "text") and f.dataType.typeName() not in ("map", "variant")]
    first = F.row_number().over(Window.partitionBy("_id", "like").orderBy(*(other or [F.lit(1)])))
    rows = rows.join(keep, ["_id", "like"], "left_semi").withColumn("_first", first).filter("_first = 1")
    return rows.select(*[F.col("_doc").getField(c).alias(c) for c in names])
