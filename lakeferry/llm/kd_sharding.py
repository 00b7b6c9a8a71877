"""Sharding by a k-d tree: weighted medians along the widest metadata dimension, until every leaf has the target's bytes.

The rows of one text (by length and 96 bits of hashes) form a group that stays together. A group is a point with one coordinate per dimension, a
key whose high bits are the value and whose low bits are the group's hash: so no two groups tie, whatever repeats.
Values keep their order: the logarithm of the length, and the places of source and language among all.
Each level splits all nodes at once. A node's spread in a dimension is the difference of its weighted 5th and 95th
percentile, over that of the root. The weighted median is found by refining a histogram of the chosen key, BITS bits at a time,
so the driver sees at most nodes x dimensions x 2**BITS counts a pass whatever the size of the input.

Groups heavier than HEAVY of a shard, of which there are at most shards / HEAVY, are too coarse for a tree. They are put into shards first, the heaviest first, each whole where the most
room is. One that no shard has room for is cut, by the documents' ids, into as few pieces as fit. The tree then fills up what room the shards have left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeferry.llm.ranks import ranked
from lakeferry.runtime import materialize

#: A group of equal texts above this share of a shard's bytes is put into shards before the tree; room may be exceeded by SLACK of a shard.
HEAVY, SLACK = 1 / 16, 1 / 64
#: Bits of the key that a pass refines; three passes see all 30.
BITS = 10
VALUE_BITS, HASH_BITS = 10, 20
#: Rows of one shard that share a slot bucket, about.
SLOT_BUCKETS = 256


def dimensions(groups: DataFrame) -> dict[str, Column]:
    """Values of VALUE_BITS bits that keep their order: of a group's length on a logarithmic scale, and of the places, from 0 to 1, of its source and language."""
    most = (1 << VALUE_BITS) - 1
    place = lambda c: F.floor(F.col(c) * most).cast("bigint")
    return {"length": F.least(F.floor(F.log2(F.col("_bytes").cast("double")) * 32), F.lit(most)).cast("bigint"), "source": place("_at_source"), "lang": place("_at_lang")}


def with_places(groups: DataFrame, name: str) -> DataFrame:
    """Adds the place of the column ``name`` among its values, from 0 for the first to 1 for the last."""
    values = ranked(groups.select(name).distinct(), name)
    last = values.agg(F.greatest(F.max("_place"), F.lit(1)).alias("_last"))
    values = values.crossJoin(F.broadcast(last)).select(name, (F.col("_place") / F.col("_last")).alias(f"_at{name}"))  # one row
    return groups.join(values, name)


def put_first(sizes: list[int], room: list[float], slack: float) -> list[list[int]]:
    """The shards that each group, the heaviest first, goes to: one, or of one that fits nowhere as few as have room for equal pieces. ``room`` is used up."""
    out = []
    for size in sizes:
        by_room = sorted(range(len(room)), key=lambda i: (-room[i], i))
        pieces = next((p for p in range(1, len(room) + 1) if size / p <= room[by_room[p - 1]] + slack), len(room))
        for i in by_room[:pieces]:
            room[i] -= size / pieces
        out.append(by_room[:pieces])
    return out


def _histogram(units: DataFrame, keys: dict[str, Column], low: int) -> list:
    """[(node, dimension, bin, bytes)] of the BITS bits above ``low`` of each key."""
    bins = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), (F.shiftright(k, low) % (1 << BITS)).alias("bin")) for d, k in keys.items()]))
    got = units.select("_node", "_weight", bins.alias("_x")).groupBy("_node", "_x.d", "_x.bin").agg(F.sum("_weight").alias("w"))
    return [tuple(r) for r in got.collect()]


def _median_bin(cells: dict[int, float], below: float, half: float) -> tuple[int, float]:
    """(bin in which the running weight passes ``half``, weight before it)."""
    seen = below
    last = max(cells)
    for b in sorted(cells):
        if seen + cells[b] >= half or b == last:
            return b, seen
        seen += cells[b]
    raise ValueError("no cells")


def _spread(cells: dict[int, float]) -> float:
    total, seen, low = sum(cells.values()), 0.0, None
    for b in sorted(cells):
        seen += cells[b]
        if low is None and seen >= 0.05 * total:
            low = b
        if seen >= 0.95 * total:
            return b - (low if low is not None else b)
    return 0.0


def split_tree(units: DataFrame, keys: dict[str, Column], room: list[float]) -> tuple[DataFrame, list[dict]]:
    """Adds ``_node``, the shard, to units with ``_weight``, in proportion to the shards' room. Also returns the splits made, for reports.

    A node that must become s shards is split into s // 2 and s - s // 2, so any number of shards works.
    """
    shards = len(room)
    units = units.withColumn("_node", F.lit(0))

    def share(first: int, s: int) -> float:
        """Of a node's bytes those that go to the left."""
        whole = sum(room[first : first + s])
        return sum(room[first : first + s // 2]) / whole if whole > 0 else (s // 2) / s

    wanted, splits, root = {0: (0, shards)}, [], None
    while any(s > 1 for _, s in wanted.values()):
        top = VALUE_BITS + HASH_BITS - BITS
        live = [n for n, (_, s) in wanted.items() if s > 1]
        todo = units.filter(F.col("_node").isin(live))
        seen: dict[int, dict[str, dict[int, float]]] = {}
        for node, d, b, w in _histogram(todo, keys, top):
            seen.setdefault(node, {}).setdefault(d, {})[b] = float(w)
        if not seen:
            break
        root = root or {d: max(_spread(c), 1.0) for d, c in seen[min(seen)].items()}
        state = {}
        for node, dims in seen.items():
            first, s = wanted[node]
            d = max(sorted(dims), key=lambda x: _spread(dims[x]) / root[x])
            total = sum(dims[d].values())
            half = total * share(first, s)
            b, before = _median_bin(dims[d], 0.0, half)
            state[node] = {"d": d, "prefix": b, "before": before, "half": half, "total": total, "none": half <= 0}
        while top > 0:
            top -= BITS
            chosen = F.lit(None).cast("bigint")
            inside = F.lit(False)
            for node, x in state.items():
                at = F.col("_node") == node
                chosen = F.when(at, keys[x["d"]]).otherwise(chosen)
                inside = inside | (at & (F.shiftright(keys[x["d"]], top + BITS) == x["prefix"]))
            got: dict[int, dict[int, float]] = {}
            for node, _, b, w in _histogram(todo.filter(inside), {"k": chosen}, top):
                got.setdefault(node, {})[b] = float(w)
            for node, cells in got.items():
                x = state[node]
                b, x["before"] = _median_bin(cells, x["before"], x["half"])
                x["prefix"] = (x["prefix"] << BITS) | b
        name, after = F.col("_node"), {}
        for node, (first, s) in wanted.items():
            if node not in state:
                after[node] = (first, s) if s == 1 else (first, 1)
                continue
            x, left = state[node], s // 2
            splits.append({"node": node, "dimension": x["d"], "key": x["prefix"], "bytes": x["total"]})
            after[node], after[first + left] = (first, left), (first + left, s - left)
            right = F.lit(True) if x["none"] else keys[x["d"]] > x["prefix"]
            name = F.when((F.col("_node") == node) & right, F.lit(first + left)).otherwise(name)
        # the node's number is the first of its shards
        units, wanted = units.withColumn("_node", name), after
    return units, splits


def shard_documents(docs: DataFrame, shards: int = 16, heavy: float = HEAVY) -> DataFrame:
    """``docs(doc_id, text, source, lang)`` -> ``doc_id, size, text_crc32, shard, slot``, a row per row of ``docs``.

    Sizes are UTF-8 bytes and 1; near equal over shards if no document is large against a shard. Equal texts are in one shard unless they don't fit into one. Null texts are empty ones,
    null sources and languages come first. Rows that repeat are dealt as any others. Columns other than the four named are not looked at. An empty table gives no rows; of fewer texts than shards some stay empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            F.octet_length(text).cast("bigint").alias("_bytes0"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("_text"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"),
        ).withColumn("size", F.col("_bytes0") + 1),
        "rows",
    )
    group = ["_text", "_bytes0", "text_crc32"]
    groups = materialize(rows.groupBy(*group).agg(F.sum("size").alias("_weight"), F.min(F.struct("_source", "_lang")).alias("_m")), "groups")
    total = groups.agg(F.sum("_weight")).first()[0] or 0
    room = [total / shards] * shards
    top = groups.filter(F.col("_weight") > F.lit(total / shards * heavy)).orderBy(F.desc("_weight"), *group).select(*group, "_weight").collect()  # shards / heavy rows at most
    into = put_first([r["_weight"] for r in top], room, total / shards * SLACK)
    kind = "_text long, _bytes0 long, text_crc32 long, _shards array<int>"
    heavy_ones = docs.sparkSession.createDataFrame([(*r[:3], x) for r, x in zip(top, into, strict=True)], kind)
    marked = rows.join(F.broadcast(heavy_ones), group, "left").drop("_source", "_lang")
    piece = F.element_at("_shards", (F.pmod(F.xxhash64("doc_id"), F.size("_shards")) + 1).cast("int"))
    first = marked.filter("_shards IS NOT NULL").select("doc_id", "size", "text_crc32", piece.alias("shard"))
    # pieces are equal but for chance, so the room left is that beside what they really are
    room = [total / shards] * shards
    for shard, held in first.groupBy("shard").agg(F.sum("size")).collect():  # a row for each shard
        room[shard] -= held
    units = groups.join(F.broadcast(heavy_ones.select(*group)), group, "left_anti").select(*group, "_weight", F.col("_m._source").alias("_source"), F.col("_m._lang").alias("_lang"))
    units = with_places(with_places(units, "_source"), "_lang").withColumn("_bytes", F.col("_bytes0") + 1)
    low = F.shiftright(F.xxhash64(*group, F.lit(7)), 64 - HASH_BITS) + F.lit(1 << (HASH_BITS - 1))
    dims = dimensions(units)
    units = materialize(units.select(*group, "_weight", *[(F.shiftleft(c, HASH_BITS) + low).alias(f"_k_{d}") for d, c in dims.items()]), "units")
    leaves, _ = split_tree(units, {d: F.col(f"_k_{d}") for d in dims}, [max(r, 0.0) for r in room])
    # no text is heavy here, so the join's keys are not either
    light = marked.filter("_shards IS NULL").join(leaves.select(*group, F.col("_node").alias("shard")), group).select("doc_id", "size", "text_crc32", "shard")
    out = first.unionByName(light)
    return with_slots(out)


def with_slots(out: DataFrame, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: the place in a bucket of the shard plus the rows of the buckets before."""
    out = out.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(buckets)))
    counts = out.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32"))
    ranked = out.withColumn("_place", place).join(counts, ["shard", "_bucket"])
    return ranked.withColumn("slot", F.col("_before") + F.col("_place") - 1).drop("_bucket", "_place", "_before")
