"""Filling containers of fixed capacity: shortest-pack-first over the length histogram.

Only the histogram of lengths reaches the driver: at most ``capacity`` rows, however many items there
are. Lengths are placed longest first, each into the least filled packs that still hold it; packs
filled alike are one pattern with a count, so the work depends on the capacity alone. The patterns go
back as ranges of ranks within each length and are joined to the items.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.tokens import count_tokens
from lodeweave.runtime import cut

#: Items of one length that are ranked together; a more frequent length is ranked in several groups.
RANKED_TOGETHER = 50_000


def place(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that hold all items of the histogram; no pattern exceeds the capacity."""
    open_packs: list[tuple[int, int, int, tuple]] = []  # fill, serial, count, lengths as nested pairs
    done, serial = [], 0
    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, per_pack = histogram[length], capacity // length
        while left > 0:
            if open_packs and open_packs[0][0] + length <= capacity:
                fill, _, count, lengths = heappop(open_packs)
                taken = min(count, left)
                if taken < count:
                    serial += 1
                    heappush(open_packs, (fill, serial, count - taken, lengths))
            else:  # as many new packs as the items left need; each takes one item now, more in the next turns
                fill, taken, lengths = 0, -(-left // per_pack), ()
            left -= taken
            serial += 1
            new = (fill + length, serial, taken, (length, lengths))
            if fill + length == capacity:
                done.append(new)
            else:
                heappush(open_packs, new)
    out = []
    for _, _, count, nested in done + open_packs:
        lengths = []
        while nested:
            length, nested = nested
            lengths.append(length)
        out.append((count, lengths[::-1]))
    return out


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, count, first pack, offset): the item of rank first+k goes to pack first_pack+k."""
    used: dict[int, int] = {}
    out, pack = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            out.append((length, rank, count, pack, offset))
            used[length] = rank + count
            offset += length
        pack += count
    return out


def pack_items(items: DataFrame, capacity: int) -> DataFrame:
    """Adds pack_id and pack_offset to items (item columns, ``length`` int, ``item_key`` sortable and unique).

    An item is never split here: lengths must not exceed the capacity. Length 0 or null needs no room:
    pack_id and pack_offset are null. Equal lengths are told apart by item_key.
    """
    spark = items.sparkSession
    counted = items.where("length > 0").groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.collect()}  # at most `capacity` rows
    if histogram and max(histogram) > capacity:
        raise ValueError("an item is longer than the capacity")
    groups = spark.createDataFrame([(k, max(1, -(-n // RANKED_TOGETHER))) for k, n in histogram.items()], "length int, groups int")
    ranges = spark.createDataFrame(slots(place(histogram, capacity)), "length int, first bigint, n bigint, first_pack bigint, pack_offset int")

    keyed = items.join(F.broadcast(groups), "length", "left").withColumn("part", F.pmod(F.xxhash64("item_key"), F.col("groups")))
    sizes = keyed.where("length > 0").groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("length", "part").orderBy("item_key")
    ranked = keyed.where("length > 0").withColumn("at", F.row_number().over(within) - 1).join(starts, ["length", "part"]).withColumn("rank", F.col("start") + F.col("at"))
    placed = ranked.alias("i").join(ranges.alias("r"), (F.col("i.length") == F.col("r.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("r.n")))
    own = [F.col(f"i.{c}").alias(c) for c in items.columns]
    full = placed.select(*own, (F.col("first_pack") + F.col("rank") - F.col("first")).alias("pack_id"), "pack_offset")
    none = items.where("length is null or length <= 0").withColumns({"pack_id": F.lit(None).cast("bigint"), "pack_offset": F.lit(None).cast("int")})
    return full.unionByName(none)


def pack_documents(documents: DataFrame, capacity: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece_no, first_token, n_tokens, pack_id, pack_offset): where every text goes.

    A text is cut only if it alone exceeds the capacity, into pieces of the whole capacity and a rest.
    Null and empty texts come out once, with 0 tokens and no pack. Repeated texts are items of their own.
    """
    sized = documents.select(F.col(id_col).alias("doc_id"), count_tokens(path, documents, F.col(text_col).cast("string")).alias("tokens"))
    sized = cut(sized)  # counted once, read twice
    cap = F.lit(capacity)
    pieces = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / cap) - 1).cast("int"))).alias("piece_no"))
    first = F.col("piece_no") * cap
    items = pieces.select("doc_id", "piece_no", first.alias("first_token"), F.least(cap, F.col("tokens") - first).cast("int").alias("length"), F.struct("doc_id", "piece_no").alias("item_key"))
    return pack_items(items, capacity).select("doc_id", "piece_no", "first_token", F.col("length").alias("n_tokens"), "pack_id", "pack_offset")
