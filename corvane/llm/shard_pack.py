"""Sharding by vector bin packing (operator 3); law `bytes`: bytes, tokens and rows of the shards are balanced jointly.

Rows with equal texts form a group that stays together; only a group that is larger than a whole shard is split, by
doc_id, into pieces of half a shard. Groups are sums (pre-aggregated before the shuffle). Those that hold more than
1/1024 of all bytes, tokens or rows (3 x 1024 at most, as shares sum to one in each measure) are placed first, in one
step. The others are dealt by hash to cells of a bounded number of groups; each cell places its groups, largest first,
where the dot product of the group's shares with the shard's residual capacity is highest, a shard's capacity being
what the large groups have left it; a cell's smallest groups, with a tenth of its bytes, go where most bytes are free,
so that the law holds also where the measures pull apart. Cells work alone, and their small errors do not add up to a bias, as the shards'
order is turned by the cell's number.

Defined results: null text has size 1 and no tokens, and null texts are one group; repeated rows each get a slot; groups
of equal size are taken by the digest of their text; a very long text is a group like others, alone in its shard's room
if it must be; an empty table gives an empty result; further columns are ignored by pack() and kept by write_shards().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, fresh, stage, table, words_of

SHARDS = 16
DIMS = ["size", "tokens", "rows"]
LARGE = 1024
CELL_GROUPS = 8192
#: Share of a cell's bytes, in its smallest groups, that evens out bytes alone, as the law demands.
LAST = 0.1


def place(vectors: np.ndarray, room: np.ndarray, first: int = 0, last: float = 0.0) -> np.ndarray:
    """Shard of each vector, taken in the given order; room: shards x measures, what is left, and gets less. The vectors
    that hold the `last` bytes go by bytes alone."""
    n, out = len(room), np.empty(len(vectors), dtype=np.int32)
    turn = (np.arange(n) + first) % n
    rest = vectors[:, 0].sum() if len(vectors) else 0.0
    for i, v in enumerate(vectors):
        gains = np.round(room @ v if rest > last else room[:, 0], 12)  # sums in another order tie alike
        s = turn[int(np.argmax(gains[turn]))]
        rest -= v[0]
        out[i] = s
        room[s] -= v
    return out


def pack(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, tokens, shard, slot; and the columns in keep as k_<name>."""
    kept = [f"k_{c}" for c in keep]
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", (bytes_of("text") + 1).alias("size"), words_of("text").alias("tokens"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("key"), *[F.col(c).alias(f"k_{c}") for c in keep],
    ).withColumn("key", F.coalesce("key", F.lit(b"null")))
    rows = stage(rows, "rows")
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "groups")
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMS], F.count(F.lit(1)).alias("n")).first()
    share = [max(1.0, float(total[d] or 0)) / shards for d in DIMS]
    cells = max(1, (total["n"] or 0) // CELL_GROUPS)
    parts = F.greatest(*[F.col(d) / F.lit(s) for d, s in zip(DIMS, share, strict=True)])
    groups = groups.withColumn("part", parts).withColumn("pieces", F.when(F.col("part") > 1, F.ceil(F.col("part") * 2)).otherwise(1).cast("int"))
    split = groups.where("pieces > 1").select("key", "pieces")
    whole = groups.where("pieces = 1").withColumn("piece", F.lit(0))
    # the pieces' real sums, from their rows
    keyed = rows.join(F.broadcast(split), "key", "left")  # at most 3 x shards groups are larger than a shard
    keyed = keyed.withColumn("piece", F.when(F.col("pieces").isNotNull(), F.expr("cast(pmod(xxhash64(doc_id), pieces) as int)")).otherwise(0)).drop("pieces")
    cut = keyed.join(F.broadcast(split.select("key")), "key", "left_semi").groupBy("key", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    items = whole.select("key", "piece", *DIMS).unionByName(cut.select("key", "piece", *DIMS))
    items = items.withColumn("part", parts)
    large = items.where(F.col("part") > shards / LARGE).toPandas()
    room = np.ones((shards, len(DIMS)))
    scale = np.array(share)
    large = large.assign(hexed=[bytes(k).hex() for k in large["key"]]).sort_values(["part", "hexed", "piece"], ascending=[False, True, True])
    large["shard"] = place(large[DIMS].to_numpy(float) / scale, room)
    left = np.maximum(room, 0)
    left = left / np.maximum(left.sum(axis=0), 1e-12)

    def cell(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(hexed=[bytes(k).hex() for k in pdf["key"]]).sort_values(["part", "hexed", "piece"], ascending=[False, True, True])
        vectors = pdf[DIMS].to_numpy(float)
        sums = np.maximum(vectors.sum(axis=0), 1e-12)
        pdf["shard"] = place(vectors / sums, left.copy(), int(key[0]), LAST)
        return pdf[["key", "piece", "shard"]]

    small = items.where(F.col("part") <= shards / LARGE).withColumn("cell", F.pmod(F.xxhash64("key", "piece"), F.lit(cells)))
    assigned = small.groupBy("cell").applyInPandas(cell, "key binary, piece int, shard int")
    fixed = [(bytearray(k), int(p), int(s)) for k, p, s in zip(large["key"], large["piece"], large["shard"], strict=True)]
    # rows of large groups learn their shard where they are; only those of small groups move to meet theirs
    fixed = F.broadcast(spark.createDataFrame(fixed, "key binary, piece int, shard int"))
    known = keyed.join(fixed, ["key", "piece"], "left")
    placed = known.where("shard IS NOT NULL").unionByName(known.where("shard IS NULL").drop("shard").join(assigned, ["key", "piece"]).select(*known.columns))
    placed = placed.withColumn("part", F.spark_partition_id())
    placed = stage(placed.select("doc_id", "size", "text_crc32", "tokens", "shard", "part", *kept), "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy("doc_id", "size", "text_crc32"))
    return placed.withColumn("rank", rank).join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "tokens", "shard", *kept, (F.col("rank") - 1 + F.col("offset")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Every row with all its columns and its slot, a folder for each shard."""
    packed = pack(docs, shards, tuple(docs.columns))
    shard, slot = fresh("shard", docs.columns), fresh("slot", docs.columns)
    packed.select(*[F.col(f"k_{c}").alias(c) for c in docs.columns], F.col("slot").alias(slot), F.col("shard").alias(shard)).write.partitionBy(shard).parquet(path)


def op3_shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
