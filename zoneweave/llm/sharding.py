"""Sharding: a prime-sized lookup table filled by shards in turns, broadcast for constant-time placement."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Production table: prime, over 100 slots a shard, so that shares differ by about a hundredth.
SHARDS, SLOTS = 64, 6551


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """Shard of each slot. Every shard prefers slots in the order offset + j*skip mod slots; in turns each
    claims the first of its preferences that is still free. Dropping a shard moves few other slots."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not prime")
    if not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one and no more than slots")
    at = [_number("offset:" + s) % slots for s in shards]
    skip = [_number("skip:" + s) % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % slots
        owner[at[i]] = i
    return owner


def table_frame(spark, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard_no) from one SQL literal, so that no Python worker takes part."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "n")).select(F.col("slot").cast("long"), F.col("n").cast("int").alias("shard_no"))


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 60 bits of the md5 of its text, modulo the table's size. Null keys hash as ''."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots))


def assign_shards(rows: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Rows with `slot` (long), `shard_no` (int) and `shard` (string) of their key; no shuffle of the rows.

    The table has `slots` rows of two numbers, a parameter and never the data's size, so it is broadcast.
    Equal keys go to one shard by definition: where a key is hot, give a key with a part that
    spreads it (an id or a position). Null keys share the slot of ''. Repeated rows, long or empty
    keys and empty tables need no special case. Columns of these three names are overwritten.
    """
    spark = rows.sparkSession
    base = rows.drop("slot", "shard_no", "shard").withColumn("slot", slot_of(key, slots))
    names = F.array(*[F.lit(s) for s in shards])
    return base.join(F.broadcast(table_frame(spark, shards, slots)), "slot").withColumn("shard", F.get(names, F.col("shard_no"))).select(*rows.drop("slot", "shard_no", "shard").columns, "slot", "shard_no", "shard")


def production_shards() -> list[str]:
    return [f"shard-{i:03d}" for i in range(SHARDS)]


def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return assign_shards(docs, F.col("doc_id"), production_shards()).select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "slot", "shard_no", "shard")


_HASH = "(('0x' || substr(md5({}), 1, 15))::BIGINT)"
OP10_SQL = f"""
WITH RECURSIVE s AS (
  SELECT i, {_HASH.format("'offset:shard-' || lpad(i::VARCHAR, 3, '0')")} % {SLOTS} AS off,
         {_HASH.format("'skip:shard-' || lpad(i::VARCHAR, 3, '0')")} % {SLOTS - 1} + 1 AS skip FROM range({SHARDS}) r(i)),
l AS (SELECT list(off ORDER BY i) AS offs, list(skip ORDER BY i) AS skips FROM s),
t(turn, owner, slot) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: -1), NULL::BIGINT
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda x, k: CASE WHEN k = pick + 1 THEN turn % {SHARDS} ELSE x END), pick FROM (
    SELECT turn, owner, list_filter(list_transform(range({SLOTS}), lambda j: (offs[turn % {SHARDS} + 1] + j * skips[turn % {SHARDS} + 1]) % {SLOTS}),
      lambda p: owner[p + 1] < 0)[1] AS pick FROM t, l WHERE turn < {SLOTS})),
m AS (SELECT slot, ((turn - 1) % {SHARDS})::INTEGER AS shard_no FROM t WHERE slot IS NOT NULL)
SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, d.slot, shard_no, 'shard-' || lpad(shard_no::VARCHAR, 3, '0') AS shard
FROM (SELECT *, {_HASH.format("doc_id::VARCHAR")} % {SLOTS} AS slot FROM documents) d JOIN m ON d.slot = m.slot
"""
