"""Shared pieces of the training-data operators: hashing kernels, checkpoints, components."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to Python: bounds a worker's memory whatever the text length.
ARROW_BATCH_BYTES = 4 << 20

M64 = (1 << 64) - 1


def bound_batches(spark: SparkSession) -> None:
    """Cap Arrow batches by bytes, so that long rows cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. A temporary one serves in local mode only: elsewhere executors cannot read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="zoneweave-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def salted_join(rows: DataFrame, side: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Equi-join of many rows with one row a key, where a key may hold a third of the rows.

    Rows of a key are dealt to `salts` tasks by a hash of `by`; the side is repeated for each. The side's own
    aggregate no longer shares the join's exchange, so adaptive execution can split what is still too large.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    each = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a merge join: the repeated side would look small once compressed and then fill the driver as a broadcast
    return dealt.join(each.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def cut_partitioned(df: DataFrame) -> DataFrame:
    """cut() that keeps the known partitioning, so that later steps need no exchange of these rows.

    A plan under adaptive execution reports no partitioning to its checkpoint; a repartition by number
    has nothing to adapt, so this one action runs without it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return cut(df.select("*"))
    finally:
        conf.set(key, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, for tables that are written once and read back."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as remainder -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string")), F.lit(n)), F.lit(-1)).cast("int")


def ascii_lower(c):
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """Hashes of byte spans of a buffer from one prefix sum: equal bytes, equal hashes.

    A span [s, e) hashes to sum(T[b_i] * P**(i-s)) mod 2**64 with a random table T and odd P,
    then mixed. Powers are kept up to the longest buffer seen, so callers cut buffers at CHUNK bytes.
    """

    CHUNK = 1 << 20

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.p = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
        self.inv = pow(self.p, -1, 1 << 64)
        self.pow = np.ones(1, np.uint64)
        self.ipow = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.pow) < n:
            k = len(self.pow)
            self.pow = np.concatenate([self.pow, self.pow * np.uint64(pow(self.p, k, 1 << 64))])
            self.ipow = np.concatenate([self.ipow, self.ipow * np.uint64(pow(self.inv, k, 1 << 64))])

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.pow[: len(buf)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix64((prefix[e] - prefix[s]) * self.ipow[s])


def hash_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray, hasher: SpanHasher) -> np.ndarray:
    """Hashes of spans in rising order, over windows of the buffer; a span beyond a window by blake2b."""
    parts, at = [], 0
    while at < len(s):
        to = int(np.searchsorted(e, s[at] + hasher.CHUNK, "right"))
        if to <= at:
            digest = hashlib.blake2b(buf[s[at] : e[at]].tobytes(), digest_size=8).digest()
            parts.append(np.frombuffer(digest, np.uint64))
            at += 1
            continue
        pre = hasher.prefix(buf[s[at] : e[to - 1]])
        parts.append(hasher.spans(pre, s[at:to] - s[at], e[at:to] - s[at]))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of equal keys in batches sorted by these keys, each as one table."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[s : s + 1].tolist()[0] for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(s, e - s))
    if held:
        yield now, pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v), long columns: one row (id, comp) per vertex with an edge.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each is a grouped minimum
    with map-side combining and a join, never a group gathered in one task. Every round is
    checkpointed, and the loop ends when a round leaves the edge set as it was.
    """
    e = cut(edges.where("u is not null and v is not null and u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct())
    seen = None
    while True:
        sym = e.unionByName(e.selectExpr("v as u", "u as v"))
        m = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.where("v > u").join(m, "u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u")
        e = cut(small.selectExpr("v as u", "m as v").where("u <> v").unionByName(small.selectExpr("u", "m as v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.selectExpr("u as id", "v as comp").unionByName(e.selectExpr("v as id", "v as comp").distinct())
