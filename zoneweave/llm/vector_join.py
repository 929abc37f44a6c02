"""Embedding near-dedup: exact metric range join over pivot cells with boundary replication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, cut, grouped, table
from .ngram_join import roots

#: Most pivots, the bounded sample they are picked from, vectors on one side of a block, rows of it compared at a time.
PIVOTS, SAMPLE, BLOCK, SLICE = 256, 2048, 2048, 256


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 0.5 to 1: exact, and squares stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def packed(x: np.ndarray) -> bytes:
    """A vector's bytes: single precision where that holds it exactly."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return short.tobytes() if (short == x).all() else x.tobytes()


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in rows])


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of unit vectors: well-spread pivots, fixed by the sample's order."""
    if not len(sample):
        return sample
    at, near = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(at) < min(n, len(sample)) and near.max() > 1e-6:
        at.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[at[-1]], axis=1))
    return sample[at]


def cells_of(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector and a matrix of the cells that may hold a partner within r.

    A partner y of x in cell q has d(y, q) <= d(y, p), so by the triangle inequality
    d(x, q) <= d(x, p) + 2r. In Euclidean space x lies at (d(x,q)^2 - d(x,p)^2) / 2d(p,q) from the
    plane between the pivots, and that must be at most r too, the tighter bound.
    """
    d = np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))
    home = d.argmin(axis=1)
    own = d[np.arange(len(x)), home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[home]
    plane = (d**2 - own**2) / (2 * np.maximum(apart, 1e-12))
    reach = (d - own <= 2 * r + 1e-7) & (plane <= r + 1e-7)
    reach[np.arange(len(x)), home] = True
    return home, reach


def _assign(pivots: np.ndarray, r: float):
    schema = pa.schema([("id", pa.int64()), ("cell", pa.string()), ("home", pa.bool_()), ("copies", pa.int64()), ("vec", pa.binary())])

    def run(batches):
        for b in batches:
            ids, label, copies = (b.column(c).to_pylist() for c in ("id", "label", "copies"))
            vecs = [np.asarray(v, np.float64) for v in b.column("vec").to_pylist()]
            out = []
            for dim in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == dim]
                x = np.stack([vecs[i] for i in at])
                if len(pivots) and dim == pivots.shape[1]:
                    home, reach = cells_of(unit(x), pivots, r)
                else:  # another dimension than the sample's: one cell
                    home, reach = np.zeros(len(at), int), np.ones((len(at), 1), bool)
                for k, i in enumerate(at):
                    raw = packed(vecs[i])
                    out += [(ids[i], f"{label[i]}/{dim}/{q}", q == home[k], copies[i], raw) for q in np.flatnonzero(reach[k]).tolist()]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run, "id long, cell string, home boolean, copies long, vec binary"


def _compare(threshold: float):
    schema = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches):
        for (cell, _, _), t in grouped(batches, ["cell", "i", "j"]):
            side, ids, copies = (t.column(c).to_numpy() for c in ("side", "id", "copies"))
            a, b = np.flatnonzero(side), np.flatnonzero(~side)
            if not len(a) or not len(b):
                continue
            x = scaled(unpacked(t.column("vec").to_pylist(), int(cell.split("/")[-2])))
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            both, at = np.unique(ids, return_inverse=True)
            full, count = np.zeros((len(both), len(both)), bool), np.zeros(len(both), np.int64)
            xb, nb = x[b].T, norm[b][None, :]
            for s in range(0, len(a), SLICE):
                own = a[s : s + SLICE]
                m = (x[own] @ xb) / (norm[own][:, None] * nb) >= threshold
                m &= ids[own][:, None] != ids[b][None, :]
                count[at[own]] = m.astype(np.int64) @ copies[b]
                p, q = np.nonzero(m)
                full[at[own[p]], at[b[q]]] = True
            full |= full.T
            hit = full.any(axis=1)
            yield pa.record_batch([pa.array(both[hit]), pa.array(both[roots(full)][hit]), pa.array(count[hit])], schema=schema)

    return run, "id long, root long, links long"


def cosine_join(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, pivots: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """Exact links between vectors of an equal label with a cosine similarity >= threshold.

    Returns one row an id: vec_id, n_links (long; copies count), component_id (smallest id reachable)
    and kept (vec_id = component_id); names follow id_col. On the unit sphere the cosine bound is the
    Euclidean radius r = sqrt(2 - 2*threshold).

    Equal vectors of a label become one class first. Pivots from a sample of at most `sample` vectors partition the
    sphere: `pivots` of them, by default one for each BLOCK vectors of the largest label and PIVOTS at most (these
    bound what reaches the driver; they steer cost only, never results). A vector goes to its nearest pivot's cell and as a replica to each cell that the
    triangle inequality cannot rule out. Cells join independently: home vectors against all in the
    cell, dealt to pairs of blocks of about BLOCK vectors, so a hot cell spreads over many tasks. A
    block returns one row a vector: its links and its root there, never pairs.

    Null vectors, zero vectors, those with a null or non-finite component and those without a label
    link with nothing and are their own component. Any finite magnitude compares: vectors are scaled by a power of two
    first, and travel in single precision where that is exact. Vectors of different lengths never link. Rows that
    repeat an id count once (the smallest hash class); null ids are dropped. Empty table: empty result.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    v = F.col("vec")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    ok = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    hashed = rows.select("id", "label", "ok", F.when(F.col("ok"), F.xxhash64("vec")).alias("h1"), F.when(F.col("ok"), F.xxhash64(F.lit("v"), "vec")).alias("h2"))
    ids = hashed.groupBy("id").agg(F.min(F.struct(~F.col("ok"), "label", "h1", "h2")).alias("c")).select("id", "c.label", "c.h1", "c.h2")
    classes = ids.where("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    named = rows.where("ok").withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit("v"), "vec"))
    reps = named.join(classes, ["label", "h1", "h2"]).where("id = class_id").dropDuplicates(["id"]).select("id", "label", "copies", "vec")
    reps = cut(reps)
    if pivots is None:
        largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        pivots = min(PIVOTS, -(-largest // BLOCK))
    picked = [np.asarray(x[0]) for x in reps.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()]
    dim = max({len(x) for x in picked}, key=[len(x) for x in picked].count, default=0)
    p = choose_pivots(unit(np.stack([x for x in picked if len(x) == dim])), pivots) if picked else np.zeros((0, 0))
    run, schema = _assign(p, r)
    dealt = cut(reps.mapInArrow(run, schema))
    sizes = dealt.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("ni"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nj"))
    dealt = dealt.join(sizes.where("ni > 0"), "cell")
    side = lambda rows, at, of, n, s: rows.select("cell", F.pmod(F.xxhash64("id"), F.col(of)).cast("int").alias(at), F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(f"o{at}"), F.lit(s).alias("side"), "id", "copies", "vec")
    homes = side(dealt.where("home"), "i", "ni", "nj", True).withColumnRenamed("oi", "j")
    others = side(dealt, "j", "nj", "ni", False).withColumnRenamed("oj", "i")
    run, schema = _compare(threshold)
    units = homes.unionByName(others).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = cut(units.mapInArrow(run, schema))
    links = found.groupBy(F.col("id").alias("class_id")).agg(F.sum("links").alias("links"))
    groups = components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "class_id")
    by_class = classes.join(links, "class_id", "left").join(groups, "class_id", "left")
    return ids.join(by_class, ["label", "h1", "h2"], "left").select(
        F.col("id").alias(id_col),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("comp", "class_id", "id").alias("component_id"),
        (F.col("id") == F.coalesce("comp", "class_id", "id")).alias("kept"),
    )


def op8(spark, sf_dir):
    return cosine_join(table(spark, sf_dir, "embeddings"))
