"""N-gram Jaccard join: sorted prefix tries of MinHash signatures for candidates, exact verification in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, bound_batches, components, cut, grouped, hash_spans, mix64, table, texts_of

#: Tries in the forest, values of a whole label, wanted recall of links at the threshold, draws that try a label's depth.
TREES, DEPTH, RECALL, DRAWS = 40, 10, 0.999, 64
#: Bytes of an entry: its tree, then two bytes of each value.
ENTRY = 1 + 2 * DEPTH
#: Sorted entries that a task looks at together.
WINDOW = 1 << 16
#: Documents and characters of one side of a verified block.
BLOCK_DOCS, BLOCK_CHARS = 256, 4 << 20


def shingles(text: str, k: int, hasher: SpanHasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; a shorter text is one shingle."""
    buf = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(buf == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf)]])
    k = min(k, len(starts))
    s, e = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(hash_spans(buf, s, e, hasher))


class Forest:
    """Labels of a shingle set, one a tree: one-permutation MinHash with densification; and how deep they must match."""

    def __init__(self, threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.k, self.trees, self.depth, self.threshold, self.recall = trees * depth, trees, depth, threshold, recall
        self.edges = np.array([(i << 64) // self.k for i in range(self.k)], dtype=np.uint64)
        self.donors = rng.integers(0, self.k, (64, self.k))
        self.odd = rng.integers(1, 1 << 62, DRAWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, x: np.ndarray) -> np.ndarray:
        """The least hash of each of k equal ranges, (trees, depth); an empty range borrows from seeded donors, alike for all sets."""
        at = np.searchsorted(x, self.edges)
        v = x[np.minimum(at, len(x) - 1)]
        full = np.append(at[1:], len(x)) > at
        own, missing = full, np.flatnonzero(~full)
        for row in self.donors:
            if not len(missing):
                break
            src = row[missing]
            ok = own[src]
            v[missing[ok]] = v[src[ok]]
            missing = missing[~ok]
        if len(missing):  # very short texts: the next full range, cyclically
            where = np.flatnonzero(own)
            v[missing] = v[where[np.searchsorted(where, missing) % len(where)]]
        return v.reshape(self.trees, self.depth)

    def prefix(self, v: np.ndarray, n: int) -> int:
        """How long a prefix of this set's labels must match: whole labels first, shortened until the target recall is met.

        A partner at the threshold t keeps a share t of the set's values, and a tree finds it when all values of the prefix are
        kept. Labels of d values, u of them distinct, meet with t**u; all trees together must reach the recall. Where
        values stand in several trees (short texts) the trees do not vary freely: then, besides, in each of DRAWS drawn
        partners with exactly that share at least one tree must find it. A set that no other set can match at t keeps whole labels.
        """
        if n / (n + 1) < self.threshold:
            return self.depth
        new = np.ones(v.shape, bool)
        for j in range(1, self.depth):
            new[:, j] = (v[:, :j] != v[:, j, None]).all(axis=1)
        meets = self.threshold ** np.cumsum(new, axis=1)
        deep = np.flatnonzero(1 - np.prod(1 - meets, axis=0) >= self.recall)
        d = int(deep[-1]) + 1 if len(deep) else 1
        values, at = np.unique(v, return_inverse=True)
        if d > 1 and len(values) < self.k:
            drawn = values[:, None] * self.odd
            keep = max(1, int(np.ceil(self.threshold * len(values))))
            kept = drawn <= np.partition(drawn, keep - 1, axis=0)[keep - 1]
            whole = np.logical_and.accumulate(kept[at.reshape(v.shape)][:, :d], axis=1).any(axis=0).all(axis=1)
            deep = np.flatnonzero(whole)
            d = int(deep[-1]) + 1 if len(deep) else 1
        return d

    def entries(self, v: np.ndarray) -> bytes:
        """All labels as entries that sort as the tries do: the tree's number, then 16 bits of each value, high byte first."""
        out = np.empty((self.trees, 1 + 2 * self.depth), np.uint8)
        out[:, 0] = np.arange(self.trees)
        short = (mix64(v) >> np.uint64(48)).astype(np.uint16)
        out[:, 1::2], out[:, 2::2] = short >> 8, short & 255
        return out.tobytes()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_hash(x: np.ndarray) -> int:
    return int(_signed(mix64(x).sum(keepdims=True))[0])


def _sign(id_col: str, text_col: str, k: int, threshold: float):
    schema = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("depth", pa.int32()), ("entries", pa.binary())])

    def run(batches):
        hasher, forest = SpanHasher(), Forest(threshold)
        for b in batches:
            rows = []
            for i, t in zip(b.column(id_col).to_pylist(), texts_of(b, text_col), strict=True):
                x = shingles(t, k, hasher)
                if len(x):
                    v = forest.signature(x)
                    h1, h2 = set_hash(x), set_hash(x ^ np.uint64(0x9E3779B97F4A7C15))
                    rows.append((i, h1, h2, len(x), len(t), forest.prefix(v, len(x)), forest.entries(v)))
                else:
                    rows.append((i, 0, 0, 0, len(t), DEPTH, b""))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run, "id long, h1 long, h2 long, n long, chars long, depth int, entries binary"


def shared(entries: np.ndarray) -> np.ndarray:
    """How many values each entry shares with the one before it, from the front; -1 in another tree. Rows of ENTRY bytes."""
    same = entries[1:] == entries[:-1]
    pairs = same[:, 1::2] & same[:, 2::2]
    return np.where(same[:, 0], np.logical_and.accumulate(pairs, axis=1).sum(axis=1), -1)


def trie_links(entries: np.ndarray, ids: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, least id of the node) among sorted entries. A node of prefix length d links all its members if one of them
    needs no more than d shared values; so it does if it reaches the first or last entry, beyond which others may need it."""
    run, done = shared(entries), np.zeros(len(ids), bool)
    out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    for d in np.unique(depth):  # shortest first: a node holds all nodes below it
        cut_at = np.concatenate([[0], np.flatnonzero(run < d) + 1])
        size = np.diff(np.append(cut_at, len(ids)))
        wanted = np.logical_or.reduceat(depth == d, cut_at)
        wanted[[0, -1]] = True
        wanted &= size > 1
        if wanted.any():
            lead = np.repeat(np.minimum.reduceat(ids, cut_at), size)
            at = np.flatnonzero(np.repeat(wanted, size) & ~done & (ids != lead))
            out.append(np.stack([ids[at], lead[at]], axis=1))
            done |= np.repeat(wanted, size)
    out = np.concatenate(out)
    return out[:, 0], out[:, 1]


def _walk(batches):
    """Links of the nodes in a range of the sorted tries, and its first and last entry, window by window."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("part", pa.int32()), ("entry", pa.binary())])
    held: list = []

    def look(final: bool):
        nonlocal held
        e, i, d = (np.concatenate(c) for c in zip(*held, strict=True))
        held = [] if final else [(e[-1:], i[-1:], d[-1:])]
        u, v = trie_links(e, i, d)
        nothing = pa.nulls(len(u))
        return pa.record_batch([pa.array(u), pa.array(v), nothing.cast(pa.int32()), nothing.cast(pa.binary())], schema=schema)

    first = last = None
    for b in batches:
        if not b.num_rows:
            continue
        entries = np.frombuffer(b"".join(b.column("entry").to_pylist()), np.uint8).reshape(-1, ENTRY)
        ids, part = b.column("id").to_numpy(), b.column("part")[0].as_py()
        first = first or (int(ids[0]), part, entries[0].tobytes())
        last = (int(ids[-1]), part, entries[-1].tobytes())
        held.append((entries, ids, b.column("depth").to_numpy()))
        if sum(len(h[1]) for h in held) >= WINDOW:
            yield look(False)
    if first:
        yield look(True)
        ends = zip(first, last, strict=True)
        ids, parts, entries = ends
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([0, 1], pa.int64()), pa.array(parts, pa.int32()), pa.array(entries, pa.binary())], schema=schema)


def trie_candidates(reps: DataFrame) -> DataFrame:
    """Candidate links (u, v) of rows (id, depth, entries): the tries of all trees as one globally sorted table of entries.

    Entries are sorted by range, with the id as the last key, so a node that a third of all texts share spreads over many tasks. In
    sorted order the members of a trie node are neighbours, and one pass finds for each entry the longest prefix that it
    shares with others. Only the two ends of each task's range meet on the driver, to link nodes across a border: two entries a
    partition, whatever the data.
    """
    spark = reps.sparkSession
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda i: F.substring(F.col("entries"), i * ENTRY + 1, F.lit(ENTRY))))
    rows = reps.select("id", "depth", each.alias("entry"))
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(p, "entry", "id").sortWithinPartitions("entry", "id").withColumn("part", F.spark_partition_id())
    found = cut(rows.mapInArrow(_walk, "u long, v long, part int, entry binary"))
    ends = sorted(found.where("entry is not null").select("part", "v", "u", "entry").collect())
    least = reps.agg(F.min("depth")).first()[0]
    links = []
    for (_, e, a, x), (_, f, b, y) in zip(ends[1::2], ends[2::2], strict=False):
        run = shared(np.frombuffer(bytes(x) + bytes(y), np.uint8).reshape(2, ENTRY))[0]
        if run >= least and a != b:
            links.append((a, b))
    edges = found.where("entry is null").select("u", "v")
    return edges.unionByName(spark.createDataFrame(links, "u long, v long")) if links else edges


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of pairs with Jaccard >= threshold, exact; one product a slice of shared shingles."""
    na, nb = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    va, vb = np.concatenate(sets_a), np.concatenate(sets_b)
    ia, ib = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    both = np.intersect1d(va, vb) if sets_a is not sets_b else np.unique(va)[np.unique(va, return_counts=True)[1] > 1]
    inter = np.zeros((len(na), len(nb)), np.float32)
    if len(both):
        pa_, pb_ = np.searchsorted(both, va), np.searchsorted(both, vb)
        oka, okb = both[np.minimum(pa_, len(both) - 1)] == va, both[np.minimum(pb_, len(both) - 1)] == vb
        pa_, ia, pb_, ib = pa_[oka], ia[oka], pb_[okb], ib[okb]
        for at in range(0, len(both), 8192):
            w = min(8192, len(both) - at)
            xa, xb = np.zeros((len(na), w), np.float32), np.zeros((len(nb), w), np.float32)
            m = (pa_ >= at) & (pa_ < at + w)
            xa[ia[m], pa_[m] - at] = 1
            m = (pb_ >= at) & (pb_ < at + w)
            xb[ib[m], pb_[m] - at] = 1
            inter += xa @ xb.T
    inter = np.rint(inter.astype(np.float64))
    if sets_a is sets_b:
        np.fill_diagonal(inter, 0)
    union = na[:, None] + nb[None, :] - inter
    return (inter / np.maximum(union, 1) >= threshold) & (inter > 0)


def roots(m: np.ndarray) -> np.ndarray:
    """The least index that each node of a symmetric boolean matrix reaches."""
    lab = np.arange(len(m))
    while True:
        # in slices: the matrix of labels would take eight times the room of m
        new = np.concatenate([np.where(m[s : s + 256], lab[None, :], len(m)).min(axis=1, initial=len(m)) for s in range(0, len(m), 256)] or [lab])
        new = np.minimum(lab, new)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _verify(k: int, threshold: float):
    schema = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches):
        hasher = SpanHasher()
        for (_, i, j), t in grouped(batches, ["comp", "bi", "bj"]):
            t = t.sort_by("id")
            sets = [shingles(x or "", k, hasher) for x in t.column("text").to_pylist()]
            # a repeated id stands for the class that it was counted in, once
            own = {i: p for p, (i, h) in enumerate(zip(t.column("id").to_pylist(), t.column("h1").to_pylist(), strict=True)) if len(sets[p]) and set_hash(sets[p]) == h}
            at = list(own.values())
            sets = [sets[p] for p in at]
            ids, block, weight = (t.column(c).to_numpy()[at] for c in ("id", "block", "copies"))
            if i == j:
                m = linked(sets, sets, threshold)
            else:
                a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
                m = np.zeros((len(ids), len(ids)), bool)
                if len(a) and len(b):
                    part = linked([sets[x] for x in a], [sets[x] for x in b], threshold)
                    m[np.ix_(a, b)] = part
                    m[np.ix_(b, a)] = part.T
            yield pa.record_batch([pa.array(ids), pa.array(ids[roots(m)]), pa.array(m.astype(np.int64) @ weight)], schema=schema)

    return run, "id long, root long, links long"


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Links between documents whose sets of k-word shingles have a Jaccard similarity >= threshold.

    Returns one row a document: doc_id, class_id (smallest id with the same shingle set), n_links
    (other documents linked directly, copies included), component_id (smallest id reachable by
    links) and kept (doc_id = component_id). Column names follow id_col.

    1. Documents with equal shingle sets become one class by a map-side combined aggregate.
    2. A class representative enters TREES prefix tries of MinHash labels, kept as one sorted table (trie_candidates). It is
       matched by whole labels first; the prefix is shortened, text by text, until its expected recall at the
       threshold is RECALL (Forest.prefix). Members of a node link to its smallest id (a star), never pair by pair.
    3. Connected candidates form a cell. Its members are dealt to blocks of bounded size and each pair of
       blocks is one task unit, which counts exact intersections with matrix products and returns
       one row a member: its verified links there and its root. No pair is emitted, none is dropped.
    4. The roots' components are the groups; links add up by copies.

    Words: str.split() of the lower-cased text. A text of fewer than k words is one shingle, so texts with
    no word (null, empty, blank) are copies of each other and of nothing else. Rows that
    repeat an id: the id is counted once (its smallest class). Null ids: dropped from the result,
    as they cannot be named. Empty table: empty result. Other columns of docs are not read.
    Cost: exact link counts are quadratic in the size of a candidate cell, split over block pairs.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _sign("id", "text", k, threshold)
    sig = cut(base.mapInArrow(run, schema))
    rows = sig.select("id", "h1", "h2", "n").groupBy("id").agg(F.min(F.struct("h1", "h2", "n")).alias("c")).select("id", "c.*")
    classes = rows.groupBy("h1", "h2", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    reps = sig.where("n > 0").join(classes, ["h1", "h2", "n"]).where("id = class_id").select("id", "copies", "chars", "h1", "depth", "entries").dropDuplicates(["id"])
    reps = cut(reps)
    cells = components(trie_candidates(reps))
    members = cut(cells.join(reps.select("id", "copies", "chars", "h1"), "id"))
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_DOCS)), F.ceil(F.sum("chars") / F.lit(BLOCK_CHARS))).cast("int").alias("blocks"))
    dealt = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    texts = base.join(dealt.select("id", "comp", "copies", "block", "blocks", "h1"), "id")
    pairs = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "comp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "id", "block", "copies", "h1", "text"
    )
    run, schema = _verify(k, threshold)
    found = cut(pairs.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj").mapInArrow(run, schema))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    reps = reps.select(F.col("id").alias("class_id")).join(links.withColumnRenamed("id", "class_id"), "class_id", "left").join(groups.withColumnRenamed("id", "class_id"), "class_id", "left")
    by_class = classes.join(reps, "class_id", "left")
    return rows.join(by_class, ["h1", "h2", "n"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("comp", "class_id", "id").alias("component_id"),
        (F.col("id") == F.coalesce("comp", "class_id", "id")).alias("kept"),
    )


def op2(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))
