"""LM scoring: deleted interpolation of bigram, unigram and uniform estimates, mixed by context frequency."""

from __future__ import annotations

import io
import pickle
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, bound_batches, cut, cut_partitioned, fold, grouped, hash_spans, mix64, table

#: White space that separates words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Unigram keys are even, bigram keys odd.
END, START = np.uint64(0x5EED0000000000E0), np.uint64(0x5EED0000000000A0)
#: Context-frequency buckets (powers of two) and steps a factor of ten in the held-out table.
BUCKETS, STEPS, SPAN = 40, 12, 20
EM_ROUNDS = 40
#: Tokens scored at a time.
SLICE = 1 << 18


def tokens(texts: list[bytes], hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Unigram keys of the lower-cased words of all texts, an END after each text; the text of each token."""
    keys, docs, base = [], [], 0
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < SpanHasher.CHUNK):
            size += len(texts[to]) + 1
            to += 1
        buf = np.frombuffer(b"\n".join(texts[at:to]) + b"\n", np.uint8)
        ends_of = np.cumsum([len(t) + 1 for t in texts[at:to]])
        blank = BLANK[buf]
        s = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        e = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        doc = np.searchsorted(ends_of, s, "right")
        out = np.full(len(s) + to - at, END, np.uint64)
        out_doc = np.empty(len(out), np.int32)
        words = np.arange(len(s)) + doc
        out[words], out_doc[words] = hash_spans(buf, s, e, hasher) & ~np.uint64(1), doc
        stop = np.bincount(doc, minlength=to - at).cumsum() + np.arange(to - at)
        out_doc[stop] = np.arange(to - at)
        keys.append(out)
        docs.append(out_doc + base)
        base += to - at
        at = to
    return (np.concatenate(keys), np.concatenate(docs)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def ngrams(uni: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context key of each token (START at a text's head) and bigram key."""
    ctx = np.concatenate([[START], uni[:-1]]).astype(np.uint64)
    ctx[np.concatenate([[True], doc[1:] != doc[:-1]])[: len(ctx)]] = START
    return ctx[: len(uni)], mix64(ctx[: len(uni)] * np.uint64(0x9E3779B97F4A7C15) + uni) | np.uint64(1)


def put(x: np.ndarray) -> bytes:
    """Rising keys or counts as byte planes, which compress well."""
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def get(b: bytes, kind) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(n, -1).T).view(kind).ravel()


def _pack():
    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            parts: dict[int, list] = {}
            for row in zip(*(b.column(c).to_pylist() for c in ("batch", "id", "part", "text")), strict=True):
                parts.setdefault(row[0], []).append((row[1], row[2], (row[3] or "").encode("utf-8", "surrogatepass").lower()))
            blobs = [z.compress(pickle.dumps(p, protocol=5)) for p in parts.values()]
            yield pa.record_batch([pa.array(list(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["batch", "docs"])

    return run, "batch int, docs binary"


def unpack(blobs: list[bytes]) -> tuple[list, np.ndarray, list[bytes]]:
    rows = [r for b in blobs for r in pickle.load(io.BytesIO(zstandard.decompress(b)))]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]


def _batch_keys(parts: np.ndarray, texts: list[bytes], hasher: SpanHasher):
    """Keys of all tokens, then bigrams, then one head a text; the text of each token; the fold (3 and more as 3) of each token and text."""
    uni, doc = tokens(texts, hasher)
    fold_ = np.clip(parts, -1, 3).astype(np.int8)
    return np.concatenate([uni, ngrams(uni, doc)[1], np.full(len(parts), START, np.uint64)]), doc, fold_[doc], fold_


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys and how often each is there."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and each key's position there, in 32 bits: np.unique holds two thirds more at its peak."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    keys = keys[new]
    at = np.empty(len(order), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys, at


def batch_counts(parts: np.ndarray, texts: list[bytes], hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of a batch with their counts in training texts and in held-out ones of these."""
    keys, _, part, heads = _batch_keys(parts, texts, hasher)
    of = np.concatenate([part, part, heads])
    some = [runs(np.sort(keys[of == f])) for f in (1, 2)]
    keys.sort()
    keys, train = runs(keys)
    dev = np.zeros_like(train)
    train[np.searchsorted(keys, some[0][0])] -= some[0][1]
    dev[np.searchsorted(keys, some[1][0])] = some[1][1]
    return keys, train, dev


def _ask(n_buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary()), ("train", pa.binary()), ("dev", pa.binary())])
    edges = np.array([(i << 64) // n_buckets for i in range(n_buckets)], np.uint64)

    def run(batches):
        hasher = SpanHasher()
        for (batch,), t in grouped(batches, ["batch"]):
            _, parts, texts = unpack(t.column("docs").to_pylist())
            keys, train, dev = batch_counts(parts, texts, hasher)
            at = np.append(np.searchsorted(keys, edges), len(keys))
            for k in range(n_buckets):
                s, e = at[k], at[k + 1]
                if s < e:
                    yield pa.record_batch(
                        [pa.array([k], pa.int32()), pa.array([batch], pa.int32()), pa.array([put(np.diff(keys[s:e], prepend=np.uint64(0)))]), pa.array([put(train[s:e].astype(np.uint32))]), pa.array([put(dev[s:e].astype(np.uint32))])],
                        schema=schema,
                    )

    return run, "bucket int, batch int, keys binary, train binary, dev binary"


def _answer():
    schema = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("train", pa.binary()), ("dev", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("n_est", pa.int64()), ("v_est", pa.int64())])

    def run(batches):
        for (bucket,), t in grouped(batches, ["bucket"]):
            who = t.column("batch").to_pylist()
            keys = [np.cumsum(get(b, np.uint64), dtype=np.uint64) for b in t.column("keys").to_pylist()]
            size = np.cumsum([len(k) for k in keys])[:-1]
            uniq, at = ranked(np.concatenate(keys))
            del keys
            sums = [np.bincount(at, np.concatenate([get(b, np.uint32) for b in t.column(c).to_pylist()]), len(uniq)).astype(np.int64) for c in ("train", "dev")]
            est = sums[0] - sums[1]
            word = ((uniq & np.uint64(1)) == 0) & (uniq != START)
            # one row a batch asked for, and one (batch -1) with this bucket's share of the totals
            rows = [(-1, bucket, None, None, int(sums[0][word].sum()), int((sums[0][word] > 0).sum()), int(est[word].sum()), int((est[word] > 0).sum()))]
            for b, a in zip(who, np.split(at, size), strict=True):
                rows.append((b, bucket, put(sums[0][a].astype(np.uint64)), put(sums[1][a].astype(np.uint64)), 0, 0, 0, 0))
            for s in range(0, len(rows), 64):
                cols = list(zip(*rows[s : s + 64], strict=True))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run, "batch int, bucket int, train binary, dev binary, n long, v long, n_est long, v_est long"


class Batch:
    """A batch's texts with the counts of each token, bigram and context over all training texts."""

    def __init__(self, docs: pa.Table, counts: pa.Table, hasher: SpanHasher):
        self.ids, self.parts, texts = unpack(docs.column("docs").to_pylist())
        keys, self.doc, self.part, _ = _batch_keys(self.parts, texts, hasher)
        n, size = len(self.doc), len(keys)
        uniq, at = ranked(keys)
        del keys
        counts = counts.sort_by("bucket")
        self.train, self.dev = (np.concatenate([get(b, np.uint64) for b in counts.column(c).to_pylist()] or [np.zeros(0, np.uint64)]).astype(np.int64) for c in ("train", "dev"))
        if len(self.train) != len(uniq):
            raise ValueError(f"counts of {len(self.train)} keys for {len(uniq)}")
        start = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])[:n]
        ctx = np.concatenate([at[:1], at[: max(n - 1, 0)]])[:n]
        ctx[start] = at[size - 1] if size else 0
        self.at = [at[n : 2 * n], ctx, at[:n]]  # bigram, context, token

    def counted(self, of: np.ndarray, which) -> list[np.ndarray]:
        """Counts of bigram, context and token of some tokens: `of` holds those of all keys."""
        return [of[at[which]] for at in self.at]


def parts_of(bigram, context, token, n: int, v: int):
    """Context bucket and the three estimates of each token."""
    seen = context > 0
    b = np.where(seen, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)
    return b, np.where(seen, bigram / np.maximum(context, 1), 0.0), token / max(n, 1), 1.0 / (v + 1)


def _held_out(totals):
    _, _, n, v = totals

    def run(left, right):
        b = Batch(left, right, SpanHasher())
        k, p2, p1, _ = parts_of(*b.counted(b.train - b.dev, np.flatnonzero(b.part == 2)), n, v)
        q2, q1 = (np.where(p > 0, np.minimum(np.rint(-STEPS * np.log10(np.maximum(p, 1e-300))), STEPS * SPAN - 1), STEPS * SPAN).astype(np.int64) for p in (p2, p1))
        code, at = np.unique((k * (STEPS * SPAN + 1) + q2) * (STEPS * SPAN + 1) + q1, return_inverse=True)
        return pa.table({"code": code, "n": np.bincount(at, minlength=len(code)).astype(np.int64), "p2": np.bincount(at, p2, len(code)).astype(float), "p1": np.bincount(at, p1, len(code)).astype(float)})

    return run, "code long, n long, p2 double, p1 double"


def mixture(rows, v: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by EM on held-out counts (bucket, n, p2, p1)."""
    lam = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    lam[0] = [0.0, 0.7, 0.3]
    if len(rows):
        b, n, p2, p1 = (np.array(c) for c in zip(*rows, strict=True))
        b = b.astype(np.int64)
        p = np.stack([p2 / n, p1 / n, np.full(len(n), 1.0 / (v + 1))], axis=1)
        for _ in range(rounds):
            w = lam[b] * p
            w = w / w.sum(axis=1, keepdims=True) * n[:, None]
            got = np.stack([np.bincount(b, w[:, i], BUCKETS) for i in range(3)], axis=1)
            got = got + [1.0, 1.0, 1.0]  # a prior of one count each keeps all weights above zero
            got[0, 0] = 0.0
            seen = np.bincount(b, n, BUCKETS) > 0
            lam[seen] = (got / got.sum(axis=1, keepdims=True))[seen]
        for i in range(2, BUCKETS):  # a bucket without held-out counts takes its neighbour's weights
            if not seen[i]:
                lam[i] = lam[i - 1] if i > 1 else lam[i]
    return lam


def _score(totals, lam: np.ndarray):
    n, v, _, _ = totals

    def run(left, right):
        b = Batch(left, right, SpanHasher())
        p, base, known = np.empty(len(b.doc)), np.empty(len(b.doc)), np.empty(len(b.doc), bool)
        for at in range(0, len(b.doc), SLICE):  # temporary arrays of one slice only
            x = slice(at, at + SLICE)
            counts = b.counted(b.train, x)
            k, p2, p1, p0 = parts_of(*counts, n, v)
            w = lam[k]
            p[x] = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
            base[x] = np.log10((counts[2] + 0.5) / (n + 0.5 * (v + 1)))
            known[x] = counts[2] > 0
        add = lambda x: np.bincount(b.doc, x, len(b.ids))
        return pa.table(
            {
                "id": pa.array(b.ids, pa.int64()), "held_out": pa.array(b.parts == 1), "n_tokens": add(None).astype(np.int64), "n_known": add(known).astype(np.int64),
                "train_tokens": pa.array(np.full(len(b.ids), n, np.int64)), "base_score": add(base), "score": add(p),
            }
        )

    return run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def interpolated_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, partitions: int | None = None) -> DataFrame:
    """log10 probability of every whole text under an interpolated bigram model of the corpus.

    Learns from rows whose crc32(id as text) mod folds is not 1. Of these, remainder 2 gives the
    held-out counts: expectation-maximisation fits, for each power of two of a context's
    frequency, the weights of the bigram, unigram and uniform estimates counted on the other training
    rows; the final estimates count all training rows. Returns doc_id, held_out, n_tokens (words and
    one end), n_known, train_tokens, base_score (add-half unigram) and score.

    Texts are dealt to batches by a hash of the id, as compressed blobs, shuffled once and checkpointed.
    A batch sends its sorted distinct n-gram hashes (64 bits) with counts to key-range buckets; these
    add up and send totals back in the same order, so no n-gram table is ever broadcast and hot
    n-grams cost one entry a batch. What the driver sees is a table of held-out counts by bucket and
    rounded log estimates, at most BUCKETS * (STEPS*SPAN+1)^2 cells at any corpus size, and four totals.
    partitions: batches and buckets, by default the session's shuffle partitions.

    Null or empty text: one end token. Null ids: scored, not learned from. Repeated ids: each row counts
    and is scored. Very long texts: hashed in windows. Empty table: empty result. Extra columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.when(F.col(id_col).isNull(), 1).otherwise(fold(id_col, folds))
    rows = docs.select(F.pmod(F.xxhash64(id_col), F.lit(p)).cast("int").alias("batch"), F.col(id_col).cast("long").alias("id"), part.cast("int").alias("part"), F.col(text_col).cast("string").alias("text"))
    packed = cut_partitioned(rows.mapInArrow(*_pack()).repartition(p, "batch"))
    asked = packed.sortWithinPartitions("batch").mapInArrow(*_ask(p))
    # dealt back to batches once, for both passes
    answers = cut_partitioned(asked.repartition(p, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(*_answer()).repartition(p, "batch"))
    t = answers.where("batch = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n_est", "v_est"))).first()
    totals = tuple(int(x) for x in t)
    counts = answers.where("batch >= 0").select("batch", "bucket", "train", "dev")
    both = packed.groupBy("batch").cogroup(counts.groupBy("batch"))
    run, schema = _held_out(totals)
    table_ = both.applyInArrow(run, schema).groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n", "p2", "p1"))).collect()
    lam = mixture([(r.code // (STEPS * SPAN + 1) ** 2, r.n, r.p2, r.p1) for r in sorted(table_)], totals[3])
    run, schema = _score(totals, lam)
    return both.applyInArrow(run, schema).withColumnRenamed("id", id_col)


def op5(spark, sf_dir):
    return interpolated_scores(table(spark, sf_dir, "documents"))
