"""Byte-level BPE: length-bucketed padded matrices, one merge a row and round, then decoding."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, mix64, table, texts_of

#: Pieces kept between batches, at most, and bytes of the longest one kept; bounds on a worker's memory, never on results.
CACHE, CACHED = 200_000, 64
#: From this width on a row is a matrix of its own, which merges all sure occurrences of its least pair in a round.
WIDE = 128


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class PairTable:
    """Open-addressing hash table (left id, right id) -> merged rank, probed for whole arrays."""

    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.byte_id = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        keys, vals = [], []
        for tok, rank in ranks.items():
            for cut in range(1, len(tok)):
                a, b = ranks.get(tok[:cut]), ranks.get(tok[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    vals.append(rank)
        keys, vals = np.array(keys, np.int64), np.array(vals, np.int64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int64)
        left = np.arange(len(keys))
        slot = self.slots(keys)
        while len(left):  # all keys claim slots at once; losers probe on
            s = slot[left]
            free = self.keys[s] == -1
            self.keys[s[free]] = keys[left[free]]
            won = free & (self.keys[s] == keys[left])
            self.vals[s[won]] = vals[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) >> np.uint64(20)).view(np.int64) & self.mask

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it cannot merge or one side is padding (below 0)."""
        out = np.full(a.shape, self.NONE, np.int64)
        ok = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        key = (a.ravel()[ok] << 32) | b.ravel()[ok]
        s, flat = self.slots(key), out.ravel()
        while len(ok):
            at = self.keys[s]
            hit = at == key
            flat[ok[hit]] = self.vals[s[hit]]
            on = ~hit & (at != -1)
            ok, key, s = ok[on], key[on], (s[on] + 1) & self.mask
        return out


def merge_rows(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Padded rows of ids (-1 beyond the end) after all merges; each round merges a row's leftmost least pair."""
    out = ids.copy()
    rows = np.arange(len(ids))
    rank = pairs.rank(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.zeros((len(ids), 0), np.int64)
    while len(rows) and rank.shape[1]:
        at = rank.argmin(axis=1)
        best = rank[np.arange(len(rows)), at]
        live = best < pairs.NONE
        out[rows[~live], : ids.shape[1]] = ids[~live]
        out[rows[~live], ids.shape[1] :] = -1
        rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
        if not len(rows):
            break
        n, w = ids.shape
        col = np.arange(w)[None, :]
        # the right half of the pair goes; all after it moves one to the left
        ids = np.where(col <= at[:, None], ids, np.concatenate([ids[:, 1:], np.full((n, 1), -1, np.int64)], axis=1))
        r = np.arange(n)
        ids[r, at] = best
        rank = np.where(col[:, : w - 1] <= at[:, None], rank, np.concatenate([rank[:, 1:], np.full((n, 1), pairs.NONE, np.int64)], axis=1))
        right = np.minimum(at + 1, w - 1)
        after = pairs.rank(ids[r, at], np.where(at + 1 < w, ids[r, right], -1))
        inside = at < w - 1
        rank[r[inside], at[inside]] = after[inside]
        has = at > 0
        rank[r[has], at[has] - 1] = pairs.rank(ids[r[has], at[has] - 1], ids[r[has], at[has]])
        used = int((ids >= 0).sum(axis=1).max())  # compaction: drop columns that no row needs
        if used < w:
            ids, rank = ids[:, :used], rank[:, : max(used - 1, 0)]
    if len(rows):
        out[rows, : ids.shape[1]] = ids
        out[rows, ids.shape[1] :] = -1
    return out


def merge_wide(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """merge_rows() of one wide row, with as many of its next merges in a round as are sure to be the next.

    With r the least rank, the plain way merges the leftmost pair of rank r, then the leftmost one again. Until a merge
    makes a pair of rank r or less, these are the pairs of rank r from the left, without overlap: all others rank above r
    and stay as they are. So a round takes them up to and with the first whose merge makes such a pair, as seen at
    that moment: left of it stands what earlier merges left there, right of it what is not merged yet. Ranks of
    changed pairs alone are looked up again.
    """
    ids = ids.astype(np.int32)
    rank = pairs.rank(ids[:-1].astype(np.int64), ids[1:].astype(np.int64))
    while len(rank):
        best = rank.min()
        if best >= pairs.NONE:
            break
        at = np.flatnonzero(rank == best)
        run = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
        at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
        left = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1).astype(np.int64)
        left[1:][at[1:] == at[:-1] + 2] = best
        right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1).astype(np.int64)
        merged = np.full(len(at), best, np.int64)
        early = np.flatnonzero(np.minimum(pairs.rank(left, merged), pairs.rank(merged, right)) <= best)
        if len(early):
            at = at[: early[0] + 1]
        ids[at] = best
        ids = np.delete(ids, at + 1)
        rank = np.delete(rank, np.minimum(at + 1, len(rank) - 1))
        pos = at - np.arange(len(at))
        near = np.unique(np.concatenate([pos[pos > 0] - 1, pos[pos < len(ids) - 1]]))
        rank = rank[: max(len(ids) - 1, 0)]
        rank[near] = pairs.rank(ids[near].astype(np.int64), ids[near + 1].astype(np.int64))
    return ids


def encode_pieces(pieces: list[bytes], pairs: PairTable) -> list[list[int]]:
    """Token ids of each piece. Pieces that are tokens take their rank at once."""
    out: list[list[int]] = [[]] * len(pieces)
    by: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        whole = pairs.ranks.get(p)
        if whole is not None:
            out[i] = [whole]
        else:
            by.setdefault(max(3, (len(p) - 1).bit_length()), []).append(i)
    for bits, at in by.items():
        if 1 << bits > WIDE:
            for i in at:
                out[i] = merge_wide(pairs.byte_id[np.frombuffer(pieces[i], np.uint8)], pairs).tolist()
            continue
        step = max(1, (1 << 19) >> bits)
        for s in range(0, len(at), step):
            part = at[s : s + step]
            lens = np.array([len(pieces[i]) for i in part])
            m = np.full((len(part), lens.max()), -1, np.int64)
            m[np.arange(m.shape[1])[None, :] < lens[:, None]] = pairs.byte_id[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
            m = merge_rows(m, pairs)
            n = (m >= 0).sum(axis=1).tolist()
            for i, k, row in zip(part, n, m.tolist(), strict=True):
                out[i] = row[:k]
    return out


def decode(ids: list[int], vocab: dict[int, bytes]) -> bytes:
    return b"".join([vocab[i] for i in ids])


def _pieces(pattern, text: str) -> list[bytes]:
    return [m.encode("utf-8", "surrogatepass") for m in pattern.findall(text)]


def _encode(id_cols: list[str], text_col: str, ranks: bytes, pattern: str, digest: bool):
    def run(batches):
        import regex

        pat = regex.compile(pattern)
        pairs = PairTable(load_ranks(ranks))
        vocab = pairs.bytes
        cache: dict[str, tuple] = {}
        for b in batches:
            found = [pat.findall(t) for t in texts_of(b, text_col)]
            if len(cache) > CACHE:
                cache.clear()
            new = list({p for f in found for p in f}.difference(cache))
            for s in range(0, len(new), 50_000):
                part = new[s : s + 50_000]
                for p, ids in zip(part, encode_pieces([p.encode("utf-8", "surrogatepass") for p in part], pairs), strict=True):
                    cache[p] = (",".join(map(str, ids)), len(ids), decode(ids, vocab)) if digest else ids
            wide = [p for p in new if len(p) > CACHED]
            cols = [b.column(c) for c in id_cols]
            if digest:
                got = [[cache[p] for p in f] for f in found]
                yield pa.record_batch(
                    [
                        *cols,
                        pa.array([sum([x[1] for x in g]) for g in got], pa.int64()),
                        pa.array([hashlib.sha256(",".join([x[0] for x in g]).encode()).hexdigest() for g in got], pa.string()),
                        pa.array([hashlib.sha256(b"".join([x[2] for x in g])).hexdigest() for g in got], pa.string()),
                    ],
                    names=[*id_cols, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                ids = [[i for p in f for i in cache[p]] for f in found]
                yield pa.record_batch([*cols, pa.array(ids, pa.list_(pa.int32())), pa.array([decode(i, vocab) for i in ids], pa.binary())], names=[*id_cols, "ids", "decoded"])
            for p in wide:
                del cache[p]

    return run


def read_vocabulary(spark, path: str) -> bytes:
    """The rank file's bytes, read on the driver: a vocabulary has a fixed size of about a megabyte."""
    with open(path, "rb") as f:
        return f.read()


def bpe_encode(docs: DataFrame, ranks: bytes, pattern: str, keep: list[str], text_col: str = "text", digest: bool = False) -> DataFrame:
    """Token ids of whole texts and the bytes they decode to, as the tiktoken library would give them.

    keep: columns carried along. Adds ids array<int> and decoded binary, or with digest=True n_tokens
    long, ids_sha256 (decimal ids joined by commas) and decoded_sha256, which keep wide results off the
    wire. ranks: content of a rank file; pattern: splits a text, each match is encoded alone, and no
    special tokens are used.

    Distinct pieces of a batch that are not in the worker's bounded cache fill padded numpy matrices
    bucketed by length; each round every row merges its leftmost minimum-rank pair, found by one
    hashed lookup of the changed pairs, and finished rows and columns are compacted away. A piece over
    128 bytes is a matrix of one row and takes all its sure next merges in a round (merge_wide), which
    gives what one merge a round gives. No shuffle.

    Null and empty texts: no tokens, hash of nothing. Very long texts: split into pieces like others; a piece of n
    bytes takes time in proportion to n times the distinct ranks that it merges, whatever its repeats.
    Repeated rows, ties and null ids pass through row by row; an empty table gives an empty result.
    Columns outside keep are not read, so they cannot clash.
    """
    bound_batches(docs.sparkSession)
    cols = docs.select(*dict.fromkeys([*keep, text_col]))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return cols.mapInArrow(_encode(keep, text_col, ranks, pattern, digest), f"{kept}, {more}")


def production(spark) -> tuple[bytes, str]:
    import public_tokenizers as p

    return read_vocabulary(spark, p.path("byte_bpe_multi_50k.tiktoken")), p.PATTERN


def op9(spark, sf_dir):
    ranks, pattern = production(spark)
    return bpe_encode(table(spark, sf_dir, "documents"), ranks, pattern, ["doc_id"], digest=True)
