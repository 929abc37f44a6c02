"""Toxicity: a generative label model over lexicon and pattern voters, then a linear classifier on its posteriors."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import SpanHasher, bound_batches, cut, fold, hash_spans, mix64, table, texts_of

#: Word lists, one lexicon voter each.
LEXICONS = {
    "en_mind": ("dumb", "fool", "idiot", "imbecile", "moron", "stupid"),
    "en_contempt": ("clown", "disgusting", "jerk", "loser", "pathetic", "worthless"),
    "en_dehumanising": ("filth", "parasite", "scum", "subhuman", "trash", "vermin"),
    "en_profane": ("asshole", "bastard", "bitch", "bullshit", "crap", "fuck", "shit"),
    "de_insult": ("abschaum", "arschloch", "dummkopf", "idiotin", "schwachkopf", "trottel", "versager"),
    "fr_insult": ("abruti", "connard", "crétin", "débile", "imbécile", "ordure", "salaud"),
    "es_insult": ("basura", "cabrón", "escoria", "estúpido", "gilipollas", "idiota", "imbécil"),
}
#: One pattern voter each, besides shouting.
PATTERNS = {
    "exclaims": re.compile(r"!{3}"),
    "masks": re.compile(r"(?<![^\W_])[^\W\d_]\*{2,}[^\W\d_]?(?![^\W_])"),
    "stretches": re.compile(r"([^\W\d_])\1{3}"),
    "addresses": re.compile(r"(?i)\byou (?:are an?|absolute|complete|total|utter) "),
    "attacks": re.compile(r"(?i)\b(?:shut up|go away and|get lost|hate you|halt's maul|ferme-la|cállate)\b"),
}
#: Labelled rows a class that the classifier is fitted on, at most; candidate features that reach the driver, most evidence
#: first; voters induced from the labelled rows; weights kept; ranges of a set's sketch; draws of a lone voter.
PER_CLASS, CANDIDATES, INDUCED, KEPT, SKETCH, DRAWS = 2000, 4096, 96, 1024, 64, 3
PREFIXES = (4, 5, 6, 7, 8, 9)
THRESHOLD = 0.7
#: Standard errors from none that a feature's log odds need; of a lexicon word never seen, the weight where none was fitted.
SURE, UNFITTED = 2.5, 6.0

_LETTER = np.ones(256, bool)
_LETTER[:128] = [chr(i).isalnum() for i in range(128)]


def _id(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(1)).astype(np.int64)


def features(texts: list[str], hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """(id, text) of every word, lower-cased, and of its heads of PREFIXES bytes; repeats included."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    gap = ~_LETTER[buf]
    s = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    e = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), s, "right")
    out, at = [_id(hash_spans(buf, s, e, hasher) * np.uint64(0x9E3779B97F4A7C15))], [doc]
    for n in PREFIXES:
        m = e - s >= n
        out.append(_id(hash_spans(buf, s[m], s[m] + n, hasher)))
        at.append(doc[m])
    return np.concatenate(out), np.concatenate(at)


def word_ids(words, hasher: SpanHasher) -> np.ndarray:
    """Ids of whole words."""
    return features(list(words), hasher)[0][: len(words)]


def parts(texts: list[str], size: int = 1 << 19):
    """Slices of a list of texts with about `size` characters each."""
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) < size):
            n += len(texts[to])
            to += 1
        yield at, to
        at = to


def shouts(text: str) -> bool:
    """More than half of all letters are capitals."""
    letters = sum(map(str.isalpha, text))
    return letters > 0 and sum(map(str.isupper, text)) > 0.5 * letters


def voters_of(text: str, ids: np.ndarray, lexicons: list[np.ndarray]) -> int:
    """Bits of the lexicon voters, then shouting, then the pattern voters that fire for a text and its feature ids."""
    fires = [np.isin(x, ids, assume_unique=True).any() for x in lexicons]
    fires += [shouts(text), *(p.search(text) is not None for p in PATTERNS.values())]
    return sum(1 << i for i, f in enumerate(fires) if f)


N_VOTERS = len(LEXICONS) + 1 + len(PATTERNS)


@dataclass
class Model:
    """Weights of feature ids and the intercept of the linear classifier."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self):
        """A function from ids to places in the weights, -1 for others: a small table rules most ids out first."""
        order = np.argsort(self.ids)
        ids, few = self.ids[order], np.zeros(1 << 16, bool)
        few[ids >> 47] = True

        def places(x: np.ndarray) -> np.ndarray:
            out = np.full(len(x), -1)
            if not len(ids):
                return out
            m = np.flatnonzero(few[x >> 47])
            at = np.minimum(np.searchsorted(ids, x[m]), len(ids) - 1)
            out[m] = np.where(ids[at] == x[m], order[at], -1)
            return out

        return places


def kinds_of(votes: np.ndarray, least: float = 0.15) -> np.ndarray:
    """A kind for each voter: voters whose votes correlate with at least `least` are of one kind, and so on along the chain."""
    x = votes - votes.mean(axis=0)
    x = x / (np.sqrt((x**2).sum(axis=0)) + 1e-9)
    near, lab = x.T @ x >= least, np.arange(votes.shape[1])
    while True:
        new = np.minimum(lab, np.where(near, lab[None, :], len(lab)).min(axis=1, initial=len(lab)))
        new = new[new]
        if (new == lab).all():
            return np.unique(lab, return_inverse=True)[1]
        lab = new


def label_model(votes: np.ndarray, prior: float, typed: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of label 1 from voters that fire (1) or not (0), and each voter's firing rate (clean, then each kind).

    Label 1 has several kinds (a voter of one language is silent on another's texts): the correlations of the `typed` voters
    tell which voters belong to a kind. EM over clean and these kinds estimates every voter's firing rates; no label takes part
    but for the share `prior` of label 1. It starts from the kind with most votes. Correlated voters share their
    say: a voter's log ratio is divided by one plus its positive residual correlations within the classes.
    """
    n, k = votes.shape
    x = votes[:, typed]
    if not x.shape[1]:
        return np.full(n, prior), np.full((1, k), prior)
    kind = kinds_of(x)
    sums = np.stack([x[:, kind == g].sum(axis=1) for g in range(kind.max() + 1)], axis=1)
    fires = np.flatnonzero(sums.max(axis=1) > 0)
    q = np.full((n, sums.shape[1] + 1), 0.1 / sums.shape[1])
    q[:, 0] = 0.9
    q[fires, 0] = 0.3
    q[fires, 1 + sums[fires].argmax(axis=1)] = 0.6
    q = q / q.sum(axis=1, keepdims=True)
    say = np.ones(k)
    for i in range(rounds):
        mass = q.sum(axis=0)
        rate = (q.T @ votes + 0.1) / (mass[:, None] + 1.0)
        if i in (2, rounds // 2):
            rest = votes - q @ rate
            sd = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            corr = (rest.T @ rest) / n / np.outer(sd, sd)
            np.fill_diagonal(corr, 0)
            say = 1 / (1 + np.where(corr > 0.05, corr, 0).sum(axis=1))
        share = np.append(1 - prior, prior * (mass[1:] + 1) / (mass[1:] + 1).sum())
        z = np.log(share) + (votes * say) @ np.log(rate).T + ((1 - votes) * say) @ np.log1p(-rate).T
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q = q / q.sum(axis=1, keepdims=True)
    return 1 - q[:, 0], rate


def evidence(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of features between soft classes, and how many standard errors they are from none."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return odds, odds / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def sketch(ids: np.ndarray) -> np.ndarray:
    """The least mixed id of each of SKETCH equal ranges, 0 for an empty one: equal shares estimate the Jaccard similarity."""
    h = np.sort(mix64(ids.view(np.uint64)))
    at = np.searchsorted(h, np.array([(i << 64) // SKETCH for i in range(SKETCH)], np.uint64))
    full = np.append(at[1:], len(h)) > at
    out = np.zeros(SKETCH, np.uint32)
    out[full] = (h[at[full]] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    return out


def apart(sketches: np.ndarray, near: float = 0.5) -> np.ndarray:
    """Indexes of sketches, each unlike all kept before it: a copy of a text must not count as more evidence.

    Each is compared with every one kept so far, in one matrix step; at most 2 * PER_CLASS come here.
    """
    kept = np.zeros_like(sketches)
    at: list[int] = []
    for i, x in enumerate(sketches):
        full = kept[: len(at)]
        either = ((full != 0) | (x != 0)).sum(axis=1)
        same = ((full == x) & (x != 0)).sum(axis=1)
        if (same >= near * np.maximum(either, 1)).any() and (x != 0).any() or not (x != 0).any() and any(not full[j].any() for j in range(len(at))):
            continue
        kept[len(at)] = x
        at.append(i)
    return np.array(at, int)


def lexicon_only(hasher: SpanHasher) -> Model:
    ids = np.unique(word_ids([w for words in LEXICONS.values() for w in words], hasher))
    return Model(ids, np.full(len(ids), UNFITTED), -4.0)


def fit(names: np.ndarray, doc: np.ndarray, feat: np.ndarray, bits: np.ndarray, gold: np.ndarray, hasher: SpanHasher) -> Model:
    """Label model and classifier. names: candidate feature ids; (doc, feat): which row has which; bits: voters_of() a row.

    Gold labels choose the induced voters (at most INDUCED, by evidence) and give the class prior; the label model itself sees votes
    only. The classifier keeps at most KEPT words with most evidence under the posteriors; its weights are fitted, and a
    lexicon word that no training row holds takes the median weight of those that do. Where no word has evidence
    enough, the lexicons alone decide.
    """
    n, size = len(gold), len(names)
    count = lambda y: np.bincount(feat, y[doc], size)
    odds, z = evidence(count(gold.astype(float)), count(1.0 - gold), gold.sum(), (1 - gold).sum())
    order = np.argsort(-z, kind="stable")
    order = order[(z[order] > 3) & (odds[order] * (1 - 1.25 / np.maximum(z[order], 1e-9)) > 2)]
    place = np.full(size, -1)
    place[order] = np.arange(len(order))
    hit = place[feat] >= 0
    has = np.zeros((n, len(order)), np.float32)
    has[doc[hit], place[feat[hit]]] = 1
    # a voter that says what an earlier one says (a word and its heads) is none of its own
    unit, own = has - has.mean(axis=0), []
    unit = unit / (np.sqrt((unit**2).sum(axis=0)) + 1e-9)
    for j in range(len(order)):
        if len(own) < INDUCED and not (own and (unit[:, own].T @ unit[:, j]).max() >= 0.8):
            own.append(j)
    top = order[own]
    votes = np.concatenate([((bits[:, None] >> np.arange(N_VOTERS)) & 1).astype(float), has[:, own]], axis=1)
    typed = np.ones(votes.shape[1], bool)
    typed[len(LEXICONS) : N_VOTERS] = False
    fired = votes.any(axis=0)
    post, _ = label_model(votes[:, fired], float(np.clip(gold.mean(), 0.01, 0.5)), typed[fired])
    # the classifier: presence of the features with most evidence under the posteriors
    odds, z = evidence(count(post), count(1 - post), post.sum(), (1 - post).sum())
    # for label 1 only: the absence of insults, not the presence of other words, makes a text clean
    strong = np.argsort(-z, kind="stable")[:KEPT]
    sure = odds[strong] * (1 - 1.25 / np.maximum(z[strong], 1e-9))  # log odds less 1.25 standard errors
    strong, sure = strong[(z[strong] > SURE) & (sure > 2)], sure[(z[strong] > SURE) & (sure > 2)]
    if not len(strong):  # too few rows for evidence on any word
        return lexicon_only(hasher)
    place[:] = -1
    place[strong] = np.arange(len(strong))
    voters = place[top][place[top] >= 0]
    hit = place[feat] >= 0
    x = np.zeros((n, len(strong)), np.float32)
    x[doc[hit], place[feat[hit]]] = 1
    # start: what is sure of each feature's log odds, shared among features that fire together
    rest = x - np.outer(post, post @ x / max(post.sum(), 1e-9)).astype(np.float32) - np.outer(1 - post, (1 - post) @ x / max((1 - post).sum(), 1e-9)).astype(np.float32)
    sd = np.sqrt((rest**2).mean(axis=0)) + 1e-6
    corr = (rest.T @ rest) / n / np.outer(sd, sd)
    corr[corr < 0.2] = 0
    start = sure / np.maximum(corr.sum(axis=1), 1)
    # texts of label 1 enter DRAWS more times with one voter each and what fires with it: one insult is enough
    rng, toxic = np.random.default_rng(5), np.flatnonzero(post > 0.5)
    y = post
    if len(voters) and len(toxic):
        one = toxic[x[np.ix_(toxic, voters)].any(axis=1)]
        fires = [(x[np.ix_(one, voters)] * rng.random((len(one), len(voters)))).argmax(axis=1) for _ in range(DRAWS)]
        alone = np.concatenate([x[one] * (corr[voters[f]] >= 0.5) for f in fires])
        x = np.concatenate([x, alone.astype(np.float32)])
        y = np.append(post, np.ones(len(alone)))
    w, bias = start.copy(), -3.0
    mass = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    m, v = np.zeros(len(strong) + 1), np.zeros(len(strong) + 1)
    for i in range(1, 601):  # Adam on the log loss, with a ridge that draws the weights to their start
        p = 1 / (1 + np.exp(-np.clip(bias + x @ w.astype(np.float32), -30, 30)))
        r = ((p - y) * mass).astype(np.float32)
        g = np.append(r @ x + 3e-4 * (w - start), r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.03 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
        w, bias = np.maximum(w - step[:-1], 0), bias - step[-1]
    lexicon = np.unique(word_ids([a for b in LEXICONS.values() for a in b], hasher))
    fitted = w[np.isin(names[strong], lexicon)]
    missing = np.setdiff1d(lexicon, names)
    return Model(np.append(names[strong], missing), np.append(w, np.full(len(missing), np.median(fitted) if len(fitted) else UNFITTED)), float(bias))


def _sets():
    schema = pa.schema([("id", pa.string()), ("toxic", pa.int32()), ("bits", pa.int64()), ("sketch", pa.binary()), ("x", pa.binary())])

    def run(batches):
        hasher = SpanHasher()
        lexicons = [np.unique(word_ids(words, hasher)) for words in LEXICONS.values()]
        for b in batches:
            rows = []
            for i, y, t in zip(b.column("id").to_pylist(), b.column("toxic").to_pylist(), texts_of(b, "text"), strict=True):
                ids = np.unique(features([t], hasher)[0])
                rows.append((i, y, voters_of(t, ids, lexicons), sketch(ids).tobytes(), ids.tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run, "id string, toxic int, bits long, sketch binary, x binary"


def _tally(kept: dict[str, int]):
    """Rows of a partition that have a feature, by label; kept: the ids that count."""

    def run(batches):
        for b in batches:
            sides = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for i, y, x in zip(b.column("id").to_pylist(), b.column("toxic").to_pylist(), b.column("x").to_pylist(), strict=True):
                if i in kept:
                    sides[int(y == 1)].append(np.frombuffer(x, np.int64))
            ids, at = np.unique(np.concatenate(sides[0] + sides[1]), return_inverse=True)
            n = sum(map(len, sides[0]))
            yield pa.record_batch([pa.array(ids), pa.array(np.bincount(at[n:], minlength=len(ids))), pa.array(np.bincount(at[:n], minlength=len(ids)))], names=["f", "pos", "neg"])

    return run, "f long, pos long, neg long"


def _only(names: np.ndarray, kept: dict[str, int]):
    """Places in `names` of the features that a row has."""

    def run(batches):
        for b in batches:
            rows = []
            for i, x in zip(b.column("id").to_pylist(), b.column("x").to_pylist(), strict=True):
                if i in kept:
                    ids = np.frombuffer(x, np.int64)
                    at = np.minimum(np.searchsorted(names, ids), max(len(names) - 1, 0))
                    rows.append((kept[i], at[names[at] == ids].tolist() if len(names) else []))
            cols = list(zip(*rows, strict=True)) if rows else [(), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int32()))], names=["row", "at"])

    return run, "row int, at array<int>"


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, per_class: int = PER_CLASS) -> Model:
    """A linear classifier from labelled rows whose crc32(id as text) mod folds is not 1.

    Per class the per_class labelled ids with the smallest hash are used: the bounded sample. Their feature sets stay in Spark. What
    reaches the driver is bounded by parameters, whatever the texts' length: a sketch of SKETCH numbers a row, for leaving copies
    out; at most CANDIDATES features with the most evidence among all features of the sample (a feature of a single text is none); and which
    row has which of these.

    Null labels and ids are left out; a repeated id takes its largest label and one of its texts (smallest hash). Null,
    empty and wordless texts have no features and count as copies of each other. Ties in evidence go to the smaller id of
    a feature. Without labels of both classes, as in empty tables, the lexicons alone decide. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != 1)).select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    pick = None
    for y in (0, 1):
        part = known.groupBy("id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        pick = part if pick is None else pick.unionByName(part)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text")).join(F.broadcast(pick), "id")
    one = found.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "toxic", "t.text")
    sets = cut(one.mapInArrow(*_sets()))
    rows = sorted(sets.select("id", "toxic", "bits", "sketch").collect())
    hasher = SpanHasher()
    keep = apart(np.array([np.frombuffer(r.sketch, np.uint32) for r in rows]).reshape(-1, SKETCH))
    rows = [rows[i] for i in keep]
    gold = np.array([r.toxic for r in rows], int)
    if not len(gold) or gold.min() == gold.max():
        return lexicon_only(hasher)
    kept = {r.id: i for i, r in enumerate(rows)}
    n1, n0 = int(gold.sum()), int((1 - gold).sum())
    sums = sets.mapInArrow(*_tally(kept)).groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 2 and pos > 0")
    log_odds = F.log((F.col("pos") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n0 + 1.0))
    z = log_odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    names = np.sort(np.array([r.f for r in sums.select("f", z.alias("z")).where("z > 0").orderBy(F.desc("z"), "f").limit(CANDIDATES).collect()], np.int64))
    has = sorted(sets.mapInArrow(*_only(names, kept)).collect())
    doc = np.repeat(np.array([r["row"] for r in has], np.int64), [len(r["at"]) for r in has])
    feat = np.array([i for r in has for i in r["at"]], np.int64)
    return fit(names, doc, feat, np.array([r.bits for r in rows], np.int64), gold, hasher)


def _score(model: Model, cols: list[str], text_col: str):
    def run(batches):
        hasher, places, w = SpanHasher(), model.lookup(), model.weights
        for b in batches:
            texts = texts_of(b, text_col)
            out = np.full(len(texts), model.bias)
            for s, e in parts(texts):
                feat, doc = features(texts[s:e], hasher)
                at = places(feat)
                pair = np.unique(doc[at >= 0] * len(w) + at[at >= 0])
                out[s:e] += np.bincount(pair // len(w), w[pair % len(w)], e - s)
            yield pa.record_batch([*(b.column(c) for c in cols), pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))], names=[*cols, "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs and `score`, 0 to 1, of each whole text; an existing score is overwritten.

    Only the text decides. Null, empty and wordless texts score the intercept; very long texts are read whole; ties and repeated
    rows score alike, row by row; null ids pass; an empty table gives an empty result. Batches are bounded by bytes, without a
    shuffle; the weights (KEPT and the lexicons) travel with the task.
    """
    bound_batches(docs.sparkSession)
    rows = docs.drop("score")
    return rows.mapInArrow(_score(model, rows.columns, text_col), StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def op6(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs.select("doc_id", "text"), train_toxicity(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
