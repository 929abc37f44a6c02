"""What keeps queries in proportion to their input: work done once, dealt out, and counted where it stands."""

import math
import random
import re
from collections import Counter

import pytest
from conftest import SF

from zoneweave.operators import retrieval as rt
from zoneweave.operators import rings, score
from zoneweave.plans import catalog, studies
from zoneweave.plans.views import chunks, questions


def once_and_dealt(spark, monkeypatch, query, shapes):
    """Every distinct shape is worked out once, in more tasks than the one file of parcels has."""
    seen, real = spark.sparkContext.accumulator(0), rings.apply_rings
    given = []

    def counted(df, key, columns, make, schema):
        def one(r):
            from pyspark import TaskContext

            seen.add(1)
            return (*make(r), TaskContext.get().partitionId())

        out = real(df, key, columns, one, f"{schema}, task int").cache()
        given.append(out)
        return out

    monkeypatch.setattr(rings, "apply_rings", counted)
    rows = query(spark, SF).count()
    assert seen.value == shapes
    assert given[0].select("task").distinct().count() > 1
    return rows


def test_kernel_concave_once_a_shape(spark, monkeypatch):
    p = studies.raw_parcels(spark, SF)
    assert once_and_dealt(spark, monkeypatch, studies.kernel_concave, p.select("width", "depth").distinct().count()) == 4 * p.count()


def test_kernel_sloped_once_a_shape(spark, monkeypatch):
    p = studies.raw_parcels(spark, SF)
    assert once_and_dealt(spark, monkeypatch, studies.kernel_sloped, p.selectExpr("width", "depth", "part_key % 5").distinct().count()) == 4 * p.count()


def test_ring_operators_once_a_shape(spark, monkeypatch):
    p = studies.raw_parcels(spark, SF)
    assert once_and_dealt(spark, monkeypatch, studies.ring_operators, p.select("width", "depth").distinct().count()) == p.count()


def test_visual_heights_once_a_shape(spark, monkeypatch):
    t = studies.ct.targets(spark, SF)
    assert once_and_dealt(spark, monkeypatch, studies.visual_heights, t.select("width", "depth", "effective_gap_m").distinct().count()) == 7 * t.count()


def brute(texts, asked, k=3):
    """{candidate: {(item, rank): (chunk, score)}} of tfidf, bm25 and their even blend, in plain Python."""
    grams = lambda t: (w := re.findall(r"\w{2,}", t.lower())) + [" ".join(p) for p in zip(w, w[1:])]
    docs, n = {i: Counter(grams(t)) for i, t in texts.items()}, len(texts)
    df = Counter(w for d in docs.values() for w in d)
    idf = {w: math.log((n + 1) / (c + 1)) + 1 for w, c in df.items()}
    avgdl = sum(map(Counter.total, docs.values())) / n
    out = {0: {}, 1: {}, 2: {}}
    for item, text in asked.items():
        q = Counter(w for w in grams(text) if w in df)
        qn = math.sqrt(sum((c * idf[w]) ** 2 for w, c in q.items()))
        s = {}
        for i, d in docs.items():
            dn = math.sqrt(sum((c * idf[w]) ** 2 for w, c in d.items()))
            t = sum(c * idf[w] ** 2 * d[w] for w, c in q.items()) / (qn * dn) if qn * dn else 0.0
            b = math.fsum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * d[w] * 2.5 / (d[w] + 1.5 * (0.25 + 0.75 * d.total() / avgdl)) for w in q)
            s[i] = (t, b)
        lo, hi = ([f(x[j] for x in s.values()) for j in (0, 1)] for f in (min, max))
        even = lambda x: sum(0.5 * (x[j] - lo[j]) / (hi[j] - lo[j]) if hi[j] - lo[j] >= 1e-9 else 0.0 for j in (0, 1))
        for c, f in enumerate((lambda x: x[0], lambda x: x[1], even)):
            best = sorted((-round(f(x), 12), i) for i, x in s.items())[:k]
            out[c] |= {(item, r + 1): (i, round(-v, 6)) for r, (v, i) in enumerate(best) if v < 0}
    return out


def test_ranks_without_rows_of_pairs(spark, monkeypatch):
    """Small blocks, pages and ranges of hashes; copies, texts without terms, unheard questions, rare and common terms."""
    for name, size in (("PAGE", 4), ("ROWS", 7), ("BLOCK", 5), ("RANGE", 9), ("HOT", 2)):
        monkeypatch.setattr(score, name, size)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 30))) for i in range(60)}
    texts |= {100 + i: texts[1] for i in range(30)} | {200: "", 201: "Über wörter, ÜBER wörter"}
    asked = {i: " ".join(rng.choices(words, k=6)) for i in range(9)} | {20: "unheard of", 21: texts[1], 22: "über wörter w1"}
    c = spark.createDataFrame([(i, "s", t) for i, t in texts.items()], "chunk_id long, source string, text string").repartition(3)
    q = spark.createDataFrame(list(asked.items()), "item_id long, question string")
    got = rt.ranked(rt.Index(c), q, [("tfidf",), ("bm25",), ("tfidf", "bm25", 0.5)], 3).collect()
    for n, want in brute(texts, asked).items():
        assert {(r.item_id, r.rank): (r.chunk_id, round(r.score, 6)) for r in got if r.candidate == n} == want


@pytest.mark.parametrize("name", ["tfidf_topk", "bm25_topk", "hybrid_topk", "boosted_topk", "retrieve_default", "retrieval_metrics", "mode_selection", "answer_logs"])
def test_no_rows_of_pairs(spark, monkeypatch, name):
    """What leaves the chunks are a few rows a question and task, not one of each matched pair."""
    sizes, real = [], rt.top_k

    def counted(scores, *more):
        sizes.append((scores.count(), scores.select("item_id", "chunk_id").distinct().count()))
        return real(scores, *more)

    monkeypatch.setattr(rt, "top_k", counted)
    (catalog.QUERIES | studies.QUERIES)[name](spark, SF).count()
    matched = rt.lexical_scores(rt.Index(chunks(spark, SF)), questions(spark, SF), ("bm25",)).count()
    assert len(sizes) == 1 and sizes[0][1] < matched / 3


def test_boosts_meet_their_questions_where_the_texts_stand(spark, monkeypatch):
    """Eight needles are eight keys: a join dealt by needle would leave a needle's chunks to one task."""
    plans = []
    real = rt.small
    monkeypatch.setattr(rt, "small", lambda df, *more: plans.append(df.columns) or real(df, *more))
    got = studies.law_boosts(spark, SF)
    assert ["item_id", "needle"] in plans
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_kernel_areas_are_dealt_out(spark):
    """Lots are few bytes and much work: sizes in bytes would leave them in one task."""
    rows = catalog.kernel_rows(spark, SF)
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_doc_terms_send_texts_not_terms(spark):
    """Terms are counted behind the exchange of the texts: no exchange has terms in it."""
    plan = catalog.QUERIES["doc_terms"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" in plan.split("Exchange ")[0]
