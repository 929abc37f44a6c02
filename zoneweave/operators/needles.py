"""Substring search of many needles in many texts: one pass over each text, whatever the number of needles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Needles, and their characters, of one automaton: the bound on what the driver and a task hold. More needles take more passes.
NEEDLES, CHARS = 50_000, 8 << 20


def _passes(needles: list[str]):
    at = 0
    while at < len(needles):
        to, n = at, 0
        while to < len(needles) and to - at < NEEDLES and (to == at or n + len(needles[to]) < CHARS):
            n += len(needles[to])
            to += 1
        yield needles[at:to]
        at = to


def _search(needles: list[str], keys: list[str]):
    def run(batches):
        import ahocorasick

        trie = ahocorasick.Automaton()
        for n in needles:
            trie.add_word(n, n)
        trie.make_automaton()
        for b in batches:
            found = [sorted({n for _, n in trie.iter(t)}) if t else [] for t in b.column("_text").to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.record_batch([*(b.column(k).take(at) for k in keys), pa.array([n for f in found for n in f], pa.string())], names=[*keys, "needle"])

    return run


def find_needles(texts: DataFrame, keys: list[str], text: Column, needles: DataFrame, needle: str) -> DataFrame:
    """(keys.., needle): which distinct non-empty needles stand in which text, each pair once a row of texts.

    Needles are read block by block from a sorted table, so what the driver holds is bounded; each block is one pass over the
    texts in batches, without a shuffle and without pairing texts with needles. Null texts hold none.
    """
    spark = texts.sparkSession
    words = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    rows = texts.select(*keys, text.alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema), "needle string"])
    out, last = None, None
    while True:  # a page of needles at a time
        page = [r.needle for r in (words if last is None else words.where(F.col("needle") > last)).orderBy("needle").limit(NEEDLES).collect()]
        if not page:
            break
        for block in _passes(page):
            part = rows.mapInArrow(_search(block, keys), schema)
            out = part if out is None else out.unionByName(part)
        if len(page) < NEEDLES:
            break
        last = page[-1]
    return out if out is not None else spark.createDataFrame([], schema)
