"""Chunking of regulation text: by article and by sliding window."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import appendix_id, collapse_blank_lines, is_contents_stub, is_deleted, strip_page_footers

# Patterns of headings.
ARTICLE = r"^\s*(?:#{1,6}\s+)?-?\s*(제\d+조(?:의\d+)?)(?!제)\s*(?:\(([^)]*)\))?"
ADDENDUM = r"^\s*부칙\s*[<\(]"
APPENDIX = r"^\s*■\s*.*?\[별표\s*\d+"
APPENDIX_WORD, HEAD = "별표", 80
#: Headings that start within so many characters of the last kept one are part of it.
NEAR = 5


def headings(text: str) -> list[tuple[int, str, str, str]]:
    """(position, article id, title, section type) of all headings, by position, close ones taken out.

    Closeness is measured to the last kept heading, so a chain of close headings is not thinned by lag().
    """
    found = [(m.start(), m[1], m[2] or "", "article") for m in re.finditer(ARTICLE, text, re.M)]
    found += [(m.start(), "부칙", "", "addendum") for m in re.finditer(ADDENDUM, text, re.M)]
    for m in re.finditer(APPENDIX, text, re.M):
        n = re.search(r"별표\s*(\d+)", m[0])
        found.append((m.start(), f"별표 {n[1]}" if n else "별표", "", "appendix"))
    kept: list[tuple[int, str, str, str]] = []
    for h in sorted(found, key=lambda h: h[0]):
        if not kept or h[0] - kept[-1][0] > NEAR:
            kept.append(h)
    return kept


def _spans(batches):
    for pdf in batches:
        out = []
        for source, text in zip(pdf["source"], pdf["clean"], strict=True):
            hs = headings(text)
            for i, (pos, article, title, kind) in enumerate(hs):
                end = hs[i + 1][0] if i + 1 < len(hs) else len(text)
                out.append((source, i, text[pos:end].strip(), article, title, kind))
            if not hs:
                out.append((source, 0, text, "", "", "unknown"))
        yield pd.DataFrame(out, columns=["source", "pos", "text", "article_id", "article_title", "section_type"])


CHUNK = ("source", "pos", "text", "article_id", "article_title", "section_type", "char_count")


def article_chunks(texts: DataFrame) -> DataFrame:
    """Chunks of (source, text) by article: source, pos, text, article_id, article_title, section_type, char_count.

    Page footers and blank runs go first. A source named as an appendix is one chunk. Deleted articles, contents
    stubs of articles and addenda are dropped, as is text before the first heading. A text without any heading is
    one chunk of type unknown. Null and blank texts give none. Only positions are found in Python (Arrow
    batches, no shuffle); cleaning and filters are native.
    """
    t = texts.select("source", collapse_blank_lines(strip_page_footers(F.coalesce("text", F.lit("")))).alias("clean")).where("clean <> ''")
    named = F.contains(F.substring(F.col("source"), 1, HEAD), F.lit(APPENDIX_WORD))
    whole = t.where(named).select("source", F.lit(0).alias("pos"), F.col("clean").alias("text"), appendix_id(F.col("source")).alias("article_id"), F.lit("").alias("article_title"), F.lit("appendix").alias("section_type"))
    parts = t.where(~F.coalesce(named, F.lit(False))).mapInPandas(_spans, "source string, pos int, text string, article_id string, article_title string, section_type string")
    c, kind = F.col("text"), F.col("section_type")
    keep = (kind == "unknown") | ((c != "") & ~is_deleted(c) & ~((kind == "article") & is_contents_stub(c)) & (kind != "addendum"))
    return whole.unionByName(parts.where(keep)).withColumn("char_count", F.length("text")).select(*CHUNK)


def sliding_chunks(texts: DataFrame, key: str, size: int = 900, overlap: int = 120, text: str = "text") -> DataFrame:
    """Windows of `size` characters that share `overlap`, trimmed, blank ones left out: key, pos, chunk. All native.

    The last window is the first that reaches the end of the text.
    """
    clean = collapse_blank_lines(F.coalesce(F.col(text), F.lit("")))
    step = max(size - overlap, 1)
    t = texts.select(key, clean.alias("_t")).where("_t <> ''").withColumn("_n", F.length("_t"))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)).cast("int")
    w = t.select(key, F.explode(F.sequence(F.lit(0), last)).alias("pos"), "_t")
    return w.select(key, "pos", F.trim(F.substring(F.col("_t"), F.col("pos") * step + 1, F.lit(size))).alias("chunk")).where("chunk <> ''")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, mean, least and largest length, by section type and over all (null)."""
    return chunks.rollup("section_type").agg(F.count("*").alias("chunks"), F.round(F.avg("char_count"), 4).alias("mean_len"), F.min("char_count").alias("min_len"), F.max("char_count").alias("max_len"))


def article_rollup(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("article_id").agg(F.count("*").alias("chunks"), F.sum("char_count").alias("chars"))
