"""Command line: `python -m zoneweave list`, `run NAME --data DIR`, `ask "question" --texts DIR`."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import chunks as ch
from .operators import retrieval as rt
from .operators import rules as ru
from .plans import catalog, studies
from .session import session
from .sources.files import read_texts

QUERIES = catalog.QUERIES | studies.QUERIES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="zoneweave")
    p.add_argument("--master", default=None, help="Spark master; the environment's by default")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("--data", required=True)
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    run.add_argument("--show", type=int, default=20)
    ask = sub.add_parser("ask", help="the best passages of a folder of texts for a question, as a prompt")
    ask.add_argument("question")
    ask.add_argument("--texts", required=True)
    ask.add_argument("--pattern", default="*.md")
    ask.add_argument("--mode", default="hybrid", choices=["hybrid", *rt.SINGLE, *rt.PAIRS])
    ask.add_argument("--alpha", type=float, default=0.5)
    ask.add_argument("--top", type=int, default=1)
    return p


def answer(spark, question: str, texts: str, pattern: str = "*.md", mode: str = "hybrid", alpha: float = 0.5, top: int = 1) -> str:
    """The prompt of a question with its best passages; empty context where nothing matches."""
    c = ch.article_chunks(read_texts(spark, texts, pattern)).select(F.xxhash64("source", "pos").alias("chunk_id"), "source", "text")
    q = spark.createDataFrame([(1, question)], "item_id long, question string")
    context = ru.context_text(rt.retrieve(rt.Index(c), q, top, mode, alpha), "item_id", top)
    row = q.join(context, "item_id", "left").select(ru.prompt("Answer from the passages.", F.col("question"), F.coalesce("context", F.lit(""))).alias("p")).first()
    return row.p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = session(a.master)
    if a.command == "ask":
        print(answer(spark, a.question, a.texts, a.pattern, a.mode, a.alpha, a.top))
        return 0
    df = QUERIES[a.name](spark, a.data)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
