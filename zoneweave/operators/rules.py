"""Rule documents: JSON salvage, validation, latest logs, prompts and language-model calls."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

REQUIRED = ("article_id", "R", "S")
#: Names under which results of query labels are stored.
LABELS = {"Q0_포괄질의": "Q0_포괄질의_BuildingEnvelope", "Q1_일조권사선제한": "Q1_일조권사선제한", "Q2_이격거리": "Q2_이격거리", "Q3_높이제한": "Q3_높이제한"}


def output_label(label: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.element_at(names, label), label)


def _json_text(c: Column) -> Column:
    return F.when(F.try_parse_json(c).isNotNull(), c)


def salvage(response: Column) -> Column:
    """JSON text in a response: the whole, else a fenced block, else first '[' to last ']', else the braces; else null."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\[.*?\]|\{.*?\})\s*```", 1)
    square, curly = F.regexp_extract(response, r"(?s)(\[.*\])", 1), F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[_json_text(F.when(c != "", c)) for c in (response, fenced, square, curly)])


def articles_of(text: str | None, single_first: bool = False) -> list[dict]:
    """Articles of a rule document that carry all required keys.

    A list is taken as it is. An object gives its 'articles' list; else the first non-empty list value, or the
    object itself if it is one article. single_first asks the last two in the opposite order.
    """
    try:
        obj = json.loads(text) if text is not None else None
    except ValueError:
        return []
    found = None
    if isinstance(obj, list):
        found = obj
    elif isinstance(obj, dict):
        lists = [v for v in obj.values() if isinstance(v, list) and v]
        single = [obj] if "article_id" in obj else None
        first = lists[0] if lists else None
        if isinstance(obj.get("articles"), list):
            found = obj["articles"]
        else:
            found = (single or first) if single_first else (first or single)
    return [a for a in found or [] if isinstance(a, dict) and set(REQUIRED) <= a.keys()]


ARTICLE = "article_id string, article_title string, source string, R string, A string, S string, E string"


def validate(docs: DataFrame, key: str, text: str = "json", single_first: bool = False) -> DataFrame:
    """One row a valid article: key, pos and the article's parts, R, A, S and E as JSON text, since their keys are open."""
    names = [c.split()[0] for c in ARTICLE.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                for i, a in enumerate(articles_of(t, single_first)):
                    vals = [a.get(n) for n in names]
                    out.append((k, i, *[v if v is None or (n in names[:3] and isinstance(v, str)) else json.dumps(v, ensure_ascii=False, sort_keys=True) for n, v in zip(names, vals, strict=True)]))
            yield pd.DataFrame(out, columns=[key, "pos", *names])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, pos int, {ARTICLE}")


def missing_keys(present: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(k) for k in required]), present)


def latest(rows: DataFrame, key: str, by: str, *ties: str) -> DataFrame:
    """The row with the largest `by` of each key; ties take the largest of the further columns. One combined aggregate."""
    rest = [c for c in rows.columns if c not in (key, by, *ties)]
    return rows.groupBy(key).agg(F.max(F.struct(by, *ties, *rest)).alias("_r")).select(key, "_r.*").select(*rows.columns)


def context_text(contexts: DataFrame, key: str, top: int = 10, source_chars: int = 60) -> DataFrame:
    """(key, prompt context): ranked contexts as '--- [rank r] source ---' blocks, the first `top`."""
    block = F.concat(F.lit("--- [rank "), F.col("rank").cast("string"), F.lit("] "), F.substring("source", 1, source_chars), F.lit(" ---\n"), F.col("text"))
    rows = contexts.where(F.col("rank") <= top).select(key, F.struct("rank", block.alias("b")).alias("s"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["b"]), "\n\n").alias("context"))


def prompt(instructions: str, question: Column, context: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(instructions), F.concat(F.lit("[질문]\n"), question), F.concat(F.lit("[근거]\n"), context))


class RateLimit(Exception):
    """The service asks to wait."""


def with_retries(call: Callable[[str], str], text: str, tries: int = 5, wait: Callable[[int], float] = lambda n: min(10 * 2 ** (n - 1), 120), sleep: Callable[[float], None] = time.sleep, fail: bool = True) -> str:
    """call(text), again after a rate limit; at the end raises, or with fail=False returns the error's text."""
    error: Exception | None = None
    for n in range(1, tries + 1):
        try:
            return call(text)
        except RateLimit as e:
            error = e
            if n < tries:
                sleep(wait(n))
        except Exception as e:  # a failed call is a result where the caller wants text
            if fail:
                raise
            return f"{type(e).__name__}: {e}"
    if fail:
        raise RuntimeError(f"rate limit after {tries} tries") from error
    return f"RateLimit: {error}"


def stub_client(text: str) -> str:
    """Deterministic offline answer: one article that names the prompt's size."""
    return json.dumps([{"article_id": "제0조", "R": {"chars": len(text)}, "S": {"conditions": []}}], ensure_ascii=False)


def ask(prompts: DataFrame, key: str, client: Callable[[str], str] = stub_client, tries: int = 5, fail: bool = False, pause: float = 0.0) -> DataFrame:
    """(key, answer) of (key, prompt) rows through an injected client, one call a row in Arrow batches."""

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                out.append(with_retries(client, p, tries, fail=fail))
                if pause:
                    time.sleep(pause)
            yield pd.DataFrame({key: pdf[key], "answer": out})

    return prompts.select(key, "prompt").mapInPandas(run, f"`{key}` {prompts.schema[key].dataType.simpleString()}, answer string")


def structure(prompts: DataFrame, key: str, done: DataFrame | None = None, client: Callable[[str], str] = stub_client, attempts: int = 3, single_first: bool = False) -> DataFrame:
    """Rules of prompts that are not done: key, attempts used, valid, json (articles) and raw (kept where none was valid).

    Each attempt asks for the prompts that have no valid article yet, as one job. Answers are checkpointed, so no prompt is
    asked twice in an attempt; salvage is native, only the articles are judged in Python.
    """
    todo = cut((prompts if done is None else prompts.join(done.select(key).distinct(), key, "left_anti")).select(key, "prompt"))
    kind = prompts.schema[key].dataType.simpleString()

    def judge(batches):
        for pdf in batches:
            good = [articles_of(t, single_first) for t in pdf["json"]]
            yield pd.DataFrame({key: pdf[key], "answer": pdf["answer"], "json": [json.dumps(g, ensure_ascii=False) if g else None for g in good]})

    out = None
    for n in range(1, attempts + 1):
        answers = cut(ask(todo, key, client)).withColumn("json", salvage(F.col("answer")))
        judged = cut(answers.mapInPandas(judge, f"`{key}` {kind}, answer string, json string"))
        valid = F.col("json").isNotNull()
        settled = judged.where(valid | F.lit(n == attempts))
        part = settled.select(key, F.lit(n).alias("attempts"), valid.alias("valid"), "json", F.when(~valid, F.col("answer")).alias("raw"))
        out = part if out is None else out.unionByName(part)
        todo = todo.join(judged.where(~valid).select(key), key, "left_semi")
        if n < attempts and not todo.take(1):
            break
    return out


def ranked_contexts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "chunk_id")))
