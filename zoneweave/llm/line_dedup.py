"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, salted_join

#: The white space stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """Documents with every line dropped whose key stands in min_docs documents or more.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased; keys under
    min_chars code points never drop. The smallest id that holds a key keeps all its lines of it.

    Only two 64-bit hashes of a key, ids and positions are shuffled for the counting; the texts
    are shuffled once, to meet their dropped positions. Counting combines on the map side, so a
    line in a third of all documents costs one row a task; the join back is salted.

    Null or empty text: one empty line, never dropped. Null id: the row keeps all its lines and
    counts for no key. Rows that repeat an id count as one document; each is cut by its own lines.
    Empty table: empty result. Columns of docs stay; `text` is replaced, `n_lines` and `n_dropped`
    (long) are added and overwrite columns of these names.
    """
    t = "_ld_"
    base = docs.drop("n_lines", "n_dropped")
    key = ascii_lower(F.btrim(F.col(t + "line"), F.lit(BLANKS)))
    lines = (
        base.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias(t + "id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias(t + "row"), F.posexplode(_lines(text_col)).alias(t + "pos", t + "line"))
        .withColumn(t + "key", key)
        .where(F.length(t + "key") >= min_chars)
        .select(t + "id", t + "row", t + "pos", F.xxhash64(t + "key").alias(t + "h1"), F.xxhash64(F.lit("line"), t + "key").alias(t + "h2"))
    )
    hashes = [t + "h1", t + "h2"]
    if min_docs <= 2:
        counts = lines.groupBy(*hashes).agg(F.min(t + "id").alias(t + "first"), F.max(t + "id").alias(t + "last")).where(F.col(t + "first") < F.col(t + "last") if min_docs == 2 else F.lit(True))
    else:
        counts = lines.select(*hashes, t + "id").distinct().groupBy(*hashes).agg(F.min(t + "id").alias(t + "first"), F.count("*").alias(t + "n")).where(F.col(t + "n") >= min_docs)
    dropped = (
        salted_join(lines, counts.select(*hashes, t + "first"), hashes, [t + "id", t + "pos"])
        .where(F.col(t + "id") != F.col(t + "first"))
        .groupBy(t + "id", t + "row")
        .agg(F.collect_set(t + "pos").alias(t + "drop"))
    )
    out = base.withColumn(t + "id", F.col(id_col)).withColumn(t + "row", F.xxhash64(F.coalesce(text_col, F.lit("")))).join(dropped, [t + "id", t + "row"], "left")
    n = F.size(_lines(text_col))
    keep = F.array_except(F.sequence(F.lit(0), n - 1), F.col(t + "drop"))
    # the lines are bound once as a lambda variable: a split inside the inner lambda would run once a line
    kept = F.array_join(F.transform(F.array(_lines(text_col)), lambda ls: F.transform(keep, lambda p: F.get(ls, p)))[0], "\n")
    out = out.withColumn("n_lines", n.cast("long")).withColumn("n_dropped", F.when(F.col(t + "drop").isNull(), F.lit(0)).otherwise(F.size(t + "drop")).cast("long"))
    return out.withColumn(text_col, F.when(F.col(t + "drop").isNull(), F.coalesce(text_col, F.lit(""))).otherwise(kept)).select(*base.columns, "n_lines", "n_dropped")


def op1(spark, sf_dir):
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS n FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, k.pos, k.line, coalesce(c.n >= 2 AND c.first_doc <> k.doc_id, false) AS gone
      FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
