"""Native text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_blank_lines(c: Column) -> Column:
    """Three and more newlines become two; white space at both ends goes."""
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def strip_page_footers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\n*법제처\s+\d+\s+국가법령정보센터\n*", "\n")


def no_space(c: Column) -> Column:
    """Without any white space, Unicode included."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def slug(c: Column, size: int = 40) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "-")
    s = F.regexp_replace(s, r"[^0-9A-Za-z가-힣\-_]", "")
    return F.when(s == "", F.lit("question")).otherwise(F.substring(s, 1, size))


#: Words that raise a chunk when a question names them.
SIGNAL_WORDS = ("일조", "채광", "정북", "인접대지경계선", "높이제한")


def signals(question: Column) -> Column:
    """Article numbers without inner spaces, then signal words found in the question; distinct, in order."""
    articles = F.transform(F.regexp_extract_all(question, F.lit(r"(?U)제\s*\d+\s*조"), F.lit(0)), no_space)
    words = F.filter(F.array(*[F.lit(w) for w in SIGNAL_WORDS]), lambda w: F.contains(question, w))
    return F.array_distinct(F.concat(articles, words))


def is_deleted(c: Column) -> Column:
    return F.contains(c, F.lit("삭제")) & (F.length(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")) < 80)


def is_contents_stub(c: Column) -> Column:
    """An article heading without substance: under 20 characters, or no paragraph mark, sentence end or numbering."""
    body = F.regexp_replace(c, r"(?U)\A(?:#{1,6}\s+)?(?:-?\s*)?제\d+조(?:의\d+)?\s*(?:\([^)]*\))?\s*", "")
    body = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    return (F.length(body) < 20) | ~(F.rlike(body, F.lit("[①②③④⑤⑥⑦⑧⑨⑩]")) | F.contains(body, F.lit("다.")) | F.rlike(body, F.lit(r"(?Um)^\s*-?\s*\d+\.")))


def appendix_id(c: Column) -> Column:
    n = F.regexp_extract(c, r"(?U)별표\s*(\d+)", 1)
    return F.when(n == "", F.lit("별표")).otherwise(F.concat(F.lit("별표 "), n))


def file_code(name: Column) -> Column:
    """District code: the third part of a file name split at '_'."""
    return F.get(F.split(name, "_"), F.lit(2))


def tokens(c: Column) -> Column:
    """Lower-cased words of two and more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def grams(tokens_: Column) -> Column:
    """Unigrams, then bigrams joined by a space."""
    n = F.greatest(F.size(tokens_) - 1, F.lit(0))
    return F.concat(tokens_, F.zip_with(F.slice(tokens_, F.lit(1), n), F.slice(tokens_, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def text_grams(c: Column) -> Column:
    """Unigrams and bigrams of a text; its tokens are bound as a lambda variable, so they are found once."""
    return F.transform(F.array(tokens(c)), grams)[0]


def cut_text(c: Column, size: int) -> Column:
    return F.substring(c, 1, size)
