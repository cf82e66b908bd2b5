"""Source clones: texts that are alike but for names, literals and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEXEME = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|[0-9]+(?:\.[0-9]+)?|[A-Za-z_$][0-9A-Za-z_$]*|[^\s0-9A-Za-z_$]"
KEYWORDS = ("if", "else", "for", "while", "return", "new", "try", "catch", "class", "import", "function", "echo", "eval", "exec", "system", "request", "response", "public", "static", "void", "include", "require")


def lexemes(text: Column) -> Column:
    """Words, literals and signs of a text, comments out."""
    plain = F.regexp_replace(text, r"(?s)/\*.*?\*/|<!--.*?-->", " ")
    return F.regexp_extract_all(plain, F.lit(f"({_LEXEME})"), F.lit(1))


def structure(tokens: Column) -> Column:
    """Lexemes with literals and names that are no keywords reduced to their kind."""
    return F.transform(
        tokens,
        lambda t: F.when(t.rlike(r"^[\"']"), "S").when(t.rlike("^[0-9]"), "N").when(F.lower(t).isin(*KEYWORDS), F.lower(t)).when(t.rlike("^[A-Za-z_$]"), "I").otherwise(t),
    )


def literals(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.rlike(r"^[\"'0-9]"))))


def fingerprints(files: DataFrame) -> DataFrame:
    """path, structure and literal digests, tokens (how many)."""
    rows = files.withColumn("_t", lexemes(F.col("text")))
    return rows.select("path", F.sha2(F.array_join(structure(F.col("_t")), " "), 256).alias("structure"), F.sha2(F.array_join(literals(F.col("_t")), " "), 256).alias("literal"), F.size("_t").alias("tokens"))


def groups(prints: DataFrame) -> DataFrame:
    """Files of equal structure, and how many sets of literals they hold; groups of one are left out."""
    g = prints.where("tokens > 0").groupBy("structure").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("files"), F.count_distinct("literal").alias("variants"))
    return g.where("files > 1")
