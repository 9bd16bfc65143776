"""The corpus model over the driver's tables, and schemas of the model's own tables.

A document's source is a book, the document a chapter, its lines the verses. The spine key of a line is
doc_id * LINES + line number, so that intervals of keys are ranges of lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"\p{L}+"
#: A document has fewer lines than this; a longer one is an error, as its keys would be those of the next.
LINES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_of(source: str) -> Column:
    return F.substring(source, 4, 9).cast("int") + 1


def documents(spark: SparkSession, sf_dir: str, scope: list[tuple[int, int]] | None = None) -> DataFrame:
    """Documents with text; of a scope of spine keys only those that hold some of it, which the scan prunes by doc_id."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    if scope:
        docs = docs.where(reduce(lambda a, b: a | b, [F.col("doc_id").between(start // LINES, end // LINES) for start, end in scope]))
    return docs


def verses(spark: SparkSession, sf_dir: str, scope: list[tuple[int, int]] | None = None) -> DataFrame:
    """(verse_id, doc_id, book_num, verse, lang, text, bridge_end): one row for each line of each document."""
    return lines_of(documents(spark, sf_dir, scope))


def lines_of(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    verse = (F.col("at") + 1).cast("long")
    key = F.when(verse < LINES, F.col("doc_id") * LINES + verse).otherwise(F.raise_error(F.lit(f"a document has {LINES} lines or more")).cast("long"))
    return lines.select(key.alias("verse_id"), "doc_id", book_of("source").alias("book_num"), verse.alias("verse"), "lang", "text", F.when(verse % 7 == 0, key + 1).alias("bridge_end"))


def words(spark: SparkSession, sf_dir: str, scope: list[tuple[int, int]] | None = None) -> DataFrame:
    """(verse_id, doc_id, book_num, verse, lang, word_num, surface, lemma): one row for each word, in order from 1."""
    return tokens(verses(spark, sf_dir, scope))


def sequences(rows: DataFrame) -> DataFrame:
    """rows with ws, the lower-cased words of text in order, in place of text."""
    return rows.withColumn("ws", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).drop("text")


def tokens(rows: DataFrame) -> DataFrame:
    keep = [c for c in ("verse_id", "doc_id", "book_num", "verse", "lang") if c in rows.columns]
    found = rows.select(*keep, F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("at", "surface"))
    return found.select(*keep, (F.col("at") + 1).cast("long").alias("word_num"), "surface", F.lower("surface").alias("lemma"))
