"""Readers of the scholarly formats. Line formats are column expressions; ordered markup is read file by file in Arrow batches."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import markup, refs


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files without byte-order marks."""
    return spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value"))


def tsv_rows(spark: SparkSession, path: str, gate: str) -> DataFrame:
    """Tab-separated fields of the lines whose first field matches the gate; prose preambles fall away."""
    cells = F.split("value", "\t")
    return lines(spark, path).where(F.get(cells, F.lit(0)).rlike(gate)).select(cells.alias("cells"))


def reference_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(verse_id, text, problem) of 'reference<TAB>text' lines; blank and # lines are skipped, only single verses are allowed."""
    rows = lines(spark, path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    cells = F.split("value", "\t", 2)
    read = rows.select(F.trim(F.get(cells, F.lit(0))).alias("ref"), F.trim(F.get(cells, F.lit(1))).alias("text"))
    read = read.withColumn("r", refs.reference_struct("ref"))
    problem = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "no text").when(F.col("r.start").isNull(), "unreadable reference").when(F.col("r.kind") != "verse", "not a single verse")
    return read.select(F.col("r.start").alias("verse_id"), "text", problem.alias("problem"))


def chapter_verse_text(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter, verse, text) of lines 'Book 1:2<TAB>text'."""
    cell, pattern = F.split("value", "\t", 2), "^([^\t]*[^\t ]) ([0-9]+):([0-9]+)$"
    ref = F.get(cell, F.lit(0))
    part = lambda i: F.regexp_extract(ref, pattern, i)
    return lines(spark, path).where(ref.rlike(pattern)).select(part(1).alias("book"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("verse"), F.get(cell, F.lit(1)).alias("text"))


def usfm(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, chapter, verse, end_verse, text) of USFM files. Lines depend on those before them, so a file is the unit of work."""
    kind = "book_id string, chapter int, verse int, end_verse int, text string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(book, v.chapter, v.verse, v.end_verse, v.text) for content in pdf["value"] for book, vs in [markup.parse_usfm(content)] for v in vs]
            out = pd.DataFrame(rows, columns=["book_id", "chapter", "verse", "end_verse", "text"])
            yield out.astype({"end_verse": "Int32"})

    return spark.read.text(path, wholetext=True).mapInPandas(read, kind)


def mapping_csv(spark: SparkSession, path: str, null_key: str = "H0000") -> DataFrame:
    """A CSV with a header whose first column is a key; rows of the null key fall away."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.where(F.col(f"`{df.columns[0]}`") != null_key)


def quoted_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated values with quoted fields in which a doubled quote stands for one."""
    return spark.read.csv(path, sep="\t", header=True, quote='"', escape='"')


def html_entries(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """One row for each HTML file: its name without suffix, and for each field the text of its pattern's first group."""
    whole = spark.read.text(path, wholetext=True).withColumn("entry", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))
    raw = whole.select("entry", *[F.regexp_extract("value", f"(?s){p}", 1).alias(n) for n, p in fields.items()])
    return raw.select("entry", *[F.nullif(markup.html_to_text(n), F.lit("")).alias(n) for n in fields])


def edges_tsv(spark: SparkSession, path: str, books: DataFrame) -> DataFrame:
    """(src, dst_start, dst_end, votes) of lines 'Gen.1.1<TAB>Joh.1.1-Joh.1.3<TAB>votes'; books has (code, book_num), one row a book.

    Lines with an unknown book, a bad number or fewer fields are left out.
    """
    cells = F.split("value", "\t")
    to = F.split(F.get(cells, F.lit(1)), "-")
    rows = lines(spark, path).select(F.get(cells, F.lit(0)).alias("a"), F.get(to, F.lit(0)).alias("b"), F.coalesce(F.get(to, F.lit(1)), F.get(to, F.lit(0))).alias("c"), F.get(cells, F.lit(2)).try_cast("int").alias("votes"))
    dim = books.select(F.lower("code").alias("code"), "book_num")
    for name, key in (("a", "src"), ("b", "dst_start"), ("c", "dst_end")):
        bit = F.split(name, "[.]")
        key_of = (F.col("book_num").cast("long") * 1000 + F.get(bit, F.lit(1)).try_cast("int")) * 1000 + F.get(bit, F.lit(2)).try_cast("int")
        rows = rows.join(dim, F.lower(F.get(bit, F.lit(0))) == F.col("code")).withColumn(key, key_of).drop("code", "book_num")
    return rows.select("src", "dst_start", "dst_end", "votes").where("src is not null and dst_start is not null and dst_end is not null and votes is not null")


def word_lines(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter, verse, text) of a corpus with one 'Book.1.2 word' on a line: words joined in file order."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: dict[tuple, list[str]] = {}
            for content in pdf["value"]:
                for m in re.finditer(r"(?m)^([^\s.]+)[.]([0-9]+)[.]([0-9]+)\s+(\S+)", content.lstrip("﻿")):
                    held.setdefault((m[1], int(m[2]), int(m[3])), []).append(m[4])
            yield pd.DataFrame([(*k, " ".join(w)) for k, w in held.items()], columns=["book", "chapter", "verse", "text"])

    return spark.read.text(path, wholetext=True).mapInPandas(read, "book string, chapter int, verse int, text string")


def name_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(kind, unique_name, field, value) of block records: '$====KIND' opens one, its first line is 'name<TAB>…', lines of – and @ follow."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf["value"]:
                for block in re.split(r"(?m)^\$=+\s*", content)[1:]:
                    kind, *body = block.strip().splitlines()
                    name = body[0].split("\t")[0].strip() if body else ""
                    for line in body[1:]:
                        if line[:1] in "–@" and line[1:].strip():
                            key, _, value = line[1:].strip().partition("\t")
                            rows.append((kind.strip(), name, key.strip(), value.strip()))
            yield pd.DataFrame(rows, columns=["kind", "unique_name", "field", "value"])

    return spark.read.text(path, wholetext=True).mapInPandas(read, "kind string, unique_name string, field string, value string")


PREDICATE = ("adv", "aux", "v", "vc", "p", None)
CLAUSE_COLUMNS = "clause_id string, parent_id string, verse_start long, verse_end long, role string, word string, strongs string, embedded int, negated int"


def flatten_tree(root: ET.Element, prefix: str) -> list[tuple]:
    """Role rows of a treebank sentence, as (clause, parent, verse span, role, word, key, embedded, negated).

    Elements: 'c' a clause, 'g' a group, 'w' a word, each with an optional role; words carry v (the verse), s (the key)
    and neg="1" for a negating particle. A word's role is its own or that of the nearest group up to its clause. A clause
    that fills a role of its parent gives its words to the parent too, embedded, through all levels. A clause is negated by
    a particle of its own in a predicate role or none.
    """
    out, count = [], [0]

    def walk(node: ET.Element, open_: list[dict], role: str | None) -> None:
        own = node.get("role") or role
        if node.tag == "c":
            clause = {"id": f"{prefix}{count[0]}", "parent": open_[-1]["id"] if open_ else None, "role": node.get("role"), "verses": [], "rows": [], "negated": 0}
            count[0] += 1
            for child in node:
                walk(child, [*open_, clause], None)
            if clause["verses"]:
                span = (min(clause["verses"]), max(clause["verses"]))
                out.extend((clause["id"], clause["parent"], *span, r, w, s, e, clause["negated"]) for r, w, s, e in clause["rows"])
        elif node.tag == "w":
            for clause in open_:
                clause["verses"].append(int(node.get("v")))
            if open_:
                open_[-1]["rows"].append((own, node.text, node.get("s"), 0))
                if node.get("neg") == "1" and own in PREDICATE:
                    open_[-1]["negated"] = 1
                for inner, outer in zip(open_[::-1], open_[-2::-1]):
                    if not inner["role"]:
                        break
                    outer["rows"].append((inner["role"], node.text, node.get("s"), 1))
        else:
            for child in node:
                walk(child, open_, own)

    walk(root, [], None)
    return out


def treebank(spark: SparkSession, path: str) -> DataFrame:
    """Role rows of treebank XML files; each <sentence> holds nested c, g and w elements whose order matters."""
    names = [c.split()[0] for c in CLAUSE_COLUMNS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf["value"]:
                root = ET.fromstring(content)
                for i, sentence in enumerate(root.iter("sentence")):
                    rows += flatten_tree(sentence, f"{root.get('id', 'f')}.{sentence.get('id', i)}.")
            yield pd.DataFrame(rows, columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(read, CLAUSE_COLUMNS)


def zip_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".usfm", ".sfm", ".tsv", ".txt"), depth: int = 3) -> DataFrame:
    """(archive, name, text) of the members, down to some depth, of all archives of a path; an archive is read in one task."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, content in zip(part["path"], part["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in sorted(z.namelist()):  # a member at a time
                        if n.lower().endswith(suffixes) and n.count("/") <= depth and ".." not in Path(n).parts:
                            yield pd.DataFrame({"archive": [archive], "name": [n], "text": [z.read(n).decode("utf-8-sig")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "archive string, name string, text string")
