"""The registry of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The corpus model in DuckDB SQL: what corpusloom.tables builds.
VERSES_SQL = r"""
lines AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
verses AS (SELECT doc_id * 1000000 + verse AS verse_id, doc_id, substr(source, 4)::INT + 1 AS book_num, verse, lang, text,
                  CASE WHEN verse % 7 = 0 THEN doc_id * 1000000 + verse + 1 END AS bridge_end
           FROM (SELECT doc_id, lang, source, unnest(range(1, len(l) + 1)) AS verse, unnest(l) AS text FROM lines))"""
WORDS_SQL = VERSES_SQL + r""",
words AS (SELECT verse_id, doc_id, book_num, verse, lang, word_num, surface, lower(surface) AS lemma
          FROM (SELECT verse_id, doc_id, book_num, verse, lang, unnest(range(1, len(w) + 1)) AS word_num, unnest(w) AS surface
                FROM (SELECT *, regexp_extract_all(text, '\p{L}+') AS w FROM verses)))"""


def query(oracle: str | None = None, needs: str = "") -> Callable:
    """Register a query under its function's name; needs ('verses' or 'words') puts the model before the oracle's SQL.

    The oracle either begins with SELECT or with further common table expressions, the first without WITH.
    """

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            sql = oracle.strip()
            model = {"": "", "verses": VERSES_SQL, "words": WORDS_SQL}[needs]
            if model:
                sql = f"WITH {model.strip()}{' ' if sql.upper().startswith('SELECT') else ', '}{sql}"
            ORACLES[f.__name__] = sql
        return f

    return register
