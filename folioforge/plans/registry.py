"""The registered queries, their SQL twins, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def blocks_of(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks, each id once."""
    return table(spark, d, "text_blocks").dropDuplicates(["id"])


def tables_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "table_blocks").dropDuplicates(["id"])


def images_of(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of tables as image blocks: the only images among the test tables."""
    t = tables_of(spark, d).where("image_path is not null")
    return t.select("id", "doc_id", "page", F.col("image_path").alias("file_path"), F.col("name").alias("caption"), "section", "category", "role", "bbox", "extra")


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["id"])


BLOCKS = "(SELECT DISTINCT ON (id) * FROM text_blocks)"
TABLES = "(SELECT DISTINCT ON (id) * FROM table_blocks)"
CHUNKS = "(SELECT DISTINCT ON (id) * FROM chunks)"


def any_of(col: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"

_OUTER = r"[\s\x0b\p{Z}\x1c-\x1f\x85]+"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_OUTER}|{_OUTER}$', '', 'g')"


def sql_between_thai(x: str, gap: str) -> str:
    """``gap`` between Thai letters dropped. A letter may end one match and begin the next, so it takes two passes."""
    for _ in range(2):
        x = f"regexp_replace({x}, '([฀-๿]){gap}([฀-๿])', '\\1\\2', 'g')"
    return x


def sql_thai_spacing(x: str) -> str:
    squeezed = f"regexp_replace({sql_between_thai(x, '[ \\t]+')}, '[ \\t]+', ' ', 'g')"
    return sql_strip(f"regexp_replace({squeezed}, '\\n\\s*\\n+', chr(10) || chr(10), 'g')")


def sql_printable(x: str) -> str:
    gone = r"[\x00-\x09\x0b-\x1f\x7f-\x9f\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\p{Cf}\p{Co}\p{Zl}\p{Zp}]"
    return sql_strip(f"regexp_replace(regexp_replace(regexp_replace({x}, '{gone}', '', 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g')")


def sql_shift_years(x: str, delta: int) -> str:
    moved = f"CASE WHEN regexp_matches(p, '^[0-9]{{4}}$') AND TRY_CAST(p AS INT) BETWEEN 2400 AND 2700 THEN CAST(TRY_CAST(p AS INT) + {delta} AS VARCHAR) ELSE p END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[0-9]{{4}}|[0-9]{{1,3}}|[^0-9]+'), lambda p: {moved}), '')"
