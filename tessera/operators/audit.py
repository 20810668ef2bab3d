"""Verdicts on logged SQL statements: read-only or not, and why."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that write, and words a statement may start with.
WRITING = (
    "INSERT UPDATE DELETE CREATE DROP ALTER COPY ATTACH INSTALL LOAD EXPORT VACUUM PRAGMA"
).split()
READING = "SELECT WITH DESCRIBE SHOW".split()

# Ways out of the catalog that a plain SELECT has in Spark.
ESCAPES = "reflect java_method try_reflect".split()
FORMATS = "parquet orc csv json text avro xml binaryFile delta".split()

_QUOTED = (
    r"'(?:[^'\\]|\\.|'')*+'?+"
    r'|"(?:[^"\\]|\\.|"")*+"?+'
    r"|`(?:[^`]|``)*+`?+"
)


def _cleaned(sql: Column) -> Column:
    """Quoted text becomes a blank, a comment its opening mark.

    Both are matched by one expression from left to right, so a quote inside a
    comment and a comment inside quotes each count as what they are.
    """
    marked = F.regexp_replace(sql, rf"(?:{_QUOTED})|(?:(--)[^\n]*)|(?:(/[*])(?s:.*?)[*]/)", " $1$2")
    return marked


def refusal(sql: Column) -> Column:
    """NULL for an acceptable statement, else the reason to refuse it."""
    text = F.rtrim(_cleaned(sql))
    body = F.regexp_replace(text, r"\s*;\z", "")
    words = "|".join(WRITING)
    paths = rf"(?i)\b(?:{'|'.join(FORMATS)})\s*[.]\s*`"
    return (
        # The mark of a comment that never ends is left without its end.
        F.when(text.rlike(r"/[*]") & ~F.regexp_replace(sql, _QUOTED, " ").rlike(r"(?s)/[*].*?[*]/"), "invalid comment")
        .when(text.rlike(r"--|/[*]"), "comment")
        .when(body.contains(";"), "second statement")
        .when(text.rlike(rf"(?i)\b(?:{words})\b"), "write statement")
        .when(~text.rlike(rf"(?i)\A\s*(?:{'|'.join(READING)})\b"), "not a query")
        .when(text.rlike(rf"(?i)\b(?:{'|'.join(ESCAPES)})\s*[(]"), "function not allowed")
        .when(sql.rlike(paths), "path not allowed")
    )


def audit(statements, column: str = "sql"):
    """Adds ``verdict`` (accepted or refused) and ``reason`` per statement."""
    reason = refusal(F.col(column))
    judged = statements.withColumn("reason", reason)
    return judged.withColumn("verdict", F.when(F.col("reason").isNull(), "accepted").otherwise("refused"))
