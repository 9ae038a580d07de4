"""Matches of any pattern as a table function: for patterns that the JVM's expressions cannot run, such as look-behind of any width."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

MATCH = "start: int, end: int, value: string, groups: array<string>"


@udtf(returnType=MATCH, useArrow=True)
class PatternMatches:
    """Rows ``start, end, value, groups`` of a text's non-empty matches from left to right; places in code points, a group that did not take part is null.

    A match of no length is passed over.  Null texts or patterns have no rows.
    """

    def __init__(self) -> None:
        self.compiled: dict[str, object] = {}

    def eval(self, text: str, pattern: str) -> Iterator[tuple]:
        import regex

        if text is None or pattern is None:
            return
        if pattern not in self.compiled:
            if len(self.compiled) > 1000:
                self.compiled.clear()
            self.compiled[pattern] = regex.compile(pattern)
        for m in self.compiled[pattern].finditer(text):
            if m.end() > m.start():
                yield m.start(), m.end(), m.group(), list(m.groups())


def register(spark: SparkSession, name: str = "pattern_matches") -> None:
    """Makes the function known to SQL: ``SELECT ... FROM docs, LATERAL pattern_matches(docs.text, '...')``."""
    spark.udtf.register(name, PatternMatches)


def matches(docs: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """``docs``' columns with a row for each match of each named pattern: ``key, start, end, value, groups``.

    A lateral join, so rows stay in the task of their text; Spark hands texts to the workers in Arrow batches of bounded rows.  Patterns are of the ``regex`` module.
    """
    rules = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(p).alias("pattern")) for k, p in patterns.items()])
    each = docs.withColumn("_rule", F.explode(rules)).withColumn("key", F.col("_rule.key"))
    found = each.lateralJoin(PatternMatches(F.col(text).outer(), F.col("_rule.pattern").outer()))
    return found.drop("_rule")
