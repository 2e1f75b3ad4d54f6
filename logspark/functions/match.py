"""Patterns: what a user types, compiled to one regular expression that Spark runs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LONGEST = 512


@dataclass(frozen=True)
class Pattern:
    """mode: word (literal, as a whole word), wildcard (``*`` and ``?`` within a path part, ``[...]``) or regex."""

    text: str
    mode: str = "word"
    case_sensitive: bool = False

    @property
    def blank(self) -> bool:
        return not self.text.strip()

    @property
    def regex(self) -> str:
        text = self.text.strip()
        if self.mode == "regex":
            body = text
        elif self.mode == "wildcard":
            body = "".join("[^/]*" if p == "*" else "[^/]" if p == "?" else "[" + ("^" + p[2:-1] if p[1] == "!" else p[1:-1]).replace("\\", "\\\\").replace("[", "\\[") + "]" if len(p) > 2 and p[0] == "[" else re.escape(p) for p in re.findall(r"\[!?[^\]]+\]|[*?]|[^*?\[]+|\[", text))
        else:
            word = re.compile(r"[A-Za-z0-9_]")
            body = r"(?<![A-Za-z0-9_])" * bool(word.match(text[:1])) + re.escape(text) + r"(?![A-Za-z0-9_])" * bool(word.match(text[-1:]))
        return "(?d)" + "(?iu)" * (not self.case_sensitive) + body

    def problem(self, spark: SparkSession) -> str:
        """Why the pattern can't be used; '' if it can. A blank pattern is valid and finds nothing."""
        if len(self.text.strip()) > LONGEST:
            return f"longer than {LONGEST} characters"
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(self.regex)
        except Exception as e:
            return str(e.java_exception.getDescription()) if hasattr(e, "java_exception") else str(e)
        return ""

    def check(self, spark: SparkSession) -> Pattern:
        if said := self.problem(spark):
            raise ValueError(f"pattern {self.text[:40]!r}: {said}")
        return self


def literal(cell: Column, pattern: Pattern) -> Column | None:
    """A cheap test that every match of a word pattern passes; None where there is none."""
    text = pattern.text.strip()
    if pattern.mode != "word" or not text.isascii():
        return None
    if pattern.case_sensitive:
        return cell.contains(text)
    # Some letters beyond ASCII fold to letters within, so cells that hold any are left to the pattern.
    return F.lower(cell).contains(text.lower()) | (F.octet_length(cell) != F.length(cell))


def matches(cell: Column, pattern: Pattern) -> Column:
    """At least one match, which may be empty; false for a blank pattern."""
    if pattern.blank:
        return F.lit(False)
    whole, first = cell.rlike(pattern.regex), literal(cell, pattern)
    return F.coalesce(whole if first is None else first & whole, F.lit(False))


def finds(cell: Column, pattern: Pattern) -> Column:
    """At least one match that is not empty."""
    if pattern.blank:
        return F.lit(False)
    return F.coalesce(F.exists(F.regexp_extract_all(cell, F.lit(f"({pattern.regex})"), 1), lambda m: F.length(m) > 0), F.lit(False))


def match_ranges(cell: Column, pattern: Pattern, limit: int = 200) -> Column:
    """Array of (start, length) of the first matches that are not empty, in code points from 0.

    The pieces between matches and the matches alternate, so running lengths give the places; Spark's split drops no piece.
    """
    kind = "array<struct<start:int,length:int>>"
    if pattern.blank:
        return F.array().cast(kind)
    found = F.regexp_extract_all(cell, F.lit(f"({pattern.regex})"), 1)
    between = F.split(cell, pattern.regex, -1)
    pairs = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(found, F.length).alias("n"))
    if pattern.mode == "word":
        # None is empty, so no more of them are looked at than are kept.
        pairs = F.slice(pairs, 1, limit)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    step = lambda a, p: F.struct(
        (a["at"] + p["gap"] + F.coalesce(p["n"], F.lit(0))).alias("at"),
        F.when(
            F.coalesce(p["n"], F.lit(0)) > 0, F.concat(a["out"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), p["n"].alias("length")))),
        ).otherwise(a["out"]).alias("out"),
    )
    return F.slice(F.aggregate(pairs, start, step, lambda a: a["out"]), 1, limit)
