"""Format detection: scores of every format on the head of each file, and what parsers learn there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formats as X

SAMPLE = 200
#: A format must score at least this to be chosen over the generic one.
LEAST_SCORE = 60


class FormatMismatch(ValueError):
    """Files of different formats were opened together."""


def sample_head(lines: DataFrame, n: int = SAMPLE) -> DataFrame:
    return lines.where(F.col("line_no") <= n)


def _heads(lines: DataFrame) -> DataFrame:
    """source_idx, source_name and sample, of lines or of files whose heads are read (sources.lines.read_heads)."""
    if "sample" in lines.columns:
        return lines.select("source_idx", "source_name", "sample")
    return sample_head(lines).groupBy("source_idx", "source_name").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"],
    ).alias("sample"))


def _score(f: X.FormatSpec) -> Column:
    if f.score:
        return f.score()
    return X.share(X.count(f.line_probe)) if f.line_probe else F.lit(0)


def probe_formats(lines: DataFrame) -> DataFrame:
    """source_idx, source_name and score_<format>, from 0 to 100, for every format."""
    return _heads(lines).select("source_idx", "source_name", *(_score(f).cast("int").alias(f"score_{f.id}") for f in X.REGISTRY))


def learn(lines: DataFrame, format: str) -> DataFrame | None:
    """What the format's parser needs to know of each source's head, by source_idx; None if nothing."""
    spec = X.find_format(format)
    return _heads(lines).select("source_idx", *(c.alias(name) for name, c in spec.learn().items())) if spec.learn else None


def scores(lines: DataFrame) -> DataFrame:
    """source_idx, source_name, format_id, score: one row for each source and format."""
    probed = probe_formats(lines)
    pairs = F.array(*(F.struct(F.lit(f.id).alias("format_id"), F.col(f"score_{f.id}").alias("score")) for f in X.REGISTRY))
    return probed.select("source_idx", "source_name", F.explode(pairs).alias("p")).select("source_idx", "source_name", "p.*")


def detect_format(lines: DataFrame, format: str = "auto") -> DataFrame:
    """source_idx, source_name, format_id, score. The highest score wins, ties go to the earlier format, and scores under 60 to
    the generic one. A named format is taken as it is."""
    probed = probe_formats(lines)
    if format not in ("", "auto"):
        chosen, score = F.lit(X.find_format(format).id), F.col(f"score_{format}")
    else:
        best = F.greatest(*(F.struct(
            F.col(f"score_{f.id}").alias("score"), F.lit(-k).alias("k"), F.lit(f.id).alias("id"),
        ) for k, f in enumerate(X.REGISTRY) if f.id != "generic"))
        chosen, score = F.when(best["score"] >= LEAST_SCORE, best["id"]).otherwise("generic"), best["score"]
    return probed.select("source_idx", "source_name", chosen.alias("format_id"), score.alias("score"))


def require_same_format(profile: DataFrame) -> str:
    """The one format of all sources; at most one row for each format comes to the driver."""
    found = profile.groupBy("format_id").agg(F.min("source_idx").alias("i")).orderBy("i").collect()
    if len(found) > 1:
        raise FormatMismatch("sources of different formats: " + " and ".join(X.find_format(r["format_id"]).name for r in found))
    return found[0]["format_id"] if found else "generic"
