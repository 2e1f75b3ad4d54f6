"""Terminal escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control sequences (CSI; OSC, DCS, SOS, PM, APC; charset and other short escapes) and control characters but TAB and LF.
CONTROL = (
    r"(?s)\x1b\[[^\x40-\x7e]*(?:[\x40-\x7e]|\z)|\x1b[\]PX^_](?:(?!\x07|\x1b\\).)*(?:\x07|\x1b\\|\z)"
    r"|\x1b[\x20-\x2f]+[\x30-\x7e]?|\x1b.|\x1b\z|[\x00-\x08\x0b-\x1f\x7f-\x9f]"
)


def strip_control(text: Column) -> Column:
    """text without terminal escapes and control characters; an unterminated sequence ends the text."""
    return F.when(text.rlike(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"), F.regexp_replace(text, CONTROL, "")).otherwise(text)
