"""Parts of messages: terminal styles and embedded JSON, XML and YAML.

Both are jobs that a native test narrows to the rows that can hold such a part, before any row reaches Python.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions.ansi import CONTROL, strip_control

STYLE = "start int, length int, bold boolean, italic boolean, underline boolean, strike boolean, fg int, bg int, fg_rgb string, bg_rgb string"
_CONTROL = re.compile(CONTROL.replace(r"\z", r"\Z").replace("(?s)", ""), re.S)
_SGR = re.compile(r"\x1b\[([0-9;]*)m\Z")
_PLAIN = {"bold": False, "italic": False, "underline": False, "strike": False, "fg": -1, "bg": -1, "fg_rgb": "", "bg_rgb": ""}
_SWITCH = {
    1: ("bold", True), 3: ("italic", True), 4: ("underline", True), 9: ("strike", True), 22: ("bold", False), 23: ("italic", False),
    24: ("underline", False), 29: ("strike", False),
}


# The steps of the colour cube.
_STEPS = [0, 95, 135, 175, 215, 255]


def _indexed(n: int) -> str:
    """The colour of one of the 240 numbers above the first 16: a cube of six steps, then a ramp of greys."""
    if n >= 232:
        return "{0},{0},{0}".format(8 + (n - 232) * 10)
    return ",".join(str(_STEPS[(n - 16) // d % 6]) for d in (36, 6, 1))


def restyle(style: dict, codes: list[int]) -> dict:
    """style after a select-graphic-rendition sequence."""
    style, todo = dict(style), list(codes)
    while todo:
        c = todo.pop(0)
        if c == 0:
            style = dict(_PLAIN)
        elif c in _SWITCH:
            style[_SWITCH[c][0]] = _SWITCH[c][1]
        elif c in (38, 48):
            side = "fg" if c == 38 else "bg"
            if todo[:1] == [5] and len(todo) > 1:
                n = todo[1]
                del todo[:2]
                if 0 <= n < 16:
                    style |= {side: n, f"{side}_rgb": ""}
                elif n <= 255:
                    style |= {side: -1, f"{side}_rgb": _indexed(n)}
            elif todo[:1] == [2] and len(todo) > 3:
                style |= {side: -1, f"{side}_rgb": ",".join(str(max(0, min(255, x))) for x in todo[1:4])}
                del todo[:4]
        elif c in (39, 49):
            style |= {"fg": -1, "fg_rgb": ""} if c == 39 else {"bg": -1, "bg_rgb": ""}
        else:
            for low, side, base in ((30, "fg", 0), (40, "bg", 0), (90, "fg", 8), (100, "bg", 8)):
                if low <= c <= low + 7:
                    style |= {side: base + c - low, f"{side}_rgb": ""}
    return style


def spans_of(text: str) -> tuple[str, list[dict]]:
    """text without escapes, and its ranges that are not plain (start, length, style)."""
    plain, at, style, out, done = [], 0, dict(_PLAIN), [], 0
    for m in [*_CONTROL.finditer(text), None]:
        piece = text[done : m.start()] if m else text[done:]
        if piece and style != _PLAIN:
            if out and out[-1]["start"] + out[-1]["length"] == at and all(out[-1][k] == v for k, v in style.items()):
                out[-1]["length"] += len(piece)
            else:
                out.append({"start": at, "length": len(piece)} | style)
        plain.append(piece)
        at += len(piece)
        if m:
            done = m.end()
            if sgr := _SGR.match(m.group()):
                style = restyle(style, [int(x or 0) for x in sgr[1].split(";")])
    return "".join(plain), out


def styled_spans(raw: DataFrame, keys: list[str], text: str = "raw", message: str | None = None) -> DataFrame:
    """keys and the styled ranges of a text that still has its escapes, in code points; with message (a column that the
    cleaned text holds), of its first place there, clipped to it and counted from its beginning. A style holds until it is changed, over line ends too."""
    some = raw.where(F.col(text).contains("\x1b"))
    if message:
        at = F.position(F.col(message), strip_control(F.col(text)))
        some = some.withColumn("_from", at - 1).withColumn("_n", F.length(message)).where("_from >= 0 and _n > 0")
    else:
        some = some.withColumn("_from", F.lit(0)).withColumn("_n", F.lit(2_147_483_647))
    picked = some.select(*keys, F.col("_from").cast("int").alias("_from"), F.col("_n").cast("int").alias("_n"), F.col(text).alias("_text"))
    names = [x.split(" ")[0] for x in STYLE.split(", ")]
    types = [pa.int32(), pa.int32(), *[pa.bool_()] * 4, pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows = [], []
            for k, (skip, most, t) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_from", "_n", "_text")), strict=True)):
                for s in spans_of(t)[1]:
                    start, end = max(s["start"] - skip, 0), min(s["start"] + s["length"] - skip, most)
                    if end > start:
                        take.append(k)
                        rows.append(s | {"start": start, "length": end - start})
            yield pa.record_batch(
                [
                    *(b.column(c).take(pa.array(take, pa.int64())) for c in keys),
                    *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)),
                ],
                names=[*keys, *names],
            )

    kinds = ", ".join(f"{c} {picked.schema[c].dataType.simpleString()}" for c in keys)
    return picked.mapInArrow(run, f"{kinds}, {STYLE}")


def entry_spans(entries: DataFrame) -> DataFrame:
    """source_idx, entry_no and the styled ranges of the messages of entries that were read with their styles (read_logs, styles=True)."""
    return styled_spans(entries, ["source_idx", "entry_no"], "raw", "message")


# Snippets ------------------------------------------------------------------------------------------------------------

SHORTEST, LONGEST, MOST = 8, 2000, 4
_JSON_PART = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]"]', re.S)
_XML_PART = re.compile(r"<!--.*?-->|<!--|<[^>]*>|<", re.S)
# What begins a line of YAML.
_YAML_KEY = re.compile(r"^\s*(?:-\s+)?[A-Za-z_][A-Za-z0-9_.\-]*\s*:(?:\s|$)")
_YAML_ITEM = re.compile(r"^\s*-\s+\S")


def json_ends(text: str, start: int, ends: dict[int, int]) -> None:
    """Adds to ends, for the bracket at start and each one passed on the way to its partner, the end of what it opens, -1 if
    that is not closed; so no bracket is passed twice."""
    opened: list[int] = []
    for m in _JSON_PART.finditer(text, start):
        c = m.group()
        if c == '"':
            break
        if c in "{[":
            opened.append(m.start())
        elif c in "}]":
            ends[opened.pop()] = m.end()
            if not opened:
                return
    ends.update(dict.fromkeys(opened, -1))


def xml_ends(text: str, start: int, ends: dict[int, tuple[int, int]]) -> None:
    """Adds to ends, for the tag at start and each one passed on the way to its partner, the end of its element and the number of
    tags in it, (-1, 0) if it has none. A tag that closes itself goes on to the element after it."""
    tags: list[tuple[int, bool]] = []  # place, whether it stands alone
    opened: list[int] = []
    found: dict[int, tuple[int, int]] = {}
    for m in _XML_PART.finditer(text, start):
        tag = m.group()
        if tag in ("<", "<!--"):
            break
        if tag.startswith("<!--"):
            tags.append((m.start(), True))
            continue
        if tag.startswith("</"):
            if not opened:
                break
            k = opened.pop()
            found[k] = m.end(), len(tags)
            tags.append((m.start(), False))
            if not opened:
                break
        else:
            if not tag.endswith("/>"):
                opened.append(len(tags))
            tags.append((m.start(), tag.endswith("/>")))
    comments = [0]
    for place, _ in tags:
        comments.append(comments[-1] + text.startswith("<!--", place))
    end, last = -1, 0
    for k in range(len(tags) - 1, -1, -1):
        place, alone = tags[k]
        if not alone:
            end, last = found.get(k, (-1, 0))
        ends[place] = (end, last - k + 1 - (comments[last + 1] - comments[k])) if end > 0 else (-1, 0)


_BEGIN = re.compile(r"[{\[]|<[A-Za-z?!]")


def snippets_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of at most MOST fragments: JSON (with a colon or a comma) and XML in text order, then YAML."""
    out: list[tuple[str, int, int]] = []
    json_at: dict[int, int] = {}
    xml_at: dict[int, tuple[int, int]] = {}
    at = 0
    while len(out) < MOST and (m := _BEGIN.search(text, at)):
        start, kind, tags = m.start(), "json" if text[m.start()] != "<" else "xml", 2
        if kind == "json":
            if start not in json_at:
                json_ends(text, start, json_at)
            end = json_at[start]
        else:
            if start not in xml_at:
                xml_ends(text, start, xml_at)
            end, tags = xml_at.get(start, (-1, 0))
        fits = tags >= 2 and SHORTEST <= end - start <= LONGEST
        fits = fits and (kind == "xml" or text.find(":", start, end) >= 0 or text.find(",", start, end) >= 0)
        if fits:
            out.append((kind, start, end))
        at = end if fits else start + 1
    return out + yaml_blocks(text, [(s, e) for _, s, e in out])[: MOST - len(out)]


def yaml_blocks(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Runs of two lines or more that are YAML and lie outside of what is taken. A key is YAML; so is an item of a list of more than one
    character, or one of a single character that a key follows, as then it begins a mapping."""
    lines = text.split("\n")
    ends = list(itertools.accumulate((len(x) + 1 for x in lines), initial=0))
    keys = [bool(_YAML_KEY.match(x)) for x in lines] + [False]

    def is_yaml(k: int) -> bool:
        start, end = ends[k], ends[k + 1] - 1
        if any(s < end and e > start for s, e in taken):
            return False
        item = lines[k].strip() if _YAML_ITEM.match(lines[k]) else ""
        return keys[k] or len(item) > 3 or bool(item) and keys[k + 1]

    out = []
    for fits, run in itertools.groupby(range(len(lines)), is_yaml):
        block = list(run)
        start, end = ends[block[0]], ends[block[-1] + 1] - 1
        if fits and len(block) >= 2 and SHORTEST <= end - start <= LONGEST:
            out.append(("yaml", start, end))
    return out


TOKENS = {
    "json": re.compile(
        r'(?P<Key>"(?:[^"\\]|\\.)*"(?=\s*:)|[A-Za-z_][\w.\-]*(?=\s*:))|(?P<String>"(?:[^"\\]|\\.)*")|(?P<Constant>\b(?:true|false|null)\b)|(?P<Number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<Punctuation>[{}\[\],:])',
        re.S,
    ),
    "xml": re.compile(
        r"(?P<Comment><!--.*?-->)|(?P<TagName>(?<=<)[/?!]?[\w:.\-]+|(?<=</)[\w:.\-]+)|(?P<Key>[\w:.\-]+(?=\s*=))|(?P<AttributeValue>\"[^\"]*\"|'[^']*')|(?P<Punctuation></?|/?>)",
        re.S,
    ),
    "yaml": re.compile(
        r"(?P<Comment>(?<!\S)#[^\n]*)|(?P<Key>(?m:^)[ \t]*(?:-[ \t]+)?[A-Za-z_][\w.\-]*(?=\s*:))|(?P<String>\"[^\"\n]*\"|'[^'\n]*')|(?P<Constant>\b(?:true|false|null|yes|no)\b)|(?P<Number>(?<![\w.])[+-]?\d+(?:\.\d+)?(?![\w.]))|(?P<Punctuation>[:\-](?=\s|$))",
        re.S,
    ),
}


def tokens_of(kind: str, text: str) -> list[tuple[str, int, int]]:
    """(kind of token, start, length), in order."""
    out = []
    for m in TOKENS[kind].finditer(text):
        start = m.start() + len(m.group()) - len(m.group().lstrip(" \t-")) if kind == "yaml" and m.lastgroup == "Key" else m.start()
        out.append((m.lastgroup, start, m.end() - start))
    return out


def _candidates(entries: DataFrame, keys: list[str], message: str) -> DataFrame:
    some = F.col(message).rlike(r"[{\[]|<[A-Za-z?!]|\n")
    return entries.where(some & (F.length(message) >= SHORTEST)).select(*keys, F.col(message).alias("_text"))


def extract_snippets(entries: DataFrame, keys: list[str] = ("source_idx", "entry_no"), message: str = "message") -> DataFrame:
    """keys, kind, start, length, text of each fragment; offsets in code points."""
    keys, picked = list(keys), _candidates(entries, list(keys), message)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, kind, s, e - s, t[s:e]) for i, t in enumerate(b.column("_text").to_pylist()) for kind, s, e in snippets_of(t)]
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.record_batch(
                [
                    *(b.column(c).take(pa.array(list(cols[0]), pa.int64())) for c in keys),
                    *(pa.array(list(c), t) for c, t in zip(cols[1:], (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)),
                ],
                names=[*keys, "kind", "start", "length", "text"],
            )

    kinds = ", ".join(f"{c} {picked.schema[c].dataType.simpleString()}" for c in keys)
    return picked.mapInArrow(run, f"{kinds}, kind string, start int, length int, text string")


def snippet_tokens(snippets: DataFrame, keys: list[str] = ("source_idx", "entry_no")) -> DataFrame:
    """keys, token, start, length (in the message) of each token of extract_snippets' fragments."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, k, s + at, n) for i, (kind, at, t) in enumerate(zip(
                b.column("kind").to_pylist(), b.column("start").to_pylist(), b.column("text").to_pylist(), strict=True,
            )) for k, s, n in tokens_of(kind, t)]
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.record_batch(
                [
                    *(b.column(c).take(pa.array(list(cols[0]), pa.int64())) for c in keys),
                    *(pa.array(list(c), t) for c, t in zip(cols[1:], (pa.string(), pa.int32(), pa.int32()), strict=True)),
                ],
                names=[*keys, "token", "start", "length"],
            )

    picked = snippets.select(*keys, "kind", "start", "text")
    kinds = ", ".join(f"{c} {picked.schema[c].dataType.simpleString()}" for c in keys)
    return picked.mapInArrow(run, f"{kinds}, token string, start int, length int")
