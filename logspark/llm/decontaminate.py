"""Benchmark decontamination by template canonicalisation.

A text becomes a template: numbers, names and units turn into typed placeholders, other words are lower-cased. It is read
three ways: as plain lower-cased tokens, as a template in which a sentence's first word is a plain word, and as one in which
it is a name if it is capitalised. Windows of ``WINDOW`` tokens of benchmark items and documents are hash-joined within a
reading; a Bloom filter, sized by the number of the benchmark's windows, lets only possible matches of the documents reach
the join, which compares whole windows. Along a diagonal of one document and item, a window goes if one of its slots maps
to a value that less than half of its role's places map to (a name's role is the name; a number's or unit's the value and
the token after it), unless that is the item's own value. That catches questions with other numbers or names and leaves
alone texts that only share a form.

Windows count by the place of their first token in the item's plain tokens, in whichever reading they match. Template windows
need ``LEAST_WORDS`` plain words, windows of plain tokens none: the share is of all places or of those with a template
window, whichever is more.

Items of equal texts are joined once and reported each. A window of many different items makes a row for each of them and each
document that has it: with such items, all of them are the document's leaks.

Edge cases: null and empty texts have no window and leak nothing; an item shorter than ``WINDOW`` tokens is one window
of its own length, if that is ``LEAST_WINDOW`` at least, and else cannot leak; repeated documents are reported once an id, as
are those without an id, together under a null id; items without an id likewise; texts that share an id count together; very
long texts are read whole; an empty table on either side gives no leaks; of the inputs only ids and texts are read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_batches, materialize, releases, window_hashes, word_hash, word_hashes

WINDOW, LEAST_WINDOW, LEAST_WORDS = 8, 5, 4
#: A document leaks an item if consistent windows cover this share of the item's, or so many windows lie on one diagonal,
#: or so many windows of plain tokens follow each other (13 tokens word for word).
COVERAGE, RUN, VERBATIM_RUN = 0.5, 20, 6
#: How a text is read: as plain tokens, or as a template with plain or with name-like first words of sentences.
LITERAL, TEMPLATE, INITIALS = 0, 1, 2
#: Bits of the Bloom filter for each window of the benchmark, and its smallest and largest size as a power of two (2 to 128 MB,
#: which is broadcast). A larger benchmark lets more through to the join, which is exact.
BITS_PER_WINDOW, LEAST_BITS, MOST_BITS = 16, 24, 30
#: Bits of one row of the filter on its way to the driver, as a power of two.
CHUNK_BITS = 20

#: Units of measure and number words that become placeholders.
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds lb lbs oz ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur mph kmh kb mb gb tb watt watts volt volts degree degrees celsius fahrenheit meter meters metre metres kilometer kilometers".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?:\n]|\d+(?:[.,:/]\d+)*|[%€$£°]")
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
_STOP = frozenset(".!?:\n")


def template(text: str | None, initials: bool = False) -> tuple[list[str], list[str | None]]:
    """Template tokens of a text and, for each, the slot's value (None for a plain word).

    A name is a capitalised word, not all capitals, that does not begin a sentence (with initials: that may begin one);
    neighbouring names of a sentence are one.
    """
    return _template(TOKEN.findall(text or ""), initials)[:2]


def _template(found: list[str], initials: bool) -> tuple[list[str], list[str | None], list[int]]:
    """Tokens, slot values and the place of each token's first word among the plain tokens."""
    tokens: list[str] = []
    values: list[str | None] = []
    starts: list[int] = []
    begins, first, at = True, False, -1
    for t in found:
        if t in _STOP:
            begins = True
            continue
        at += 1
        low = t.lower()
        value = low
        if t[0].isdigit() or low in NUMBER_WORDS:
            kind = NUM
        elif t in "%€$£°" or (tokens and tokens[-1] == NUM and low in UNITS):
            kind = UNIT
        elif (initials or not begins) and t[0] != low[0] and t[1:] == low[1:] and len(t) > 1:
            if tokens and tokens[-1] == NAME and not begins:
                # A sentence's first word may be no part of the name after it.
                values[-1] += f"\n{low}" if first and "\n" not in values[-1] else f" {low}"
                continue
            kind, first = NAME, begins
        else:
            kind, value = low, None
        tokens.append(kind)
        values.append(value)
        starts.append(at)
        begins = False
    return tokens, values, starts


def _kind(t: str) -> int:
    """A token's class: 0 plain word, 1 end of a sentence, 2 number, 3 currency or percent sign, 4 word of a unit, 5 capitalised, 6 both."""
    low = t.lower()
    if t in _STOP:
        return 1
    if t[0].isdigit() or low in NUMBER_WORDS:
        return 2
    if t in "%€$£°":
        return 3
    if t[0] != low[0] and t[1:] == low[1:] and len(t) > 1:
        return 6 if low in UNITS else 5
    return 4 if low in UNITS else 0


#: The low bits of a token's hash are left for its class.
CLASS = np.uint64(7)
#: Tokens whose hashes a worker keeps; twice that at most.
TOKEN_CACHE = 250_000


class _Tokens(dict):
    """A token's hash, lower-cased, with its class in the low bits, as eight bytes."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def __missing__(self, t: str) -> bytes:
        value = self.older.get(t)
        if value is None:
            value = (word_hash(t.lower()) & ~7 | _kind(t)).to_bytes(8, "little")
        if len(self) >= TOKEN_CACHE:
            self.older = dict(self)
            self.clear()
        self[t] = value
        return value

    def release(self) -> None:
        self.older = {}
        self.clear()


_tokens = _Tokens()
releases[__name__] = _tokens.release


def token_hashes(tokens: list[str]) -> np.ndarray:
    """Hashes of template tokens."""
    return word_hashes(tokens) & ~CLASS


def template_hashes(text: str | None) -> np.ndarray:
    """token_hashes of template(text)'s tokens, without making them."""
    return _reading_hashes(text)[TEMPLATE]


_SLOTS = [token_hashes([slot])[0] for slot in (NUM, UNIT, NAME)]


def _reading_hashes(text: str | None) -> list[np.ndarray]:
    """token_hashes of each reading's tokens."""
    return [h for h, _ in _hashes_of_texts([text])]


def _hashes_of_texts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each reading the token_hashes of all texts' tokens, one text after the other, and the text's number for each token."""
    held, sizes = [], []
    for t in texts:
        found = TOKEN.findall(t or "")
        held.append(b"".join(map(_tokens.__getitem__, found)))
        sizes.append(len(found))
    h, of = np.frombuffer(b"".join(held), "<u8"), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    kind = (h & CLASS).astype(np.int8)
    h = h & ~CLASS
    # What stood before the first token of a text is no part of it.
    begins = np.concatenate([[True], (kind[:-1] == 1) | (of[1:] != of[:-1])])[: len(h)]
    kept = kind != 1
    kind, h, of, begins = kind[kept], h[kept], of[kept], begins[kept]
    num = kind == 2
    after_num = np.concatenate([[False], num[:-1] & (of[1:] == of[:-1])])[: len(h)]
    unit = (kind == 3) | ((kind == 4) | (kind == 6)) & after_num
    capital = (kind >= 5) & ~unit
    slotted = h.copy()
    slotted[num], slotted[unit] = _SLOTS[0], _SLOTS[1]

    def named(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.where(name, _SLOTS[2], slotted)
        stays = ~name | begins | ~np.concatenate([[False], name[:-1]])[: len(h)]
        return out[stays], of[stays]

    return [(h, of), named(capital & ~begins), named(capital)]


def _readings(text: str | None, among: frozenset[int] = frozenset((LITERAL, TEMPLATE, INITIALS))) -> list[tuple[int, list[str], list[str | None], list[int]]]:
    """(reading, tokens, slot values, places among the plain tokens) of each reading that differs from those before it. Without TEMPLATE and
    INITIALS among those asked for, neither is made."""
    found = TOKEN.findall(text or "")
    literal = [t.lower() for t in found if t not in _STOP]
    if not among & {TEMPLATE, INITIALS}:
        return [(LITERAL, literal, [None] * len(literal), list(range(len(literal))))]
    plain, named = _template(found, False), _template(found, True)
    out = [(LITERAL, literal, [None] * len(literal), list(range(len(literal)))), (TEMPLATE, *plain)]
    return out if named == plain else [*out, (INITIALS, *named)]


def _who(value: str) -> str:
    """The name, without a sentence's first word before it."""
    return value.rpartition("\n")[2]


def _rich(values: list[str | None], size: int) -> np.ndarray:
    """For each window, whether it has enough plain words."""
    plain = np.concatenate([[0], np.cumsum([v is None for v in values])])
    return plain[size:] - plain[:-size] >= LEAST_WORDS


def _hash_list(tokens: list[str], size: int) -> np.ndarray:
    return window_hashes(token_hashes(tokens), size)


def windows_of_item(text: str | None) -> list[tuple]:
    """(reading, position, hash, window, slot values, their roles, their places, first, end, rich) of an item's windows; first
    to end are the places that the window stands for, rich tells whether a template window stands for the first."""
    read = _readings(text)
    n = len(read[0][1])
    last = max(0, n - WINDOW) + 1
    out, rich_places = [], np.zeros(last, bool)
    if n < LEAST_WINDOW:
        return out
    for reading, tokens, values, starts in read[::-1]:
        size = min(WINDOW, len(tokens))
        if size < LEAST_WINDOW:
            continue
        hashes = _hash_list(tokens, size).view(np.int64).tolist()
        rich = _rich(values, size).tolist()
        roles = [_who(v) if k == NAME and v else f"{v} {after}" for k, v, after in zip(
            tokens, values, [*(w or t for t, w in zip(tokens[1:], values[1:], strict=True)), ""], strict=True,
        )]
        for p, h in enumerate(hashes):
            if reading != LITERAL and not rich[p]:
                continue
            first, end = starts[p], starts[p + 1] if p + 1 < len(hashes) else last
            if reading != LITERAL:
                rich_places[first:end] = True
            slots = [k for k in range(p, p + size) if values[k] is not None]
            out.append((
                reading, p, h, " ".join(tokens[p : p + size]), [values[k] for k in slots], [roles[k] for k in slots], slots, first, end,
                bool(rich_places[first]),
            ))
    return out


def windows_of_document(text: str | None, sizes: list[int], keep, among: frozenset[int] = frozenset((LITERAL, TEMPLATE, INITIALS))) -> list[tuple]:
    """(reading, position, hash, window, slot values) of the windows of a document, in the readings among those given, that keep (a test
    of a hash array) lets through."""
    out = []
    for reading, tokens, values, _ in _readings(text, among):
        for size in sizes:
            if len(tokens) < size:
                continue
            hashes = _hash_list(tokens, size)
            ok = keep(hashes)
            if reading != LITERAL:
                ok = ok & _rich(values, size)
            for p in np.flatnonzero(ok).tolist():
                out.append((
                    reading, p, int(hashes[p : p + 1].view(np.int64)[0]), " ".join(tokens[p : p + size]),
                    [v for v in values[p : p + size] if v is not None],
                ))
    return out


WINDOW_FIELDS = {"reading": pa.int32(), "position": pa.int32(), "hash": pa.int64(), "window": pa.string(), "slots": pa.list_(pa.string())}
ITEM_FIELDS = WINDOW_FIELDS | {
    "roles": pa.list_(pa.string()), "places": pa.list_(pa.int32()), "first": pa.int32(), "end": pa.int32(), "rich": pa.bool_(),
}
WINDOW_SCHEMA = "reading int, position int, hash long, window string, slots array<string>"


def _arrow(ids: pa.Array, per_row: list[list], name: str, fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    counts = [len(r) for r in per_row]
    flat = [w for r in per_row for w in r]
    take = np.repeat(np.arange(len(counts)), counts)
    cols = list(zip(*flat, strict=True)) if flat else [[]] * len(fields)
    return pa.record_batch(
        [ids.take(pa.array(take, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, fields.values(), strict=True))], names=[name, *fields],
    )


def item_windows(texts: DataFrame) -> DataFrame:
    """item and the fields of windows_of_item, for texts (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in chunks(batches):
            yield _arrow(ids, [windows_of_item(t) for t in found], "item", ITEM_FIELDS)

    return map_batches(
        texts.select("item", "text"), run, f"item long, {WINDOW_SCHEMA}, roles array<string>, places array<int>, first int, end int, rich boolean",
    )


def bloom(items: DataFrame) -> np.ndarray:
    """Two bits for each window hash, as words of 32 bits, gathered in rows of 2 ** CHUNK_BITS bits."""
    hashes = items.select("hash").distinct()
    power = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, BITS_PER_WINDOW * hashes.count())))))
    mask = (1 << power) - 1
    slots = hashes.select(F.explode(F.array(
        F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask),
    )).alias("slot")).distinct()

    def gather(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << CHUNK_BITS, bool)
        bits[held["slot"].to_numpy() & ((1 << CHUNK_BITS) - 1)] = True
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros((1 << (power - CHUNK_BITS), 1 << (CHUNK_BITS - 5)), np.uint32)
    for r in slots.withColumn(
        "chunk", F.shiftright("slot", CHUNK_BITS),
    ).groupBy("chunk").applyInPandas(gather, "chunk long, bits binary").toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["bits"], "<u4")
    return out.reshape(-1)


def document_windows(docs: DataFrame, filter_bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """doc_id, reading, position, hash, window, slots of the windows that pass the filter, for each window size among the items'."""
    mask = np.uint64(32 * len(filter_bits) - 1)
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def has(slot: np.ndarray) -> np.ndarray:
        return (bits.value[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1)

    def keep(hashes: np.ndarray) -> np.ndarray:
        return has(hashes & mask) & has((hashes >> np.uint64(32)) & mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            # The texts' windows are looked up together; only texts with a hit are read word for word, and those without one in a template only plainly.
            hit = np.zeros((len(texts), 3), bool)
            for reading, (h, of) in enumerate(_hashes_of_texts(texts)):
                for size in sizes:
                    at = np.flatnonzero(keep(window_hashes(h, size)))
                    hit[of[at[of[at] == of[at + size - 1]]], reading] = True
            rows = [windows_of_document(t, sizes, keep, frozenset(np.flatnonzero(x).tolist())) if x.any() else [] for t, x in zip(texts, hit, strict=True)]
            yield _arrow(ids, rows, "doc_id", WINDOW_FIELDS)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, {WINDOW_SCHEMA}")


def kept_windows(reading: int, found: list[dict], run: int = RUN) -> tuple[list[tuple[dict, bool]], bool]:
    """(window, whether it holds the item's own values) of the consistent windows of one diagonal, and whether they leak by themselves."""
    if reading == LITERAL:
        at = sorted(w["position"] for w in found)
        longest = length = 1
        for x, y in itertools.pairwise(at):
            length = length + 1 if y == x + 1 else 1
            longest = max(longest, length)
        return [(w, True) for w in found], longest >= min(run, VERBATIM_RUN)
    mapped = {p: (r, _who(o)) for w in found for p, r, o in zip(w["places"], w["roles"], w["ours"], strict=True)}
    votes, places = Counter(mapped.values()), Counter(r for r, _ in mapped.values())
    kept = []
    for w in found:
        slots = [(r, o, t.replace("\n", " ") == o.replace("\n", " ")) for r, t, o in zip(w["roles"], w["theirs"], w["ours"], strict=True)]
        if all(own or 2 * votes[r, _who(o)] >= places[r] for r, o, own in slots):
            kept.append((w, all(own for _, _, own in slots)))
    return kept, len(kept) >= run


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """doc_id, item_id, windows (of the item, matched with consistent slots), item_windows, coverage, exact (all matched windows
    hold the item's own values) for each document that leaks an item of benchmark (item_id, text)."""
    texts = materialize(benchmark.select("text").where("text is not null").distinct().withColumn("item", F.monotonically_increasing_id()), "texts")
    members = materialize(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().join(texts, "text").select("item", "item_id"), "members",
    )
    items = materialize(item_windows(texts), "items")
    totals = materialize(
        items.where(F.col("reading") == LITERAL).groupBy("item").agg(
            F.countDistinct("position").alias("all_places"), F.countDistinct(F.when(F.col("rich"), F.col("position"))).alias("rich_places"),
        ),
        "totals",
    )
    sizes = sorted(r[0] for r in items.select(F.size(F.split("window", " "))).distinct().collect())
    hits = document_windows(docs, bloom(items), sizes).distinct()
    ours = items.withColumnRenamed("slots", "theirs").withColumnRenamed("position", "item_position")
    pairs = hits.join(ours, ["reading", "hash", "window"]).withColumn("diagonal", F.col("position") - F.col("item_position"))
    window = F.struct(F.col("item_position").alias("position"), "places", "roles", "theirs", F.col("slots").alias("ours"), "first", "end", "rich")
    # Along a diagonal an item has each window once, so these groups are as small as an item.
    along = pairs.groupBy("doc_id", "item", "diagonal", "reading").agg(F.collect_list(window).alias("found"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (reading, found) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                kept, alone = kept_windows(reading, found, run)
                rows += [(k, p, w["rich"], exact, alone) for w, exact in kept for p in range(w["first"], w["end"])]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            take = pa.array(list(cols[0]), pa.int64())
            yield pa.record_batch(
                [
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(list(cols[1]), pa.int32()),
                    *(pa.array(list(c), pa.bool_()) for c in cols[2:]),
                ],
                names=["doc_id", "item", "place", "rich", "exact", "alone"],
            )

    places = map_batches(
        along.select("doc_id", "item", "reading", "found"), judge, "doc_id long, item long, place int, rich boolean, exact boolean, alone boolean",
    )
    places = places.groupBy("doc_id", "item", "place").agg(*(F.max(c).alias(c) for c in ("rich", "exact", "alone")))
    out = places.groupBy("doc_id", "item").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("rich").alias("n_rich"), F.min("exact").alias("exact"), F.max("alone").alias("alone"),
    ).join(totals, "item")
    share = lambda n, of: F.struct(
        F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0).alias("coverage"), F.col(n).alias("windows"), F.col(of).alias("item_windows"),
    )
    out = out.withColumn("best", F.greatest(share("n", "all_places"), share("n_rich", "rich_places")))
    out = out.where((F.col("best.coverage") >= coverage) | F.col("alone"))
    return out.join(members, "item").select("doc_id", "item_id", "best.windows", "best.item_windows", "best.coverage", "exact")
