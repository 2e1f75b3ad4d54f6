"""Best-fit packing by bin completion.

Documents become token pieces of at most ``capacity`` ids. What decides a packing is only how many pieces
there are of each length, so the branch-and-bound runs on that histogram (at most ``capacity`` entries, whatever
the corpus size) and yields filling patterns with multiplicities; pieces are then dealt to the patterns' places
by their rank within their length, as a distributed job.

Edge cases: a null or empty text is a piece of one token (the end id); repeated rows, rows without an id and rows that share
one are packed each; pieces of equal length take their places in any order; a very long text is cut into as many pieces as it
needs, in the task that reads it; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_batches, materialize, releases, with_rank

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Nodes of the search for a packing with fewer bins, which ends sooner where the packing is proved the best. Nodes and not time, so
#: that the same documents are always packed alike.
NODES = 3_000_000
#: Words, whose merges cost most, and blank-separated strings that a worker keeps ids of (twice that at most), and the longest kept.
WORD_CACHE, STRING_CACHE, LONGEST = 200_000, 20_000, 64
#: The characters for which lower() is the vocabulary's normalization, what parts strings, and contractions that it splits off.
PLAIN = "!-~\u00a1-\u024f"
BLANKS = " \n\t\r"
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]


def _splitter() -> re.Pattern:
    """How the vocabulary splits lower-cased plain text before its merges: contractions, runs of letters, single digits, runs of other characters."""
    plain = re.compile(f"[{PLAIN}]")
    lowered = sorted({x for c in map(chr, range(0x250)) if plain.match(c) for x in c.lower()})
    letters, digits = ("".join(re.escape(c) for c in lowered if unicodedata.category(c)[0] == kind) for kind in "LN")
    return re.compile("|".join([*CONTRACTIONS, f"[{letters}]+", f"[{digits}]", f"[^\\s{letters}{digits}]+"]))


class _Kept(dict):
    """Ids of strings in two generations: what the younger one lacks is looked up in the older, which goes when the younger is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, found: Iterable[str]) -> list[str]:
        new = [x for x in found if x not in self]
        older = self.older
        if older:
            self.update((x, older[x]) for x in new if x in older)
            new = [x for x in new if x not in self]
        return new

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class _Encoder:
    """Ids of texts as little-endian uint32, as the tokenizer gives them, with those of frequent words kept.

    A plain text is split as the tokenizer splits it and its unknown words are encoded in one call: each word ends with the
    only token that may end one. Blanks end tokens of this vocabulary, so of any other text what stands between blanks is
    encoded by itself, by the tokenizer whole; so is a text that holds an added token, as none of them has a blank.
    as_text: added tokens in a text are encoded like any other characters, not as themselves.
    """

    def __init__(self, path: str, as_text: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.begins = {c for t in added for c in (t[:1].lower(), t[:1].upper())}
        self.plain = re.compile(f"[{BLANKS}{PLAIN}]*").fullmatch
        self.split = _splitter().findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.strings = _Kept(WORD_CACHE), _Kept(STRING_CACHE)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, new: list[str]) -> None:
        ids = np.asarray(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(new):
            self.words.update(zip(new, self._whole(new), strict=True))
            return
        data = ids.tobytes()
        self.words.update((word, data[a:b]) for word, a, b in zip(new, [0, *ends], ends, strict=False))

    def _is_plain(self, text: str) -> bool:
        return bool(self.plain(text)) and not (any(c in text for c in self.begins) and self.added.search(text))

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        plain = [self._is_plain(t or "") for t in texts]
        parts = [self.split((t or "").lower()) if p else re.split(f"[{BLANKS}]", t) for t, p in zip(texts, plain, strict=True)]
        long = []
        for kept, learn, mine in (
            (self.words, self._learn, True), (self.strings, lambda new: self.strings.update(zip(new, self._whole(new), strict=True)), False),
        ):
            kept.trim()
            new = kept.missing(set().union(*(x for x, p in zip(parts, plain, strict=True) if p is mine)))
            if new:
                learn(new)
                long += [(kept, x) for x in new if len(x) > LONGEST]
        for x, p in zip(parts, plain, strict=True):
            yield b"".join(map((self.words if p else self.strings).__getitem__, x))
        for kept, x in long:
            del kept[x]


_encoders: dict[tuple[str, bool], _Encoder] = {}
releases[__name__] = _encoders.clear


def encode(texts: list[str | None], path: str, as_text: bool = True) -> Iterator[bytes]:
    """Ids of texts; as_text: see _Encoder. Packing takes the tokenizer as its file has it."""
    if (path, as_text) not in _encoders:
        _encoders[path, as_text] = _Encoder(path, as_text)
    return _encoders[path, as_text](texts)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """docs (doc_id, text) as pieces of at most capacity ids: doc_id, piece, start, length, ids_crc32."""
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            rows = []
            for doc_id, data in zip(ids.to_pylist(), encode(texts, tokenizer_path, as_text=False), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            doc, piece, start, length, crc = zip(*rows, strict=True)
            yield pa.record_batch(
                [
                    pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECES)


class OutOfNodes(Exception):
    """The search has used up its nodes."""


def _reach(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each place in lengths a bitset of the sums up to room that the lengths from there on can make, within counts."""
    mask = (1 << room + 1) - 1
    out = [1]
    for x in reversed(lengths):
        bits, left, step = out[-1], min(counts[x], room // x), 1
        while left > 0:
            take = min(step, left)
            bits |= bits << take * x
            left, step = left - take, 2 * step
        out.append(bits & mask)
    return out[::-1]


def _summing(lengths: list[int], counts: dict[int, int], reach: list[int], total: int) -> Iterator[tuple[int, ...]]:
    """All ways to make total from lengths (falling) within counts, those of the largest lengths first."""
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, total, ())]
    falling = [-x for x in lengths]
    while stack:
        i, rest, used = stack.pop()
        if not rest:
            yield used
            continue
        i = max(i, bisect.bisect_left(falling, -rest))
        x = lengths[i]
        for n in range(min(counts[x], rest // x) + 1):
            if reach[i + 1] >> (rest - n * x) & 1:
                stack.append((i + 1, rest - n * x, used + (x,) * n))


def _smeared(bits: int, by: int) -> int:
    """bits and their copies moved up by 1 to by."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def dominated(used: tuple[int, ...], waste: int, spare: int) -> bool:
    """Whether a spare length (spare: their bitset) could be added to a filling, or take the place of one or more of its
    items and leave less room, or take the place of two or more that it equals."""
    one, many = 0, 0
    for x in used:
        many |= (many << x) | (one << x)
        one |= 1 << x
    better = _smeared(many, waste)
    if waste:
        better |= _smeared((one | 1) << 1, waste - 1)
    return bool(better & spare)


def fillings(room: int, counts: dict[int, int], most_waste: int, tick: Callable[[], None] = lambda: None) -> Iterator[tuple[int, tuple[int, ...]]]:
    """All undominated fillings of room from counts that leave most_waste at most, least waste first: (waste, lengths in falling order)."""
    lengths = sorted((x for x, n in counts.items() if n > 0 and x <= room), reverse=True)
    reach = _reach(lengths, counts, room)
    spare = sum(1 << x for x in lengths)
    for waste in range(min(room, most_waste) + 1):
        if reach[0] >> (room - waste) & 1:
            for used in _summing(lengths, counts, reach, room - waste):
                tick()
                gone = sum(1 << x for x in set(used) if used.count(x) == counts[x])
                if not dominated(used, waste, spare & ~gone):
                    yield waste, used


def least_bins(histogram: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound: items over half a bin have a bin each, and what can't stand beside them needs more.

    For each k the items of k and more count, those over capacity - k as whole bins; k = 0 is the bound by volume.
    """
    n = np.zeros(capacity + 2, np.int64)
    n[list(histogram)] = list(histogram.values())
    many, volume = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    k, half = np.arange(capacity // 2 + 1), capacity // 2
    alone = many[capacity] - many[capacity - k]
    large = many[capacity - k] - many[half]
    room = large * capacity - (volume[capacity - k] - volume[half])
    small = volume[half] - np.where(k > 0, volume[k - 1], 0)
    return int((alone + large + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: patterns with multiplicities."""
    open_bins: dict[int, list[list]] = {}
    rooms: list[int] = []
    for x in sorted(histogram, reverse=True):
        n = histogram[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                pattern, m = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
                per = min(room // x, -(-n // m)) if n >= m else 1
                take = min(m, n // per) if n >= per else 0
                if not take:
                    per, take = 1, min(m, n)
                if take < m:
                    _put(open_bins, rooms, room, [pattern, m - take])
                _put(open_bins, rooms, room - per * x, [pattern + (x,) * per, take])
                n -= take * per
            else:
                per = min(capacity // x, n)
                m = n // per
                _put(open_bins, rooms, capacity - per * x, [(x,) * per, m])
                n -= m * per
    return [(tuple(p), m) for bins in open_bins.values() for p, m in bins if m]


def _put(open_bins: dict, rooms: list, room: int, item: list) -> None:
    if room not in open_bins:
        open_bins[room] = []
        bisect.insort(rooms, room)
    open_bins[room].append(item)


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in falling order) with multiplicities that use up the histogram in as few bins as the search finds.

    Depth first with limited discrepancy: the largest remaining length is completed by its undominated fillings, least
    waste first, as often as counts allow, or once; the j-th choice of a node costs j of a path's discrepancies, of which
    there are 0, 1, 2, 4 and so on until no choice is left out. A branch ends when its waste and the volume that is left need
    as many bins as the incumbent has. The incumbent is best-fit decreasing until a completion is as good. The search
    ends when the incumbent meets the lower bound or the tree is exhausted, and both prove it the best, or after so many ``nodes``.
    """
    total = sum(x * n for x, n in histogram.items())
    start = {x: n for x, n in histogram.items() if n}
    if not start:
        return []
    best = best_fit(histogram, capacity)
    # A completion with as many bins takes the place of best-fit's packing.
    limit, bound = sum(m for _, m in best) + 1, least_bins(start, capacity)
    left = iter(range(nodes))

    def tick() -> None:
        if next(left, None) is None:
            raise OutOfNodes

    def choice(counts: dict[int, int], most_waste: int, k: int) -> tuple[int, tuple[int, ...], int] | None:
        """(waste, pattern, how often) of the k-th choice of an open decision."""
        largest = max(counts)
        rest = dict(counts)
        rest[largest] -= 1

        def every() -> Iterator[tuple[int, tuple[int, ...], int]]:
            for lost, filling in fillings(capacity - largest, rest, most_waste, tick):
                pattern = (largest, *filling)
                times = min(counts[x] // pattern.count(x) for x in set(pattern))
                yield lost, pattern, times
                if times > 1:
                    yield lost, pattern, 1

        return next(itertools.islice(every(), k, None), None)

    # One set of counts serves all decisions; a decision is [bins, waste, discrepancies left, choices tried, its pattern, how often].
    counts = dict(start)
    try:
        allowed = 0
        while limit > bound:
            left_out = False
            stack: list[list] = [[0, 0, allowed, 0, (), 0]]
            while stack:
                tick()
                node = stack[-1]
                used, waste, spare, tried, pattern, times = node
                for x in pattern:
                    counts[x] = counts.get(x, 0) + times
                node[4] = ()
                slack = (limit - 1) * capacity - total - waste
                found = choice(counts, slack, tried) if tried <= spare and slack >= 0 else None
                if found is None:
                    left_out |= tried > spare
                    stack.pop()
                    continue
                lost, pattern, times = found
                times = min(times, slack // lost) if lost else times
                for x in pattern:
                    counts[x] -= times
                    if not counts[x]:
                        del counts[x]
                node[3:] = tried + 1, pattern, times
                used, waste = used + times, waste + lost * times
                if not counts:
                    if used < limit:
                        limit, best = used, [(n[4], n[5]) for n in stack]
                        if limit <= bound:
                            break
                elif used + -(-(total - used * capacity + waste) // capacity) < limit:
                    stack.append([used, waste, spare - tried, 0, (), 0])
            if not left_out:
                break
            allowed = max(1, 2 * allowed)
    except OutOfNodes:
        pass
    return best


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, nodes: int = NODES) -> DataFrame:
    """One row for each piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of full length have a sequence of their own; the others share sequences by ``complete_bins``.
    """
    spark = docs.sparkSession
    # Each piece gets a number of its own, so that any number of rows without an id, or with the same, can be dealt out.
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    plan = [((capacity,), full)] * bool(full) + complete_bins(histogram, capacity, nodes)
    # By length: first rank, places in each bin, first sequence, first offset.
    places, seen, sequence = defaultdict(list), Counter(), 0
    for pattern, times in plan:
        offset = 0
        for x in dict.fromkeys(pattern):
            k = pattern.count(x)
            places[x].append((seen[x], k, sequence, offset))
            seen[x] += k * times
            offset += k * x
        sequence += times
    by_length = {x: np.array(p, np.int64) for x, p in places.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = order[a:b]
                runs = by_length[int(length[rows[0]])]
                run = runs[np.searchsorted(runs[:, 0], rank[rows], "right") - 1]
                at, among = np.divmod(rank[rows] - run[:, 0], run[:, 1])
                seq[rows], off[rows] = run[:, 2] + at, run[:, 3] + among * length[rows]
            yield pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    if not histogram and not full:
        return spark.createDataFrame([], PIECES + ", sequence_id long, offset long")
    ranked = with_rank(pieces, ["length"], ["row"], "rank", full + sum(histogram.values()))
    return map_batches(ranked, place, PIECES + ", sequence_id long, offset long")
