"""URL filter: glob rules as one bit-parallel automaton.

Every rule is a glob over the canonical URL; all rules are packed into one multiword bit mask, and each character of
a URL advances all rules at once: shift, and with the character's mask, keep the loops of wildcards (Shift-And). A
batch's URLs advance together, one character position at a time, and leave the batch as soon as no rule can change.

Globs: ``*`` is any run without ``/``, ``**`` any run, every other character itself.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; hosts and paths of any
length are read whole; repeated URLs are judged each; an empty table gives no rows; rules may be empty (all URLs get
the default verdict); other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Characters of a URL have masks of their own up to this code; the others share one, as no rule names them.
CODES = 128


@dataclass(frozen=True)
class Rule:
    """verdict for URLs of host and its subdomains whose path starts with path; written host + path without its first slash doubled."""

    verdict: str
    text: str

    @property
    def glob(self) -> str:
        host, slash, path = self.text.partition("/")
        return f"*.{host}{slash}{path}**"


class Automaton:
    """Globs as bits: for each glob a start bit and one bit a character; bit b is set when the first b characters fit."""

    def __init__(self, globs: list[str]):
        parsed = []
        for glob in globs:
            cells, loops, i = [], {}, 0
            while i < len(glob):
                if glob[i] == "*":
                    wide = glob[i : i + 2] == "**"
                    loops[len(cells)] = loops.get(len(cells), False) or wide
                    i += 1 + wide
                else:
                    if ord(glob[i]) >= CODES:
                        raise ValueError(f"a rule may hold ASCII only: {glob!r}")
                    cells.append(glob[i])
                    i += 1
            parsed.append((cells, loops))
        bits = sum(len(c) + 1 for c, _ in parsed)
        self.words = max(1, -(-bits // 64))
        step, loop = np.zeros((CODES + 1, bits), bool), np.zeros((CODES + 1, bits), bool)
        start, final = np.zeros(bits, bool), np.zeros(bits, bool)
        self.final_bits, at = [], 0
        for cells, loops in parsed:
            start[at] = True
            for k, c in enumerate(cells, 1):
                step[ord(c), at + k] = True
            for k, wide in loops.items():
                loop[:, at + k] = True
                if not wide:
                    loop[ord("/"), at + k] = False
            at += len(cells) + 1
            final[at - 1] = True
            self.final_bits.append(at - 1)
        self.step, self.loop, self.start, self.final = (self._pack(x) for x in (step, loop, start, final))
        #: Bits that no later character can clear: those of a trailing ``**``.
        self.settled = np.bitwise_and.reduce(self.loop) & self.final

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        full = np.zeros((*bits.shape[:-1], self.words * 64), bool)
        full[..., : bits.shape[-1]] = bits
        return np.packbits(full, axis=-1, bitorder="little").view("<u8")

    def run(self, texts: list[str]) -> np.ndarray:
        """For each text and glob: whether the glob fits the whole text."""
        codes = [np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), CODES).astype(np.uint8) for t in texts]
        lengths = np.array([len(c) for c in codes], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(codes) else lengths
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint8)
        state = np.tile(self.start, (len(texts), 1))
        live, at = np.flatnonzero(lengths > 0), 0
        while len(live):
            c = flat[starts[live] + at]
            s = state[live]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            s = (moved & self.step[c]) | (s & self.loop[c])
            state[live] = s
            at += 1
            live = live[(lengths[live] > at) & (s & ~self.settled).any(axis=1)]
        ends = np.array(self.final_bits, np.int64)
        return ((state[:, ends // 64] >> (ends % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id_column, host, path, rule, verdict for each row of pages: the longest rule that fits decides, the default if none does.

    rules are a fixed list of the caller's; their masks travel with the task.
    """
    automaton = Automaton([r.glob for r in rules])
    longest_first = sorted(range(len(rules)), key=lambda k: (-len(rules[k].text), rules[k].text))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(rules[k].text for k in longest_first), None], object)
        verdicts = np.array([*(rules[k].verdict for k in longest_first), default], object)
        for batch in batches:
            # A dot before the host makes a host its own subdomain.
            texts = [f".{h}{p}" if h or p else "" for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            fits = np.ones((len(texts), len(rules) + 1), bool)
            fits[:, :-1] = automaton.run(texts)[:, longest_first]
            first = fits.argmax(axis=1)
            yield pa.record_batch(
                [
                    batch.column(id_column), batch.column("host"), batch.column("path"), pa.array(names[first], pa.string()),
                    pa.array(verdicts[first], pa.string()),
                ],
                names=[id_column, "host", "path", "rule", "verdict"],
            )

    parts = pages.select(id_column, host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    kind = parts.schema[id_column].dataType.simpleString()
    return map_batches(parts, decide, f"{id_column} {kind}, host string, path string, rule string, verdict string")
