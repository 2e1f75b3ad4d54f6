"""Following logs: growing files as a stream, entries folded across micro-batches, counts that follow replaced files.

``TailSource`` is a stream source of growing files: it hands out bytes up to the last line end, so an unfinished line
waits; a file that shrinks or is replaced starts a new generation. ``follow_entries`` keeps, for each file, the entry that
may still grow; it is emitted when the next one begins or after a time without lines. ``level_changes`` takes back what a
replaced file counted.

What is appended to a file after the last poll before it is replaced is not seen. A generation is told by the file's first
line, so a file that is replaced by one with the same first line and is not smaller is taken for the same file.
"""

from __future__ import annotations

import fnmatch
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import replace
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logspark.functions import normalize as N
from logspark.functions.ansi import strip_control
from logspark.operators import formats as X
from logspark.operators.entries import parse_entries
from logspark.sources.event_xml import parsed_events
from logspark.sources.lines import HEAD_BYTES, WIDE, bound_batches, decode_line, encoding_of

#: How often files are looked at.
POLL = "300 milliseconds"
#: Bytes of a file in one input partition, and of its first line that tell its generation.
RANGE, FIRST_LINE = 4 << 20, 256
#: Most bytes of a file in one micro-batch, and bytes in which a line end is looked for at once.
PER_FILE, LOOK = 32 << 20, 65536
#: The counters of a generation that had no line for so long are dropped.
FORGET_MS = 24 * 3600 * 1000


class _Range(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int):
        self.path, self.generation, self.start, self.end = path, generation, start, end


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI names (local, HDFS, or an object store that Arrow knows), and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(system: fs.FileSystem, pattern: str) -> list[fs.FileInfo]:
    """The files that a pattern names; ``*`` and its like stand for parts of one name, in any part of the path."""
    parts = pattern.split("/")
    fixed = next((k for k, x in enumerate(parts) if re.search(r"[*?\[]", x)), len(parts))
    if fixed == len(parts):
        found = [system.get_file_info(pattern)]
    else:
        found = system.get_file_info(fs.FileSelector("/".join(parts[:fixed]) or "/", allow_not_found=True, recursive=fixed < len(parts) - 1))
    fits = lambda path: len(x := path.split("/")) == len(parts) and all(map(fnmatch.fnmatchcase, x[fixed:], parts[fixed:]))
    return sorted((f for f in found if f.type == fs.FileType.File and fits(f.path)), key=lambda f: f.path)


def _ends(data: bytes, wide: str | None, at: int) -> list[int]:
    """Places after line ends in data, which begins at byte ``at`` of its file: CR, LF and CRLF; LF in two-byte text."""
    if wide:
        end = "\n".encode(wide)
        return [m.end() for m in re.finditer(re.escape(end), data) if (at + m.start()) % 2 == 0]
    return [m.end() for m in re.finditer(rb"\r\n|\r|\n", data)]


def last_line_end(f: pa.NativeFile, start: int, end: int, wide: str | None = None) -> int:
    """The place after the last line end in [start, end); start if there is none. A CR at the very end may be half of CRLF and waits."""
    at = end
    while at > start:
        low = max(start, at - LOOK)
        f.seek(low)
        data = f.read(at - low + (1 if wide and at < end else 0))
        data = data[:-1] if at == end and data.endswith(b"\r") and not wide else data
        if found := _ends(data, wide, low):
            return low + found[-1]
        at = low
    return start


def first_line_end(f: pa.NativeFile, start: int, end: int, wide: str | None = None) -> int:
    """The place after the first line end in [start, end); start if there is none."""
    at = low = start
    while at < end:
        f.seek(low)
        data = f.read(min(end, at + LOOK) - low)
        data = data[:-1] if data.endswith(b"\r") and not wide else data
        if found := _ends(data, wide, low):
            return low + found[0]
        at = min(end, at + LOOK)
        # A line end may lie across two pieces.
        low = max(start, at - 2)
    return start


def head_of_file(f: pa.NativeFile) -> tuple[int, str]:
    """A number that tells a file with a finished line from another of the same name, of its first line; and its encoding."""
    f.seek(0)
    data = f.read(HEAD_BYTES)
    return zlib.crc32(re.split(rb"[\r\n]", data[:FIRST_LINE])[0]), encoding_of(data)


def _wide(encoding: str) -> str | None:
    return encoding if encoding in WIDE else None


class TailReader(DataSourceStreamReader):
    """Offsets are {path: [generation, bytes]} as a JSON value. A batch takes at most per_file bytes of a file, in whole lines.

    What was handed out is remembered. When a query starts, new or again, it is known from the folder progress, where each finished batch
    is noted; the note may be one batch late, so the first batch then is up to twice as large. Without that folder the first batch takes all
    that is there. Files that did not change since they were looked at are not opened.
    """

    def __init__(self, pattern: str, per_file: int = PER_FILE, progress: str | None = None):
        self.pattern, self.per_file, self.progress = pattern, per_file, progress
        self.at: dict | None = None
        self.looked: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, pattern = file_system(self.pattern)
        most = self.per_file
        if self.at is None and self.progress:
            self.at, most = self.noted() or {}, 2 * self.per_file
        found = {}
        for info in files_of(system, pattern):
            looks = (info.size, info.mtime_ns)
            known = self.looked.get(info.path)
            if known and known[0] == looks and known[3]:
                found[info.path] = [known[1], known[2]]
                continue
            with system.open_input_file(info.path) as f:
                generation, encoding = head_of_file(f)
                had, start = (self.at or {}).get(info.path, [generation, 0])
                start = start if had == generation and start <= info.size else 0
                upto = info.size if self.at is None else min(info.size, start + most)
                end = last_line_end(f, start, upto, _wide(encoding))
                if end == start and upto < info.size:
                    end = first_line_end(f, upto, info.size, _wide(encoding))
                    end = end if end > upto else start
            if end:
                found[info.path] = [generation, end]
            # Of a file that is not read up to its end there is more to come.
            self.looked[info.path] = (looks, generation, end, bool(end) and upto == info.size)
        self.at = found
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        system, _ = file_system(self.pattern)
        out = []
        for path, (generation, upto) in after.items():
            had, at = before.get(path, [generation, 0])
            if had != generation or upto < at:
                at = 0
            if at == upto:
                continue
            with system.open_input_file(path) as f:
                _, encoding = head_of_file(f)
                while at < upto:
                    cut = upto
                    if upto - at > RANGE:
                        cut = last_line_end(f, at, at + RANGE, _wide(encoding))
                        if cut == at:
                            cut = first_line_end(f, at + RANGE, upto, _wide(encoding))
                            cut = cut if cut > at + RANGE else upto
                    out.append(_Range(path, generation, at, cut))
                    at = cut
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, _ = file_system(self.pattern)
        with system.open_input_file(partition.path) as f:
            _, encoding = head_of_file(f)
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        at, wide = 0, _wide(encoding)
        for end in _ends(data, wide, partition.start):
            raw = data[at:end]
            text = raw.decode(wide, "replace") if wide else decode_line(raw.rstrip(b"\r\n"), encoding)
            text = text.rstrip("\r\n").removeprefix("\ufeff") if partition.start + at == 0 else text.rstrip("\r\n")
            yield partition.path.rpartition("/")[2], partition.generation, partition.start + at, text
            at = end

    def commit(self, end: dict) -> None:
        if self.progress:
            system, folder = file_system(self.progress)
            system.create_dir(folder)
            with system.open_output_stream(f"{folder}/next") as f:
                f.write(end["files"].encode())
            system.move(f"{folder}/next", f"{folder}/done")

    def noted(self) -> dict | None:
        system, folder = file_system(self.progress)
        if system.get_file_info(f"{folder}/done").type != fs.FileType.File:
            return None
        with system.open_input_stream(f"{folder}/done") as f:
            return json.loads(f.read())


class TailSource(DataSource):
    """Options: path, a file or a pattern of files in any file system that Arrow opens and every executor reaches; perfile, the most bytes
    of a file in one batch; progress, a folder in which finished batches are noted."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, generation long, position long, raw string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options["path"], int(self.options.get("perfile", PER_FILE)), self.options.get("progress"))


def tail(spark: SparkSession, path: str, per_file: int = 0, progress: str | None = None) -> DataFrame:
    """A stream of finished lines: file, generation, position, raw. See TailSource."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("log_tail").option("path", path).option("perfile", str(per_file or PER_FILE))
    return (reader.option("progress", progress) if progress else reader).load()


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of files that are put into a folder whole: file, generation (0), position (the line's number from 0), raw.
    A file is one row before its lines are, so files should be cut to what a task can hold, as rotated logs are; where lines
    need no order, landed_lines takes files of any size."""
    whole = spark.readStream.option("wholetext", "true").text(folder).select(
        F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"(\r\n|\r|\n)\z", "").alias("value"),
    )
    lines = F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("position", "raw")
    return whole.where(F.length("value") > 0).select("file", lines).select(
        "file", F.lit(0).cast("long").alias("generation"), F.col("position").cast("long").alias("position"), "raw",
    )


def landed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of files that are put into a folder whole: file, raw; large files are split."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))


#: Lines go to the state in chunks of about so many bytes, and entries come from there likewise. What parts lines, entries and an entry's first
#: line number in them are control characters, which no line has any more.
CHUNK, LINE, ENTRY, NUMBER = 1 << 20, "\x1e", "\x1d", "\x1f"
CHUNKS = "file string, generation long, position long, positions binary, starts binary, texts string"
FOLDED = "file string, generation long, entry_no long, entries string"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, generation, position, text, start) in chunks that are rows: of one file and generation, in the order of their places."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file = batch.column(0).dictionary_encode()
        codes, generation, position = file.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        order = np.lexsort((position, generation, codes))
        codes, generation, position = codes[order], generation[order], position[order]
        texts, starts = batch.column(3).take(pa.array(order)), batch.column(4).fill_null(False).to_numpy(zero_copy_only=False)[order]
        piece = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // CHUNK
        cuts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (generation[1:] != generation[:-1]) | (piece[1:] != piece[:-1])])
        rows = [
            (file.dictionary[int(codes[a])].as_py(), int(generation[a]), int(position[a]), position[a:b].astype("<i8").tobytes(), starts[a:b].astype("u1").tobytes(), LINE.join(texts.slice(a, b - a).to_pylist()))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True)
        ]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in CHUNKS.split(", ")])


def _in_order(chunks: list[tuple]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and starts of the chunks (position, positions, starts, texts) of a generation, by place. Chunks that overlap are merged first."""
    chunks.sort(key=lambda c: c[0])
    if any(np.frombuffer(c[1], "<i8")[-1] > d[0] for c, d in itertools.pairwise(chunks)):
        order = np.argsort(np.concatenate([np.frombuffer(c[1], "<i8") for c in chunks]), kind="stable")
        texts, starts = [t for c in chunks for t in c[3].split(LINE)], np.concatenate([np.frombuffer(c[2], "u1") for c in chunks])
        yield [texts[k] for k in order], starts[order].astype(bool)
        return
    for _, _, starts, texts in chunks:
        yield texts.split(LINE), np.frombuffer(starts, "u1").astype(bool)


def _learned(lines: DataFrame, spec: X.FormatSpec, heads: DataFrame | None, name: str) -> DataFrame:
    """lines with what the format learns of each file's head (sources.lines.read_heads), by the file's name; without heads,
    plain logs count as ones whose entries begin with a time."""
    if not spec.learn:
        return lines
    if heads is None:
        if spec.id == "generic":
            return lines.withColumn("anchored", F.lit(True))
        raise ValueError(f"{spec.id} needs the heads of the files that are followed")
    known = heads.groupBy(F.col("source_name").alias(name)).agg(F.first("sample").alias("sample")).select(
        name, *(c.alias(k) for k, c in spec.learn().items()),
    )
    return lines.join(F.broadcast(known), name, "left")


#: State that processors keep by file needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    """Entries of a file's lines. The open entry is a list that lines are only appended to, so an entry of many batches is written once;
    beside it stand the file's generation, how many generations there were, and where the open entry begins."""

    def __init__(self, flush_after_ms: int, forget_after_ms: int):
        self.flush_after, self.forget_after = flush_after_ms, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "text string", self.forget_after)
        self.known = handle.getValueState("known", "generation long, epoch long, begun long, line_no long, entry_no long", self.forget_after)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        of, state = {}, self.known.get() if self.known.exists() else None
        for frame in rows:
            for r in frame.itertuples(index=False):
                of.setdefault(int(r.generation), []).append((int(r.position), r.positions, r.starts, r.texts))
        for generation in sorted(of, key=lambda g: min(c[0] for c in of[g])):
            out = []
            if state is None or state[0] != generation:
                if state is not None and state[2]:
                    out.append(self.closed(key, state))
                self.open.clear()
                state = (generation, state[1] + 1 if state is not None else 0, 0, 0, 0)
            for texts, starts in _in_order(of[generation]):
                state = self.fold(key, state, texts, starts, out)
                if out:
                    yield self.frame(out)
                    out = []
            if out:
                yield self.frame(out)
        self.known.update(state)
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if state[2]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_after)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.known.get() if self.known.exists() else None
        if state is not None and state[2]:
            entry = self.closed(key, state)
            self.open.clear()
            self.known.update((state[0], state[1], 0, state[3], state[4] + 1))
            yield self.frame([entry])

    def closed(self, key: tuple, state: tuple, more: list = ()) -> tuple:
        return key[0], state[1], state[4], state[2], [x[0] for x in self.open.get()] + list(more)

    def fold(self, key: tuple, state: tuple, texts: list, starts: np.ndarray, out: list) -> tuple:
        generation, epoch, begun, line_no, entry_no = state
        at = np.flatnonzero(starts)
        upto = int(at[0]) if len(at) else len(texts)
        if not len(at):
            if begun and texts:
                self.open.appendList([(t,) for t in texts])
            return generation, epoch, begun, line_no + len(texts), entry_no
        if begun:
            out.append(self.closed(key, state, texts[:upto]))
            entry_no += 1
        for a, b in zip(at[:-1], at[1:], strict=True):
            out.append((key[0], epoch, entry_no, line_no + int(a) + 1, texts[a:b]))
            entry_no += 1
        self.open.put([(t,) for t in texts[at[-1] :]])
        return generation, epoch, line_no + int(at[-1]) + 1, line_no + len(texts), entry_no

    def frame(self, out: list) -> pd.DataFrame:
        """Entries (file, generation, entry_no, entry_start, lines) as rows, one for those that are numbered on."""
        rows = []
        for _, run in itertools.groupby(enumerate(out), lambda x: (x[1][1], x[1][2] - x[0])):
            own = [e for _, e in run]
            rows.append((*own[0][:3], ENTRY.join(f"{e[3]}{NUMBER}{LINE.join(e[4])}" for e in own)))
        return pd.DataFrame(rows, columns=["file", "generation", "entry_no", "entries"])

    def close(self) -> None:
        pass


def follow_folded(
    lines: DataFrame, spec: X.FormatSpec, flush_after_ms: int = 1000, heads: DataFrame | None = None, forget_after_ms: int = FORGET_MS,
) -> DataFrame:
    """Closed entries of a stream of lines, as their lines; generation counts a file's generations from 0. State by file, until nothing
    came for forget_after_ms. A task holds the text that one micro-batch brings of one file, which tail bounds when it has a folder for its progress.

    Lines are put into chunks where they are read, so the task of a file's state passes on few rows; entries are cut and parsed by all tasks."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    bound_batches(lines.sparkSession)
    text = _learned(lines.withColumn("text", N.or_empty(strip_control(F.col("raw")))), spec, heads, "file")
    marked = text.withColumn("start", spec.starts()).select("file", "generation", "position", "text", "start")
    chunks = marked.mapInArrow(_chunked, CHUNKS)
    folded = chunks.groupBy("file").transformWithStateInPandas(_Fold(flush_after_ms, forget_after_ms), FOLDED, "Append", "ProcessingTime")
    cut = folded.repartition("file", "entry_no").select("file", "generation", "entry_no", F.posexplode(F.split("entries", ENTRY)).alias("k", "entry"))
    return cut.select(
        "file", "generation", (F.col("entry_no") + F.col("k")).alias("entry_no"), F.substring_index("entry", NUMBER, 1).cast("long").alias("entry_start"),
        F.split(F.substring_index("entry", NUMBER, -1), LINE).alias("lines"),
    )


CHANGES = "source_name string, generation long, level_idx int, level string, change long"


class _Changes(StatefulProcessor):
    """Counts by level of a file's newest generation; a newer one takes back all that the one before counted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "generation long")
        self.counts = handle.getMapState("counts", "level_idx int", "level string, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        before, now = self.newest.get()[0] if self.newest.exists() else -1, int(frame["generation"].max())
        out = []
        if now > before:
            if before >= 0:
                out = [(key[0], before, level[0], name, -n) for level, (name, n) in self.counts.iterator()]
                self.counts.clear()
            self.newest.update((now,))
        fresh = frame[frame["generation"] == max(now, before)]
        for (level, name), n in fresh.groupby(["level_idx", "level"]).size().items():
            had = self.counts.getValue((int(level),)) if self.counts.containsKey((int(level),)) else None
            self.counts.updateValue((int(level),), (name, int(n) + (had[1] if had else 0)))
            out.append((key[0], max(now, before), int(level), name, int(n)))
        yield pd.DataFrame(out, columns=["source_name", "generation", "level_idx", "level", "change"])

    def close(self) -> None:
        pass


def level_changes(entries: DataFrame) -> DataFrame:
    """A stream of changes of level counts, of a stream of entries (follow_entries): by file, generation and level. When a file has been
    replaced, the counts of its former generation are taken back, so the sum of changes is what the files hold now (counts_of_changes)."""
    entries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = entries.select("source_name", "generation", "level_idx", "level")
    return rows.groupBy("source_name").transformWithStateInPandas(_Changes(), CHANGES, "Append", "None")


def counts_of_changes(changes: DataFrame) -> DataFrame:
    """level_idx, level, n: the sums of changes that a stream has put out."""
    return changes.groupBy("level_idx", "level").agg(F.sum("change").alias("n")).where("n <> 0")


def follow_entries(
    lines: DataFrame, format: str, flush_after_ms: int = 1000, heads: DataFrame | None = None, reference: date | None = None,
) -> DataFrame:
    """A stream of entries, with generation: of files that all have the named format. An unfinished last line waits for its end.

    heads: what read_heads found of the files, for formats that learn from it. A date that a line lacks is that of the file's name, else reference.
    """
    spec = X.find_format(format)
    if spec.id == "wevt_xml":
        return _follow_events(lines, spec, flush_after_ms)
    folded = follow_folded(lines, spec, flush_after_ms, heads).withColumn("text", F.col("lines")[0])
    day = F.coalesce(N.date_of_name(F.col("file")), F.lit(reference).cast("date"))
    place = F.struct("generation", "entry_no", "entry_start").alias("entry_start")
    ready = folded.select(
        F.lit(0).alias("source_idx"), F.col("file").alias("source_name"), F.col("generation").alias("block"), place, "lines", "text",
        day.alias("reference"),
    )
    parsed = parse_entries(_learned(ready, spec, heads, "source_name"), spec)
    return parsed.select(
        "source_name", F.col("entry_start.generation").alias("generation"), F.col("entry_start.entry_no").alias("entry_no"),
        F.col("entry_start.entry_start").alias("first_line"), "physical_lines", "time", "level", "level_idx", "raw_level", "thread", "target", "host",
        "pid", "extra", "message",
    )


def _follow_events(lines: DataFrame, spec: X.FormatSpec, flush_after_ms: int) -> DataFrame:
    """follow_entries of event XML: lines are cut after end tags, and an event begins where its tag opens, so it may share a line with others
    or take many; one that is malformed gives no entry, as in files that are read at once."""
    cut = lines.select("file", "generation", "position", F.posexplode(F.split("raw", "(?<=</Event>)")).alias("piece", "raw")).where("piece = 0 or raw != ''")
    begins = replace(spec, starts=lambda: F.col("text").contains("<Event "))
    # A piece is at least a character, so places stay in order.
    folded = follow_folded(cut.withColumn("position", F.col("position") + F.col("piece")).drop("piece"), begins, flush_after_ms)
    xml = F.regexp_replace(F.array_join("lines", "\n"), r"(?s)</Event>.*\z", "")
    place = F.struct("generation", "entry_no", "entry_start").alias("position")
    parsed = parsed_events(folded.select(F.lit(0).alias("source_idx"), F.col("file").alias("source_name"), F.lit(0).alias("block"), place, xml.alias("xml")))
    return parsed.select(
        "source_name", "position.generation", "position.entry_no", (F.col("position.entry_no") + 1).alias("first_line"), "physical_lines", "time", "level", "level_idx",
        "raw_level", "thread", "target", "host", "pid", "extra", "message",
    )


def line_entries(lines: DataFrame, format: str, heads: DataFrame | None = None, reference: date | None = None) -> DataFrame:
    """A stream in which every line is an entry of its own, for counts and filters that need no continuations: source_name and the fields of an entry."""
    spec = X.find_format(format)
    day = F.coalesce(N.date_of_name(F.col("file")), F.lit(reference).cast("date"))
    text = strip_control(F.col("raw"))
    ready = lines.select(
        F.lit(0).alias("source_idx"), F.col("file").alias("source_name"), F.lit(0).alias("block"), F.lit(0).alias("entry_start"),
        F.array(text).alias("lines"), text.alias("text"), day.alias("reference"),
    )
    return parse_entries(_learned(ready, spec, heads, "source_name"), spec).drop("source_idx", "block", "entry_start")


def running_level_counts(entries: DataFrame) -> DataFrame:
    """For outputMode complete."""
    return entries.groupBy("level_idx", "level").agg(F.count(F.lit(1)).alias("n"))


def start(
    stream: DataFrame, sink: str, checkpoint: str, name: str | None = None, mode: str = "append", poll: str | None = POLL, **options,
) -> StreamingQuery:
    """Starts a query that looks for new lines every ``poll``; with None it takes what is there and ends."""
    writer = stream.writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()
