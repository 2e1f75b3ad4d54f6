"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds what they miss.

The field tags every token as the beginning of a secret, inside of one or outside. Its features are the token (its word, the shape
and mix of its characters, its length), the words and shapes of the two tokens on either side, and the file (its size, how much
of it is digits and signs). It learns from windows of 64 tokens in which the patterns' values are the secrets; windows with
secrets count twice, the second time without the words around, so that a value is also known by its looks.

Decoding is Viterbi's, exact over whole texts: where a token's score for outside is ahead of the others by more than any neighbours
can make up for, it is outside in every best path, so the chain is cut there and only short pieces are left to be searched.

Null and empty texts have no spans. Texts of any length are read whole, in blocks cut at blanks. Equal texts have equal spans, repeated
rows are rows like others, ids may be null or equal. Of spans that start at one place, the kinds stand in the order of KINDS. An empty table gives no rows, and
where no text has a pattern's match the field finds nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hash_share, map_batches, materialize

KINDS = ["assign", "access", "hex", "field"]
#: The patterns, and the least length of the value (group 2 of the first, else the whole match).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs as long as they can be, so a least length in the pattern drops those that are shorter and no others.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TOKEN = re.compile(r"\w++(?:[+/.\-]++\w++)*+|[^\s\w]")
#: Characters that are no letters or digits; digits; capitals, among others, as far as they are plain; letters that are left.
WORDLIKE, DIGIT, UPPER, LOWER = re.compile(r"[\W_]"), re.compile(r"\d"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\dA]")
SAME, SIXTEEN = re.compile(r"(.)\1+"), re.compile(r"[0-9A-Fa-f]+")
#: Tokens of a training window, and the most windows with secrets and without that are learned from.
WINDOW, MAX_MARKED, MAX_PLAIN = 64, 800, 1000
#: A feature must be seen so often; steps of the fit, and the weight of its penalty.
LEAST_SEEN, STEPS, PENALTY = 2, 50, 0.02
#: Characters of a block, and distinct tokens that a task keeps scores of.
BLOCK, CACHE = 500_000, 60_000
ROLES = [0, -1, -2, 1, 2]


# Patterns ------------------------------------------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, kind's place in KINDS, kind, end, start of the value) of every match of the patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


# Features ------------------------------------------------------------------------------------------------------------


def length_class(n: int) -> int:
    return n if n < 3 else min(3 + int(2 * math.log2(n / 3)), 12)


def looks(token: str) -> list[str]:
    """What a token looks like: the mix of its characters, their runs, its length and how often letters and digits alternate."""
    kinds = WORDLIKE.sub("-", token[:256])
    for pattern, kind in ((DIGIT, "0"), (UPPER, "A"), (LOWER, "a")):
        kinds = pattern.sub(kind, kinds)
    runs = SAME.sub(r"\1", kinds)
    mix, size = "".join(sorted(set(runs))), length_class(len(token))
    turns = min(9, 10 * len(runs) // max(4, len(kinds)))
    return [f"mix={mix},{size}", f"turns={turns},{min(size, 8)}", f"runs={runs[:5]}", f"hex={SIXTEEN.fullmatch(token) is not None},{size}", f"mix={mix}"]


def word(token: str) -> str | None:
    """The token as a word or sign; none for what is more likely a value."""
    return f"word={token.lower()}" if len(token) <= 16 and not DIGIT.search(token) else None


def token_features(token: str, roles: list[int], masked: bool = False) -> list[list[str]]:
    """Features of a token, for itself (role 0) or as a neighbour. masked: a neighbour's word doesn't count, signs do."""
    own, seen = word(token), looks(token)
    others = None if masked and token[0].isalnum() else own
    return [
        seen + ([own] if own else []) if role == 0 else [f"{role}|{seen[-1]}"] + ([f"{role}|{others}"] if others else []) for role in roles
    ]


def file_features(text: str) -> list[str]:
    n = len(text)
    share = lambda chars: min(8, int(40 * sum(map(text.count, chars)) / max(1, n)))
    return ["file", f"size={int(math.log2(n + 1)) // 2}", f"signs={share('=:{};')}", f"quotes={share(chr(34) + chr(39))}", f"digits={share('0123456789')}"]


# Learning ------------------------------------------------------------------------------------------------------------


def tags_of(text: str, base: list) -> tuple[list[str], list[int]]:
    """Tokens and their tags, by the values of the patterns' matches."""
    values = sorted((start, end) for _, _, _, end, start in base)
    tokens, tags, at, begun = [], [], 0, -1
    for m in TOKEN.finditer(text):
        while at < len(values) and values[at][1] <= m.start():
            at += 1
        inside = at < len(values) and values[at][0] < m.end()
        tokens.append(m.group())
        tags.append((INSIDE if begun == at else BEGIN) if inside else OUTSIDE)
        begun = at if inside else begun
    return tokens, tags


def windows(text: str) -> Iterator[tuple[bool, int, list[str], list[int], list[str]]]:
    """At most one window with a secret and one without, those of the smallest hashes: marked, hash, tokens, tags, file features."""
    tokens, tags = tags_of(text, base_spans(text))
    best: dict[bool, tuple] = {}
    for at in range(0, len(tokens), WINDOW):
        some = tokens[at : at + WINDOW]
        marked = any(tags[at : at + WINDOW])
        h = xxhash.xxh3_64_intdigest("\n".join(some).encode("utf-8", "surrogatepass")) >> 1
        if marked not in best or h < best[marked][0]:
            best[marked] = (h, some, tags[at : at + WINDOW])
    for marked, (h, some, found) in best.items():
        yield marked, h, some, found, file_features(text)


def _sample(docs: DataFrame) -> list:
    """Windows to learn from, by the smallest hashes of all; of texts without a secret only a share is looked at, which the
    number of texts decides and which is many times what is kept."""
    share = min(1.0, 20 * MAX_PLAIN / max(1, docs.count()))
    rows = docs.select(F.lit(None).cast("string").alias("x"), F.coalesce("text", F.lit("")).alias("text"), hash_share("text", share).alias("looked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, looked = [], batch.column(2).to_pylist()
            at = 0
            for _, texts in chunks([batch]):
                for k, text in enumerate(texts):
                    if looked[at + k] or base_spans(text):
                        out += (w for w in windows(text) if w[0] or looked[at + k])
                at += len(texts)
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["marked", "h", "tokens", "tags", "file"])

    found = map_batches(rows, run, "marked boolean, h long, tokens array<string>, tags array<long>, file array<string>")
    # Copies are one window.
    own = materialize(found.groupBy("marked", "h").agg(F.first("tokens").alias("tokens"), F.first("tags").alias("tags"), F.first("file").alias("file")), "windows")
    return [r for marked, most in ((True, MAX_MARKED), (False, MAX_PLAIN)) for r in own.where(F.col("marked") == marked).orderBy("h").limit(most).collect()]


@dataclass
class Model:
    """Weights of features by tag, and of pairs of tags; no weights: nothing was learned."""

    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))


def _window_features(tokens: list[str], file: list[str], masked: bool) -> list[list[str]]:
    out = []
    every = [token_features(token, ROLES, masked) for token in tokens]
    for k in range(len(tokens)):
        found = list(file)
        for i, role in enumerate(ROLES):
            if 0 <= k + role < len(tokens):
                found += every[k + role][i]
        out.append(found)
    return out


def likelihood(scores: np.ndarray, lengths: np.ndarray, tags: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of chains (chain, place, tag): the log-likelihood of their tags and its gradients by scores and by moves."""
    chains, longest, _ = scores.shape
    sums = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    inside = np.arange(longest)[None] < lengths[:, None]
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, longest):
        step = sums(forward[:, t - 1, :, None] + moves[None], 1) + scores[:, t]
        forward[:, t] = np.where(inside[:, t, None], step, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = sums(moves[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
    total = sums(forward[:, -1], 1)
    chance = np.exp(forward + backward - total[:, None, None]) * inside[..., None]
    own = np.zeros_like(scores)
    np.put_along_axis(own, tags[..., None], 1.0, axis=2)
    own *= inside[..., None]
    both = inside[:, 1:, None, None]
    pair = np.exp(np.where(
        both, forward[:, :-1, :, None] + moves[None, None] + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None], -np.inf,
    ))
    seen = (own[:, :-1, :, None] * own[:, 1:, None, :]).sum((0, 1))
    value = (own * scores).sum() + (seen * moves).sum() - total.sum()
    return float(value), own - chance, seen - pair.sum((0, 1))


def train(rows: list) -> Model:
    """The weights that make the tags of windows (tokens, tags, file, marked) likeliest, under a quadratic penalty."""
    chains = [(_window_features(r["tokens"], r["file"], masked), r["tags"]) for r in rows for masked in ([False, True] if r["marked"] else [False])]
    if not any(r["marked"] for r in rows):
        return Model()
    seen = Counter(f for found, _ in chains for one in found for f in one)
    features = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_SEEN))}
    n, longest = len(features), max(len(t) for _, t in chains)
    lengths = np.array([len(t) for _, t in chains])
    tags, place, index = np.zeros((len(chains), longest), np.int64), [], []
    for c, (found, own) in enumerate(chains):
        tags[c, : len(own)] = own
        for t, one in enumerate(found):
            ids = [features[f] for f in one if f in features]
            index += ids
            place += [c * longest + t] * len(ids)
    place, index = np.array(place), np.array(index)
    weights, moves = np.zeros((n, 3)), np.zeros((3, 3))
    state = [np.zeros((n, 3)), np.zeros((n, 3)), np.zeros((3, 3)), np.zeros((3, 3))]
    for step in range(1, STEPS + 1):
        scores = np.stack([np.bincount(place, weights[index, y], len(chains) * longest) for y in range(3)], axis=1).reshape(len(chains), longest, 3)
        _, by_score, by_move = likelihood(scores, lengths, tags, moves)
        flat = by_score.reshape(-1, 3)
        by_weight = np.stack([np.bincount(index, flat[place, y], n) for y in range(3)], axis=1)
        for value, grad, k in ((weights, by_weight - PENALTY * weights, 0), (moves, by_move - PENALTY * moves, 2)):
            state[k] = 0.9 * state[k] + 0.1 * grad
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * grad**2
            value += 0.2 * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)
    return Model(features, weights, moves)


def fit(docs: DataFrame, text_column: str = "text") -> Model:
    """Learns from at most MAX_MARKED windows with secrets and MAX_PLAIN without, of at most one of each kind in a text."""
    return train(_sample(docs.select(F.col(text_column).alias("text"))))


# Decoding ------------------------------------------------------------------------------------------------------------


class _Known(dict):
    """Tokens to numbers that stand for their looks and their word, of which there are tables of scores: by role, then tag. What
    most tokens look like is told by their length alone."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.by_looks, self.by_words = model, {}, {}
        self.looks, self.words = np.zeros((1024, len(ROLES), 3)), [np.zeros((len(ROLES), 3))]
        for f, k in model.features.items():
            role, _, name = f.rpartition("|") if not f.startswith("word=") else ("0", "", f)
            if name.startswith("word=") and role.lstrip("-").isdigit():
                at = self.by_words.setdefault(name[5:], len(self.words))
                if at == len(self.words):
                    self.words.append(np.zeros((len(ROLES), 3)))
                self.words[at][ROLES.index(int(role))] += model.weights[k]
        self.words = np.array(self.words)

    def of_looks(self, key, token: str) -> int:
        k = self.by_looks[key] = len(self.by_looks)
        if k == len(self.looks):
            self.looks = np.concatenate([self.looks, np.zeros_like(self.looks)])
        seen = looks(token)
        for i, role in enumerate(ROLES):
            ids = [self.model.features[f] for f in (seen if role == 0 else [f"{role}|{seen[-1]}"]) if f in self.model.features]
            self.looks[k, i] = self.model.weights[ids].sum(axis=0)
        return k

    def __missing__(self, token: str) -> int:
        if token.isalpha() and (token.islower() or token.istitle() and UPPER.match(token)):
            key = (token.islower(), len(token), SIXTEEN.fullmatch(token) is None)
        else:
            key = tuple(looks(token))
        k = self.by_looks.get(key)
        if k is None:
            k = self.of_looks(key, token)
        own = word(token)
        self[token] = out = k * len(self.words) + (self.by_words.get(own[5:], 0) if own else 0)
        return out

    def scores(self, numbers: np.ndarray) -> np.ndarray:
        """[token, role, tag]"""
        k, w = np.divmod(numbers, len(self.words))
        return self.looks[k] + self.words[w]


def lead_needed(moves: np.ndarray) -> np.ndarray:
    """By how much outside must be ahead of each tag, so that no neighbours' tags, or ends of the text, make up for it."""
    before = np.r_[moves - moves[:, [OUTSIDE]], np.zeros((1, 3))].max(axis=0)
    after = np.c_[moves - moves[[OUTSIDE]], np.zeros((3, 1))].max(axis=1)
    return before + after


def viterbi(scores: np.ndarray, moves: np.ndarray, first: bool, last: bool) -> list[int]:
    """The best tags of a piece; first and last: the text begins and ends with it, else there is a token outside before and after it."""
    best = scores[0] if first else scores[0] + moves[OUTSIDE]
    back = []
    for one in scores[1:]:
        step = best[:, None] + moves
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + one
    tags = [int((best if last else best + moves[:, OUTSIDE]).argmax())]
    for one in reversed(back):
        tags.append(int(one[tags[-1]]))
    return tags[::-1]


class Scanner:
    """Finds spans in texts; keeps the scores of so many tokens."""

    def __init__(self, model: Model):
        self.model, self.known, self.lead = model, _Known(model), lead_needed(model.moves)

    def scores(self, text: str) -> np.ndarray:
        """[token, tag] of a whole text."""
        out, n, at = np.zeros((max(64, len(text) // 6), 3)), 0, 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):
                blank = re.compile(r"\s").search(text, end)
                end = blank.start() if blank else len(text)
            tokens = TOKEN.findall(text, at, end)
            if len(self.known) > CACHE or len(self.known.by_looks) > CACHE:
                self.known = _Known(self.model)
            index = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
            if n + len(tokens) + 2 > len(out):
                out = np.concatenate([out, np.zeros((max(len(out), len(tokens) + 2), 3))])
            found = self.known.scores(index)
            for i, role in enumerate(ROLES):
                first = n - role
                skip = min(len(tokens), max(0, -first))
                out[max(0, first) : max(0, first + len(tokens))] += found[skip:, i]
            n, at = n + len(tokens), end
        ids = [self.model.features[f] for f in file_features(text) if f in self.model.features]
        return out[:n] + self.model.weights[ids].sum(axis=0)

    def tags(self, text: str) -> dict[int, int]:
        """The tags of the tokens that are not outside, by their places."""
        if not len(self.model.weights):
            return {}
        scores = self.scores(text)
        behind = scores[:, [OUTSIDE]] - scores[:, 1:]
        open_at = np.flatnonzero((behind <= self.lead[None, 1:]).any(axis=1))
        found = {}
        for piece in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1) if len(open_at) else []:
            a, b = int(piece[0]), int(piece[-1]) + 1
            tags = viterbi(scores[a:b], self.model.moves, a == 0, b == len(scores))
            found.update({a + k: y for k, y in enumerate(tags) if y != OUTSIDE})
        return found

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of all secrets: the patterns' matches, and of the field's those that touch none of them."""
        base = base_spans(text)
        out = [(start, place, kind, end) for start, place, kind, end, _ in base]
        if tags := self.tags(text):
            found: list[list[int]] = []
            last = -2
            for k, m in enumerate(TOKEN.finditer(text)):
                if y := tags.get(k):
                    if y == BEGIN or last != k - 1:
                        found.append([m.start(), m.end()])
                    found[-1][1], last = m.end(), k
            at, reach = 0, 0
            for start, end in found:
                while at < len(base) and base[at][0] < end:
                    reach = max(reach, base[at][3])
                    at += 1
                if reach <= start:
                    out.append((start, len(KINDS) - 1, KINDS[-1], end))
        return [(kind, start, end) for start, _, kind, end in sorted(out)]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end in code points) of every row."""
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for ids, texts in chunks(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(t)] for t in texts]
            yield pa.record_batch([ids, pa.array(found, kind)], names=["id", "spans"])

    found = map_batches(rows, run, f"id {rows.schema[0].dataType.simpleString()}, spans {SPANS}")
    return found.select(F.col("id").alias(id_column), "spans")
