"""Secrets found by patterns, and by a conditional random field that tags tokens.

Patterns give the base spans. A linear-chain conditional random field then tags
every token as beginning (B), inside (I) or outside (O) of a secret. Tokens are
runs of word characters and `+/_.-`, and single other characters; features are
the shape of a token (length, digits, case, hexadecimal, other marks), its
neighbours (a secret word before it, with or without `=` or `:`; a quote beside
it) and the file (how many of its tokens are such operators). The field is fitted
by gradient ascent on the base spans of a bounded sample of documents, and
decoded by Viterbi. Tagged spans that meet no base span are added as kind `crf`.

Decoding is exact but skips most of a text: where a token favours O over both
other tags by more than all that its two transitions can make up for, every best
path is O there, so Viterbi runs only over the stretches between such tokens.

Edge cases: a null text is an empty one, without spans. Offsets are code points.
Without any sample, or without base spans in it, the field tags nothing. Repeated
rows give equal rows, an empty table none; ties between paths go to O; extra
columns are ignored.
"""

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of fewer is dropped
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
ASSIGN_STEMS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "crf")

SECRET_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "pwd", "auth", "credential")
# The fit sees at most this many documents with secrets and as many without, of at most this many characters.
SAMPLE_DOCS, SAMPLE_CHARS, AROUND = 400, 20_000, 12
O, B, I = 0, 1, 2

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    found = []
    lower = text.lower()
    if any(stem in lower for stem in ASSIGN_STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


# Classes of bytes.
_SPACE, _OTHER, _LOWER, _UPPER, _DIGIT, _MARK, _HIGH = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
_CLASS[[ord(c) for c in "+/_.-"]] = _MARK
_HEXADECIMAL = np.zeros(256, bool)
_HEXADECIMAL[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPREAD = np.array([pow(1_000_003, i, 1 << 64) for i in range(16)], np.uint64)


def _word_number(word: bytes) -> int:
    return sum(int(_SPREAD[i]) * (byte + 1) for i, byte in enumerate(word)) % (1 << 64)


_WORDS = np.array(sorted(_word_number(w.encode()) for w in SECRET_WORDS), np.uint64)
_WORD_LENGTHS = {len(w) for w in SECRET_WORDS}

# Values of each feature: token kind and length, digits, case, hexadecimal, marks, secret word before, quote, file.
SIZES = (7, 4, 4, 2, 2, 3, 2, 2)


def tokens(data: np.ndarray, doc_end: np.ndarray):
    """Starts and ends of the tokens of concatenated texts; no token crosses a text."""
    kind = _CLASS[data]
    wordy = kind >= _LOWER
    begins = kind != _SPACE
    begins[1:] &= ~(wordy[1:] & wordy[:-1])
    inner = doc_end[:-1]
    inner = inner[inner < len(data)]
    begins[inner] = kind[inner] != _SPACE
    start = np.flatnonzero(begins)
    stops = np.ones(len(data) + 1, bool)
    stops[:-1] = begins | (kind == _SPACE)
    stops[doc_end] = True
    places = np.flatnonzero(stops)
    end = places[np.searchsorted(places, start, "right")] if len(start) else start
    return start, end


def codes(data: np.ndarray, doc_end: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number per token that holds all its features."""
    if not len(start):
        return np.empty(0, np.int64)
    kind = _CLASS[data]
    length = end - start

    def share(flags):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return total[end] - total[start]

    digits, lower, upper = share(kind == _DIGIT), share(kind == _LOWER), share(kind == _UPPER)
    marks, hexes = share(kind == _MARK), share(_HEXADECIMAL[data])
    word = kind[start] >= _LOWER
    first = data[start]
    operator = ~word & ((first == ord("=")) | (first == ord(":")))
    quote = ~word & ((first == ord('"')) | (first == ord("'")))

    number = np.zeros(len(start), np.uint64)
    short = np.flatnonzero(word & np.isin(length, list(_WORD_LENGTHS)))
    for i in range(max(_WORD_LENGTHS)):
        at = short[length[short] > i]
        number[at] += _SPREAD[i] * (_FOLD[data[start[at] + i]].astype(np.uint64) + np.uint64(1))
    secret = np.zeros(len(start), bool)
    secret[short] = np.isin(number[short], _WORDS)

    doc = np.searchsorted(doc_end, start, "right")
    # The last secret word within four tokens of the same text, with an operator since or not.
    before = np.zeros(len(start), np.int64)
    for step in range(1, 5):
        at = np.flatnonzero(secret[:-step]) + step
        at = at[doc[at] == doc[at - step]]
        with_operator = np.zeros(len(at), bool)
        for back in range(1, step):
            with_operator |= operator[at - back]
        before[at] = np.maximum(before[at], 1 + with_operator)
    beside = np.zeros(len(start), bool)
    beside[1:] |= quote[:-1] & (doc[1:] == doc[:-1])
    beside[:-1] |= quote[1:] & (doc[1:] == doc[:-1])
    count = np.bincount(doc, minlength=len(doc_end))
    often = np.bincount(doc, operator, minlength=len(doc_end)) * 100 >= np.maximum(count, 1)
    case = np.where(upper == 0, np.where(lower > 0, 0, 1), np.where(lower > 0, 2, 3))
    parts = (
        np.where(word, 1 + np.digitize(length, (6, 12, 20, 24, 36)), 0),
        np.where(digits == 0, 0, np.where(4 * digits < length, 1, np.where(5 * digits < 3 * length, 2, 3))),
        case, (hexes == length).astype(np.int64), (marks > 0).astype(np.int64), before,
        beside.astype(np.int64), often[doc].astype(np.int64),
    )
    code = np.zeros(len(start), np.int64)
    for values, size in zip(parts, SIZES):
        code = code * size + values
    return code


class Field:
    """A linear-chain conditional random field over tokens with packed features."""

    def __init__(self, weights: list[np.ndarray], transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions
        table = np.zeros((1, 3))
        for w in weights:
            table = (table[:, None, :] + w[None, :, :]).reshape(-1, 3)
        self.emission = table
        swing = 2 * (transitions.max() - transitions.min())
        self.settled = table[:, O] - table[:, 1:].max(axis=1) > swing

    def tags(self, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best tags; texts are separate chains."""
        out = np.zeros(len(code), np.int8)
        open_ = np.flatnonzero(~self.settled[code])
        if not len(open_):
            return out
        for run in np.split(open_, np.flatnonzero((np.diff(open_) > 1) | (np.diff(doc[open_]) > 0)) + 1):
            left = run[0] > 0 and doc[run[0] - 1] == doc[run[0]]
            right = run[-1] + 1 < len(code) and doc[run[-1] + 1] == doc[run[-1]]
            out[run] = self.viterbi(self.emission[code[run]], left, right)
        return out

    def viterbi(self, emission: np.ndarray, left: bool, right: bool) -> np.ndarray:
        """left, right: a token tagged O stands before or after."""
        score = emission[0] + (self.transitions[O] if left else 0)
        back = []
        for row in emission[1:]:
            paths = score[:, None] + self.transitions
            back.append(paths.argmax(axis=0))
            score = paths.max(axis=0) + row
        tag = int((score + (self.transitions[:, O] if right else 0)).argmax())
        tags = [tag]
        for pointers in reversed(back):
            tag = int(pointers[tag])
            tags.append(tag)
        return np.array(tags[::-1], np.int8)


def _unpack(code: np.ndarray) -> np.ndarray:
    out = np.empty((len(code), len(SIZES)), np.int64)
    for i in reversed(range(len(SIZES))):
        code, out[:, i] = np.divmod(code, SIZES[i])
    return out


def fit(texts: list[str], steps=150, rate=0.3, decay=1e-3) -> Field | None:
    """Fit on base spans of `texts`, in windows around them and at the start of each text."""
    chains, golds = [], []
    for text in texts:
        code, gold = _silver(text)
        marked = np.flatnonzero(gold == B)
        for centre in [AROUND, *marked[:50]]:
            window = slice(max(0, centre - AROUND), centre + AROUND)
            if len(code[window]):
                chains.append(code[window])
                golds.append(gold[window])
    if not any((g != O).any() for g in golds):
        return None
    longest = max(map(len, chains))
    x = np.zeros((len(chains), longest, len(SIZES)), np.int64)
    y = np.zeros((len(chains), longest), np.int64)
    real = np.zeros((len(chains), longest), bool)
    for i, (c, g) in enumerate(zip(chains, golds)):
        x[i, :len(c)], y[i, :len(c)], real[i, :len(c)] = _unpack(c), g, True
    weights, transitions = [np.zeros((size, 3)) for size in SIZES], np.zeros((3, 3))
    squares = [np.zeros_like(w) for w in (*weights, transitions)]
    goal = np.eye(3)[y] * real[..., None]
    pairs = real[:, 1:, None, None] * goal[:, :-1, :, None] * goal[:, 1:, None, :]
    for _ in range(steps):
        emission = sum(w[x[..., i]] for i, w in enumerate(weights))
        unary, joint = _marginals(emission, transitions, real)
        miss = goal - unary
        gradients = [np.stack([np.bincount(x[..., i].ravel(), miss[..., t].ravel(), len(w)) for t in range(3)], 1) for i, w in enumerate(weights)]
        gradients.append((pairs - joint).sum(axis=(0, 1)))
        for w, g, s in zip((*weights, transitions), gradients, squares):
            g = g / len(chains) - decay * w
            s += g * g
            w += rate * g / (np.sqrt(s) + 1e-8)
    return Field(weights, transitions)


def _marginals(emission, transitions, real):
    """Forward and backward sums over padded chains."""
    n, longest, _ = emission.shape
    forward, backward = np.zeros_like(emission), np.zeros_like(emission)
    forward[:, 0] = emission[:, 0]
    for t in range(1, longest):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + transitions, axis=1) + emission[:, t]
        forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = np.logaddexp.reduce(transitions + (emission[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(real[:, t + 1, None], step, 0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)[:, None, None]
    unary = np.exp(forward + backward - total) * real[..., None]
    joint = np.exp(
        forward[:, :-1, :, None] + transitions + (emission[:, 1:] + backward[:, 1:])[:, :, None, :] - total[..., None]
    ) * real[:, 1:, None, None]
    return unary, joint


def _packed(texts: list[bytes]):
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc_end = np.cumsum([len(t) for t in texts])
    start, end = tokens(data, doc_end)
    return data, doc_end, start, end, codes(data, doc_end, start, end)


def _silver(text: str):
    """Codes and tags of one text; the value of a base span is what is tagged."""
    _, _, start, end, code = _packed([text.encode()])
    gold = np.zeros(len(code), np.int64)
    inner = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    inner += [(s, e) for s, kind, e in base_spans(text) if kind]
    for s, e in inner:
        low, high = len(text[:s].encode()), len(text[:e].encode())
        at = np.flatnonzero((start < high) & (end > low))
        gold[at] = I
        gold[at[:1]] = B
    return code, gold


def sample(docs: DataFrame, size=SAMPLE_DOCS, chars=SAMPLE_CHARS) -> list[str]:
    """Texts to fit on, chosen by a hash: at most `size` with a secret word or a long
    hexadecimal run, and as many others, none longer than `chars`."""
    short = docs.select("doc_id", "text").filter(F.length("text").between(1, chars))
    likely = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    return [
        row.text for condition in (likely, ~likely)
        for row in hashed_sample(short.filter(condition), size, "doc_id", "text").collect()
    ]


def _crf_spans(field: Field, texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Byte spans of tagged tokens, per text."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    _, doc_end, start, end, code = _packed(texts)
    if not len(code):
        return spans
    doc = np.searchsorted(doc_end, start, "right")
    tags = field.tags(code, doc)
    at = np.flatnonzero(tags != O)
    last = None
    for i in at.tolist():
        d = int(doc[i])
        begin = 0 if d == 0 else int(doc_end[d - 1])
        s, e = int(start[i]) - begin, int(end[i]) - begin
        if tags[i] == I and last == (d, i - 1):
            spans[d][-1] = (spans[d][-1][0], e)
        else:
            spans[d].append((s, e))
        last = (d, i)
    return spans


def find(text: str, tagged: list[tuple[int, int]]):
    """Base spans of a text, and all spans with the tagged ones (in bytes) that meet none of them."""
    base = base_spans(text)
    if not tagged:
        return base, base
    raw = text.encode()
    begins, reach = [start for start, _, _ in base], list(accumulate((end for _, _, end in base), max))
    more, at, low = [], 0, 0
    for s, e in sorted(tagged):
        low += len(raw[at:s].decode())
        high, at = low + len(raw[s:e].decode()), s
        # Of the base spans that begin before the end of this one, the one that reaches farthest decides.
        n = bisect_left(begins, high)
        if not (n and reach[n - 1] > low):
            more.append((low, KINDS.index("crf"), high))
    return base, sorted(base + more)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _shared(docs: DataFrame, field: Field | None):
    """The field's numbers, some hundreds, as plain values: workers need no copy of this package."""
    model = field or fit(sample(docs))
    return docs.sparkSession.sparkContext.broadcast(model and (model.weights, model.transitions))


def _field(shared) -> Field | None:
    return shared.value and Field(*shared.value)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts and spans per document; `field` is fitted on a sample of `docs` if not given."""
    shared = _shared(docs, field)

    def run(batches):
        for text, batch in _scanned(batches, _field(shared)):
            rows = []
            for doc_id, base, spans in batch:
                kinds = [kind for _, kind, _ in base]
                rows.append((doc_id, *(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (*[pa.int64()] * 4, pa.string(), pa.string()))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


# Bytes of text that are tagged at once.
AT_ONCE = 1 << 20


def _scanned(batches, field):
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= AT_ONCE:
                yield texts, _tagged(ids, texts, field)
                ids, texts, size = [], [], 0
        yield texts, _tagged(ids, texts, field)


def _tagged(ids, texts, field):
    tagged = _crf_spans(field, [t.encode() for t in texts]) if field and texts else [[]] * len(texts)
    return [(doc_id, *find(text, spans)) for doc_id, text, spans in zip(ids, texts, tagged)]


def redact(docs: DataFrame, mark="[SECRET]", field: Field | None = None) -> DataFrame:
    """`docs` with every span replaced by `mark` (overlapping spans once); the columns and nulls stay."""
    shared = _shared(docs, field)
    place = docs.columns.index("text")

    def run(batches):
        own = _field(shared)
        for batch in batches:
            column, out, waiting, size = batch.column(place), [], [], 0

            def flush():
                for text, (_, _, spans) in zip(waiting, _tagged([None] * len(waiting), [t or "" for t in waiting], own)):
                    out.append(None if text is None else _without(text, spans, mark))

            for value in column:
                waiting.append(value.as_py())
                size += len(waiting[-1] or "")
                if size >= AT_ONCE:
                    flush()
                    waiting, size = [], 0
            flush()
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def _without(text: str, spans, mark: str) -> str:
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])
