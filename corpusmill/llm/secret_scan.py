"""Secret scan: plain patterns, and a linear-chain conditional random field.

The patterns find what they name.  The field learns from their findings in
bounded samples of the texts with and without any what secrets look like (shape,
neighbouring words, the file) and
tags every token of every text as the begin of a secret, inside one, or
outside; the best tagging is found by Viterbi.  Its spans are added where they
touch no pattern's span.

Most tokens cannot be part of a secret under any tags of their neighbours: with
transition weights in a known range, a margin of its own suffices.  Such tokens
are outside for certain, so Viterbi only runs over what lies between them; the
result is the same as over the whole text.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import IS_FIRST, IS_SPACE, Lookup, Texts, bounds, pieces

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
# A run that is too short has no long enough part either, so these equal "match, then drop".
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

#: Distinct texts (about) without and with secrets that the field learns from, by a hash of the text.
TRAINING_ROWS = 20_000
SECRET_ROWS = 2_000
SHARES = 1 << 40
WINDOW = 24
#: One of so many texts of the sample also gives a window of its middle.
ORDINARY = 8
RANGE = 1.5  # transition weights lie between -RANGE and RANGE
OUT, BEGIN, INSIDE = 0, 1, 2

#: (feature, value) set in copies of training windows: between ordinary words, and
#: then without a telling word as well.
PLAIN = (((4, 7), (6, 7)), ((4, 7), (5, 0), (6, 7)))

STRONG = (b"password", b"passwd", b"pwd", b"passphrase", b"secret", b"token", b"apikey", b"api_key", b"credential")
WEAK = (b"key", b"auth", b"bearer", b"authorization", b"private", b"access", b"login", b"signature", b"client_secret")

_CLASS = np.ones(256, np.uint8)  # 0 white space, 1 part of a run, 2 a mark of its own
_CLASS[33:127] = 2
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _CLASS[_a:_b] = 1
_CLASS[list(b"_+/.-")] = 1
_CLASS[IS_SPACE] = 0
_CODES = np.arange(256)
_LOWER = (_CODES >= 97) & (_CODES <= 122)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_HEXED = _DIGIT | ((_CODES >= 97) & (_CODES <= 102))
_WIDE = _CODES >= 128
_SORT = _LOWER * 1 + _UPPER * 2 + _DIGIT * 3  # for changes within a token
_MARK = np.zeros(256, np.uint8)
for _code, _c in enumerate((b"=", b":", b"\"'", b".", b",;"), 1):
    _MARK[list(_c)] = _code
_LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40])
#: Values of each feature; see :func:`features`.
SIZES = (2 * 32 + 8, 12, 14, 6, 9, 13, 9, 12)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Patterns' findings, by start and then kind."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for k, a, b in sorted(found, key=lambda x: (x[1], x[0]))]


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The secrets themselves: values of assignments, keys and hex runs."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(found + [m.span() for r in (ACCESS, HEX) for m in r.finditer(text)])


def shows_secret(text: str) -> bool:
    """Whether :func:`secret_parts` finds any."""
    return bool(HEX.search(text) or ACCESS.search(text) or any(len(m[2]) >= 6 for m in ASSIGN.finditer(text)))


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of runs of word characters and of single marks."""
    data = texts.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    cls = _CLASS[data]
    start = np.ones(len(data), bool)
    start[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == 2)
    start[texts.offsets[:-1][texts.n_bytes > 0]] = True
    at = np.flatnonzero(start)
    end = np.append(at[1:], len(data))
    full = cls[at] > 0
    return at[full], end[full], texts.owner(at[full])


class _Keywords:
    def __init__(self) -> None:
        words = Texts(pa.array([w.decode() for w in (*STRONG, *WEAK)]))
        h = words.hashes(words.offsets[:-1], words.offsets[1:], fold=True)
        self.table = Lookup(h, np.array([2] * len(STRONG) + [1] * len(WEAK), np.int8))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.table.find(hashes)[0]


def features(texts: Texts, keywords: _Keywords) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token starts, ends, texts, and one code per feature for each token.

    Shape (kinds of characters, or which mark), length, share of digits and
    whether all are hexadecimal, changes between kinds of characters, the token
    before, the distance to a telling word before, the token after, and the
    file's length and share of digits.
    """
    starts, ends, owner = tokens(texts)
    n, m = len(texts), len(starts)
    codes = np.zeros((m, len(SIZES)), np.uint8)
    if not m:
        return starts, ends, owner, codes
    data = texts.data

    def counted(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask[data], out=sums[1:])
        return sums[ends] - sums[starts], sums

    lower, upper, wide, hexed = (counted(x)[0] for x in (_LOWER, _UPPER, _WIDE, _HEXED))
    digit, digit_sums = counted(_DIGIT)
    sort = _SORT[data]
    turns = np.zeros(len(data) + 1, np.int32)
    np.cumsum(sort[1:] != sort[:-1], out=turns[2:])
    turn = turns[ends] - turns[np.minimum(starts + 1, len(data))]
    length = ends - starts
    mark = np.where(_CLASS[data[starts]] == 2, _MARK[data[starts]] + 1, 0)
    shape = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (wide > 0) + 16 * (upper == 1)
    rest = (lower + upper + digit + wide < length) & (mark == 0)
    codes[:, 0] = np.where(mark > 0, 64 + mark, shape + 32 * rest)
    codes[:, 1] = np.searchsorted(_LENGTHS, length, side="right")
    codes[:, 2] = (digit * 6 // length) + 7 * (hexed == length)
    codes[:, 3] = np.minimum(np.searchsorted([1, 2, 4, 8], turn, side="right"), 5)
    kind = np.where(mark > 0, mark, np.where((lower == length) | ((lower == length - 1) & (upper == 1)), 7, 8)).astype(np.uint8)
    same = owner[1:] == owner[:-1]
    codes[1:, 4] = np.where(same, kind[:-1], 0)
    codes[:-1, 6] = np.where(same, kind[1:], 0)
    # How many tokens ago a telling word stood, up to six.
    telling = np.zeros(m, np.int8)
    short = (mark == 0) & (length <= 16)
    telling[short] = keywords(texts.hashes(starts[short], ends[short], fold=True))
    place = np.where(telling > 0, np.arange(m), -1)
    last = np.append(-1, np.maximum.accumulate(place)[:-1])
    ago = np.arange(m) - last
    near = (last >= 0) & (ago <= 6)
    near &= owner[np.maximum(last, 0)] == owner
    codes[:, 5] = np.where(near, ago + np.where(telling[np.maximum(last, 0)] == 2, 6, 0), 0)
    size = np.maximum(texts.n_bytes, 1)
    share = (digit_sums[texts.offsets[1:]] - digit_sums[texts.offsets[:-1]]) / size
    file = np.searchsorted([0.001, 0.01, 0.1], share, side="right") * 3 + np.searchsorted([1000, 10_000], size, side="right")
    codes[:, 7] = file[owner]
    return starts, ends, owner, codes


# -- the field --------------------------------------------------------------

_OFFSETS = np.cumsum((0, *SIZES[:-1]))


class Field:
    """Weights of a linear-chain field with three tags; a text starts and ends outside."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((*codes.shape[:-1], 3))
        for k, offset in enumerate(_OFFSETS):
            out += self.emit[codes[..., k].astype(np.int64) + offset]
        return out

    def decode(self, codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The best tag of each token."""
        score = self.scores(codes)
        tags = np.zeros(len(score), np.int8)
        margin = score[:, OUT] - np.maximum(score[:, BEGIN], score[:, INSIDE])
        open_ = margin <= 2 * (self.move.max() - self.move.min())
        at = np.flatnonzero(open_)
        if len(at):
            first = np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
            start = at[first]
            size = np.diff(np.append(np.flatnonzero(first), len(at)))
            self._viterbi(score, tags, start, size)
        return tags

    def _viterbi(self, score: np.ndarray, tags: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """All runs at the same time; on both sides of a run the tag is outside."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        best = np.tile(self.move[OUT], (len(start), 1)) + score[start]
        back = [np.zeros((len(start), 3), np.int8)]
        active = len(size) - np.searchsorted(size[::-1], np.arange(2, int(size[0]) + 1), side="left")
        for k, m in enumerate(active.tolist(), 1):
            ways = best[:m, :, None] + self.move[None]
            back.append(ways.argmax(axis=1).astype(np.int8))
            best[:m] = ways.max(axis=1) + score[start[:m] + k]
        tag = (best + self.move[:, OUT]).argmax(axis=1)
        for k in range(len(back) - 1, -1, -1):
            m = len(back[k])
            tags[start[:m] + k] = tag[:m]
            if k:
                tag[:m] = back[k][np.arange(m), tag[:m]]


def _forward_backward(score: np.ndarray, move: np.ndarray, length: np.ndarray):
    """Log normalisers, tag marginals and summed transition marginals of windows."""
    n, t, _ = score.shape
    step = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    inside = np.arange(t) < length[:, None]
    fore, aft = np.zeros((n, t, 3)), np.zeros((n, t, 3))
    fore[:, 0] = move[OUT] + score[:, 0]
    for k in range(1, t):
        fore[:, k] = np.where(inside[:, k, None], step(fore[:, k - 1, :, None] + move, 1) + score[:, k], fore[:, k - 1])
    aft[:, t - 1] = move[:, OUT]
    for k in range(t - 2, -1, -1):
        value = step(move[None] + (score[:, k + 1] + aft[:, k + 1])[:, None], 2)
        aft[:, k] = np.where(inside[:, k + 1, None], value, move[:, OUT])
    norm = step(fore[:, t - 1] + move[:, OUT], 1)
    tag = np.exp(fore + aft - norm[:, None, None]) * inside[..., None]
    pair = np.exp(
        fore[:, :-1, :, None] + move + (score[:, 1:] + aft[:, 1:])[:, :, None] - norm[:, None, None, None]
    ) * inside[:, 1:, None, None]
    moved = pair.sum(axis=(0, 1))
    rows = np.arange(n)
    moved[OUT] += tag[:, 0].sum(axis=0)
    moved[:, OUT] += tag[rows, length - 1].sum(axis=0)
    return norm, tag, moved


def train(codes: np.ndarray, tags: np.ndarray, length: np.ndarray, steps: int = 80, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Maximise the likelihood of windows (padded to one length) by Adam."""
    emit, move = np.zeros((sum(SIZES), 3)), np.zeros((3, 3))
    at = codes.astype(np.int64) + _OFFSETS
    inside = np.arange(codes.shape[1]) < length[:, None]
    truth = np.eye(3)[tags] * inside[..., None]
    rows = np.arange(len(tags))
    seen = np.zeros((3, 3))
    np.add.at(seen, (tags[:, :-1][inside[:, 1:]], tags[:, 1:][inside[:, 1:]]), 1)
    np.add.at(seen, (OUT, tags[:, 0]), 1)
    np.add.at(seen, (tags[rows, length - 1], OUT), 1)
    field, total = Field(emit, move), inside.sum()
    mean, square = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, steps + 1):
        _, tag, moved = _forward_backward(field.scores(codes), move, length)
        slack = truth - tag
        grad = np.stack([
            sum(np.bincount(at[..., k].ravel(), weights=slack[..., y].ravel(), minlength=len(emit)) for k in range(len(SIZES)))
            for y in range(3)
        ], axis=1)
        for i, (weight, g) in enumerate(((emit, grad / total - ridge * emit), (move, (seen - moved) / total - ridge * move))):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            weight += rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
        np.clip(move, -RANGE, RANGE, out=move)
    return field


def _windows(texts: Texts, listed: list[str], keywords: _Keywords):
    """Windows around known secrets, and one from the middle of every ``ORDINARY``-th text."""
    starts, ends, owner, codes = features(texts, keywords)
    edge = bounds(owner, len(texts))
    letters = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(IS_FIRST[texts.data], out=letters[1:])
    for i, text in enumerate(listed):
        a, b = edge[i], edge[i + 1]
        if a == b:
            continue
        tag = np.zeros(b - a, np.int64)
        begin = letters[starts[a:b]] - letters[texts.offsets[i]]
        stop = letters[ends[a:b]] - letters[texts.offsets[i]]
        centres = [(b - a) // 2] if zlib.crc32(text.encode()) % ORDINARY == 0 else []
        for lo, hi in secret_parts(text):
            own = np.flatnonzero((begin < hi) & (stop > lo))
            if len(own):
                tag[own] = INSIDE
                tag[own[0]] = BEGIN
                centres.append(int(own[0]))
        for c in centres[:9]:
            lo, hi = max(0, c - WINDOW), min(b - a, c + WINDOW)
            window, own = codes[a + lo : a + hi], tag[lo:hi]
            yield window, own
            if own.any():
                # Patterns know secrets by what stands beside them; the field is to
                # know them by their looks too, so it also sees these copies.
                for plain in PLAIN:
                    masked = window.copy()
                    for k, value in plain:
                        masked[own > 0, k] = value
                    yield masked, own


def learn(
    docs: DataFrame, text_col: str = "text", most_rows: int = TRAINING_ROWS, most_secrets: int = SECRET_ROWS
) -> Field | None:
    """A field from about ``most_rows`` texts without and ``most_secrets`` with secrets; None if no text shows one.

    The patterns run over all rows, and equal texts count once.  Windows come to
    the driver: 27 per text at most, of 48 tokens and 9 bytes per token, which
    bounds them by the samples.
    """
    keyed = docs.where(F.col(f"`{text_col}`").isNotNull()).select(
        F.xxhash64(F.lit("secrets"), f"`{text_col}`").alias("h"), F.col(f"`{text_col}`").alias("text")
    )

    def mark(batches):
        for batch in batches:
            shown = [shows_secret(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(shown, pa.bool_())], names=["h", "shown"])

    marked = keyed.mapInArrow(mark, "h bigint, shown boolean").distinct().groupBy("shown").count().collect()
    texts = {r["shown"]: r["count"] for r in marked}
    if not texts.get(True):
        return None
    below = {
        shown: SHARES if texts.get(shown, 0) <= most else SHARES * most // texts[shown]
        for shown, most in ((False, most_rows), (True, most_secrets))
    }
    share = F.pmod("h", F.lit(SHARES))

    def run(batches):
        keywords, seen = _Keywords(), set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                at, listed = [], piece.column("text").to_pylist()
                for i, (h, part) in enumerate(zip(piece.column("h").to_pylist(), piece.column("share").to_pylist())):
                    if h not in seen and part < below[shows_secret(listed[i])]:
                        seen.add(h)
                        at.append(i)
                chosen = piece.take(pa.array(at, pa.int64()))
                rows = [
                    (h, k, c.tobytes(), t.astype(np.uint8).tobytes())
                    for i, h in enumerate(chosen.column("h").to_pylist())
                    for k, (c, t) in enumerate(_windows(Texts(chosen.column("text").slice(i, 1)), [listed[at[i]]], keywords))
                ]
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["h", "k", "codes", "tags"]
                )

    drawn = keyed.withColumn("share", share).where(F.col("share") < max(below.values()))
    windows = drawn.mapInArrow(run, "h bigint, k int, codes binary, tags binary").distinct()
    found = windows.select("codes", "tags").orderBy(F.xxhash64("codes", "tags"), "codes", "tags").collect()
    if not any(set(r["tags"]) - {0} for r in found):
        return None
    n, t = len(found), 2 * WINDOW
    codes, tags, length = np.zeros((n, t, len(SIZES)), np.uint8), np.zeros((n, t), np.int64), np.zeros(n, np.int64)
    for i, row in enumerate(found):
        length[i] = k = len(row["tags"])
        codes[i, :k] = np.frombuffer(row["codes"], np.uint8).reshape(k, -1)
        tags[i, :k] = np.frombuffer(row["tags"], np.uint8)
    return train(codes, tags, length)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(
    docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Findings of every text.

    Columns: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``
    (kind:start:end in code points, by start and kind), ``n_crf``.  Null and
    empty texts have none; repeated rows each get their row; other columns are
    left out.  Without a field only the patterns speak.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def added(texts: Texts, keywords: _Keywords) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        starts, ends, owner, codes = features(texts, keywords)
        if field is None or not len(starts):
            return out
        tags = field.decode(codes, owner)
        hit = np.flatnonzero(tags)
        if len(hit):
            letters = np.zeros(len(texts.data) + 1, np.int64)
            np.cumsum(IS_FIRST[texts.data], out=letters[1:])
            new = np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]) | (tags[hit[1:]] == BEGIN))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(hit)) - 1
            base = letters[texts.offsets[owner[hit[first]]]]
            begin, stop = letters[starts[hit[first]]] - base, letters[ends[hit[last]]] - base
            for i, a, b in zip(owner[hit[first]].tolist(), begin.tolist(), stop.tolist()):
                out[i].append((a, b))
        return out

    def run(batches):
        keywords = _Keywords()
        for batch in batches:
            for piece in pieces(batch, text_col):
                listed = piece.column(1).to_pylist()
                extra = added(Texts(piece.column(1)), keywords)
                columns = [[] for _ in range(6)]
                for text, more in zip(listed, extra):
                    base = base_spans(text or "")
                    new = [("crf", a, b) for a, b in more if not any(a < y and x < b for _, x, y in base)]
                    every = sorted(base + new, key=lambda s: (s[1], KINDS.index(s[0])))
                    kinds = [k for k, _, _ in base]
                    row = (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(new))
                    for column, value in zip(columns, row):
                        column.append(value)
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                    names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
                )

    schema = f"`{id_col}` {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_crf bigint"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = TRAINING_ROWS) -> DataFrame:
    """Learn a field from a sample of ``docs``, then scan all of it."""
    return scan(docs, learn(docs, text_col, most_rows), id_col, text_col)
