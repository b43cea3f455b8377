"""Quality rules: compression bands.

Text that says the same again and again compresses far better than prose, and
random characters compress worse.  Whole documents and fixed chunks are
compressed with zstandard; the ratio (bytes in over bytes out) must lie within
limits that depend on the length compressed, because short texts compress less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .texts import IS_FIRST, IS_SPACE, Texts, by_piece, shingles

LEVEL = 3
CHUNK_BYTES = 4096
#: What is left after the last full chunk is a chunk of its own from this length.
REST_BYTES = 1_000

#: (bytes from, least ratio, greatest ratio); a row holds up to the next one.
#: From 150 bytes the least ratio lies between what was measured for words of random
#: base64 characters and for prose, shorter texts of the two overlap.
BANDS = (
    (0, 0.9, 3.4),
    (150, 1.07, 3.4),
    (200, 1.14, 3.4),
    (300, 1.22, 3.4),
    (400, 1.28, 3.4),
    (500, 1.33, 3.4),
    (700, 1.4, 3.4),
    (1_000, 1.45, 3.8),
    (2_000, 1.5, 3.8),
    (4_000, 1.5, 4.4),
    (16_000, 1.5, 5.2),
    (64_000, 1.55, 6.5),
)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, least_chunk_ratio double, most_chunk_ratio double"
)


def limits(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(bands) if n_bytes >= start)


def within(n_bytes: int, ratio: float, bands=BANDS) -> bool:
    low, high = limits(n_bytes, bands)
    return low <= ratio <= high


def ratios(text: bytes, press: zstandard.ZstdCompressor, chunk: int = CHUNK_BYTES) -> list[tuple[int, float]]:
    """Length and ratio of the whole text, then of its chunks if it holds a full one.

    They cover the text: a rest of ``REST_BYTES`` or more is judged by itself, a
    shorter one within the last ``chunk`` bytes.
    """
    parts = [text, *(text[i : i + chunk] for i in range(0, len(text) - chunk + 1, chunk))]
    rest = len(text) % chunk if len(text) > chunk else 0
    if rest:
        parts.append(text[-rest:] if rest >= REST_BYTES else text[-chunk:])
    return [(len(p), len(p) / len(press.compress(p))) for p in parts if p]


def repeated_words(hashes: np.ndarray, owners: np.ndarray, n: int, window: int = 3) -> np.ndarray:
    """Words of each text inside a window that the text holds twice or more."""
    covered = np.zeros(len(hashes), bool)
    found, of = shingles(hashes, owners, window)
    if len(found):
        first = np.flatnonzero(owners[: len(hashes) - window + 1] == owners[window - 1 :])
        order = np.lexsort((found, of))
        h, o = found[order], of[order]
        same = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
        again = np.zeros(len(h), bool)
        again[1:] |= same
        again[:-1] |= same
        at = first[order[again]]
        for k in range(window):
            covered[at + k] = True
    return np.bincount(owners[covered], minlength=n)


def duplicate_lines(texts: Texts) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    starts, ends, owners = texts.lines()
    has = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(~IS_SPACE[texts.data], out=has[1:])
    worded = has[ends] > has[starts]
    starts, ends, owners = starts[worded], ends[worded], owners[worded]
    h = texts.hashes(starts, ends)
    order = np.lexsort((h, owners))
    h, o = h[order], owners[order]
    return np.bincount(o[1:][(h[1:] == h[:-1]) & (o[1:] == o[:-1])], minlength=len(texts))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS) -> DataFrame:
    """One row per document: counts, the plain rules and the verdict.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` (under 50 words, or
    over half of them in repeated three-word windows), ``kept``, and the ratios.
    A null text counts as empty and fails; repeated rows each get their row;
    other columns are left out.  Documents are judged one by one, so neither
    ties nor hot keys exist.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(1))
        n = len(texts)
        inside = ~IS_SPACE[texts.data]
        starts, ends, owners = texts.words()
        n_words = np.bincount(owners, minlength=n)
        repeats = repeated_words(texts.hashes(starts, ends), owners, n)
        failed = (n_words < 50) | (100 * repeats > 50 * n_words)
        press = zstandard.ZstdCompressor(level=LEVEL)
        whole, least, most, kept = [], [], [], []
        for i in range(n):
            found = ratios(texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes(), press)
            chunks = [r for _, r in found[1:]]
            whole.append(found[0][1] if found else None)
            least.append(min(chunks, default=None))
            most.append(max(chunks, default=None))
            kept.append(bool(not failed[i] and all(within(size, r, bands) for size, r in found)))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(n_words), pa.array(texts.counted(inside & IS_FIRST[texts.data])),
                pa.array(texts.counted(_IS_SYMBOL[texts.data])), pa.array(duplicate_lines(texts)),
                pa.array(repeats), pa.array(failed), pa.array(kept), pa.array(whole, pa.float64()),
                pa.array(least, pa.float64()), pa.array(most, pa.float64()),
            ],
            names=[id_col, *(c.split()[0] for c in SCHEMA.split(", "))],
        )

    return docs.select(id_col, text_col).mapInArrow(by_piece(work, text_col), f"`{id_col}` {id_type}, {SCHEMA}")
