"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs.  A run of ``N`` letters is the
product (binding) of their vectors, each rotated (permuted) by its place; a
document is the sum (bundling) of the vectors of its runs, and a language the
sum of its documents' vectors, each of unit length.  A text gets the language
whose vector points most nearly its way, by cosine.

Words are padded with one blank on each side, and letters are folded to lower
case.  Vectors come from a hash of the code point, so no alphabet is fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import Texts, bounds, mixed, pieces, released

DIMENSIONS = 1024
N = 3
FOLDS = 5
#: Most rows (about) of each language that its prototype is learned from.
TRAINING_ROWS = 10_000
SHARES = 1 << 40
CACHED_RUNS = 20_000
#: Work on a piece takes some hundred bytes for each of its own.
PIECE_BYTES = 1 << 18
UNKNOWN = "und"

_U = np.uint64


class _Letters:
    """Code points to letter symbols; 0 stands for all that are not letters."""

    def __init__(self) -> None:
        self.kind = np.full(0x110000, -1, np.int32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self.kind[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                c = chr(code)
                folded = c.lower()
                self.kind[code] = ord(folded) if c.isalpha() and len(folded) == 1 else code if c.isalpha() else 0
            out = self.kind[codes]
        return out


class Profiler:
    """Vectors of whole texts."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = N) -> None:
        self.dimensions, self.n = dimensions, n
        self.letters = _Letters()
        self.rows: dict[int, int] = {}
        # Signs take a byte each; room for all that are kept is taken once.
        self.vectors = np.zeros((CACHED_RUNS, dimensions), np.int8)

    def letter(self, symbols: np.ndarray) -> np.ndarray:
        """Sign vectors of symbols, one row each."""
        words = self.dimensions // 64
        with np.errstate(over="ignore"):
            seeds = symbols.astype(np.uint64)[:, None] * _U(1009) + np.arange(1, words + 1, dtype=np.uint64)
            bits = np.unpackbits(mixed(seeds * _U(0x9E3779B97F4A7C15)).view(np.uint8), axis=1)
        return bits.astype(np.int8) * 2 - 1

    def bound(self, runs: np.ndarray) -> np.ndarray:
        """Vectors of runs; each is ``N`` symbols of 21 bits in one word."""
        out = np.ones((len(runs), self.dimensions), np.int8)
        for k in range(self.n):
            symbol = (runs >> _U(21 * (self.n - 1 - k))) & _U(0x1FFFFF)
            out *= np.roll(self.letter(symbol), self.n - 1 - k, axis=1)
        return out

    def runs(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters and the texts they are of."""
        data = texts.data
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        owner = texts.owner(place)
        symbol = self.letters(codes).astype(np.uint64)
        # One blank between words and at both ends of a text.
        keep = np.ones(len(symbol), bool)
        keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0) | (owner[1:] != owner[:-1])
        symbol, owner = symbol[keep], owner[keep]
        head = np.append(True, owner[1:] != owner[:-1]) & (symbol > 0)
        at = np.flatnonzero(head)
        symbol, owner = np.insert(symbol, at, 0), np.insert(owner, at, owner[at])
        tail = np.flatnonzero(np.append(owner[1:] != owner[:-1], True) & (symbol > 0))
        symbol, owner = np.insert(symbol, tail + 1, 0), np.insert(owner, tail + 1, owner[tail])
        m = len(symbol) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.zeros(m, np.uint64)
        for k in range(self.n):
            out = (out << _U(21)) | symbol[k : k + m]
        # A run has a letter in its middle and does not reach over a word break.
        good = (owner[:m] == owner[self.n - 1 :]) & (symbol[1 : 1 + m] > 0)
        return out[good], owner[:m][good]

    def _rows(self, unique: np.ndarray) -> np.ndarray:
        """Rows of ``self.vectors`` that hold these runs' vectors."""
        keys = unique.tolist()
        missing = [k for k in keys if k not in self.rows]
        if len(self.rows) + len(missing) > CACHED_RUNS:
            self.rows, missing = {}, keys
        # Bound in slices: a vector is a thousand numbers.
        for i in range(0, len(missing), 4096):
            part, a = missing[i : i + 4096], len(self.rows)
            self.vectors[a : a + len(part)] = self.bound(np.array(part, np.uint64))
            self.rows.update(zip(part, range(a, a + len(part))))
        return np.array([self.rows[k] for k in keys], np.int64)

    def bundles(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """A vector for each text, and whether it has any letter."""
        n = len(texts)
        out = np.zeros((n, self.dimensions), np.float32)
        found, owner = self.runs(texts)
        if not len(found):
            return out, np.zeros(n, bool)
        unique, inverse = np.unique(found, return_inverse=True)
        edge = bounds(owner, n)
        if len(unique) <= CACHED_RUNS:
            rows = self._rows(unique)
            for i in range(n):
                a, b = edge[i], edge[i + 1]
                if b > a:
                    counts = np.bincount(inverse[a:b])
                    own = np.flatnonzero(counts)
                    for k in range(0, len(own), 2048):
                        part = own[k : k + 2048]
                        out[i] += counts[part].astype(np.float32) @ self.vectors[rows[part]].astype(np.float32)
        else:
            # More runs than are kept: bundle them slice by slice.
            for lo in range(0, len(unique), CACHED_RUNS):
                vectors = self.bound(unique[lo : lo + CACHED_RUNS]).astype(np.float32)
                for i in range(n):
                    part = inverse[edge[i] : edge[i + 1]] - lo
                    part = part[(part >= 0) & (part < len(vectors))]
                    if len(part):
                        out[i] += np.bincount(part, minlength=len(vectors)).astype(np.float32) @ vectors
        return out, edge[1:] > edge[:-1]


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm == 0, 1, norm)


def fold(id_col: str, folds: int = FOLDS) -> F.Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds


def shares(totals: dict[str, int], most_rows: int) -> dict[str, int]:
    """For labels of more than ``most_rows`` rows: how many of ``SHARES`` hash values are taken."""
    return {label: max(1, SHARES * most_rows // n) for label, n in totals.items() if n > most_rows}


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", most_rows: int = TRAINING_ROWS,
          dimensions: int = DIMENSIONS, n: int = N) -> tuple[list[str], np.ndarray]:
    """Languages and their unit vectors.

    Learns from about ``most_rows`` rows of each label, chosen by a hash of the
    text; a label with fewer is learned from all.  Each task sums up its vectors
    by language, so what is shuffled and collected is one vector per language
    (and task), and one count.
    """
    labelled = labelled.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    label = F.col(f"`{label_col}`").cast("string")
    totals = {r[0]: r[1] for r in labelled.groupBy(label.alias("label")).count().collect()}
    limits = shares(totals, most_rows)
    if limits:
        share = F.pmod(F.xxhash64(F.lit("learn"), f"`{text_col}`"), F.lit(SHARES))
        bound = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        labelled = labelled.where(share < F.coalesce(F.try_element_at(bound, label), F.lit(SHARES)))

    def partial(batches):
        profiler, sums = Profiler(dimensions, n), {}
        for batch in batches:
            for part in pieces(batch, text_col, PIECE_BYTES):
                vectors, _ = profiler.bundles(Texts(part.column(1)))
                vectors = _unit(vectors)
                for label in set(names := part.column(0).to_pylist()):
                    own = vectors[[x == label for x in names]].sum(axis=0, dtype=np.float64)
                    sums[label] = sums.get(label, 0) + own
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                names=["label", "sums"],
            )

    parts = labelled.select(F.col(f"`{label_col}`").cast("string").alias("label"), text_col).mapInArrow(
        released(partial), "label string, sums array<double>"
    ).select("label", F.posexplode("sums").alias("place", "x"))
    whole = parts.groupBy("label", "place").agg(F.sum("x").alias("x")).groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v")
    ).orderBy("label").collect()
    names = [r["label"] for r in whole]
    return names, _unit(np.array([[x["x"] for x in r["v"]] for r in whole]).reshape(len(names), dimensions))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text",
            dimensions: int = DIMENSIONS, n: int = N, carry: tuple[str, ...] = ()) -> DataFrame:
    """Id, ``lang_pred`` and ``score`` (the cosine, 0 to 1) of every row, and its ``carry`` columns.

    Null and empty texts and texts without letters are ``und`` with score 0, as
    are all when no language was learned.  Ties go to the first language by
    name.  Repeated rows each get their row; columns that are not
    carried are left out.
    """
    names, prototypes = model
    id_type = docs.schema[id_col].dataType.simpleString()
    listed = pa.array([*names, UNKNOWN])
    prototypes = prototypes.astype(np.float32)

    def run(batches):
        profiler = Profiler(dimensions, n)
        for batch in batches:
            for piece in pieces(batch, "_scored_text", PIECE_BYTES):
                yield scored(profiler, piece)

    def scored(profiler: Profiler, batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors, lettered = profiler.bundles(Texts(batch.column(1)))
        if names:
            cosine = _unit(vectors) @ prototypes.T
            best = np.where(lettered, cosine.argmax(axis=1), len(names))
            score = np.where(lettered, np.clip(cosine.max(axis=1, initial=0), 0, 1), 0)
        else:
            best, score = np.zeros(len(batch), np.int64), np.zeros(len(batch))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), listed.take(pa.array(best)), pa.array(score.astype(np.float64)),
             *[batch.column(1 if c == text_col else sent.index(c)) for c in carry]],
            names=[id_col, "lang_pred", "score", *carry],
        )

    # A text that is carried too is sent once, under a name of its own.
    sent = [id_col, "_scored_text", *[c for c in carry if c != text_col]]
    part = docs.select(id_col, F.col(f"`{text_col}`").alias("_scored_text"), *sent[2:])
    schema = [f"`{id_col}` {id_type}", "lang_pred string", "score double"]
    schema += [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return part.mapInArrow(released(run), ", ".join(schema))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
             most_rows: int = TRAINING_ROWS) -> DataFrame:
    """Learn outside the held-out fold, then predict every row.

    Columns: id, ``held_out``, ``lang_pred``, ``score``.
    """
    held_out = fold(id_col) == 0
    model = learn(docs.where(~held_out), text_col, label_col, most_rows)
    return predict(docs, model, id_col, text_col).select(id_col, held_out.alias("held_out"), "lang_pred", "score")
