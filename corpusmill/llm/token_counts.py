"""Token counts by a compiled finite-state transducer.

Byte-pair merging looks like a global affair, but the last token of every
prefix follows from the last tokens of shorter prefixes: it is the one token
ending there that merging would leave beside its left neighbour.  So a left to
right automaton can carry what the future may need, which is, for each suffix
of the input that begins some token, the last token before it and how many
tokens lie between.  Equal sets are one state.  A transition on a byte says how
much the number of tokens changes by it (it may shrink).

States are compiled when a text first needs them, into tables with a fixed
bound, and the tables are started afresh when full.  Texts are cut into chunks
that all run at the same time, one table lookup per step for all chunks.  A
chunk's state map holds its end state and its count for each state that can
enter it: a guess from the bytes before the chunk, and whatever end state its
left neighbour's map turns out to have.  Once every end state has its place in
the right neighbour's map, the maps compose pairwise in a parallel prefix scan.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .texts import Texts, by_piece, pieces

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK_BYTES = 4096
GUESS_BYTES = 96
WIDEN_AFTER = 4
WIDEN_STATES = 64
PIECE_BYTES = 8 << 20
MAX_STATES = 1 << 16

# How a token looks from one side while it is being merged: (part at that edge,
# when it arose, when it was merged further).
Edge = tuple[tuple[str, float, float], ...]
# What may follow a token: the edge parts that matter, or the tokens that fit.
Before = Edge | frozenset
# A state: (suffix, what may follow the token before it, tokens from there on, negative).
State = tuple[tuple[str, Before, int], ...]
ROOT: State = (("", (), 0),)
FEW_TOKENS = 64


class Transducer:
    """Counts tokens as a sentencepiece byte-pair model with byte fallback does."""

    def __init__(self, model_path: str, max_states: int = MAX_STATES) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.rank = {
            model.id_to_piece(i): -model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        }
        self.tokens: dict[str, list[str]] = {}  # by proper prefix
        for p in self.rank:
            for k in range(1, len(p)):
                self.tokens.setdefault(p[:k], []).append(p)
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("tokens of this model reach over word breaks")
        self.max_states = max_states
        self._edges: dict[str, tuple[Edge, Edge] | None] = {}
        self._seen: dict[tuple[str, Before], Before] = {}
        self._clear([])

    # -- compiling ----------------------------------------------------------

    def edges(self, token: str) -> tuple[Edge, Edge] | None:
        """Left and right edge while ``token`` is merged; None if it never arises.

        A merge happens when all better ones that were possible are done, so its
        time is the worst rank up to and with it.
        """
        if token in self._edges:
            return self._edges[token]
        parts, time = list(token), 0.0
        left, right = [(parts[0], 0.0)], [(parts[-1], 0.0)]
        while len(parts) > 1:
            rank, i = min((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == np.inf:
                break
            time = max(time, rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                left.append((parts[0], time))
            if i == len(parts) - 1:
                right.append((parts[-1], time))
        found = None
        if len(parts) == 1:
            ends = [tuple((x, t, u) for (x, t), (_, u) in zip(e, [*e[1:], ("", np.inf)])) for e in (left, right)]
            found = (ends[0], ends[1])
        self._edges[token] = found
        return found

    def fits(self, before: Before, token: str) -> bool:
        """Whether merging keeps the boundary between what came before and ``token``.

        It is lost if two parts that meet there form a token whose rank comes
        before either part is merged further (with equal ranks the left goes first).
        """
        if isinstance(before, frozenset):
            return token in before
        own = self.edges(token)
        if own is None:
            return False
        for x, x_from, x_to in before:
            for y, y_from, y_to in own[0]:
                rank = self.rank.get(x + y)
                if rank is not None and rank < x_to and rank <= y_to and max(x_from, y_from) < min(x_to, y_to):
                    return False
        return True

    def _narrowed(self, suffix: str, before: Before) -> Before:
        """``before`` without what no token that begins with ``suffix`` can tell apart."""
        key = (suffix, before)
        found = self._seen.get(key)
        if found is None:
            tokens = self.tokens[suffix]
            if len(tokens) <= FEW_TOKENS:
                found = frozenset(t for t in tokens if self.fits(before, t))
            else:
                found = tuple(
                    e for e in before
                    if e[0] + suffix in self.tokens or any(e[0] + suffix[:k] in self.rank for k in range(1, len(suffix) + 1))
                )
            if len(self._seen) > 500_000:
                self._seen = {}
            self._seen[key] = found
        return found

    def after(self, state: State, char: str) -> tuple[State, int]:
        """The next state, and how many tokens more (or fewer) there are."""
        if char not in self.rank:
            return ROOT, len(char.encode())
        token, since = next(
            (suffix + char, count)
            for suffix, before, count in state
            if suffix + char in self.rank and self.fits(before, suffix + char)
        )
        delta = since + 1
        chain = []
        for suffix, before, count in state:
            if suffix + char in self.tokens:
                before = self._narrowed(suffix + char, before)
                if before != frozenset():
                    chain.append((suffix + char, before, count - delta))
        edge = tuple(e for e in self.edges(token)[1] if e[0] in self.tokens)
        return (*chain, ("", edge, 0)), delta

    def _clear(self, keep: list) -> list[int]:
        self.ids: dict[tuple[State, bytes], int] = {}
        self.states: list[tuple[State, bytes]] = []
        self.next = np.full(256 * 1024, -1, np.int32)
        self.delta = np.zeros(256 * 1024, np.int8)
        self.root = self._id((ROOT, b""))
        start, self.first_delta = self.after(ROOT, SPACE)
        self.begin = self._id((start, b""))
        self.word = self._id((self.after(self.after(ROOT, "a")[0], SPACE)[0], b""))
        return [self._id(k) for k in keep]

    def _id(self, key: tuple[State, bytes]) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            if 256 * len(self.states) > len(self.next):
                self.next = np.concatenate([self.next, np.full(len(self.next), -1, np.int32)])
                self.delta = np.concatenate([self.delta, np.zeros(len(self.delta), np.int8)])
        return found

    def _compile(self, slot: int) -> None:
        (state, pending), byte = self.states[slot >> 8], slot & 255
        pending += bytes([byte])
        lead = pending[0]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        if len(pending) < width:
            self.next[slot] = self._id((state, pending))
            return
        char = pending.decode()
        state, delta = self.after(state, SPACE if char == " " else char)
        target = self._id((state, b""))
        self.next[slot], self.delta[slot] = target, delta

    # -- running ------------------------------------------------------------

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray):
        """End states and count changes of spans, each from its own state."""
        order = np.argsort(starts - ends, kind="stable")
        at, n = starts[order], (ends - starts)[order]
        state, total = states[order].astype(np.int64), np.zeros(len(order), np.int64)
        active = len(order) - np.searchsorted(n[::-1], np.arange(1, int(n.max(initial=0)) + 1), side="left")
        for k, m in enumerate(active.tolist()):
            slot = (state[:m] << 8) + data[at[:m] + k]
            to = self.next[slot]
            if to.min() < 0:
                for missing in np.unique(slot[to < 0]).tolist():
                    self._compile(missing)
                to = self.next[slot]
            total[:m] += self.delta[slot]
            state[:m] = to
            if len(self.states) > self.max_states:
                # Start the tables afresh with the states that are still in use.
                used, back = np.unique(state, return_inverse=True)
                fresh = self._clear([self.states[s] for s in used.tolist()])
                state = np.array(fresh, np.int64)[back]
                self.generation += 1
        out_state, out_total = np.empty_like(state), np.empty_like(total)
        out_state[order], out_total[order] = state, total
        return out_state, out_total

    generation = 0

    def count(self, texts: Texts, chunk: int = CHUNK_BYTES) -> np.ndarray:
        """Tokens of each text."""
        sizes, n = texts.n_bytes, len(texts)
        chunks = -(-sizes // chunk)
        owner = np.repeat(np.arange(n), chunks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        data, first = texts.data, number == 0
        last = np.append(first[1:], True)[: len(owner)]

        def aligned(at: np.ndarray, stop: np.ndarray) -> np.ndarray:
            """The next places where a character begins."""
            for _ in range(3):
                at = at + ((at < stop) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80))
            return at

        stops = texts.offsets[1:][owner]
        starts = aligned(np.minimum(texts.offsets[:-1][owner] + number * chunk, stops), stops)
        ends = np.where(last, stops, np.append(starts[1:], 0)[: len(owner)])
        generation = self.generation
        # The entry states: what the bytes before a chunk lead to, from a word's begin on.
        warm = aligned(np.maximum(starts - GUESS_BYTES, texts.offsets[:-1][owner]), starts)
        enters, _ = self.run(data, warm, starts, np.full(len(owner), self.word))
        enters = np.where(first, self.begin, enters)
        maps = _StateMaps(len(owner))
        new_chunk, new_state = np.arange(len(owner)), enters
        rounds = 0
        while len(new_chunk):
            rounds += 1
            if rounds % WIDEN_AFTER == 0:
                # Phases that go round, as in a long run of one character: let
                # each state that was met enter every chunk of these texts.
                met = np.unique(new_state)[:WIDEN_STATES]
                chunks = np.flatnonzero(np.isin(owner, owner[new_chunk]) & ~first)
                wide = np.repeat(chunks, len(met)), np.tile(met, len(chunks))
                new_chunk, new_state = maps.missing(
                    np.concatenate([new_chunk, wide[0]]), np.concatenate([new_state, wide[1]])
                )
            end, total = self.run(data, starts[new_chunk], ends[new_chunk], new_state)
            if self.generation != generation:
                # State numbers changed meanwhile; count these texts one by one.
                return np.array([self.count_one(bytes(data[a:b])) for a, b in zip(texts.offsets, texts.offsets[1:])])
            maps.add(new_chunk, new_state, end, total)
            inner = ~last[new_chunk]
            new_chunk, new_state = maps.missing(new_chunk[inner] + 1, end[inner])
        total = maps.compose(first, last, enters)
        out = np.zeros(n, np.int64)
        out[owner[first]] = total
        return out + np.where(sizes > 0, self.first_delta, 0)

    def count_one(self, text: bytes) -> int:
        """Tokens of one text without tables, for texts that overflow them."""
        if not text:
            return 0
        state, total = self.after(ROOT, SPACE)
        for char in text.decode():
            state, delta = self.after(state, SPACE if char == " " else char)
            total += delta
        return total


class _StateMaps:
    """State maps of chunks: rows of ``(chunk, entry state)`` with end state and count."""

    def __init__(self, n_chunks: int) -> None:
        self.n_chunks = n_chunks
        self.keys = self.end = self.total = np.zeros(0, np.int64)

    def _find(self, chunk: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of rows, and whether they are there."""
        key = (chunk << 32) | state
        at = np.searchsorted(self.keys, key)
        return at, (at < len(self.keys)) & (np.append(self.keys, -1)[at] == key)

    def add(self, chunk: np.ndarray, state: np.ndarray, end: np.ndarray, total: np.ndarray) -> None:
        keys = np.concatenate([self.keys, (chunk << 32) | state])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.end = np.concatenate([self.end, end])[order]
        self.total = np.concatenate([self.total, total])[order]

    def missing(self, chunk: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs that no map holds."""
        _, there = self._find(chunk, state)
        key = np.unique((chunk[~there] << 32) | state[~there])
        return key >> 32, key & 0xFFFFFFFF

    def compose(self, first: np.ndarray, last: np.ndarray, enters: np.ndarray) -> np.ndarray:
        """Count of every text: its chunks' maps composed, applied to its first state.

        Every step composes each map with the one that follows what it covers, so
        it covers twice as many chunks; the longest text takes log2(chunks) steps.
        """
        n, chunk = len(self.keys), self.keys >> 32
        follows = np.full(n + 1, n)
        inner = np.flatnonzero(~last[chunk])
        follows[inner], there = self._find(chunk[inner] + 1, self.end[inner])
        if not there.all():
            raise ValueError("an end state has no place in the next map")
        total = np.append(self.total, 0)
        while (follows[:n] < n).any():
            total += total[follows]
            follows = follows[follows]
        starts = np.flatnonzero(first)
        return total[self._find(starts, enters[starts])[0]]


_LOADED: dict[str, Transducer] = {}


def transducer(model_path: str) -> Transducer:
    """One transducer per worker; what it has compiled serves later tasks too."""
    if model_path not in _LOADED:
        _LOADED[model_path] = Transducer(model_path)
    return _LOADED[model_path]


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = LIMIT,
) -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every document.

    A null text is empty and has 0 tokens; repeated rows each get their row;
    other columns are left out; the order of rows does not matter.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = transducer(public_tokenizers.path(model))
        for batch in batches:
            for piece in pieces(batch, text_col, PIECE_BYTES):
                texts = Texts(piece.column(1))
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(texts.n_bytes), pa.array(n), pa.array(n > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    schema = f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
