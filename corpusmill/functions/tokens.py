"""Token counts: a native character heuristic and byte-pair encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


HEURISTIC = "heuristic"


def heuristic_tokens(text: Column) -> Column:
    """Characters over four, rounded up; null and empty text count zero."""
    return tokens_from_chars(F.length(text))


def tokens_from_chars(chars: Column) -> Column:
    n = F.coalesce(chars, F.lit(0)).cast("bigint")
    per_token = F.lit(fv.CHARS_PER_TOKEN)
    return F.call_function("div", n + (per_token - 1), per_token)


def encoding_name(model_id: Column) -> Column:
    """Name of the vocabulary a model is counted with."""
    model = F.lower(model_id)
    legacy = F.lit(False)
    for mark in fv.LEGACY_MODEL_MARKS:
        legacy = legacy | F.contains(model, F.lit(mark))
    return F.when(legacy, fv.LEGACY_ENCODING).otherwise(fv.MODERN_ENCODING)


class MissingVocabulary(Exception):
    """No usable vocabulary: the whole job counts with the heuristic."""


def local_encoder(name: str, vocabulary_dir: str):
    """An encoder from files that were placed in ``vocabulary_dir`` beforehand.

    ``<name>.tiktoken`` holds the ranks and ``<name>.pattern`` the splitting
    pattern.  The folder must exist on every worker (a shared mount, or files
    shipped with ``SparkContext.addFile``).  Files are only read.
    """
    import base64
    import os

    import tiktoken

    try:
        with open(os.path.join(vocabulary_dir, f"{name}.pattern"), encoding="utf-8") as stream:
            pattern = stream.read().rstrip("\n")
        with open(os.path.join(vocabulary_dir, f"{name}.tiktoken"), "rb") as stream:
            pairs = [line.split() for line in stream if line.strip()]
    except OSError as problem:
        raise MissingVocabulary(str(problem)) from problem
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def usable(encoder: Callable[[], object]) -> bool:
    """Whether the encoder is there; asked once per job, on the driver.

    A missing vocabulary or library means the heuristic.  One that is there and
    broken is an error.
    """
    try:
        encoder()
    except (MissingVocabulary, OSError, ImportError):
        return False
    return True


def bpe_tokens(text: Column, encoder: Callable[[], object]) -> Column:
    """Tokens by a byte-pair encoder, or all of them by the heuristic.

    ``encoder`` builds an object with ``encode(text, disallowed_special=())``.
    The choice is made here, for the whole job: without a usable encoder the
    plan has no Python stage, and with one a task that cannot build it fails.
    Null texts count zero.
    """
    if not usable(encoder):
        return heuristic_tokens(text)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder().encode
        for batch in batches:
            yield pd.Series([0 if t is None else len(encode(t, disallowed_special=())) for t in batch], dtype="int64")

    return F.pandas_udf(count, "bigint")(text)


def _model_encoder(model_id: str, vocabulary_dir: str) -> tuple[str, Callable[[], object]]:
    legacy = any(mark in model_id.lower() for mark in fv.LEGACY_MODEL_MARKS)
    name = fv.LEGACY_ENCODING if legacy else fv.MODERN_ENCODING
    return name, partial(local_encoder, name, vocabulary_dir)


def token_method(model_id: str, vocabulary_dir: str | None) -> str:
    """How a job counts: the name of a vocabulary, or ``heuristic``."""
    if vocabulary_dir:
        name, encoder = _model_encoder(model_id, vocabulary_dir)
        if usable(encoder):
            return name
    return HEURISTIC


def model_tokens(text: Column, model_id: str, vocabulary_dir: str | None) -> Column:
    """Tokens of ``text`` for one model, by the method :func:`token_method` names."""
    if token_method(model_id, vocabulary_dir) == HEURISTIC:
        return heuristic_tokens(text)
    return bpe_tokens(text, _model_encoder(model_id, vocabulary_dir)[1])
