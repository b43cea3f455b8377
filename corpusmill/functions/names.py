"""Path parts, name patterns and file classes as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv


# -- path parts -------------------------------------------------------------

def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last slash, ``''`` for a file at the root."""
    return F.regexp_extract(path, r"(?s)\A(.*)/", 1)


def extension(name: Column) -> Column:
    """Last suffix with its dot; leading dots do not start a suffix."""
    return F.regexp_extract(name, r"(?s)\A\.*[^.].*(\.[^.]*)\z", 1)


# -- pattern lists ----------------------------------------------------------

# Groups that are counted or named, backreferences, quoting and inline flags mean
# something else (or break) inside a longer pattern.
_STANDS_ALONE = re.compile(r"\\[1-9kQ]|\(\?(?:<[A-Za-z]|P|[a-zA-Z-]*[a-zA-Z])")


def joined_patterns(patterns: Iterable[str]) -> list[str]:
    """The patterns to search one after the other: plain ones as one alternation."""
    patterns = list(patterns)
    alone = [p for p in patterns if _STANDS_ALONE.search(p)]
    plain = [f"(?:{p})" for p in patterns if not _STANDS_ALONE.search(p)]
    return (["|".join(plain)] if plain else []) + alone


def java_pattern(text: str) -> str:
    """Named groups and their backreferences as Java spells them."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", text.replace("(?P<", "(?<"))


def valid_patterns(
    spark: SparkSession, patterns: Iterable[str], dropped: list[str] | None = None
) -> list[str]:
    """The patterns Spark's regex engine accepts; others go to ``dropped``.

    Patterns are Java regular expressions, so the JVM is the judge.
    """
    pattern = spark.sparkContext._jvm.java.util.regex.Pattern
    kept = []
    for text in patterns:
        try:
            pattern.compile(java_pattern(text))
        except (Py4JJavaError, IllegalArgumentException):
            if dropped is not None:
                dropped.append(text)
            continue
        kept.append(java_pattern(text))
    return kept


def hits_any(name: Column, patterns: Iterable[str]) -> Column:
    """True when any pattern is found somewhere in the name."""
    hit = F.lit(False)
    for rx in joined_patterns(patterns):
        hit = hit | name.rlike(rx)
    return hit


def has_excluded_dir(path: Column, patterns: Iterable[str]) -> Column:
    """True when a directory on the way to the file hits an exclude pattern."""
    patterns = list(patterns)
    if not patterns:
        return F.lit(False)
    folders = directory(path)
    return (folders != "") & F.exists(F.split(folders, "/"), lambda d: hits_any(d, patterns))


# -- classes ----------------------------------------------------------------

TEST_NAME_RX = (
    "(?iu)^(?:" + "|".join(fv.TEST_NAME_STEMS) + r")\.(?:"
    + "|".join(fv.TEST_NAME_EXTENSIONS) + r")\n?\z"
)


def is_test(name: Column) -> Column:
    return name.rlike(TEST_NAME_RX)


def is_resource(name: Column, ext: Column) -> Column:
    return name.isin(*fv.RESOURCE_FILENAMES) | F.lower(ext).isin(*fv.RESOURCE_EXTENSIONS)


def has_listed_extension(name: Column, ext: Column, extensions: Iterable[str]) -> Column:
    """Case-sensitive whitelist; an entry may also be a whole file name."""
    wanted = list(extensions)
    return (ext.isin(*wanted) | name.isin(*wanted)) if wanted else F.lit(False)


# -- glob rules -------------------------------------------------------------

def is_plain_glob(glob: Column) -> Column:
    """Whether a glob is plain text, or plain text after stars."""
    return ~F.rlike(plain_part(glob), F.lit(r"[*?\[]"))


def plain_part(glob: Column) -> Column:
    """A glob without its leading stars and final slashes."""
    return F.regexp_replace(glob, r"\A\*+|/+\z", "")


# One token: a bracket class, a run of stars, or a single character.
_GLOB_TOKEN = r"(?s)(\[!?\]?[^\]]*\]|\*+|.)"


def glob_to_regex(glob: Column, mode: str = "basename_suffix") -> Column:
    """Translate a shell glob to a Java regex that ends where the name ends.

    ``basename_suffix`` leaves the start open, so ``build`` also hits
    ``rebuild``; ``basename_exact`` anchors it.  ``!`` and inner slashes carry
    no special meaning.
    """
    if mode not in ("basename_suffix", "basename_exact"):
        raise ValueError(f"unknown glob mode {mode!r}")
    start = r"\A" if mode == "basename_exact" else ""
    body = F.regexp_replace(glob, r"/+\z", "")
    tokens = F.regexp_extract_all(body, F.lit(_GLOB_TOKEN), F.lit(1))
    return F.concat(
        F.lit(start + "(?s:"), F.array_join(F.transform(tokens, _glob_token), ""), F.lit(r")\z")
    )


def _glob_token(token: Column) -> Column:
    is_class = (F.length(token) > 1) & token.startswith("[")
    return (
        F.when(token.startswith("*"), F.lit(".*"))
        .when(token == "?", F.lit("."))
        .when(is_class, _glob_class(token))
        .otherwise(_literal(token))
    )


def _literal(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{N}_])", r"\\$1")


def _glob_class(token: Column) -> Column:
    negated = token.startswith("[!")
    inner = F.substring(
        token, F.when(negated, 3).otherwise(2), F.length(token) - F.when(negated, 3).otherwise(2)
    )
    # Ranges that run backwards match nothing and are dropped.
    parts = F.filter(
        F.regexp_extract_all(inner, F.lit(r"(?s)(.-.|.)"), F.lit(1)),
        lambda p: (F.length(p) < 3) | (F.substring(p, 1, 1) <= F.substring(p, 3, 1)),
    )
    members = F.array_join(
        F.transform(
            parts,
            lambda p: F.when(
                F.length(p) == 3,
                F.concat(_literal(F.substring(p, 1, 1)), F.lit("-"), _literal(F.substring(p, 3, 1))),
            ).otherwise(_literal(p)),
        ),
        "",
    )
    return (
        F.when((members == "") & negated, F.lit("."))
        .when(members == "", F.lit("(?!)"))
        .otherwise(F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), members, F.lit("]")))
    )
