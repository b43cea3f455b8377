"""Redaction, path masking and minifying as native column expressions.

All functions take the text of a whole file and keep *line* semantics: a
pattern never spans a line feed and blank runs are counted in lines, yet no
line is ever exploded into a row.  Only ``\\n`` ends a line; use
:func:`read_text` first on raw bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..options import JobOptions

# Unicode blanks without the line feed, and Unicode word characters.  Written
# out because Java's \s, \w and \b are ASCII-only by default; ASCII comes first
# because most characters are, and one failed test is then enough for them.
BLANKS = (
    r"\t\x0B\f\r \x1c\x1d\x1e\x1f"
    r"[[^\x00-\x7f]&&[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
_WORD = r"[\p{L}\p{N}_]"

API_KEY_RX = r"sk-[a-zA-Z0-9-]{32,}"
CLOUD_KEY_RX = r"AKIA[0-9A-Z]{16}"
IP_RX = rf"(?=\p{{Nd}})(?<!{_WORD})(?:\p{{Nd}}{{1,3}}\.){{3}}\p{{Nd}}{{1,3}}(?!{_WORD})"
# A run of local-part characters is tried once, from its start (or from where the
# last match ended): no later start in it can match if this one does not, as all
# share what follows the run.  The first group is what stands before the run's
# first word edge; it is put back.
EMAIL_RX = (
    r"(?:\G|(?<![\w.%+-]))"
    rf"((?<={_WORD})\w*+|(?<!{_WORD})[.%+-]*+)[\w.%+-]++"
    r"@[\p{Alnum}.-]+\.[\p{Alpha}|]{2,}"
    rf"(?:(?<=\p{{Alpha}})(?!{_WORD})|(?<=\|)(?={_WORD}))"
)

_WORDS = "|".join(fv.CREDENTIAL_WORDS)
# The look-ahead only skips positions no credential word can start at.  It
# spells out both cases (and the two letters that fold to k and s), because a
# case-insensitive class is slow.
ASSIGNMENT_RX = (
    rf"(?=[kKpPsStTaA\u212a\u017f])(?iu)((?:{_WORDS})[-_]?(?:{_WORDS})?[{BLANKS}]*[:=][{BLANKS}]*['\"])"
    rf"[^'\"\n]{{{fv.MIN_CREDENTIAL_CHARS},}}(['\"])"
)


def read_text(raw: Column) -> Column:
    """UTF-8 bytes to text: bad bytes become U+FFFD, CR and CRLF become LF."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"\r\n?", "\n")


# -- redaction --------------------------------------------------------------

def redact_api_keys(text: Column) -> Column:
    return F.regexp_replace(text, API_KEY_RX, fv.MARK_SENSITIVE)


def redact_cloud_keys(text: Column) -> Column:
    return F.regexp_replace(text, CLOUD_KEY_RX, fv.MARK_SENSITIVE)


def redact_ips(text: Column) -> Column:
    return F.regexp_replace(text, IP_RX, fv.MARK_SENSITIVE)


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL_RX, rf"$1{fv.MARK_SENSITIVE}")


def redact_assignments(text: Column) -> Column:
    """``token = "…"``: keep the name and the quotes, hide the value."""
    return F.regexp_replace(text, ASSIGNMENT_RX, rf"$1{fv.MARK_SECRET}$2")


# The order is part of the result: a key inside an assignment gets both marks.
# The second item is text that must be present for the pattern to match at all.
REDACTION_STEPS = (
    (redact_api_keys, "sk-"),
    (redact_cloud_keys, "AKIA"),
    (redact_ips, None),
    (redact_emails, "@"),
    (redact_assignments, None),
)


def redact_all(text: Column) -> Column:
    for step, _ in REDACTION_STEPS:
        text = step(text)
    return text


def redact_column(df: DataFrame, name: str) -> DataFrame:
    """:func:`redact_all` on a column, skipping patterns that cannot match.

    A substring test on the raw bytes is far cheaper than a regex pass, and
    most files hold no key, no address and no mail.  Each step is a projection
    of its own, so the text expression is never duplicated.
    """
    for step, needle in REDACTION_STEPS:
        text = F.col(name)
        changed = step(text)
        if needle is not None:
            changed = F.when(F.contains(text, F.lit(needle)), changed).otherwise(text)
        df = df.withColumn(name, changed)
    return df


# -- masking ----------------------------------------------------------------

def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in text)


def mask_paths(text: Column, home_dir: str = "", user_name: str = "") -> Column:
    """Hide the home directory (any case) and the user name between slashes.

    Every backslash becomes a slash first, also outside paths.
    """
    text = F.translate(text, "\\", "/")
    if home_dir:
        home = home_dir.replace("\\", "/")
        text = F.regexp_replace(text, f"(?iu){_quoted(home)}", fv.MARK_HOME)
    if user_name:
        text = F.regexp_replace(text, f"/{_quoted(user_name)}/", f"/{fv.MARK_USER}/")
    return text


# -- minifying --------------------------------------------------------------

def strip_hash_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"#[^\n]*", "")


def strip_slash_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"//[^\n]*", "")


def strip_comments(text: Column, ext: Column) -> Column:
    """Drop comments by the extension's syntax; other extensions stay whole."""
    kind = F.lower(F.coalesce(ext, F.lit("")))
    return (
        F.when(kind.isin(*fv.HASH_COMMENT_EXTENSIONS), strip_hash_comments(text))
        .when(kind.isin(*fv.SLASH_COMMENT_EXTENSIONS), strip_slash_comments(text))
        .otherwise(text)
    )


def with_final_newline(text: Column) -> Column:
    closed = (text == "") | text.endswith("\n")
    return F.concat(text, F.when(closed, "").otherwise("\n"))


def trim_lines(text: Column) -> Column:
    """Cut blanks at line ends; a non-empty text ends with a line feed."""
    return _trim_closed_lines(with_final_newline(text))


def _trim_closed_lines(text: Column) -> Column:
    # The look-behind admits only the first blank of a run, which keeps long
    # runs linear; testing it after that blank is what makes it cheap.
    return F.regexp_replace(text, rf"[{BLANKS}](?<![{BLANKS}][{BLANKS}])[{BLANKS}]*+\n", "\n")


def collapse_blank_lines(text: Column) -> Column:
    """Keep one of each run of blank lines, also at the very start."""
    return F.regexp_replace(text, r"\n(?<=\n\n\n|\A\n\n)\n*", "")


def minify(text: Column, ext: Column) -> Column:
    # The last line is closed first: a comment on it leaves an empty line.
    closed = with_final_newline(text)
    return collapse_blank_lines(_trim_closed_lines(strip_comments(closed, ext)))


def minify_whole(text: Column, ext: Column) -> Column:
    """:func:`minify`, without any blank or line feed at the very end."""
    # Lines are trimmed already, so only line feeds can be left there.
    return F.rtrim(minify(text, ext), F.lit("\n"))


def reduction_percent(before: Column, after: Column) -> Column:
    """Share of the characters a change saved; null for empty input."""
    return 100 - F.length(after) * 100 / F.nullif(F.length(before), F.lit(0))


# -- the whole chain --------------------------------------------------------

def transform_column(
    df: DataFrame, options: JobOptions, name: str = "content", ext: str = "ext"
) -> DataFrame:
    """Skeleton, minify, redact, mask, as far as the options ask for them."""
    if options.processing_depth == "skeleton":
        from .pycode import skeleton_where_python

        df = df.withColumn(name, skeleton_where_python(F.col(name), F.col(ext)))
    if options.minify_output:
        df = df.withColumn(name, minify(F.col(name), F.col(ext)))
    if options.enable_sanitizer:
        df = redact_column(df, name)
    if options.mask_user_paths:
        df = df.withColumn(
            name, mask_paths(F.col(name), options.home_dir, options.user_name)
        )
    return df


# -- small helpers on text columns ------------------------------------------

def csv_list(text: Column) -> Column:
    """Comma separated text to an array: items trimmed, empty ones dropped."""
    trimmed = F.transform(
        F.split(text, ","),
        lambda item: F.regexp_replace(item, rf"\A[{BLANKS}\n]+|[{BLANKS}\n]+\z", ""),
    )
    return F.filter(trimmed, lambda item: item != "")


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def checksum_differs(digest: Column, expected: Column) -> Column:
    """True when a digest was promised and does not match, ignoring case."""
    return F.coalesce(F.lower(digest) != F.lower(F.nullif(expected, F.lit(""))), F.lit(False))
