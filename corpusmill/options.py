"""Options of one job, shared by every operator."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, fields, replace
from typing import Any

from . import fixed_values as fv

DEPTHS = ("full", "skeleton", "tree_only")

_TRUE_WORDS = {"true", "1", "yes", "y", "si", "sí"}
_FALSE_WORDS = {"false", "0", "no", "n"}


@dataclass(frozen=True)
class JobOptions:
    """What to admit, how to change it and what to write.

    An empty tuple of patterns or extensions means "none", not "the default".
    ``user_name`` and ``home_dir`` are options because an executor's own login
    says nothing about who wrote the corpus.
    """

    input_path: str = ""
    output_base_dir: str = ""
    output_subdir_name: str = fv.OUTPUT_SUBDIR
    output_prefix: str = fv.OUTPUT_PREFIX

    processing_depth: str = "full"
    process_tests: bool = True
    process_resources: bool = True

    extensions: tuple[str, ...] = fv.DEFAULT_EXTENSIONS
    include_patterns: tuple[str, ...] = fv.DEFAULT_INCLUDE_PATTERNS
    exclude_patterns: tuple[str, ...] = fv.DEFAULT_EXCLUDE_PATTERNS
    respect_gitignore: bool = False
    glob_mode: str = "basename_suffix"

    create_individual_files: bool = True
    create_unified_file: bool = True
    save_error_log: bool = False

    generate_tree: bool = True
    tree_mode: str = "all"
    show_functions: bool = False
    show_classes: bool = False
    show_methods: bool = False

    enable_sanitizer: bool = False
    mask_user_paths: bool = False
    minify_output: bool = False
    user_name: str = ""
    home_dir: str = ""

    target_model: str = fv.DEFAULT_MODEL

    def __post_init__(self) -> None:
        if self.processing_depth not in DEPTHS:
            raise ValueError(f"processing_depth must be one of {DEPTHS}")

    @property
    def process_modules(self) -> bool:
        return self.processing_depth != "tree_only"

    @property
    def wants_symbols(self) -> bool:
        return self.show_functions or self.show_classes or self.show_methods

    def with_(self, **changes: Any) -> "JobOptions":
        return replace(self, **changes)

    def config_fingerprint(self) -> str:
        """MD5 over the settings that change a file's processed text.

        The masked names join the list only when masking is on, so jobs without
        masking share one fingerprint whoever runs them.
        """
        parts: list[Any] = [
            self.processing_depth, self.process_tests, self.process_resources,
            self.enable_sanitizer, self.mask_user_paths, self.minify_output,
        ]
        if self.mask_user_paths:
            parts += [self.user_name, self.home_dir]
        return hashlib.md5(json.dumps(parts).encode("utf-8")).hexdigest()

    def planned_outputs(self) -> list[str]:
        """Names a run with these options may write, in a fixed order."""
        kinds: list[str] = []
        if self.create_individual_files:
            if self.process_modules:
                kinds.append("modules")
            if self.process_tests:
                kinds.append("tests")
            if self.process_resources:
                kinds.append("resources")
            if self.generate_tree:
                kinds.append("tree")
        if self.create_unified_file:
            kinds.append("full_context")
        if self.save_error_log:
            kinds.append("errors")
        return [f"{self.output_prefix}_{kind}" for kind in kinds]

    def output_path(self) -> str:
        base = normalize_path(self.output_base_dir, self.input_path or ".")
        sub = self.output_subdir_name.strip() or fv.OUTPUT_SUBDIR
        return f"{base.rstrip('/')}/{sub}"


def normalize_path(path: str | None, fallback: str) -> str:
    """Expand ``~`` and variables; make local paths absolute.

    A path with a scheme (``hdfs://``, ``s3a://`` ...) is left as it is: Hadoop
    resolves those.
    """
    text = (path or "").strip() or fallback
    if "://" in text:
        return text
    return os.path.abspath(os.path.expandvars(os.path.expanduser(text)))


def split_csv(text: str) -> list[str]:
    return [item.strip() for item in text.split(",") if item.strip()]


def options_from_mapping(
    raw: dict[str, Any], strict: bool = False
) -> tuple[JobOptions, list[str]]:
    """Build :class:`JobOptions` from loosely typed settings.

    Returns the options and one warning per value that had to be converted or
    dropped.  With ``strict`` such a value raises instead.  Keys this library
    does not know are ignored.
    """
    notes: list[str] = []

    def reject(message: str, kind: type[Exception] = TypeError) -> None:
        if strict:
            raise kind(message)
        notes.append(message)

    if not isinstance(raw, dict):
        reject(f"settings must be a dict, not {type(raw).__name__}; defaults used")
        return JobOptions(), notes

    chosen: dict[str, Any] = {}
    for field in fields(JobOptions):
        value = raw.get(field.name)
        if value is None:
            continue
        default = field.default
        if isinstance(default, bool):
            chosen[field.name] = _to_bool(field.name, value, default, strict, reject, notes)
        elif isinstance(default, tuple):
            chosen[field.name] = _to_names(field.name, value, default, strict, reject, notes)
        elif isinstance(value, str):
            chosen[field.name] = value.strip() or default
        else:
            reject(f"{field.name}: text expected, got {type(value).__name__}")

    modules = raw.get("process_modules")
    if modules is not None and not _to_bool(
        "process_modules", modules, True, strict, reject, notes
    ):
        chosen["processing_depth"] = "tree_only"
    if "extensions" in chosen:
        chosen["extensions"] = _dotted(chosen["extensions"], strict, reject)
    return JobOptions(**chosen), notes


def _to_bool(name, value, default, strict, reject, notes) -> bool:
    if isinstance(value, bool):
        return value
    word = None
    if not strict and isinstance(value, str):
        word = value.strip().lower()
    elif not strict and isinstance(value, (int, float)) and value in (0, 1):
        word = str(int(value))
    for words, meaning in ((_TRUE_WORDS, True), (_FALSE_WORDS, False)):
        if word in words:
            notes.append(f"{name}: {value!r} read as {meaning}")
            return meaning
    reject(f"{name}: true or false expected, got {value!r}")
    return default


def _to_names(name, value, default, strict, reject, notes) -> tuple[str, ...]:
    if isinstance(value, str) and not strict:
        items = split_csv(value)
        if not items:
            return tuple(default)
        notes.append(f"{name}: comma separated text read as a list")
        return tuple(items)
    if not isinstance(value, (list, tuple)):
        reject(f"{name}: a list of text expected, got {type(value).__name__}")
        return tuple(default)
    for item in value:
        if not isinstance(item, str):
            reject(f"{name}: {item!r} is not text and was dropped")
    return tuple(i.strip() for i in value if isinstance(i, str) and i.strip())


def _dotted(names: tuple[str, ...], strict, reject) -> tuple[str, ...]:
    """Give plain extensions (``py``) their dot, leave file names alone.

    A name is a file name when it has a capital first letter or an inner dot
    (``Makefile``, ``composer.json``).
    """
    out = []
    for name in names:
        if not name.startswith("."):
            if strict:
                reject(f"extension {name!r} must start with '.'", ValueError)
            if not (name[0].isupper() or "." in name):
                reject(f"extension {name!r} read as '.{name}'")
                name = "." + name
        out.append(name)
    return tuple(dict.fromkeys(out))
