import os

import pytest

from corpusmill.options import JobOptions, normalize_path, options_from_mapping


def test_words_and_lists_are_read():
    options, notes = options_from_mapping({
        "minify_output": "yes", "generate_tree": 0, "enable_sanitizer": "Sí", "extensions": "py, .js,Makefile, composer.json",
        "include_patterns": ["^a", 3, " "], "exclude_patterns": [], "processing_depth": " skeleton ", "unknown": 1,
    })
    assert (options.minify_output, options.generate_tree, options.enable_sanitizer) == (True, False, True)
    assert options.extensions == (".py", ".js", "Makefile", "composer.json")
    assert options.include_patterns == ("^a",) and options.exclude_patterns == ()
    assert options.processing_depth == "skeleton" and len(notes) == 6


def test_bad_values_fall_back_or_raise():
    options, notes = options_from_mapping({"minify_output": "perhaps", "output_prefix": 5, "extensions": 3})
    assert options == JobOptions() and len(notes) == 3
    for bad in ({"minify_output": "yes"}, {"extensions": ["py"]}, {"extensions": [1]}, {"output_prefix": 5}):
        with pytest.raises((TypeError, ValueError)):
            options_from_mapping(bad, strict=True)
    with pytest.raises(TypeError):
        options_from_mapping([], strict=True)
    assert options_from_mapping(None)[0] == JobOptions()


def test_modules_off_means_tree_only():
    options, _ = options_from_mapping({"process_modules": False})
    assert options.processing_depth == "tree_only" and not options.process_modules
    with pytest.raises(ValueError):
        JobOptions(processing_depth="deep")


def test_paths(monkeypatch):
    monkeypatch.setenv("WHERE", "/data")
    assert normalize_path("$WHERE/x", "/f") == "/data/x"
    assert normalize_path("  ", "/f") == "/f"
    assert normalize_path("~", "/f") == os.path.expanduser("~")
    assert normalize_path("s3a://b/$WHERE", "/f") == "s3a://b/$WHERE"
    assert JobOptions(output_base_dir="/o", output_subdir_name=" ").output_path() == "/o/transcript"


def test_planned_outputs():
    both = JobOptions(save_error_log=True)
    assert both.planned_outputs() == [f"transcription_{k}" for k in ("modules", "tests", "resources", "tree", "full_context", "errors")]
    assert JobOptions(create_individual_files=False).planned_outputs() == ["transcription_full_context"]
