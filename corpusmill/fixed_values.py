"""Values that decide results and therefore may not drift: patterns, word
lists, lookup tables, headings and limits.  Everything here is data."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: file classification
# ---------------------------------------------------------------------------

TEST_NAME_STEMS = (
    r"test_.*", r".*_test", r"Test.*", r".*Test", r".*Tests", r".*TestCase",
    r".*\.spec", r".*\.test", r".*\.e2e", r".*\.cy",
)
TEST_NAME_EXTENSIONS = (
    "py", "js", "ts", "jsx", "tsx", "java", "kt", "go", "rs", "cs", "cpp", "c",
    "h", "hpp", "swift", "php",
)

RESOURCE_EXTENSIONS = (
    ".md", ".markdown", ".rst", ".txt",
    ".json", ".yaml", ".yml", ".toml", ".xml", ".csv", ".ini", ".cfg", ".conf",
    ".properties", ".dockerignore", ".editorconfig", ".css", ".env",
)
RESOURCE_FILENAMES = (
    "Dockerfile", "Makefile", "LICENSE", "CHANGELOG", "README", "Gemfile",
    "Procfile", ".dockerignore", ".editorconfig", ".env", ".gitignore",
)

DEFAULT_EXTENSIONS = (".py",)
DEFAULT_INCLUDE_PATTERNS = (".*",)
DEFAULT_EXCLUDE_PATTERNS = (
    r"^__init__\.py$",
    r".*\.pyc$",
    r"^(__pycache__|\.git|\.idea|\.vscode|node_modules)$",
    r"^\.",
)

STACK_PRESETS = {
    "Python Data": (".py", ".ipynb", ".json", ".csv", ".yaml"),
    "Web Fullstack": (".js", ".ts", ".jsx", ".tsx", ".html", ".css", ".json"),
    "Java/Kotlin": (".java", ".kt", ".kts", ".xml", ".gradle", ".properties"),
    "C# / .NET": (".cs", ".csproj", ".sln", ".config"),
    "C / C++": (".c", ".cpp", ".h", ".hpp", "CMakeLists.txt", "Makefile"),
    "Mobile (Swift/Dart)": (".swift", ".dart", ".yaml", ".xml", ".plist"),
    "Rust": (".rs", ".toml"),
    "Go": (".go", ".mod", ".sum"),
    "PHP Legacy": (".php", ".phtml", "composer.json", ".ini"),
    "Shell / Ops": (
        ".sh", ".bash", ".zsh", ".ps1", ".bat", "Dockerfile", ".dockerignore",
        ".yaml", ".yml",
    ),
    "Documentation": (".md", ".rst", ".txt", ".pdf"),
}

# ---------------------------------------------------------------------------
# FIXED VALUES: redaction, masking, minifying
# ---------------------------------------------------------------------------

MARK_SENSITIVE = "[[REDACTED_SENSITIVE]]"
MARK_SECRET = "[[REDACTED_SECRET]]"
MARK_HOME = "<USER_HOME>"
MARK_USER = "<USER>"

CREDENTIAL_WORDS = ("key", "password", "secret", "token", "auth", "api", "pwd")
MIN_CREDENTIAL_CHARS = 8

HASH_COMMENT_EXTENSIONS = (".py", ".yaml", ".yml", ".sh", ".bash")
SLASH_COMMENT_EXTENSIONS = (
    ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".cs",
    ".go",
)

# ---------------------------------------------------------------------------
# FIXED VALUES: tokens and the model catalogue
# ---------------------------------------------------------------------------

CHARS_PER_TOKEN = 4
DEFAULT_CONTEXT_WINDOW = 4096
DEFAULT_MODEL = "- Default Model -"
MODERN_ENCODING = "o200k_base"
LEGACY_ENCODING = "cl100k_base"
LEGACY_MODEL_MARKS = ("gpt-4-", "gpt-3.5", "legacy")

CATALOGUE_TEMPLATE_ID = "sample_spec"
TEXT_MODES = ("chat", "completion")
UNKNOWN_PROVIDER = "unknown"
NO_MODELS = "-- No Models --"
INFRASTRUCTURE_MARKS = ("AZURE", "BEDROCK", "VERTEX", "SAGEMAKER")
PROVIDER_NAMES = {
    "AZURE": "AZURE",
    "AZURE_AI": "AZURE",
    "AZURE_TEXT": "AZURE",
    "BEDROCK": "AWS (BEDROCK)",
    "BEDROCK_CONVERSE": "AWS (BEDROCK)",
    "SAGEMAKER": "AWS (SAGEMAKER)",
    "VERTEX_AI": "GOOGLE (VERTEX)",
    "GEMINI": "GOOGLE",
    "PALM": "GOOGLE",
    "OPENROUTER": "OPENROUTER",
    "TOGETHER_AI": "TOGETHER AI",
    "ANYSCALE": "ANYSCALE",
    "FIREWORKS_AI": "FIREWORKS AI",
    "DEEPINFRA": "DEEPINFRA",
    "FRIENDLIAI": "FRIENDLI AI",
    "CLOUDFLARE": "CLOUDFLARE",
    "DATABRICKS": "DATABRICKS",
    "GITHUB_COPILOT": "GITHUB",
    "TEXT-COMPLETION-OPENAI": "OPENAI",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: layout of the written documents
# ---------------------------------------------------------------------------

ENTRY_RULE = "-" * 200
TITLE_RULE = "=" * 80
TREE_RULE = "-" * 50
ERROR_RULE = "-" * 80
CONTEXT_TITLE = "PROJECT CONTEXT: "
TREE_TITLE = "PROJECT STRUCTURE:"
ERRORS_TITLE = "TRANSCRIPTION ERRORS REPORT:"
SECTION_TITLES = {
    "module": "SCRIPTS/MODULES:",
    "test": "TESTS:",
    "resource": "RESOURCES (CONFIG/DATA/DOCS):",
}
REJECTED_MESSAGE = "Filtered by mode or depth"
BRANCH_MIDDLE, BRANCH_LAST = "├── ", "└── "
INDENT_OPEN, INDENT_CLOSED = "│   ", "    "
OUTPUT_SUBDIR = "transcript"
OUTPUT_PREFIX = "transcription"
