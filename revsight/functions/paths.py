"""Path expressions: suffixes, names, languages, and what kind of file a path is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix to language as file analysis names it.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".cs": "csharp",
    ".php": "php", ".rb": "ruby", ".go": "go", ".rs": "rust",
}
# Suffix to language as repository statistics name it.
TITLES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "JavaScript", ".tsx": "TypeScript", ".java": "Java", ".cpp": "C++", ".c": "C", ".cs": "C#", ".php": "PHP",
    ".rb": "Ruby", ".go": "Go", ".rs": "Rust", ".kt": "Kotlin", ".swift": "Swift", ".dart": "Dart", ".scala": "Scala", ".clj": "Clojure", ".hs": "Haskell", ".ml": "OCaml", ".elm": "Elm",
    ".ex": "Elixir", ".erl": "Erlang", ".lua": "Lua", ".pl": "Perl", ".r": "R", ".jl": "Julia", ".nim": "Nim",
}
# Suffixes whose lines count, suffixes that are analysed, and names of special files.
COUNTED = (*TITLES, ".sh", ".bash", ".zsh", ".fish", ".ps1", ".bat", ".sql", ".html", ".css", ".scss", ".sass", ".less", ".xml", ".json", ".yaml", ".yml", ".toml", ".ini", ".conf")
ANALYSED = (*LANGUAGES, ".kt", ".swift", ".dart")
SCANNED = tuple(LANGUAGES)
EXCLUDED_DIRS = (".git", "node_modules", "__pycache__", ".pytest_cache", "venv", ".venv")
CONFIG_SUFFIXES = (".ini", ".conf", ".config", ".cfg", ".toml", ".yaml", ".yml", ".json")
CONFIG_NAMES = ("config", "settings", ".env", "environment")
DEPENDENCY_NAMES = (
    "requirements.txt", "requirements-dev.txt", "setup.py", "pyproject.toml", "Pipfile", "package.json", "package-lock.json", "yarn.lock", "Gemfile", "Gemfile.lock", "composer.json", "composer.lock",
)
MAX_BYTES = 1_048_576


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """The last dot of the name and what follows, lower-cased; '' for none, for a leading dot alone and for a final dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def after_dot(path: Column | str, default: str) -> Column:
    """What follows the last dot of the whole path, case kept; ``default`` without a dot."""
    p = _col(path)
    return F.when(p.contains("."), F.substring_index(p, ".", -1)).otherwise(F.lit(default))


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language(path: Column | str) -> Column:
    return F.coalesce(_mapped(suffix(path), LANGUAGES), F.lit("unknown"))


def language_title(path: Column | str) -> Column:
    """Null for a suffix without a language."""
    return _mapped(suffix(path), TITLES)


def is_counted(path: Column | str) -> Column:
    return suffix(path).isin(*COUNTED)


def is_code_file(path: Column | str, content: Column | str) -> Column:
    c = _col(content)
    return (F.length(F.regexp_replace(c, r"^\s+$", "")) > 0) & (F.length(c) <= MAX_BYTES) & suffix(path).isin(*ANALYSED)


def is_config_file(path: Column | str) -> Column:
    name = basename(path)
    return suffix(path).isin(*CONFIG_SUFFIXES) | F.lower(name).isin(*CONFIG_NAMES) | name.startswith(".env")


def is_test_file(path: Column | str) -> Column:
    return F.lower(basename(path)).contains("test") | F.array_contains(F.split(_col(path), "/"), "test")


def is_dependency_file(path: Column | str) -> Column:
    return basename(path).isin(*DEPENDENCY_NAMES)


def is_scanned(path: Column | str) -> Column:
    """A repository scan takes the path: a known suffix, and no component is an excluded folder."""
    parts = F.split(_col(path), "/")
    return suffix(path).isin(*SCANNED) & ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))


def prefixes(path: Column | str) -> Column:
    """Every folder above a path, outermost first."""
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def repository_name(url: Column | str) -> Column:
    """The last segment of a URL without .git, other characters than letters, digits, _ and - replaced."""
    plain = F.regexp_replace(_col(url), r"\.git$", "")
    return F.regexp_replace(F.substring_index(F.rtrim(plain), "/", -1), "[^a-zA-Z0-9_-]", "_")
