"""Path and language expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and file names with their language.
LANGUAGES = {
    "python": "py pyi pyw", "go": "go", "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "java": "java", "rust": "rs", "c": "c h", "cpp": "cpp cc cxx hpp hxx hh",
    "csharp": "cs", "ruby": "rb rake gemspec", "php": "php phtml", "kotlin": "kt kts", "swift": "swift", "scala": "scala sc", "shell": "sh bash zsh", "sql": "sql", "html": "html htm",
    "css": "css scss sass less", "markdown": "md markdown", "json": "json", "yaml": "yaml yml", "toml": "toml", "xml": "xml xsd xsl", "lua": "lua", "perl": "pl pm", "r": "r", "dart": "dart",
    "elixir": "ex exs", "erlang": "erl hrl", "haskell": "hs lhs", "ocaml": "ml mli", "clojure": "clj cljs cljc", "protobuf": "proto", "vue": "vue", "svelte": "svelte", "zig": "zig", "julia": "jl",
}
FILE_NAMES = {"makefile": "make", "dockerfile": "docker", "docker-compose.yml": "yaml", "cmakelists.txt": "cmake", "gemfile": "ruby", "rakefile": "ruby", ".env.local": "env", ".env": "env"}
# End of the fixed values.


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last extension in lower case, or ''."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def repo(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def detect_language(path: Column) -> Column:
    """By whole file name, then by extension; '' if neither is known."""
    pairs = {e: k for k, v in LANGUAGES.items() for e in v.split()}
    names = F.create_map(*[F.lit(x) for kv in FILE_NAMES.items() for x in kv])
    extensions = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(file_name(path))), F.try_element_at(extensions, extension(path)), F.lit(""))


def is_test(path: Column) -> Column:
    """Names that start with test_ or end in _test, .test or .spec before the extension, or conftest files."""
    return F.lower(file_name(path)).rlike(r"^test_|_test\.[^.]+$|\.(?:test|spec)\.[^.]+$|^conftest\.py")


def is_compiled(path: Column) -> Column:
    return extension(path).isin("pyc", "pyo", "class", "o")


def in_directory(path: Column, *names: str) -> Column:
    """Whether a directory of the path has one of the names."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), F.array(*[F.lit(n) for n in names]))


def module_name(path: Column) -> Column:
    """The path as a dotted module name."""
    return F.translate(F.regexp_replace(path, r"\.[^./]+$", ""), "/", ".")
