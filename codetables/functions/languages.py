"""Language and grammar of a path, by exact name, then by last suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codetables.functions import paths

# File name (lower case) to language.
BY_NAME = {
    "dockerfile": "Dockerfile", "dockerfile.dev": "Dockerfile", "makefile": "Makefile", "gnumakefile": "Makefile", "bsdmakefile": "Makefile",
    "cmakelists.txt": "CMake", "justfile": "Justfile", "procfile": "Procfile", ".env.example": "Text", ".editorconfig": "INI",
}
# Language to the suffixes that mean it.
SUFFIXES = {
    "Python": ".py .pyi .pyw", "JavaScript": ".js .mjs .cjs .jsx", "TypeScript": ".ts .mts .cts .tsx", "Java": ".java", "Kotlin": ".kt .kts",
    "Scala": ".scala", "Groovy": ".groovy", "Gradle": ".gradle", "C": ".c .h", "C++": ".cpp .cc .cxx .hpp .hh .hxx", "C#": ".cs",
    "Objective-C": ".m", "Objective-C++": ".mm", "Swift": ".swift", "Rust": ".rs", "Go": ".go", "Zig": ".zig", "HTML": ".html .htm",
    "CSS": ".css", "SCSS": ".scss", "Sass": ".sass", "Less": ".less", "Vue": ".vue", "Svelte": ".svelte", "Shell": ".sh .bash .zsh .fish",
    "PowerShell": ".ps1 .psm1", "Ruby": ".rb", "PHP": ".php", "Lua": ".lua", "Perl": ".pl .pm", "R": ".r", "Dart": ".dart", "Elm": ".elm",
    "Elixir": ".ex .exs", "Erlang": ".erl .hrl", "Haskell": ".hs", "Clojure": ".clj", "ClojureScript": ".cljs", "SQL": ".sql",
    "JSON": ".json .json5", "YAML": ".yaml .yml", "TOML": ".toml", "INI": ".ini .cfg .conf", "XML": ".xml .xsd", "SVG": ".svg",
    "Protocol Buffers": ".proto", "GraphQL": ".graphql", "Markdown": ".md .markdown", "reStructuredText": ".rst", "Text": ".txt",
    "Jupyter Notebook": ".ipynb",
}
# Grammar to the suffixes it covers.
GRAMMARS = {
    "python": ".py", "javascript": ".js .mjs .cjs .jsx", "typescript": ".ts .mts .cts", "tsx": ".tsx", "go": ".go", "rust": ".rs",
    "java": ".java", "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp .hh .hxx", "ruby": ".rb", "php": ".php", "kotlin": ".kt .kts",
    "scala": ".scala", "bash": ".sh .bash .zsh", "css": ".css", "html": ".html .htm", "json": ".json", "yaml": ".yaml .yml",
    "toml": ".toml", "sql": ".sql", "lua": ".lua", "r": ".r", "elixir": ".ex .exs", "erlang": ".erl", "haskell": ".hs",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for item in table.items() for x in item))[key]


def _by_suffix(path: Column, table: dict[str, str]) -> Column:
    return _lookup(F.lower(paths.suffix(path)), {s: k for k, listed in table.items() for s in listed.split()})


def language(path: Column) -> Column:
    """Display name of the language; ``Other`` if neither the name nor the suffix is known."""
    return F.coalesce(_lookup(F.lower(paths.name(path)), BY_NAME), _by_suffix(path, SUFFIXES), F.lit("Other"))


def grammar(path: Column) -> Column:
    """Grammar family; null where no structure is extracted."""
    return _by_suffix(path, GRAMMARS)
