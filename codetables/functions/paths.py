"""Paths as columns: parts, exclusion of directories and files, containment, lookup patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that hold no source.
IGNORED_DIRS = [
    ".git", ".hg", ".svn", "node_modules", "bower_components", "vendor", "dist", "build", "out", "target", "__pycache__",
    ".venv", "venv", ".idea", ".vscode", ".next", ".nuxt", ".svelte-kit", "coverage", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".tox", ".nox", ".eggs", ".cargo", ".gradle", "Pods", "DerivedData", "__MACOSX",
]
# File names that are never source.
IGNORED_FILES = [".env", ".gitignore", ".dockerignore", ".ds_store", "thumbs.db", "desktop.ini"]
# Lock files of package managers.
LOCKFILES = [
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "pnpm-lock.yml", "poetry.lock", "pipfile.lock",
    "uv.lock", "cargo.lock", "gemfile.lock", "composer.lock", "go.sum", "gradle.lockfile", "terraform.lock.hcl",
]
# Suffixes of binary and media files.
BINARY_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".avif", ".tif", ".tiff", ".heic",
    ".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v",
    ".mp3", ".wav", ".flac", ".ogg", ".m4a", ".aac", ".mid", ".midi",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".zip", ".gz", ".tar", ".tgz", ".bz2", ".xz", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".class",
    ".jar", ".war", ".deb", ".rpm", ".whl", ".wasm", ".pyc", ".pyo", ".pyd", ".bin", ".dat", ".db", ".sqlite", ".sqlite3",
    ".parquet", ".arrow", ".npy", ".npz", ".pickle", ".pkl", ".h5", ".hdf5", ".onnx", ".pb", ".pt", ".pth", ".ckpt", ".safetensors",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
]


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Directory part without a final slash; empty for a file in the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Last suffix with its dot; empty for names that only begin with a dot."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def in_ignored_dir(path: Column) -> Column:
    """True if any directory above the file is in the list (case matters)."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, IGNORED_DIRS)))


def is_ignored_name(path: Column) -> Column:
    return F.lower(name(path)).isin(IGNORED_FILES)


def is_lockfile(path: Column) -> Column:
    return F.lower(name(path)).isin(LOCKFILES)


def is_minified(path: Column) -> Column:
    return F.lower(name(path)).rlike(r"\.min\.(js|css)$")


def is_binary(path: Column) -> Column:
    return F.lower(suffix(path)).isin(BINARY_SUFFIXES)


def is_excluded(path: Column) -> Column:
    return in_ignored_dir(path) | is_ignored_name(path) | is_lockfile(path) | is_minified(path) | is_binary(path)


def normalised(path: Column) -> Column:
    """Path with ``.`` and ``..`` resolved as text; null if it climbs above the root."""
    step = lambda stack, part: (
        F.when(stack.isNull(), stack)
        .when((part == "") | (part == "."), stack)
        .when(part == "..", F.when(F.size(stack) > 0, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))))
        .otherwise(F.concat(stack, F.array(part)))
    )
    stack = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.array_join(stack, "/")


def is_contained(path: Column) -> Column:
    """False for an empty or absolute path, the root itself, and anything that climbs out of it."""
    return F.coalesce((path != "") & ~path.startswith("/") & (normalised(path) != ""), F.lit(False))


def listing_prefix(path: Column) -> Column:
    """Directory argument of a listing: leading dots and slashes and the final slash removed."""
    return F.rtrim(F.regexp_replace(path, r"^[./]+", ""), F.lit("/"))


def ancestors(path: Column) -> Column:
    """All directories above the file, the root ('') first."""
    parts = F.split(directory(path), "/")
    real = F.when(directory(path) == "", F.array().cast("array<string>")).otherwise(parts)
    return F.transform(F.sequence(F.lit(0), F.size(real)), lambda n: F.array_join(F.slice(real, 1, n), "/"))
