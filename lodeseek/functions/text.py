"""Scalar functions over paths and texts, as Columns."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language of each file extension and of some file names.
EXTENSION_LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyi": "python", ".go": "go", ".dart": "dart", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".java": "java",
    ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cs": "csharp",
    ".scala": "scala", ".lua": "lua", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".sql": "sql", ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "scss", ".less": "less", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml",
    ".md": "markdown", ".mdx": "markdown", ".vue": "vue", ".svelte": "svelte", ".astro": "astro", ".graphql": "graphql", ".gql": "graphql",
    ".proto": "protobuf", ".r": "r", ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hs": "haskell", ".ml": "ocaml",
    ".mli": "ocaml", ".clj": "clojure", ".tf": "terraform", ".dockerfile": "dockerfile",
}
FILENAME_LANGUAGES = {"Dockerfile": "dockerfile", "Makefile": "makefile", "GNUmakefile": "makefile", "Rakefile": "ruby", "Gemfile": "ruby", "Vagrantfile": "ruby", "Justfile": "makefile", "CMakeLists.txt": "cmake"}
# Extensions of files that are never text here.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".avif", ".mp3", ".mp4", ".avi", ".mov", ".mkv", ".flv", ".wmv",
    ".wav", ".ogg", ".flac", ".zip", ".gz", ".tar", ".bz2", ".7z", ".rar", ".xz", ".zst", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".ppt", ".pptx", ".exe", ".dll", ".so", ".dylib", ".a", ".o", ".obj", ".lib", ".wasm", ".class", ".pyc", ".pyo", ".ttf", ".otf",
    ".woff", ".woff2", ".eot", ".sqlite", ".db", ".sqlite3", ".bin", ".dat", ".iso", ".img", ".node", ".map",
]


def _folds() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, then all marks; and the letters alone. For ``translate``, which deletes what has no counterpart."""
    letters, plain, marks = [], [], []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.combining(c):
            marks.append(c)
        else:
            base = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
            if len(base) == 1 and base[0] != c:
                letters.append(c)
                plain.append(base[0])
    return "".join(letters + marks), "".join(plain)


#: Accents and how they go, in an index and in queries alike.
ACCENTED, PLAIN = _folds()
FOLDS = {ord(c): PLAIN[i] if i < len(PLAIN) else None for i, c in enumerate(ACCENTED)}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last dot of the file name and what follows, lower-cased; empty for none, and for a name that only starts with it."""
    name = basename(path)
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1))



def language(path: Column) -> Column:
    """By extension, then by file name, then for Dockerfile variants; else null."""
    name = basename(path)
    return F.coalesce(F.try_element_at(_map(EXTENSION_LANGUAGES), extension(path)), F.try_element_at(_map(FILENAME_LANGUAGES), name), F.when(name.startswith("Dockerfile."), "dockerfile"))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def is_binary_name(path: Column) -> Column:
    return extension(path).isin(BINARY_EXTENSIONS)


def is_source_name(path: Column) -> Column:
    """A known extension or file name, a Dockerfile variant, or no extension at all."""
    ext, name = extension(path), basename(path)
    return ext.isin(list(EXTENSION_LANGUAGES)) | name.isin(list(FILENAME_LANGUAGES)) | name.startswith("Dockerfile.") | (ext == "")


def has_nul(content: Column) -> Column:
    """Whether the first 8192 bytes hold a zero byte."""
    return F.locate("\x00", F.decode(F.substring(content, 1, 8192), "ISO-8859-1")) > 0


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def repository_id(path: Column) -> Column:
    return basename(F.regexp_replace(path, "/+$", ""))


def embedding_text(path: Column, lang: Column, kind: Column, name: Column, code: Column) -> Column:
    """``file: … | language: … | type: … | name: … | code: …`` without empty parts."""
    parts = [("file", path), ("language", lang), ("type", kind), ("name", name), ("code", code)]
    return F.concat_ws(" | ", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}: "), c)) for k, c in parts])


def capped(text: Column, characters: int = 1_000_000) -> Column:
    return F.substring(text, 1, characters)


def rerank_document(kind: Column, name: Column, path: Column, content: Column) -> Column:
    head = F.concat(F.lit("["), F.coalesce(kind, F.lit("chunk")), F.lit("] "))
    named = F.concat(name, F.lit(" ("), path, F.lit(")"))
    return F.concat(head, F.when(F.coalesce(name, F.lit("")) != "", named).otherwise(path), F.lit("\n"), content)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 3)), F.lit("...")))


def preview(text: Column, lines: int = 8) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits without accents, in order; marks after letters are accents, too."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    folded = F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(F.translate(lower, ACCENTED, PLAIN))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def let(value: Column, of) -> Column:
    """``of(value)`` with ``value`` computed once a row, also where the optimizer would put it into each of its uses."""
    return F.get(F.transform(F.array(value), of), F.lit(0))
