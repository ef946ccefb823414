"""Path and language functions of the code index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language, folders that are never read, extensions that a module name drops.
EXTENSIONS = {
    "python": ".py .pyi", "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx", "go": ".go", "rust": ".rs", "java": ".java", "kotlin": ".kt", "c": ".c .h",
    "cpp": ".cpp .cc .cxx .hpp", "csharp": ".cs", "ruby": ".rb", "php": ".php", "swift": ".swift", "scala": ".scala", "bash": ".sh .bash", "lua": ".lua", "sql": ".sql", "html": ".html", "css": ".css",
}
SKIP_DIRS = ".git .hg .svn .venv venv env __pycache__ .mypy_cache .ruff_cache .pytest_cache node_modules dist build .tox .eggs target Pods DerivedData".split()
MODULE_EXTENSIONS = ".py .js .ts .go .rs .java .c .cpp .rb .cs".split()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def language(path) -> Column:
    """By lower-cased extension; null if it is not known."""
    ext = F.lower(F.regexp_extract(F.regexp_extract(_col(path), r"([^/]*)$", 1), r"(\.[^.]*)$", 1))
    table = F.create_map(*[F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts.split() for x in (e, lang)])
    return table[ext]


def ignored(path, globs=()) -> Column:
    """A skipped folder on the way, or a base name that holds a stripped pattern."""
    out = F.arrays_overlap(F.split(_col(path), "/"), F.array(*[F.lit(d) for d in SKIP_DIRS]))
    base = F.regexp_extract(_col(path), r"([^/]*)$", 1)
    for g in globs:
        out = out | base.contains(g.rstrip("*").rstrip("/"))
    return out


def module_name(path) -> Column:
    dotted = F.regexp_replace(_col(path), r"[/\\]", ".")
    tail = "|".join(e[1:] for e in MODULE_EXTENSIONS)
    base = F.regexp_replace(F.regexp_replace(dotted, rf"\.(?:{tail})$", ""), r"\.index$", "")
    return F.when(base == "", F.lit("module")).otherwise(base)


def qualify(module, parent, name) -> Column:
    return F.when(_col(parent) != "", F.concat_ws(".", _col(parent), _col(name))).otherwise(F.concat_ws(".", _col(module), _col(name)))


def is_identifier(c) -> Column:
    return _col(c).rlike(r"^[\p{L}_][\p{L}\p{Nd}_]*$")


def first_lines(text, n: int) -> Column:
    return F.array_join(F.slice(F.split(_col(text), "\n"), 1, n), "\n")


def symbol_content(kind, qualified_name, signature, docstring, body) -> Column:
    def part(label, c):
        return F.when(_col(c) != "", F.concat(F.lit(label), _col(c)))

    return F.concat_ws("\n", F.concat(_col(kind), F.lit(" "), _col(qualified_name)), part("signature: ", signature), part("doc: ", docstring), part("body:\n", body))
