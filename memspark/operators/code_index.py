"""Incremental code index: changed files, symbols or line chunks, call edges inside a file."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code, text
from ..functions.hashing import content_hash
from ..schema import L2, Config, MemoryState
from ..sources.shared import small_batches
from . import dml, grammars, graph, layers

CHUNK_LINES = 40
SYMBOLS = "array<struct<symbol_kind: string, name: string, parent: string, signature: string, docstring: string, line_start: int, line_end: int, body: string, calls: array<string>>>"


def _calls(node: ast.AST) -> list[str]:
    out = []
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            name = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else ""
            if name.isidentifier():
                out.append(name)
    return out


def python_symbols(source: str, max_lines: int = 40) -> list[dict]:
    """Top-level functions and classes, and what classes define. Decorated definitions give no symbol."""
    lines, out = source.split("\n"), []

    def visit(nodes, parent):
        for n in nodes:
            if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) or n.decorator_list:
                continue
            is_class = isinstance(n, ast.ClassDef)
            body = "\n".join(lines[n.lineno - 1 : n.end_lineno])[n.col_offset :]
            first = body.split("\n", 1)[0].rstrip(" ")
            head = first.split("{", 1)[0].rstrip(" ") if "{" in first else first
            signature = f"class {n.name}" if is_class else head.rstrip().removesuffix(":").strip()
            kept = "\n".join(body.split("\n")[: max_lines if max_lines > 0 else 40])
            out.append({"symbol_kind": "class" if is_class else "function", "name": n.name, "parent": parent, "signature": signature, "docstring": (ast.get_docstring(n, clean=False) or "").strip("\"'"), "line_start": n.lineno, "line_end": n.end_lineno, "body": kept, "calls": _calls(n)})
            if is_class:
                visit(n.body, f"{parent}.{n.name}" if parent else n.name)

    visit(ast.parse(source).body, "")
    return out


def chunks(df: DataFrame, content: str = "content", size: int = CHUNK_LINES) -> DataFrame:
    """Windows of lines: chunk_no, line_start, line_end, body; an empty file has one empty chunk."""
    lines = F.split(F.regexp_replace(F.col(content), "\r\n", "\n"), "\n")
    df = df.withColumn("_lines", lines)
    starts = F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / size).cast("int"))
    out = df.select("*", F.explode(starts).alias("chunk_no"))
    out = out.withColumn("line_start", (F.col("chunk_no") * size + 1).cast("int")).withColumn("line_end", F.least(F.size("_lines"), (F.col("chunk_no") + 1) * size).cast("int"))
    return out.withColumn("body", F.array_join(F.slice("_lines", F.col("line_start"), F.lit(size)), "\n")).drop("_lines")


def manifest_diff(files: DataFrame, index_state: DataFrame) -> DataFrame:
    """files (workspace, path, body_hash) -> with status new, changed or unchanged."""
    old = index_state.select(F.col("workspace").alias("_w"), F.col("file_path").alias("_p"), F.col("body_hash").alias("_old"))
    j = files.join(old, F.col("workspace").eqNullSafe(F.col("_w")) & F.col("path").eqNullSafe(F.col("_p")), "left").drop("_w", "_p")
    return j.withColumn("status", F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("body_hash"), "unchanged").otherwise("changed")).drop("_old")


def extract(files: DataFrame, max_lines: int = 40) -> DataFrame:
    """files (workspace, path, language, content) -> a row per symbol, with seq, qualified_name and calls.
    Python is parsed, languages with braces are scanned (``grammars``); other languages, unparsable files
    and files without symbols become chunks."""

    @F.pandas_udf(f"symbols {SYMBOLS}, error string")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, languages in batches:
            out = []
            for source, lang in zip(contents, languages):
                try:
                    found = python_symbols(source, max_lines) if lang == "python" else grammars.symbols(source, lang, max_lines) if lang in grammars.TOP else []
                    out.append((found, None))
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append(([], f"parse failed ({e}); using chunk fallback"))
            yield pd.DataFrame(out, columns=["symbols", "error"])

    small_batches(files.sparkSession)
    parsed = files.withColumn("_p", parse("content", "language")).withColumn("module", code.module_name("path"))
    some = parsed.where(F.size("_p.symbols") > 0).select("workspace", "path", "language", "module", F.posexplode("_p.symbols").alias("seq", "s")).select("workspace", "path", "language", "module", "seq", "s.*", F.lit(None).cast("string").alias("error"))
    parent = F.when(F.col("parent") == "", F.lit("")).otherwise(F.concat_ws(".", "module", "parent"))
    some = some.withColumn("qualified_name", code.qualify("module", parent, "name")).drop("parent")
    cut = chunks(parsed.where(F.size("_p.symbols") == 0).select("workspace", "path", "language", "module", "content", F.col("_p.error").alias("error")))
    name = F.concat(F.lit("lines_"), F.col("line_start").cast("string"))
    cut = cut.select(
        "workspace", "path", "language", "module", F.col("chunk_no").cast("int").alias("seq"), F.lit("chunk").alias("symbol_kind"), name.alias("name"), F.lit("").alias("signature"), F.lit("").alias("docstring"),
        "line_start", "line_end", "body", F.array().cast("array<string>").alias("calls"), "error", F.concat_ws(".", "module", name).alias("qualified_name"),
    )
    return some.unionByName(cut)


def call_refs(symbols: DataFrame) -> DataFrame:
    """Calls to names defined in the same file: the last definition of a name counts, own names do not."""
    names = symbols.groupBy("workspace", "path", F.col("name").alias("callee")).agg(F.max_by("qualified_name", "seq").alias("dst_symbol"))
    calls = symbols.select("workspace", "path", F.col("qualified_name").alias("src_symbol"), "name", F.explode("calls").alias("callee")).where("callee <> name")
    return calls.join(names, ["workspace", "path", "callee"]).select("src_symbol", "dst_symbol", F.lit("calls").alias("ref_kind"), "workspace", F.col("path").alias("file_path")).distinct()


def file_summaries(symbols: DataFrame, top: int = 8) -> DataFrame:
    """Path, language, counts of symbol kinds and the first names of each file, in one line. symbols need
    workspace, path, language, symbol_kind, name and seq (from 0)."""
    keys = ["workspace", "path", "language"]
    kinds = symbols.groupBy(*keys, "symbol_kind").agg(F.count(F.lit(1)).alias("n"))
    parts = kinds.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("symbol_kind", "n"))), lambda k: F.concat_ws(" ", k["n"].cast("string"), k["symbol_kind"])), ", ").alias("k"), F.sum("n").cast("long").alias("n_symbols"))
    first = symbols.where(F.col("seq") < top).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]), ", ").alias("names"))
    line = F.concat("path", F.lit(" ("), "language", F.lit("): "), "k", F.lit(". Top symbols: "), F.coalesce("names", F.lit("")), F.lit("."))
    return parts.join(first, keys, "left").select(*keys, line.alias("file_summary"), "n_symbols")


def index_code(state: MemoryState, files: DataFrame, now: float, embedding, config: Config = Config(), force: bool = False, languages: list[str] | None = None, prune: bool = False) -> tuple[MemoryState, DataFrame]:
    """files (workspace, path, content) -> (new state, one-row report). Unchanged files are skipped by hash,
    by workspace; a file's refs replace its earlier ones. ``prune`` also drops symbols and files that are gone."""
    seen = files.where(~code.ignored("path", config.ignore_globs)).withColumn("language", code.language("path")).withColumn("body_hash", content_hash("content"))
    seen = graph.written(manifest_diff(seen, state.index_state), "files")
    wanted = seen.where(F.col("language").isNotNull())
    if languages is not None:
        wanted = wanted.where(F.col("language").isin(*languages) if languages else F.lit(False))
    todo = wanted if force else wanted.where("status <> 'unchanged'")
    symbols = graph.written(extract(todo, config.max_body_lines), "symbols")
    refs = call_refs(symbols)
    made = layers.code_files(file_summaries(symbols).withColumn("id", layers.derived_id("file", F.col("workspace"), F.col("path"))), now, embedding)
    content = code.symbol_content("symbol_kind", "qualified_name", "signature", "docstring", "body")
    rows = symbols.withColumn("id", layers.derived_id("symbol", F.col("workspace"), F.col("path"), F.col("qualified_name"))).dropDuplicates(["id"])
    rows = graph.written(rows, "rows")
    mem = layers.memory_rows(
        rows.withColumn("_content", content), now, embedding, layer=L2, type="code_symbol", content=F.col("_content"), summary=text.truncate("qualified_name", 120), source=F.col("path"),
        metadata=F.to_json(F.struct(F.col("path").alias("file_path"), "qualified_name", F.col("symbol_kind").alias("kind"), "language")), content_hash=content_hash("_content"),
    )
    table = rows.select(F.col("id").alias("memory_id"), F.col("path").alias("file_path"), "symbol_kind", "qualified_name", "signature", "docstring", "line_start", "line_end", "language")
    if prune:
        paths = todo.select("workspace", F.col("path").alias("source"))
        lost = state.memories.where(F.col("type").isin("code_symbol", "code_file")).join(paths, ["workspace", "source"], "left_semi").select("id")
        gone_files = state.index_state.join(seen.select("workspace", F.col("path").alias("file_path")), ["workspace", "file_path"], "left_anti").select("workspace", F.col("file_path").alias("source"))
        lost = lost.unionByName(state.memories.where(F.col("type").isin("code_symbol", "code_file")).join(gone_files, ["workspace", "source"], "left_semi").select("id"))
        state = dml.delete(state, graph.written(lost, "lost"))
    state = dml.put_symbols(dml.put_memories(dml.put_memories(state, made), mem), table)
    old_refs = state.refs.join(todo.select("workspace", F.col("path").alias("file_path")), ["workspace", "file_path"], "left_anti").select(*state.refs.columns)
    state = state.with_(refs=old_refs.unionByName(refs.select(*state.refs.columns)))
    marks = todo.select("workspace", F.col("path").alias("file_path"), "body_hash", F.lit(now).alias("indexed_at"))
    kept = state.index_state.join(marks.select("workspace", "file_path"), ["workspace", "file_path"], "left_anti").select(*state.index_state.columns)
    state = state.with_(index_state=kept.unionByName(marks))
    skipped = F.col("language").isNull()
    report = seen.agg(F.count(F.lit(1)).alias("files_seen"), F.count_if(skipped).alias("files_skipped_unsupported"))
    report = report.crossJoin(wanted.agg(F.count_if(F.lit(not force) & (F.col("status") == "unchanged")).alias("files_skipped_unchanged")))  # one row each
    report = report.crossJoin(todo.agg(F.count(F.lit(1)).alias("files_indexed"))).crossJoin(rows.agg(F.count(F.lit(1)).alias("symbols_written"), F.sort_array(F.collect_set(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "path", "error")))).alias("errors"))).crossJoin(refs.agg(F.count(F.lit(1)).alias("refs_written")))
    return state, report
