"""Source trees: files, their symbols and references."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.functions.text import content_hash, glob_regex
from tidemark.operators.codegraph import changed_files, replace_files, resolve_edges
from tidemark.session import materialize

# Languages by file extension.
LANGUAGES = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "sh": "bash", "scala": "scala",
}
#: Patterns of other languages than Python, which its own parser reads: type, function, call.
_TYPE = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+|export\s+|public\s+|private\s+|abstract\s+|final\s+|open\s+|data\s+|sealed\s+)*(?:class|struct|trait|interface|enum|protocol|object|module)\s+(\w+)(?:\s*(?:\(|extends|implements|:|<)\s*:?\s*(\w+))?")
_FUNC = re.compile(r"^\s*(?:[\w<>\[\],&*:]+\s+)*?(?:fn|func|function|def|fun|sub)\s+(?:\([^)]*\)\s*)?(\w+)\s*[(<]|^\s*(?:public|private|protected|static|final|async|\s)+[\w<>\[\],]+\s+(\w+)\s*\([^;]*\)\s*\{")
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*!?\(")
_IMPORT = re.compile(r"^\s*(?:import|use|require|include|from|#include)\s+[\"<{]?\s*([\w./:@-]+)")
_WORDS = frozenset("if for while switch return match catch function fn func def class sizeof new assert".split())


def source_files(spark: SparkSession, root: str, project_id: str, exclude: tuple[str, ...] = DEFAULTS.code_exclude, languages: tuple[str, ...] | None = None) -> DataFrame:
    """``project_id, path, language, content, content_hash`` of the known files below ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*" + re.escape("/" + root.strip("/") + "/").replace("/", "/+"), "")
    ext = F.regexp_extract("path", r"\.(\w+)$", 1)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    files = raw.select(F.lit(project_id).alias("project_id"), path.alias("path"), F.try_element_at(known, ext).alias("language"), F.decode("content", "UTF-8").alias("content"))
    skipped = "|".join(glob_regex(g) for g in exclude)
    files = files.where(F.col("language").isNotNull() & ~F.col("path").rlike(skipped))
    if languages is not None:
        files = files.where(F.col("language").isin(*languages))
    return files.withColumn("content_hash", content_hash(F.col("content")))


def _python(path: str, text: str) -> list[tuple]:
    out: list[tuple] = []

    def visit(node: ast.AST, owner: str | None, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_type = isinstance(child, ast.ClassDef)
                test = not is_type and child.name.startswith("test")
                kind = "type" if is_type else "test" if test else "method" if inside else "function"
                me = f"{path}#{child.lineno}:{child.name}"
                out.append(("node", me, kind, child.name, child.lineno, child.end_lineno, None))
                if test:
                    out.append(("test", me, None, child.name.removeprefix("test_") or None, None, None, None))
                if is_type:
                    out.extend(("inherit", None, None, b.id, None, None, child.name) for b in child.bases if isinstance(b, ast.Name))
                visit(child, owner if is_type else me, is_type)
                continue
            if isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name:
                    out.append(("call", owner, None, name, None, None, None))
            if isinstance(child, ast.Import | ast.ImportFrom):
                for a in child.names:
                    out.append(("node", f"{path}#{child.lineno}:{a.name}", "import", a.name, child.lineno, child.lineno, None))
            visit(child, owner, inside)

    visit(ast.parse(text), None, False)
    return out


def _lines(path: str, text: str) -> list[tuple]:
    """By patterns: good for declarations and plain calls, not a grammar."""
    out: list[tuple] = []
    owner, typed = None, False
    for no, line in enumerate(text.split("\n"), 1):
        if m := _IMPORT.match(line):
            out.append(("node", f"{path}#{no}:{m.group(1)}", "import", m.group(1), no, no, None))
        elif m := _TYPE.match(line):
            out.append(("node", f"{path}#{no}:{m.group(1)}", "type", m.group(1), no, no, None))
            typed = True
            if m.group(2):
                out.append(("inherit", None, None, m.group(2), None, None, m.group(1)))
        elif m := _FUNC.match(line):
            name = m.group(1) or m.group(2)
            test = name.lower().startswith("test")
            owner = f"{path}#{no}:{name}"
            out.append(("node", owner, "test" if test else "method" if typed and line[:1].isspace() else "function", name, no, no, None))
            if test:
                out.append(("test", owner, None, re.sub(r"^[Tt]est_?", "", name) or None, None, None, None))
            line = line[m.end() :]
            out += [("call", owner, None, c, None, None, None) for c in _CALL.findall(line) if c not in _WORDS]
        else:
            out += [("call", owner, None, c, None, None, None) for c in _CALL.findall(line) if c not in _WORDS]
    return out


PARSED = "project_id string, file_path string, record string, id string, kind string, name string, start_line int, end_line int, sub string"


def parse(files: DataFrame) -> DataFrame:
    """Records of ``files``: nodes, calls, tests, inherits; a Python file that does not parse is read by patterns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for project, path, language, text in zip(frame.project_id, frame.path, frame.language, frame.content, strict=True):
                try:
                    found = _python(path, text) if language == "python" else _lines(path, text)
                except (SyntaxError, ValueError, RecursionError):
                    found = _lines(path, text)
                rows += [(project, path, *r) for r in found]
            yield pd.DataFrame(rows, columns=["project_id", "file_path", "record", "id", "kind", "name", "start_line", "end_line", "sub"]).astype({"start_line": "Int32", "end_line": "Int32"})

    return files.select("project_id", "path", "language", "content").mapInPandas(run, PARSED)


def parsed_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    part = lambda r: parsed.where(F.col("record") == r)
    return {
        "nodes": part("node").select("project_id", "id", "file_path", "kind", "name", "start_line", "end_line").distinct(),
        "calls": part("call").select("project_id", "file_path", F.col("id").alias("caller_id"), F.col("name").alias("ref")).distinct(),
        "tests": part("test").select("project_id", "file_path", F.col("id").alias("test_id"), F.col("name").alias("ref")).distinct(),
        "inherits": part("inherit").select("project_id", "file_path", "sub", F.col("name").alias("ref")).distinct(),
    }


def snippets(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``id, snippet``: the lines of each node."""
    f = files.select("project_id", F.col("path").alias("file_path"), F.split("content", "\n").alias("lines"))
    return nodes.join(f, ["project_id", "file_path"]).select("id", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("snippet"))


def build(files: DataFrame, stored: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The code graph of ``files`` (:func:`source_files`): its tables (files, nodes, calls, tests, inherits, edges), and one
    row of counts (``n_files, n_parsed, n_skipped, n_removed, n_nodes, n_edges``).

    With ``stored``, the tables of an earlier build, only new and changed files are parsed, what is gone is dropped, and
    edges are resolved over all of it: the result is that of a full build.
    """
    spark = files.sparkSession
    known = files.select("project_id", "path", "content_hash")
    before = stored["files"] if stored else known.limit(0)
    again, gone = changed_files(files, before)
    again = again.select(*files.columns)
    fresh = parsed_tables(materialize(parse(again), "parsed"))
    if stored:
        fresh = {name: replace_files(stored[name], rows, again, gone) for name, rows in fresh.items()}
    tables = {name: materialize(rows, name) for name, rows in fresh.items()}
    tables |= {"files": materialize(known, "files"), "edges": materialize(resolve_edges(tables["nodes"], tables["calls"], tables["tests"], tables["inherits"]), "code-edges")}
    n, parsed = tables["files"].count(), again.count()
    counts = (n, parsed, n - parsed, gone.count(), tables["nodes"].count(), tables["edges"].count())
    return tables, spark.createDataFrame([counts], "n_files long, n_parsed long, n_skipped long, n_removed long, n_nodes long, n_edges long")
