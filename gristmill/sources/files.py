"""Files as rows: discovery with early predicates, language by name or first line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regex

# What a scan leaves out by default.
EXCLUDED = (
    "*.pyc", "*.pyo", "*.so", "*.dylib", "*.dll", "*.exe", "*.bin", "*.o", "*.a", "*.lib", "*.class", "*.jar", "*.war", "*.ear",
    "__pycache__", ".git", ".svn", ".hg", ".bzr", "node_modules", "venv", "env", ".venv", ".env", "dist", "build", "target",
    ".idea", ".vscode", "*.min.js", "*.min.css", ".DS_Store", "Thumbs.db",
)
# Language by extension.
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".c": "c", ".cpp": "cpp",
    ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala", ".sh": "bash", ".bash": "bash", ".zsh": "zsh", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss",
    ".sass": "sass", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml", ".md": "markdown", ".r": "r", ".m": "matlab", ".pl": "perl",
    ".lua": "lua", ".vim": "vim", ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hrl": "erlang", ".clj": "clojure", ".dart": "dart",
}
# Language by whole file name, and by a word of the first line.
NAMES = {"makefile": "makefile", "gnumakefile": "makefile", "dockerfile": "dockerfile", "vagrantfile": "ruby", "rakefile": "ruby", "gemfile": "ruby", "podfile": "ruby"}
SHEBANGS = (("python", "python"), ("node", "javascript"), ("javascript", "javascript"), ("ruby", "ruby"), ("bash", "bash"), ("sh", "bash"), ("perl", "perl"), ("php", "php"))

MAX_SIZE = 1 << 20


def language(path: str, content: str | None = None) -> Column:
    """Language by extension, else by file name, else by the first line's interpreter; null if none tells."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ext = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    found = F.coalesce(F.try_element_at(table(EXTENSIONS), ext), F.try_element_at(table(NAMES), name))
    if content:
        first = F.substring_index(content, "\n", 1)
        shebang = None
        for word, lang in SHEBANGS:
            fits = F.startswith(first, F.lit("#!")) & F.contains(first, F.lit(word))
            shebang = F.when(fits, lang) if shebang is None else shebang.when(fits, lang)
        found = F.coalesce(found, shebang)
    return found


def scan_predicate(path: str, length: Column, include: Sequence[str] | None = None, exclude: Sequence[str] = EXCLUDED, max_size: int = MAX_SIZE) -> Column:
    """What a scan keeps: not excluded, included (or, without a list, of a known language or text), not too long."""
    keep = ~regex.glob_any_part(path, list(exclude)) & (length <= max_size)
    return keep & regex.glob_any_part(path, list(include)) if include else keep


def read_files(spark: SparkSession, root: str, include: Sequence[str] | None = None, exclude: Sequence[str] = EXCLUDED, max_size: int = MAX_SIZE) -> DataFrame:
    """Text files under ``root``: file_path (below it), language, content.

    Names and lengths are tested on the listing; contents of other files are not read. Files that are
    not UTF-8 are dropped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    below = F.regexp_replace(F.substring_index("path", base, -1), "^/+", "")
    f = raw.withColumn("file_path", below).where(scan_predicate("file_path", F.col("length"), include, exclude, max_size))
    f = f.withColumn("content", F.try_validate_utf8(F.col("content").cast("string"))).where("content IS NOT NULL")
    f = f.withColumn("language", language("file_path", "content"))
    return f.where("language IS NOT NULL" if not include else "TRUE").select("file_path", "language", "content")
