"""Filtered search over files (``path, content``). Ignored paths go before lines are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S
from ..functions.ignore import SEARCH_EXCLUDES, glob_match, is_ignored
from ..scratch import Scratch
from .scans import prefix_sums


def lines(files: DataFrame) -> DataFrame:
    """``path, line_no`` (from 1) and ``line`` of every file; a closing line feed begins none."""
    cut = F.slice(F.split("content", "\n", -1), F.lit(1), S.line_count(F.col("content")).cast("int"))
    out = files.where(F.col("content") != "").select("path", F.posexplode(cut).alias("i", "line"))
    return out.select("path", (F.col("i") + 1).alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("line"))


def glob(files: DataFrame, pattern: str, limit: int, newest: Column) -> DataFrame:
    """Paths that fit and aren't ignored, newest first; limited after the sort."""
    out = files.where(glob_match(F.col("path"), pattern) & ~is_ignored(F.col("path")))
    return out.orderBy(newest.desc(), "path").limit(limit)


#: Endings of the names of files of a type.
TYPES = {
    "c": ("c", "h"), "cpp": ("cc", "cpp", "cxx", "hpp", "hh"), "cs": ("cs",), "go": ("go",), "html": ("html", "htm"), "java": ("java",), "js": ("js", "jsx", "mjs", "cjs"),
    "json": ("json",), "kotlin": ("kt", "kts"), "md": ("md", "markdown"), "py": ("py", "pyi"), "rust": ("rs",), "ts": ("ts", "tsx"), "txt": ("txt",), "yaml": ("yaml", "yml"),
}


def of_type(path: Column, name: str) -> Column:
    """Whether a path's name ends as files of the type do; ValueError for a type that isn't known."""
    if name not in TYPES:
        raise ValueError(f"no such file type: {name!r}")
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)).isin(*TYPES[name])


def searched(files: DataFrame, pattern: str, glob: str | None = None, ignore_case: bool = False, type: str | None = None) -> DataFrame:
    """Lines with ``hit``, of files that may be searched."""
    files = files.where(~is_ignored(F.col("path"), (), SEARCH_EXCLUDES))
    if glob:
        files = files.where(glob_match(F.col("path"), glob))
    if type:
        files = files.where(of_type(F.col("path"), type))
    return lines(files).withColumn("hit", F.rlike("line", F.lit(("(?i)" if ignore_case else "") + pattern)))


def grep_content(files: DataFrame, pattern: str, before: int = 0, after: int = 0, **options) -> DataFrame:
    """Lines that match, or stand so near one: ``path, line_no, line, hit``."""
    found = searched(files, pattern, **options)
    if not (before or after):
        return found.where("hit")
    near = F.max(F.col("hit").cast("int")).over(W.partitionBy("path").orderBy("line_no").rowsBetween(-after, before))
    return found.withColumn("near", near).where("near = 1").drop("near")


def grep_count(files: DataFrame, pattern: str, **options) -> DataFrame:
    return searched(files, pattern, **options).where("hit").groupBy("path").agg(F.count("*").alias("n"))


def grep_files(files: DataFrame, pattern: str, **options) -> DataFrame:
    """Files with a match anywhere: tested on whole contents, without splitting lines."""
    files = files.where(~is_ignored(F.col("path"), (), SEARCH_EXCLUDES))
    flags = "(?mi)" if options.get("ignore_case") else "(?m)"
    return files.where(F.rlike("content", F.lit(flags + pattern))).select("path")


def numbered(found: DataFrame, mode: str = "content", numbers: bool = False) -> DataFrame:
    """``path, line_no, text``: what a search prints of each line: its path, with ``numbers`` its
    number, and the line; ``:`` after what matches, ``-`` after lines around it."""
    mark = F.when(F.col("hit"), ":").otherwise("-")
    number = F.concat(F.col("line_no").cast("string"), mark) if numbers else F.lit("")
    return found.select("path", "line_no", F.concat("path", mark, number, "line").alias("text"))


def pass_through(files: DataFrame, pattern: str, keys: list[str], ignored: tuple[str, ...] = (), forced: bool = False, **options) -> DataFrame:
    """By ``keys`` (columns of ``files``): ``hits``, ``dropped`` (hits in ignored files, which aren't
    told) and whether the search is left to the agent (``passed``): it found nothing and nothing was
    dropped, so there is nothing to tell, unless it is ``forced``."""
    flags = "(?mi)" if options.get("ignore_case") else "(?m)"
    n = F.regexp_count("content", F.lit(flags + pattern)).cast("long")
    out = is_ignored(F.col("path"), ignored)
    found = files.groupBy(*keys).agg(F.coalesce(F.sum(F.when(~out, n)), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(out, n)), F.lit(0)).alias("dropped"))
    return found.withColumn("passed", (F.col("hits") == 0) & (F.col("dropped") == 0) & F.lit(not forced))


def byte_cap(found: DataFrame, most: int) -> DataFrame:
    """Each file's first lines up to ``most`` bytes."""
    upto = F.sum(F.octet_length("line").cast("long") + 1).over(W.partitionBy("path").orderBy("line_no"))
    return found.withColumn("upto", upto).where(F.col("upto") <= most).drop("upto")


def head_limit(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy("path", "line_no").limit(n)


def output_cap(found: DataFrame, most: int) -> DataFrame:
    """The first lines of the whole output, up to ``most`` bytes (a line feed a line included)."""
    size = F.octet_length("line").cast("long") + 1
    return prefix_sums(found, ["path", "line_no"], size, Scratch(found.sparkSession, "output"), most).drop("upto")


def grep_multiline(files: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """``path, n``: how often a pattern that may cross lines is met in each file."""
    files = files.where(~is_ignored(F.col("path"), (), SEARCH_EXCLUDES))
    n = F.regexp_count("content", F.lit(("(?si)" if ignore_case else "(?s)") + pattern)).cast("long")
    return files.select("path", n.alias("n")).where("n > 0")
