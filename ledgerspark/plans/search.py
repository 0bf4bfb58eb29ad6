"""Queries over paths and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.ignore import glob_match, is_ignored
from ..operators import search as G
from ..sources.tables import FILES_SQL, files, table

Q: dict = {}
LINES = f"""WITH {FILES_SQL},
cut AS (SELECT path, string_split(content, chr(10)) AS ls, ends_with(content, chr(10)) AS fed FROM files WHERE content <> ''),
lines AS (SELECT path, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line_no, unnest(ls) AS line0, len(ls) AS n, fed FROM cut),
ln AS (SELECT path, line_no, regexp_replace(line0, '\\r$', '') AS line FROM lines WHERE NOT (fed AND line_no = n))"""


def q(name, sql=None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


@q("glob_match", f"WITH {FILES_SQL} SELECT path FROM files WHERE regexp_matches(path, '^src1.*/en/.*7$')")
def _(spark, d):
    return files(spark, d).where(glob_match(F.col("path"), "src1*/en/*7")).select("path")


@q("ignore_filter", f"WITH {FILES_SQL} SELECT path, regexp_matches(path, '^src3/.*$') AND NOT regexp_matches(path, '^src3/en/.*$') AS ignored FROM files")
def _(spark, d):
    return files(spark, d).select("path", is_ignored(F.col("path"), ("src3/", "!src3/en/")).alias("ignored"))


@q("ignored_urls", r"SELECT page_id, regexp_matches(url, '^.*\.html$') OR regexp_matches(regexp_extract(url, '[^/]+$'), '^.*\.html$') AS ignored FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", is_ignored(F.col("url"), ("*.html",), ()).alias("ignored"))


@q("glob_newest", f"WITH {FILES_SQL} SELECT path FROM files WHERE regexp_matches(path, '^src.*/de/.*$') ORDER BY doc_id DESC, path LIMIT 1000")
def _(spark, d):
    return G.glob(files(spark, d), "src*/de/*", DEFAULT.glob_limit, F.col("doc_id")).select("path")


@q("grep_content", f"{LINES} SELECT path, line_no, line FROM ln WHERE regexp_matches(line, 'th[aeiou]+n\\b')")
def _(spark, d):
    return G.grep_content(files(spark, d), r"th[aeiou]+n\b").select("path", "line_no", "line")


@q("grep_count", f"{LINES} SELECT path, count(*) AS n FROM ln WHERE regexp_matches(line, '(?i)license') GROUP BY 1")
def _(spark, d):
    return G.grep_count(files(spark, d), "license", ignore_case=True)


@q("grep_files", f"{LINES} SELECT DISTINCT path FROM ln WHERE regexp_matches(line, 'MIT')")
def _(spark, d):
    return G.grep_files(files(spark, d), "MIT")


@q("grep_context", f"{LINES}, h AS (SELECT *, regexp_matches(line, 'MIT') AS hit FROM ln), x AS (SELECT *, max(CAST(hit AS INTEGER)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM h) SELECT path, line_no, line, hit FROM x WHERE near = 1")
def _(spark, d):
    return G.grep_content(files(spark, d), "MIT", before=2, after=1)


@q("grep_glob", f"{LINES} SELECT path, line_no FROM ln WHERE regexp_matches(path, '^src2/.*$') AND regexp_matches(line, 'and')")
def _(spark, d):
    return G.grep_content(files(spark, d), "and", glob="src2/**").select("path", "line_no")


@q("grep_head_limit", f"{LINES} SELECT path, line_no FROM ln WHERE regexp_matches(line, 'and') ORDER BY path, line_no LIMIT 100")
def _(spark, d):
    return G.head_limit(G.grep_content(files(spark, d), "and"), 100).select("path", "line_no")


@q("grep_byte_cap", f"{LINES}, h AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY line_no) AS upto FROM ln WHERE regexp_matches(line, 'and')) SELECT path, line_no FROM h WHERE upto <= 2000")
def _(spark, d):
    return G.byte_cap(G.grep_content(files(spark, d), "and"), 2000).select("path", "line_no")


@q("grep_output_cap", f"{LINES}, h AS (SELECT *, sum(strlen(line) + 1) OVER (ORDER BY path, line_no) AS upto FROM ln WHERE regexp_matches(line, 'and')) SELECT path, line_no FROM h WHERE upto <= 20000")
def _(spark, d):
    return G.output_cap(G.grep_content(files(spark, d), "and"), 20000).select("path", "line_no")


@q("grep_multiline", f"WITH {FILES_SQL}, x AS (SELECT path, CAST(len(regexp_extract_all(content, '(?s)[.] *\\n[A-Z]')) AS BIGINT) AS n FROM files) SELECT path, n FROM x WHERE n > 0")
def _(spark, d):
    return G.grep_multiline(files(spark, d), "[.] *\\n[A-Z]")


#: Files with a language's ending, those of one in a folder that is ignored by default.
NAMED = """named AS (SELECT doc_id, source, CASE lang WHEN 'de' THEN 'node_modules/' ELSE '' END || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.rs' ELSE '.md' END AS path, text AS content FROM documents)"""


def named(spark, d):
    t = table(spark, d, "documents")
    folder, end = F.when(F.col("lang") == "de", "node_modules/").otherwise(""), F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".rs").otherwise(".md")
    return t.select("doc_id", "source", F.concat(folder, F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"), F.col("text").alias("content"))


@q("grep_type", f"""WITH {NAMED}, ln AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT path, CASE WHEN ends_with(content, chr(10)) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS ls FROM named WHERE content <> '' AND ends_with(path, '.py')))
SELECT path, line_no, path || ':' || line_no || ':' || regexp_replace(line, chr(13) || '$', '') AS text FROM ln WHERE regexp_matches(line, 'th[aeiou]+n\\b')""")
def _(spark, d):
    """Matches in files of one type, with line numbers, as they are printed."""
    return G.numbered(G.grep_content(named(spark, d), r"th[aeiou]+n\b", type="py"), numbers=True)


@q("grep_pass_through", f"""WITH {NAMED}, x AS (SELECT source, starts_with(path, 'node_modules/') AS out, CAST(len(regexp_extract_all(content, 'MIT License')) AS BIGINT) AS n FROM named)
SELECT source, CAST(coalesce(sum(n) FILTER (NOT out), 0) AS BIGINT) AS hits, CAST(coalesce(sum(n) FILTER (out), 0) AS BIGINT) AS dropped, coalesce(sum(n), 0) = 0 AS passed FROM x GROUP BY 1""")
def _(spark, d):
    """Of each source whether a search is left to the agent, as nothing was found or dropped."""
    return G.pass_through(named(spark, d), "MIT License", ["source"])


@q("default_ignores", f"WITH {NAMED} SELECT doc_id, starts_with(path, 'node_modules/') AS ignored FROM named")
def _(spark, d):
    """What the list of default patterns leaves out."""
    return named(spark, d).select("doc_id", is_ignored(F.col("path")).alias("ignored"))


@q("prefix_filter", f"WITH {FILES_SQL} SELECT path FROM files WHERE path = 'src1' OR starts_with(path, 'src1/')")
def _(spark, d):
    return files(spark, d).where((F.col("path") == "src1") | F.startswith("path", F.lit("src1/"))).select("path")


@q("workspace_filter", f"WITH {FILES_SQL} SELECT path, NOT coalesce(path = 'src0' OR starts_with(path, 'src0/'), false) AS refused FROM files")
def _(spark, d):
    inside = (F.col("path") == "src0") | F.startswith("path", F.lit("src0/"))
    return files(spark, d).select("path", (~F.coalesce(inside, F.lit(False))).alias("refused"))
