"""Code outlines as relations: long function bodies give way to a mark; signatures, types, imports
and comments stay, and doc comments keep their beginning.

A text is read as tokens (strings, comments, the rest) by one pattern, so that braces and
keywords in strings and comments don't count. Then everything is rows: a statement's head up to
its ``{`` or ``}`` with its line and depth (running sums), a block's end by the next brace of
its depth, a Python body's end by the next line indented no more than its ``def``; Python's lines that
can't be either come as one row. Of bodies within
bodies the outermost counts. All windows are by file, and look back only: a frame up to the end of
its rows is summed anew for each of them. What is cut comes back to the text as one array a file, so
no line of a text is shuffled; files that are dealt by ``file`` are shuffled nowhere. Rows are made
by outer generators: before others the planner looks whether an array is empty, and makes it twice.

Files have ``file``, ``language`` and ``content``; lines are numbered from 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import DEFAULT, LedgerConfig
from ..scratch import Scratch
from .scans import overlaps

BRACES = ("rust", "typescript", "javascript", "go", "java", "c", "cpp", "csharp", "kotlin", "swift", "php", "scala")
DOCS = tuple(x for x in BRACES if x not in ("rust", "go"))
#: Tokens of a text: a comment, a string, or a stretch of neither. A lone apostrophe is neither.
#: Repeats don't give back, so none takes more stack or time for a longer text.
BRACE_TOKENS = r"""//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|"(?:\\.|[^"\\\n])*+"?|'(?:\\[^\n][^'\n]{0,9}|[^'\\\n])'|`(?s:\\.|[^`\\])*+`?|[^/"'`]++|[/'`]"""
PYTHON_TOKENS = r'''#[^\n]*+|"""(?s:.*?)(?:"""|\z)|\'\'\'(?s:.*?)(?:\'\'\'|\z)|"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?|[^#"']++'''
#: Of texts whose strings and comments end with their line: what gives way, with the quotes of strings.
#: What begins one is asked first, and repeats are of a class, as these are what Java's patterns are fast at.
BRACE_BLANKS = r"""[/"'](?:(?<=/)/[^\n]*|(?<=("))[^"\\\n]*(?:\\.[^"\\\n]*)*+"?|(?<=')(?:\\[^\n][^'\n]{0,9}|[^'\\\n])('))"""
PYTHON_BLANKS = r"""[#"'](?:(?<=#)[^\n]*|(?<=("))[^"\\\n]*(?:\\.[^"\\\n]*)*+"?|(?<=('))[^'\\\n]*(?:\\.[^'\\\n]*)*+'?)"""
#: A stretch of tokens up to a brace that is code, or to the end; its rest is read as by BRACE_TOKENS.
#: Repeats of a class are greedy here, which is what Java's patterns are fast at; nothing that follows makes them give back.
BRACE_PARTS = r"""(?!\z)(?:[^/"'`{}]+|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"[^"\\\n]*(?:\\.[^"\\\n]*)*+"?|'(?:\\[^\n][^'\n]{0,9}|[^'\\\n])'|`[^`\\]*(?s:\\.[^`\\]*)*+`?|[/'`])*+(?:[{}]|\z)"""
#: Of Python's code: lines, and as one piece each the lines in a row that are indented alike, hold no
#: colon and begin no ``def``. Neither a head nor a body's end can be among those but for the first.
PIECES = r"( *)(?!(?:async\s+)?def\s)[^\s:][^\n:]*\n(?:\1(?!(?:async\s+)?def\s)[^\s:][^\n:]*\n)*+|[^\n]*\n|[^\n]+"
CONTROL = r"^(?:[}\s]|\belse\b)*\b(?:if|for|foreach|while|switch|catch|match|when|loop|do|try|using|lock|synchronized|return|guard|select|unsafe|with)\b"
TYPE = r"^(?:[\w@\[\]()<>.,\"\s]*?\s)?(?:class|struct|enum|interface|trait|impl|namespace|mod|module|union|object|record|extension|protocol)\b(?![^{]*=>)"
CALLED = r"([\w$~]+)\s*(?:<[^()]*>|\[[^\]()]*\])?\s*\("
ASSIGNED = r"(?:const|let|var|val)\s+([\w$]+)"
KEYWORDS = ("func", "fn", "fun", "function")
DEF = r"^\s*(?:async\s+)?def\s+(\w+)"
#: Doc comments of as many lines or more keep so many lines of their summary, and tags.
DOC_LINES, SUMMARY, TAGS = 6, 2, 6


def masked(content: Column, language: Column) -> Column:
    """The text with its line feeds, empty strings for strings and nothing for comments."""
    return F.when(language == "python", python_masked(content)).otherwise(brace_masked(content))


def _masked(content: Column, pattern: str, comments: tuple[str, ...], strings: tuple[str, ...]) -> Column:
    begins = lambda x, marks: reduce(lambda a, b: a | b, (F.startswith(x, F.lit(m)) for m in marks))
    feeds = lambda x: F.when(F.contains(x, F.lit("\n")), F.regexp_replace(x, r"[^\n]+", "")).otherwise(F.lit(""))
    # an apostrophe alone is code
    string = lambda x: begins(x, strings) & (x != "'") if pattern is BRACE_TOKENS else begins(x, strings)
    blank = lambda x: F.when(string(x), F.concat(F.lit('""'), feeds(x))).when(begins(x, comments), feeds(x)).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), blank), "")


def _blanked(content: Column, pattern: str, odd: tuple[str, ...]) -> tuple[Column, Column]:
    """Whether a text has none of the ``odd`` marks, and its mask then: no token takes a line feed, so
    one pass replaces them. Quotes that it leaves twice are those of strings."""
    plain = reduce(lambda a, b: a & b, (~F.contains(content, F.lit(m)) for m in odd))
    blanked = F.regexp_replace(content, pattern, "$1$1$2$2")
    return plain, F.when(F.contains(content, F.lit("'")), F.regexp_replace(blanked, "''", '""')).otherwise(blanked)


def brace_masked(content: Column) -> Column:
    plain, blanked = _blanked(content, BRACE_BLANKS, ("/*", "`", "''"))
    return F.when(plain, blanked).otherwise(_masked(content, BRACE_TOKENS, ("//", "/*"), ('"', "'", "`")))


def python_masked(content: Column) -> Column:
    plain, blanked = _blanked(content, PYTHON_BLANKS, ('"""', "'''"))
    return F.when(plain, blanked).otherwise(_masked(content, PYTHON_TOKENS, ("#",), ('"', "'")))


def lines_of(files: DataFrame) -> DataFrame:
    """``file, language, k, line``: every line."""
    rows = files.select("file", "language", F.posexplode_outer(F.split("content", "\n", -1)).alias("k", "line"))
    return rows.select("file", "language", (F.col("k") + 1).alias("k"), "line")


def python_lines(files: DataFrame) -> DataFrame:
    """``file, t, code, k`` of Python files: the code, nothing but feeds being left of strings and comments,
    in pieces of :data:`PIECES` with the number of their first line."""
    pieces = F.regexp_extract_all(python_masked(F.col("content")), F.lit(PIECES), F.lit(0))
    rows = files.where("language = 'python'").select("file", F.posexplode_outer(pieces).alias("t", "code"))
    rows = rows.withColumn("feeds", F.regexp_count("code", F.lit("\n")))
    k = F.sum("feeds").over(W.partitionBy("file").orderBy("t")) - F.col("feeds") + 1
    return rows.select("file", "t", "code", k.cast("int").alias("k"))


def once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with columns that are made once a row: filters on them stay behind the generator, where
    they would else be given the whole expression."""
    for name, column in made.items():
        rows = rows.select("*", F.explode_outer(F.array(column)).alias(name))
    return rows


def name_of(head: Column) -> Column:
    """The function that a head opens; null if it opens something else."""
    assigned = F.when(F.contains(head, F.lit("=>")) | F.contains(head, F.lit("function")), F.regexp_extract(head, ASSIGNED, 1))
    called = F.regexp_extract_all(F.regexp_replace(head, r"@\w+(?:\([^)]*\))?", ""), F.lit(CALLED), F.lit(1))
    # what a keyword calls is a receiver, or a function without a name
    plain = F.get(F.filter(called, lambda x: ~x.isin(*KEYWORDS)), F.lit(0))
    opens = F.contains(head, F.lit("(")) & ~F.rlike(head, F.lit(CONTROL)) & ~F.rlike(head, F.lit(TYPE))
    # a head that closes more than it opens goes on from a ; in brackets
    whole = F.regexp_count(head, F.lit(r"\(")) >= F.regexp_count(head, F.lit(r"\)"))
    return F.when(opens & whole, F.coalesce(F.when(assigned != "", assigned), plain, F.get(called, F.lit(0))))


def brace_bodies(files: DataFrame, least: int) -> DataFrame:
    """``file, first, last, name`` of bodies in braces of ``least`` lines or more."""
    own = files.where(F.col("language").isin(*BRACES))
    # what follows the last brace ends with one that opens nothing
    parts = F.regexp_extract_all(F.concat("content", F.lit("\n{")), F.lit(BRACE_PARTS), F.lit(0))
    rows = own.select("file", F.posexplode_outer(parts).alias("t", "part"))
    order = W.partitionBy("file").orderBy("t")
    opens, feeds = F.endswith("part", F.lit("{")), F.regexp_count("part", F.lit("\n"))
    # the head is what follows the last statement; that of a closing brace is never asked for, so bodies aren't masked
    head = F.when(opens, F.trim(F.regexp_replace(F.substring_index(brace_masked(F.col("part")), ";", -1), r"[\n{};]", " "))).otherwise(F.lit(""))
    rows = rows.select("file", "t", F.when(opens, F.lit("{")).otherwise(F.lit("}")).alias("mark"), head.alias("head"), feeds.alias("feeds"))
    rows = rows.withColumns({"line": F.sum("feeds").over(order) + 1, "depth": F.sum(F.when(F.col("mark") == "{", 1).otherwise(-1)).over(order)})
    level = W.partitionBy("file", "level").orderBy("t")
    rows = rows.withColumn("level", F.col("depth") + (F.col("mark") == "}").cast("int"))
    rows = rows.withColumns({"end": F.lead("line").over(level), "end_mark": F.lead("mark").over(level), "end_t": F.lead("t").over(level)})
    found = rows.where("mark = '{' and end_mark = '}'").where(F.col("end") - F.col("line") - 1 >= least)
    found = once(found.select("file", "line", "end", "t", "end_t", "head"), name=name_of(F.col("head"))).where(F.col("name").isNotNull())
    return outermost(found.select("file", (F.col("line") + 1).alias("first"), (F.col("end") - 1).alias("last"), "name", F.col("t").alias("a"), F.col("end_t").alias("b")))


def outermost(bodies: DataFrame) -> DataFrame:
    """``file, first, last, name`` of bodies, from ``a`` to ``b``, that no other one holds."""
    before = F.max("b").over(W.partitionBy("file").orderBy("a").rowsBetween(W.unboundedPreceding, -1))
    return bodies.withColumn("upto", before).where("upto is null or upto < a").select("file", "first", "last", "name")


def python_bodies(lines: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """As above, of ``def`` bodies, from :func:`python_lines`; the signature goes on to a colon outside of brackets."""
    order, back = W.partitionBy("file").orderBy("k"), W.partitionBy("file").orderBy(F.desc("k"))
    count = lambda marks: F.regexp_count("code", F.lit(marks))
    rows = lines.withColumn("depth", F.sum(count(r"[(\[{]") - count(r"[)\]}]")).over(order))
    code = F.rtrim(F.when(F.endswith("code", F.lit("\n")), F.left("code", F.length("code") - 1)).otherwise(F.col("code")))
    # only a line that is a piece of its own has a colon
    colon = (F.col("depth") <= 0) & F.contains("code", F.lit(":"))
    indent = F.length(F.regexp_replace(F.regexp_extract("code", r"^[ \t]*", 0), "\t", "        "))
    last = F.col("k") + F.greatest(F.regexp_count(code, F.lit("\n")), F.lit(0))
    rows = rows.select("file", "k", last.alias("upto"), code.alias("code"), colon.alias("here"), indent.alias("indent")).where(F.col("code") != "")
    ends = F.when(F.col("here") & F.endswith("code", F.lit(":")), F.col("k"))
    rows = rows.withColumns({"name": F.regexp_extract("code", DEF, 1), "next_end": F.min(ends).over(back.rowsBetween(W.unboundedPreceding, -1))})
    rows = rows.withColumns({"last_code": F.lag("upto").over(order), "final": F.max("upto").over(W.partitionBy("file"))})
    rows = scratch.keep(rows.select("file", "k", "name", "indent", "last_code", "final", "next_end", "here"), "python")
    defs = rows.where("name <> ''").select("file", F.col("indent").alias("level"), F.col("k").alias("a"), "name", F.when(F.col("here"), F.col("k")).otherwise(F.col("next_end")).alias("k"), "final").where("k is not null")
    # by level of indentation: the next line that ends a body of it
    levels = defs.select("file", "level").distinct()
    stops = rows.join(levels, "file").where("indent <= level").select("file", "level", "k", "last_code", F.lit(None).cast("int").alias("a"))
    asked = defs.select("file", "level", "k", F.lit(None).cast("int").alias("last_code"), "a")
    after = W.partitionBy("file", "level").orderBy(F.desc("k"), F.col("a").isNotNull().desc()).rowsBetween(W.unboundedPreceding, -1)
    found = stops.unionByName(asked).withColumn("stop", F.last(F.when(F.col("a").isNull(), F.struct("k", "last_code")), ignorenulls=True).over(after)).where("a is not null")
    both = defs.withColumnRenamed("k", "sig").join(found.select("file", "a", "stop"), ["file", "a"])
    last = F.when(F.col("stop").isNull(), F.col("final")).otherwise(F.col("stop.last_code"))
    both = both.select("file", (F.col("sig") + 1).alias("first"), last.alias("last"), "name", "a", last.alias("b"))
    return outermost(both.where(F.col("last") - F.col("first") + 1 >= least))


def doc_blocks(lines: DataFrame) -> DataFrame:
    """``file, first, last`` of stretches of long doc comments to leave out, two lines at least."""
    rows = lines.where(F.col("language").isin(*DOCS))
    order, back = W.partitionBy("file").orderBy("k"), W.partitionBy("file").orderBy(F.desc("k"))
    body = F.trim(F.regexp_replace(F.trim("line"), r"^\*+", ""))
    ends = F.when(F.contains("line", F.lit("*/")), F.col("k"))
    rows = rows.withColumns({"body": body, "end": F.min(ends).over(back.rowsBetween(W.unboundedPreceding, 0)), "opens": F.startswith(F.trim("line"), F.lit("/**"))})
    start = F.last(F.when(F.col("opens"), F.struct("k", "end")), ignorenulls=True).over(order)
    rows = rows.withColumn("block", start).where((F.col("k") <= F.col("block.end")) & (F.col("block.end") - F.col("block.k") + 1 >= DOC_LINES))
    within = W.partitionBy("file", "block.k").orderBy("k")
    edge = (F.col("k") == F.col("block.k")) | (F.col("k") == F.col("block.end"))
    tag, text = ~edge & F.startswith("body", F.lit("@")), ~edge & (F.col("body") != "") & ~F.startswith("body", F.lit("@"))
    rows = rows.withColumns({"tags": F.sum(tag.cast("int")).over(within), "texts": F.sum(text.cast("int")).over(within)})
    stays = edge | (tag & (F.col("tags") <= TAGS)) | (text & (F.col("texts") <= SUMMARY) & (F.col("tags") == 0))
    gone = rows.where(~stays).withColumn("run", F.col("k") - F.row_number().over(W.partitionBy("file").orderBy("k")))
    return gone.groupBy("file", "run").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("last > first").drop("run")


def _known(files: DataFrame, config: LedgerConfig) -> DataFrame:
    """Files that may be outlined."""
    return files.where((F.octet_length("content") >= config.compress_min_bytes) & F.col("language").isin("python", *BRACES))


def elided(files: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``file, first, last, name`` of stretches that an outline leaves out; no name: of a comment."""
    known, least = _known(files, config), max(4, config.min_body_lines)
    bodies = brace_bodies(known, least).unionByName(python_bodies(python_lines(known), least, Scratch(files.sparkSession, "outlines")))
    docs = doc_blocks(lines_of(known.where(F.contains("content", F.lit("/**"))))).withColumn("name", F.lit(None).cast("string"))
    both = bodies.withColumn("kind", F.lit(0)).unionByName(docs.withColumn("kind", F.lit(1)))
    # a comment within a body goes with it
    return outermost(both.select("file", "first", "last", "name", (2 * F.col("first") + F.col("kind")).alias("a"), (2 * F.col("last") + 1).alias("b")))


def _cut(files: DataFrame, config: LedgerConfig) -> DataFrame:
    """``files`` with ``cuts``: what an outline leaves out of each, in order, with ``gone``, the lines
    that are gone before; null if it leaves out nothing. A file's text meets one row of its cuts."""
    before = F.sum(F.col("last") - F.col("first")).over(W.partitionBy("file").orderBy("first").rowsBetween(W.unboundedPreceding, -1))
    rows = elided(files, config).withColumn("gone", F.coalesce(before, F.lit(0)).cast("int"))
    cuts = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("first", "last", "gone", "name"))).alias("cuts"))
    return files.join(cuts.hint("shuffle_hash"), "file", "left")


def _stretches(lines: Column, cuts: Column, stretch, mark) -> Column:
    """Of ``lines``, a column that was made once, what an outline shows, in order, without a look at lines that it leaves out: before each cut
    ``stretch`` of the lines that stay, of the number of those before them and of the cut, then the cut's ``mark``."""

    def part(c, i):
        start = F.when(i > 0, F.get(cuts, i - 1)["last"]).otherwise(F.lit(0)).cast("int")
        return F.concat(stretch(F.slice(lines, start + 1, (c["first"] - 1).cast("int") - start), start, c["gone"]), F.array(mark(lines, c)))

    end = F.get(cuts, F.size(cuts) - 1)
    n = end["last"].cast("int")
    rest = stretch(F.slice(lines, n + 1, F.size(lines)), n, end["gone"] + (end["last"] - end["first"]).cast("int"))
    return F.concat(F.flatten(F.transform(cuts, part)), rest)


def _mark(language: Column):
    comment = F.when(language == "python", "#").otherwise("//")

    def mark(lines, c):
        n = (c["last"] - c["first"] + 1).cast("string")
        spelt = F.concat(F.regexp_extract(F.get(lines, (c["first"] - 1).cast("int")), r"^\s*", 0), comment, F.lit(" ... "), n, F.lit(" lines of "), c["name"], F.lit(" elided"))
        return F.coalesce(spelt, F.concat(F.lit(" * ... "), n, F.lit(" lines elided")))

    return mark


def _shown(lines: Column, language: Column, cuts: Column) -> Column:
    """The outline's lines in order: ``compressed_line, original_start, original_end, symbol, elided, text``."""
    spelt = _mark(language)

    def row(k, gone, last, symbol, elided, text):
        return F.struct((k - gone).cast("int").alias("compressed_line"), k.cast("int").alias("original_start"), last.cast("long").alias("original_end"), symbol.cast("string").alias("symbol"), F.lit(elided).alias("elided"), text.alias("text"))

    stretch = lambda rows, start, gone: F.transform(rows, lambda x, k: row(start + k + 1, gone, start + k + 1, F.lit(None), False, x))
    return _stretches(lines, cuts, stretch, lambda lines, c: row(c["first"], c["gone"], c["last"], c["name"], True, spelt(lines, c)))


def source_map(files: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``file, compressed_line, original_start, original_end, symbol, elided, text``: the lines of
    every outline, of files that lose something."""
    rows = _cut(files.select("file", "language", "content"), config).where("cuts is not null")
    rows = once(rows, lines=F.split("content", "\n", -1))
    return rows.select("file", F.inline_outer(_shown(F.col("lines"), F.col("language"), F.col("cuts"))))


def outlined(files: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``files`` with ``text, names``: their outline if that is smaller, else null."""
    tokens = lambda c: F.call_function("div", F.octet_length(c) + 3, F.lit(4))
    shown = _stretches(F.col("lines"), F.col("cuts"), lambda rows, start, gone: rows, _mark(F.col("language")))
    cut = F.col("cuts").isNotNull()
    rows = once(_cut(files, config), lines=F.when(cut, F.split("content", "\n", -1)))
    rows = once(rows, text=F.when(cut, F.array_join(shown, "\n"))).drop("lines")
    smaller = tokens(F.col("text")) < tokens(F.col("content"))
    names = F.transform(F.filter("cuts", lambda c: c["name"].isNotNull()), lambda c: c["name"])
    return rows.withColumns({"text": F.when(smaller, F.col("text")), "names": F.when(smaller, names)}).drop("cuts")


def outlines(files: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``file, text, names`` of files whose outline is smaller."""
    return outlined(files.select("file", "language", "content"), config).where("text is not null").select("file", "text", "names")


def edit_hits(files: DataFrame, needles: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``file, names``: of elided functions that an edit of the ``needle`` (``file, needle``) would touch,
    wherever it stands; needles of under four bytes are too common to tell."""
    asked = files.join(needles.where(F.octet_length("needle") >= 4).hint("shuffle_hash"), "file")
    parts = asked.select("file", "needle", F.posexplode(F.split(F.col("content"), F.concat(F.lit("\\Q"), F.replace("needle", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)).alias("i", "part"))
    feeds = lambda c: F.regexp_count(c, F.lit("\n"))
    order = W.partitionBy("file", "needle").orderBy("i")
    at = F.sum(feeds("part")).over(order) + F.col("i") * feeds("needle") + 1
    rows = parts.withColumns({"low": at, "n": F.max("i").over(W.partitionBy("file", "needle"))}).where("i < n")
    spans = rows.select("file", "low", (F.col("low") + feeds("needle") - F.endswith("needle", F.lit("\n")).cast("int")).alias("high"))
    cut = elided(files, config).where("name is not null").select("file", F.col("first").alias("low"), F.col("last").alias("high"), "name")
    met = overlaps(cut, spans, ["file"], 64)
    return met.groupBy("file").agg(F.array_sort(F.collect_set("name")).alias("names"))


def edit_warnings(edits: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``file, warning`` of edits (``file, language, before, after``) that seem to have taken an outline
    for the text: they wrote its mark, cut the text by over half, or emptied functions."""
    marked = F.rlike("after", F.lit(r"[#/](?<=#|//) \.\.\. \d+ lines of \w+ elided"))
    half = (F.octet_length("before") > 200) & (F.octet_length("after") * 2 < F.octet_length("before"))
    plain = F.when(marked, "the edit wrote an outline's mark into the file").when(half, "the edit removed over half of the file")
    told = once(edits.select("file", "language", "before", "after"), warning=plain)
    # bodies are looked for where nothing else is told and something changed
    asked = lambda c: F.when(F.col("warning").isNull() & (F.col("before") != F.col("after")), F.col(c)).alias(c)
    told = Scratch(edits.sparkSession, "warnings").keep(told.select("file", "language", "warning", asked("before"), asked("after")), "edits")  # read from six sides
    plain, edits = told.select("file", "warning"), told.where("before is not null")
    side = lambda c: elided(edits.select("file", "language", F.col(c).alias("content")), config).where("name is not null").select("file", "name").distinct()
    gone = side("before").join(side("after"), ["file", "name"], "left_anti")
    # a name that is called stands at a boundary and goes up to a bracket; every call is looked at once
    calls = F.regexp_extract_all("after", F.lit(r"\b(?=([\w$~]++)\s*+\()"), F.lit(1))
    still = gone.join(edits.select("file", F.explode(F.array_distinct(calls)).alias("name")), ["file", "name"], "left_semi")
    short = still.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    both = plain.join(short, "file", "left")
    return both.select("file", F.coalesce("warning", F.concat(F.lit("bodies became short: "), F.col("names"))).alias("warning")).where("warning is not null")
