"""Outlines as relations against a scanner of one text at a time."""

import random
import re

import plain_outline as plain
import pytest
from pyspark.sql import functions as F
from test_kernels import BODY, HEADS, PY, RS, TS

from ledgerspark.operators import outlines as R
from ledgerspark.plans import text as T
from ledgerspark.plans.text import FUNCTIONS

SCHEMA = "file long, language string, content string"


def sources(seed, n):
    """Functions of eight languages, within classes and after comments, with braces, quotes,
    keywords and brackets in strings and comments."""
    rng, out = random.Random(seed), []
    brace = ['        x = g("}"); // {\n', "        y = 'a';\n", "        /* { \n } */ z;\n", "        if (a) { b(); }\n", "        `t {\n`;\n", "        for (i = 0; i < n(); i++) { c(\"\\\"{\"); }\n", "\n"]
    python = ['        x = g("}")  # {\n', "        y = 'def f():'\n", "        if a:\n            b()\n", "\n", "        z = (1,\n  2)\n", '        """d\ndef g():\n"""\n', "        def inner(a):\n            return 1\n"]
    for i in range(n):
        language = rng.choice(list(FUNCTIONS))
        py, (head, tail) = language == "python", FUNCTIONS[language]
        text = ("# " if py else "// ") + "x" * 1100 + "\n"
        for j in range(rng.randint(1, 6)):
            if not py and rng.random() < 0.3:
                text += "/**\n" + "".join(rng.choice([f" * text {k}\n", " *\n", f" * @tag {k}\n"]) for k in range(rng.randint(1, 14))) + " */\n"
            inside = not py and rng.random() < 0.2
            text += ("class K {\n" if inside else "") + head.replace("%", f"f{i}_{j}") + "".join(rng.choice(python if py else brace) for _ in range(rng.randint(1, 30))) + tail + ("}\n" if inside else "")
        out.append((i, language, text))
    return out


def found(df):
    return {r.file: (r.text, list(r.names)) for r in R.outlines(df).collect()}


def wanted(rows):
    out = {}
    for i, language, text in rows:
        o = plain.outline(text, language)
        if o is not None:
            out[i] = "\n".join(o.lines), o.names
    return out


def test_random_sources(spark):
    # the scanner takes a def in a doc string for one; such texts are left to the next test
    rows = [r for r in sources(3, 150) if '"""' not in r[2]]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit("clash")).withColumn("line", F.lit(0)).repartition(3)
    want = wanted(rows)
    assert found(df) == want and len(want) > 50
    maps = {}
    for r in R.source_map(df).collect():
        maps.setdefault(r.file, []).append((r.compressed_line, r.original_start, r.original_end, r.symbol, r.elided))
    for i, language, text in rows:
        if i in want:
            assert sorted(maps[i]) == plain.outline(text, language).source_map


def test_known_texts(spark):
    rows = [(0, "python", PY), (1, "rust", RS), (2, "typescript", TS), (3, "generic", PY), (4, "python", "def f():\n    pass\n"), (5, "java", None), (6, None, PY)]
    rows += [(10 + i, language, "// " + "x" * 1100 + "\n" + head + BODY + "}\n" + head.replace(name, "other") + BODY + "}\n") for i, (language, head, name) in enumerate(HEADS)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert [got[i][1] for i in range(3)] == [["m0", "m1", "m2"], ["m0", "m1", "m2"], ["f", "m"]] and not got.keys() & {3, 4, 5, 6}
    assert [got[10 + i][1] for i in range(len(HEADS))] == [[name, "other"] for _, _, name in HEADS]
    assert got == wanted([r for r in rows if r[1] and r[2]])
    assert R.outlines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_doc_string_is_no_code(spark):
    body = "".join(f"    x{i} = {i}\n" for i in range(20))
    text = "# " + "x" * 1100 + '\ndef f(a):\n    """Says\ndef g():\nthat {\n    """\n' + body + "def h():\n    return 1\n"
    (got,) = found(spark.createDataFrame([(1, "python", text)], SCHEMA).select("file", "language", "content")).values()
    assert got[1] == ["f"] and got[0].endswith("    # ... 24 lines of f elided\ndef h():\n    return 1\n")


def test_long_strings_and_texts(spark):
    """Neither a string of a million letters and escapes nor a text without a brace takes the stack
    or a second look at each letter."""
    text = "// x\nfn f(a: u32) {\n" + '    let s = "' + 'a\\"{' * 300_000 + '";\n' * 1 + "    y;\n" * 20 + "}\n" + "word " * 300_000
    (got,) = found(spark.createDataFrame([(1, "rust", text)], SCHEMA)).values()
    assert got[1] == ["f"] and len(got[0]) < len(text)


def test_edit_hits(spark):
    rows = [(i, "python", PY) for i in range(5)] + [(9, "rust", RS)]
    needles = [(0, "x3 = 3  # {"), (1, "x3"), (2, "import os"), (3, "x19 = 19  # {\n\n    def m1("), (4, "nowhere at all"), (9, 'let x2 = "}";')]
    got = {r.file: list(r.names) for r in R.edit_hits(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(needles, "file long, needle string")).collect()}
    assert got == {0: ["m0", "m1", "m2"], 3: ["m0"], 9: ["m0", "m1", "m2"]}
    text = {r[0]: r[2] for r in rows}
    for i, needle in needles:
        language = "rust" if i == 9 else "python"
        assert got.get(i, []) == plain.edit_hits(text[i], [needle], plain.outline(text[i], language).source_map)


@pytest.mark.parametrize("seed", [1])
def test_edit_warnings(spark, seed):
    rows = [r for r in sources(seed, 60) if '"""' not in r[2]]
    rng, edits = random.Random(seed), []
    for i, language, text in rows:
        o = plain.outline(text, language)
        lines = text.split("\n")
        after = rng.choice([text, "\n".join(o.lines) if o else text, text[: len(text) // 3], "\n".join(x for x in lines if "y = 'a'" not in x and "z" not in x)])
        edits.append((i, language, text, after))
    df = spark.createDataFrame(edits, "file long, language string, before string, after string")
    got = {r.file: r.warning for r in R.edit_warnings(df).collect()}
    assert got == {i: w for i, language, a, b in edits if (w := plain.elided_edit_warning(a, b, language))} and len(got) > 10
    none = spark.createDataFrame([(1, "python", None, "x"), (2, "python", "x", None)], "file long, language string, before string, after string")
    assert R.edit_warnings(none).count() == 0


def test_frames_look_back_and_texts_stay(spark):
    """A frame up to the end of its rows is summed anew for each of them: lines squared; files dealt by
    ``file`` meet their cuts where they lie."""
    files = spark.createDataFrame(sources(5, 20), SCHEMA).repartition(6, "file")
    plan = R.outlined(files)._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan and "REPARTITION_BY_NUM" in plan
    assert all("content" not in line for line in plan.split("\n") if "Exchange" in line)
    joined = plan.split("ShuffledHashJoin")[1]
    assert "ENSURE_REQUIREMENTS" not in joined[: joined.index("REPARTITION_BY_NUM")]


def test_calls_of_many_names(spark):
    """Names are looked for in one pass over the text after an edit, a dollar being a letter."""
    head = "// " + "x" * 1100 + "\n"
    names = ["f$a", "$b", "c"] + [f"n{i}" for i in range(30)]
    text = lambda n: head + "".join(f"function {x}(a) {{\n" + "    y();\n" * n + "}\n" for x in names)
    edits = [(1, "javascript", text(20), text(12)), (2, "javascript", text(20), text(20))]
    got = {r.file: r.warning for r in R.edit_warnings(spark.createDataFrame(edits, "file long, language string, before string, after string")).collect()}
    assert got == {1: plain.elided_edit_warning(*edits[0][2:], "javascript")} and "f$a" in got[1]


def test_masks_of_one_pass_equal_masks_by_tokens(spark):
    rng = random.Random(5)
    parts = ["'", '"', "\\", "/", "//", "#", "\n", "a", "{", "}", ";", " ", "''", "'x'", "'\\n'", "&'a str", "é", "\r", "`", "/*", "*/", '"""', "'''"]
    texts = ["".join(rng.choices(parts[: 19 if n % 4 else 23], k=rng.randint(0, 30))) for n in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    brace, python = R._masked(F.col("t"), R.BRACE_TOKENS, ("//", "/*"), ('"', "'", "`")), R._masked(F.col("t"), R.PYTHON_TOKENS, ("#",), ('"', "'"))
    plain = lambda odd: R._blanked(F.col("t"), R.BRACE_BLANKS, odd)[0]
    both = rows.select("t", R.brace_masked(F.col("t")).alias("b"), brace.alias("b2"), R.python_masked(F.col("t")).alias("p"), python.alias("p2"), plain(("/*", "`", "''")).alias("one"))
    got = both.collect()
    assert [r for r in got if r["b"] != r["b2"] or r["p"] != r["p2"]] == []
    assert sum(r["one"] for r in got) > 500


def test_bodies_are_looked_for_only_where_nothing_else_is_told(spark, monkeypatch):
    body = "".join(f"    x({i});\n" for i in range(20))
    whole = "int f(int a) {\n" + body + "}\n" + "// " + "y" * 1100 + "\n"
    rows = [(1, "java", whole, whole), (2, "java", whole, whole.replace(body, "    // ... 20 lines of f elided\n")), (3, "java", whole, "int f(int a) {\n}\n"), (4, "java", whole, whole.replace(body, "    x(1);\n")), (5, "java", None, whole), (6, "java", whole, None)]
    looked, plain = [], R.elided

    def elided(files, config):
        looked.append(sorted(r["file"] for r in files.select("file").collect()))
        return plain(files, config)

    monkeypatch.setattr(R, "elided", elided)
    got = {r["file"]: r["warning"] for r in R.edit_warnings(spark.createDataFrame(rows, "file long, language string, before string, after string")).collect()}
    assert got == {2: "the edit wrote an outline's mark into the file", 3: "the edit removed over half of the file", 4: "bodies became short: f"}
    assert looked == [[4], [4]]


def test_bodies_are_few_rows_and_are_not_masked(spark):
    """A function's lines in a row that are alike are one row, and only what opens a brace is masked."""
    body = "".join(f'    x = g("w{i}")  # {{\n' for i in range(200))
    text = "# " + "x" * 1100 + "\ndef f(\n    a,\n):\n" + body + "    if a:\n        y\n\nz = 1\n"
    files = spark.createDataFrame([(1, "python", text), (2, "rust", "fn f() {\n" + body + "}\n")], SCHEMA)
    rows = R.python_lines(files).collect()
    assert len(rows) < 12 and [r["k"] for r in rows if "g(" in (r["code"] or "")] == [5]
    assert [tuple(r) for r in R.python_bodies(R.python_lines(files), 15, R.Scratch(spark, "few")).collect()] == [(1, 5, 206, "f")]
    assert "regexp_replace(content" not in R.brace_bodies(files, 15)._jdf.queryExecution().optimizedPlan().toString()


def test_heads_are_counted_by_line(spark):
    texts = ["", "f1_2", "f1_2 f3_4\nf5_6(\n xf1_2 f1_2x\nf_1\n", "f1_2\r f1_2\n // ... 3 lines of f1_2 elided\nf7_8", "ff1_2\n a lines of b f1_2\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.head_lines(F.col("t")).alias("n")).collect()
    want = [sum(bool(re.search(r"\bf\d+_\d+\b", x)) and " lines of " not in x for x in t.split("\n")) for t in texts]
    assert [r["n"] for r in rows] == want
