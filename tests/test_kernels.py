"""Text kernels: cases, brute force and properties."""

import random
import re
import subprocess
import sys

import plain_outline as O
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerspark.config import DEFAULT, normalize_changed_pct, parse_duration
from ledgerspark.functions import diff as D
from ledgerspark.functions import ignore as G
from ledgerspark.streaming import machine as M

texts = st.lists(st.sampled_from(["a", "b", "c", "", "-- x", "++"]), max_size=12).flatmap(lambda ls: st.sampled_from(["\n".join(ls), "\n".join(ls) + "\n"]))


@given(texts, texts)
@settings(max_examples=300, deadline=None)
def test_diff_applies(old, new):
    assert D.apply_diff(old, D.unified_diff("f", old, new)) == new


@given(texts, texts)
@settings(max_examples=200, deadline=None)
def test_diff_is_shortest(old, new):
    a, b = D.split_lines(old), D.split_lines(new)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    edits = sum(op != "=" for op, _, _ in D.edit_script(a, b))
    assert edits == len(a) + len(b) - 2 * best[-1][-1]


def test_diff_of_large_texts():
    """Two texts of 99 KB without a line in common, in bounded time and memory."""
    import time
    import tracemalloc

    old, new = ("".join(f"pub fn item_{i}() -> u32 {{ {k} * {i} + {i * 7 % 1000} }} // filler\n" for i in range(1850)) for k in "12")
    assert 95_000 < len(old) < 115_000
    began = time.perf_counter()
    d = D.unified_diff("f", old, new)
    assert time.perf_counter() - began < 10 and D.apply_diff(old, d) == new
    tracemalloc.start()
    D.unified_diff("f", old[:50_000], new[:50_000])
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_diff_format():
    d = D.unified_diff("f", "a\nb\nc\n", "a\nx\nc\n")
    assert d == "--- f (last read)\n+++ f (current)\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c\n"
    assert D.unified_diff("f", "a", "a") is None
    assert D.hunk_ranges(d) == [(2, 2, "")]
    assert D.hunk_ranges(D.unified_diff("f", "a\nb", "a\nc")) == [(2, 2, "")]
    assert D.hunk_ranges("@@ -1,2 +0,0 @@ fn x\n-a\n-b\n") == [(1, 1, "fn x")]


@given(st.lists(st.tuples(st.integers(-2, 30), st.integers(-2, 30)), max_size=12))
def test_ranges_merge(ranges):
    got = M.merge([list(r) for r in ranges])
    points = {p for a, b in ranges if 1 <= a <= b for p in range(a, b + 1)}
    assert {p for a, b in got for p in range(a, b + 1)} == points
    assert all(x[1] + 1 < y[0] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize(
    ("ranges", "want"),
    [([(1, 10), (5, 20)], [[1, 20]]), ([(1, 10), (11, 20)], [[1, 20]]), ([(50, 60), (10, 20)], [[10, 20], [50, 60]]), ([(0, 5), (10, 8), (1, 1), (5, 5)], [[1, 1], [5, 5]])],
)
def test_merge_cases(ranges, want):
    assert M.merge([list(r) for r in ranges]) == want


def test_covers():
    have = [[1, 50], [100, 200]]
    assert all(M.covers(have, *r) for r in ((1, 50), (100, 150), (5, 25)))
    assert not any(M.covers(have, *r) for r in ((49, 51), (200, 201), (0, 5), (10, 5)))
    assert not M.covers([], 1, 1)


def test_globs():
    fits = lambda g, p: re.fullmatch(G.glob_regex(g), p, re.S) is not None
    assert fits("*.png", "a/b/c.png") and fits("target/**", "target/x/y") and not fits("target/**", "a/target/x")
    assert fits("**/target/**", "a/target/x") and fits("**/x", "x") and fits("a?c", "abc") and fits("{a,b}.rs", "b.rs")
    assert fits("[a-c]x", "bx") and not fits("[!a-c]x", "bx")
    with pytest.raises(ValueError):
        G.glob_regex("[a")
    assert G.parse(["# c", "", "!x/", "[bad"]) == ([], [G.glob_regex("x/**")])


def test_durations():
    assert [parse_duration(x) for x in ("30d", "12h", "45m", "90s", "90")] == [2_592_000, 43_200, 2700, 90, 90]
    for bad in ("nope", "30y", ""):
        with pytest.raises(ValueError):
            parse_duration(bad)
    assert normalize_changed_pct(40) == normalize_changed_pct(0.4) == 0.4


PY = "import os\n\n\nclass A:\n" + "".join(f"    def m{k}(\n        self, a,\n    ):\n" + "".join(f"        x{i} = {i}  # {{\n" for i in range(20)) + "\n" for k in range(3)) + "END = 1\n"
RS = "use std::fmt;\n\nimpl A {\n" + "".join(f"    pub fn m{k}(&self, s: &'a str)\n        -> u32\n    {{\n" + "".join(f'        let x{i} = "}}"; // {{\n' for i in range(20)) + "    }\n" for k in range(3)) + "}\n"
TS = "export const f = async (a: number) => {\n" + "  if (a) { go() }\n" * 20 + "}\nclass B {\n  m(x: string): void {\n" + "    while (true) {\n      x()\n    }\n" * 8 + "  }\n}\n" + "// pad\n" * 60


@pytest.mark.parametrize(("text", "language", "names"), [(PY, "python", ["m0", "m1", "m2"]), (RS, "rust", ["m0", "m1", "m2"]), (TS, "typescript", ["f", "m"])])
def test_outline(text, language, names):
    o = O.outline(text, language)
    assert o.names == names
    lines = text.split("\n")
    shown = [x for x in o.source_map if not x[4]]
    assert all(o.lines[c - 1] == lines[a - 1] for c, a, _, _, _ in shown)
    assert [n for _, a, b, _, _ in o.source_map for n in range(a, b + 1)] == list(range(1, len(lines) + 1))
    kept = {x.strip() for x in o.lines}
    assert all(x.strip() in kept for x in lines if re.match(r"\s*(def|class|import|use|impl|pub fn|export|m\()", x))


BODY = "".join(f'    x{i} = g("}}"); // {{\n' for i in range(20))
HEADS = [
    ("go", "func (r *Ring) Push(a int, f func(int) int) (int, error) {\n", "Push"), ("go", "func Map[T any](xs []T) []T {\n", "Map"),
    ("java", "@Override\n@Named(\"x\")\npublic static <T> List<T> of(T a) throws E {\n", "of"), ("cpp", "template <typename T>\nint Ring<T>::push(const T& a) const\n{\n", "push"),
    ("csharp", "public async Task<int> Run(int a)\n{\n", "Run"), ("kotlin", "override suspend fun load(a: Int): Int {\n", "load"),
    ("rust", "pub fn walk<T>(a: &'a str, b: T) -> u32\nwhere\n    T: Copy,\n{\n", "walk"), ("typescript", "export async function go(a: number): Promise<void> {\n", "go"),
    ("javascript", "const later = function (a) {\n", "later"), ("swift", "public func draw(in r: Rect) throws -> Int {\n", "draw"),
]


@pytest.mark.parametrize(("language", "head", "name"), HEADS)
def test_outline_names(language, head, name):
    text = "// " + "x" * 1100 + "\n" + head + BODY + "}\n" + head.replace(name, "other") + BODY + "}\n"
    o = O.outline(text, language)
    assert o.names == [name, "other"]
    kept = set(o.lines)
    assert all(line in kept for line in head.split("\n"))


def test_outline_refuses():
    assert O.outline("def f():\n    pass\n", "python") is None
    assert O.outline(PY, "generic") is None


def test_doc_blocks():
    text = "/**\n * One.\n * Two.\n" + " * more\n" * 5 + " * @param a x\n */\nvoid f();\n"
    assert O.doc_blocks(text.split("\n")) == {3: (3, 7)}


def test_edit_guard():
    o = O.outline(PY, "python")
    assert O.edit_hits(PY, ["x3 = 3  # {"], o.source_map) == ["m0", "m1", "m2"]
    assert O.edit_hits(PY, ["x3"], o.source_map) == [] and O.edit_hits(PY, ["import os"], o.source_map) == []
    assert "mark" in O.elided_edit_warning(PY, "\n".join(o.lines), "python")
    assert O.elided_edit_warning(PY, PY, "python") is None


def test_import_needs_no_llm():
    code = "import sys; sys.modules['ledgerspark.llm'] = None; import ledgerspark.plans.registry as r; print(len(r.queries()) > 50)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert out.stdout.strip() == "True", out.stderr


def test_config_is_frozen():
    assert DEFAULT.ttl == 7200


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("kept", [1 << 28, 40])
def test_edit_scripts_are_shortest(monkeypatch, kept):
    """Of texts with many repeated lines, with all rows kept and in halves."""
    rng = random.Random(kept)
    monkeypatch.setattr(D, "KEPT_BITS", kept)
    for _ in range(600):
        a, b = ([rng.choice(letters) + "\n" for _ in range(rng.randint(0, 25))] for letters in ("abcde", "abcdx"))
        script = D.edit_script(a, b)
        assert sum(op == "=" for op, _, _ in script) == longest(a, b)
        assert [a[i] for op, i, _ in script if op != "+"] == a and [b[j] for op, _, j in script if op != "-"] == b
        assert D.apply_diff("".join(a), D.unified_diff("f", "".join(a), "".join(b))) == "".join(b)


@pytest.mark.parametrize("width", [78, 39, 19, 1])
def test_diffs_of_large_texts(width):
    """Two 99 KB texts over 400 lines in different orders: seconds, not minutes, and little memory."""
    import time
    import tracemalloc

    rng = random.Random(width)
    lines = ["".join(rng.choice("abcdef") for _ in range(width)) + "\n" for _ in range(400)]
    old, new = ("".join(rng.choice(lines) for _ in range(99 * 1024 // (width + 1))) for _ in range(2))
    began = time.perf_counter()
    found = D.unified_diff("f", old, new)
    took = time.perf_counter() - began
    assert D.apply_diff(old, found) == new and took < 10
    if width > 1:
        tracemalloc.start()
        D.unified_diff("f", old, new)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()


def test_texts_beyond_the_bound_are_replaced(monkeypatch):
    monkeypatch.setattr(D, "MOST_CELLS", 10)
    old, new = "a\nb\nc\nd\ne\n", "a\nc\nb\nd\nc\ne\n"
    found = D.unified_diff("f", old, new)
    assert D.apply_diff(old, found) == new and "-b\n-c\n-d\n+c\n+b\n+d\n+c\n" in found


def test_texts_go_to_python_a_few_at_a_time(spark):
    """Diffs aren't made of batches that are cut by thousands of rows, whatever a row's bytes."""
    from pyspark.sql import functions as F

    from ledgerspark.functions import diff as D

    rows = spark.range(10).select(F.lit("a\n").alias("old"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("new"))
    made = rows.select("new", D.diff_of(F.lit("f"), F.col("old"), F.col("new")).alias("diff")).withColumns({"r": D.ranges_of(F.col("diff")), "s": D.summary_of(F.col("diff"), F.col("new"))})
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" in plan
    assert {tuple(tuple(x) for x in r.r) for r in made.collect()} == {((1, 1, ""),)}
    none = rows.select(D.diff_of(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("new")).alias("d")).select("d", D.ranges_of(F.col("d")).alias("r"), D.summary_of(F.col("d"), F.col("d")).alias("s")).first()
    assert tuple(none) == (None, [], "")
