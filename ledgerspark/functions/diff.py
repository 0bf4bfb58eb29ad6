"""Line diffs: pure functions of strings, and columns over them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, LedgerConfig

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)")


def split_lines(text: str) -> list[str]:
    """Lines with their line feeds; only ``\\n`` ends one."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


#: Bits of rows that are kept for a way back; larger problems are halved. Cells (lines of one
#: text times lines of the other) beyond which texts are told as replaced.
KEPT_BITS, MOST_CELLS = 1 << 28, 1 << 36


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """Shortest edits: (op, index in a, index in b), op one of ``= - +``, in order; what a change
    removes comes before what it adds.

    Lines that the other text doesn't have are set aside first, as they can't be kept. What is
    left is a longest common subsequence of numbers, found in rows of bits: one row a line of
    ``b``, a bit a line of ``a``. Over MOST_CELLS what differs is told as replaced."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    both = set(x).intersection(y)
    at_x, at_y = [i for i, line in enumerate(x) if line in both], [j for j, line in enumerate(y) if line in both]
    number = {line: n for n, line in enumerate(both)}
    kept = common([number[x[i]] for i in at_x], [number[y[j]] for j in at_y])
    out = [("=", i, i) for i in range(head)]
    i = j = 0
    for p, q in [*((at_x[p], at_y[q]) for p, q in kept), (len(x), len(y))]:
        out += [("-", k + head, j + head) for k in range(i, p)] + [("+", p + head, k + head) for k in range(j, q)]
        i, j = p + 1, q + 1
        if p < len(x):
            out.append(("=", p + head, q + head))
    return out + [("=", len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def _rows(a: list[int], b: list[int], keep: list[int] | None = None) -> int:
    """The last row of the table of common lengths of ``a`` and ``b`` as bits: bit i is 0 where
    the length grows from i to i + 1 items of ``a``. ``keep`` gets all rows."""
    places: dict[int, int] = {}
    for i, n in enumerate(a):
        places[n] = places.get(n, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for n in b:
        here = row & places.get(n, 0)
        row = ((row + here) | (row - here)) & full
        if keep is not None:
            keep.append(row)
    return row


def _lengths(row: int, n: int) -> list[int]:
    """Common lengths of the first 0 to n items, of a row of bits."""
    out, total = [0], 0
    for c in reversed(f"{row:0{n}b}" if n else ""):
        total += c == "0"
        out.append(total)
    return out


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order. Rows of bits are kept for the way back
    as far as KEPT_BITS go; beyond that ``b`` is halved where the two halves' lengths add up
    best, so memory stays at a row's. Nothing is common where it would take over MOST_CELLS."""
    n, m = len(a), len(b)
    if not n or not m or n * m > MOST_CELLS:
        return []
    if n * m > KEPT_BITS and m > 1:
        half = m // 2
        upper, lower = _lengths(_rows(a, b[:half]), n), _lengths(_rows(a[::-1], b[half:][::-1]), n)[::-1]
        cut = max(range(n + 1), key=lambda i: upper[i] + lower[i])
        return common(a[:cut], b[:half]) + [(i + cut, j + half) for i, j in common(a[cut:], b[half:])]
    rows: list[int] = []
    _rows(a, b, rows)
    out, i, j = [], n, m
    width = (n + 7) // 8
    bits = rows[-1].to_bytes(width, "little")
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif bits[(i - 1) >> 3] >> ((i - 1) & 7) & 1:  # a's item adds nothing
            i -= 1
            continue
        else:
            j -= 1
        if j:
            bits = rows[j - 1].to_bytes(width, "little")
    return out[::-1]


def unified_diff(label: str, old: str, new: str, context: int = 3) -> str | None:
    """A unified diff, or None for equal texts."""
    if old == new:
        return None
    a, b = split_lines(old), split_lines(new)
    script = edit_script(a, b)
    changed = [n for n, (op, _, _) in enumerate(script) if op != "="]
    out = [f"--- {label} (last read)\n", f"+++ {label} (current)\n"]
    at = 0
    while at < len(changed):
        end = at
        while end + 1 < len(changed) and changed[end + 1] - changed[end] <= 2 * context + 1:
            end += 1
        part = script[max(0, changed[at] - context) : changed[end] + context + 1]
        olds, news = [i for op, i, _ in part if op != "+"], [j for op, _, j in part if op != "-"]
        side = lambda own, first: f"{(own[0] + 1) if own else first},{len(own)}" if len(own) != 1 else f"{own[0] + 1}"
        out.append(f"@@ -{side(olds, part[0][1])} +{side(news, part[0][2])} @@\n")
        for op, i, j in part:
            line = b[j] if op == "+" else a[i]
            out.append((" " if op == "=" else op) + line + ("" if line.endswith("\n") else "\n\\ No newline at end of file\n"))
        at = end + 1
    return "".join(out)


def apply_diff(old: str, diff: str | None) -> str:
    """The new text; what the property tests hold a diff against."""
    if not diff:
        return old
    a, out, at, rows = split_lines(old), [], 0, split_lines(diff)[2:]
    for n, row in enumerate(rows):
        bare = n + 1 < len(rows) and rows[n + 1].startswith("\\")
        if m := HUNK.match(row):
            begin = int(m[1]) - (0 if m[2] == "0" else 1)
            out += a[at:begin]
            at = begin
        elif row[0] == "\\":
            continue
        else:
            if row[0] in " -":
                at += 1
            if row[0] in " +":
                out.append(row[1:-1] if bare else row[1:])
    return "".join(out + a[at:])


def hunk_ranges(diff: str) -> list[tuple[int, int, str]]:
    """(first, last, symbol) of each run of added lines in the new text; a pure deletion is
    the line where it happened. The symbol is what follows the hunk's second ``@@``."""
    out, at, run, symbol, gone = [], 0, None, "", None
    for row in [*diff.split("\n"), "@@"]:
        if row.startswith("\\"):
            continue
        m = HUNK.match(row)
        if not row.startswith("+") or row.startswith("+++"):
            if run:
                out.append((run, at - 1, symbol))
            elif gone and not row.startswith("-"):
                out.append((gone, gone, symbol))
            if not row.startswith("-") or run:
                gone = None
            run = None
        if m:
            at, symbol, gone = max(1, int(m[3])), m[5].strip(), None
        elif row.startswith(("---", "+++")):
            continue
        elif row.startswith("+"):
            run = run or at
            at += 1
        elif row.startswith("-"):
            gone = gone or at
        elif row.startswith(" "):
            at += 1
    return out


NAMES = (
    re.compile(r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)"),
    re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|mod)\s+(\w+)"),
    re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|interface)\s+(\w+)"),
    re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\("),
    re.compile(r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)"),
    re.compile(r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|inline|async)\s+)+[\w<>\[\],.?\s]*?(\w+)\s*\("),
)


def enclosing_name(lines: list[str], line: int) -> str | None:
    """The nearest name defined on or above a 1-based line."""
    for text in reversed(lines[:line]):
        for pattern in NAMES:
            if m := pattern.match(text):
                return m[1]
    return None


def hunk_summary(diff: str, new: str, most: int = DEFAULT.toc_hunks) -> str:
    """Each hunk's lines and enclosing name, the first few."""
    lines = new.split("\n")
    parts = [f"{a}-{b}" + (f" {name}" if (name := enclosing_name(lines, a)) else "") for a, b, _ in hunk_ranges(diff)]
    more = f", +{len(parts) - most} more" if len(parts) > most else ""
    return ", ".join(parts[:most]) + more


# Rows go to Python a hundred at a time: batches of Arrow are cut by rows, and ten thousand pairs of
# texts with their diffs are more than an executor's workers may hold.
@F.udf(returnType=T.StringType(), useArrow=False)
def diff_of(label, old, new):
    return None if old is None or new is None else unified_diff(label or "", old, new)


@F.udf(returnType=T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("symbol", T.StringType())])), useArrow=False)
def ranges_of(diff):
    return hunk_ranges(diff) if diff else []


@F.udf(returnType=T.StringType(), useArrow=False)
def summary_of(diff, new):
    return hunk_summary(diff, new) if diff else ""


def complexity(diff: Column, new_lines: Column) -> Column:
    """``hunks, added, removed, changed_pct, span`` of a unified diff, without Python; lines
    that begin with ``---`` or ``+++`` are taken for headers."""
    rows = F.split(diff, "\n", -1)
    hunk_at = F.transform(F.filter(rows, lambda r: F.rlike(r, F.lit(r"^@@ -\d+(?:,\d+)? \+\d+"))), lambda r: F.regexp_extract(r, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int"))
    added = F.size(F.filter(rows, lambda r: F.startswith(r, F.lit("+")) & ~F.startswith(r, F.lit("+++"))))
    removed = F.size(F.filter(rows, lambda r: F.startswith(r, F.lit("-")) & ~F.startswith(r, F.lit("---"))))
    return F.struct(
        F.size(hunk_at).alias("hunks"), added.alias("added"), removed.alias("removed"),
        ((added + removed).cast("float") / F.greatest(new_lines, F.lit(1)).cast("float")).cast("float").alias("changed_pct"),
        F.coalesce(F.array_max(hunk_at) - F.array_min(hunk_at), F.lit(0)).alias("span"),
    )


def too_complex(c: Column, config: LedgerConfig = DEFAULT) -> Column:
    far = (c["hunks"] > config.span_hunks) & (c["span"] > config.max_span)
    return (c["hunks"] > config.max_hunks) | (c["changed_pct"] > F.lit(config.max_changed_pct).cast("float")) | far


def cut_lines(text: Column, most: int = DEFAULT.diff_trailer_lines) -> Column:
    rows = F.split(text, "\n", -1)
    over = F.size(rows) > most
    return F.when(over, F.concat(F.array_join(F.slice(rows, 1, most), "\n"), F.lit("\n... cut"))).otherwise(text)
