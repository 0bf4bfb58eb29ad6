"""Outlines by a scanner of one text at a time: what the relational ones are held against."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ledgerspark.config import DEFAULT, LedgerConfig

BRACES = {"rust", "typescript", "javascript", "go", "java", "c", "cpp", "csharp", "kotlin", "swift", "php", "scala"}
DOCS = BRACES - {"rust", "go"}
CONTROL = re.compile(r"^(?:[}\s]|\belse\b)*\b(?:if|for|foreach|while|switch|catch|match|when|loop|do|try|using|lock|synchronized|return|guard|select|unsafe|with)\b")
TYPE = re.compile(r"^(?:[\w@\[\]()<>.,\"\s]*?\s)?(?:class|struct|enum|interface|trait|impl|namespace|mod|module|union|object|record|extension|protocol)\b(?![^{]*=>)")
CALLED = re.compile(r"([\w$~]+)\s*(?:<[^()]*>|\[[^\]()]*\])?\s*\(")
ASSIGNED = re.compile(r"(?:const|let|var|val)\s+([\w$]+)")
KEYWORDS = {"func", "fn", "fun", "function"}
PY_DEF = re.compile(r"^(\s*)(?:async\s+)?def\s+(\w+)")


@dataclass
class Outline:
    lines: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    #: (line of the outline, first and last line of the source, name or None, elided)
    source_map: list[tuple[int, int, int, str | None, bool]] = field(default_factory=list)

    def keep(self, text: str, line: int) -> None:
        self.lines.append(text)
        self.source_map.append((len(self.lines), line, line, None, False))

    def elide(self, mark: str, first: int, last: int, name: str | None) -> None:
        self.lines.append(mark)
        if name:
            self.names.append(name)
        self.source_map.append((len(self.lines), first, last, name, True))


def python_bodies(lines: list[str], least: int) -> list[tuple[int, int, str]]:
    """(first, last, name), 0-based, of bodies of ``least`` lines or more, outermost first."""
    out, i = [], 0
    while i < len(lines):
        m = PY_DEF.match(lines[i])
        if not m:
            i += 1
            continue
        depth, j = 0, i
        while j < len(lines):  # the signature goes on to a colon outside of brackets
            code = re.sub(r"\"[^\"]*\"|'[^']*'|#.*", "", lines[j])
            depth += sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}")
            if depth <= 0 and code.rstrip().endswith(":"):
                break
            if depth <= 0 and ":" in code and j == i:
                break
            j += 1
        indent, first, last, k = len(m[1].expandtabs()), j + 1, j, j + 1
        while k < len(lines):
            text = lines[k]
            if text.strip():
                if len(text.expandtabs()) - len(text.expandtabs().lstrip()) <= indent:
                    break
                last = k
            k += 1
        if last - first + 1 >= least:
            out.append((first, last, m[2]))
            i = last + 1
        else:
            i = j + 1
    return out


def brace_bodies(text: str, least: int, quotes: str = "\"'`") -> list[tuple[int, int, str]]:
    """As above, of functions in braces. One pass over the characters outside of strings and
    comments: what stands before a ``{`` since the last ``; { }`` is its header, whatever
    lines it takes, and says whether a function, a type or a control block opens."""
    line, header, stack, out, i, n = 0, "", [], [], 0, len(text)
    while i < n:
        c = text[i]
        if c == "\n":
            line += 1
            header += " "
        elif text.startswith("//", i) or (c == "#" and text[i - 1 : i] in ("", "\n")):
            end = text.find("\n", i)
            i = (n if end < 0 else end) - 1
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            line += text.count("\n", i, end)
            i = end - 1
        elif c in quotes:
            j = i + 1
            if c == "'" and not re.match(r"'(?:\\.[^']*|[^'\\])'", text[i : i + 12]):
                header += c  # a lifetime or an apostrophe
                i += 1
                continue
            while j < n and text[j] != c and (c == "`" or text[j] != "\n"):
                j += 2 if text[j] == "\\" else 1
            line += text.count("\n", i, j)
            header += '""'
            i = j
        elif c == "{":
            h = header.strip()
            name = None
            if "(" in h and not CONTROL.match(h) and not TYPE.match(h):
                m = ASSIGNED.search(h) if "=>" in h or "function" in h else None
                called = [x[1] for x in CALLED.finditer(re.sub(r"@\w+(?:\([^)]*\))?", "", h))]
                # what a keyword calls is a receiver, or a function without a name
                name = m[1] if m else next((x for x in called if x not in KEYWORDS), next(iter(called), None))
            stack.append((line, name))
            header = ""
        elif c == "}":
            if stack:
                begin, name = stack.pop()
                if name and line - begin - 1 >= least:
                    out = [x for x in out if x[0] <= begin]  # an outer body takes its inner ones along
                    out.append((begin + 1, line - 1, name))
            header = ""
        elif c == ";":
            header = "" if header.count("(") <= header.count(")") else header + c
        else:
            header += c
        i += 1
    return sorted(out)


def doc_blocks(lines: list[str], least: int = 6, summary: int = 2, tags: int = 6) -> dict[int, tuple[int, int]]:
    """Stretches of long doc comments to leave out, by first line: two summary lines and six
    tags stay, and at least two lines go."""
    out, i = {}, 0
    while i < len(lines):
        if not lines[i].strip().startswith("/**"):
            i += 1
            continue
        end = i
        while end < len(lines) and "*/" not in lines[end]:
            end += 1
        if end < len(lines) and end - i + 1 >= least:
            kept, tagged, run = 0, 0, None
            for k in range(i + 1, end + 1):
                body = lines[k].strip().lstrip("*").strip()
                stays = k == end
                if not stays and body.startswith("@"):
                    stays, tagged = tagged < tags, tagged + 1
                elif not stays and body:
                    stays, kept = kept < summary and not tagged, kept + 1
                if not stays:
                    run = k if run is None else run
                elif run is not None:
                    if k - run >= 2:
                        out[run] = (run, k - 1)
                    run = None
        i = end + 1
    return out


def outline(content: str, language: str, config: LedgerConfig = DEFAULT) -> Outline | None:
    """The outline, or None if the text is short, of no known language, or loses nothing."""
    if len(content.encode()) < config.compress_min_bytes or language not in BRACES | {"python"}:
        return None
    lines, least = content.split("\n"), max(4, config.min_body_lines)
    bodies = python_bodies(lines, least) if language == "python" else brace_bodies(content, least)
    docs = doc_blocks(lines) if language in DOCS else {}
    starts = {a: (b, name) for a, b, name in bodies}
    comment = "#" if language == "python" else "//"
    out, i = Outline(), 0
    while i < len(lines):
        if i in starts:
            last, name = starts[i]
            indent = re.match(r"\s*", lines[i])[0]
            out.elide(f"{indent}{comment} ... {last - i + 1} lines of {name} elided", i + 1, last + 1, name)
            i = last + 1
        elif i in docs:
            first, last = docs[i]
            out.elide(f" * ... {last - first + 1} lines elided", first + 1, last + 1, None)
            i = last + 1
        else:
            out.keep(lines[i], i + 1)
            i += 1
    small = (len("\n".join(out.lines).encode()) + 3) // 4 < (len(content.encode()) + 3) // 4
    return out if small and len(out.lines) < len(lines) else None


def edit_hits(content: str, needles: list[str], source_map: list[tuple]) -> list[str]:
    """Names of elided stretches that an edit of the given old texts would touch; needles of
    under four bytes are too common to tell."""
    touched = set()
    for needle in needles:
        if len(needle.encode()) < 4:
            continue
        at = content.find(needle)
        while at >= 0:
            first = content.count("\n", 0, at) + 1
            last = first + needle.count("\n", 0, len(needle) - 1)
            touched |= {name or "" for _, a, b, name, elided in source_map if elided and last >= a and first <= b}
            at = content.find(needle, at + 1)
    return sorted(touched)


def elided_edit_warning(before: str, after: str, language: str) -> str | None:
    """A hint if an edit left an outline's mark in the text, emptied a function, or cut the
    text by over half."""
    if re.search(r"(?:#|//) \.\.\. \d+ lines of \w+ elided", after):
        return "the edit wrote an outline's mark into the file"
    if len(before) > 200 and len(after) * 2 < len(before):
        return "the edit removed over half of the file"
    old, new = outline(before, language), outline(after, language)
    gone = set(old.names if old else ()) - set(new.names if new else ())
    kept = {n for n in gone if re.search(rf"\b{re.escape(n)}\s*\(", after)}
    return f"bodies became short: {', '.join(sorted(kept))}" if kept else None
