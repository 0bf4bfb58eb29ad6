"""Scalar kernels as column expressions: they stay in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, LedgerConfig


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.call_function("div", F.octet_length(text) + 3, F.lit(4))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(*parts: Column) -> Column:
    """The first 8 bytes of the hash of the joined parts, in hex."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def line_count(text: Column) -> Column:
    """Lines as an editor counts them: a closing line feed begins no line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def percent_saved(full: Column, sent: Column) -> Column:
    """Whole per cent, halves away from zero; none if nothing was full, never negative."""
    share = F.round(F.greatest(full - sent, F.lit(0)).cast("double") / full * 100)
    return F.when(full > 0, share.cast("int")).otherwise(F.lit(0))


def dollars_saved(tokens: Column, config: LedgerConfig = DEFAULT) -> Column:
    return F.greatest(tokens, F.lit(0)).cast("double") / F.lit(1e6) * F.lit(config.price_per_mtok)


def co2_saved(tokens: Column, config: LedgerConfig = DEFAULT) -> Column:
    return F.greatest(tokens, F.lit(0)).cast("double") / F.lit(1e3) * F.lit(config.co2_g_per_ktok)


def storage_route(text: Column, limit: int = DEFAULT.inline_max_bytes) -> Column:
    """By bytes; a limit of -1 keeps everything inline."""
    return F.when((F.octet_length(text) <= limit) | F.lit(limit == -1), "inline").otherwise("file")


def file_kind(content: Column, config: LedgerConfig = DEFAULT) -> Column:
    """Of a binary column: size is tested before content."""
    head = F.substring(content, 1, config.binary_probe_bytes)
    binary = F.contains(head, F.lit(bytearray(b"\0"))) | ~F.is_valid_utf8(content)
    return F.when(F.octet_length(content) > config.text_max_bytes, "too_large").when(binary, "binary").otherwise("text")


def is_truncated(old_bytes: Column, new_bytes: Column) -> Column:
    return (old_bytes > 0) & (new_bytes * 2 < old_bytes)


def window(text: Column, start: Column, count: Column) -> Column:
    """``count`` lines from 1-based ``start`` on; a closing line feed stays one if the
    window has the last line or more lines follow."""
    lines = F.split(text, "\n", -1)
    n = line_count(text)
    body = F.array_join(F.slice(lines, start, F.greatest(F.least(count, n - start + 1), F.lit(0)).cast("int")), "\n")
    fed = F.endswith(text, F.lit("\n")) | (start + count - 1 < n)
    return F.when(start > n, F.lit("")).otherwise(F.concat(body, F.when(fed, F.lit("\n")).otherwise(F.lit(""))))


def line_bytes(text: Column) -> Column:
    """The bytes of each line without its line feed; the last is 0 if the text ends with one."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.octet_length(x))


def window_bytes(sizes: Column, start: Column, count: Column) -> Column:
    """The bytes of :func:`window`, from :func:`line_bytes` of the text."""
    bare = F.element_at(sizes, -1) > 0
    n = F.size(sizes) - F.when(bare, 0).otherwise(1)
    k = F.greatest(F.least(count, n - start + 1), F.lit(0)).cast("int")
    body = F.aggregate(F.slice(sizes, start, k), F.lit(0).cast("long"), lambda a, x: a + x) + F.greatest(k - 1, F.lit(0))
    fed = (~bare & (F.size(sizes) > 1)) | (start + count - 1 < n)
    return F.when(start > n, F.lit(0)).otherwise(body + F.when(fed, 1).otherwise(0))


def day_of(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


EXTENSIONS = {
    "python": ("py", "pyi"),
    "rust": ("rs",),
    "typescript": ("ts", "tsx"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "go": ("go",),
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"),
    "csharp": ("cs",),
    "kotlin": ("kt", "kts"),
    "swift": ("swift",),
    "php": ("php",),
    "scala": ("scala",),
}


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F
    for name, known in EXTENSIONS.items():
        out = out.when(extension.isin(*known), name)
    return out.otherwise("generic")


def git_branch(head: Column) -> Column:
    """Of HEAD's text: a branch, or the first 8 digits of a detached commit, or null."""
    t = F.trim(head)
    branch, commit = F.regexp_extract(t, r"^ref: refs/heads/(.+)$", 1), F.regexp_extract(t, r"^([0-9a-fA-F]{8})[0-9a-fA-F]*$", 1)
    return F.when(branch != "", branch).when(commit != "", commit)


def agent_label(agent: Column) -> Column:
    """Known names normalised; what looks like a UUID is hidden; an empty one is unknown."""
    a = F.lower(F.trim(agent))
    uuid = F.rlike(a, F.lit("^[0-9a-f-]{36}$"))
    return F.when(a.isNull() | (a == ""), "unknown").when(uuid, "anonymous").otherwise(a)


def session_key(env: Column, branch: Column, cwd: Column, worktree: Column) -> Column:
    """An id given by the environment, else a hash of place and branch, else of the place."""
    by_git = short_hash(F.lit("git:"), cwd, F.lit(":"), branch, F.lit(":"), F.coalesce(worktree, F.lit("")))
    return F.coalesce(F.when(env != "", env), F.when(branch.isNotNull() & (branch != ""), by_git), short_hash(F.lit("cwd:"), cwd))


def format_age(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0))
    ago = lambda unit, letter: F.concat(F.floor(s / unit).cast("string"), F.lit(letter))
    return F.when(s < 60, ago(1, "s")).when(s < 3600, ago(60, "m")).when(s < 86_400, ago(3600, "h")).otherwise(ago(86_400, "d"))


def format_duration(seconds: Column) -> Column:
    """The two largest units."""
    part = lambda whole, unit, a, b: F.concat(F.floor(seconds / whole).cast("string"), F.lit(a + " "), F.floor(seconds % whole / unit).cast("string"), F.lit(b))
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, part(60, 1, "m", "s"))
        .when(seconds < 86_400, part(3600, 60, "h", "m"))
        .otherwise(part(86_400, 3600, "d", "h"))
    )


def format_compact(n: Column) -> Column:
    tenths = lambda unit, letter: F.concat(F.format_string("%.1f", F.floor(n.cast("double") / (unit / 10)) / 10), F.lit(letter))
    return F.when(n >= 1_000_000, tenths(1e6, "M")).when(n >= 1000, tenths(1e3, "k")).otherwise(n.cast("string"))


def format_thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def format_bytes(n: Column) -> Column:
    part = lambda unit, name: F.concat(F.format_string("%.1f", F.floor(n.cast("double") / (unit / 10)) / 10), F.lit(name))
    return F.when(n >= 1 << 20, part(float(1 << 20), " MiB")).when(n >= 1024, part(1024.0, " KiB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def bar(share: Column, width: int = 20) -> Column:
    """A share of 0 to 1 as full and empty cells."""
    full = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def tail_label(text: Column, width: int) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.lit(".."), F.right(text, F.lit(width - 2))))


def head_label(text: Column, width: int) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.left(text, F.lit(width - 2)), F.lit("..")))


def line_argument(text: Column) -> Column:
    """``5`` or ``L5`` as a number, else null."""
    m = F.regexp_extract(text, r"^[Ll]?([0-9]{1,9})$", 1)
    return F.when(m != "", m.cast("int"))


def is_hash(text: Column) -> Column:
    return F.rlike(text, F.lit("^[0-9a-fA-F]{64}$"))


FALLBACKS = {
    "ignored": "path is ignored",
    "symlink": "symbolic link",
    "binary": "binary file",
    "huge_file": "file exceeds the hard cap",
    "large_file": "large file",
    "non_utf8": "not valid UTF-8",
    "truncated": "file shrank by more than half",
    "diff_bigger": "diff is larger than the file",
    "overhead": "reply is larger than the file",
    "too_complex": "diff is too complex",
    "external_change": "file changed externally",
}


def fallback_label(reason: Column) -> Column:
    out = F
    for name, text in FALLBACKS.items():
        out = out.when(reason == name, text)
    return out.otherwise(F.lit(None))


def utf8_cut(text: Column, limit: int, suffix: str = "") -> Column:
    """The longest beginning of whole characters within ``limit`` bytes, and a suffix if cut.

    The cut falls behind the last byte that doesn't belong to a character going on."""
    raw = F.encode(text, "UTF-8")
    cut = F.lit(limit)
    for back in range(1, 4):
        at = F.conv(F.hex(raw.substr(F.lit(limit + 2 - back), F.lit(1))), 16, 10).cast("int")
        cut = F.when((cut == limit + 1 - back) & at.between(128, 191), F.lit(limit - back)).otherwise(cut)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.decode(raw.substr(F.lit(1), cut), "UTF-8"), F.lit(suffix)))
