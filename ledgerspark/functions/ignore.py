"""Ignore patterns: globs compiled once, on the driver, to regular expressions that run in
the scan's stage.

A glob must fit the whole path; ``*`` crosses ``/``, ``?`` is any one character, ``[...]``
a class, ``{a,b}`` alternatives; ``!`` in front allows, a closing ``/`` means all below.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import basename

#: What is ignored unless allowed: the engine's own choice of names that tools are known by.
DEFAULTS = (
    # version control
    ".git/**", "**/.git/**", ".hg/**", "**/.hg/**", ".svn/**", "**/.svn/**",
    # dependencies
    "node_modules/**", "**/node_modules/**", "vendor/**", "**/vendor/**", ".venv/**", "**/.venv/**", "venv/**", "**/venv/**", "bower_components/**",
    # build results
    "target/**", "**/target/**", "dist/**", "**/dist/**", "build/**", "**/build/**", "out/**", "**/__pycache__/**", "__pycache__/**", "*.pyc", "*.pyo", "*.class", "*.o", "*.obj",
    ".next/**", ".nuxt/**", ".cache/**", "coverage/**", ".gradle/**", ".tox/**",
    # lock files
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "uv.lock", "bun.lockb",
    # binaries and media
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.webp", "*.ico", "*.bmp", "*.pdf", "*.zip", "*.tar", "*.gz", "*.bz2", "*.xz", "*.7z", "*.rar", "*.exe", "*.dll", "*.so", "*.dylib",
    "*.bin", "*.jar", "*.war", "*.wasm", "*.mp3", "*.mp4", "*.mov", "*.avi", "*.woff", "*.woff2", "*.ttf", "*.otf", "*.eot", "*.db", "*.sqlite", "*.parquet",
    # secrets
    ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.crt", "*.cer", "*.jks", "*.keystore", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
    ".netrc", ".npmrc", ".pypirc", ".ssh/**", "**/.ssh/**", ".aws/**", "**/.aws/**", ".gcp/**", "**/.gcp/**", ".azure/**", "**/.azure/**", ".kube/**", "**/.kube/**", "kubeconfig", "credentials.json",
    # others
    ".DS_Store", "Thumbs.db", "*.min.map",
)
#: Searches leave out these instead.
SEARCH_EXCLUDES = (
    ".git/**", "node_modules/**", "target/**", "dist/**", "build/**", ".venv/**", "venv/**", "__pycache__/**", ".next/**", "coverage/**",
    "*.lock", "*.min.js", "*.min.css", "*.map", "*.png", "*.jpg", "*.pdf", "*.zip", "*.pyc", "package-lock.json",
)


def glob_regex(glob: str) -> str:
    """The expression a glob stands for; ValueError if it is malformed."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            if i - 2 >= 0 and glob[max(0, i - 2) : i] == "**" and glob[i : i + 1] == "/" and (i == 2 or glob[i - 3] == "/"):
                out += "(?:.*/)?"
                i += 1
            else:
                out += ".*"
            continue
        if c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class: {glob!r}")
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed braces: {glob!r}")
    return out


def parse(lines) -> tuple[list[str], list[str]]:
    """(deny, allow) expressions of pattern lines; comments and malformed lines are skipped."""
    deny, allow = [], []
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        to = deny
        if line.startswith("!"):
            line, to = line[1:], allow
        if line.endswith("/"):
            line += "**"
        try:
            to.append(glob_regex(line))
        except ValueError:
            continue
    return deny, allow


def _fits(path: Column, expressions: list[str]) -> Column:
    if not expressions:
        return F.lit(False)
    whole = F.lit("(?s)^(?:" + "|".join(expressions) + ")$")
    bare = F.regexp_replace(path, r"^(\./)+", "")
    return F.rlike(path, whole) | F.rlike(basename(path), whole) | F.rlike(bare, whole)


def is_ignored(path: Column, extra=(), defaults=DEFAULTS) -> Column:
    """Denied and not allowed: by the path, its last part, or without a leading ``./``."""
    deny, allow = parse([*defaults, *extra])
    return _fits(path, deny) & ~_fits(path, allow)


def glob_match(path: Column, glob: str) -> Column:
    return F.rlike(path, F.lit(f"(?s)^(?:{glob_regex(glob)})$"))
