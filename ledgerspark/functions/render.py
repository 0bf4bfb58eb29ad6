"""Reply headers as columns. Their bytes count as tokens sent, so the templates are part of
what the accounting means; the tag is an option."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, LedgerConfig
from .scalars import fallback_label, format_age


def _line(config: LedgerConfig, *parts) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(F.lit(f"[{config.tag}: "), *[c.cast("string") for c in columns], F.lit("]\n"))


def unchanged(path: Column, tokens: Column, age: Column, config: LedgerConfig = DEFAULT) -> Column:
    return _line(config, "unchanged ", path, ", ", tokens, " tokens, last read ", format_age(age), " ago")


def window_unchanged(path: Column, first: Column, last: Column, config: LedgerConfig = DEFAULT) -> Column:
    return _line(config, "unchanged ", path, ", lines ", first, "-", last)


def header(kind: Column | str, path: Column, tokens: Column, config: LedgerConfig = DEFAULT) -> Column:
    """What stands before a text, a diff, or in place of a text (``first``, ``delta``,
    ``unchanged``), and is charged."""
    return _line(config, kind, " ", path, " ", tokens, " tokens")


def fallback(path: Column, reason: Column, config: LedgerConfig = DEFAULT) -> Column:
    """Stands before a text that is told in full; isn't charged."""
    return _line(config, "full ", path, ", ", fallback_label(reason))


def deleted(path: Column, config: LedgerConfig = DEFAULT) -> Column:
    return _line(config, "deleted ", path)


def registry(status: Column, config: LedgerConfig = DEFAULT) -> Column:
    return F.when(status == "unknown", F.lit("")).otherwise(_line(config, "file ", status, " since another session"))


def certificate(path: Column, before: Column, after: Column, ranges: Column, config: LedgerConfig = DEFAULT) -> Column:
    """What an edit changed: both hashes in short, and the touched lines (an array of
    ``first, last``)."""
    listed = F.array_join(F.transform(ranges, lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string"))), ", ")
    return F.concat(_line(config, "edit confirmed ", path), F.left(before, F.lit(12)), F.lit(" -> "), F.left(after, F.lit(12)), F.lit("\nlines "), listed, F.lit("\n"))


def session_segment(session_id: Column, reads: Column, saved: Column) -> Column:
    return F.concat(F.lit("session "), F.left(session_id, F.lit(8)), F.lit(", "), reads.cast("string"), F.lit(" reads, "), saved.cast("string"), F.lit(" tokens saved"))
