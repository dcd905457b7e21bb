"""Text measures and the head-and-tail trim of long tool outputs. All are Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD, TAIL, MAX_TOKENS = 15, 15, 500
PREFIX = "[trajloom] "

# What stands in the place of the lines left out.
NOTICES = {
    "shell": "%d lines of a command that went well left out (kept: first %d, last %d), all of it under %s",
    "text": "%d lines left out (kept: first %d, last %d), all of it under %s",
    "entries": "%d entries left out (kept: first %d, last %d), the list under %s",
}


# What counts as white space around a text and between its words.
WHITE = " \t\n\x0b\x0c\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(x: Column, use) -> Column:
    """use(x), with x worked out once however often ``use`` names it; in a plain expression Spark may work it out at each place."""
    return F.transform(F.array(x), lambda v: use(v))[0]


def trim_white(text: Column) -> Column:
    """Without the white space at both ends; Spark's own trim takes blanks only."""
    return F.btrim(text, F.lit(WHITE))


def estimated_tokens(text: Column) -> Column:
    """A run of letters, digits and _ costs a token for each four bytes begun, any other code point one."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))
    in_runs = F.aggregate(F.transform(runs, lambda r: F.ceil(F.octet_length(r) / 4)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.length(F.regexp_replace(text, r"[\p{L}\p{Nd}_]+", "")) + in_runs


def lines(text: Column) -> Column:
    """One trailing newline isn't a line."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def trims(text: Column, tokens: Column | None = None, head: int = HEAD, tail: int = TAIL, threshold: int = MAX_TOKENS) -> Column:
    """Both gates: more than ``threshold`` tokens and more than head + tail lines."""
    return ((estimated_tokens(text) if tokens is None else tokens) > threshold) & (F.size(lines(text)) > head + tail)


def omitted_lines(text: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    return F.greatest(F.size(lines(text)) - head - tail, F.lit(0))


def _omitted(text: Column, head: int, tail: int) -> Column:
    return F.slice(lines(text), head + 1, omitted_lines(text, head, tail))


def omitted_bytes(text: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    """Bytes of the omitted lines joined by newlines."""
    return F.octet_length(F.array_join(_omitted(text, head, tail), "\n")).cast("bigint")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def content_id(text: Column) -> Column:
    """The name of a text in the archive: 16 bytes of its hash."""
    return F.substring(content_hash(text), 1, 32)


def notice(kind: str, omitted: Column, where: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    return F.format_string(NOTICES[kind], omitted, F.lit(head), F.lit(tail), where)


def trimmed(text: Column, kind: str = "shell", where: Column | None = None, prefix: str = PREFIX, head: int = HEAD, tail: int = TAIL) -> Column:
    """First and last lines with a notice between; for texts that ``trims`` holds for."""
    own = lines(text)
    said = F.concat(F.lit(prefix), notice(kind, omitted_lines(text, head, tail), content_id(text) if where is None else where, head, tail))
    end = F.when(text.endswith("\n"), "\n").otherwise("")
    return F.concat(F.array_join(F.slice(own, 1, head), "\n"), F.lit("\n"), said, F.lit("\n"), F.array_join(F.slice(own, -tail, tail), "\n"), end)


def trimmed_entries(entries: Column, **options) -> Column:
    """The same for a list of short entries, each a line; the notice becomes an entry."""
    text = F.array_join(entries, "\n")
    return F.when(trims(text), F.split(trimmed(text, "entries", **options), "\n")).otherwise(entries)


def project_slug(root: Column) -> Column:
    """A project's last path part in safe characters, at most 40, and 12 digits of the path's hash."""
    clean = F.when(F.length(root) > 1, F.regexp_replace(root, "/+$", "")).otherwise(root)
    base = F.regexp_replace(F.regexp_extract(clean, "[^/]*$", 0), "[^A-Za-z0-9_-]", "-")
    base = F.when(base == "", "-").otherwise(base)
    return F.concat(F.substring(base, 1, 40), F.lit("-"), F.substring(content_hash(clean), 1, 12))


def format_bytes(n: Column) -> Column:
    """1024 to a unit; one decimal, exact halves to even."""
    return _scaled(n.cast("double"), 1024.0, ["KiB", "MiB", "GiB", "TiB", "PiB", "EiB"], " ", F.concat(n.cast("bigint").cast("string"), F.lit(" B")))


def format_tokens(n: Column) -> Column:
    """1000 to a unit."""
    return _scaled(n.cast("double"), 1000.0, ["K", "M", "B", "T"], "", F.bround(n, 0).cast("bigint").cast("string"))


def _scaled(n: Column, unit: float, names: list[str], gap: str, small: Column) -> Column:
    out = None
    for k in range(len(names), 0, -1):
        shown = F.concat(F.format_string("%.1f", F.bround(n / unit**k, 1)), F.lit(gap + names[k - 1]))
        out = F.when(n >= unit**k, shown) if out is None else out.when(n >= unit**k, shown)
    return out.otherwise(small)
