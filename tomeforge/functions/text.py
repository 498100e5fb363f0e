"""Text functions of the engine, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"

# Secret shapes, each a prefix and a token.
SECRET_SHAPES = (
    "AKIA[0-9A-Z]{16}", "ghp_[0-9A-Za-z_]{36}", "github_pat_[0-9A-Za-z_]{22}", "xoxb-[0-9A-Za-z-]{10}",
    "xoxp-[0-9A-Za-z-]{10}", "AIza[0-9A-Za-z_-]{35}",
)
PEM = r"(?s)-----BEGIN(?:(?!-----END).)*PRIVATE KEY-----(?:(?!-----END).)*-----END[^\n]*?-----"


def folded(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), ACCENTED, FOLDED)


def tokens(text: Column) -> Column:
    """Index terms: folded, cut at everything but letters and digits."""
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def has_secret(text: Column) -> Column:
    pem = F.contains(text, F.lit("-----BEGIN")) & F.contains(text, F.lit("PRIVATE KEY-----"))
    return text.rlike("|".join(SECRET_SHAPES)) | pem


def redacted(text: Column) -> Column:
    """Secret shapes replaced by a marker. Whole PEM blocks go, closing dashes included."""
    for shape in (*SECRET_SHAPES, PEM):
        text = F.regexp_replace(text, shape, "[REDACTED]")
    return text


def excerpt(text: Column, terms: list[str], around: int = 120) -> Column:
    """Text around the first term, in query order, that occurs; else the first 2 * around characters."""
    low = F.lower(text)
    at = F.coalesce(*[F.when(F.locate(t.lower(), low) > 0, F.locate(t.lower(), low) - 1) for t in terms], F.lit(-1))
    term = F.coalesce(*[F.when(F.locate(t.lower(), low) > 0, F.lit(len(t))) for t in terms], F.lit(0))
    start, end = F.greatest(at - around, F.lit(0)), F.least(at + term + around, F.length(text))
    body = F.translate(F.substring(text, start + 1, end - start), "\n", " ")
    found = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at < 0, F.substring(text, 1, 2 * around)).otherwise(found)


def bounded(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def base64url(text: Column) -> Column:
    """Base64 for addresses, without padding and without the line ends that long values may get."""
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def pr_hints(message: Column, most: int = 5) -> Column:
    """Numbers after # at the start, or after a bracket, space or tab; distinct, zero left out."""
    found = F.regexp_extract_all(message, F.lit(r"(?:^|[( \t])#(\d{1,9})(?!\d)"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("int")), lambda n: n > 0)), 1, most)


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "-")


def remote_name(url: Column) -> Column:
    """A remote address without credentials, scheme and trailing .git."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[a-z+]+://", ""), "^[^@/]*@", "")
    return F.regexp_replace(F.regexp_replace(bare, "/+$", ""), r"(?:\.git)+$", "")


def duration(ms: Column) -> Column:
    """Seconds with one decimal under a minute, else minutes and whole seconds; of whole milliseconds.

    The decimal is that of the double nearest to the seconds, rounded as its exact value is: where that stands on a
    tie, to the even tenth. A tie of milliseconds is one of the double only if no bits were lost on the way there.
    """
    seconds = ms.cast("double") / 1000
    minutes = F.floor(seconds / 60)
    long = F.format_string("%dm %02ds", minutes, F.floor(seconds - minutes * 60))
    # the double as a whole number of 2^-57, which under a minute fits a long, and from 50 ms on is exact
    exact = F.least(seconds, F.lit(60.0)) * float(1 << 57)
    lost = exact.cast("long").cast("decimal(38,0)") * 1000 - ms.cast("decimal(38,0)") * F.lit(1 << 57).cast("decimal(20,0)")
    tenths, rest = F.floor(ms / 100), F.pmod(ms, F.lit(100))
    up = F.when(rest != 50, rest > 50).when(lost != 0, lost > 0).otherwise(tenths % 2 == 1)
    tenths = tenths + up.cast("int")
    return F.when(seconds < 60, F.format_string("%d.%ds", F.floor(tenths / 10), tenths % 10)).otherwise(long)


def utc(ms: Column) -> Column:
    """Epoch milliseconds as RFC 3339, whatever the session's time zone."""
    none = F.lit(0)
    since = F.make_dt_interval(none, none, none, (ms.cast("decimal(18,0)") / 1000).cast("decimal(18,6)"))
    return F.date_format(F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + since, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def title(heading: Column, path: Column) -> Column:
    return F.when(heading != "", heading).otherwise(F.substring_index(path, "/", -1))


def permalink(base: Column, path: Column, first: Column, last: Column) -> Column:
    """A link for a pinned revision; null for any other base."""
    return F.when(base.rlike("^git:[0-9a-fA-F]{40}$"), F.format_string("%s/%s#L%d-L%d", base, path, first, last))


def glob_regex(pattern: str) -> str:
    """A filter's glob: * and ? cross separators, classes stand in brackets, case counts."""
    out, i = "", 0
    while i < len(pattern):
        end = pattern.find("]", i + 2) if pattern[i] == "[" else -1
        if end > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", r"\\").replace("[", r"\[") + "]"
            i = end + 1
        else:
            out += {"*": ".*", "?": "."}.get(pattern[i], re.escape(pattern[i]))
            i += 1
    return f"(?s)^{out}$"
