"""Text predicates of the profiler and markdown fences around JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Text patterns, tested in this order; each must start at the beginning of the text.
PATTERNS = [
    ("email", r"^[\w\.-]+@[\w\.-]+\.\w+$"),
    ("url", r"^https?://[\w\.-]+"),
    ("phone", r"^[\d\s\-\+\(\)]+$"),
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("ipv4", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
]

BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0")


def matches(c: Column, pattern: str) -> Column:
    """A match with letters and digits of any script."""
    return c.rlike("(?U)" + pattern)


def is_blank(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*$")


def is_boolean_text(c: Column) -> Column:
    return F.lower(c).isin(*BOOLEAN_WORDS)


def _reads_as(c: Column, pattern: str, layout: str) -> Column:
    return F.when(c.rlike(pattern), F.try_to_timestamp(c, F.lit(layout)).isNotNull()).otherwise(False)


def is_datetime_text(c: Column) -> Column:
    day, clock = r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}:\d{1,2}:\d{1,2}"
    return (
        _reads_as(c, f"^{day}$", "yyyy-M-d")
        | _reads_as(c, f"^{day}T{clock}$", "yyyy-M-d'T'H:m:s")
        | _reads_as(c, f"^{day}T{clock}Z$", "yyyy-M-d'T'H:m:s'Z'")
        | _reads_as(c, f"^{day} {clock}$", "yyyy-M-d H:m:s")
    )


def is_date_text(c: Column) -> Column:
    slashes = r"^\d{1,2}/\d{1,2}/\d{4}$"
    return (
        _reads_as(c, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d")
        | _reads_as(c, slashes, "d/M/yyyy")
        | _reads_as(c, slashes, "M/d/yyyy")
    )


def is_time_text(c: Column) -> Column:
    hour, minute = r"([01]?\d|2[0-3])", r"[0-5]?\d"
    return (
        c.rlike(f"^{hour}:{minute}(:[0-5]?\\d)?$")
        | c.rlike(f"(?i)^(0?[1-9]|1[0-2]):{minute} [ap]m$")
    )


# Fixed value: the characters that count as blank at the ends of a text.
_BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
           "\u200a\u2028\u2029\u202f\u205f\u3000")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a Column used several times is otherwise copied."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _trimmed(c: Column) -> Column:
    """Text without blanks at its ends; only texts that have some are cut, as that looks up every character."""
    def cut(t: Column) -> Column:
        blank = lambda end: F.contains(F.lit(_BLANKS), end)
        return F.when(blank(F.substring(t, 1, 1)) | blank(F.substring(t, -1, 1)), F.btrim(t, F.lit(_BLANKS))).otherwise(t)

    return bound(c, cut)


def strip_fence(c: Column) -> Column:
    """Text without a markdown code fence around it."""
    opened = lambda t: F.when(t.startswith("```json"), F.substr(t, F.lit(8))).when(
        t.startswith("```"), F.substr(t, F.lit(4))).otherwise(t)
    closed = lambda t: F.when(t.endswith("```"), F.substr(t, F.lit(1), F.length(t) - 3)).otherwise(t)
    return _trimmed(bound(bound(_trimmed(c), opened), closed))


def _reads_within(before: str, t: Column, after: str) -> Column:
    """Whether the text reads as part of a JSON object; its values are skipped, so repeated keys do not matter."""
    strict = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
    return F.from_json(F.concat(F.lit(before), t, F.lit(after)), "_bad string", strict)["_bad"].isNull()


def is_json(t: Column) -> Column:
    """Whether a text is one JSON value; objects may repeat a key (then the last one counts, as ``from_json`` reads it).

    VARIANT takes no repeated keys and does not look behind the first value, so a text is tried as a member of an object and as an
    element of a list: only one whole value is both.
    """
    return F.when(t.isNotNull(), _reads_within('{"v":', t, "}") & _reads_within('{"v":[', t, "]}"))


def _valid(c: Column) -> Column:
    """The text where it is one JSON value, else null."""
    return bound(c, lambda t: F.when(is_json(t), t))


def _fenced(c: Column) -> Column:
    """What stands between the first two code fences, without the word json in front."""
    return bound(F.split(c, "```", 3), lambda parts: F.when(
        F.size(parts) == 3, F.regexp_replace(F.get(parts, F.lit(1)), r"\Ajson", "")))


def _span(c: Column) -> Column:
    """From the first { to the last }, or from the first [ to the last ], whichever starts first."""
    def ends(t: Column, left: str, right: str) -> Column:
        end = F.length(t) - F.length(F.substring_index(t, right, -1))  # 0 where there is none
        return F.struct(F.instr(t, left).alias("start"), end.alias("end"))

    def cut(t: Column) -> Column:
        pairs = F.filter(F.array(ends(t, "{", "}"), ends(t, "[", "]")), lambda p: (p["start"] > 0) & (p["end"] > p["start"]))
        return bound(F.array_min(pairs), lambda p: F.substr(t, p["start"], p["end"] - p["start"] + 1))

    return bound(c, cut)


def json_in_text(c: Column) -> Column:
    """JSON text inside free text: a fenced block, else the whole text, else the first {...} or [...] span."""
    return F.coalesce(_valid(_fenced(c)), _valid(c), _valid(_span(c)))


def json_in_answer(c: Column) -> Column:
    """The same after removing a fence, trying the span before the whole text."""
    return bound(strip_fence(c), lambda body: F.coalesce(_valid(_span(body)), _valid(body)))


def md5_prefix(c: Column, length: int) -> Column:
    return F.substring(F.md5(c), 1, length)
