"""Python literals as JSON text, as expressions: linear, without a Python worker.

A literal is cut into its strings and what stands between them. Strings are written anew piece by
piece (escapes, quotes); between strings None, True and False, tuples, trailing commas, keys that are
numbers and the spellings of numbers are put into JSON's form. What is no literal comes out as text
that is no JSON or as null, so that reading it gives null.

Sets, bytes, complex and hexadecimal numbers, implicitly joined strings, raw strings and characters by
name are not read (null). A parenthesis around one value reads as a list of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r"'(?:[^'\\\n]|\\[\s\S])*+'|\"(?:[^\"\\\n]|\\[\s\S])*+\""
_TOKEN = rf"[uU]?(?:{_STRING})|(?:[^'\"uU]|[uU](?!['\"]))++"
_PIECE = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|[\s\S])|[^\\\"]++|\""
#: Escapes that JSON spells otherwise than Python.
_SAME = ("\\n", "\\t", "\\r", "\\b", "\\f", "\\\\", '\\"')
_OTHER = {"\\'": "'", "\\a": "\\u0007", "\\v": "\\u000b", "\\\n": "", '"': '\\"'}


def _escaped(code: Column) -> Column:
    """A code point as JSON escapes."""
    unit = lambda c: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(c), 4, "0")))
    high, low = 0xD800 + F.shiftright(code - 0x10000, 10), 0xDC00 + (code - 0x10000).bitwiseAND(F.lit(1023).cast("long"))
    return F.when(code > 0x10FFFF, F.lit(None)).when(code > 0xFFFF, F.concat(unit(high), unit(low))).otherwise(unit(code))


def _piece(p: Column) -> Column:
    hexadecimal = lambda start: F.conv(F.substr(p, F.lit(start)), 16, 10).cast("long")
    known = F.create_map(*[F.lit(x) for kv in _OTHER.items() for x in kv])
    out = F.when(~p.startswith("\\") & (p != '"'), p).when(p.isin(*_SAME), p).when(p.isin(*_OTHER), known[p])
    out = out.when(p.rlike(r"^\\u."), p).when(p.rlike(r"^\\[xU]."), _escaped(hexadecimal(3))).when(p.rlike(r"^\\[0-7]"), _escaped(F.conv(F.substr(p, F.lit(2)), 8, 10).cast("long")))
    # \x, \u and \U without their digits, and names, are errors; any other backslash stands for itself.
    return out.when(p.rlike(r"^\\[xuUN]"), F.lit(None)).otherwise(F.concat(F.lit("\\"), p))


def _string(t: Column) -> Column:
    body = F.regexp_replace(t, r"^[uU]?['\"]|['\"]$", "")
    slow = F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_PIECE), F.lit(0)), lambda p: F.coalesce(_piece(p), F.lit("\\!"))), "")  # \! is no JSON
    return F.concat(F.lit('"'), F.when(body.rlike(r"[\\\"]"), slow).otherwise(body), F.lit('"'))


def _between(t: Column) -> Column:
    fine = t.rlike(r"^(?:[\s\[\]{}(),:0-9+._eE-]|None|True|False)*$") & ~t.rlike(r"[\[{(,:]\s*,|[0-9.]\s+[0-9.]|:\s*[}\])]")
    out = t
    for pattern, by in (
        (r"\(", "["),
        (r"\)", "]"),
        (r",\s*([\]}])", "$1"),
        (r"([0-9])_(?=[0-9])", "$1"),
        (r"(?<![0-9.eE])\+(?=[0-9.])", ""),
        (r"(?<![0-9])\.([0-9])", "0.$1"),
        (r"([0-9])\.(?![0-9])", "$1.0"),
        (r"([{,]\s*)(-?[0-9][0-9.eE+-]*|None|True|False)(\s*:)", '$1"$2"$3'),
        (r"(?<!\")\bNone\b(?!\")", "null"),
        (r"(?<!\")\bTrue\b(?!\")", "true"),
        (r"(?<!\")\bFalse\b(?!\")", "false"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.when(fine, out).otherwise("!")


def as_json(c: Column | str) -> Column:
    """The JSON of a Python literal; null, or text that is no JSON, for anything else."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    whole = lambda ts: F.array_join(ts, "") == text
    spelled = lambda ts: F.array_join(F.transform(ts, lambda t: F.when(t.rlike(r"['\"]"), _string(t)).otherwise(_between(t))), "")
    return F.transform(F.array(tokens), lambda ts: F.when(whole(ts), spelled(ts)))[0]


def dictionary(c: Column | str) -> Column:
    """A map of a dictionary literal: text values as they are, None as null, other values as JSON. Null for anything else."""
    # In an array of one, so that nothing can follow it.
    read = F.from_json(F.concat(F.lit("["), as_json(c), F.lit("]")), "array<map<string,string>>", {"allowUnquotedControlChars": "true"})
    return F.transform(F.array(read), lambda a: F.when(F.size(a) == 1, a[0]))[0]


def value_of(c: Column | str, key: str) -> Column:
    """A dictionary literal's value of a key, the last one where the key is repeated; null for anything else."""
    entries = F.filter(F.map_entries(dictionary(c)), lambda e: e["key"] == key)
    return F.try_element_at(entries, F.lit(-1))["value"]
