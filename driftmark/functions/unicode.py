"""Unicode composition and case folding as expressions, linear in the text, for every script.

Tables come from Python's Unicode data by rule. A character is looked up by a hash table (that
of translate()) and an array. Only clusters, a character and what may join it, are taken apart; texts
without any stay as they are.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SURROGATES = range(0xD800, 0xE000)
_HANGUL = (0x1100, 0x1161, 0x11A7, 0xAC00)  # first lead, vowel, tail (none) and syllable
_NONE = "\uffff"
_FREE = 0xF0000  # a private plane, whose characters have no values


def char_class(chars) -> str:
    """The inside of a character class of a pattern, as ranges; characters stand for themselves, so that plans stay short."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    spelled = lambda c: chr(c) if c > 0xA0 else f"\\x{c:02x}"
    return "".join(spelled(a) if a == b else f"{spelled(a)}-{spelled(b)}" for a, b in ranges)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once and written once in the plan."""
    return F.transform(F.array(value), body)[0]


# What follows writes SQL, which is parsed in one go; put together call by call it would take a
# driver half a second each time. Names of lambda variables differ wherever they nest.


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _applied(text: Column, body: str) -> Column:
    """The SQL body, in which t is the text."""
    return F.call_function("transform", F.array(text), F.expr(f"t -> {body}"))[0]


def _looked_up(values: dict[str, str], char: str, name: str) -> str:
    """A character's value, null without one: by a hash table, that of translate(), to a number, and by that from an array."""
    number = all(v.isdigit() for v in values.values())  # a small number needs no array
    marks = "".join(chr(_FREE + (int(v) if number else i)) for i, v in enumerate(values.values()))
    found = f"ascii({name}) - {_FREE}"
    value = found if number else f"get(split({_quoted(_NONE.join(values.values()))}, {_quoted(_NONE)}), {found})"
    return _let(name, f"translate({char}, {_quoted(''.join(values))}, {_quoted(marks)})", f"if({name} <> {char}, {value}, null)")


def _chars(text: str, name: str) -> str:
    return f"filter(split({text}, ''), {name} -> {name} <> '')"


def _replaced(text: str, pattern: str, by: str) -> str:
    """The text with each match h of the pattern replaced."""
    hits = f"transform(regexp_extract_all({text}, {_quoted(pattern)}, 0), h -> {by})"
    return f"array_join(zip_with(split({text}, {_quoted(pattern)}, -1), {hits}, (g, r) -> concat(g, coalesce(r, ''))), '')"


@functools.cache
def _tables() -> dict:
    chars = [chr(c) for c in range(0x110000) if c not in _SURROGATES]
    order = {c: unicodedata.combining(c) for c in chars}
    marks = {c for c in chars if unicodedata.combining(unicodedata.normalize("NFD", c)[0])}
    changed = {c for c in chars if unicodedata.normalize("NFC", c) != c} - marks
    pairs: dict[str, str] = {}  # first character to (second, composed) one after another
    seconds = set()
    for c in chars:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            a, b = (chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", a + b) == c:
                pairs[a] = pairs.get(a, "") + b + c
                if b not in marks:
                    seconds.add(b)
    apart = {}
    for c in chars:
        d = unicodedata.normalize("NFD", c)
        if d != c and (c in changed or all(order[x] for x in d[1:])) and not 0xAC00 <= ord(c) < 0xD7A4:
            apart[c] = d
    return {"order": {c: str(n) for c, n in order.items() if n}, "marks": marks, "changed": changed, "pairs": pairs, "seconds": seconds, "apart": apart}


def _gaps(chars: set[str], least: int = 256) -> str:
    """The inside of a class of most characters that are not among the given ones: the long stretches between them.

    A class of many ranges is tried range by range for each character; this one is short.
    """
    points = [-1, *sorted(map(ord, chars)), 0x110000]
    spelled = lambda c: f"\\x{{{c:x}}}"
    return "".join(f"{spelled(a + 1)}-{spelled(b - 1)}" for a, b in zip(points, points[1:], strict=False) if b - a > least)


@functools.cache
def _composition() -> str:
    """The SQL of the composed form of t."""
    t = _tables()
    lead, vowel, final, syllable = _HANGUL
    seconds = {*t["seconds"], *map(chr, (*range(vowel, vowel + 21), *range(final + 1, final + 28)))}
    marks, changed, joins = char_class(t["marks"]), char_class(t["changed"]), char_class({*t["marks"], *seconds})
    clusters, pieces = f"(?s)[{changed}][{joins}]*+|[^{joins}]?[{joins}]++", f"(?s)[^{marks}][{marks}]*+|[{marks}]++"
    plain = _gaps({*t["marks"], *seconds, *t["changed"]})

    # A cluster taken apart, its marks put into their order: (o, i, c) of each character.
    chars = f"flatten(transform({_chars('p', 'z')}, k -> {_let('d', _looked_up(t['apart'], 'k', 'n1'), 'if(d is null, array(k), ' + _chars('d', 'w') + ')')}))"
    ranked = f"flatten(transform(regexp_extract_all(h, {_quoted(pieces)}, 0), p -> array_sort(transform({chars}, (c, i) -> named_struct('o', coalesce({_looked_up(t['order'], 'c', 'n2')}, 0), 'i', i, 'c', c)))))"

    # What the latest starter a.s and m.c make: by table, or as parts of a Hangul syllable.
    pair = _let("row", _looked_up(t["pairs"], "a.s", "n3"), _let("place", "instr(row, m.c)", "if(place > 0, substr(row, place + 1, 1), null)"))
    char = lambda code: f"decode(unhex(lpad(hex({code}), 4, '0')), 'UTF-16BE')"
    x, y = "ascii(a.s)", "ascii(m.c)"
    inside = lambda v, first, n: f"{v} between {first} and {first + n - 1}"
    lv = char(f"{syllable} + (({x} - {lead}) * 21 + {y} - {vowel}) * 28")
    lvt = char(f"{x} + {y} - {final}")
    hangul = f"case when {inside(x, lead, 19)} and {inside(y, vowel, 21)} then {lv} when {inside(x, syllable, 11172)} and ({x} - {syllable}) % 28 = 0 and {inside(y, final + 1, 27)} then {lvt} end"

    # s: the latest starter as composed so far, at its place in the cluster; last: the order of the last mark after it that
    # did not join; i: the place; changes: places whose character became another one or went into one.
    start = "named_struct('s', '', 'at', -1, 'last', 0, 'i', 0, 'changes', cast(array() as array<struct<at:int,c:string>>))"
    free = "a.at >= 0 and if(m.o > 0, a.last < m.o, a.last = 0)"
    changes = "if(n is not null, concat(filter(a.changes, v -> v.at <> a.at), array(named_struct('at', a.at, 'c', n), named_struct('at', a.i, 'c', ''))), a.changes)"
    fresh = "n is null and m.o = 0"
    after = f"named_struct('s', if({fresh}, m.c, coalesce(n, a.s)), 'at', if({fresh}, a.i, a.at), 'last', case when {fresh} then 0 when n is null then m.o else a.last end, 'i', a.i + 1, 'changes', {changes})"
    step = _let("n", f"if({free}, coalesce({pair}, {hangul}), null)", after)
    done = "array_join(transform(cs, (e, j) -> coalesce(try_element_at(filter(b.changes, v -> v.at = j), 1).c, e.c)), '')"
    cluster = _let("cs", ranked, f"aggregate(cs, {start}, (a, m) -> {step}, b -> {done})")
    return f"if(t rlike {_quoted(f'[^{plain}]')}, {_replaced('t', clusters, cluster)}, t)"


def composed(text: Column) -> Column:
    """The text in composed form (NFC). It must not be null."""
    return _applied(text, _composition())


@functools.cache
def _folding() -> str:
    """The SQL of t, already in lower case, with the rest of its case distinctions removed."""
    fixes = {chr(c): chr(c).casefold() for c in range(0x110000) if c not in _SURROGATES and chr(c).lower() == chr(c) and chr(c).casefold() != chr(c)}
    one = {a: b for a, b in fixes.items() if len(b) == 1}
    more = {a: b for a, b in fixes.items() if len(b) > 1}
    several = f"[{char_class(more)}]"
    plain = f"translate(t, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    full = f"if(u rlike {_quoted(f'[^{_gaps(set(more), 64)}]')}, {_replaced('u', several, _looked_up(more, 'h', 'n1'))}, u)"
    return f"if(t rlike '[^\\\\x00-\\\\x7f]', {_let('u', plain, full)}, t)"


def casefolded(text: Column) -> Column:
    """The text with all case distinctions removed (full case folding). It must not be null."""
    return _applied(F.lower(text), _folding())
