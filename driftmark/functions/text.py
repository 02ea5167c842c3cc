"""Column expressions for cleaning, keying, splitting and composing address-like text.

Empty strings stand for missing values: every function maps null to "".
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.functions import unicode
from driftmark.functions.unicode import let  # noqa: F401  used as T.let

#: House number, street, ward, district, province.
FIELDS = ("SoNha", "TenDuong", "PhuongXa", "QuanHuyen", "TinhThanh")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """The value, or "" for null."""
    return F.coalesce(col(c), F.lit(""))


def clean_value(c: Column | str) -> Column:
    """Trim Unicode white space, then trailing commas and spaces."""
    return F.regexp_replace(blank(c), r"(?U)^\s+|[, ]*+\s*+$", "")


def normalise_text(c: Column | str) -> Column:
    """Composed, case-folded, white space collapsed; accents and unit names stay."""
    folded = F.replace(F.translate(F.lower(composed(clean_value(c))), *_FOLDS), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def composition_table() -> str:
    """A NUL, a character, a mark and the one character that they compose to, for every script."""
    out = {}
    for whole in (chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000):
        parts = unicodedata.normalize("NFD", whole)
        if len(parts) > 1 and unicodedata.normalize("NFC", whole) == whole:
            for i in range(1, len(parts)):
                rest = unicodedata.normalize("NFC", parts[:i] + parts[i + 1 :])
                if len(rest) == 1 and unicodedata.category(parts[i])[0] == "M" and unicodedata.normalize("NFC", rest + parts[i]) == whole:
                    out[rest + parts[i]] = whole
    return "".join(f"\0{pair}{whole}" for pair, whole in sorted(out.items()))


_COMPOSED = composition_table()
#: Characters that folding changes after lower-casing, and what each becomes, where that is one character.
_FOLDS = tuple("".join(x) for x in zip(*((chr(c), chr(c).casefold()) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).lower() == chr(c) != chr(c).casefold() and len(chr(c).casefold()) == 1), strict=True))


def composed(c: Column | str) -> Column:
    """The text with characters and the marks on them composed, whatever the marks' order, in time linear in the text.

    It is the form for keys, in which an expression stands many times, so it stays small: marks that
    join no character keep their places. unicode.composed() is the full form (NFC).
    """
    text = blank(c)
    cluster = r"(?s)\P{M}\p{M}{1,30}"
    pair = lambda done, x: F.instr(F.lit(_COMPOSED), F.concat(F.lit("\0"), F.right(done, F.lit(1)), x))
    step = lambda done, x: F.when((done != "") & (pair(done, x) > 0), F.concat(F.left(done, F.length(done) - 1), F.substr(F.lit(_COMPOSED), pair(done, x) + 3, F.lit(1)))).otherwise(F.concat(done, x))
    hits = F.transform(F.regexp_extract_all(text, F.lit(cluster), F.lit(0)), lambda h: F.aggregate(F.split(h, ""), F.lit(""), step))
    whole = F.array_join(F.zip_with(F.split(text, cluster, -1), hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")
    return F.when(text.rlike(r"\P{M}\p{M}"), whole).otherwise(text)


def province_key(c: Column | str) -> Column:
    """Normalised text without one leading level word that white space follows."""
    return F.trim(F.regexp_replace(normalise_text(c), r"(?U)^(?:tỉnh|thành phố|tp\.?)\s+", ""))


#: Level words and their abbreviations, in the order in which they are tried.
LEVELS = ("thành phố", "tỉnh", "quận", "huyện", "thị xã", "phường", "xã", "thị trấn", r"tp\.?", r"q\.?", r"h\.?", r"tx\.?", r"p\.?", r"x\.?", r"tt\.?")


def comparable(c: Column | str, levels: tuple[str, ...] = LEVELS) -> Column:
    """Normalised text without one leading level word: what the scorer compares.

    ASCII words without anything between them only need folding.
    """
    slow = F.trim(F.regexp_replace(normalise_text(c), rf"(?U)^(?:{'|'.join(levels)})\s+", ""))
    return F.when(blank(c).rlike("[^A-Za-z0-9]"), slow).otherwise(F.lower(blank(c)))


def accent_table(extra: dict[str, str] | None = None) -> tuple[str, str]:
    """(accented, plain) letters of the Latin blocks whose decomposition starts with an ASCII letter, plus đ and Đ."""
    pairs = {"đ": "d", "Đ": "D"} | (extra or {})
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            pairs[chr(code)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


_ACCENTS = accent_table()


def strip_accents(c: Column | str) -> Column:
    """Letters without their marks, đ as d."""
    return F.regexp_replace(F.translate(blank(c), *_ACCENTS), r"\p{Mn}", "")


def fuzzy_key(c: Column | str) -> Column:
    """Lower case, everything but word characters as spaces, no accents, spaces collapsed."""
    words = F.regexp_replace(F.lower(blank(c)), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(strip_accents(words), r"(?U)\s+", " "))


def address_join(*parts: Column | str, sep: str = ", ") -> Column:
    """The non-empty parts, joined."""
    return F.array_join(F.filter(F.array(*[blank(p) for p in parts]), lambda x: x != ""), sep)


def address_split(c: Column | str, pattern: str = ",") -> Column:
    """Trimmed non-empty parts."""
    parts = F.transform(F.split(blank(c), pattern), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def part_from_end(parts: Column, k: int) -> Column:
    """The k-th part from the end, "" where there are fewer."""
    return F.coalesce(F.try_element_at(parts, F.lit(-k)), F.lit(""))


def split_house(c: Column | str) -> tuple[Column, Column]:
    """(house number, street) of a street line; no number leaves the line whole."""
    pattern = r"(?U)^(\d+[\w/\-]*)(?:[,\s]+)(.*)$"
    line = clean_value(c)
    found = line.rlike(pattern)
    return F.when(found, F.regexp_extract(line, pattern, 1)).otherwise(""), F.when(found, F.trim(F.regexp_extract(line, pattern, 2))).otherwise(line)


def house_key(c: Column | str) -> Column:
    """The leading house number of a fuzzy key, null if there is none."""
    found = F.regexp_extract(blank(c), r"(?U)^\d+[a-z]?(?:[/-]\d+[a-z]?)*\b", 0)
    return F.when(found != "", found)


def latin_class() -> str:
    """A character class of letters that Unicode names LATIN (basic plane), as ranges."""
    return unicode.char_class(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)).startswith("L") and "LATIN" in unicodedata.name(chr(c), ""))


def clean_tag(c: Column | str) -> Column:
    """A tag's value, trimmed of spaces and commas; "" if it holds ",," or a character beyond Latin letters, digits, marks and " /.,-()_"."""
    value = F.regexp_replace(composed(c), "^[ ,]+|[ ,]+$", "")
    fine = value.rlike(rf"^[{latin_class()}\p{{M}}0-9 /.,\-()_\t]+$") & ~value.contains(",,")
    return F.when(fine, value).otherwise("")


def lenient_bool(c: Column | str) -> Column:
    """true/1/yes, false/0/no, else null."""
    word = F.lower(clean_value(c))
    return F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)


def region_of(text: Column, regions: dict[str, list[str]], other: str) -> Column:
    """The first region, in the given order, of which a keyword occurs in the text."""
    low, out = F.lower(text), None
    for name, words in regions.items():
        hit = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other) if out is not None else F.lit(other)


def kind_before_colon(c: Column | str) -> Column:
    """The text before the first colon, "unknown" without one."""
    return F.when(blank(c).contains(":"), F.split_part(col(c), F.lit(":"), F.lit(1))).otherwise("unknown")


def point_fingerprint(lat: Column, lon: Column) -> Column:
    """node:lat,lon at seven decimals, "" without both."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("node:%.7f,%.7f", lat, lon)).otherwise("")


def way_fingerprint(refs: Column) -> Column:
    """way: and the SHA-256 of the comma-joined references, "" without any."""
    return F.when(F.size(refs) > 0, F.concat(F.lit("way:"), F.sha2(F.array_join(F.transform(refs, lambda r: r.cast("string")), ","), 256))).otherwise("")


def draw(seed: int | str, salt: str, *keys: Column) -> Column:
    """A uniform number in [0, 1) fixed by seed, salt and keys; the same in any partitioning and in SQL."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(seed: int | str, salt: str, choices: list[str], *keys: Column) -> Column:
    """One of the choices, by a draw."""
    at = F.floor(draw(seed, salt, *keys) * len(choices)).cast("int")
    return F.array(*[F.lit(c) for c in choices])[at]


def clean_lines(c: Column | str) -> Column:
    """Trimmed non-empty lines, each kept once in order, joined by commas."""
    return F.array_join(F.array_distinct(address_split(c, "\n")), ", ")


#: What precedes addresses on receipts (till and branch codes), and telephone numbers.
PHONE = r"(?U)(\+?84|0\d{2,3})[.\s/-]?\d{3,4}[.\s/-]?\d{3,5}(-\s*\d+)?"
TILLS = (
    r"(?iuU)^(V[MIHT41W][A-Z0-9\+\s/\-\.]*?(QNH|CNH|HNI|ONH|QHH|QBH|GNH|GLH|CHH)?\s+)",
    r"(?iuU)^(VM\+|VMM\+|VMT\+|VIM\+|V/H\+|V4\-|W4\+|VHH\+|V1A\+|V11\+|GNH|CS\d+:?)\s*",
    r"(?iuU)^(Vinh\s*\+\s*[A-Z0-9\+]+|Vth\s*[\+\-]\s*[A-Z0-9\+]+|Võ\s+[A-Z0-9\+]+\s+)",
)


def clean_receipt(c: Column | str, phone: str = PHONE, tills: tuple[str, ...] = TILLS) -> Column:
    """An address as scanned from a receipt: lines joined once each, numbers and codes dropped, quotes and edges trimmed."""
    out = F.regexp_replace(clean_lines(c), phone, "")
    for t in tills:
        out = F.regexp_replace(out, t, "")
    out = F.regexp_replace(F.regexp_replace(out, "[\"']", ""), r"(?U)^[,\-+.\s]+|[,\-+.\s]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)\s*,\s*", ", "), r"(?U)\s+", " "))


#: Endings of texts that were cut off, and marks of lists of branches.
CUT, LISTS = ("...", "..", " -"), ("CS1:", "CS2:")


def valid_text(c: Column, keywords: list[str], least: int = 12, cut: tuple[str, ...] = CUT, lists: tuple[str, ...] = LISTS) -> Column:
    """Long enough, not cut off, no list of branches, at least one keyword."""
    low = F.lower(c)
    ok = F.length(c) >= least
    for x in cut:
        ok &= ~c.endswith(x)
    for x in lists:
        ok &= ~c.contains(x)
    return ok & reduce(lambda a, b: a | b, [low.contains(k) for k in keywords])
