"""Text rules as column expressions, the same on every engine that follows Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends of a text, longest first.
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
CONTROL = r"/\*|\*/|/#|#/"


#: Every character that is white space, and the four separators below it.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text without their ends; a final end opens no further line, and an empty text has none."""
    ended = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(bound(F.split(text, LINE_END), ended))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def nonblank(parts: Column) -> Column:
    return F.filter(parts, lambda x: strip(x) != "")


def middle(values: Column) -> Column:
    """Median of an array of numbers, as a double; null when empty."""
    n = F.size(values)
    at = lambda s, k: F.get(s, F.floor(k).cast("int")).cast("double")
    return F.when(n > 0, bound(F.array_sort(values), lambda s: (at(s, (F.size(s) - 1) / 2) + at(s, F.size(s) / 2)) / 2))


def deviation(values: Column) -> Column:
    """Median absolute deviation of an array of numbers."""
    return bound(middle(values), lambda m: middle(F.transform(values, lambda x: F.abs(x.cast("double") - m))))


#: Letters whose case folding is not the lower case of their upper case: dotless i, and small Cherokee letters.
_KEPT, _MARK = "\u0131", "\ue000"
_CHEROKEE = "".join(map(chr, range(0xAB70, 0xABC0))) + "".join(map(chr, range(0x13F8, 0x13FE))), "".join(map(chr, range(0x13A0, 0x13F0))) + "".join(map(chr, range(0x13F0, 0x13F6)))


def case_folded(text: Column) -> Column:
    """The full Unicode case folding of a text: lower case of the upper case, and where that differs, what the folding gives."""
    # the optimizer takes a change of case right upon another to be the outer one alone, so they are kept apart
    apart = lambda c: F.translate(c, _KEPT, _MARK)
    cased = F.lower(apart(F.upper(apart(F.lower(apart(text))))))
    return F.translate(cased, "\u03c2" + _MARK + _CHEROKEE[0], "\u03c3" + _KEPT + _CHEROKEE[1])


def natural_key(name: Column) -> Column:
    """An orderable key: digit runs by number (digits without leading zeros, by count and then as text), then by length; other runs
    by their case folding; the name itself last. Numbers of any length have their place."""
    part = lambda k, n, v, w, t: F.struct(F.lit(k).alias("k"), n.cast("int").alias("n"), v.alias("v"), w.cast("int").alias("w"), t.alias("t"))
    zero, none = F.lit(0), F.lit("")
    bare = lambda r: F.regexp_replace(r, "^0+", "")
    runs = F.transform(
        F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1)),
        lambda r: F.when(r.rlike("^[0-9]"), part(2, F.length(bare(r)), bare(r), F.length(r), none)).otherwise(part(1, zero, none, zero, case_folded(r))),
    )
    return F.concat(runs, F.array(part(0, zero, none, zero, name)))


def tag_count(text: Column, tag: str) -> Column:
    """Opening tags of one kind, any case, with attributes or self-closing."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?iu)<{tag}(?:\s+[^>]*)?/?>"), F.lit(0)))


def is_recto(name: Column) -> Column:
    """Odd last number in a name; a name without one counts as recto."""
    digit = F.regexp_extract(name, r"([0-9])[^0-9]*$", 1)
    return (digit == "") | (F.try_to_number(digit, F.lit("9")) % 2 == 1)


def code_point(character: Column) -> Column:
    return F.format_string("U+%04X", F.ascii(character))


def letters_only(word: Column) -> Column:
    """Lower-case letters and digits of a word."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at index floor(share * (n - 1) + 1/2) of the sorted array."""
    return F.get(F.array_sort(values), F.floor(F.lit(share) * (F.size(values) - 1) + F.lit(0.5)).cast("int"))
