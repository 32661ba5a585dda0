"""The natural order of page names, in Python."""

from __future__ import annotations

from itertools import groupby

DIGITS = frozenset("0123456789")
#: What stands first in a part of a key: the end of a name comes before text, and text before numbers.
END, TEXT, NUMBER = range(3)


def natural_key(name: str) -> tuple:
    """Text runs by their case folding, digit runs by value and then by length, and the name itself at the end."""
    key: list[tuple] = []
    for numeric, run in groupby(name, DIGITS.__contains__):
        whole = "".join(run)
        key.append((NUMBER, int(whole), len(whole)) if numeric else (TEXT, whole.casefold()))
    return (*key, (END, name))
