"""Titles and symbols named in questions: verbatim, nearly, and by their tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW, _UP, _NUM = "a-z", "A-Z", "0-9"
_SNAKE = rf"_?[{_LOW}][{_LOW}{_NUM}]*(?:_[{_LOW}{_NUM}]+)+"
_CAPS = rf"[{_UP}][{_UP}{_NUM}]*(?:_[{_UP}{_NUM}]+)+"
#: ASCII word boundaries, spelled out as the engine's own are Unicode-aware.
_B0, _B1 = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
SYMBOL = f"{_B0}{_SNAKE}{_B1}|{_B0}{_CAPS}{_B1}"
#: Words too common to name a title, by length.
STOP = tuple("a i an as at be by do in is it my of on or to and are can for how the why does what when with what's where which".replace("'", "").split())
STOP_WORDS = tuple(sorted(set(STOP)))


def distinctive(title: Column) -> Column:
    """Titles that no prose would hold by chance: with a digit or two capitals."""
    return title.rlike("[0-9]") | (F.regexp_count(title, F.lit("[A-Z]")) >= 2)


def escape_regex(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def title_pattern(title: Column) -> Column:
    """A regular expression that finds the title between ASCII word boundaries, case aside if distinctive.

    At an edge that is no word character, a boundary asks for a word character next to it.
    """
    word = "[A-Za-z0-9_]"
    left = F.when(title.rlike(f"^{word}"), F.lit(f"(?<!{word})")).otherwise(F.lit(f"(?<={word})"))
    right = F.when(title.rlike(f"{word}$"), F.lit(f"(?!{word})")).otherwise(F.lit(f"(?={word})"))
    return F.concat(F.when(distinctive(title), F.lit("(?i)")).otherwise(F.lit("")), left, escape_regex(title), right)


def near_tokens(s: Column) -> Column:
    words = F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9_]+)"), F.lit(1))
    return F.filter(words, lambda t: ~t.isin(*STOP_WORDS))


def symbol_tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(f"({SYMBOL})"), F.lit(1))


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours."""

    def swapped(i: Column) -> Column:
        return F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b

    swap = (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), swapped)
    return (F.levenshtein(a, b, 1) >= 0) | swap


def covers(q: Column, t: Column) -> Column:
    """Whether a question's token stands for a title's: equal, a long prefix either way, or a typo of a long word."""
    nq, nt = F.length(q), F.length(t)
    prefix = (nq >= 4) & (nt >= 4) & (F.startswith(q, t) | F.startswith(t, q))
    typo = (nq >= 6) & (nt >= 6) & (F.abs(nq - nt) <= 1) & within_one_edit(q, t)
    return (q == t) | prefix | typo


def edit_distance(a: str, b: str) -> int:
    """Optimal string alignment of any distance, for use off the cluster."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + (x != y))
            row.append(d)
        two, one = one, row
    return one[-1]
