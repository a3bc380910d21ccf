"""Sequences as string columns.

Two alphabets, which must not be mixed: COMPONENTS keeps the 20 amino acids and X and reads every other letter as A;
GREEDY reads B as N, Z as E, and J, O, U as X. Nucleotides are A, C, G and T (U is T), all else is N.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The components alphabet in the order of its codes.
COMPONENTS = "ACDEFGHIKLMNPQRSTVWYX"
#: The greedy alphabet in the order of its codes.
GREEDY = "ARNDCQEGHILKMFPSTWYVX"


def letters(s: Column) -> Column:
    """Letters only, in upper case (stripped first, so that no letter becomes two)."""
    return F.upper(F.regexp_replace(s, "[^A-Za-z]", ""))


def trimmed_record(s: Column) -> Column:
    """A raw record without trailing white space and one trailing asterisk."""
    return F.regexp_replace(F.regexp_replace(s, r"[ \t\n\x0B\f\r]+$", ""), r"\*$", "")


def bad_characters(s: Column) -> Column:
    """How many characters of a raw record are neither letters nor white space; records with any are invalid."""
    return F.length(F.regexp_replace(trimmed_record(s), r"[A-Za-z \t\n\x0B\f\r]", "")).cast("long")


def formatted(s: Column) -> Column:
    """The record's sequence, or null if it is invalid."""
    return F.when(bad_characters(s) == 0, letters(trimmed_record(s)))


def trimmed(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def merged_pair(r1: Column, r2: Column) -> Column:
    """A paired record: the second read reversed, then the first."""
    return F.concat(F.reverse(r2), r1)


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTU", "TGCAA"))


def masked(s: Column, which: str) -> Column:
    """Letters that do not count for identity, as a mask sign."""
    return F.translate(s, which, "#" * len(which))


def components_alphabet(s: Column) -> Column:
    return F.translate(s, "BJOUZ", "AAAAA")


def greedy_alphabet(s: Column) -> Column:
    return F.translate(s, "BZJOU", "NEXXX")


def nucleotides(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, "U", "T"), "[^ACGT]", "N")


def normalized(s: Column) -> Column:
    """What every components query works on: letters, upper case, components alphabet."""
    return components_alphabet(letters(s))


def word_code(word: Column, alphabet: str = COMPONENTS) -> Column:
    """A word's code: digits to the alphabet's base, the first letter the most significant."""
    base = len(alphabet)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * base + F.call_function("locate", c, F.lit(alphabet)) - 1))


def identifier(header: Column, width: int = 20) -> Column:
    """A record's identifier: marker, at most one blank, and the header up to white space, cut to ``width`` characters (0: whole)."""
    found = F.regexp_extract(header, r"^([>@+]?[ \t]?\S*)", 1)
    return F.substring(found, 1, width) if width else found


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    """Multiset similarity from the shared count and the two sizes; 0 if there is nothing to share."""
    union = a + b - shared
    return F.when(union > 0, shared.cast("double") / union.cast("double")).otherwise(F.lit(0.0))
