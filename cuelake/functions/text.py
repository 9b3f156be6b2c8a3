"""Caption text: normal forms, tokens, similarity, readability and line breaks.

Column expressions, but for Unicode normal forms, which no built-in function gives. Lengths in the caption rules are UTF-16 units, those
in the scores are code points.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as captions' authors mean it, whatever the engine's own class is.
SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
CJK = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]"

#: Words after which a line should not break.
WEAK_ENDS = (
    "a an the to of in on at by for from with about as into over after before under between and but or so because if that which who "
    "is are was were be been being am do does did have has had will would can could should may might must i you he she it we they"
).split()


def collapse(text: Column) -> Column:
    """All white space runs one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalise_lines(text: Column) -> Column:
    """Line breaks as \\n, each line collapsed, empty lines dropped."""
    lines = F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n", -1)
    return F.array_join(F.filter(F.transform(lines, collapse), lambda x: x != ""), "\n")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def readable_length(text: Column) -> Column:
    """UTF-16 units of the collapsed text, blanks included."""
    return utf16_length(collapse(text))


def comparable(text: Column) -> Column:
    """For finding duplicates: lower case, letters and digits only, collapsed. No compatibility forms; marks are dropped."""
    return collapse(F.regexp_replace(F.lower(collapse(text)), "[^\\p{L}\\p{N}\\s]", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " ", -1), lambda x: x != "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; there is no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def scored(text: Column, lowercase: bool = True, punctuation: bool = True, unicode_form: bool = True) -> Column:
    """The scorer's normal form: compatibility form, lower case, punctuation and symbols blanks, collapsed. Each is an option."""
    t = nfkc(text) if unicode_form else text
    t = F.lower(t) if lowercase else t
    return collapse(F.regexp_replace(t, "[\\p{P}\\p{S}]+", " ") if punctuation else t)


def characters(text: Column, blanks: bool = False) -> Column:
    """Code points, without white space unless ``blanks``."""
    t = text if blanks else F.regexp_replace(text, f"{SPACE}+", "")
    return F.filter(F.split(t, "", -1), lambda x: x != "")


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    own = lambda x, t: F.size(F.filter(x, lambda y: y == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, t: acc + F.least(own(a, t), own(b, t)))


def token_similarity(a: Column, b: Column) -> Column:
    """Common tokens by the longer array's size; 1 for two empty ones, 0 for one."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).when(F.least(F.size(a), F.size(b)) == 0, 0.0).otherwise(common_tokens(a, b) / most)


def dice(a: Column, b: Column) -> Column:
    """Twice the common tokens by both sizes; 1 for two empty arrays, 0 for one."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).when(F.least(F.size(a), F.size(b)) == 0, 0.0).otherwise(F.lit(2.0) * common_tokens(a, b) / total)


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays: one fold over ``a`` that carries a row of the table."""
    first = F.sequence(F.lit(0), F.size(b))

    def row(prev: Column, x: Column) -> Column:
        start = F.array(prev[0] + 1)
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            start,
            lambda out, j: F.concat(
                out, F.array(F.least(F.element_at(out, -1) + 1, prev[j] + 1, prev[j - 1] + F.when(x == b[j - 1], 0).otherwise(1)))
            ),
        )

    folded = F.aggregate(a, first, row, lambda r: F.element_at(r, -1))
    return F.when(F.size(a) == 0, F.size(b)).when(F.size(b) == 0, F.size(a)).otherwise(folded)


def strong_end(word: Column) -> Column:
    return word.rlike("[.!?][\"')\\]]?$")


def soft_end(word: Column) -> Column:
    return word.rlike("[,;:\\u2013\\u2014][\"')\\]]?$")


def bare_word(word: Column) -> Column:
    """Lower case without anything but letters, digits and apostrophes at its ends."""
    return F.regexp_replace(F.lower(word), "^[^a-z0-9']+|[^a-z0-9']+$", "")


def break_penalty(before: Column, after: Column) -> Column:
    """How bad a line break between two words is."""
    capital = "^[A-Z][a-z]+[,.!?]?$"
    weak = bare_word(before).isin(*WEAK_ENDS)
    return (
        F.when(weak, 35).otherwise(0)
        + F.when(bare_word(before) == "to", 40).otherwise(0)
        + F.when(before.rlike(capital) & after.rlike(capital), 28).otherwise(0)
        + F.when(bare_word(after).isin("'s", "s"), 50).otherwise(0)
    )


def wrap(text: Column, width: int) -> Column:
    """At most two lines: one if it fits, else the split of least penalty with both sides in ``width``, else the middle word.

    The penalty weighs uneven sides, breaks after weak words, one-word sides and sides that mix sentences; the first of equal splits wins.
    """
    line = collapse(text)
    words = tokens(line)
    join = lambda w, a, n: F.array_join(F.slice(w, a, n), " ")

    def candidate(w: Column, k: Column) -> Column:
        one, two = join(w, F.lit(1), k), join(w, k + 1, F.size(w))
        before, after = w[k - 1], w[k]
        uneven = F.abs(utf16_length(one) - utf16_length(two)) * 1.7
        alone = F.when((k == 1) | (utf16_length(one) < min(9.0, 0.25 * width)), 22).otherwise(0) + F.when(
            (k == F.size(w) - 1) | (utf16_length(two) < min(9.0, 0.25 * width)), 45
        ).otherwise(0)
        bonus = F.when(strong_end(before), -22).when(soft_end(before), -12).otherwise(0)
        mixed = F.when(one.rlike("[.!?]\\s"), 18).otherwise(0) + F.when(strong_end(before) & after.rlike("^[a-z]"), 8).otherwise(0)
        fits = (utf16_length(one) <= width) & (utf16_length(two) <= width)
        return F.when(fits, F.struct((uneven + break_penalty(before, after) + alone + bonus + mixed).alias("cost"), k.alias("k")))

    best = F.transform(
        F.array(words), lambda w: F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: candidate(w, k)), lambda x: x.isNotNull()))["k"]
    )[0]
    middle = F.ceil(F.size(words) / 2).cast("int")
    at = F.coalesce(F.when(F.size(words) > 1, best), middle)
    return F.when((utf16_length(line) <= width) | (F.size(words) < 2), line).otherwise(
        F.concat(join(words, F.lit(1), at), F.lit("\n"), join(words, at + 1, F.size(words)))
    )


def glue(words: Column) -> Column:
    """One text of word tokens: no blank before closing punctuation or contractions, after opening brackets or between CJK letters."""
    sticks = lambda acc, w: (
        w.rlike("^[,.!?;:%)\\]}\\u3001\\u3002\\uFF0C\\uFF01\\uFF1F]") | w.rlike("(?i)^['\\u2019](s|re|ve|ll|d|m|t)\\b") | acc.rlike("[(\\[{]$")
        | (acc.rlike(f"{CJK}$") & w.rlike(f"^{CJK}"))
    )
    return F.aggregate(
        F.filter(F.transform(words, collapse), lambda x: x != ""),
        F.lit(""),
        lambda acc, w: F.when((acc == "") | sticks(acc, w), F.concat(acc, w)).otherwise(F.concat(acc, F.lit(" "), w)),
    )


def graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\X"), 0)


def speed(text: Column, start: Column, end: Column) -> Column:
    """Readable characters a second; infinite for no duration."""
    return F.when(end - start > 0, readable_length(text) / (end - start)).otherwise(F.lit(float("inf")))


def adjacent_repeats(words: Column) -> Column:
    """How many tokens equal the one before them."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 1)), lambda k: (k < F.size(words)) & (F.get(words, k) == F.get(words, k - 1))))


def dominant_repetition(words: Column, most: int = 8) -> Column:
    """(size, times, share) of the n-gram of 2 to ``most`` tokens that covers most of a text, the longer of equal ones.

    Only n-grams that occur three times or more and n at most a third of the text count; null if none covers three tenths.
    """
    found = []
    gram = lambda n: lambda i: F.array_join(F.slice(words, i, n), " ")  # noqa: E731  (a second parameter would be the index)
    for n in range(2, most + 1):
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), gram(n))
        times = F.transform(
            F.array(F.array_sort(grams)),
            lambda g: F.array_max(F.transform(F.array_distinct(g), lambda x: F.size(F.filter(g, lambda y: y == x)))),
        )[0]
        covered = F.least(F.lit(1.0), times * n / F.size(words))
        found.append(F.when((F.size(words) >= 3 * n) & (times >= 3), F.struct(covered.alias("share"), F.lit(n).alias("size"), times.alias("times"))))
    best = reduce(lambda a, b: F.greatest(a, b), found)
    return F.when(best["share"] >= 0.3, best)


def byte_size(n: Column) -> Column:
    """B, KB, MB or GB."""
    unit = lambda k, name: F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(" " + name))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def base_name(name: Column) -> Column:
    """Without its last extension."""
    return F.regexp_replace(name, "\\.[^.]+$", "")
