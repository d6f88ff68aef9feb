"""What documents are searched for: words and formats as fixed values, and column functions that look for them.

A text is read as its words and marks in order; white space and case don't count. Formats of numbers are Java patterns
under (?U).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: words, marks and formats.
CAPTION_WORDS = ("figure", "figuré", "fig.", "fig", "table")
REFERENCE_VERBS = (
    "show", "shows", "illustrate", "illustrates", "depict", "depicts", "demonstrate", "demonstrates",
    "compare", "compares", "summarize", "summarizes",
)
REFERENCE_PHRASES = ("is shown", "can be seen")
GREEKS = ("delta", "gamma", "theta", "vega", "rho")
PAYOFF_WORDS = ("profit", "loss", "payoff", "breakeven", "break even", "break - even")
MATH_SYMBOLS = "∑∫√≈≤≥∞"
ROMAN_DIGITS = "ivxlcdm"
CUE_TIMES = (("dd:dd:dd,ddd", "d:dd:dd,ddd", "dd:dd:dd.ddd", "d:dd:dd.ddd"), ("dd:dd.ddd",))
NUMBER = r"[+\-−]?\s*(?:\d+(?:[.,]\d+)?|[.,]\d+)"
NUMBER_OF_A_TABLE = r"(?<!\w)[+\-−]?\s*(?:\d+(?:[.,]\d+)?|[.,]\d+)"
QUANTITY = r"(?<![A-Za-z0-9_.])[+$\-−]?\s*(?:\d{1,3}(?:[ ,]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?|[.,]\d+)(?![A-Za-z0-9_.])"
PRODUCT = r"([+\-−]?(?:\d+(?:[.,]\d+)?|[.,]\d+))\s*([xX×*])\s*([+\-−]?(?:\d+(?:[.,]\d+)?|[.,]\d+))\s*=\s*([+\-−]?(?:\d+(?:[.,]\d+)?|[.,]\d+))"


def _bound(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Words (letters, digits, underscores) and single marks of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


def spoken(text: Column) -> Column:
    """The tokens in lower case with a blank around each, so that a phrase is found as ` word word `."""
    return F.concat(F.lit(" "), F.array_join(tokens(F.lower(text)), " "), F.lit(" "))


def _says(text: Column, phrases: tuple[str, ...]) -> Column:
    def found(said: Column) -> Column:
        out = F.lit(False)
        for phrase in phrases:
            out = out | F.contains(said, F.lit(f" {phrase} "))
        return out

    return _bound(spoken(text), found)


def caption(text: Column) -> Column:
    """(kind, number, rest) of a text that begins with a caption word and, after white space, its number of one or two parts; else nulls."""

    def read(pieces: Column) -> Column:
        word, label = F.lower(F.get(pieces, F.lit(0))), F.regexp_extract(F.get(pieces, F.lit(1)), r"(?U)^\d+(?:[-.]\d+)?", 0)

        def made(number: Column) -> Column:
            tail = F.substring(F.get(pieces, F.lit(1)), F.char_length(number) + 1, F.char_length(F.get(pieces, F.lit(1))))
            rest = F.array_join(F.concat(F.filter(F.array(tail), lambda t: t != ""), F.slice(pieces, F.lit(3), F.lit(3))), " ")
            return F.when(word.isin(*CAPTION_WORDS) & (number != ""), F.struct(F.rtrim(word, F.lit(".")).alias("kind"), number.alias("number"), F.lower(rest).alias("rest")))

        return _bound(F.coalesce(label, F.lit("")), made)

    return _bound(F.split(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+"), read)


def refers(rest: Column) -> Column:
    """Whether what follows a caption's number goes on as prose about it: with a verb, or `is shown`, `can be seen`."""
    out = F.regexp_extract(rest, r"(?U)^\w+", 0).isin(*REFERENCE_VERBS)
    for phrase in REFERENCE_PHRASES:
        out = out | (rest.startswith(phrase) & ~F.regexp_like(F.substring(rest, len(phrase) + 1, 1), F.lit(r"(?U)\w")))
    return out


def is_continued(text: Column) -> Column:
    """`continued` as a word, or `cont` in brackets, with or without a full stop."""
    return _says(text, ("continued", "( cont )", "( cont . )"))


def is_payoff(text: Column) -> Column:
    """Words of profit and loss, or P&L, which may have a slash or a bracket before the L."""
    return _says(text, (*PAYOFF_WORDS, "p & l", "p & / l", "p & ( l", "p & / ( l"))


def is_chart(text: Column) -> Column:
    """One quantity vs another."""
    return _says(text, tuple(f"{q} vs" for q in ("volatility", *GREEKS)))


def is_greek_value(text: Column) -> Column:
    """A row of a Greek's values: its name and an equals sign at the start."""
    said = spoken(text)
    return _bound(said, lambda s: F.substring_index(s, " = ", 1).isin(*[f" {g}" for g in GREEKS]) & F.contains(s, F.lit(" = ")))


def is_blank_page(text: Column) -> Column:
    """A page that says that it is blank, and nothing else."""
    sentences = ["page intentionally left blank"]
    for middle in ("", "is "):
        for meant in ("", "intentionally "):
            sentences += [f"this page {middle}{meant}{left}blank" for left in ("", "left ")]
    return spoken(text).isin(*[f" {s}{end} " for s in sentences for end in ("", " .", " !")])


def isolated_number(text: Column) -> Column:
    """A number of up to four digits that stands alone; else null."""
    return _bound(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), lambda t: F.when((F.char_length(t) <= 4) & F.regexp_like(t, F.lit(r"(?U)^\d+$")), t))


def chapter(text: Column) -> Column:
    """What follows the first word `chapter` that has a number or a Roman one right behind it; else null."""

    def number_after(found: Column) -> Column:
        def after(word: Column, i: Column) -> Column:
            return _bound(F.get(found, i + 1), lambda n: F.when((F.lower(word) == "chapter") & (F.regexp_like(n, F.lit(r"(?U)^\d+$")) | (F.translate(F.lower(n), ROMAN_DIGITS, "") == "")), n))

        return F.get(F.array_compact(F.transform(found, after)), F.lit(0))

    return F.when(F.contains(F.lower(text), F.lit("chapter")), _bound(tokens(text), number_after))


def _has_symbol(text: Column) -> Column:
    return F.char_length(F.translate(text, MATH_SYMBOLS, "")) < F.char_length(text)


def is_formula(text: Column) -> Column:
    """A mathematical symbol, or an equals sign with a name before it and two characters of a line behind it (blanks count)."""

    def sides(parts: Column) -> Column:
        def stands(left: Column, i: Column) -> Column:
            name = F.regexp_extract(left, r"(?U)(\w+)\s*$", 1)
            behind = F.array_join(F.slice(parts, i + 2, F.lit(3)), "=")
            return (i + 1 < F.size(parts)) & F.regexp_like(name, F.lit("^[A-Za-z][0-9A-Za-z_]*$")) & F.regexp_like(behind, F.lit(r"(?U)^\s*[^\n]{2}"))

        return F.exists(F.transform(parts, stands), lambda x: x)

    return _has_symbol(text) | (F.contains(text, F.lit("=")) & _bound(F.split(text, "="), sides))


def formula_hints(text: Column) -> Column:
    """How many mathematical symbols and small equations a text has: a single letter, an equals sign and what is reckoned behind it.

    What is reckoned are words, blanks, brackets and + - * /. A letter that the equation before it has taken in (nothing
    else stands between the two equals signs) begins no other.
    """

    def count(parts: Column) -> Column:
        def side(right: Column, i: Column) -> Column:
            left = F.get(parts, F.greatest(i - 1, F.lit(0)))
            letter = (i > 0) & F.regexp_like(left, F.lit(r"(?U)(?:^|\W)[A-Za-z]\s*$"))
            reckoned = F.regexp_extract(right, r"(?U)^[\w\s()*/+-]+", 0)
            return F.struct((letter & (reckoned != "")).alias("fits"), (reckoned == right).alias("whole"))

        state = "struct<n:int,taken:boolean>"

        def step(s: Column, x: Column) -> Column:
            hit = x["fits"] & ~s["taken"]
            return F.struct((s["n"] + hit.cast("int")).alias("n"), (hit & x["whole"]).alias("taken")).cast(state)

        return F.aggregate(F.transform(parts, side), F.struct(F.lit(0).alias("n"), F.lit(False).alias("taken")).cast(state), step, lambda s: s["n"])

    symbols = F.char_length(text) - F.char_length(F.translate(text, MATH_SYMBOLS, ""))
    return symbols + F.when(F.contains(text, F.lit("=")), _bound(F.split(text, "="), count)).otherwise(F.lit(0))


def is_cue(line: Column) -> Column:
    """A subtitle's timing: a time, an arrow between white space, and at the start of what follows a time of the same kind."""

    def timed(pieces: Column) -> Column:
        shapes = [F.translate(F.get(pieces, F.lit(i)), "0123456789", "d" * 10) for i in (0, 2)]
        out = F.lit(False)
        for kind in CUE_TIMES:
            begins = F.lit(False)
            for shape in kind:
                begins = begins | shapes[1].startswith(shape)
            out = out | (shapes[0].isin(*kind) & begins)
        return F.coalesce((F.get(pieces, F.lit(1)) == "-->") & out, F.lit(False))

    return F.contains(line, F.lit("-->")) & _bound(F.split(line, r"(?U)\s+"), timed)
