"""Column expressions over text. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as the data model defines it (ASCII plus the Unicode spaces).
# The two named classes are one test per character; a list of ranges is ten.
SPACE = r"\h\v\x{feff}"
WS = f"[{SPACE}]"
NON_WS = f"[^{SPACE}]"
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Word boundary over ASCII word characters; the JVM default also looks at accents.
W = "[A-Za-z0-9_]"
WORD_START = f"(?<!{W})(?={W})"
WORD_END = f"(?<={W})(?!{W})"
BOUNDARY = f"(?:{WORD_START}|{WORD_END})"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+$", "")


def words(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{NON_WS}+")), F.lit(0)).cast("bigint")


def minutes(word_count: Column) -> Column:
    """Reading time at 150 words a minute, to 0.1 minute."""
    return F.round(word_count / F.lit(150.0), 1)


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def clean(text: Column, *, fix_soft: bool = True, british: bool = False) -> Column:
    """Normalise quotes, dashes, ellipses, footnote marks, wraps and blank lines."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, "[“”„‟«»]", '"')
    t = F.regexp_replace(t, "[‘’‚‛`´]", "'")
    t = F.regexp_replace(t, r"--{1,3}", "—")
    t = F.regexp_replace(t, "[–―]", "—")
    t = F.regexp_replace(t, "…", "...")
    t = F.regexp_replace(t, r"\.{4,}", "...")
    t = F.regexp_replace(t, rf"(?i)\[{WS}*(?:[0-9]+|note{WS}*[0-9]+){WS}*\]", "")
    if fix_soft:
        t = F.regexp_replace(t, SOFT_BREAK, " $1")
    t = F.regexp_replace(t, rf"(?m){WS_INLINE}+$", "")
    t = strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    return british_quotes(t) if british else t


# Looked for from the newline on, not at every letter. The sign before it may not be the
# one after the last soft break, which that break has taken (``\\G``).
SOFT_BREAK = "\\n(?<=[^\\n.!?\":;—…]\\n)(?<!\\G\\n)([a-zA-Z0-9\"'])"
# Space characters other than the newline: trimming them per line keeps the lines.
WS_INLINE = r"[\h\r\f\x{0b}\x{2028}\x{2029}\x{feff}]"


def british_quotes(text: Column) -> Column:
    """``'speech'`` to ``"speech"``, keeping contractions and clipped words."""
    mark = "\ue000"  # private-use character that stands for a protected apostrophe
    t = F.regexp_replace(text, "(?<=[a-zA-Z])'(?=[a-zA-Z])", mark)
    # fixed values: clipped words that start with an apostrophe
    t = F.regexp_replace(t, f"(?i)'(em|cause|til|round|bout)(?!{W})", mark + "$1")
    t = F.regexp_replace(
        t,
        rf"(?m)(?:^|(?<=[{SPACE}—(\[{{]))'([^'\n]+)'(?=[{SPACE}—)\]}}.,;:!?]|\z)",
        '"$1"',
    )
    return F.replace(t, F.lit(mark), F.lit("'"))


def british_quotes_if_needed(text: Column) -> Column:
    """Apply :func:`british_quotes` only where a text has under two double quotes."""
    return F.when(F.regexp_count(text, F.lit('"')) < 2, british_quotes(text)).otherwise(text)


def unwrap(text: Column) -> Column:
    """Join single line breaks, keep blank lines, squeeze runs of spaces."""
    t = F.regexp_replace(strip(text), r"\r\n", "\n")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n[ \t]+", "\n")
    t = F.regexp_replace(t, r"(?<!\n)\n(?!\n)", " ")
    return F.regexp_replace(t, " {2,}", " ")


def quote_pattern(text: Column) -> Column:
    """Escape a literal so that it can stand inside a regular expression."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}#\s-])", r"\\$1")


def quote_replacement(text: Column) -> Column:
    """Escape a literal used as a regular-expression replacement."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2_147_483_647))


def from_offset(text: Column, start: Column, length: Column) -> Column:
    """Substring by 0-based start and length (negative start clips to 0)."""
    begin = F.greatest(start, F.lit(0))
    return F.substr(text, (begin + 1).cast("int"), F.greatest(length, F.lit(0)).cast("int"))
