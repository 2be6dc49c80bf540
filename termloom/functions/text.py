"""Text functions as column expressions, with the white space and line rules of Unicode text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.repair import repaired_udf

#: White space, as Java's regular expressions take it: what str.split() and str.strip() take in Python.
SPACE = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Marks that normalisation deletes: fixed values.
MARKS = "•-–—*_#"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def split_words(c: Column) -> Column:
    """The words between white space; none for a blank text."""
    own = strip(c)
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, f"{SPACE}+"))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(SPACE.replace("[", "[^", 1) + "+"))


def squeeze(c: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(c, f"{SPACE}+", " ")))


def unspaced(c: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(c), f"{SPACE}+", "")


def normalize(c: Column) -> Column:
    """squeeze(), and then without bullets, dashes and emphasis marks: a blank beside a deleted mark stays."""
    return F.translate(squeeze(c), MARKS, "")


def first_line_title(c: Column) -> Column:
    """A markdown file's title: its first line without any # marks."""
    return strip(F.replace(F.element_at(F.split(c, "\n", 2), 1), F.lit("#"), F.lit("")))


def after_first_line(c: Column) -> Column:
    """The rest of the file after its first line; empty if there is one line."""
    return strip(F.coalesce(F.get(F.split(c, "\n", 2), F.lit(1)), F.lit("")))


def strip_fence(c: Column) -> Column:
    """What is inside a code fence that the text starts with, up to the next fence; other texts as they are, stripped."""
    t = strip(c)
    return F.when(t.startswith("```"), strip(F.regexp_extract(t, r"(?s)^```(?:json)?(.*?)(?:```|$)", 1))).otherwise(t)


def repaired(c: Column) -> Column:
    """A reply's JSON as a reader takes it: as it is where it can be read, outside of fences and of what stands around it; else
    mended by a scanner (functions.repair); null if it has no object or list."""
    own = strip_fence(c)
    fine = F.when(own.startswith("{") & own.endswith("}"), F.get_json_object(own, "$"))
    return F.coalesce(fine, repaired_udf(F.when(fine.isNull(), own)))


def is_table_line(c: Column) -> Column:
    t = strip(c)
    return t.startswith("|") & t.endswith("|") & (F.regexp_count(t, F.lit(r"\|")) >= 2)


def heading_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"^#+{SPACE}*", ""))


def anchor(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def snippet(c: Column, n: int = 200) -> Column:
    """The first n characters, with three dots in any case."""
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def squeeze_blank_lines(c: Column) -> Column:
    """A page's text with runs of blank lines as one, stripped."""
    return strip(F.regexp_replace(c, rf"\n{SPACE}*\n+", "\n\n"))


def pair_key(a: Column, b: Column) -> list[Column]:
    """The two ends of an undirected edge, in order of code points."""
    return [F.least(a, b), F.greatest(a, b)]
