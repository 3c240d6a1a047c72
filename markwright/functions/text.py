"""Text functions on answer sheets, as Catalyst expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str methods see it, spelled out: Java's \s knows ASCII only.
WS = r"\t-\r\x1c-\x20\x85\xa0" + f"{chr(0x1680)}{chr(0x2000)}-{chr(0x200A)}{chr(0x2028)}{chr(0x2029)}{chr(0x202F)}{chr(0x205F)}{chr(0x3000)}"
ZERO_WIDTH = chr(0x200B)
#: The same characters one by one, for trims.
WHITE = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


#: Ranges without any white space, which pass over most characters by a comparison or two.
PRINTED = r"\xa1-\x{167f}\x{3001}-\x{10ffff}"


def collapse(c: Column, chars: str = WS) -> Column:
    """Each run of `chars` (a class with the space as its \\x20) as one space, none at the ends. Single spaces, which are most
    of the runs, are not matched, so little is copied; what can't be white space is passed over before the whole class is tried."""
    others, maybe = chars.replace(r"\x20", r"\x1f"), f"(?=[^!-~{PRINTED}])"
    return F.trim(F.regexp_replace(c, f"{maybe}(?: {maybe}[{chars}]++|(?=[^ ])[{others}][{chars}]*+)", " "))


def preprocess(c: Column) -> Column:
    """Null as empty; white space, rules (| _) and dot leaders to one space; lower case."""
    t = collapse(F.coalesce(c, F.lit("")), WS + ZERO_WIDTH)
    without = collapse(F.regexp_replace(F.regexp_replace(t, r"[|_]{2,}", " "), r"\.{3,}", " "))
    return F.lower(F.when(t.rlike(r"[|_]{2}|\.{3}"), without).otherwise(t))


def clean_line(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"[ \t\xa0{ZERO_WIDTH}]+", " "), f"^[{WS}]+|[{WS}]+$", "")


def word_count(c: Column) -> Column:
    """0 for null; words are what single spaces part once white space is collapsed."""
    return F.size(F.array_remove(F.split(collapse(F.coalesce(c, F.lit(""))), " "), ""))


def squeeze_runs(c: Column) -> Column:
    """Runs of three or more of one character become two."""
    return F.regexp_replace(c, r"(.)\1{2,}", "$1$1")


def script_boundary(c: Column) -> Column:
    """A space between Tamil and Latin letters that touch."""
    c = F.regexp_replace(c, r"([஀-௿])([a-zA-Z])", "$1 $2")
    return F.regexp_replace(c, r"([a-zA-Z])([஀-௿])", "$1 $2")


def exact_key(c: Column) -> Column:
    """What texts are matched on: trimmed, lower case, without final stops and white space. White space within stays as it is."""
    return F.rtrim(F.lower(F.ltrim(c, F.lit(WHITE))), F.lit(f"{WHITE}.?!।"))


def canonical_qno(c: Column, whole: bool = False) -> Column:
    """Question numbers in one form: no brackets, no final punctuation, no leading zeros, lower case; "Q" and a digit keep the
    capital (`whole`: only if nothing but digits follows)."""
    t = F.regexp_replace(collapse(c.cast("string")), r"^\((.*)\)$", "$1")
    t = F.regexp_replace(t, rf"(?i)^Q[.\- ]?[{WS}]*", "Q")
    t = F.regexp_replace(t, rf"[{WS}.):]+$", "")
    t = F.regexp_replace(t, r"^(Q?)0+(?=[0-9])", "$1")
    return F.when(t.rlike(r"^Q[0-9]+$" if whole else r"^Q[0-9]"), t).otherwise(F.lower(t))


def clean_question_line(c: Column) -> Column:
    """As `clean_line`, but only spaces and tabs within the line are collapsed."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), f"^[{WS}]+|[{WS}]+$", "")


def strip_marks(c: Column) -> Column:
    """Without hints such as (5 marks) or [7]."""
    return collapse(F.regexp_replace(c, r"(?i)[(\[] *[0-9]+ *(marks?)? *[)\]]", " "))


def truncate(c: Column, longest: int = 122, to: int = 120) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, to), F.lit(" …"))).otherwise(c)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_\-]", "_")


def answer_status(c: Column) -> Column:
    n = word_count(c)
    return F.when(n == 0, "not_attempted").when(n < 3, "empty").otherwise("valid")
