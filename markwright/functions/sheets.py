"""Recognised lines of question papers and answer sheets: question numbers, noise, continuations, repairs of spelling.

Java's \\b, \\w, \\d and \\s differ from the ones these rules are defined with, so classes are spelled out: a word character is a
letter, digit or underscore (Tamil vowel signs aren't), and a boundary after a word is a look-ahead on that class."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS, ZERO_WIDTH, collapse, script_boundary, squeeze_runs

W, D, S = r"[\p{L}\p{N}_]", r"\p{Nd}", f"[{WS}]"

# Header words, in Latin letters (a boundary follows) and Tamil (which end in a sign, so a word character follows).
HEADERS = ["page", rf"reg(?:ister)?\.?{S}*no", "roll", "name", "date", "time", "marks", "maximum", "total", "instructions", rf"part{S}+[a-z]", "subject"]
TAMIL_HEADERS = ["பக்கம்", "பெயர்", "தேதி", "நேரம்", "மதிப்பெண்", "விதிமுறை", "பகுதி", "பாடம்"]
PAPER_HEADERS = ["page", "register", rf"reg\.?{S}*no", "roll", "name", "date", "time", "marks", "maximum", "instructions", rf"part{S}+[a-z]"]
PAPER_TAMIL_HEADERS = ["பக்கம்", "பெயர்", "தேதி", "நேரம்", "மதிப்பெண்", "விதிமுறை", "பகுதி"]
# Words that end a question.
QUESTION_WORDS = ["என்ன", "ஏன்", "எப்படி", "விளக்குக", "கூறுக", "எழுதுக"]
# Romanised words and what they become, in order.
ROMANISED = {
    "satyagraha": "சத்தியாக்கிரகம்", "satyagrahi": "சத்தியாக்கிரகி", "ahimsa": "அஹிம்சை", "swadeshi": "சுதேசி", "swaraj": "சுராஜ்",
    "gandhiji": "காந்தியடிகள்", "bharatham": "பாரதம்", "indhiya": "இந்தியா", "vidudhali": "விடுதலை", "porattam": "போராட்டம்",
    "tholkappiyam": "தொல்காப்பியம்", "sangam": "சங்கம்", "ilakkiyam": "இலக்கியம்", "ilakkanam": "இலக்கணம்", "kural": "குறள்",
    "thirukkural": "திருக்குறள்", "avvaiyar": "ஔவையார்", "valluvar": "வள்ளுவர்", "neer": "நீர்", "kaatru": "காற்று", "maram": "மரம்", "suryan": "சூரியன்",
}
# Misread words and what they become, in order.
MISREAD = {
    "இனதியா": "இந்தியா", "இனதிய": "இந்திய", "தமிழனாட": "தமிழ்நாடு", "தமிழனாடு": "தமிழ்நாடு", "கானதியடிகள்": "காந்தியடிகள்", "கானதி": "காந்தி",
    "இலககியம": "இலக்கியம்", "இலககணம": "இலக்கணம்", "சதியாககிரகம": "சத்தியாக்கிரகம்", "விடதலை": "விடுதலை", "போராடம": "போராட்டம்",
    "தோலகாபியம": "தொல்காப்பியம்", "திருககுரல": "திருக்குறள்", "அவைவயார": "ஔவையார்", "வளளுவர": "வள்ளுவர்",
}


def _header(latin, tamil):
    return rf"(?iu)^{S}*(?:(?:{'|'.join(latin)})(?!{W})|(?:{'|'.join(tamil)})(?={W}))"


DATE = rf"^{S}*{D}{{1,2}}[/\-]{D}{{1,2}}[/\-]{D}{{2,4}}{S}*$"
NOISE = [
    _header(HEADERS, TAMIL_HEADERS), rf"^{S}*[*\-–—_=]{{2,}}{S}*$", rf"^{S}*[-–]?{S}*{D}{{1,3}}{S}*[-–]?{S}*$", DATE,
    rf"(?i)^{S}*(?:contd\.?|p\.?t\.?o\.?|over){S}*$",
]
PAPER_NOISE = [_header(PAPER_HEADERS, PAPER_TAMIL_HEADERS), rf"^{S}*\*+{S}*$", rf"^{S}*[-–—_]{{3,}}{S}*$", DATE]


def _any(line: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | line.rlike(p)
    return found


def is_noise(line: Column) -> Column:
    """Lines of an answer sheet that aren't answers: headers, rules, page numbers, dates, "P.T.O."."""
    return _any(line, NOISE)


def is_skipped(line: Column) -> Column:
    """Lines of a question paper that aren't questions: headers, asterisks, long rules, dates."""
    return _any(line, PAPER_NOISE)


REST = rf"{D}{{1,3}}[.{WS}]{S}*[a-zA-Z][).]?{S}*|\(?[a-fA-F][).]{S}*|\(?(?:i{{1,3}}|iv|vi{{0,3}}|viii)[).]{S}*|[அஆஇஈஉஊ][)]{S}*"
ANSWER_NUMBER = rf"^(?:(?:Q[.\-{WS}]?{S}*)?{D}{{1,3}}(?:{S}*[.):\-]{S}*)?(?!{D})|{REST})"
PAPER_NUMBER = rf"^(?:(?:Q\.?{S}*)?{D}{{1,3}}(?:{S}*[.):\-]{S}*)?(?!{S}*{D})|{REST})"


def _number(line: Column, pattern: str, prefix: str) -> Column:
    token = F.regexp_extract(line, pattern, 0)
    qno = F.regexp_replace(F.regexp_replace(collapse(token), rf"[{WS}.):]+$", ""), prefix, "Q")
    found = line.rlike(pattern)
    rest = F.regexp_replace(F.substring(line, F.length(token) + 1, F.length(line)), f"^{S}+|{S}+$", "")
    return F.struct(F.when(found, qno).alias("qno"), F.when(found, rest).otherwise(line).alias("rest"))


def answer_number(line: Column) -> Column:
    """Struct qno, rest: the question number a line of an answer sheet starts with (null if none), and what follows it."""
    return _number(line, ANSWER_NUMBER, rf"^Q[.\-{WS}]?{S}*")


def paper_number(line: Column) -> Column:
    """As `answer_number`, by the question papers' rules: no number before another number."""
    return _number(line, PAPER_NUMBER, rf"^Q\.?{S}*")


def continues(line: Column) -> Column:
    """Whether a line without a number goes on with a question: it starts with a small letter, Tamil or a bracket."""
    return ~line.rlike(PAPER_NUMBER) & line.rlike(r"^[\p{IsLowercase}஀-௿(]")


MID_LINE = rf"(?iu)(?<=[^\n])(Q{S}*{D}+{S}*[).:\-]|(?<!{W}){D}+{S}*[).:]|கேள்வி{S}*{D}+|வினா{S}*{D}+)"
BLOCK_NUMBER = rf"(?iu)(?<![^\n])(?:(?:Q|கேள்வி|வினா)[{WS}.:\-]*({D}+)|({D}+){S}*[.):])"


def sheet_blocks(sheet: Column) -> Column:
    """Array of struct qno, block: the numbered blocks of a combined sheet, for `split_block`. A question marker within a line
    starts a line first. What stands before the first number goes; a sheet without numbers has no blocks."""
    text = F.regexp_replace(F.regexp_replace(sheet, MID_LINE, "\n$1"), r"\n{2,}", "\n")
    parts = F.split(text, BLOCK_NUMBER, -1)
    named, plain = (F.regexp_extract_all(text, F.lit(BLOCK_NUMBER), F.lit(k)) for k in (1, 2))
    qno = lambda i: F.when(F.get(named, i) != "", F.get(named, i)).otherwise(F.get(plain, i))
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda b, i: F.struct(qno(i).alias("qno"), b.alias("block")))


def is_question(text: Column) -> Column:
    """Whether the joined text of a question counts: five characters or more, not of punctuation only."""
    return (F.length(text) >= 5) & text.rlike(rf"[\p{{L}}\p{{N}}_஀-௿]")


MARKER = rf"(?:விடை{S}*:|vidai{S}*:|answer{S}*:|ans{S}*:)"


def split_block(block: Column) -> Column:
    """Struct question, answer of one block: at an answer marker; else after the first line that ends in a stop or holds a
    question word (the first line if none does); else, on one line, after the first sentence."""
    block = F.regexp_replace(block, f"^{S}+|{S}+$", "")
    marked = rf"(?ius)^(.*?){MARKER}(.*)$"
    lines = F.filter(F.transform(F.split(block, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(x, f"^{S}+|{S}+$", "")), lambda x: x != "")
    ends = F.transform(lines, lambda x: x.endswith(".") | _any(x, QUESTION_WORDS))
    at = F.greatest(F.array_position(ends, True), F.lit(1)).cast("int")
    sentences = F.split(block, "[.?]", -1)
    both = lambda q, a: F.struct(collapse(q).alias("question"), collapse(a).alias("answer"))
    return (
        F.when(block.rlike(marked), both(F.regexp_extract(block, marked, 1), F.regexp_extract(block, marked, 2)))
        .when(F.size(lines) >= 2, both(F.array_join(F.slice(lines, 1, at), " "), F.array_join(F.slice(lines, at + 1, F.size(lines)), " ")))
        .when(F.size(sentences) >= 2, both(F.element_at(sentences, 1), F.array_join(F.slice(sentences, 2, F.size(sentences)), " ")))
        .otherwise(both(F.lit(""), block))
    )


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """The composed Unicode form, for which Spark has no expression."""
    import unicodedata

    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def from_romanised(c: Column) -> Column:
    for word, tamil in ROMANISED.items():
        c = F.regexp_replace(c, rf"(?iu)(?<!{W}){word}(?!{W})", tamil)
    return c


def respelled(c: Column) -> Column:
    for wrong, right in MISREAD.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def without_stray(c: Column) -> Column:
    """Symbols other than letters, digits, white space and common punctuation become spaces."""
    return F.regexp_replace(c, rf"""[^஀-௿\p{{L}}\p{{N}}_{WS}।?!,.\-'"():;]""", " ")


def repaired(c: Column) -> Column:
    """A recognised answer, ready to be scored: composed, scripts apart, no stray symbols or long runs, words respelled."""
    c = squeeze_runs(without_stray(script_boundary(nfc(F.coalesce(c, F.lit(""))))))
    return collapse(respelled(from_romanised(c)), WS + ZERO_WIDTH)


# Tamil letters and their forms in the ITRANS scheme.
CONSONANTS = {
    "க": "k", "ங": "~N", "ச": "ch", "ஞ": "~n", "ட": "T", "ண": "N", "த": "t", "ந": "n", "ப": "p", "ம": "m", "ய": "y", "ர": "r", "ல": "l", "வ": "v",
    "ழ": "zh", "ள": "L", "ற": "R", "ன": "n", "ஜ": "j", "ஶ": "sh", "ஷ": "Sh", "ஸ": "s", "ஹ": "h",
}
VOWELS = {"அ": "a", "ஆ": "A", "இ": "i", "ஈ": "I", "உ": "u", "ஊ": "U", "எ": "e", "ஏ": "E", "ஐ": "ai", "ஒ": "o", "ஓ": "O", "ஔ": "au", "ஃ": "H"}
SIGNS = {"ா": "A", "ி": "i", "ீ": "I", "ு": "u", "ூ": "U", "ெ": "e", "ே": "E", "ை": "ai", "ொ": "o", "ோ": "O", "ௌ": "au"}
VIRAMA = "்"
#: Vowel signs written as two marks, and the one they are.
TWO_MARKS = {"\u0bc6\u0bbe": "\u0bca", "\u0bc7\u0bbe": "\u0bcb", "\u0bc6\u0bd7": "\u0bcc"}


def phonetic(c: Column) -> Column:
    """How a text sounds, in Latin letters. A consonant has the vowel a of its own, unless a vowel sign takes its place or a virama
    takes it away. Of several readings the longest counts (signs of two marks before their parts). Other characters stay; texts
    without Tamil letters are left alone."""
    signs = "".join(SIGNS)
    t = c
    for two, one in TWO_MARKS.items():
        t = F.replace(t, F.lit(two), F.lit(one))
    t = F.regexp_replace(t, f"([{''.join(CONSONANTS)}])(?![{signs}{VIRAMA}])", "$1a")
    t = F.regexp_replace(t, f"([{''.join(CONSONANTS)}]){VIRAMA}", "$1")
    for letter, latin in (CONSONANTS | VOWELS | SIGNS).items():
        t = F.replace(t, F.lit(letter), F.lit(latin))
    return F.when(c.rlike("[\u0B80-\u0BFF]"), t).otherwise(c)
