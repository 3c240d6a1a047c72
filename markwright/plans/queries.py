"""The engine's queries on the driver's tables, each with the SQL that gives the same rows.

`documents` stand for answer sheets and answers, `benchmark` for the question bank, `conversations` for numbered records,
`embeddings` for sentence vectors; `orders` and `lineitem` give numbers to score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, scoring, sheets, text, vectors
from ..operators import evaluate, match, records, reports

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def collapsed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def cleaned(x: str) -> str:
    return trimmed(f"regexp_replace({x}, '[ \\t\\x{{a0}}\\x{{200B}}]+', ' ', 'g')")


PREPROCESSED = collapsed("lower(regexp_replace(regexp_replace(" + collapsed("coalesce(text, '')") + ", '[|_]{2,}', ' ', 'g'), '[.]{3,}', ' ', 'g'))")
COUNT = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '" + SPACE + "+'), lambda x: x <> ''))"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """`rows` for costly work on each: dealt anew if their files make fewer tasks than there are cores, else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def turns(spark, d):
    return t(spark, d, "conversations")


# Text


@query(f"SELECT doc_id, {PREPROCESSED} AS cleaned, {COUNT} AS n_words FROM documents")
def clean_text(spark, d):
    return spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.preprocess(F.col("text")).alias("cleaned"), text.word_count(F.col("text")).cast("long").alias("n_words"))


@query("""WITH c AS (SELECT doc_id, string_split(text, '') AS cs FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN i > 2 AND cs[i] = cs[i - 1] AND cs[i] = cs[i - 2] AND ascii(cs[i]) NOT IN (10, 13, 133, 8232, 8233) THEN '' ELSE cs[i] END), '') AS squeezed FROM c""")
def squeeze_runs(spark, d):
    return t(spark, d, "documents").select("doc_id", text.squeeze_runs(F.col("text")).alias("squeezed"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(text || 'அa' , '([\\x{0B80}-\\x{0BFF}])([a-zA-Z])', '\\1 \\2', 'g'), '([a-zA-Z])([\\x{0B80}-\\x{0BFF}])', '\\1 \\2', 'g') AS spaced FROM documents""")
def script_boundary(spark, d):
    return t(spark, d, "documents").select("doc_id", text.script_boundary(F.concat("text", F.lit("அa"))).alias("spaced"))


KEY = f"regexp_replace(regexp_replace(lower(text), '^{SPACE}+', ''), '([.?!।]|{SPACE})+$', '')"


@query(f"SELECT doc_id, {KEY} AS match_key FROM documents")
def trailing_norm(spark, d):
    return t(spark, d, "documents").select("doc_id", text.exact_key(F.col("text")).alias("match_key"))


FORMS = "CASE turn % 5 WHEN 0 THEN 'Q.0' || turn WHEN 1 THEN '(' || turn || ')' WHEN 2 THEN turn || ')' WHEN 3 THEN 'q ' || turn || '.' ELSE '0' || turn || '.A' END"


def forms():
    n = F.col("turn").cast("string")
    return F.when(F.col("turn") % 5 == 0, F.concat(F.lit("Q.0"), n)).when(F.col("turn") % 5 == 1, F.concat(F.lit("("), n, F.lit(")"))).when(F.col("turn") % 5 == 2, F.concat(n, F.lit(")"))).when(F.col("turn") % 5 == 3, F.concat(F.lit("q "), n, F.lit("."))).otherwise(F.concat(F.lit("0"), n, F.lit(".A")))


@query(f"""WITH r AS (SELECT conv_id, turn, {FORMS} AS raw FROM conversations),
a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\\((.*)\\)$', '\\1'), '(?i)^Q[.\\- ]?\\s*', 'Q'), '[\\s.):]+$', ''), '^(Q?)0+([0-9])', '\\1\\2') AS s FROM r)
SELECT conv_id, turn, raw, CASE WHEN regexp_matches(s, '^Q[0-9]') THEN s ELSE lower(s) END AS mapped, CASE WHEN regexp_matches(s, '^Q[0-9]+$') THEN s ELSE lower(s) END AS whole FROM a""")
def canonical_qno(spark, d):
    r = turns(spark, d).select("conv_id", "turn", forms().alias("raw"))
    return r.withColumn("mapped", text.canonical_qno(F.col("raw"))).withColumn("whole", text.canonical_qno(F.col("raw"), whole=True))


@query(f"SELECT doc_id, {COUNT} AS n_words, CASE WHEN {COUNT} = 0 THEN 'not_attempted' WHEN {COUNT} < 3 THEN 'empty' ELSE 'valid' END AS status FROM documents")
def status_classify(spark, d):
    return t(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"), text.answer_status(F.col("text")).alias("status"))


# Lines and records

ENDS = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')"
ALL_LINES = f"""l AS (SELECT doc_id, pos - 1 AS line_pos, {cleaned('line')} AS line FROM (SELECT doc_id, unnest({ENDS}) AS line, generate_subscripts({ENDS}, 1) AS pos FROM documents))"""
LINES = f"{ALL_LINES}, k AS (SELECT * FROM l WHERE line <> '')"


@query(f"""WITH {LINES}, b AS (SELECT *, count(*) FILTER (WHERE line_pos % 3 = 1) OVER (PARTITION BY doc_id ORDER BY line_pos) AS block FROM k)
SELECT doc_id, block, {collapsed("string_agg(line, ' ' ORDER BY line_pos)")} AS text FROM b WHERE block > 0 GROUP BY doc_id, block""")
def line_blocks(spark, d):
    return records.sheet_blocks(spread(t(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", lambda x: x["pos"] % 3 == 1)


# Number tokens and noise in SQL; it has no look-ahead, so what must follow a token is matched after its group
IN, DIGIT, WORD_CHAR = SPACE[1:-1], "\\p{Nd}", "[\\p{L}\\p{N}_]"
REST = f"{DIGIT}{{1,3}}[.{IN}]{SPACE}*[a-zA-Z][).]?{SPACE}*|\\(?[a-fA-F][).]{SPACE}*|\\(?(?:i{{1,3}}|iv|vi{{0,3}}|viii)[).]{SPACE}*|[அஆஇஈஉஊ][)]{SPACE}*"


def token(pattern: str) -> str:
    return f"coalesce(nullif(regexp_extract(line, '{pattern}', 1), ''), regexp_extract(line, '{pattern}', 2))"


def number_sql(prefix: str, follows: str) -> tuple[str, str, str]:
    """The token, the number and the rest of `line` in SQL."""
    found = token(f"^(?:((?:{prefix})?{DIGIT}{{1,3}}(?:{SPACE}*[.):\\-]{SPACE}*)?){follows}|({REST}))")
    qno = f"regexp_replace(regexp_replace({collapsed('token')}, '[{IN}.):]+$', ''), '^{prefix}', 'Q')"
    return found, f"nullif({qno}, '')", f"CASE WHEN token = '' THEN line ELSE {trimmed('substr(line, length(token) + 1)')} END"


ANSWER_TOKEN, ANSWER_QNO, ANSWER_REST = number_sql(f"Q[.\\-{IN}]?{SPACE}*", f"(?:[^{DIGIT}]|$)")
PAPER_TOKEN, PAPER_QNO, PAPER_REST = number_sql(f"Q\\.?{SPACE}*", f"(?:{SPACE}*(?:[^{IN}{DIGIT}]|$))")
DATES = f"^{SPACE}*{DIGIT}{{1,2}}[/\\-]{DIGIT}{{1,2}}[/\\-]{DIGIT}{{2,4}}{SPACE}*$"


def header_sql(latin, tamil) -> str:
    names = "|".join(latin).replace(sheets.S, SPACE)
    return f"(regexp_matches(line, '(?i)^{SPACE}*(?:{names})(?:[^\\p{{L}}\\p{{N}}_]|$)') OR regexp_matches(line, '^{SPACE}*(?:{'|'.join(tamil)}){WORD_CHAR}'))"


NOISY = f"""({header_sql(sheets.HEADERS, sheets.TAMIL_HEADERS)} OR regexp_matches(line, '^{SPACE}*[*\\-–—_=]{{2,}}{SPACE}*$|^{SPACE}*[-–]?{SPACE}*{DIGIT}{{1,3}}{SPACE}*[-–]?{SPACE}*$')
 OR regexp_matches(line, '{DATES}') OR regexp_matches(line, '(?i)^{SPACE}*(?:contd\\.?|p\\.?t\\.?o\\.?|over){SPACE}*$'))"""
SKIPPED = f"({header_sql(sheets.PAPER_HEADERS, sheets.PAPER_TAMIL_HEADERS)} OR regexp_matches(line, '^{SPACE}*\\*+{SPACE}*$|^{SPACE}*[-–—_]{{3,}}{SPACE}*$') OR regexp_matches(line, '{DATES}'))"


@query(f"""WITH {ALL_LINES}, a AS (SELECT *, {ANSWER_TOKEN} AS token FROM l WHERE line_pos < 40),
n AS (SELECT doc_id, line_pos + 1 AS line_no, line, {ANSWER_QNO} AS qno, {ANSWER_REST} AS rest FROM a),
k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN {NOISY} THEN 'noise' WHEN qno IS NOT NULL THEN 'number' ELSE 'answer' END AS kind FROM n)
SELECT doc_id, line_no, kind, CASE WHEN kind = 'number' THEN qno END AS qno, CASE kind WHEN 'number' THEN rest[1:40] WHEN 'answer' THEN line[1:60] ELSE '' END AS shown FROM k""")
def diagnose_lines(spark, d):
    return records.diagnosed(spread(t(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {SKIPPED}) AS n_skipped FROM k GROUP BY doc_id")
def skipped_lines(spark, d):
    rows = records.lines(spread(t(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(sheets.is_skipped(F.col("line"))).alias("n_skipped"))


def _dedup(how):
    def f(spark, d):
        return how(t(spark, d, "documents").select("source", "lang", "text", "doc_id"), ["source", "lang"], "text", "doc_id")

    return f


for _name, _how, _order in (("dedup_first", records.first_of, "doc_id"), ("dedup_last", records.last_of, "doc_id DESC"), ("dedup_longest", records.longest_of, "length(text) DESC, doc_id")):
    QUERIES[_name] = _dedup(_how)
    SQL[_name] = f"SELECT source, lang, text, first_id AS doc_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY source, lang) AS first_id, row_number() OVER (PARTITION BY source, lang ORDER BY {_order}) AS k FROM documents) WHERE k = 1"


@query("""SELECT conv_id, role, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE text <> ''), '') AS text, min(turn) AS turn FROM conversations GROUP BY conv_id, role""")
def merge_answers(spark, d):
    return records.merged(turns(spark, d).select("conv_id", "role", "text", "turn"), ["conv_id", "role"], "text", "turn")


@query("""WITH r AS (SELECT * FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, unnest(generate_series(min(turn), max(turn))) AS turn FROM r GROUP BY conv_id)
SELECT conv_id, turn FROM s ANTI JOIN r USING (conv_id, turn)""")
def gap_fill(spark, d):
    return records.missing_numbers(turns(spark, d).where("role = 'user'").select("conv_id", "turn"), "conv_id", "turn")


@query("""SELECT conv_id, turn FROM conversations ANTI JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'user') USING (conv_id, turn)""")
def expected_gap(spark, d):
    c = turns(spark, d)
    return records.missing_expected(c.select("conv_id", "turn"), c.where("role = 'user'").select("conv_id", "turn"), ["conv_id", "turn"])


QNO = "CASE (turn + conv_id) % 9 WHEN 0 THEN CAST(turn + 1 AS VARCHAR) WHEN 1 THEN 'Q' || turn || 'b' WHEN 2 THEN chr(97 + CAST(turn % 9 AS INT)) WHEN 3 THEN 'iii' WHEN 4 THEN turn || '.B' WHEN 5 THEN 'இ' WHEN 6 THEN 'V' WHEN 7 THEN 'q' || turn ELSE 'VIII' END"


@query(f"""WITH r AS (SELECT conv_id, turn, {QNO} AS qno FROM conversations), b AS (SELECT *, regexp_replace(qno, '^[Qq]', '') AS bare FROM r),
k AS (SELECT *, CASE WHEN regexp_full_match(bare, '[0-9]+([.\\s][a-zA-Z])?') THEN 0 WHEN regexp_full_match(bare, '[a-zA-Z]') THEN 1 WHEN lower(bare) IN ('ii', 'iii', 'iv', 'vi', 'vii', 'viii') THEN 2 WHEN instr('{records.TAMIL_PARTS}', bare) > 0 THEN 3 ELSE 4 END AS kind FROM b),
n AS (SELECT *, CASE kind WHEN 0 THEN CAST(regexp_extract(bare, '^[0-9]+') AS BIGINT) WHEN 2 THEN list_position(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii'], lower(bare)) WHEN 3 THEN instr('{records.TAMIL_PARTS}', bare) ELSE 0 END AS number,
 CASE kind WHEN 0 THEN ascii(lower(regexp_extract(bare, '[a-zA-Z]$'))) WHEN 1 THEN ascii(lower(bare)) ELSE 0 END AS letter, CASE kind WHEN 4 THEN bare ELSE '' END AS rest FROM k)
SELECT conv_id, turn, qno, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY kind, number, letter, rest, turn) AS INT) AS place FROM n""")
def qno_sort_key(spark, d):
    from pyspark.sql import Window as W

    n, form = F.col("turn").cast("string"), (F.col("turn") + F.col("conv_id")) % 9
    kinds = [(F.col("turn") + 1).cast("string"), F.concat(F.lit("Q"), n, F.lit("b")), F.char(97 + F.col("turn") % 9), F.lit("iii"), F.concat(n, F.lit(".B")), F.lit("இ"), F.lit("V"), F.concat(F.lit("q"), n)]
    qno = F.lit("VIII")
    for k, c in enumerate(kinds):
        qno = F.when(form == k, c).otherwise(qno)
    r = turns(spark, d).select("conv_id", "turn", qno.alias("qno"))
    return r.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy(records.sort_key(F.col("qno")), "turn")))


# Recognised lines: numbers stand before the texts of turns, as no text here starts with one


def numbered(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.concat_ws(" ", forms(), text.clean_line(F.col("text"))).alias("line"))


NUMBERED = f"n AS (SELECT conv_id, turn, concat_ws(' ', {FORMS}, {cleaned('text')}) AS line FROM conversations)"


@query(f"WITH {NUMBERED}, m AS (SELECT *, {ANSWER_TOKEN} AS token FROM n) SELECT conv_id, turn, {ANSWER_QNO} AS qno, {ANSWER_REST} AS rest FROM m")
def answer_number(spark, d):
    return numbered(spark, d).withColumn("n", sheets.answer_number(F.col("line"))).select("conv_id", "turn", "n.qno", "n.rest")


@query(f"""WITH {NUMBERED}, m AS (SELECT *, {PAPER_TOKEN} AS token FROM n)
SELECT conv_id, turn, {PAPER_QNO} AS qno, {PAPER_REST} AS rest, token = '' AND regexp_matches(line, '^[\\p{{Ll}}\\x{{0B80}}-\\x{{0BFF}}(]') AS continues FROM m""")
def paper_number(spark, d):
    return numbered(spark, d).withColumn("n", sheets.paper_number(F.col("line"))).select("conv_id", "turn", "n.qno", "n.rest", sheets.continues(F.col("line")).alias("continues"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {NOISY}) AS n_noise FROM k GROUP BY doc_id")
def noise_lines(spark, d):
    rows = records.lines(t(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(sheets.is_noise(F.col("line"))).alias("n_noise"))


def ordered_sql(source: str) -> str:
    """`o`: the rows of `source` with the parts of their number's sort key."""
    return f"""bare AS (SELECT *, regexp_replace(qno, '^[Qq]', '') AS bare FROM {source}),
kinds AS (SELECT *, CASE WHEN regexp_full_match(bare, '[0-9]+([.\\s][a-zA-Z])?') THEN 0 WHEN regexp_full_match(bare, '[a-zA-Z]') THEN 1 WHEN lower(bare) IN ('ii', 'iii', 'iv', 'vi', 'vii', 'viii') THEN 2 WHEN instr('{records.TAMIL_PARTS}', bare) > 0 THEN 3 ELSE 4 END AS kind FROM bare),
o AS (SELECT *, CASE kind WHEN 0 THEN CAST(regexp_extract(bare, '^[0-9]+') AS BIGINT) WHEN 2 THEN list_position(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii'], lower(bare)) WHEN 3 THEN instr('{records.TAMIL_PARTS}', bare) ELSE 0 END AS number,
 CASE kind WHEN 0 THEN ascii(lower(regexp_extract(bare, '[a-zA-Z]$'))) WHEN 1 THEN ascii(lower(bare)) ELSE 0 END AS letter, CASE kind WHEN 4 THEN bare ELSE '' END AS other FROM kinds)"""


SHEET_LINES = ENDS.replace("text", "sheet", 1)


@query(f"""WITH sheets AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN concat_ws(' ', {FORMS}, text) ELSE text END || CASE WHEN turn % 3 = 1 THEN chr(10) || 'Page ' || turn ELSE '' END, chr(10) ORDER BY turn) AS sheet FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, pos, {cleaned('line')} AS line FROM (SELECT conv_id, unnest({SHEET_LINES}) AS line, generate_subscripts({SHEET_LINES}, 1) AS pos FROM sheets)),
m AS (SELECT *, {ANSWER_TOKEN} AS token FROM l WHERE line <> '' AND NOT {NOISY}), n AS (SELECT conv_id, pos, line, {ANSWER_QNO} AS qno, {ANSWER_REST} AS rest FROM m),
b AS (SELECT *, count(qno) OVER (PARTITION BY conv_id ORDER BY pos) AS block, CASE WHEN qno IS NOT NULL THEN rest WHEN length(line) >= 2 THEN line ELSE '' END AS part FROM n),
g AS (SELECT conv_id, block, min(qno) AS qno, {trimmed(f"regexp_replace(coalesce(string_agg(part, ' ' ORDER BY pos) FILTER (WHERE part <> ''), ''), '{SPACE}{{2,}}', ' ', 'g')")} AS answer FROM b WHERE block > 0 GROUP BY conv_id, block),
merged AS (SELECT conv_id, qno, coalesce(string_agg(answer, ' ' ORDER BY block) FILTER (WHERE answer <> ''), '') AS answer, min(block) AS pos FROM g GROUP BY conv_id, qno),
whole AS (SELECT conv_id, CAST(qno AS INT) AS v FROM merged WHERE regexp_full_match(qno, '[0-9]+')),
gaps AS (SELECT conv_id, v FROM (SELECT conv_id, unnest(generate_series(min(v), max(v))) AS v FROM whole GROUP BY conv_id) ANTI JOIN whole USING (conv_id, v)),
every AS (SELECT * FROM merged UNION ALL SELECT conv_id, CAST(v AS VARCHAR), '', 1000000 + v FROM gaps), {ordered_sql('every')}
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY kind, number, letter, other, pos) AS INT) AS place, qno, answer FROM o""")
def extracted_answers(spark, d):
    """Each conversation as an answer sheet, user turns starting with a number and noise lines between: its answers in order."""
    line = F.when(F.col("role") == "user", F.concat_ws(" ", forms(), "text")).otherwise(F.col("text"))
    noise = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("\nPage "), F.col("turn").cast("string"))).otherwise("")
    rows = turns(spark, d).select("conv_id", "turn", F.concat(line, noise).alias("line"))
    sheets_ = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("sheet"))
    return records.extracted_answers(sheets_, "conv_id", "sheet")


@query()
def split_blocks(spark, d):
    """The numbered blocks of each document, each split in question and answer; without numbers, all of it is the answer of 1."""
    docs = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select("doc_id", "text", F.posexplode_outer(sheets.sheet_blocks(F.col("text"))).alias("pos", "b")).withColumn("s", sheets.split_block(F.col("b.block")))
    none, whole = F.col("pos").isNull(), text.collapse(F.col("text"))
    return found.select("doc_id", F.coalesce("pos", F.lit(0)).alias("block"), F.when(none, "1").otherwise(F.col("b.qno")).alias("qno"), F.when(none, "").otherwise(F.col("s.question")).alias("question"), F.when(none, whole).otherwise(F.col("s.answer")).alias("answer"))


@query()
def repaired_text(spark, d):
    return t(spark, d, "documents").select("doc_id", sheets.repaired(F.col("text")).alias("repaired"))


def sounded_sql(c: str) -> str:
    """The phonetic form in SQL, which has no look-ahead: the vowel a is put after every consonant, then signs and viramas take it away."""
    letters = "".join(sheets.CONSONANTS)
    out = c
    for two, one in sheets.TWO_MARKS.items():
        out = f"replace({out}, '{two}', '{one}')"
    out = f"regexp_replace({out}, '([{letters}])', '\\1a', 'g')"
    out = f"regexp_replace(regexp_replace({out}, 'a{sheets.VIRAMA}', '', 'g'), 'a([{''.join(sheets.SIGNS)}])', '\\1', 'g')"
    for letter, latin in (sheets.CONSONANTS | sheets.VOWELS | sheets.SIGNS).items():
        out = f"replace({out}, '{letter}', '{latin}')"
    return out


TAMIL_WORDS = [*sheets.ROMANISED.values(), *sheets.QUESTION_WORDS]
TAMIL_LIST = "[" + ", ".join(f"'{w}'" for w in TAMIL_WORDS) + "]"


@query(f"SELECT doc_id, {sounded_sql(f"text || ' ' || ({TAMIL_LIST})[CAST(doc_id % {len(TAMIL_WORDS)} + 1 AS INT)]")} AS sounds FROM documents")
def phonetic_form(spark, d):
    """Each document, with a Tamil word after it (the texts have none), in its phonetic form."""
    word = F.get(F.array(*map(F.lit, TAMIL_WORDS)), (F.col("doc_id") % len(TAMIL_WORDS)).cast("int"))
    return t(spark, d, "documents").select("doc_id", sheets.phonetic(F.concat("text", F.lit(" "), word)).alias("sounds"))


# Joins

PAIRS = """q AS (SELECT conv_id, turn AS qno, text AS question, turn AS pos FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS qno, text AS answer, turn AS pos FROM conversations WHERE role <> 'user')"""


def _pairs(spark, d):
    c = turns(spark, d)
    q = c.where("role = 'user'").select("conv_id", F.col("turn").alias("qno"), F.col("text").alias("question"), F.col("turn").alias("pos"))
    a = c.where("role != 'user'").select("conv_id", (F.col("turn") - 1).alias("qno"), F.col("text").alias("answer"), F.col("turn").alias("pos"))
    return q, a


OUTER = f"""WITH {PAIRS}, m AS (SELECT conv_id, qno, coalesce(question, '') AS question, coalesce(answer, '') AS answer,
 CASE WHEN q.pos IS NULL THEN 'invalid' WHEN coalesce(answer, '') <> '' THEN 'attempted' ELSE 'unattempted' END AS status,
 CASE WHEN q.pos IS NULL THEN 1 ELSE 0 END AS side, coalesce(q.pos, a.pos) AS pos FROM q FULL JOIN a USING (conv_id, qno))"""


@query(OUTER + " SELECT * FROM m")
def qa_full_outer(spark, d):
    return records.question_answers(*_pairs(spark, d), ["conv_id", "qno"])


@query(OUTER + " SELECT conv_id, qno, question, answer, status FROM m WHERE side = 0")
def qa_left(spark, d):
    q, a = _pairs(spark, d)
    j = q.join(a.drop("pos"), ["conv_id", "qno"], "left")
    return j.select("conv_id", "qno", "question", F.coalesce("answer", F.lit("")).alias("answer"), F.when(F.coalesce("answer", F.lit("")) != "", "attempted").otherwise("unattempted").alias("status"))


@query(f"WITH {PAIRS} SELECT conv_id, qno, answer FROM a ANTI JOIN q USING (conv_id, qno)")
def qa_orphans(spark, d):
    q, a = _pairs(spark, d)
    return a.join(q, ["conv_id", "qno"], "left_anti").select("conv_id", "qno", "answer")


@query(OUTER + " SELECT status, count(*) AS n FROM m GROUP BY status")
def mapping_counts(spark, d):
    return qa_full_outer(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT b.item_id, b.text AS question, d.doc_id, d.text AS answer FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id + 1")
def positional_join(spark, d):
    b, docs = t(spark, d, "benchmark"), t(spark, d, "documents").select("doc_id", F.col("text").alias("answer"))
    return b.select("item_id", F.col("text").alias("question"), (F.col("item_id") + 1).alias("doc_id0")).join(docs, F.col("doc_id0") == F.col("doc_id"), "left").select("item_id", "question", "doc_id", "answer")


@query(f"""WITH k AS (SELECT doc_id, {KEY} AS key FROM documents WHERE text <> '') SELECT q.doc_id AS q_id, min(b.doc_id) AS bank_pos FROM k q JOIN k b USING (key) GROUP BY q.doc_id""")
def exact_bank_match(spark, d):
    docs = spread(t(spark, d, "documents").select("doc_id", "text"))
    return match.exact(docs.select(F.col("doc_id").alias("q_id"), F.col("text").alias("question")), docs.select(F.col("doc_id").alias("bank_pos"), F.col("text").alias("question")))


NEAREST = """WITH p AS (SELECT q.vec_id AS q_id, b.vec_id AS bank_pos, round(list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
 FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER w AS k, lead(score, 1, 0.0) OVER w AS second FROM p WINDOW w AS (PARTITION BY q_id ORDER BY score DESC, bank_pos))"""


def _nearest(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = match.nearest(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q_id"), v.withColumnRenamed("vec_id", "bank_pos"))
    return n.withColumn("score", F.round("score", 6)).withColumn("second", F.round("second", 6))


@query(NEAREST + " SELECT q_id, bank_pos, score FROM r WHERE k = 1 AND score >= 0.35")
def nn_top1(spark, d):
    return _nearest(spark, d).where("score >= 0.35").select("q_id", "bank_pos", "score")


@query(NEAREST + " SELECT q_id, bank_pos, score, second, CASE WHEN score < 0.35 THEN 'below' WHEN score - second < 0.03 THEN 'ambiguous' ELSE 'accepted' END AS verdict FROM r WHERE k = 1")
def nn_margin(spark, d):
    return match.with_margin(_nearest(spark, d), 0.35, 0.03)


# Scores


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 6)) AS kws FROM benchmark),
k AS (SELECT item_id, unnest(kws) AS kw FROM w), c AS (SELECT doc_id, lower(text) AS body FROM documents)
SELECT item_id, doc_id, count(*) AS n_keywords, count(*) FILTER (WHERE contains(body, kw)) AS n_found FROM k, c GROUP BY item_id, doc_id HAVING count(*) FILTER (WHERE contains(body, kw)) > 0""")
def keyword_coverage(spark, d):
    b = t(spark, d, "benchmark").select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 6)).alias("kws"))
    docs = spread(t(spark, d, "documents").select("doc_id", "text"))
    return match.coverage(docs.select("doc_id", F.lower("text").alias("body")), b)


def _graded(spark, d):
    """Documents as answers to benchmark questions (item = doc_id modulo their number), with the ratios of all keywords."""
    n = t(spark, d, "benchmark").count()
    b = t(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 6)).alias("keywords"))
    docs = spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.preprocess(F.col("text")).alias("answer"), (F.col("doc_id") % n).alias("item"))
    return docs.join(b, "item").withColumn("found", fuzzy.ratios("keywords", "answer"))


@query()
def fuzzy_keywords(spark, d):
    g = _graded(spark, d)
    ones = F.transform("keywords", lambda x: F.lit(1.0))
    return g.select("doc_id", F.round(fuzzy.keyword_score(ones, F.col("found")), 2).alias("keyword_score"), F.array_join(fuzzy.matched(F.col("keywords"), F.col("found")), ", ").alias("matched"), F.array_join(fuzzy.missing(F.col("keywords"), F.col("found")), ", ").alias("missing"))


@query()
def concept_score(spark, d):
    g = _graded(spark, d).withColumn("concepts", F.transform("keywords", lambda x: F.array(x, F.substring(x, 1, 5))))
    return g.withColumn("flags", fuzzy.covered("concepts", "answer")).select("doc_id", F.round(fuzzy.concept_score(F.col("flags")), 2).alias("concept_score"))


INPUTS = "SELECT l_orderkey, l_linenumber, l_quantity / 5 AS sem, l_discount * 100 AS kw, l_tax * 125 AS con, l_discount AS ctr, CAST(l_quantity AS INT) AS words, 5 AS most FROM lineitem"
FORMULA = f"""WITH i AS ({INPUTS}), f AS (SELECT *, CASE WHEN words <= 0 THEN 0.0 ELSE least(1.0::DOUBLE, words / (0.35::DOUBLE * 15 * greatest(most, 1))) END AS factor,
 greatest(0.0::DOUBLE, least(10.0::DOUBLE, (0.5::DOUBLE * sem + 0.25::DOUBLE * kw + 0.25::DOUBLE * con) * (1 - 0.5::DOUBLE * ctr))) AS raw FROM i),
a AS (SELECT *, CASE WHEN factor < 1 THEN 0.85::DOUBLE + 0.15::DOUBLE * factor ELSE 1.0::DOUBLE END AS adjustment FROM f),
m AS (SELECT *, CASE WHEN words < 3 OR sem / 10 < 0.2::DOUBLE THEN 0.0::DOUBLE WHEN sem / 10 < 0.35::DOUBLE THEN least(raw * adjustment, 2.0::DOUBLE) ELSE raw * adjustment END AS marks FROM a)"""


def _scored(spark, d):
    i = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 5).alias("sem"), (F.col("l_discount") * 100).alias("kw"), (F.col("l_tax") * 125).alias("con"), F.col("l_discount").alias("ctr"), F.col("l_quantity").cast("int").alias("words"), F.lit(5).alias("most"))
    i = i.withColumn("factor", scoring.length_factor(F.col("words"), F.col("most"))).withColumn("raw", scoring.raw_score(F.col("sem"), F.col("kw"), F.col("con"), F.col("ctr")))
    i = i.withColumn("adjustment", scoring.length_adjustment(F.col("factor")))
    return i.withColumn("marks", scoring.banded_marks(F.col("raw"), F.col("adjustment"), scoring.band(F.col("sem") / 10, F.col("words"))))


@query(FORMULA + " SELECT l_orderkey, l_linenumber, round(factor, 6) AS factor, round(adjustment, 6) AS adjustment FROM m")
def length_factor(spark, d):
    return _scored(spark, d).select("l_orderkey", "l_linenumber", F.round("factor", 6).alias("factor"), F.round("adjustment", 6).alias("adjustment"))


@query(FORMULA + " SELECT l_orderkey, l_linenumber, raw, marks, least(marks * most / 10, most) AS final FROM m")
def score_formula(spark, d):
    s = _scored(spark, d)
    return s.select("l_orderkey", "l_linenumber", "raw", "marks", scoring.scaled(F.col("marks"), F.col("most")).alias("final"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4 * 2, 0) / 2 AS rounded FROM lineitem")
def half_step(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scoring.half_step(F.col("l_quantity") / 4).alias("rounded"))


@query(NEAREST + " SELECT q_id, CASE WHEN score < 0.2 THEN 'irrelevant' WHEN score < 0.35 THEN 'partial' ELSE 'relevant' END AS band, count(*) AS n FROM p GROUP BY ALL")
def relevance_band(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vector"))
    return match.bands(v.where("q_id % 20 = 0"), v.withColumnRenamed("q_id", "bank_pos"))


@query(FORMULA + """, b AS (SELECT *, CASE WHEN kw < 1 THEN 'irrelevant' WHEN kw < 2 THEN 'partial' ELSE 'relevant' END AS band FROM m)
SELECT l_orderkey, l_linenumber, CASE WHEN band = 'irrelevant' THEN 'The answer isn''t about the question.' WHEN band = 'partial' THEN 'The answer is about the question in part only.'
 ELSE coalesce(nullif(concat_ws('; ', CASE WHEN factor < 0.35 THEN 'The answer is too short.' END, CASE WHEN sem < 6 THEN 'The meaning differs from the model answer.' END,
 CASE WHEN sem / 10 < 0.45 THEN 'The match with the model answer is uncertain.' END), ''), 'Good answer.') END AS feedback FROM b""")
def feedback_list(spark, d):
    none = F.array().cast("array<string>")
    s = _scored(spark, d).withColumn("band", F.when(F.col("kw") < 1, "irrelevant").when(F.col("kw") < 2, "partial").otherwise("relevant"))
    lines = scoring.feedback(F.col("band"), F.col("ctr"), F.col("factor"), F.col("sem"), F.col("sem") / 10, none, none, F.lit(0))
    return s.select("l_orderkey", "l_linenumber", F.array_join(lines, "; ").alias("feedback"))


# Reports


@query("""SELECT o_custkey, round(sum(l_quantity), 2) AS total, sum(50.0::DOUBLE) AS max_total, round(100 * sum(l_quantity) / sum(50.0::DOUBLE), 2) AS percentage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def report_totals(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = j.groupBy("o_custkey").agg(F.sum("l_quantity").alias("total"), F.sum(F.lit(50.0)).alias("max_total"))
    return a.select("o_custkey", F.round("total", 2).alias("total"), "max_total", F.round(scoring.percentage(F.col("total"), F.col("max_total")), 2).alias("percentage"))


GRADES = f"g AS (SELECT doc_id, quality, least(10.0, {COUNT} / 50.0)::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def _grades(spark, d):
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return j.select("doc_id", "quality", F.least(F.lit(10.0), text.word_count(F.col("text")) / 50.0).alias("score"))


@query(f"WITH {GRADES} SELECT round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high, round(stddev_pop(score), 6) AS deviation, count(*) FILTER (WHERE score < 2) AS n_irrelevant, count(*) AS n FROM g")
def summary_stats(spark, d):
    return _grades(spark, d).agg(F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.stddev_pop("score"), 6).alias("deviation"), F.count_if(F.col("score") < 2).alias("n_irrelevant"), F.count("*").alias("n"))


@query(f"WITH {GRADES} SELECT round(avg(quality * 10.0::DOUBLE), 6) AS expected, round(avg(abs(score - quality * 10.0::DOUBLE)), 6) AS mae, round(sqrt(avg((score - quality * 10.0::DOUBLE) * (score - quality * 10.0::DOUBLE))), 6) AS rmse, count(*) AS n FROM g WHERE quality IS NOT NULL")
def accuracy_metrics(spark, d):
    e = F.col("score") - F.col("quality") * 10.0
    return _grades(spark, d).where("quality IS NOT NULL").agg(F.round(F.avg(F.col("quality") * 10.0), 6).alias("expected"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.count("*").alias("n"))


STATES = "SELECT conv_id, sum(length(text)) AS total, count(*) FILTER (WHERE role = 'user') AS n_evaluated, count(*) FILTER (WHERE role = 'assistant') AS n_no_answer, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS n_skipped FROM conversations GROUP BY conv_id"


@query(STATES.replace("sum(length(text))", "CAST(sum(length(text)) AS BIGINT)"))
def pipeline_totals(spark, d):
    """Totals and counts of states by sheet: roles stand for states, lengths for marks."""
    role = F.col("role")
    return turns(spark, d).groupBy("conv_id").agg(F.sum(F.length("text")).alias("total"), F.count_if(role == "user").alias("n_evaluated"), F.count_if(role == "assistant").alias("n_no_answer"), F.count_if(~role.isin("user", "assistant")).alias("n_skipped"))


@query("SELECT user_id, round(avg(value), 4) AS confidence FROM events WHERE value <> 0 GROUP BY user_id")
def page_confidence(spark, d):
    return t(spark, d, "events").where("value != 0").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("confidence"))


@query("SELECT s AS subject, m AS medium, s IN ('tamil', 'english') AS is_language FROM (VALUES ('tamil'), ('english'), ('science'), ('social'), ('maths')) a(s), (VALUES ('tamil'), ('english')) b(m) WHERE s NOT IN ('tamil', 'english') OR s = m")
def subject_inventory(spark, d):
    s = spark.createDataFrame([(x,) for x in ("tamil", "english", "science", "social", "maths")], "subject string")
    m = spark.createDataFrame([(x,) for x in ("tamil", "english")], "medium string")
    language = F.col("subject").isin("tamil", "english")
    return s.crossJoin(F.broadcast(m)).where(~language | (F.col("subject") == F.col("medium"))).withColumn("is_language", language)


@query()
def score_answers(spark, d):
    """The flagship: documents as answers to bank questions; keyword ratios, length and score, marks in halves, feedback.

    The keyword score stands for the semantic one too, so a tenth of it is the confidence: below 0.20, or with under three
    words, an answer gets no marks, and up to 0.35 it gets 2.0 of ten at most."""
    g = _graded(spark, d)
    ones = F.transform("keywords", lambda x: F.lit(1.0))
    g = g.withColumn("words", text.word_count(F.col("answer"))).withColumn("keyword", F.round(fuzzy.keyword_score(ones, F.col("found")), 2)).withColumn("factor", scoring.length_factor(F.col("words"), F.lit(5)))
    g = g.withColumn("band", scoring.band(F.col("keyword") / 10, F.col("words"))).withColumn("keyword", F.when(F.col("band") == "empty", 0.0).otherwise(F.col("keyword")))
    raw = scoring.raw_score(F.col("keyword"), F.col("keyword"), F.lit(0.0), F.lit(0.0))
    g = g.withColumn("raw", F.when(scoring.no_marks(F.col("band")), 0.0).otherwise(raw)).withColumn("marks", scoring.banded_marks(F.col("raw"), scoring.length_adjustment(F.col("factor")), F.col("band")))
    none = F.array().cast("array<string>")
    lines = scoring.feedback(F.col("band"), F.lit(0.0), F.col("factor"), F.col("keyword"), F.col("keyword") / 10, none, fuzzy.missing(F.col("keywords"), F.col("found")), F.size("keywords"))
    return g.select("doc_id", "item", "keyword", F.round("raw", 4).alias("raw"), F.round("marks", 2).alias("marks"), scoring.half_step(scoring.scaled(F.col("marks"), F.lit(5))).alias("rounded"), F.array_join(lines, "; ").alias("feedback"))


@query(f"SELECT conv_id, turn, {collapsed("regexp_replace(text || ' (' || turn || ' Marks) and [' || turn || ']', '(?i)[(\\[] *[0-9]+ *(marks?)? *[)\\]]', ' ', 'g')")} AS stripped FROM conversations")
def stripped_marks(spark, d):
    n = F.col("turn").cast("string")
    return turns(spark, d).select("conv_id", "turn", text.strip_marks(F.concat("text", F.lit(" ("), n, F.lit(" Marks) and ["), n, F.lit("]"))).alias("stripped"))


@query("SELECT doc_id, CASE WHEN length(text) > 122 THEN substr(text, 1, 120) || ' …' ELSE text END AS shown FROM documents")
def shown_text(spark, d):
    return t(spark, d, "documents").select("doc_id", text.truncate(F.col("text")).alias("shown"))


@query("SELECT p_partkey, regexp_replace(p_name || '/' || p_type, '[^a-zA-Z0-9_\\-]', '_', 'g') AS name FROM part")
def safe_names(spark, d):
    return t(spark, d, "part").select("p_partkey", text.safe_name(F.concat_ws("/", "p_name", "p_type")).alias("name"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.75 THEN 'High' WHEN l_discount * 10 >= 0.45 THEN 'Medium' ELSE 'Low' END AS label FROM lineitem")
def confidence_labels(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scoring.confidence_label(F.col("l_discount") * 10).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS semantic, CASE WHEN l_linenumber > 3 THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS keyword,
round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, l_quantity / 4 * (0.8::DOUBLE + 0.2::DOUBLE * l_discount * 10))), 6) AS adjusted FROM lineitem""")
def older_formula(spark, d):
    w = scoring.older_weights(F.col("l_linenumber") + 5)
    adjusted = scoring.confidence_adjustment(F.col("l_quantity") / 4, F.col("l_discount") * 10)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", w[0].alias("semantic"), w[1].alias("keyword"), F.round(adjusted, 6).alias("adjusted"))


@query(f"SELECT d.doc_id, round(least(10.0, {COUNT} / 50.0)::DOUBLE - quality * 10.0::DOUBLE, 2) AS error FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def answer_errors(spark, d):
    """What an answer's score is above what was expected; null where nothing was."""
    score = F.least(F.lit(10.0), text.word_count(F.col("text")) / 50.0)
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.round(score - F.col("quality") * 10.0, 2).alias("error"))


@query("""WITH c AS (SELECT *, CASE WHEN turn % 4 <> 3 THEN CAST(turn % 4 AS VARCHAR) END AS qno FROM conversations WHERE turn % 4 <> 3),
q AS (SELECT conv_id, qno, arg_min(trim(text), turn) AS question, min(turn) AS pos FROM c WHERE role = 'user' GROUP BY ALL),
a AS (SELECT conv_id, qno, coalesce(string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE trim(text) <> ''), '') AS answer, min(turn) AS pos FROM c WHERE role <> 'user' GROUP BY ALL)
SELECT conv_id, qno, coalesce(question, '') AS question, coalesce(answer, '') AS answer, CASE WHEN q.pos IS NULL THEN 'invalid' WHEN coalesce(answer, '') <> '' THEN 'attempted' ELSE 'unattempted' END AS status,
CASE WHEN q.pos IS NULL THEN 1 ELSE 0 END AS side, coalesce(q.pos, a.pos) AS pos FROM q FULL JOIN a USING (conv_id, qno)""")
def mapped_records(spark, d):
    """Questions and answers matched by numbers in their one form, repeats and rows without a number included."""
    n = F.when(F.col("turn") % 4 == 3, "").otherwise(F.concat(F.lit("0"), (F.col("turn") % 4).cast("string"), F.lit(".")))
    c = turns(spark, d).withColumn("n", n)
    q = c.where("role = 'user'").select("conv_id", F.col("n").alias("qno"), F.col("text").alias("question"), F.col("turn").alias("pos"))
    answer_no = F.when(F.col("n") == "", "").otherwise(F.concat(F.lit("("), (F.col("turn") % 4).cast("string"), F.lit(")")))
    return records.mapped(q, c.where("role != 'user'").select("conv_id", answer_no.alias("qno"), F.col("text").alias("answer"), F.col("turn").alias("pos")), "conv_id")


@query(f"""WITH v AS (SELECT doc_id, text, {KEY} AS key, embedding::DOUBLE[] AS e, {PREPROCESSED} <> '' AS says FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
same AS (SELECT q.doc_id AS q_id, min(b.doc_id) AS bank_pos FROM v q JOIN v b ON q.key = b.key AND q.doc_id <> b.doc_id WHERE q.doc_id % 20 = 0 AND q.text <> '' AND b.text <> '' GROUP BY q.doc_id),
rest AS (SELECT doc_id AS q_id, e, says FROM v WHERE doc_id % 20 = 0 AND doc_id NOT IN (SELECT q_id FROM same)),
p AS (SELECT q_id, b.doc_id AS bank_pos, list_dot_product(q.e, b.e) AS score FROM rest q, v b WHERE q.e IS NOT NULL AND b.e IS NOT NULL AND q.says AND b.says AND b.doc_id <> q_id),
r AS (SELECT *, row_number() OVER w AS k, lead(score, 1, 0.0) OVER w AS second FROM p WINDOW w AS (PARTITION BY q_id ORDER BY score DESC, bank_pos)),
n AS (SELECT *, score >= 0.75 AND score - second >= 0.08 AS taken FROM r WHERE k = 1)
SELECT q_id, bank_pos, 1.0::DOUBLE AS score, 'exact' AS how FROM same UNION ALL
SELECT q_id, CASE WHEN taken THEN bank_pos END, round(score, 6), CASE WHEN taken THEN 'nearest' ELSE 'none' END FROM rest LEFT JOIN n USING (q_id)""")
def bank_match(spark, d):
    """Every document whose id is divisible by 20 against all others: by equal text, else by the nearest vector (some have none)."""
    docs = match.keyed(spread(t(spark, d, "documents").select("doc_id", F.col("text").alias("question"))))
    v = docs.join(t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    found = match.keyed_match(v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "q_id"), v.withColumnRenamed("doc_id", "bank_pos"), others=True)
    return found.withColumn("score", F.round("score", 6))


def _asked(spark, d):
    """Documents (doc_id, answer, item), and model answers (item, model_answer): a document's question is its number modulo theirs."""
    b = t(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("model_answer"))
    return spread(t(spark, d, "documents").select("doc_id", F.col("text").alias("answer"), F.pmod("doc_id", F.lit(b.count())).alias("item"))), b


@query(f"""WITH a AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item, {PREPROCESSED} AS c FROM documents), m AS (SELECT item_id AS item, {PREPROCESSED} AS c FROM benchmark),
w AS (SELECT 0 AS side, doc_id AS id, md5(unnest(list_filter(string_split(c, ' '), lambda x: x <> ''))) AS h FROM a UNION ALL SELECT 1, item, md5(unnest(list_filter(string_split(c, ' '), lambda x: x <> ''))) FROM m),
v AS (SELECT side, id, h[1:2] AS at, CAST(sum(CASE WHEN ('0x' || h[3])::INT % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM w GROUP BY ALL HAVING v <> 0),
n AS (SELECT side, id, sqrt(sum(v * v)) AS norm FROM v GROUP BY ALL),
p AS (SELECT a.doc_id, sum(x.v * y.v) AS dot FROM a JOIN v x ON x.side = 0 AND x.id = a.doc_id JOIN v y ON y.side = 1 AND y.id = a.item AND y.at = x.at GROUP BY a.doc_id),
s AS (SELECT a.doc_id, a.item, CASE WHEN x.norm IS NOT NULL AND y.norm IS NOT NULL THEN coalesce(dot, 0) / (x.norm * y.norm) END AS sim FROM a LEFT JOIN p USING (doc_id) LEFT JOIN n x ON x.side = 0 AND x.id = a.doc_id LEFT JOIN n y ON y.side = 1 AND y.id = a.item)
SELECT doc_id, item, round(sim, 6) AS similarity, round(10 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, sim)), 4) + 0.0::DOUBLE AS semantic, CASE WHEN sim IS NULL THEN 'unevaluable' WHEN sim < 0.2 THEN 'irrelevant' WHEN sim < 0.35 THEN 'partial' ELSE 'relevant' END AS band FROM s""")
def semantic_scores(spark, d):
    """The similarity of each document with the model answer of its question, from their texts; scores of ten and bands."""
    docs, b = _asked(spark, d)
    found, sim = vectors.similarities(docs, "doc_id", "answer", b, "item", "model_answer"), F.col("similarity")
    return docs.select("doc_id", "item").join(found, "doc_id").select("doc_id", "item", F.round(sim, 6).alias("similarity"), F.round(10 * scoring.clamp(sim, 0.0, 1.0), 4).alias("semantic"), scoring.relevance(sim).alias("band"))


@query()
def evaluate_answers(spark, d):
    """Whole evaluations, 21 columns: documents as answers to bank questions, the similarity being that of `semantic_scores`."""
    docs, b = _asked(spark, d)
    words = F.array_distinct(F.filter(F.split(F.lower("model_answer"), " "), lambda x: F.length(x) > 6))
    b = b.select("item", "model_answer", F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(1.0).alias("weight"))).alias("keywords"), F.transform(words, lambda w: F.array(w, F.substring(w, 1, 5))).alias("concepts"))
    rows = docs.join(b, "item").select("doc_id", "item", "answer", "model_answer", "keywords", "concepts", F.lit(5).alias("max_marks"))
    out = evaluate.final(rows).drop("answer", "model_answer", "keywords", "concepts")
    first = ["doc_id", "item", "similarity", "max_marks"]
    return out.select(*first, *(c for c in out.columns if c not in first))


# Reports of whole evaluations


@query(FORMULA[: FORMULA.rindex(",\nm AS")] + """, b AS (SELECT *, CASE WHEN words < 3 THEN 'empty' WHEN sem / 10 < 0.2::DOUBLE THEN 'irrelevant' WHEN sem / 10 < 0.35::DOUBLE THEN 'partial' ELSE 'relevant' END AS band FROM a),
c AS (SELECT *, CASE WHEN band IN ('empty', 'irrelevant') THEN 0.0::DOUBLE WHEN band = 'partial' THEN least(raw * adjustment, 2.0::DOUBLE) ELSE raw * adjustment END AS banded FROM b)
SELECT l_orderkey, l_linenumber, band, banded AS marks, least(banded * most / 10, most) AS final FROM c""")
def banded_formula(spark, d):
    """The formula with the rule of relevance: no marks below a confidence of 0.20 or under three words, 2.0 at most below 0.35."""
    s = _scored(spark, d).withColumn("band", scoring.band(F.col("sem") / 10, F.col("words"))).withColumn("marks", scoring.banded_marks(F.col("raw"), F.col("adjustment"), F.col("band")))
    return s.select("l_orderkey", "l_linenumber", "band", "marks", scoring.scaled(F.col("marks"), F.col("most")).alias("final"))


@query("""WITH p AS (SELECT conv_id, 'Q' || (turn // 2) AS question_number, arg_max(text, turn) AS student_text, arg_max(length(text) % 1000 / 1000.0::DOUBLE, turn) AS sure FROM conversations WHERE role <> 'user' AND text IS NOT NULL GROUP BY ALL)
SELECT c.conv_id, c.turn, CASE WHEN turn % 3 = 0 OR text IS NULL OR text = '' THEN CASE WHEN student_text IS NULL THEN '' ELSE 'recognised' END ELSE text END AS question, coalesce(student_text, '') AS student_answer,
 round(CASE WHEN turn % 4 = 2 THEN 0.5::DOUBLE ELSE coalesce(sure, 0.0::DOUBLE) END, 4) AS ocr_confidence
FROM conversations c LEFT JOIN p ON p.conv_id = c.conv_id AND p.question_number = 'Q' || (c.turn // 2) WHERE role = 'user'""")
def enriched_details(spark, d):
    """User turns as details, some without question or confidence, which the other turns of their number fill in."""
    c = turns(spark, d).withColumn("n", F.floor(F.col("turn") / 2).cast("string"))
    own = c.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("Q"), "n").alias("question_number"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("question"), F.lit(None).cast("string").alias("student_answer"), F.when(F.col("turn") % 4 == 2, 0.5).otherwise(0.0).alias("ocr_confidence"))
    payload = c.where("role != 'user' AND text IS NOT NULL").select("conv_id", F.col("n").alias("question_number"), F.lit("recognised").alias("question"), F.col("text").alias("student_text"), (F.length("text") % 1000 / 1000).alias("ocr_confidence"), F.col("turn").alias("pos"))
    return reports.enriched(own, payload, ["conv_id"]).drop("question_number")


@query("""WITH m AS (SELECT conv_id, CASE turn % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'unattempted' ELSE 'attempted' END AS status, CASE WHEN turn % 3 <> 0 THEN turn + 1 END AS most FROM conversations),
s AS (SELECT *, CASE WHEN status = 'unattempted' THEN status WHEN most IS NULL THEN 'unevaluable' ELSE 'evaluated' END AS state FROM m WHERE status <> 'invalid')
SELECT conv_id, state, count(*) AS n, CAST(sum(CASE WHEN state = 'unevaluable' THEN 0 ELSE coalesce(most, 10) END) AS BIGINT) AS max_total FROM s GROUP BY conv_id, state""")
def state_totals(spark, d):
    """What each state of a sheet's answers adds to the maximum: invalid ones go, those without a model answer add nothing."""
    turn = F.col("turn")
    status = F.when(turn % 4 == 0, "invalid").when(turn % 4 == 1, "unattempted").otherwise("attempted")
    m = turns(spark, d).select("conv_id", status.alias("status"), F.when(turn % 3 != 0, turn + 1).alias("max_marks"))
    return reports.states(m).groupBy("conv_id", "state").agg(F.count("*").alias("n"), F.sum("counted_max").cast("long").alias("max_total"))


@query(f"SELECT doc_id, {trimmed("regexp_replace(text, '[ \\t]+', ' ', 'g')")} AS line FROM documents")
def question_text(spark, d):
    return spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.clean_question_line(F.col("text")).alias("line"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE {COUNT} > 0) AS n_with_text, count(*) FILTER (WHERE {COUNT} = 0) AS n_empty FROM documents GROUP BY lang")
def answer_counts(spark, d):
    empty = text.word_count(F.col("text")) == 0
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~empty).alias("n_with_text"), F.count_if(empty).alias("n_empty"))
