"""Words with boxes: built from the words of texts, whose places follow from their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from idsieve.operators import layout, parsers
from idsieve.plans import identity
from idsieve.plans.registry import query

# words of the conversations: ten in a row, rows 30 apart with a slight slope, two wide gaps in each
_WORDS = """WITH w AS (SELECT conv_id || '-' || turn || '-' || role AS doc_id, unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS text, generate_subscripts(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1) - 1 AS ord FROM conversations),
    words AS (SELECT doc_id, 1 AS page, ord, text, (ord * 37 % 101)::double AS confidence, (ord % 10 * 50 + CASE WHEN ord % 10 > 5 THEN 80 ELSE 0 END)::double AS x, ((ord // 10) * 30 + ord % 3)::double AS y, 40.0 AS width, 10.0 AS height FROM w WHERE text <> '')"""


def words(table):
    tokens = F.split(F.trim(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+", " ")), " ")
    rows = table("conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("doc_id"), F.posexplode(tokens).alias("ord", "text")).where("text != ''")
    o = F.col("ord")
    return rows.select("doc_id", F.lit(1).alias("page"), "ord", "text", (o * 37 % 101).cast("double").alias("confidence"), (o % 10 * 50 + F.when(o % 10 > 5, 80).otherwise(0)).cast("double").alias("x"), (F.floor(o / 10) * 30 + o % 3).cast("double").alias("y"), F.lit(40.0).alias("width"), F.lit(10.0).alias("height"))


@query(f"{_WORDS} SELECT doc_id, round_even(avg(confidence), 1) AS confidence, count(*) AS tokens_detected, count_if(confidence < 70) AS tokens_requiring_review FROM words GROUP BY 1")
def word_metrics(table):
    return layout.word_metrics(words(table))


@query(f"{_WORDS} SELECT doc_id, ord, (ord // 10) AS row FROM words")
def visual_rows(table):
    return layout.visual_rows(layout.boxed(words(table))).select("doc_id", "ord", "row")


@query(
    f"""{_WORDS}, s AS (SELECT doc_id, ord // 10 AS row, (ord % 10 > 5)::int + 1 AS segment, string_agg(text, '' ORDER BY x, ord) AS text, min(x) AS x, min(y) AS y, max(x + width) AS x2, max(y + height) AS y2 FROM words GROUP BY 1, 2, 3)
    SELECT doc_id, row, segment, text, x, y, x2, y2 FROM s WHERE length(text) >= 12"""
)
def row_segments(table):
    return layout.segments(layout.visual_rows(layout.boxed(words(table)))).select("doc_id", "row", "segment", "text", "x", "y", "x2", "y2")


@query(f"{_WORDS} SELECT doc_id, ord, text FROM words QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, ord DESC) <= 4")
def lowest_four(table):
    return layout.lowest_rows(words(table), 4).select("doc_id", "ord", "text")


def form_words(table):
    """A page for each order: six labels in two columns, each with its value below or to the right."""
    k = F.col("o_orderkey")
    number = F.concat(F.lit("K"), F.lpad(k.cast("string"), 7, "0"))
    below = [("Passport Number", 0, 0, number, 0, 25), ("Entries", 300, 0, F.when(k % 2 == 0, "M").otherwise("S"), 300, 25), ("Issue Date", 0, 100, F.upper(F.date_format("o_orderdate", "dd MMM yyyy")), 0, 125)]
    right = [("Nationality", 0, 200, F.lit("UTO"), 120, 200), ("Sex", 300, 200, F.when(k % 3 == 0, "F").otherwise("?"), 350, 200), ("Control Number", 0, 300, (1000000000000 + k).cast("string"), 180, 300)]
    pieces = []
    for label, x, y, value, vx, vy in below + right:
        pieces += [F.struct(F.lit(label).alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")), F.struct(value.alias("text"), F.lit(float(vx)).alias("x"), F.lit(float(vy)).alias("y"))]
    cells = table("orders").select(k.alias("doc_id"), F.posexplode(F.array(*pieces)).alias("cell", "c"))
    tokens = cells.select("doc_id", "cell", "c.x", "c.y", F.posexplode(F.split("c.text", " ")).alias("n", "text"))
    return tokens.select("doc_id", F.lit(1).alias("page"), (F.col("cell") * 10 + F.col("n")).alias("ord"), "text", F.lit(90.0).alias("confidence"), (F.col("x") + F.col("n") * 45).alias("x"), "y", F.lit(40.0).alias("width"), F.lit(12.0).alias("height"))


@query(
    """WITH v AS (SELECT o_orderkey AS doc_id, 'passport_number' AS field, 'K' || lpad(o_orderkey::varchar, 7, '0') AS value FROM orders UNION ALL SELECT o_orderkey, 'entries', CASE WHEN o_orderkey % 2 = 0 THEN 'MULTIPLE' ELSE 'SINGLE' END FROM orders
    UNION ALL SELECT o_orderkey, 'issue_date', strftime(o_orderdate, '%d/%m/%Y') FROM orders UNION ALL SELECT o_orderkey, 'nationality', 'UTO' FROM orders UNION ALL SELECT o_orderkey, 'gender', CASE WHEN o_orderkey % 3 = 0 THEN 'F' END FROM orders
    UNION ALL SELECT o_orderkey, 'control_number', (1000000000000 + o_orderkey)::varchar FROM orders) SELECT doc_id, field, CASE WHEN field = 'passport_number' AND doc_id % 8 = 7 THEN NULL ELSE value END AS value FROM v"""
)
def labelled_values(table):
    """Of every fourth order the passport number's letter was not read; the text tells it, unless it has two such numbers."""
    k = F.col("doc_id")
    cut = F.when((k % 4 == 3) & F.col("text").rlike("^K[0-9]{7}$"), F.substring("text", 2, 7)).otherwise(F.col("text"))
    rows = layout.visual_rows(layout.boxed(form_words(table).withColumn("text", cut)))
    number = F.lpad(F.col("o_orderkey").cast("string"), 7, "0")
    texts = table("orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("VISA no K"), number, F.when(F.col("o_orderkey") % 8 == 7, F.concat(F.lit(" or L"), number)).otherwise("")).alias("text"))
    return layout.labelled_values(rows, layout.VISA_LABELS, parsers.field_value, texts)


@query(
    f"""{identity._LINE} SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 > 0 OR {identity.sql_check_digit('expiry')} = '9' THEN line2 END AS line2 FROM line WHERE o_orderkey % 5 > 0 OR {identity.sql_check_digit('expiry')} = '9'"""
)
def machine_line_pairs(table):
    """Three rows a page: a heading, line 1 and line 2 with blanks between; only pairs that verify come out."""
    lines = identity.lines(table).select(F.col("o_orderkey").alias("doc_id"), "line2")
    spaced = F.concat_ws(" ", F.substring("line2", 1, 20), F.substring("line2", 21, 24))
    rows = lines.select("doc_id", F.posexplode(F.array(F.lit("REPUBLIC OF UTOPIA"), F.lit(identity._NAME_LINE), spaced)).alias("ord", "text"))
    rows = rows.select("doc_id", F.lit(1).alias("page"), "ord", "text", (F.lit(20.0) + F.col("ord") * 3).alias("x"), (F.lit(500.0) + F.col("ord") * 40).alias("y"))
    return layout.machine_pairs(rows).select("doc_id", "line2")


_REGION_ROWS = """WITH o AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 1 THEN 1000.0 ELSE 600.0 END::double AS h, 40 + o_orderkey % 4 * 50 AS gap, o_orderkey % 10 = 0 AS brief FROM orders),
    r AS (SELECT doc_id, h, unnest([{'ord': 0, 'n': 30, 'x': 20, 'y': 100.0}, {'ord': 1, 'n': CASE WHEN brief THEN 12 ELSE 44 END, 'x': 20, 'y': h / 2}, {'ord': 2, 'n': 44, 'x': 23, 'y': h / 2 + gap}, {'ord': 3, 'n': 25, 'x': 90, 'y': h / 2 + gap + 5}]) AS c FROM o)"""


@query(
    f"""{_REGION_ROWS}, e AS (SELECT doc_id, h, c.ord AS ord, c.n AS n, c.x AS x, c.y::double AS y FROM r WHERE c.y >= h * 0.45 AND c.n >= 20),
    p AS (SELECT a.doc_id, a.y, b.y + 12 AS by2, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.n + b.n + greatest(0, 100 - abs(a.x - b.x)) + a.y / a.h * 10 DESC, a.ord, b.ord) AS k FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.ord > a.ord AND b.y - a.y BETWEEN 12 AND greatest(120, a.h * 0.18))
    SELECT o.doc_id, coalesce(greatest(0, floor(p.y)::int - 24), floor(h * 0.55::double)::int) AS top, coalesce(least(h::int, floor(p.by2)::int + 24), h::int) AS bottom FROM o LEFT JOIN p ON o.doc_id = p.doc_id AND k = 1"""
)
def machine_regions(table):
    k = F.col("o_orderkey")
    h, gap = F.when(k % 2 == 1, 1000.0).otherwise(600.0), 40 + k % 4 * 50
    row = lambda n, x, y: F.struct(F.repeat(F.lit("A"), n).alias("text"), F.lit(float(x)).alias("x"), y.cast("double").alias("y"))
    cells = F.array(row(F.lit(30), 20, F.lit(100)), row(F.when(k % 10 == 0, 12).otherwise(44), 20, h / 2), row(F.lit(44), 23, h / 2 + gap), row(F.lit(25), 90, h / 2 + gap + 5))
    rows = table("orders").select(k.alias("doc_id"), F.lit(1).alias("page"), h.alias("page_height"), F.posexplode(cells).alias("ord", "c")).select("doc_id", "page", "page_height", "ord", "c.text", "c.x", "c.y", (F.col("c.y") + 12).alias("y2"))
    return layout.machine_region(rows).select("doc_id", "top", "bottom")


@query(
    f"""{identity._LINE}, pool AS (SELECT o_orderkey AS doc_id, line2, {identity.sql_valid_td3('line2')} AS td3, ({identity.sql_check_digit('substring(line2, 22, 6)')} = substring(line2, 28, 1)) AS mrv, o_orderkey % 3 > 0 AS p FROM line)
    SELECT doc_id, line2, 2::int AS ord2 FROM pool WHERE (td3 OR mrv) AND p UNION ALL SELECT doc_id, line2, 4::int FROM pool WHERE (td3 OR mrv) AND p"""
)
def pooled_line_pairs(table):
    """A pool of candidates for each order: a line 1 of a passport or a visa, a short text, and the same line 2 twice."""
    first = F.when(F.col("o_orderkey") % 3 > 0, F.lit(identity._NAME_LINE)).otherwise(F.lit("V" + identity._NAME_LINE[1:]))
    rows = identity.lines(table).select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(F.lit("REPUBLIC"), first, F.col("line2"), F.substring("line2", 1, 30), F.col("line2"))).alias("ord", "text"))
    return layout.candidate_pairs(rows, "P<").select("doc_id", "line2", "ord2")


@query(
    """WITH r AS (SELECT conv_id AS doc_id, turn AS page, role, text, len(list_filter(['NAME', 'THE'], lambda k: contains(upper(text), k))) AS hits, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS n FROM conversations WHERE text IS NOT NULL),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY hits DESC, n DESC, role, text) = 1) SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM b WHERE trim(text) <> '' GROUP BY 1"""
)
def richest_readings(table):
    from pyspark.sql import Window

    variant = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return layout.richest_reading(table("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), variant.alias("variant"), "text"), ["NAME", "THE"])


def line_words(table):
    """Words of a page for each order: a heading, line 1, and line 2 in three words whose boxes are a little off."""
    # of a named column Spark would first look whether it has elements, and for that make line 2 anew for every use of it
    rows = F.array(F.array(F.lit("REPUBLIC"), F.lit("OF"), F.lit("UTOPIA")), F.array(F.lit(identity._NAME_LINE)), F.array(F.substring("line2", 1, 20), F.substring("line2", 21, 10), F.substring("line2", 31, 14)))
    tokens = identity.lines(table).select(F.col("o_orderkey").alias("doc_id"), F.posexplode(rows).alias("row", "tokens")).select("doc_id", "row", F.posexplode("tokens").alias("n", "text"))
    x, y = 20.0 + F.col("row") * 3 + F.col("n") * 210, 500.0 + F.col("row") * 40 + F.col("n") * 2
    return tokens.select("doc_id", F.lit(1).alias("page"), (F.col("row") * 10 + F.col("n")).alias("ord"), "text", F.lit(90.0).alias("confidence"), x.alias("x"), y.alias("y"), F.lit(200.0).alias("width"), F.lit(14.0).alias("height"))


@query(
    f"""{identity._LINE} SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 > 0 OR {identity.sql_check_digit('expiry')} = '9' THEN line2 END AS line2, 2 AS candidates, (o_orderkey % 5 > 0 OR {identity.sql_check_digit('expiry')} = '9')::int AS verified FROM line"""
)
def pairs_from_words(table):
    """From words to pairs in one plan, with what became of each candidate."""
    rows = layout.pairs_of_documents(layout.boxed(line_words(table)))
    return rows.select("doc_id", "line2", F.size("candidates").alias("candidates"), F.size(F.filter("candidates", lambda c: c["role"] == "line2")).alias("verified"))


_REJECTED = f"""{identity._LINE}, b AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN substring(line2, 1, 40) WHEN 1 THEN substring(line2, 1, 9) || '<' || substring(line2, 11) WHEN 2 THEN substring(line2, 1, 19) || 'X' || substring(line2, 21) ELSE line2 END AS second, CASE o_orderkey % 4 WHEN 0 THEN rpad('P<UTOERIKSSON<ANNA<', 44, 'X') WHEN 1 THEN 'P<UTOERIKSSON<<ANNA' ELSE '{identity._NAME_LINE}' END AS first FROM line),
    one AS (SELECT doc_id, 0 AS ord, 'line1' AS role, first AS line, unnest(CASE WHEN length(first) <> 44 THEN [{{'nth': 0, 'check': 'length', 'given': length(first)::varchar, 'wanted': '44'}}] ELSE [{{'nth': 0, 'check': 'length', 'given': '44', 'wanted': '44'}}, {{'nth': 1, 'check': 'prefix', 'given': 'P<', 'wanted': 'P<'}}, {{'nth': 2, 'check': 'separator', 'given': CASE WHEN contains(substring(first, 6), '<<') THEN '<<' ELSE '' END, 'wanted': '<<'}}] END) AS c FROM b),
    two AS (SELECT doc_id, 1 AS ord, 'line2' AS role, second AS line, unnest(CASE WHEN length(second) <> 44 THEN [{{'nth': 0, 'check': 'length', 'given': length(second)::varchar, 'wanted': '44'}}] ELSE [{{'nth': 0, 'check': 'length', 'given': '44', 'wanted': '44'}}, {", ".join(f"{{'nth': {n}, 'check': '{name} digit', 'given': substring(second, {at + 1}, 1), 'wanted': {identity.sql_check_digit(field)}}}" for n, name, at, field in ((1, "number", 9, "substring(second, 1, 9)"), (2, "birth", 19, "substring(second, 14, 6)"), (3, "expiry", 27, "substring(second, 22, 6)"), (4, "optional", 42, "substring(second, 29, 14)"), (5, "composite", 43, "(substring(second, 1, 10) || substring(second, 14, 7) || substring(second, 22, 22))")))}] END) AS c FROM b),
    checks AS (SELECT doc_id, ord, role, line, c.* FROM (SELECT * FROM one UNION ALL SELECT * FROM two))"""


def broken_lines(table):
    """Both lines of a page for each order: some cut off, some with a check digit that is a filler, a letter or wrong, some without separator."""
    k = F.col("doc_id")
    rows = identity.lines(table).select(F.col("o_orderkey").alias("doc_id"), "line2")
    put = lambda at, c: F.concat(F.substring("line2", 1, at), F.lit(c), F.substring("line2", at + 2, 44))
    second = F.when(k % 6 == 0, F.substring("line2", 1, 40)).when(k % 6 == 1, put(9, "<")).when(k % 6 == 2, put(19, "X")).otherwise(F.col("line2"))
    first = F.when(k % 4 == 0, "P<UTOERIKSSON<ANNA<".ljust(44, "X")).when(k % 4 == 1, "P<UTOERIKSSON<<ANNA").otherwise(identity._NAME_LINE)
    rows = rows.select("doc_id", F.posexplode(F.array(first, second)).alias("ord", "text"))
    return rows.withColumn("page", F.lit(1))


@query(f"{_REJECTED} SELECT doc_id, ord, role, line, nth, \"check\", given, wanted, given = wanted AS passed FROM checks")
def candidates_checked(table):
    """Every check of every candidate as it was read."""
    return layout.candidate_checks(broken_lines(table)).where("tier = 'read'").drop("page", "tier")


@query(
    f"""{_REJECTED}, r AS (SELECT ord, arg_min("check", nth) FILTER (given <> wanted) AS why, count(*) FILTER (given <> wanted) AS failed FROM checks GROUP BY doc_id, ord) SELECT ord, coalesce(why, 'none') AS why, count(*) AS candidates FROM r GROUP BY 1, 2"""
)
def rejections_by_reason(table):
    """Candidates by the first check that they fail as read."""
    checks = layout.candidate_checks(broken_lines(table)).where("tier = 'read'")
    return layout.rejections(checks).groupBy("ord", F.coalesce("why.check", F.lit("none")).alias("why")).agg(F.count("*").alias("candidates"))
