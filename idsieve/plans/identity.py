"""Check digits, machine-readable lines, identifiers, dates, card texts and validation, on fields built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from idsieve.functions import dates, identifiers, mrz, text
from idsieve.operators import outcome, parsers, validation
from idsieve.plans.registry import query
from idsieve.sources import tables

AS_OF = "2024-06-15"
_NAME_LINE = "P<UTOERIKSSON<<ANNA" + "<" * 25


def _value(c: str) -> str:
    return f"CASE WHEN {c} BETWEEN '0' AND '9' THEN ascii({c}) - 48 WHEN {c} BETWEEN 'A' AND 'Z' THEN ascii({c}) - 55 ELSE 0 END"


def sql_check_digit(f: str) -> str:
    return f"((list_sum(list_transform(string_split({f}, ''), lambda c, i: ({_value('c')}) * [7, 3, 1][(i - 1) % 3 + 1])) % 10)::bigint)::varchar"


def sql_valid_td3(x: str) -> str:
    cut = lambda a, n: f"substring({x}, {a + 1}, {n})"
    fields = [(cut(0, 9), 9), (cut(13, 6), 19), (cut(21, 6), 27), (cut(28, 14), 42), (f"({cut(0, 10)} || {cut(13, 7)} || {cut(21, 22)})", 43)]
    return f"(length({x}) = 44 AND " + " AND ".join(f"{sql_check_digit(f)} = {cut(at, 1)}" for f, at in fields) + ")"


def sql_dmy(x: str) -> str:
    """A date of D/M/YYYY text; null if it is none."""
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime({x}, '%d/%m/%Y')::date END"


def sql_mrz_date(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{6}}') THEN strftime(try_strptime(CASE WHEN left({x}, 2) <= '49' THEN '20' ELSE '19' END || {x}, '%Y%m%d'), '%d/%m/%Y') END"


# a passport's line 2 from an order: number, dates, and check digits that are right but for every fifth order
_LINE = f"""WITH f AS (SELECT o_orderkey, rpad('N' || lpad(o_custkey::varchar, 7, '0'), 9, '<') AS number, strftime(o_orderdate, '%y%m%d') AS birth, strftime(o_orderdate + INTERVAL 20 YEAR, '%y%m%d') AS expiry, rpad('Z' || o_orderkey, 14, '<') AS extra,
    CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' ELSE '<' END AS sex FROM orders),
    g AS (SELECT *, number || {sql_check_digit('number')} || 'UTO' || birth || {sql_check_digit('birth')} || sex || expiry || CASE WHEN o_orderkey % 5 = 0 THEN '9' ELSE {sql_check_digit('expiry')} END || extra || {sql_check_digit('extra')} AS head FROM f),
    line AS (SELECT *, head || {sql_check_digit("(substring(head, 1, 10) || substring(head, 14, 7) || substring(head, 22, 22))")} AS line2 FROM g)"""


def lines(table):
    orders = tables.spread(table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")).withColumn("expires", F.add_months("o_orderdate", 240))
    sex = F.when(F.col("o_orderstatus") == "F", "F").when(F.col("o_orderstatus") == "O", "M").otherwise("<")
    rows = orders.select(
        "o_orderkey",
        F.rpad(F.concat(F.lit("N"), F.lpad(F.col("o_custkey").cast("string"), 7, "0")), 9, "<").alias("number"),
        F.date_format("o_orderdate", "yyMMdd").alias("birth"),
        F.date_format("expires", "yyMMdd").alias("expiry"),
        F.rpad(F.concat(F.lit("Z"), F.col("o_orderkey").cast("string")), 14, "<").alias("extra"),
        sex.alias("sex"),
    )
    digit = lambda c: mrz.check_digit(F.col(c), 14)  # noqa: E731  no field is longer
    wrong = F.when(F.col("o_orderkey") % 5 == 0, "9").otherwise(digit("expiry"))
    rows = rows.withColumn("head", F.concat("number", digit("number"), F.lit("UTO"), "birth", digit("birth"), "sex", "expiry", wrong, "extra", digit("extra")))
    return rows.withColumn("line2", F.concat("head", mrz.check_digit(mrz.composite(F.col("head")), mrz.COMPOSED)))


@query(f"SELECT l_orderkey, l_linenumber, {sql_check_digit("l_partkey::varchar || l_returnflag || '<' || l_suppkey::varchar")} AS digit FROM lineitem")
def check_digits(table):
    field = F.concat(F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.lit("<"), F.col("l_suppkey").cast("string"))
    return table("lineitem").select("l_orderkey", "l_linenumber", mrz.check_digit(field).alias("digit"))


@query(f"{_LINE} SELECT o_orderkey, line2, {sql_valid_td3('line2')} AS valid FROM line")
def passport_lines_verified(table):
    return lines(table).select("o_orderkey", "line2", mrz.valid_td3(F.col("line2")).alias("valid"))


@query(
    f"""{_LINE} SELECT o_orderkey, rtrim(substring(line2, 1, 9), '<') AS passport_number, substring(line2, 11, 3) AS nationality, {sql_mrz_date('substring(line2, 14, 6)')} AS date_of_birth,
    CASE substring(line2, 21, 1) WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' WHEN '<' THEN 'Unspecified' END AS gender, {sql_mrz_date('substring(line2, 22, 6)')} AS expiry_date, replace(substring(line2, 29, 14), '<', '') AS optional_data FROM line"""
)
def passport_line2_fields(table):
    row = mrz.passport_fields(F.lit("P<UTOA<<B" + "<" * 35), F.col("line2"))
    return lines(table).select("o_orderkey", row.alias("f")).select("o_orderkey", "f.passport_number", "f.nationality", "f.date_of_birth", "f.gender", "f.expiry_date", "f.optional_data")


@query(
    """WITH n AS (SELECT c_custkey, rpad(upper(c_mktsegment) || CASE WHEN c_custkey % 3 > 0 THEN '<<ANNA<' || chr((65 + c_custkey % 26)::int) || 'X' ELSE '' END, 39, '<') AS field FROM customer)
    SELECT c_custkey, array_to_string(list_filter(string_split(split_part(rtrim(field, '<'), '<<', 1), '<'), lambda w: w <> ''), ' ') AS surname, array_to_string(list_filter(string_split(split_part(rtrim(field, '<'), '<<', 2), '<'), lambda w: w <> ''), ' ') AS given_names FROM n"""
)
def passport_names(table):
    k = F.col("c_custkey")
    field = F.rpad(F.concat(F.upper("c_mktsegment"), F.when(k % 3 > 0, F.concat(F.lit("<<ANNA<"), F.char(65 + k % 26), F.lit("X"))).otherwise("")), 39, "<")
    return table("customer").select("c_custkey", mrz.name_of(field).alias("n")).select("c_custkey", "n.surname", "n.given_names")


@query(
    f"""{_LINE}, bad AS (SELECT o_orderkey, line2, number, substring(line2, 10, 1) AS digit, CASE WHEN contains(number, '0') AND o_orderkey % 5 > 0 THEN regexp_replace(number, '0', 'O') ELSE number END AS read FROM line)
    SELECT o_orderkey, CASE WHEN {sql_check_digit('read')} = digit THEN read ELSE coalesce(list_filter(flatten(list_transform(range(1, 10), lambda i: list_transform(string_split(CASE substring(read, i, 1) WHEN '0' THEN 'OQD' WHEN 'O' THEN '0QD' WHEN '1' THEN 'IL' WHEN 'I' THEN '1L' WHEN 'L' THEN '1I' WHEN '2' THEN 'Z' WHEN 'Z' THEN '2' WHEN '5' THEN 'S' WHEN 'S' THEN '5' WHEN '6' THEN 'GC' WHEN '8' THEN 'B' WHEN 'B' THEN '8' WHEN '9' THEN 'GQ' WHEN 'G' THEN '9Q' ELSE '' END, ''), lambda a: CASE WHEN a <> '' THEN substring(read, 1, i - 1) || a || substring(read, i + 1) END))), lambda t: t IS NOT NULL AND {sql_check_digit('t')} = digit)[1], read) END AS corrected FROM bad"""
)
def corrected_fields(table):
    rows = lines(table).withColumn("read", F.when(F.col("number").contains("0") & (F.col("o_orderkey") % 5 > 0), F.expr("regexp_replace(number, '^([^0]*)0', '$1O')")).otherwise(F.col("number")))
    return rows.select("o_orderkey", mrz.correct_field(F.col("read"), mrz.piece(F.col("line2"), 9, 1)).alias("corrected"))


@query()
def corrected_passport_lines(table):
    """Lines with one digit read as a letter, put right by their check digits."""
    rows = lines(table).withColumn("read", F.expr("concat(substring(line2, 1, 13), replace(substring(line2, 14, 6), '0', 'O'), substring(line2, 20))"))
    return rows.select("o_orderkey", mrz.correct_td3(F.col("read")).alias("corrected"), mrz.line_score(F.col("read"), "P<").alias("score"))


@query(
    f"""{_LINE}, broken AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN substring(line2, 1, 40) WHEN 2 THEN replace(line2, 'N', '-') WHEN 3 THEN substring(line2, 1, 20) || 'X' || substring(line2, 22) ELSE line2 END AS b FROM line)
    SELECT o_orderkey, CASE WHEN length(b) <> 44 THEN 'line 2 has ' || length(b) || ' characters instead of 44' WHEN contains(b, '-') THEN 'line 2 has characters that no such line has: -' WHEN substring(b, 21, 1) NOT IN ('M', 'F', '<') THEN 'the sex in line 2 is none of M, F and <' END AS error FROM broken"""
)
def structural_errors(table):
    b, k = F.col("line2"), F.col("o_orderkey") % 7
    broken = F.when(k == 1, F.substring(b, 1, 40)).when(k == 2, F.replace(b, F.lit("N"), F.lit("-"))).when(k == 3, F.concat(F.substring(b, 1, 20), F.lit("X"), F.substring(b, 22, 44))).otherwise(b)
    return lines(table).select("o_orderkey", mrz.structure_error(F.lit("P<UTOA<<B" + "<" * 35), broken).alias("error"))


def _flat(rows: list[list[int]]) -> str:
    return "[" + ", ".join(str(x) for r in rows for x in r) + "]"


def sql_verhoeff(n: str) -> str:
    steps = f"list_transform(string_split(reverse({n}), ''), lambda c, i: {_flat(identifiers.VERHOEFF_P)}[((i - 1) % 8) * 10 + c::int + 1])"
    return f"(list_reduce({steps}, lambda a, v: {_flat(identifiers.VERHOEFF_D)}[a * 10 + v + 1], 0) = 0)"


@query(f"SELECT o_orderkey, {sql_verhoeff("lpad((o_orderkey * 7919 + o_custkey)::varchar, 12, '2')")} AS valid FROM orders")
def resident_numbers_verified(table):
    n = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 12, "2")
    return table("orders").select("o_orderkey", identifiers.verhoeff_valid(n).alias("valid"))


@query(
    f"""WITH t AS (SELECT o_orderkey, lpad((o_orderkey * 7919)::varchar, 12, '3') AS a, lpad((o_custkey * 104729)::varchar, 12, '4') AS b FROM orders), c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [b] ELSE [a, b] END AS found FROM t),
    p AS (SELECT o_orderkey, coalesce(list_filter(found, lambda x: {sql_verhoeff('x')})[1], found[1]) AS n, len(list_filter(found, lambda x: {sql_verhoeff('x')})) > 0 AS ok FROM c)
    SELECT o_orderkey, substring(n, 1, 4) || ' ' || substring(n, 5, 4) || ' ' || substring(n, 9, 4) AS number, ok AS checksum_valid FROM p"""
)
def resident_numbers_in_text(table):
    a, b = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 12, "3"), F.lpad((F.col("o_custkey") * 104729).cast("string"), 12, "4")
    said = F.concat(F.lit("no. "), identifiers.grouped(a), F.when(F.col("o_orderkey") % 3 == 0, " 1234").otherwise(""), F.lit(" and "), b, F.lit("."))
    return table("orders").select("o_orderkey", identifiers.resident_number(said).alias("n")).select("o_orderkey", "n.number", "n.checksum_valid")


@query(
    """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'P' || o_orderkey WHEN 1 THEN 'A' || lpad(o_orderkey::varchar, 7, '0') WHEN 2 THEN 'ABCDEFG' ELSE 'X-' || o_orderkey END AS n FROM orders)
    SELECT o_orderkey, length(n) BETWEEN 6 AND 9 AND regexp_full_match(n, '[A-Z0-9]+') AND regexp_matches(n, '[0-9]') AS valid, CASE WHEN regexp_full_match(regexp_replace(n, '[^A-Z0-9]', '', 'g'), '[A-Z][0-9]{7}') THEN regexp_replace(n, '[^A-Z0-9]', '', 'g') END AS strict FROM p"""
)
def passport_numbers(table):
    k = F.col("o_orderkey")
    n = F.when(k % 4 == 0, F.concat(F.lit("P"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("A"), F.lpad(k.cast("string"), 7, "0"))).when(k % 4 == 2, "ABCDEFG").otherwise(F.concat(F.lit("X-"), k.cast("string")))
    return table("orders").select("o_orderkey", (F.size(identifiers.passport_number_errors(n)) == 0).alias("valid"), identifiers.strict_passport(n).alias("strict"))


@query("""SELECT c_custkey, sha256('{"id":' || c_custkey || ',"name":"' || c_name || '","nothing":null,"segment":"' || c_mktsegment || '"}') AS record_hash FROM customer""")
def record_hashes(table):
    payload = identifiers.canonical_json({"segment": F.col("c_mktsegment"), "name": F.col("c_name"), "id": F.col("c_custkey"), "nothing": F.lit(None).cast("string")})
    return table("customer").select("c_custkey", identifiers.record_hash(payload).alias("record_hash"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'passport_number' WHEN c_custkey % 3 = 1 THEN 'visa_number' ELSE 'aadhaar_number' END AS identity_type,
    upper(CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_custkey::varchar END) AS identity_key FROM customer"""
)
def document_identities(table):
    k = F.col("c_custkey") % 3
    key, value = identifiers.document_identity({"passport_number": F.when(k == 0, F.concat(F.lit(" "), "c_name")).otherwise(" "), "visa_number": F.when(k == 1, F.col("c_mktsegment")), "aadhaar_number": F.col("c_custkey").cast("string")})
    return table("customer").select("c_custkey", key.alias("identity_type"), value.alias("identity_key"))


# dates -------------------------------------------------------------------------------------------------

_DAY = "CASE WHEN l_linenumber % 4 = 0 THEN '31/02/' || year(l_shipdate) ELSE strftime(l_shipdate, '%d/%m/%Y') END"


@query(f"SELECT l_orderkey, l_linenumber, {sql_dmy(_DAY)} AS day, {sql_mrz_date("CASE WHEN l_linenumber % 4 = 0 THEN '991332' ELSE strftime(l_shipdate, '%y%m%d') END")} AS mrz_day FROM lineitem")
def dates_reparsed(table):
    odd = F.col("l_linenumber") % 4 == 0
    day = F.when(odd, F.concat(F.lit("31/02/"), F.year("l_shipdate").cast("string"))).otherwise(F.date_format("l_shipdate", "dd/MM/yyyy"))
    code = F.when(odd, "991332").otherwise(F.date_format("l_shipdate", "yyMMdd"))
    return table("lineitem").select("l_orderkey", "l_linenumber", dates.dmy(day).alias("day"), mrz.date_of(code).alias("mrz_day"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 > 0 THEN strftime(l_shipdate, '%d/%m/%Y') END AS day FROM lineitem")
def dates_spelt(table):
    k, d = F.col("l_linenumber") % 5, F.col("l_shipdate")
    said = F.when(k == 0, "30 FEB 2021").when(k == 1, F.upper(F.date_format(d, "d MMM yyyy"))).when(k == 2, F.upper(F.date_format(d, "ddMMMyyyy"))).when(k == 3, F.concat(F.lit("on "), F.date_format(d, "MMM d yyyy"))).otherwise(F.date_format(d, "dd MMM yyyy"))
    return table("lineitem").select("l_orderkey", "l_linenumber", dates.spelt(said).alias("day"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 > 0 THEN strftime(l_shipdate, '%d/%m/%Y') END AS day FROM lineitem")
def dates_of_cards(table):
    k, d = F.col("l_linenumber") % 5, F.col("l_shipdate")
    said = F.when(k == 0, "2021-13-40").when(k == 1, F.date_format(d, "yyyy-M-d")).when(k == 2, F.date_format(d, "d/M/yy")).when(k == 3, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "d MMMM, yyyy"))
    return table("lineitem").select("l_orderkey", "l_linenumber", dates.any_format(said, F.lit(AS_OF).cast("date")).alias("day"))


# texts -------------------------------------------------------------------------------------------------


@query()
def text_lines(table):
    """Of every document; SQL engines without look-behind cannot join spaced letters, so tests hold it against plain Python."""
    return table("documents").select("doc_id", text.lines(F.col("text")).alias("lines"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[0-9]{16}'))) AS numbers, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\b(version|public|license)\\b'), lambda x: upper(x)))) AS terms FROM documents")
def terms_and_numbers(table):
    return table("documents").select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{16}"), 0))).alias("numbers"), F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("(?i)\\b(version|public|license)\\b"), 0), lambda x: F.upper(x)))).alias("terms"))


_SPACE = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_LABEL = "NAME|GENDER|SEX|ADDRESS|VID|(?:DATE|YEAR)S*OFS*BIRTH|[DY]\\.?S*O\\.?S*B\\.?".replace("S*", f"{_SPACE}*")


@query(
    f"""SELECT conv_id, turn, role, length(text) <= 40 AND regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(?:{_LABEL})(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') AS label,
    trim(regexp_replace(regexp_replace(trim(coalesce(text, '')), '^[:\\-.|#]+{_SPACE}*', ''), '{_SPACE}+', ' ', 'g')) AS value FROM conversations"""
)
def labels_and_values(table):
    return table("conversations").select("conv_id", "turn", "role", text.looks_like_label(F.col("text")).alias("label"), text.clean_value(F.col("text")).alias("value"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'MULTIPLE' WHEN 1 THEN 'SINGLE' WHEN 2 THEN 'DOUBLE' END AS entries, CASE p_size % 4 WHEN 0 THEN 'WORK' WHEN 1 THEN 'STUDENT' END AS visa_type, CASE WHEN p_size % 3 = 0 THEN 'B' || (1000000 + p_partkey) WHEN p_size % 3 = 1 THEN 'AB' || (100000 + p_partkey) END AS visa_number, p_size || ' ' || CASE p_size % 2 WHEN 0 THEN 'DAY' ELSE 'MONTH' END AS stay FROM part")
def visa_values(table):
    k, n = F.col("p_size"), F.col("p_partkey")
    number = F.when(k % 3 == 0, F.concat(F.lit("B-"), (1000000 + n).cast("string"))).when(k % 3 == 1, F.concat(F.lit("ab "), (100000 + n).cast("string"))).otherwise("none")
    pick = lambda m, *v: F.coalesce(*(F.when(k % m == i, F.lit(x)) for i, x in enumerate(v)), F.lit("?"))
    stay = F.concat(F.lit("max. "), k.cast("string"), F.when(k % 2 == 0, " days").otherwise(" month"))
    return table("part").select("p_partkey", parsers.entries(pick(6, "Multi", "1", " double ")).alias("entries"), parsers.visa_type(pick(4, "H-1B", "F1", "zz")).alias("visa_type"), parsers.visa_number(number).alias("visa_number"), parsers.stay_duration(stay).alias("stay"))


@query(
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN substring(c_name, 1, 8) WHEN 4 THEN c_name END AS holder_name, CASE WHEN c_custkey % 6 IN (0, 4) THEN c_name WHEN c_custkey % 6 = 1 THEN upper(c_name) WHEN c_custkey % 6 = 2 THEN substring(c_name, 1, 8) WHEN c_custkey % 6 = 3 THEN 'OTHER' END AS passport_number FROM customer"""
)
def merged_readings(table):
    """Two sources of a field: one missing, equal but for case, a part of the other, and different."""
    k, name = F.col("c_custkey") % 6, F.col("c_name")
    read = F.when(k.isin(0, 1, 2, 3), name)
    machine = F.when(k == 1, F.upper(name)).when(k == 2, F.substring(name, 1, 8)).when(k == 3, "OTHER").when(k == 4, name)
    return table("customer").select("c_custkey", parsers.resolved("holder_name", read, machine).alias("holder_name"), parsers.resolved("passport_number", read, machine).alias("passport_number"))


# what each kind of document gives: passports by their lines, visas by a pair of lines or by a line of the text, cards, and others
_SCREENED = f"""{_LINE}, o AS (SELECT l.o_orderkey AS k, o_custkey, o_orderpriority, rtrim(substring(line2, 1, 9), '<') AS line_number, {sql_valid_td3('line2')} AS td3, l.o_orderkey % 5 > 0 OR {sql_check_digit('expiry')} = '9' AS mrv, lpad((l.o_orderkey * 7919)::varchar, 12, '3') AS digits, l.o_orderkey % 13 = 0 AS dark,
        CASE WHEN l.o_orderkey % 8 < 4 THEN 'PASSPORT' WHEN l.o_orderkey % 8 < 6 THEN 'VISA' WHEN l.o_orderkey % 8 = 6 THEN 'AADHAAR' WHEN l.o_orderkey % 3 > 0 THEN 'LICENCE' END AS kind, {sql_dmy(sql_mrz_date('expiry'))} >= TIMESTAMP '{AS_OF}' AS active,
        ((l.o_orderkey % 2 = 0)::int * 0.45::double + (l.o_orderkey % 2 <> 0)::int * 0.135::double) * ((l.o_orderkey % 10) / 10) + 0.35::double * ((l.o_orderkey % 7) / 7) + CASE WHEN l.o_orderkey % 9 = 0 THEN 0.2::double ELSE 0 END AS c FROM line l JOIN orders o ON o.o_orderkey = l.o_orderkey),
    s AS (SELECT *, CASE WHEN kind = 'PASSPORT' THEN CASE WHEN td3 THEN 'MATCH' ELSE 'NOT_PRESENT' END WHEN kind = 'VISA' AND k % 8 = 4 THEN CASE WHEN mrv THEN 'MATCH' ELSE 'MISMATCH' END ELSE 'NOT_PRESENT' END AS mrz_verification,
        CASE WHEN kind = 'PASSPORT' AND td3 OR kind = 'VISA' AND (k % 8 = 4 OR mrv) THEN line_number WHEN kind = 'AADHAAR' THEN substring(digits, 1, 4) || ' ' || substring(digits, 5, 4) || ' ' || substring(digits, 9, 4) END AS number,
        CASE WHEN kind = 'PASSPORT' AND td3 OR kind = 'AADHAAR' AND {sql_verhoeff('digits')} THEN 'VALID' ELSE 'INVALID' END AS validation_status,
        CASE WHEN NOT coalesce(kind = 'PASSPORT' AND td3 OR kind = 'VISA' AND (k % 8 = 4 OR mrv), false) THEN 'UNKNOWN' WHEN active THEN 'ACTIVE' ELSE 'EXPIRED' END AS expiry_status, CASE WHEN dark THEN 0 ELSE round_even(least(c, 1), 2) END AS confidence, NOT dark AND round_even(least(c, 1), 2) >= 0.5 AS tampering,
        CASE WHEN coalesce(kind NOT IN ('PASSPORT', 'VISA'), true) THEN 'NOT_APPLICABLE' WHEN dark THEN 'INSUFFICIENT_EVIDENCE' WHEN k % 4 = 0 THEN 'UNCERTAIN' WHEN k % 4 = 1 THEN 'STAMP_DETECTED' ELSE 'NO_STAMP_DETECTED' END AS stamp_status FROM o),
    t AS (SELECT *, CASE WHEN validation_status = 'INVALID' THEN 90 WHEN tampering THEN 75 ELSE 10 END::double AS stored_score, sha256(o_custkey || '-' || o_orderpriority) AS hash FROM s)"""


def _read_documents(table):
    """A document for each order, with scores of its image and gate results of its stamps: passports, visas with lines or with a
    line in the text, cards, and others with and without a type. Some images could not be decoded."""
    k = F.col("document_id")
    kind = F.when(k % 8 < 4, "PASSPORT").when(k % 8 == 4, "visa").when(k % 8 == 5, "VISA").when(k % 8 == 6, "AADHAAR").when(k % 3 > 0, "LICENCE")
    rows = lines(table).select(F.col("o_orderkey").alias("document_id"), "line2").withColumn("kind", kind)
    gates = F.when(k % 4 == 0, F.array(F.lit("UNCERTAIN"))).when(k % 4 == 1, F.array(F.lit("UNCERTAIN"), F.lit("STAMP_DETECTED")))
    card = F.concat(F.lit("GOVERNMENT\nName: Anna Maria\nDOB: 12/04/1985\nGender: Female\nAddress: 12 Main Road\n"), identifiers.grouped(F.lpad((k * 7919).cast("string"), 12, "3")))
    said = F.when(k % 8 == 5, F.concat(F.lit("VISA\n"), F.col("line2"))).when(k % 8 == 6, card).otherwise("")
    first = F.when(k % 8 < 4, _NAME_LINE).when(k % 8 == 4, "V<UTOERIKSSON<<ANNA" + "<" * 25)
    image = [(k % 10 / 10).alias("ela"), (k % 7 / 7).alias("noise"), F.when(k % 9 == 0, "GIMP 2.10").alias("software"), (k % 2 == 0).alias("jpeg"), gates.alias("stamps"), F.when(k % 13 == 0, "the file ends within a chunk").alias("image_error")]
    return rows.select("document_id", F.col("kind").alias("document_type"), said.alias("text"), first.alias("line1"), F.when(first.isNotNull(), F.col("line2")).alias("line2"), *image)


@query(
    f"""{_SCREENED}, w AS (SELECT l_orderkey, round_even(avg(CASE WHEN l_linenumber % 4 > 0 THEN l_quantity * 2 END), 1) AS confidence, count(*) AS tokens, count_if(l_linenumber % 4 > 0 AND l_quantity * 2 < 70) AS review FROM lineitem GROUP BY 1)
    SELECT k AS document_id, number AS identity_number, mrz_verification, (mrz_verification = 'MATCH')::int::double AS mrz_confidence, validation_status, expiry_status, tampering, t.confidence AS tampering_confidence, stamp_status, stored_score, CASE WHEN stored_score >= 75 THEN 'HIGH' ELSE 'LOW' END AS risk_level,
    w.confidence, coalesce(tokens, 0) AS tokens_detected, coalesce(review, 0) AS tokens_requiring_review FROM t LEFT JOIN w ON k = l_orderkey"""
)
def documents_screened(table):
    confidence = F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity") * 2).otherwise(-1.0)
    words = table("lineitem").select(F.col("l_orderkey").alias("doc_id"), confidence.cast("double").alias("confidence"))
    rows = outcome.screened(_read_documents(table), F.lit(AS_OF).cast("timestamp"), words)
    return rows.drop("document_type", "validation_score", "reasons")


@query(
    f"""{_SCREENED} SELECT 'scan-' || k || '.png' AS filename, CASE WHEN k % 8 = 4 THEN 'visa' ELSE kind END AS document_type, k::varchar AS document_id, 'SCR-' || k AS screening_id, CASE WHEN dark THEN 'FAILED' ELSE 'COMPLETED' END AS status, stored_score AS risk_score, CASE WHEN stored_score >= 75 THEN 'HIGH' ELSE 'LOW' END AS risk_level,
    validation_status, CASE WHEN kind = 'PASSPORT' AND td3 THEN 100 WHEN kind = 'PASSPORT' THEN 0 WHEN kind = 'VISA' THEN CASE WHEN k % 8 = 4 OR mrv THEN 43 ELSE 0 END WHEN kind = 'AADHAAR' THEN CASE WHEN validation_status = 'VALID' THEN 100 ELSE 83 END ELSE 0 END AS validation_score, mrz_verification, tampering AS tampering_detected, confidence AS tampering_confidence, stamp_status,
    NULL::varchar AS blockchain_status, sha256('{{"document":' || k || ',"score":' || stored_score::int || '}}') AS record_hash, NULL::varchar AS processing_seconds, CASE WHEN dark THEN 'the file ends within a chunk' END AS error FROM t"""
)
def evaluated_documents(table):
    """All columns of an evaluation; documents whose image could not be decoded have failed, with the reason."""
    docs = _read_documents(table)
    rows = outcome.screened(docs, F.lit(AS_OF).cast("timestamp")).join(docs.select("document_id", F.col("image_error").alias("error")), "document_id")
    payload = identifiers.canonical_json({"document": F.col("document_id"), "score": F.col("stored_score").cast("int")})
    rows = rows.withColumns({"filename": F.concat(F.lit("scan-"), F.col("document_id").cast("string"), F.lit(".png")), "screening_id": F.concat(F.lit("SCR-"), F.col("document_id").cast("string")), "record_hash": identifiers.record_hash(payload)})
    rows = rows.withColumn("document_id", F.col("document_id").cast("string")).withColumn("status", F.when(F.col("error").isNull(), "COMPLETED"))
    return tables.evaluation_rows(rows.withColumnsRenamed({"stored_score": "risk_score", "tampering": "tampering_detected"}))


@query(
    f"""{_SCREENED}, h AS (SELECT *, lag(hash) OVER (PARTITION BY hash ORDER BY k) AS same, CASE WHEN number IS NOT NULL THEN lag(hash) OVER (PARTITION BY kind, number ORDER BY k) END AS other FROM t)
    SELECT k AS document_id, CASE WHEN same IS NOT NULL THEN 'UNCHANGED' WHEN other IS NULL THEN 'NEW' WHEN other = hash THEN 'UNCHANGED' ELSE 'MISMATCH' END AS integrity_status, stored_score, CASE WHEN same IS NULL AND other <> hash THEN greatest(stored_score, 90) ELSE stored_score END AS record_score FROM h"""
)
def screenings_recorded(table):
    """The score stored with a screening and that of its record, which a mismatch with a prior record escalates."""
    rows = outcome.screened(_read_documents(table), F.lit(AS_OF).cast("timestamp"))
    hashes = table("orders").select(F.col("o_orderkey").alias("document_id"), F.sha2(F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderpriority"), 256).alias("document_hash"))
    rows = rows.join(hashes, "document_id").withColumns({"record_id": F.col("document_id"), "status": F.lit("CONFIRMED")})
    return outcome.recorded(rows, ["record_id"]).select("document_id", "integrity_status", "stored_score", "record_score")


def resident_cards(table):
    """A card text for each customer, with fields that some lack."""
    k = F.col("c_custkey")
    number = F.lpad((k * 104729).cast("string"), 12, "4")
    parts = [
        F.lit("GOVERNMENT"),
        F.concat(F.lit("|| Name: "), "c_name", F.lit(" ~")),
        F.when(k % 3 > 0, F.concat(F.lit("DOB : "), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("/0"), (k % 9 + 1).cast("string"), F.lit("/19"), (50 + k % 50).cast("string"))),
        F.when(k % 3 == 0, F.concat(F.lit("Year of Birth "), (1950 + k % 50).cast("string"))),
        F.when(k % 2 == 0, "Gender: M A L E").otherwise("/ FEMALE"),
        F.when(k % 4 == 0, "S/O: Mohan Lal, Pune"),
        F.lit("Address: 12 Main Road"),
        F.concat(F.lit("Ward "), (k % 7).cast("string")),
        F.lit("411001"),
        identifiers.grouped(number),
    ]
    return tables.spread(table("customer").select("c_custkey", "c_name")).select("c_custkey", F.array_join(F.array_compact(F.array(*parts)), "\n").alias("text"))


@query(
    f"""WITH c AS (SELECT c_custkey AS k, c_name, lpad((c_custkey * 104729)::varchar, 12, '4') AS n FROM customer)
    SELECT k AS c_custkey, substring(n, 1, 4) || ' ' || substring(n, 5, 4) || ' ' || substring(n, 9, 4) AS aadhaar_number, {sql_verhoeff('n')} AS checksum_valid, c_name AS name, CASE WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
    CASE WHEN k % 3 > 0 THEN lpad((k % 28 + 1)::varchar, 2, '0') || '/0' || (k % 9 + 1) || '/19' || (50 + k % 50) END AS date_of_birth, CASE WHEN k % 3 = 0 THEN (1950 + k % 50)::varchar END AS year_of_birth,
    CASE WHEN k % 4 = 0 THEN 'Mohan Lal' END AS guardian_name, '12 Main Road, Ward ' || (k % 7) || ', 411001' AS address FROM c"""
)
def resident_cards_parsed(table):
    rows = parsers.parse_residents(resident_cards(table), F.lit(AS_OF).cast("date"))
    return rows.select("c_custkey", "identity.aadhaar_number", F.col("identity.aadhaar_number_checksum_valid").alias("checksum_valid"), "identity.name", "identity.gender", "identity.date_of_birth", "identity.year_of_birth", "identity.guardian_name", "identity.address")


@query(
    f"""SELECT c_custkey, CASE WHEN {sql_verhoeff("lpad((c_custkey * 104729)::varchar, 12, '4')")} THEN 'VALID' ELSE 'INVALID' END AS status, CASE WHEN {sql_verhoeff("lpad((c_custkey * 104729)::varchar, 12, '4')")} THEN 100 ELSE 83 END AS validation_score,
    (c_custkey % 3 = 0)::int AS warnings FROM customer"""
)
def resident_cards_validated(table):
    rows = parsers.parse_residents(resident_cards(table), F.lit(AS_OF).cast("date"))
    rows = rows.select("c_custkey", validation.validate_resident(F.col("identity"), F.lit(AS_OF).cast("timestamp")).alias("v"))
    return rows.select("c_custkey", "v.status", "v.validation_score", F.size("v.warnings").alias("warnings"))


@query(
    f"""{_LINE} SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 OR {sql_check_digit('expiry')} = '9' THEN 'VALID' ELSE 'INVALID' END AS mrz_status, CASE WHEN o_orderkey % 5 > 0 OR {sql_check_digit('expiry')} = '9' THEN 'VALID' ELSE 'INVALID' END AS status,
    CASE WHEN o_orderkey % 5 > 0 OR {sql_check_digit('expiry')} = '9' THEN CASE WHEN {sql_dmy(sql_mrz_date('expiry'))} >= TIMESTAMP '{AS_OF}' THEN 'ACTIVE' ELSE 'EXPIRED' END ELSE 'UNKNOWN' END AS expiry_status FROM line"""
)
def passports_validated(table):
    rows = parsers.parse_passports(lines(table).select("o_orderkey", F.lit(_NAME_LINE).alias("line1"), "line2", F.lit("").alias("text")))
    rows = rows.select("o_orderkey", F.col("mrz.status").alias("mrz_status"), validation.validate_passport(F.col("identity"), F.col("mrz"), F.lit(AS_OF).cast("timestamp")).alias("v"))
    return rows.select("o_orderkey", "mrz_status", "v.status", "v.expiry_status")


@query(
    """SELECT c_custkey, upper(c_mktsegment) AS surname, 'ANNA' AS given_names, 'K' || lpad(c_custkey::varchar, 7, '0') AS passport_number, 'IND' AS nationality, '12/04/1985' AS date_of_birth, '13/01/2032' AS expiry_date, 'Female' AS gender, 'NOT_FOUND' AS mrz_status FROM customer"""
)
def visible_passports(table):
    """Passports without machine-readable lines: what their visible text gives."""
    k = F.col("c_custkey")
    said = F.concat(F.lit("PASSPORT\nSurname\n"), F.upper("c_mktsegment"), F.lit("\nGiven Name(s)\nANNA\nNationality\nINDIAN\nSex\nF\nPassport No: K"), F.lpad(k.cast("string"), 7, "0"), F.lit("\nDate of Birth\n12 APR 1985\nDate of Issue  Date of Expiry\n14 JAN 2022  13 JAN 2032"))
    rows = parsers.parse_passports(table("customer").select("c_custkey", F.lit(None).cast("string").alias("line1"), F.lit(None).cast("string").alias("line2"), said.alias("text")))
    return rows.select("c_custkey", "identity.surname", "identity.given_names", "identity.passport_number", "identity.nationality", "identity.date_of_birth", "identity.expiry_date", "identity.gender", F.col("mrz.status").alias("mrz_status"))


@query(
    f"""{_LINE}, v AS (SELECT l.o_orderkey AS k, o_orderdate, l.o_orderkey % 2 = 0 AND {sql_check_digit('substring(line2, 1, 9)')} = substring(line2, 10, 1) AS own, l.o_orderkey % 2 = 0 AS pair, line2 FROM line l JOIN orders o ON o.o_orderkey = l.o_orderkey),
    w AS (SELECT *, CASE WHEN pair THEN rtrim(substring(line2, 1, 9), '<') WHEN k % 3 = 1 THEN 'K1234567' END AS number, CASE k % 3 WHEN 0 THEN DATE '2024-02-01' WHEN 1 THEN DATE '2025-03-30' END AS issue,
        CASE WHEN pair THEN {sql_dmy(sql_mrz_date('substring(line2, 22, 6)'))} WHEN k % 3 = 0 THEN o_orderdate WHEN k % 3 = 1 THEN DATE '2026-01-01' END AS expiry, CASE WHEN pair THEN {sql_dmy(sql_mrz_date('substring(line2, 14, 6)'))} END AS birth FROM v),
    c AS (SELECT *, CASE WHEN expiry < issue THEN NULL ELSE expiry END AS until, k % 3 = 1 AS grid FROM w),
    n AS (SELECT *, (number IS NOT NULL AND length(number) BETWEEN 6 AND 9)::int AS number_ok, pair::int AS nation_ok, (until IS NOT NULL AND (birth IS NULL OR (birth <= TIMESTAMP '{AS_OF}' AND until > birth)))::int AS dates_ok FROM c)
    SELECT k AS o_orderkey, number AS passport_number, strftime(issue, '%d/%m/%Y') AS issue_date, strftime(until, '%d/%m/%Y') AS expiry_date, CASE WHEN k % 3 = 0 THEN 'MULTIPLE' END AS entries, CASE WHEN grid THEN 'ANNA MARIA VAIRAT' END AS holder_name, CASE WHEN grid THEN 'B1' END AS visa_class,
    'INVALID' AS status, round_even(100.0 * ((grid AND number IS NOT NULL AND pair AND until IS NOT NULL)::int + grid::int + number_ok + nation_ok + dates_ok) / 7, 0)::int AS validation_score,
    coalesce((until < TIMESTAMP '{AS_OF}')::int, 0) + (birth IS NULL)::int + (issue IS NULL)::int + 1 + (NOT grid)::int + (k % 3 <> 0)::int + 1 AS warnings FROM n"""
)
def visas_parsed_and_validated(table):
    """Visas of three layouts: Schengen labels, the US grid, and machine-readable lines that override both."""
    k = F.col("o_orderkey")
    schengen = F.concat(F.lit("SCHENGEN STATES\nVALID FROM 01-02-2024 UNTIL "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit("\nMULT NEW DELHI"))
    grid = F.lit("Issuing Post Name\nNEW DELHI\nControl Number\nx\nSe VAIRAT\nGiven Name Visa Type /Class\nANNA MARIA R B1\nPassport Number Sex\nK1234567 F\nIssue Date Expiration Date\n3O MAR 2025 O1 JAN 2026\nAnnotation\nX BLANKET L-1")
    rows = lines(table).join(table("orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    rows = rows.select("o_orderkey", F.when(k % 3 == 0, schengen).when(k % 3 == 1, grid).otherwise("").alias("text"), F.when(k % 2 == 0, F.rpad(F.lit("V<UTOERIKSSON<<ANNA"), 44, "<")).alias("line1"), F.when(k % 2 == 0, F.col("line2")).alias("line2"))
    rows = parsers.parse_visas(rows).withColumn("v", validation.validate_visa(F.col("identity"), F.lit(AS_OF).cast("timestamp")))
    return rows.select("o_orderkey", "identity.passport_number", "identity.issue_date", "identity.expiry_date", "identity.entries", "identity.holder_name", "identity.visa_class", "v.status", "v.validation_score", F.size("v.warnings").alias("warnings"))
