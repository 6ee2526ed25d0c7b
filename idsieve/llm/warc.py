"""WARC derivatives: metadata and plain-text conversion records of response records.

Deriving is built-in expressions on columns: a response's HTTP header is split off, its fields and
digests are kept as source fields of the metadata record, and the body becomes plain text. Both
derivatives name the response in WARC-Refers-To; ids are digests of what they stand for, so a rerun
gives the same ones. Nothing is shuffled. Files are read record by record, by their lengths.
"""

from __future__ import annotations

import gzip
import html.entities
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

DATE = "1970-01-01T00:00:00Z"  # pages have none
VERSION = "WARC/1.1"
# Elements whose content is no text, and elements that begin a line.
HIDDEN = ["script", "style", "noscript", "template", "title"]
BLOCK = "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul".split()
#: Columns of a record and the fields that hold them.
FIELDS = {"record_id": "WARC-Record-ID", "type": "WARC-Type", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "source_payload_digest": "WARC-Source-Payload-Digest"}
READ_BYTES = 16 << 20  # of blocks in one batch

_q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: The attributes of a tag; a quoted value may hold what would end it. Java takes them possessively, so that nothing is looked at again
#: where a tag has no end; the SQL of the other engine, which never goes back, has plain quantifiers.
_ATTRIBUTES = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
#: Comments and hidden elements, in one pass from left to right; what has no end goes up to the end of the page.
_HIDDEN = ["!--(?:.*?-->|.*)", *(f"{tag}(?:\\s{_ATTRIBUTES})?>(?:.*?</{tag}\\s*>|.*)" for tag in HIDDEN)]
_UNSEEN = f"(?is)<(?:{'|'.join(_HIDDEN)})"  # alternatives that each had their own < would be tried at every character
_BLOCKS = f"(?i)</?(?:{'|'.join(BLOCK)})(?:\\s{_ATTRIBUTES})?/?>"
_TAGS = f"</?[a-zA-Z!]{_ATTRIBUTES}>"
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
_TITLE = r"(?is)<title(?:\s[^<>]*)?>(.*?)(?:</title|\z)"
_LANG = rf"(?i)<html\s(?:[^<>]*?\s)?lang{_VALUE}"
_LINK = rf"(?i)<a\s(?:[^<>]*?\s)?href{_VALUE}"
_CHARACTER = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def named_characters() -> dict[str, str]:
    """The named characters of the HTML standard by ``&name;``; a blank that may not be broken counts as a blank."""
    return {f"&{name}": char for name, char in html.entities.html5.items() if name.endswith(";")} | {"&nbsp;": " "}


def visible_text(html_: str) -> str:
    """SQL for the text of an HTML column without its hidden elements and tags; block elements begin lines."""
    out = f"regexp_replace({html_}, {_q(_UNSEEN)}, ' ')"
    out = f"regexp_replace({out}, {_q(_BLOCKS)}, '\\n')"
    return f"regexp_replace({out}, {_q(_TAGS)}, '')"


def decoded_characters(text: str) -> str:
    """SQL for a text with its numbered and named characters decoded, each once; unknown ones stay."""
    code = "CASE WHEN x LIKE '&#x%' OR x LIKE '&#X%' THEN try_cast(conv(substring(x, 4, length(x) - 4), 16, 10) AS int) ELSE try_cast(substring(x, 3, length(x) - 3) AS int) END"
    numbered = f"CASE WHEN ({code}) BETWEEN 32 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') ELSE x END"
    table = f"str_to_map({_q('\x01'.join(f'{name}\x02{char}' for name, char in named_characters().items()))}, '\x01', '\x02')"
    usual = " ".join(f"WHEN '{name}' THEN {_q(named_characters()[name])}" for name in ("&amp;", "&nbsp;", "&lt;", "&gt;", "&quot;", "&apos;"))
    char = f"CASE WHEN x LIKE '&#%' THEN {numbered} ELSE CASE x {usual} ELSE coalesce(try_element_at({table}, x), x) END END"
    pattern = _q(_CHARACTER)
    return f"CASE WHEN contains({text}, '&') THEN array_join(flatten(zip_with(split({text}, {pattern}, -1), transform(regexp_extract_all({text}, {pattern}, 0), x -> {char}), (p, c) -> array(p, coalesce(c, '')))), '') ELSE {text} END"


def plain_text(seen: str) -> str:
    """SQL for the final text: characters decoded, blanks collapsed, empty lines left out."""
    return tidy(decoded_characters(seen))


def tidy(text: str) -> str:
    """SQL for a text whose blanks are collapsed; runs with an end of line become one, so empty lines are left out. Single blanks are
    passed over, and other blanks are only looked for in texts that have some."""
    others = [_q(c) for c in "\t\r\f\x0b"]
    usual = f"CASE WHEN {' OR '.join(f'contains(t, {c})' for c in others)} THEN regexp_replace(t, '[\\\\t\\\\r\\\\f\\\\x0B]', ' ') ELSE t END"
    return f"element_at(transform(array({text}), t -> trim(BOTH '\\n ' FROM regexp_replace({usual}, ' *+(\\n)[\\n ]*+|( ) ++', '$1$2'))), 1)"


def _unquoted(value: str) -> str:
    return f"regexp_replace({value}, {_q('^["' + "'" + ']|["' + "'" + ']$')}, '')"


def _uuid(*parts: str) -> str:
    h = f"sha2(concat_ws('\\n', {', '.join(parts)}), 256)"
    cut = ", '-', ".join(f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat('<urn:uuid:', {cut}, '>')"


def responses_from_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record for each page, with page_id. Null columns count as empty."""
    rows = pages.selectExpr("page_id", "coalesce(cast(url AS string), '') AS target_uri", "coalesce(cast(html AS string), '') AS body")
    return rows.selectExpr(
        "page_id",
        _uuid("'response'", "coalesce(cast(page_id AS string), '')", "target_uri", "body") + " AS record_id",
        "'response' AS type",
        "cast(NULL AS string) AS refers_to",
        "target_uri",
        f"{_q(date)} AS date",
        "'application/http;msgtype=response' AS content_type",
        "concat('sha256:', sha2(body, 256)) AS payload_digest",
        "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', octet_length(body), '\\r\\n\\r\\n', body) AS block",
    )


def _header_and_body(block: str, binary: bool) -> tuple[str, str]:
    """SQL for the HTTP header of a block and for its body; a block without a header is all body."""
    text = f"decode({block}, 'ISO-8859-1')" if binary else block  # a character for each byte
    whole = f"CASE WHEN startswith({text}, 'HTTP/') THEN regexp_extract({text}, '(?s)^HTTP/.*?\\r?\\n\\r?\\n', 0) ELSE '' END"
    head = f"regexp_replace({whole}, '\\r?\\n\\r?\\n$', '')"
    return head, f"substring({block}, length({whole}) + 1)"


def derivatives(responses: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record, with all its other columns but those that a derivative has itself.

    Blocks are text or bytes; bytes are read as ISO-8859-1 where the HTTP header says so, else as UTF-8, and what is none
    becomes the replacement character. The source's payload digest goes with both; where it has none, it is taken of the
    body. The metadata record has all HTTP header lines, folded ones as one line and repeated ones each. A null
    block is an empty one. Records of other types are left out; repeated records give the same records again.
    """
    made = ["record_id", "type", "refers_to", "target_uri", "date", "content_type", "payload_digest", "source_payload_digest", "block", "title", "n_links"]
    kept = [f"`{c}`" for c in responses.columns if c not in made]
    binary = dict(responses.dtypes)["block"] == "binary"
    source_id, given, head, raw, body, seen, lang, links, text, record = scratch.unused(responses, "source_id", "given", "head", "raw", "body", "seen", "lang", "links", "text", "record")
    header, payload = _header_and_body("coalesce(block, X'')" if binary else "coalesce(block, '')", binary)
    rows = responses.where("type = 'response'").selectExpr(*kept, f"record_id AS {source_id}", "target_uri", "date", f"payload_digest AS {given}", f"regexp_replace({header}, '\\r?\\n[ \\t]+', ' ') AS {head}", f"{payload} AS {raw}")
    as_text = f"CASE WHEN {head} RLIKE '(?i)charset=\"?(iso-8859-1|latin-?1)' THEN decode({raw}, 'ISO-8859-1') ELSE make_valid_utf8(cast({raw} AS string)) END" if binary else raw
    rows = rows.withColumn(body, F.expr(as_text))
    rows = rows.selectExpr(
        *kept,
        source_id,
        "target_uri",
        "date",
        head,
        f"coalesce({given}, concat('sha256:', sha2({raw}, 256))) AS source_payload_digest",
        f"{visible_text(body)} AS {seen}",
        f"regexp_extract({body}, {_q(_TITLE)}, 1) AS title",
        f"{_unquoted(f'regexp_extract({body}, {_q(_LANG)}, 1)')} AS {lang}",
        f"transform(regexp_extract_all({body}, {_q(_LINK)}, 1), x -> {_unquoted('x')}) AS {links}",
    )
    decoded = decoded_characters("title")
    rows = rows.withColumns({text: F.expr(plain_text(seen)), "title": F.trim(F.regexp_replace(F.expr(decoded), "\\s+", " "))})
    lines = f"CASE WHEN {head} = '' THEN '' ELSE concat('source-header: ', regexp_replace({head}, '\\r?\\n', '\\r\\nsource-header: '), '\\r\\n') END"
    fields = f"concat('title: ', title, '\\r\\nlanguage: ', {lang}, '\\r\\nsource-payload-digest: ', source_payload_digest, '\\r\\n', {lines}, array_join(transform({links}, x -> concat('outlink: ', x, '\\r\\n')), ''))"
    both = f"array(named_struct('type', 'metadata', 'content_type', 'application/warc-fields', 'block', {fields}), named_struct('type', 'conversion', 'content_type', 'text/plain; charset=utf-8', 'block', {text}))"
    out = rows.selectExpr(*kept, source_id, "target_uri", "date", "source_payload_digest", "title", f"size({links}) AS n_links", f"explode({both}) AS {record}")
    return out.selectExpr(
        *kept,
        _uuid(f"{record}.type", source_id, f"{record}.block") + " AS record_id",
        f"{record}.type AS type",
        f"{source_id} AS refers_to",
        "target_uri",
        "date",
        f"{record}.content_type AS content_type",
        "cast(NULL AS string) AS payload_digest",
        "source_payload_digest",
        f"{record}.block AS block",
        "title",
        "n_links",
    )


def serialized(records: DataFrame) -> DataFrame:
    """One column ``value``: each record with its header lines. Blocks are text."""
    own = {f: c for c, f in FIELDS.items() if c in records.columns}
    order = ["WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Source-Payload-Digest"]
    lines = [(f, own[f]) for f in order if f in own] + [("WARC-Block-Digest", "concat('sha256:', sha2(block, 256))"), ("Content-Type", "content_type"), ("Content-Length", "octet_length(block)")]
    head = ", ".join(f"coalesce(concat('{name}: ', {column}, '\\r\\n'), '')" for name, column in lines)
    return records.selectExpr(f"concat('{VERSION}\\r\\n', {head}, '\\r\\n', block) AS value")


def write_warc(records: DataFrame, path: str, compressed: bool = False) -> None:
    """WARC files, one for each task; compressed ones are one gzip member each."""
    serialized(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip" if compressed else "none").text(path)


def records_in(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, str | None]]:
    """(fields in order, block, what is wrong or None) of each record of a file, whose gzip members may hold any part of it.

    Blocks are as long as Content-Length says. A file that breaks off ends with the record that is not whole, and one
    in which no record begins where it should ends there with a record without fields; both name what is wrong.
    """
    file = gzip.open(io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    fields: list[tuple[str, str]] = []
    try:
        while line := file.readline():
            if not line.strip():
                continue
            fields = []
            if not line.startswith(b"WARC/"):
                yield fields, line, "no record begins here"
                return
            while (line := file.readline()).strip():
                if line[:1] in b" \t" and fields:
                    fields[-1] = fields[-1][0], f"{fields[-1][1]} {line.decode('utf-8', 'replace').strip()}"
                else:
                    name, _, value = line.decode("utf-8", "replace").partition(":")
                    fields.append((name.strip(), value.strip()))
            given = next((v for n, v in fields if n.lower() == "content-length"), "")
            if not given.isdecimal():
                yield fields, b"", "no length"
                return
            block = file.read(int(given))
            yield fields, block, None if len(block) == int(given) else "breaks off"
    except (EOFError, zlib.error, gzip.BadGzipFile):
        yield fields, b"", "breaks off"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, compressed or not: the columns of FIELDS, headers (all fields in order), block (bytes) and error.

    A record's place follows from the lengths before it, so a file is read by one task; there are many, and each is
    of a bounded size (spark.sql.sources.binaryFile.maxLength at most).
    """
    schema = ", ".join(f"{c} string" for c in FIELDS) + ", headers array<struct<name: string, value: string>>, block binary, error string"
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            columns = [[r[i] for r in rows] for i in range(len(FIELDS))]
            headers = [[{"name": n, "value": v} for n, v in r[-3]] for r in rows]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(headers, kind), pa.array([r[-2] for r in rows], pa.binary()), pa.array([r[-1] for r in rows], pa.string())], [*FIELDS, "headers", "block", "error"])

        for files in batches:
            for content in files.column("content"):
                rows, size = [], 0
                for fields, block, error in records_in(content.as_py()):
                    first = {n.lower(): v for n, v in reversed(fields)}
                    rows.append((*(first.get(f.lower()) or None for f in FIELDS.values()), fields, block, error))
                    size += len(block)
                    if size >= READ_BYTES:
                        yield batch()
                        rows, size = [], 0
                if rows:
                    yield batch()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of every page.

    Null url or html counts as empty. Repeated rows give the same records again. An empty table gives none.
    """
    records = derivatives(responses_from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.selectExpr(
        "page_id",
        "type",
        "record_id",
        "refers_to",
        "target_uri",
        "content_type",
        "source_payload_digest",
        "concat('sha256:', sha2(block, 256)) AS block_digest",
        "cast(octet_length(block) AS bigint) AS content_length",
        "cast(n_links AS bigint) AS n_links",
        "title",
    )


def _oracle() -> str:
    """The same in DuckDB's SQL."""
    e = lambda s: "'" + s.replace("'", "''") + "'"
    plain = lambda pattern: re.sub(r"([+*?])\+", r"\1", pattern)  # noqa: E731  possessive quantifiers as plain ones
    unseen = "(?is)" + "|".join(f"<{x}" for x in _HIDDEN)
    text = f"regexp_replace(body, {e(plain(unseen))}, ' ', 'g')"
    text = f"regexp_replace({text}, {e(plain(_BLOCKS))}, chr(10), 'g')"
    text = f"regexp_replace({text}, {e(plain(_TAGS))}, '', 'g')"
    code = "CASE WHEN x LIKE '&#x%' OR x LIKE '&#X%' THEN try_cast('0x' || substring(x, 4, length(x) - 4) AS int) ELSE try_cast(substring(x, 3, length(x) - 3) AS int) END"
    numbered = f"CASE WHEN ({code}) BETWEEN 32 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr({code}) ELSE x END"
    names = named_characters()
    table = f"MAP([{', '.join(map(e, names))}], [{', '.join(map(e, names.values()))}])"

    def characters(of: str) -> str:
        parts = f"list_transform(regexp_extract_all({of}, {e(_CHARACTER)}), lambda x: CASE WHEN x LIKE '&#%' THEN {numbered} ELSE coalesce({table}[x], x) END)"
        return f"array_to_string(list_transform(list_zip(regexp_split_to_array({of}, {e(_CHARACTER)}), {parts}), lambda p: p[1] || coalesce(p[2], '')), '')"

    unquoted = lambda of: f"regexp_replace({of}, {e('^["' + "'" + ']|["' + "'" + ']$')}, '', 'g')"
    blanks = lambda of: f"regexp_replace({of}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    lines = lambda of: f"trim(regexp_replace({blanks(of)}, ' ?\\n[\\n ]*', chr(10), 'g'), chr(10) || ' ')"

    def uuid(*parts: str) -> str:
        h = f"sha256(concat_ws(chr(10), {', '.join(parts)}))"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    crlf = "chr(13) || chr(10)"
    return f"""WITH source AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS body FROM pages),
    response AS (SELECT *, {uuid("'response'", "coalesce(page_id::varchar, '')", "target_uri", "body")} AS source_id, 'sha256:' || sha256(body) AS payload_digest,
        'source-header: HTTP/1.1 200 OK' || {crlf} || 'source-header: Content-Type: text/html; charset=utf-8' || {crlf} || 'source-header: Content-Length: ' || strlen(body) || {crlf} AS head,
        regexp_extract(body, {e(_TITLE)}, 1) AS said, {unquoted(f"regexp_extract(body, {e(_LANG)}, 1)")} AS lang, list_transform(regexp_extract_all(body, {e(_LINK)}, 1), lambda x: {unquoted("x")}) AS links, {text} AS seen FROM source),
    decoded AS (SELECT *, trim(regexp_replace({characters("said")}, '\\s+', ' ', 'g')) AS title, {lines(characters("seen"))} AS plain FROM response),
    record AS (SELECT *, 'metadata' AS type, 'application/warc-fields' AS content_type, 'title: ' || title || {crlf} || 'language: ' || lang || {crlf} || 'source-payload-digest: ' || payload_digest || {crlf} || head || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {crlf}), ''), '') AS block FROM decoded
        UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', plain FROM decoded)
    SELECT page_id, type, {uuid("type", "source_id", "block")} AS record_id, source_id AS refers_to, target_uri, content_type, payload_digest AS source_payload_digest, 'sha256:' || sha256(block) AS block_digest,
        strlen(block)::bigint AS content_length, len(links)::bigint AS n_links, title FROM record"""


OP2_SQL = _oracle()
