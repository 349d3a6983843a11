"""WARC derivatives: metadata and plain-text conversion records made from responses, linked to them."""

from __future__ import annotations

import gzip
import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import c, fresh, table

#: When the derivatives of the query are dated; a parameter, so that a repeated run gives the same records.
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, warc_type string, target_uri string, warc_date string, http_headers string, payload binary"
DERIVED = ("record_id", "warc_type", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_date", "source_block_digest", "source_payload_digest", "source_headers", "content")

_BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul"
#: Patterns that Java's and RE2's engines read alike, and what takes their place, in this order.
STEPS = (
    (r"(?is)<script\b.*?(?:</script[^>]*>|\z)", " "),
    (r"(?is)<style\b.*?(?:</style[^>]*>|\z)", " "),
    (r"(?is)<title\b.*?(?:</title[^>]*>|\z)", " "),
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (rf"(?i)</?(?:{_BLOCKS})(?:[ \t\r\n/][^<>]*)?>", "\n"),
    (r"</?[A-Za-z!?][^<>]*>", ""),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"))
#: Comes last, both ways to write it at once: what it begins isn't a reference again.
AMPERSAND = "&(?:amp|#38);"
SPACES = ((r"[ \t\r\f\x0B\x{00A0}]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))
#: White space that SPACES makes a space, and all of SPACES but what begins a text where there is none of it. Groups: what stays of a run.
ODD, SPACED = r"[\t\r\f\x0B\x{00A0}]", r"[ \n](?:\z|(?=[ \n])(?:[ \n]*+\z|(?<=(\n))[ \n]++| *+(?:(\n)[ \n]*+|(?<=( ) ))))"
TITLE, LANGUAGE, LINK = r"(?is)<title[^>]*>(.*?)(?:</title|\z)", r"(?is)<html[^>]* lang=\"([^\"]*)\"", r"(?is)<a [^>]*?href=\"([^\"]*)\""


def _let(x: Column, f) -> Column:
    """f(x) where f names x more than once; x is made once."""
    return F.transform(F.array(x), f)[0]


def unescape(x: Column) -> Column:
    """Named references of ENTITIES and decimal ones; others stay as they are."""
    code = lambda e: F.regexp_replace(e, "[^0-9]", "").cast("long")
    sign = lambda e: F.decode(F.unhex(F.lpad(F.hex(code(e)), 8, "0")), "UTF-32")
    valid = lambda e: (code(e).between(32, 0xD7FF)) | (code(e).between(0xE000, 0x10FFFF))

    def decimal(x: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"(&#[0-9]{1,7};)"), 1))
        # & itself waits for the end
        return F.aggregate(F.filter(found, lambda e: valid(e) & (code(e) != 38)), x, lambda a, e: F.replace(a, e, sign(e)))

    def named(piece: Column, k: Column) -> Column:  # what follows an &; nothing that is put in begins or ends a reference
        out = F.when(k == 0, piece)
        for name, to in (*ENTITIES, ("&amp;", "&"), ("&#38;", "&")):
            out = out.when(F.startswith(piece, F.lit(name[1:])), F.concat(F.lit(to), F.substring(piece.cast("binary"), len(name), 0x7FFFFFFF).cast("string")))
        return out.otherwise(F.concat(F.lit("&"), piece))

    def decoded(x: Column) -> Column:
        x = F.when(F.contains(x, F.lit("&#")), decimal(x)).otherwise(x)
        return F.array_join(F.transform(F.split(x, "&"), named), "")

    return _let(x, lambda x: F.when(F.contains(x, F.lit("&")), decoded(x)).otherwise(x))


def _spaced(x: Column) -> Column:
    """As SPACES has it, in one pass where spaces and line ends are the only white space."""

    def spaced(x: Column) -> Column:
        one = F.when(F.rlike(x, F.lit(ODD)), F.regexp_replace(x, *SPACES[0])).otherwise(x)
        return F.ltrim(F.regexp_replace(one, SPACED, "$1$2$3"), F.lit(" \n"))

    return _let(x, spaced)


def stripped(html: Column) -> Column:
    for pattern, to in STEPS:
        html = F.regexp_replace(html, pattern, to)
    return html


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and the title go, block tags end lines, references are decoded."""
    return _spaced(unescape(stripped(html)))


def record_id(*parts: Column) -> Column:
    """A URN from the parts' digest: the same parts give the same identifier on any run."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def one_line(x: Column) -> Column:
    """A header's value; line ends would begin another header."""
    return F.trim(F.regexp_replace(x, r"[\r\n]+", " "))


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of pages, beside their id. A null page is a null payload; the id's hash makes the record id."""
    html = c(html_col).cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    parts = (F.lit("response"), F.coalesce(c(id_col).cast("string"), F.lit("")), F.coalesce(c(url_col), F.lit("")), F.coalesce(F.md5(html), F.lit("")))
    return pages.select(c(id_col).alias("page_id"), record_id(*parts).alias("record_id"), F.lit("response").alias("warc_type"), c(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_headers"), html.alias("payload"))


def derive(responses: DataFrame, date: str = DATE) -> DataFrame:
    """A metadata and a conversion record for each response; one narrow stage of built-in expressions.

    Takes the columns of RECORD, payload as text or UTF-8 bytes; columns that it doesn't know come along, a number
    added where a name clashes. Gives the columns of DERIVED: each record refers to its response's record id and
    carries the response's URI, date, HTTP headers and digests (of the payload and of headers and payload), the metadata
    record also in its block, with title, language, links and the text's length. Digests are SHA-256 in hexadecimal.
    The conversion's content is the whole text. Lengths are in bytes.

    Records of another type than response and those with a null payload or record id give no derivatives. A null URI or null
    headers give no such line and an empty string in the block's digest. An empty payload gives an empty text. Repeated
    responses give repeated derivatives, with the same identifiers. An empty table gives no rows.
    """
    known = {x.split()[0] for x in RECORD.split(", ")}
    extra = [x for x in responses.columns if x.lower() not in known]
    kept = fresh(DERIVED, *extra)
    r = responses.filter("warc_type = 'response' AND payload IS NOT NULL AND record_id IS NOT NULL")
    payload, head = F.col("payload").cast("string"), F.coalesce(F.col("http_headers"), F.lit(""))
    r = r.select(
        *(c(a).alias(f"__extra_{k}") for k, a in enumerate(extra)),
        F.col("record_id").alias("__source"), one_line(F.col("target_uri")).alias("target_uri"), F.col("warc_date").alias("source_date"), F.col("http_headers").alias("source_headers"),
        digest(F.concat(head, F.lit("\r\n\r\n"), payload)).alias("source_block_digest"), digest(payload).alias("source_payload_digest"), F.octet_length(payload).alias("__bytes"),
        stripped(payload).alias("__stripped"), one_line(_spaced(unescape(F.regexp_extract(payload, TITLE, 1)))).alias("__title"), one_line(F.regexp_extract(payload, LANGUAGE, 1)).alias("__language"),
        F.transform(F.regexp_extract_all(payload, F.lit(LINK), 1), lambda x: F.concat(F.lit("outlink: "), one_line(x))).alias("__links"),
    )
    # steps of their own, so that no step's text is made again where it is used twice
    r = r.withColumn("__text", _spaced(unescape(F.col("__stripped")))).drop("__stripped")
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x)
    headers = F.transform(F.split(F.col("source_headers"), "\r?\n"), lambda x: F.concat(F.lit("http-header: "), x))
    fields = F.concat(
        F.array_compact(F.array(
            line("title", F.col("__title")), line("language", F.col("__language")), line("text-characters", F.length("__text").cast("string")), line("source-record-id", F.col("__source")), line("source-date", F.col("source_date")),
            line("source-payload-length", F.col("__bytes").cast("string")), line("source-block-digest", F.col("source_block_digest")), line("source-payload-digest", F.col("source_payload_digest")),
        )),
        F.coalesce(headers, F.array().cast("array<string>")), F.col("__links"),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("content_type"), F.concat(F.concat_ws("\r\n", fields), F.lit("\r\n")).alias("content")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("__text").alias("content")),
    )
    made = r.withColumn("__made", F.explode(both))
    at = F.col("__made")
    values = {
        "record_id": record_id(at["kind"], F.col("__source"), at["content"]), "warc_type": at["kind"], "refers_to": F.col("__source"), "target_uri": F.col("target_uri"), "warc_date": F.lit(date), "content_type": at["content_type"],
        "content_length": F.octet_length(at["content"]).cast("long"), "block_digest": digest(at["content"]), "content": at["content"],
    }
    return made.select(*(c(f"__extra_{k}").alias(b) for k, b in enumerate(kept)), *(values.get(x, F.col(x)).alias(x) for x in DERIVED))


def record_bytes(derived: DataFrame, out_col: str = "record") -> DataFrame:
    """The derivatives as WARC/1.1 records, bytes in a column; headers whose value is null are left out."""
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x, F.lit("\r\n"))
    heads = F.concat_ws(
        "", F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")), line("WARC-Refers-To-Date", F.col("source_date")), line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    (out,) = fresh(derived.columns, out_col)
    return derived.withColumn(out, F.concat(heads, F.lit("\r\n"), F.col("content"), F.lit("\r\n\r\n")).cast("binary"))


def parse_warc(data: bytes):
    """Yields the rows of RECORD of a WARC file's bytes, plain or compressed by record; payload is what follows the
    HTTP headers, or the whole block of other records. ValueError where a record isn't whole."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        fields, name = {}, None
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and name:
                fields[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
        size = int(fields.get("content-length", -1))
        block = stream.read(max(size, 0))
        if size < 0 or len(block) < size:
            raise ValueError("a WARC record isn't whole")
        head, payload = None, block
        if fields.get("warc-type") == "response" and "http" in fields.get("content-type", "") and (end := re.search(rb"\r?\n\r?\n", block)):
            head, payload = block[: end.start()].decode("utf-8", "replace"), block[end.end() :]
        yield fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"), head, payload


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under a path, a task for a few files; each file is held in memory by one task."""
    kinds = [pa.string()] * 5 + [pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for row in parse_warc(data.as_py()):
                    held.append(row)
                    size += len(row[-1])
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion records of every page."""
    return derive(page_responses(table(spark, sf_dir, "pages")))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql() -> str:
    def e(x: str) -> str:  # a string with its line ends
        return "E" + _quoted(x.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t"))

    def steps(x: str, pairs) -> str:
        for pattern, to in pairs:
            x = f"regexp_replace({x}, {_quoted(pattern)}, {e(to)}, 'g')"
        return x

    def decoded(x: str) -> str:
        found = f"list_filter(list_distinct(regexp_extract_all({x}, '(&#[0-9]{{1,7}};)', 1)), lambda e: (CAST(e[3:-2] AS BIGINT) BETWEEN 32 AND 55295 OR CAST(e[3:-2] AS BIGINT) BETWEEN 57344 AND 1114111) AND e <> '&#38;')"
        x = f"list_reduce(list_prepend({x}, {found}), lambda a, e: replace(a, e, chr(CAST(e[3:-2] AS INTEGER))))"
        for name, to in ENTITIES:
            x = f"replace({x}, {_quoted(name)}, {_quoted(to)})"
        return f"regexp_replace({x}, '{AMPERSAND}', '&', 'g')"

    def urn(x: str) -> str:
        return f"'<urn:uuid:' || {x}[1:8] || '-' || {x}[9:12] || '-' || {x}[13:16] || '-' || {x}[17:20] || '-' || {x}[21:32] || '>'"

    line = lambda x: f"trim(regexp_replace({x}, '[\\r\\n]+', ' ', 'g'))"
    crlf = e("\r\n")
    return f"""
WITH a AS (
  SELECT page_id, {line("url")} AS target_uri, html, 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(html) AS source_headers,
         md5('response' || chr(31) || coalesce(CAST(page_id AS VARCHAR), '') || chr(31) || coalesce(url, '') || chr(31) || coalesce(md5(html), '')) AS h,
         {steps("html", STEPS)} AS stripped, regexp_extract(html, {_quoted(TITLE)}, 1) AS title0
  FROM pages WHERE html IS NOT NULL),
b AS (
  SELECT *, {urn("h")} AS refers_to, 'sha256:' || sha256(source_headers || {e(chr(13) + chr(10)) } || {crlf} || html) AS source_block_digest, 'sha256:' || sha256(html) AS source_payload_digest,
         {steps(decoded("stripped"), SPACES)} AS text, {line(steps(decoded("title0"), SPACES))} AS title, {line(f"regexp_extract(html, {_quoted(LANGUAGE)}, 1)")} AS language,
         regexp_extract_all(html, {_quoted(LINK)}, 1) AS links
  FROM a),
d AS (
  SELECT *, array_to_string(list_concat(['title: ' || title, 'language: ' || language, 'text-characters: ' || length(text), 'source-record-id: ' || refers_to, 'source-date: {DATE}',
         'source-payload-length: ' || strlen(html), 'source-block-digest: ' || source_block_digest, 'source-payload-digest: ' || source_payload_digest],
         list_transform(string_split(source_headers, {crlf}), lambda x: 'http-header: ' || x), list_transform(links, lambda x: 'outlink: ' || {line("x")})), {crlf}) || {crlf} AS fields
  FROM b),
m AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, fields AS content FROM d
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM d),
n AS (SELECT *, md5(warc_type || chr(31) || refers_to || chr(31) || content) AS k FROM m)
SELECT page_id, {urn("k")} AS record_id, warc_type, refers_to, target_uri, '{DATE}' AS warc_date, content_type, CAST(strlen(content) AS BIGINT) AS content_length,
       'sha256:' || sha256(content) AS block_digest, '{DATE}' AS source_date, source_block_digest, source_payload_digest, source_headers, content
FROM n"""


SQL = _sql()
