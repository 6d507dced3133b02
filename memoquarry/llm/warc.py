"""Operator 7, content-addressed WARC archive.

``write_archive`` makes two tables: ``payloads`` holds each distinct payload once under its
SHA-256, and ``headers`` holds the exact header block of every record.  ``read_archive``
parses the header blocks, checks every stored payload against its digest, and joins the two;
``reconstruct`` gives the bytes of the original records.  DataFrame functions only.

Payload bytes are shuffled once, already reduced to one per digest and task, so a payload
that a third of all pages share moves as a few rows.  Equal digests with different length or
different second hash raise an error instead of being merged.

Defined results: a null payload is empty; payloads under ``small`` bytes are always responses;
among rows with equal payload and equal smallest id the one first by url and row key responds;
a null id sorts after all others and is written as an empty record id; a null url has no target header; a url
with line ends is escaped (and marked so) in a way that gives back the same url; payloads are kept whole, however
long; repeated rows are records of their own; an empty table gives empty archives; other columns, whatever their names, are ignored.
The pages have no capture time, so records carry the one that is given (``date``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoquarry.llm.common import Scratch, keyed

SMALL = 100
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"


def _records(pages: DataFrame, scratch: Scratch, id_col: str, url_col: str, body_col: str) -> DataFrame:
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary"))
    return keyed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload")), scratch).withColumn("n", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))


def write_archive(pages: DataFrame, scratch: Scratch, small: int = SMALL, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), both written to the scratch folder."""
    records = _records(pages, scratch, id_col, url_col, body_col)
    stored = records.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("n").alias("n"), F.max("n").alias("n_most"), F.min(F.xxhash64("payload")).alias("h"), F.max(F.xxhash64("payload")).alias("h_most"))
    same = (F.col("n") == F.col("n_most")) & (F.col("h") == F.col("h_most"))
    payloads = scratch.write(stored.select("digest", F.when(same, F.col("payload")).otherwise(F.raise_error("two payloads have one digest").cast("binary")).alias("payload")), "payloads")
    facts = records.select("rid", "id", "url", "n", "digest")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "url", "rid")
    first = facts.filter(F.col("n") >= small).groupBy("digest").agg(F.min(place).alias("at"))
    linked = facts.join(first, "digest", "left")
    revisit = (F.col("n") >= small) & (F.col("at.rid") != F.col("rid"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    odd = F.regexp_like("url", F.lit("[\r\n]"))
    escaped = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = F.when(F.col("url").isNull(), F.lit("")).when(odd, F.concat(line("WARC-Target-URI", escaped), line("X-Target-URI-Escaped", F.lit("yes")))).otherwise(line("WARC-Target-URI", F.col("url")))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        target,
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("at.id"))))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(CRLF),
    )
    headers = scratch.write(linked.select("rid", header.alias("header")), "headers")
    return headers, payloads


def _field(name: str, pattern: str = "[^\r]*") -> F.Column:
    return F.regexp_extract("header", rf"\r\n{name}: ({pattern})\r\n", 1)


def parse_headers(headers: DataFrame) -> DataFrame:
    page = lambda x: F.nullif(F.regexp_extract(x, "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    target = _field("WARC-Target-URI")
    plain = F.replace(F.replace(F.replace(target, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    url = F.when(~F.contains("header", F.lit("\r\nWARC-Target-URI: ")), F.lit(None)).when(F.contains("header", F.lit("\r\nX-Target-URI-Escaped: yes\r\n")), plain).otherwise(target)
    return headers.select("rid", "header", _field("WARC-Type").alias("record_type"), page(_field("WARC-Record-ID")).alias("page_id"), page(_field("WARC-Refers-To")).alias("refers_to"), url.alias("url"), F.regexp_extract("header", "\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1).alias("digest"))


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row per record, from the archives alone; each stored payload is digested anew."""
    kept = payloads.select(F.col("digest"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    kept = kept.select("digest", "payload_bytes", F.when(F.col("digest") == F.col("payload_digest"), F.col("digest")).otherwise(F.raise_error("a stored payload does not have its digest").cast("string")).alias("payload_digest"))
    return parse_headers(headers).join(kept, "digest", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(rid, page_id, url, record): the bytes of each original record, header block, body and closing line ends.

    A revisit is given the full payload that it refers to.
    """
    joined = parse_headers(headers).join(payloads, "digest", "left")
    return joined.select("rid", "page_id", "url", F.concat(F.col("header").cast("binary"), F.col("payload"), F.lit(CRLF * 2).cast("binary")).alias("record"))


def archive_pages(pages: DataFrame, small: int = SMALL) -> DataFrame:
    scratch = Scratch(pages.sparkSession, "warc")
    return read_archive(*write_archive(pages, scratch, small))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN lead END AS refers_to
FROM m
"""
