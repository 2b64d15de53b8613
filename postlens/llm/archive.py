"""A content-addressed web archive.

``write_archive`` turns pages into WARC records and stores them in two tables:

* ``payloads``: every distinct payload once, by its SHA-1. The digest is
  verified: within a digest, payloads are told apart by their full bytes.
* ``records``: for every page the exact header block of its WARC record, the
  digest of its payload, and by which payload row the record is put together.

``read_archive`` joins the two, puts every record together again (header block,
payload, end), parses the header block and recomputes the digest.

Of the records with equal payloads of at least ``LEAST_BYTES`` bytes, that of
the largest page_id is a response, and the others are revisits that refer to
it; smaller payloads are all responses. A revisit record has no payload block
of its own in WARC, but its page's payload is in the store all the same.

A payload that a third of all pages share is one row of the store. Its records
are dealt to as many copies of the row, made when reading, as it has thousands
of records, so no reader gets more than about ``PER_COPY`` records of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import text_of
from postlens.session import scratch_path

LEAST_BYTES = 1000
PER_COPY = 1000
CRLF = "\r\n"


def _header(record_type: Column) -> Column:
    """The exact header block of a record, without the empty line after it."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    is_revisit = record_type == "revisit"
    some = lambda value: F.coalesce(value, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", record_type),
        line("WARC-Date", F.col("date")),
        line("WARC-Record-ID", urn(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))),
        # a URI has no line breaks; they would end the header line
        some(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        some(F.when(is_revisit, line("WARC-Refers-To", urn(F.col("first_id"))))),
        some(F.when(is_revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )


def _date(captured: Column) -> Column:
    """A time as WARC has it: in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(captured, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", captured: str | None = None) -> None:
    """Writes the tables ``payloads`` and ``records`` under ``path``.

    ``captured`` names the column with the time of capture; without one, and
    where it is null, a record's date is the time of this call. Null html is the empty payload; a null url has no target line. Pages with
    equal ids are records of their own; a null page_id is a page that no
    revisit refers to while another page has the payload. Further columns are
    not archived. An empty table makes an empty archive.
    """
    body = F.encode(text_of(html), "UTF-8")
    now = F.current_timestamp()
    rows = pages.select(
        _date(now if captured is None else F.coalesce(F.col(captured).cast("timestamp"), now)).alias("date"),
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.sha1(body).alias("digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.xxhash64(body).alias("check"),
        body.alias("payload"),
    )
    # copies meet by digest and full bytes; each task first keeps one row for each of its payloads
    stored = rows.groupBy("digest", "check", "payload_bytes", "payload").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    stored = stored.withColumn("copies", F.ceil(F.col("n") / PER_COPY).cast("int"))
    stored.write.parquet(f"{path}/payloads")
    known = pages.sparkSession.read.schema(stored.schema).parquet(f"{path}/payloads").drop("payload")
    # the SHA-1, the second hash and the length together name the payload row
    records = rows.drop("payload").join(known.drop("n"), ["digest", "check", "payload_bytes"], "left")
    large = F.col("payload_bytes") >= LEAST_BYTES
    first = F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(large & ~first & F.col("first_id").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))
    records.select(
        "page_id",
        _header(kind).alias("header"),
        "digest",
        "check",
        "payload_bytes",
        F.pmod(F.xxhash64("page_id", "url"), F.col("copies")).cast("int").alias("copy"),
    ).write.parquet(f"{path}/records")


def read_archive(spark, path: str) -> DataFrame:
    """One row per record: page_id, record (the bytes of the WARC record as
    written), payload (its page's bytes: cut out of the record, or for a revisit,
    which has none, the store's), payload_bytes, payload_digest (recomputed),
    record_type and refers_to (parsed from the header block), and intact (length,
    digest and end of the record agree with its header)."""
    store = spark.read.parquet(f"{path}/payloads")
    copies = store.select("digest", "check", "payload_bytes", "payload", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    joined = spark.read.parquet(f"{path}/records").join(copies, ["digest", "check", "payload_bytes", "copy"])
    field = lambda name: F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    page = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1)
    is_revisit = field("WARC-Type") == "revisit"
    empty, end, both = (F.encode(F.lit(x), "UTF-8") for x in ("", CRLF, CRLF * 2))
    header = F.encode("header", "UTF-8")
    built = joined.select(
        F.when(page("WARC-Record-ID") != "", page("WARC-Record-ID").cast("long")).alias("page_id"),
        F.concat(header, end, F.when(is_revisit, empty).otherwise(F.col("payload")), both).alias("record"),
        F.col("payload").alias("of_store"),
        (F.octet_length(header) + len(CRLF)).alias("block_at"),
        field("Content-Length").cast("int").alias("block_bytes"),
        field("WARC-Type").alias("record_type"),
        F.when(is_revisit, page("WARC-Refers-To").cast("long")).alias("refers_to"),
        field("WARC-Payload-Digest").alias("stated"),
    )
    block = F.expr("substring(record, block_at + 1, block_bytes)")
    cut = built.withColumn("payload", F.when(F.col("record_type") == "revisit", F.col("of_store")).otherwise(block))
    parsed = cut.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    ends = (F.octet_length("record") == F.col("block_at") + F.col("block_bytes") + len(CRLF * 2)) & (F.expr("substring(record, block_at + block_bytes + 1)") == both)
    whole = (F.col("stated") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & ends & ((F.col("record_type") != "revisit") | (F.col("block_bytes") == 0))
    return parsed.select(
        "page_id", "record", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce(whole, F.lit(False)).alias("intact")
    )


def sound(records: DataFrame) -> DataFrame:
    """The rows of ``read_archive``; a record that is not intact fails the job."""
    broken = F.raise_error(F.concat(F.lit("the record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" is not intact")))
    return records.withColumn("payload_digest", F.when(F.col("intact"), F.col("payload_digest")).otherwise(broken.cast("string")))


def archived(pages: DataFrame, **columns) -> DataFrame:
    """The pages written to a new archive in the shared folder and read back."""
    path = scratch_path(pages.sparkSession, "archive")
    write_archive(pages, path, **columns)
    return read_archive(pages.sparkSession, path)


