"""WARC archives: written as text splits, read back by verified record boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import cut, remove, scratch

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Fixed values of the archive format: the revisit profile and the media types.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEDIA = "application/http; msgtype=response"
#: Repeated payloads up to this many are broadcast; more are joined by a shuffle.
BROADCAST_REPEATS = 500_000
#: Records of one archive file.
FILE_RECORDS = 20_000
#: Bytes of a file whose candidate records are sorted together, and of the stretches that find a torn record's pieces.
STRETCH, FINE = 1 << 26, 1 << 20


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in bare upper-case base 32: four times ten hex digits are eight base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row into WARC files under ``path``.

    Of the rows with equal payloads, that with the largest id is a response and the others are revisits of it; a
    null payload is empty, a null url leaves its header out, line ends in urls are percent-encoded. Repeated ids are
    records of their own (of equal largest ids with equal payloads, each is a response). Records end with the
    separator that the text writer puts after each row, so no Python touches them.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(id_col).alias("key"),
        F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        payload.alias("payload"),
        base32_sha1(payload.cast("binary")).alias("digest"),
    )
    repeats = rows.select("digest", "key").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("first"))
    repeats = cut(repeats.filter("n > 1").select(F.col("digest").alias("again"), "first"), "repeats")
    if repeats.count() <= BROADCAST_REPEATS:
        repeats = F.broadcast(repeats)
    rows = rows.join(repeats, rows["digest"] == repeats["again"], "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    header = F.concat(
        F.lit(MAGIC),
        F.when(revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce("id", F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.lit(f"Content-Type: {MEDIA}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    out = rows.select(F.concat(header, block).alias("value"))
    out.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _pieces(spark, path: str) -> DataFrame:
    """Archive files cut at every magic, wherever it stands: file, place, bytes of the piece and its header."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    value = F.col("value")
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("at"),
        value.cast("binary").alias("bytes"),
        F.substring_index(value, END, 1).alias("head"),
    )


def _field(head: Column, name: str, pattern: str = r"[^\r\n]*") -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}: *({pattern})", 1)
    return F.when(found != "", found)


def reachable(candidates: DataFrame) -> DataFrame:
    """Of candidate records (file, start, next), those on the chain from their file's start.

    Candidates of one stretch that follow on from each other are one run; a run also begins where some record that is
    not followed at once points to. Runs are whole or not at all, and pointer jumping over them, doubling the step each
    round, marks those that the run at byte 0 leads to.
    """
    w = Window.partitionBy("file", F.floor(F.col("start") / STRETCH)).orderBy("start")
    rows = candidates.withColumn("on", F.coalesce(F.lead("start").over(w) == F.col("next"), F.lit(False)))
    rows = cut(rows, "chain")
    targets = rows.filter("NOT on").select(F.col("file").alias("tf"), F.col("next").alias("ts")).distinct()
    rows = rows.join(targets, (F.col("file") == F.col("tf")) & (F.col("start") == F.col("ts")), "left")
    first = ~F.coalesce(F.lag("on").over(w), F.lit(False)) | F.col("ts").isNotNull()
    rows = rows.withColumn("run", F.last(F.when(first, F.col("start")), ignorenulls=True).over(w)).drop("tf", "ts")
    rows = cut(rows, "runs")
    runs = rows.groupBy("file", "run").agg(F.max_by("next", "start").alias("to"))
    known = runs.select(F.col("file").alias("kf"), F.col("run").alias("kr"))
    step = cut(
        runs.join(known, (F.col("file") == F.col("kf")) & (F.col("to") == F.col("kr")), "left").select("file", "run", F.col("kr").alias("to"), (F.col("run") == 0).alias("in")),
        "step",
    )
    while not step.filter("to IS NOT NULL").isEmpty():
        hit = step.filter("`in` AND to IS NOT NULL").select(F.col("file").alias("hf"), F.col("to").alias("hr")).distinct()
        jump = step.select(F.col("file").alias("jf"), F.col("run").alias("jr"), F.col("to").alias("far"))
        moved = step.join(hit, (F.col("file") == F.col("hf")) & (F.col("run") == F.col("hr")), "left")
        moved = moved.join(jump, (F.col("file") == F.col("jf")) & (F.col("to") == F.col("jr")), "left")
        last, step = step, cut(moved.select("file", "run", F.col("far").alias("to"), (F.col("in") | F.col("hr").isNotNull()).alias("in")), "step")
        remove(rows.sparkSession, last.scratch_path)
    return rows.join(step.filter("`in`").select("file", "run"), ["file", "run"], "left_semi").drop("on", "run")


def read_archives(spark, path: str) -> DataFrame:
    """Every record that is reachable from its file's start: id, url, record_type, refers_to (strings), payload_bytes, payload_digest.

    Tasks read byte ranges and take every magic for a candidate; a candidate's successor is where its headers say
    that it ends, whether or not a magic stands there, so magics inside payloads are never reached. Candidates without
    a length, or with one that leads beyond their file, are none, whatever a payload quotes. A response's
    digest is computed from the payload that was read, a revisit's is its header's. Payloads that hold magics are put
    together again from their pieces. An empty folder of files gives an empty table.
    """
    pieces = _pieces(spark, path)
    stated = _field(F.col("head"), "Content-Length", "[0-9]+").try_cast("long")
    stated = F.when(stated <= F.col("file_size"), stated)  # longer than its file: not a record, and sums stay longs
    held = F.octet_length("head") + len(END) + stated <= F.octet_length("bytes")
    narrow = pieces.select(
        "file", "block", "at", "file_size", F.octet_length("bytes").alias("size"), F.octet_length("head").alias("head_size"), stated.alias("block_size"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        F.regexp_extract("head", r"(?im)^WARC-Record-ID: *<urn:page:([^>\r\n]*)>", 1).alias("id"),
        _field(F.col("head"), "WARC-Target-URI").alias("url"),
        _field(F.col("head"), "WARC-Payload-Digest").alias("stated"),
        F.regexp_extract("head", r"(?im)^WARC-Refers-To: *<urn:page:([^>\r\n]*)>", 1).alias("refers_to"),
        F.when(held, _payload(F.col("bytes"), F.octet_length("head") + len(END), stated)).alias("payload"),
    )
    # the first piece is what stands before the first magic
    placed = cut(_placed(cut(narrow, "pieces")).filter("no > 1").drop("no", "block", "at"), "placed")
    next_ = F.col("start") + len(MAGIC) + F.col("head_size") + len(END) + F.col("block_size") + len(END)
    valid = placed.filter("block_size IS NOT NULL").withColumn("next", next_).filter("next <= file_size").drop("file_size")
    kept = cut(reachable(valid), "records")
    whole = F.col("head_size") + len(END) + F.col("block_size") <= F.col("size")
    out = kept.filter(whole).select("id", "url", "record_type", "refers_to", "stated", "payload")
    torn = kept.filter(~whole)
    if not torn.isEmpty():
        out = out.unionByName(_mend(pieces, torn))
    revisit = F.col("record_type") == "revisit"
    return out.select(
        "id",
        "url",
        "record_type",
        F.when(F.col("refers_to") != "", F.col("refers_to")).alias("refers_to"),
        F.when(revisit, F.col("payload.stated")).otherwise(F.col("payload.size")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated", "^sha1:", "")).otherwise(F.col("payload.digest")).alias("payload_digest"),
    )


def _payload(data: Column, skip: Column, size: Column) -> Column:
    """Stated and true size and digest of the payload in a record's block, which begins after ``skip`` bytes of ``data`` and lies in it."""
    size = F.least(size, F.octet_length(data)).cast("int")
    block = F.substring(data, (skip + 1).cast("int"), size)
    http = F.substring_index(block.cast("string"), END, 1)
    payload = F.substring(block, F.octet_length(http) + 1 + len(END), size)
    stated = _field(http, "Content-Length", "[0-9]+").try_cast("long")
    return F.struct(stated.alias("stated"), F.octet_length(payload).cast("long").alias("size"), base32_sha1(payload).alias("digest"))


def _placed(pieces: DataFrame) -> DataFrame:
    """Add ``no``, a piece's number within its file, and ``start``, the offset of its magic: sums within blocks, and over blocks."""
    order = Window.partitionBy("file", "block").orderBy("at")
    inner = pieces.withColumns({
        "before": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "number": F.row_number().over(order),
    })
    blocks = pieces.groupBy("file", "block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block that was read
    sums = blocks.select("file", "block", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"past_{c}") for c in ("size", "n")])
    out = inner.join(sums, ["file", "block"]).withColumn("no", F.col("number") + F.col("past_n"))
    start = F.col("before") + F.col("past_size") + (F.col("no") - 2) * len(MAGIC)
    return out.withColumn("start", start).drop("before", "number", "past_size", "past_n")


def _mend(pieces: DataFrame, torn: DataFrame) -> DataFrame:
    """Records whose payloads hold magics: their files are read again, and their pieces joined in order.

    The second reading is placed by itself: offsets in the file are the same however it is cut into tasks.
    """
    files = torn.select("file").distinct()
    again = cut(pieces.join(files, "file", "left_semi").select("file", "block", "at", "bytes"), "again")
    placed = _placed(again.select("file", "block", "at", F.octet_length("bytes").alias("size"))).filter("no > 1")
    # a torn record owns the pieces up to its end; what looks like a record among them is none
    fine = lambda c: F.floor(F.col(c) / FINE)
    owner = torn.select("file", F.col("start").alias("owner"), F.col("next").alias("end"), F.explode(F.sequence(fine("start"), fine("next"))).alias("fine"))
    inside = placed.withColumn("fine", fine("start")).join(owner, ["file", "fine"]).filter("start >= owner AND start < end")
    parts = again.join(inside.select("file", "block", "at", "start", "owner"), ["file", "block", "at"])
    grouped = parts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "bytes"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["bytes"].cast("string")), MAGIC)
    joined = grouped.select("file", F.col("owner").alias("start"), text.cast("binary").alias("data"))
    both = torn.drop("payload").join(joined, ["file", "start"])
    return both.select("id", "url", "record_type", "refers_to", "stated", _payload(F.col("data"), F.col("head_size") + len(END), F.col("block_size")).alias("payload"))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch(spark, "warc")
    write_archives(pages, path)
    out = read_archives(spark, path)
    return out.select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


#: DuckDB SQL of op10_warc; base 32 is spelled five bits a digit.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
b AS (SELECT *, array_to_string([upper(substr('abcdefghijklmnopqrstuvwxyz234567',
        1 + CAST(((('0x' || substr(s, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) AS INTEGER), 1)) for i in range(0, 32)], '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS top FROM b)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""
