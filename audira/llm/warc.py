"""WARC archives: write one record per page, read them back by boundary-chain verification.

Writing. Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is a response record,
the others are revisit records that refer to it; smaller payloads are all responses. Records are lines of Spark's text
writer, so its committer writes the files and a lost executor leaves no half-written archive.

Reading. Archives are read in splits. Everywhere where the magic line ``WARC/1.0`` stands a record may begin, but payloads
may hold that line too, or whole records.

1. Each task cuts its split at the magic and emits, for every candidate, its offset and the offset of its successor, which
   follows from Content-Length. Offsets inside the file follow from the bytes that all earlier splits of the file emitted.
2. Inside a split the tasks follow the successors: each candidate gets the offset at which its chain leaves the split, and
   its place in the tree of chains, from which "lies on the chain of" is an interval test.
3. Between splits pointer jumping from the file's start doubles the distance each round and finds, for each split, the one
   candidate at which the chain of the file enters. Candidates on the chain of that entry are records, all others are not.
4. A payload that holds the magic is put together from its pieces, in a second pass that runs only if there is one.

A null html is an empty payload, a null url has no WARC-Target-URI line, a null page_id is written as the id ``null`` and
read as null; it loses against any other page_id. Equal payloads with the same largest page_id are all responses. White
space and control characters in urls are escaped. Empty tables give no records. A file that does not begin with the magic
has no records; after a broken record its file has no further ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from audira.llm.shared import map_batches, new_folder, pick, same, settle

MAGIC = "WARC/1.0\r\n"
LINE = "\r\n"
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 5 hexadecimal digits make 4 of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def with_record_types(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html -> also payload, n_bytes, digest, refers_to (null: response).

    Only payloads that occur more than once are joined back, by digest; a payload that a third of all pages share is counted
    before the shuffle, and its join is split unless the table of repeated payloads is small enough to be sent.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.withColumns({"payload": payload, "n_bytes": F.octet_length(payload).cast("long")}).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    groups = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    repeated = settle(groups.where("n > 1").select(F.col("digest").alias("r_digest"), F.col("n_bytes").alias("r_bytes"), "largest"))
    joined = rows.join(repeated, (F.col("digest") == F.col("r_digest")) & (F.col("n_bytes") == F.col("r_bytes")), "left")
    revisit = F.col("r_digest").isNotNull() & ~same(F.col("page_id"), F.col("largest"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("largest"))).drop("r_digest", "r_bytes", "largest")


def record_text(date: str) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(LINE))

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))

    revisit = F.col("refers_to").isNotNull()
    address = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", address)).otherwise(""),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(LINE),
        F.when(revisit, "").otherwise(F.col("payload")),
        F.lit(LINE + "\r"),  # the writer adds the last line feed
    )


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    rows = pick(pages, page_id, url, html).toDF("page_id", "url", "html")
    with_record_types(rows, min_bytes).select(record_text(date).alias("value")).write.option("lineSep", "\n").text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines, in file order within each split."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("chunk"))


def _parsed(chunk: bytes) -> tuple[int | None, int | None, dict[str, str]]:
    """Bytes of the header lines, Content-Length, the lines; nulls if it is no header."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None, None, {}
    lines = dict(x.split(":", 1) for x in chunk[:end].decode("utf-8", "replace").split(LINE) if ":" in x)
    lines = {k.strip().lower(): v.strip() for k, v in lines.items()}
    length = lines.get("content-length", "")
    return (end + 4, int(length), lines) if length.isascii() and length.isdigit() else (None, None, {})


CANDIDATE = (
    "file string, block long, place long, size long, total long, successor long, leaves long, low long, high long, header long, length long, "
    "record_type string, record_id string, target_uri string, refers_to string, stated_digest string, payload_digest string, chunk_md5 string"
)
FIELDS = [f.split()[0] for f in CANDIDATE.split(", ")]
KINDS = [pa.string() if f.split()[1] == "string" else pa.int64() for f in CANDIDATE.split(", ")]


def _linked(rows: list[dict]) -> pa.RecordBatch:
    """Follow the chains of one split. Places are relative to the first byte that the split emits.

    ``leaves``: where the chain leaves the split (null: it breaks inside). ``low`` and ``high``: the candidate's interval in
    the tree of chains; a candidate lies on the chain of another if its interval holds the other's ``low``.
    """
    total = sum(r["size"] + len(MAGIC) for r in rows)
    at = {r["place"]: r for r in rows}
    for r in rows:
        r |= {"total": total, "count": 1, "leaves": None}
    for r in rows:  # successors stand behind, so counts are complete when they are passed on
        if (after := at.get(r["successor"])) is not None:
            after["count"] += r["count"]
    next_root = 0
    for r in reversed(rows):
        after = at.get(r["successor"])
        if after is None:
            r["low"], next_root = next_root, next_root + r["count"]
            if r["successor"] is not None and r["successor"] >= total - len(MAGIC):
                r["leaves"] = r["successor"]
        else:
            r["low"], r["leaves"] = after["free"], after["leaves"]
            after["free"] += r["count"]
        r["free"], r["high"] = r["low"] + 1, r["low"] + r["count"]
    return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], k) for f, k in zip(FIELDS, KINDS, strict=True)], names=FIELDS)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk. ``place`` is the magic's offset from the split's first emitted byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, rows, place = None, [], 0
        for batch in batches:
            for file, block, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if split != (file, block):
                    if rows:
                        yield _linked(rows)
                    split, rows, place = (file, block), [], 0
                header, length, lines = _parsed(chunk)
                whole = header is not None and header + length <= len(chunk)
                digest = base64.b32encode(hashlib.sha1(memoryview(chunk)[header : header + length]).digest()).decode() if whole else None
                rows.append(
                    {
                        "file": file, "block": block, "place": place - len(MAGIC), "size": len(chunk), "header": header, "length": length,
                        "successor": None if header is None else place + header + length + len(LINE) * 2,
                        "record_type": lines.get("warc-type"), "record_id": lines.get("warc-record-id"), "target_uri": lines.get("warc-target-uri"),
                        "refers_to": lines.get("warc-refers-to"), "stated_digest": lines.get("warc-payload-digest"), "payload_digest": digest,
                        "chunk_md5": hashlib.md5(chunk, usedforsecurity=False).hexdigest(),
                    }
                )
                place += len(chunk) + len(MAGIC)
        if rows:
            yield _linked(rows)

    return map_batches(_chunks(spark, path), run, CANDIDATE)


def with_offsets(found: DataFrame) -> DataFrame:
    """Offsets in the file: a split begins where all earlier ones of its file end. One row per split enters the window."""
    splits = found.groupBy("file", "block").agg(F.first("total").alias("total"))
    before = F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = splits.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"))
    rows = found.join(bases, ["file", "block"])
    return rows.withColumns({"offset": F.col("base") + F.col("place"), "next": F.col("base") + F.col("successor"), "leaves": F.col("base") + F.col("leaves")})


def chain_entries(found: DataFrame) -> DataFrame:
    """(file, block, entry): the candidate at which each file's chain enters a split, by pointer jumping from offset 0."""
    exits = found.where("leaves is not null").select("file", F.col("leaves").alias("offset")).distinct()
    jumps = found.join(exits, ["file", "offset"], "left_semi").select("file", "offset", F.col("leaves").alias("to"))
    start = found.where("offset = 0").select("file", "offset", F.col("leaves").alias("to"))
    # Only candidates that some chain enters matter: about one per split.
    jumps = settle(jumps.where("to is not null"))
    reached = settle(start)
    while True:
        targets = found_targets(reached, jumps)
        more = settle(targets.join(reached, ["file", "offset"], "left_anti"))
        if more.isEmpty():
            break
        reached = settle(reached.select("file", "offset", "to").union(more))
        doubled = jumps.join(jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond")), ["file", "to"])
        jumps = settle(doubled.select("file", "offset", F.col("beyond").alias("to")).union(jumps).distinct())
    return found.join(reached.select("file", "offset").distinct(), ["file", "offset"], "left_semi").select("file", "block", F.col("low").alias("entry"))


def found_targets(reached: DataFrame, jumps: DataFrame) -> DataFrame:
    """Where the jumps lead from the offsets reached so far."""
    first = reached.where("to is not null").select("file", F.col("to").alias("offset"))
    further = reached.select("file", "offset").join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
    return first.union(further).distinct().withColumn("to", F.lit(None).cast("long"))


def pieces(found: DataFrame, records: DataFrame) -> DataFrame:
    """(file, chunk_md5, offset, owner): the chunks that make up payloads that hold the magic.

    Chunks that are no records, and records whose payload is not in one chunk, in offset order: a chunk belongs to the last
    such record before it.
    """
    split = records.where("payload_digest is null").select("file", "offset", F.col("next").alias("owner_next"))
    rows = found.join(records.where("payload_digest is not null").select("file", "offset"), ["file", "offset"], "left_anti")
    rows = rows.select("file", "chunk_md5", "offset").join(split, ["file", "offset"], "left")
    owner = F.last(F.when(F.col("owner_next").isNotNull(), F.struct("offset", "owner_next")), ignorenulls=True).over(Window.partitionBy("file").orderBy("offset"))
    return rows.withColumn("owner", owner).where("offset < owner.owner_next").select("file", "chunk_md5", "offset", F.col("owner.offset").alias("owner"))


def read_payloads(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(file, owner, joined): the chunks of each owner with the magic between them.

    A chunk is found again by its content. Its place would not do: where a file is split depends on settings and on the
    number of cores at the time of reading, and both may differ between two readings. A missing chunk is an error.
    """
    needed = wanted.select(F.col("file").alias("of"), F.col("chunk_md5").alias("sought")).distinct()
    read = _chunks(spark, path).select("file", "chunk", F.md5("chunk").alias("md5"))
    read = read.join(needed, (F.col("file") == F.col("of")) & (F.col("md5") == F.col("sought")), "left_semi")
    once = read.groupBy(F.col("file").alias("in_file"), "md5").agg(F.first("chunk").alias("chunk"))
    rows = wanted.join(once, (F.col("file") == F.col("in_file")) & (F.col("chunk_md5") == F.col("md5")), "left")
    lost = F.raise_error(F.format_string("%s: the chunk at %s is gone", "file", "offset")).cast("binary")
    parts = F.sort_array(F.collect_list(F.struct("offset", F.coalesce("chunk", lost).alias("chunk"))))
    glue = F.lit(MAGIC.encode())
    joined = F.aggregate(parts, F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x["chunk"]).otherwise(F.concat(a, glue, x["chunk"])))
    return rows.groupBy("file", "owner").agg(joined.alias("joined"))


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records: file, offset, record_type, record_id, target_uri, refers_to, stated_digest, length, payload_digest (and payload)."""
    found = settle(with_offsets(settle(candidates(spark, path))))
    entries = settle(chain_entries(found))
    on_chain = (F.col("low") <= F.col("entry")) & (F.col("entry") < F.col("high"))
    records = settle(found.join(entries, ["file", "block"]).where(on_chain & F.col("next").isNotNull() & (F.col("offset") >= 0)).drop("entry"))
    split = records.where("payload_digest is null")
    out = ["file", "offset", "record_type", "record_id", "target_uri", "refers_to", "stated_digest", "length", "payload_digest"]
    if not with_payload and split.isEmpty():
        return records.select(*out)
    wanted = pieces(found, records)
    if with_payload:
        own = records.where("payload_digest is not null").select("file", "chunk_md5", "offset", F.col("offset").alias("owner"))
        wanted = wanted.union(own)
    joined = read_payloads(spark, path, settle(wanted)).withColumnRenamed("owner", "offset")
    rows = records.join(joined, ["file", "offset"], "left")
    payload = F.substring(F.col("joined"), F.col("header").cast("int") + 1, F.col("length").cast("int"))
    digest = F.coalesce(F.col("payload_digest"), base32_sha1(payload))
    rows = rows.withColumns({"payload_digest": digest, "payload": payload})
    return rows.select(*out, *["payload"] * with_payload)


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def warc_report(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    A revisit has no payload of its own: its size is that of the response it refers to.
    """
    spark, path = pages.sparkSession, new_folder(pages.sparkSession)
    write_warc(pages, path, page_id, url, html, min_bytes)
    records = settle(read_warc(spark, path).withColumns({"page_id": page_of(F.col("record_id")), "refers_to": page_of(F.col("refers_to"))}))
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("to_page"), F.col("payload_digest").alias("to_digest"), F.col("length").alias("to_length")).distinct()
    revisits = records.where("record_type = 'revisit'").withColumn("digest", F.substring_index("stated_digest", ":", -1))
    met = revisits.join(responses, (F.col("refers_to") == F.col("to_page")) & (F.col("digest") == F.col("to_digest")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    whole = records.where("record_type = 'response'").withColumn("payload_bytes", F.col("length"))
    again = met.withColumns({"payload_bytes": F.col("to_length"), "payload_digest": F.col("to_digest")})
    return whole.select(*columns).union(again.select(*columns))
