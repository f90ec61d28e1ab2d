"""WARC records, and the assembly of each capture's request, response and metadata records into one row."""

from __future__ import annotations

import gzip
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import cut
from vecloom.llm.components import components

RECORD = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, block binary, intact boolean"
ANSWERS = ("response", "revisit", "resource")
_DATE = "2024-01-01T00:00:00Z"


def _raw(kind: str, rid: Column, uri: Column, concurrent: Column | None, content_type: str, block: Column) -> Column:
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), rid, F.lit("\r\nWARC-Target-URI: "), uri, F.lit(f"\r\nWARC-Date: {_DATE}")]
    if concurrent is not None:
        head += [F.lit("\r\nWARC-Concurrent-To: "), concurrent]
    head += [F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n")]
    return F.concat(*head, block, F.lit("\r\n\r\n"))


def records_of_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(raw): a serialised request, response and metadata record for each page, as a crawler writes them.

    The request is concurrent to the response; so is the metadata of pages with an even id, while that of others is
    concurrent to the request. Null urls and bodies count as empty, and line ends in urls are
    written as %0D and %0A; rows with a null id are left out, for they can't be
    named. Repeated rows give repeated records.
    """
    at = F.col(id_col).cast("string")
    rid = lambda kind: F.concat(F.lit("<urn:uuid:"), F.md5(F.concat(F.lit(f"{kind}:"), at)), F.lit(">"))
    uri = F.replace(F.replace(F.coalesce(F.col(url_col), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce(F.col(html_col), F.lit("")))
    asked = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n"))
    about = F.concat(F.lit("via: "), uri, F.lit("\r\nbytes: "), F.octet_length(body).cast("string"))
    even = F.pmod(F.xxhash64(at), F.lit(2)) == 0 if pages.schema[id_col].dataType.simpleString() == "string" else F.pmod(F.col(id_col), F.lit(2)) == 0
    raws = F.array(
        _raw("request", rid("request"), uri, rid("response"), "application/http; msgtype=request", asked),
        _raw("response", rid("response"), uri, None, "application/http; msgtype=response", body),
        _raw("metadata", rid("metadata"), uri, F.when(even, rid("response")).otherwise(rid("request")), "application/warc-fields", about),
    )
    return pages.where(F.col(id_col).isNotNull()).select(F.explode(raws).alias("raw"))


def parse(raws: DataFrame, raw_col: str = "raw") -> DataFrame:
    """The columns of RECORD for each serialised record, text or binary; what has no record id or type is left out.

    The block are the octets that Content-Length states; what lies behind them is no part of it. A record that ends before
    has the octets that are there, and one without a valid Content-Length those up to its end, without the two line ends
    that close a record; both aren't intact. A null is left out, a head without an end has an empty block.
    """
    raw = F.col(raw_col).cast("binary")
    text = F.col(raw_col).cast("string")
    head = F.substring_index(text, "\r\n\r\n", 1)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?imd)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))
    split = raws.select(raw.alias("raw"), head.alias("head"))
    split = split.withColumn("stated", field("Content-Length"))
    valid = F.col("stated").rlike("^[0-9]{1,10}$")
    rest = split.select("*", F.expr("substring(raw, octet_length(head) + 5, octet_length(raw))").alias("rest"), F.when(valid, F.col("stated").cast("bigint")).alias("length"))
    closed = F.expr("if(right(hex(substring(rest, -4, 4)), 8) = '0D0A0D0A', octet_length(rest) - 4, octet_length(rest))")
    size = F.least(F.coalesce(F.col("length"), closed.cast("bigint")), F.lit(2147483647)).cast("int")
    return rest.select(
        field("WARC-Record-ID").alias("record_id"),
        F.lower(field("WARC-Type")).alias("type"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Date").alias("date"),
        F.regexp_extract_all("head", F.lit(r"(?imd)^WARC-Concurrent-To:[ \t]*(.*?)[ \t]*\r?$"), F.lit(1)).alias("concurrent_to"),
        F.substring("rest", F.lit(1), size).alias("block"),
        (F.col("length").isNotNull() & (F.octet_length("rest") >= F.col("length"))).alias("intact"),
    ).where("record_id is not null and type is not null")


def read(spark: SparkSession, paths: list[str], batch_bytes: int = 16 << 20) -> DataFrame:
    """The columns of RECORD for each record in WARC files (plain or gzip), one task a file, read as a stream.

    Paths are those of any file system that pyarrow opens. Blocks are as parse() has them. A file that breaks off, in a
    record or in its compression, gives what could be read; its last record isn't intact. What follows a record without a
    valid Content-Length is searched for the next record's first line. An empty file gives nothing.
    """
    import pyarrow.fs as fs

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                with where.open_input_stream(name, compression=None) as raw:
                    f = io.BufferedReader(raw)
                    f = gzip.open(f) if f.peek(2)[:2] == b"\x1f\x8b" else f
                    rows, size = [], 0
                    for r in _scan(f):
                        rows.append(r)
                        size += len(r["block"])
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, RECORD)


_ARROW = pa.schema([(n, pa.string()) for n in ("record_id", "type", "target_uri", "date")] + [("concurrent_to", pa.list_(pa.string())), ("block", pa.binary()), ("intact", pa.bool_())])
_BROKEN = (EOFError, OSError, zlib.error)


class _Lines:
    """A stream that ends where it can't be read any further."""

    def __init__(self, f):
        self.f = f

    def line(self) -> bytes:
        try:
            return self.f.readline()
        except _BROKEN:
            return b""

    def octets(self, n: int) -> bytes:
        out = []
        try:
            while n > 0 and (part := self.f.read(min(n, 1 << 20))):
                out.append(part)
                n -= len(part)
        except _BROKEN:
            pass
        return b"".join(out)


def _scan(f):
    f = _Lines(f)
    line = f.line()
    while line:
        if not line.startswith(b"WARC/"):
            line = f.line()
            continue
        head: dict[str, str] = {}
        concurrent = []
        while (line := f.line().strip()) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "warc-concurrent-to":
                concurrent.append(value)
            head[name] = value
        stated = head.get("content-length", "")
        if stated.isascii() and stated.isdigit():
            block = f.octets(int(stated))
            intact = len(block) == int(stated)
            line = f.line()
        else:
            parts, intact = [], False
            while (line := f.line()) and not line.startswith(b"WARC/"):
                parts.append(line)
            block = b"".join(parts).removesuffix(b"\r\n\r\n")
        if head.get("warc-record-id") and head.get("warc-type"):
            yield {"record_id": head["warc-record-id"], "type": head["warc-type"].lower(), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "concurrent_to": concurrent, "block": block, "intact": intact}


def captures_of(links: DataFrame) -> DataFrame:
    """(record_id, capture) of records (record_id, type, concurrent_to).

    Concurrent-to holds both ways. A response is its own capture. Another record belongs to each response next to it; if
    there is none, to the least response next to a neighbour; if there is none, to the least one that links lead to by way of
    other such records; if there is none, to the least request that they lead to, else to the least record.
    """
    known = cut(links.groupBy("record_id").agg(F.max(F.col("type").isin(*ANSWERS)).alias("answer"), F.max(F.col("type") == "request").alias("asked")))
    one = links.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).where("a <> b")
    edges = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ends = edges.join(known.select(F.col("record_id").alias("a"), F.col("answer").alias("a_answer")), "a").join(known.select(F.col("record_id").alias("b"), F.col("answer").alias("b_answer")), "b")
    ends = cut(ends.where("not a_answer"))
    direct = ends.where("b_answer").select(F.col("a").alias("record_id"), F.col("b").alias("capture"))
    nearest = direct.groupBy(F.col("record_id").alias("b")).agg(F.min("capture").alias("capture"))
    others = ends.where("not b_answer").select("a", "b")
    onward = others.join(nearest, "b").groupBy(F.col("a").alias("record_id")).agg(F.min("capture").alias("capture"))
    onward = onward.join(direct.select("record_id").distinct(), "record_id", "left_anti")
    placed = cut(known.where("answer").select("record_id", F.col("record_id").alias("capture")).unionByName(direct).unionByName(onward))
    left = cut(known.join(placed, "record_id", "left_anti").select("record_id", "asked"))
    if left.isEmpty():
        return placed
    roots = components(others)
    root = others.select(F.col("a").alias("record_id")).distinct().join(roots, F.col("record_id") == F.col("node"), "left").select("record_id", F.coalesce("root", "record_id").alias("root"))
    reached = direct.join(root, "record_id").groupBy("root").agg(F.min("capture").alias("capture"))
    mine = cut(left.join(root, "record_id", "left").select("record_id", "asked", F.coalesce("root", "record_id").alias("root")))
    alone = mine.groupBy("root").agg(F.min(F.struct((~F.col("asked")).alias("late"), "record_id")).alias("least"))
    far = mine.join(reached, "root", "left").join(alone, "root").select("record_id", F.coalesce("capture", "least.record_id").alias("capture"))
    return placed.unionByName(far)


def assemble(records: DataFrame, *, most_records: int = 10_000) -> DataFrame:
    """One row for each capture: (capture_id, part, target_uri, date, requests, response, metadata, n_records).

    response is a struct (record_id, date, block, intact), null where there is none; requests and metadata are arrays of such
    structs by record id, empty where there are none. n_records counts the records of the row. A capture of more than
    most_records records is given in parts, numbered from 0, over which its requests and metadata are spread by a hash; the
    response is in part 0. So no row is unbounded. Repeated rows count once; of several records of one id all are kept,
    but only the least answer. warcinfo, conversion and continuation records and null ids are left out; unknown ids in
    concurrent_to are ignored. target_uri and date are the response's, else the least of the part's. Empty blocks stay
    empty. An empty table gives an empty result; columns beyond RECORD's are not looked at.
    """
    usable = records.where(F.col("record_id").isNotNull() & F.col("type").isin(*ANSWERS, "request", "metadata"))
    links = cut(usable.select("record_id", "type", F.coalesce("concurrent_to", F.array().cast("array<string>")).alias("concurrent_to")))
    columns = usable.select("record_id", "type", "target_uri", "date", "block", "intact")
    answers = F.col("type").isin(*ANSWERS)
    captures = captures_of(links)
    sizes = captures.groupBy("capture").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_records)
    sizes = sizes.select("capture", F.ceil(F.col("n") / most_records).cast("int").alias("parts"))
    captures = captures.join(sizes, "capture", "left").select("record_id", "capture", F.coalesce(F.pmod(F.xxhash64("record_id"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    # An answer is its own capture, so that its block, which is most of the bytes, moves once.
    own = columns.where(answers).withColumns({"capture": F.col("record_id"), "part": F.lit(0)})
    others = columns.where(~answers).join(captures, "record_id").select(*own.columns)
    grouped = own.unionByName(others).groupBy("capture", "part").agg(F.array_sort(F.collect_set(F.struct("record_id", "type", "target_uri", "date", "block", "intact"))).alias("all"))
    part = lambda x: F.struct(x["record_id"].alias("record_id"), x["date"].alias("date"), x["block"].alias("block"), x["intact"].alias("intact"))
    of = lambda *kinds: F.filter("all", lambda x: x["type"].isin(*kinds))
    answer = F.get(of(*ANSWERS), F.lit(0))
    return grouped.select(
        F.col("capture").alias("capture_id"),
        "part",
        F.coalesce(answer["target_uri"], F.array_min(F.transform("all", lambda x: x["target_uri"]))).alias("target_uri"),
        F.coalesce(answer["date"], F.array_min(F.transform("all", lambda x: x["date"]))).alias("date"),
        F.transform(of("request"), part).alias("requests"),
        F.get(F.transform(of(*ANSWERS), part), F.lit(0)).alias("response"),
        F.transform(of("metadata"), part).alias("metadata"),
        F.size("all").alias("n_records"),
    )


FLAT_SQL = """
SELECT '<urn:uuid:' || md5('response:' || page_id) || '>' AS capture_id, url AS target_uri,
       '<urn:uuid:' || md5('request:' || page_id) || '>' AS request_id, '<urn:uuid:' || md5('metadata:' || page_id) || '>' AS metadata_id,
       'GET ' || url || ' HTTP/1.1' AS request_line, md5(html) AS body_md5, strlen(html)::BIGINT AS body_bytes, 3 AS n_records
FROM pages
"""


def flat(captures: DataFrame) -> DataFrame:
    """Scalars of each capture that has all three kinds of record, to hold against SQL."""
    body = F.expr("substring(response.block, locate('\r\n\r\n', cast(response.block as string)) + 4)")
    return captures.select(
        "capture_id",
        "target_uri",
        F.get("requests", F.lit(0))["record_id"].alias("request_id"),
        F.get("metadata", F.lit(0))["record_id"].alias("metadata_id"),
        F.substring_index(F.get("requests", F.lit(0))["block"].cast("string"), "\r\n", 1).alias("request_line"),
        F.md5(body).alias("body_md5"),
        F.octet_length(body).cast("bigint").alias("body_bytes"),
        "n_records",
    )
