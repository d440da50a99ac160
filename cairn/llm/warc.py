"""WARC archives: a writer that revisits equal payloads, and a reader that salvages damaged files.

Writing: each record is a gzip member of its own. Spark's text writer puts the members into files of the shared folder with
its commit protocol; an empty member serves as its line separator, so a file is a valid sequence of members.

Reading: a file is walked member by member, or record by record where it is not compressed. Where a check fails, the
reader searches for the next valid member or version line, goes on there, and reports the bytes in between as a gap. Inside
a member it goes on at the next version line, so that one bad record does not cost the others.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, load, scratch, stash, text_of

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
SIGN = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
PIECE = 1 << 16


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


EMPTY_MEMBER = gzip_member(b"")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from its hex digits: five of them are four symbols."""

    def spelled(digits: Column) -> Column:
        out = []
        for g in range(8):
            value = F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int")
            out += [F.substring(F.lit(ALPHABET), F.shiftright(value, 15 - 5 * j).bitwiseAND(31) + F.lit(1), F.lit(1)) for j in range(4)]
        return F.concat(*out)

    return let(F.sha1(payload), spelled)


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """One row per page: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    Of equal payloads of at least ``least_bytes`` the largest id is the response and the others revisit it; rows that
    share that id are all responses. A null html is an empty payload, a null url an empty one, and a null id is
    smaller than any other.
    """
    payload = text_of(html_col).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    tops = stash(rows.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"), "tops")
    joined = rows.join(tops, ["payload_digest", "payload_bytes"], "left")
    again = (F.col("payload_bytes") >= least_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top")).alias("refers_to"))


def record_name(page_id: object) -> str:
    h = hashlib.md5(f"page {page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record_bytes(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One record as it stands in an archive, with its end."""
    block = HTTP + (payload or b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": record_name(page_id), "WARC-Date": date, "WARC-Target-URI": re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)}
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": "" if page_id is None else str(page_id), "X-Payload-Length": str(size)}
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_name(refers_to), "X-Refers-To-Page-Id": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + END


def write_archives(records: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", per_file: int = 5000, file_bytes: int = 1 << 28) -> None:
    """Write planned records as files of gzip members, at most ``per_file`` to a file and about ``file_bytes`` before compression.

    Records are written by size class, each a power of two of bytes, so that a file's greatest number of records follows from its
    class; a record larger than ``file_bytes`` has a file of its own. Null payloads are those of revisits, or empty; null ids
    are left out of the headers' numbers. Repeated rows are records of their own, and an empty table gives a folder of no records.
    """

    @F.pandas_udf(T.BinaryType())
    def member(page_id: pd.Series, url: pd.Series, payload: pd.Series, size: pd.Series, digest: pd.Series, kind: pd.Series, refers: pd.Series) -> pd.Series:
        return pd.Series([gzip_member(record_bytes(p or None, u, b, n, d, k, r or None, date)) for p, u, b, n, d, k, r in zip(page_id, url, payload, size, digest, kind, refers, strict=True)])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))  # noqa: E731  null ids as empty text: pandas would make them floats
    one = member(text("page_id"), F.col("url"), F.col("payload"), F.col("payload_bytes"), F.col("payload_digest"), F.col("record_type"), text("refers_to"))
    stored = F.coalesce(F.octet_length("payload"), F.lit(0)) + F.octet_length("url") + 1024
    power = F.ceil(F.log2(stored.cast("double"))).cast("int")
    least = max(0, (file_bytes // per_file).bit_length() - 1)  # records up to this power fit by their number alone
    classed = records.withColumn("_power", F.greatest(power, F.lit(least)))
    for row in classed.groupBy("_power").count().collect() or [None]:  # some thirty at most
        mine = classed if row is None else classed.where(F.col("_power") == row["_power"])
        most = per_file if row is None else max(1, min(per_file, file_bytes >> row["_power"]))
        mine.select(one.cast("string").alias("value")).write.mode("append").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", most).text(path)


class Damaged(ValueError):
    pass


def inflate(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """The content of the gzip member at ``at``, where it ends, and what is wrong with it ("": its CRC and length are right).

    Of a member that is cut off or damaged, the content is what inflates before that place.
    """
    unpacker, out, pos = zlib.decompressobj(31), [], at
    while not unpacker.eof:
        if pos >= len(data):
            return b"".join(out), len(data), "member cut off"
        part, before = data[pos : pos + PIECE], unpacker.copy()
        try:
            out.append(unpacker.decompress(part))
        except zlib.error:
            for k in range(len(part)):
                try:
                    out.append(before.decompress(part[k : k + 1]))
                except zlib.error:
                    return b"".join(out), pos + k, "member damaged"
        pos += len(part)
    return b"".join(out), pos - len(unpacker.unused_data), ""


def parse(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    if not VERSION.match(bytes(data[at : at + 16])):
        raise Damaged("no record header")
    size = PIECE
    while True:  # headers have no greatest length: a url may be long
        window = bytes(data[at : at + size])
        cut = window.find(END)
        if cut >= 0 or at + size >= len(data):
            break
        size *= 4
    if cut < 0:
        raise Damaged("no record header")
    head = {}
    for line in window[:cut].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        head[name.strip()] = value.strip()
    if not head.get("Content-Length", "").isdigit():
        raise Damaged("no content length")
    begin = at + cut + len(END)
    end = begin + int(head["Content-Length"])
    if bytes(data[end : end + len(END)]) != END:
        raise Damaged("record does not end where it should")
    return head, bytes(data[begin:end]), end + len(END)


def checked(head: dict[str, str], block: bytes) -> dict:
    """A record row; the digest of a stored payload must be that of its header."""
    kind = head.get("WARC-Type", "")
    payload = block.partition(END)[2] if head.get("Content-Type", "").startswith("application/http") else block
    digest = head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    size = len(payload)
    if kind == "revisit":
        size = int(head["X-Payload-Length"]) if head.get("X-Payload-Length", "").isdigit() else size
    elif digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise Damaged("payload digest differs")
    return {"kind": kind, "headers": head, "payload": payload, "payload_bytes": size, "payload_digest": digest}


def member_rows(inside: bytes, whole: bool) -> tuple[list[dict], str]:
    """The records of an inflated member that pass, and the reason of the first check that failed.

    In a member whose own check failed for damage only a payload that has the digest of its header counts as passed.
    """
    rows, pos, why = [], 0, ""
    while pos < len(inside):
        try:
            head, block, end = parse(inside, pos)
            row = checked(head, block)
            if not whole and (row["kind"] == "revisit" or not row["payload_digest"]):
                raise Damaged("record of a damaged member without a check of its own")
            rows.append(row)
            pos = end
        except Damaged as e:
            why = why or str(e)
            found = VERSION.search(inside, pos + 1)
            pos = found.start() if found else len(inside)
    return rows, why


def salvage(content: bytes) -> Iterator[dict]:
    """Rows of one file in order: records with their byte range, and gaps with the reason of the failed check.

    Records from a compressed file have the range of their member, so has the gap of a member in which only some passed.
    """
    data, at, gap, why = memoryview(content), 0, None, ""
    taken, until = [], 0  # records saved from a damaged member, and where it ends: stored blocks show them once more
    while at < len(data):
        rows, bad, end = [], "", at
        if data[at : at + 3] == MAGIC:
            inside, end, broken = inflate(data, at)
            rows, bad = member_rows(inside, broken != "member damaged")
            bad = broken or bad
            if broken:
                rows = [r for r in rows if at >= until or r not in taken]
        else:
            broken = ""
            try:
                head, block, end = parse(data, at)
                rows = [checked(head, block)]
            except Damaged as e:
                broken = bad = str(e)
            if at < until:
                rows = [r for r in rows if r not in taken]
        if gap is not None and (rows or not broken):
            yield {"kind": "gap", "begin": gap, "end": at, "reason": why}
            gap = None
        for row in rows:
            yield row | {"begin": at, "end": end}
        if broken:
            if rows:
                taken, until = (taken if at < until else []) + rows, max(until, end)
            if gap is None:
                gap, why = at, bad
            found = SIGN.search(content, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad:
            yield {"kind": "gap", "begin": at, "end": end, "reason": bad}
        at = end
    if gap is not None:
        yield {"kind": "gap", "begin": gap, "end": len(data), "reason": why}


ROWS = "path string, kind string, begin_at long, end_at long, reason string, headers map<string,string>, payload binary, payload_bytes long, payload_digest string"


def read_archives(spark, path: str, *, payloads: bool = True) -> DataFrame:
    """Records and gaps (``kind`` = 'gap') of all files under ``path``, damaged or not, in one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("begin_at", pa.int64()), ("end_at", pa.int64()), ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                held, size = [], 0
                for r in salvage(content.as_py()):
                    held.append({"path": name.as_py(), "kind": r["kind"], "begin_at": r["begin"], "end_at": r["end"], "reason": r.get("reason"), "headers": list(r.get("headers", {}).items()), "payload": r.get("payload") if payloads else None, "payload_bytes": r.get("payload_bytes"), "payload_digest": r.get("payload_digest")})
                    size += len(r.get("payload", b"")) if payloads else 0
                    if len(held) >= 1000 or size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def resolve_revisits(read: DataFrame) -> DataFrame:
    """``read`` with ``target``: the headers and payload size of the response that a revisit's ``WARC-Refers-To`` names.

    The response must have the revisit's payload digest; of several with one record id any stands for all. A revisit
    of a response that was lost or is in other archives, and any other row, has a null target. Gaps stay.
    """
    key = ["_id", "payload_digest"]
    asked = F.when(F.col("kind") == "revisit", F.col("headers")["WARC-Refers-To"]).alias("_id")
    wanted = read.select(asked, "payload_digest").where("_id IS NOT NULL").distinct()
    responses = read.where("kind = 'response'").select(F.col("headers")["WARC-Record-ID"].alias("_id"), "payload_digest", F.struct("headers", "payload_bytes").alias("target"))
    named = stash(responses.join(wanted, key, "left_semi").groupBy(*key).agg(F.first("target").alias("target")), "named")
    return read.select("*", asked).join(named, key, "left").drop("_id").select(*read.columns, "target")


def count_gaps(read: DataFrame) -> DataFrame:
    """``read`` with ``gaps``: how many byte ranges of the row's file were quarantined."""
    lost = read.where("kind = 'gap'").groupBy("path").agg(F.count("*").alias("gaps"))
    return read.join(lost, "path", "left").na.fill(0, ["gaps"])


def op4_warc_salvage(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    write_archives(plan_records(load(spark, sf_dir, "pages")), path)
    read = count_gaps(resolve_revisits(stash(read_archives(spark, path, payloads=False), "read"))).where("kind <> 'gap'")
    page = lambda headers: F.when(headers["X-Page-Id"] != "", headers["X-Page-Id"].cast("long"))
    size = F.coalesce(F.col("target")["payload_bytes"], F.col("payload_bytes"))
    return read.select(page(F.col("headers")).alias("page_id"), size.alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), page(F.col("target")["headers"]).alias("refers_to"), "gaps")


_SYMBOLS = " || ".join(f"substr('{ALPHABET}', CAST((('0x' || substr(hex, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * j}) & 31 AS INT) + 1, 1)" for g in range(8) for j in range(4))
SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_SYMBOLS} AS payload_digest, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, CAST(0 AS BIGINT) AS gaps
FROM d
"""
