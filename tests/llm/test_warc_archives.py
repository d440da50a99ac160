"""Sizes of archive files, revisits of archives that others wrote, and gaps counted by file."""

import base64
import hashlib

from cairn.llm import warc

PAGES = "page_id long, url string, html string"


def parts(folder):
    return sorted(p for p in folder.iterdir() if p.name.startswith("part-"))


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def foreign(kind, name, payload, refers_to=None):
    """A record as other writers store it: no headers but those of the format."""
    block = warc.HTTP + (payload if kind == "response" else b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http", "Content-Length": str(len(block))}
    head |= {"WARC-Refers-To": refers_to} if refers_to else {}
    return warc.gzip_member(b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + warc.END)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", "s" * 10 + str(i)) for i in range(40)] + [(100 + i, "u", str(i) * 30_000) for i in range(10)] + [(200, "u", "L" * 400_000), (201, None, None), (None, "u", "n")]
    path = f"file://{tmp_path}/archives"
    warc.write_archives(warc.plan_records(spark.createDataFrame(rows, PAGES).coalesce(1)), path, per_file=30, file_bytes=100_000)
    for p in parts(tmp_path / "archives"):
        found = [r for r in warc.salvage(p.read_bytes()) if r["kind"] != "gap"]
        assert len(found) <= 30 and (len(found) == 1 or sum(len(r["payload"]) for r in found) <= 100_000)
    read = warc.read_archives(spark, path).collect()
    assert sorted((r.headers["X-Page-Id"], bytes(r.payload)) for r in read) == sorted(("" if i is None else str(i), (t or "").encode()) for i, _, t in rows)


def test_an_empty_table_makes_a_folder_of_no_records(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    warc.write_archives(warc.plan_records(spark.createDataFrame([], PAGES)), path)
    assert warc.count_gaps(warc.resolve_revisits(warc.read_archives(spark, path))).count() == 0


def test_revisits_of_archives_without_private_headers(spark, tmp_path):
    one, two = b"first page", b"second"
    (tmp_path / "a.warc.gz").write_bytes(foreign("response", "<a>", one) + foreign("revisit", "<b>", one, "<a>") + foreign("revisit", "<c>", one, "<gone>"))
    (tmp_path / "b.warc.gz").write_bytes(foreign("response", "<a>", two) + foreign("revisit", "<d>", two, "<a>") + foreign("response", "<a>", two))
    out = warc.resolve_revisits(warc.read_archives(spark, f"file://{tmp_path}")).collect()
    got = sorted(str((r.headers["WARC-Record-ID"], r.kind, r.target and r.target.payload_bytes)) for r in out)
    assert got == sorted(map(str, [("<a>", "response", None)] * 3 + [("<b>", "revisit", len(one)), ("<c>", "revisit", None), ("<d>", "revisit", len(two))]))


def test_gaps_are_counted_by_file(spark, tmp_path):
    good, bad = foreign("response", "<a>", b"whole"), bytearray(foreign("response", "<b>", b"broken" * 50))
    bad[20:30] = b"\0" * 10
    (tmp_path / "a.warc.gz").write_bytes(good)
    (tmp_path / "b.warc.gz").write_bytes(good + bytes(bad) + good)
    out = warc.count_gaps(warc.read_archives(spark, f"file://{tmp_path}")).collect()
    assert sorted((r.path[-9:], r.kind, r.gaps) for r in out) == [("a.warc.gz", "response", 0), ("b.warc.gz", "gap", 1), ("b.warc.gz", "response", 1), ("b.warc.gz", "response", 1)]
