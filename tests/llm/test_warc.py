import base64
import gzip
import hashlib

import pytest

from ledgerloom.llm import warc


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def rows():
    out = [(k, f"http://x.example/{k}", f"<p>{k % 7} é</p>" if k % 2 else f"<p>{k}</p>") for k in range(40)]
    out += [(50, None, None), (51, "http://x.example/\r\nX-Evil: 1", ""), (52, "u", "WARC/1.1\r\n\r\nfake\r\n\r\n"), (53, "u", "z" * 700_000 + "é" * 300_000), (54, "u", "z" * 700_000 + "é" * 300_000), (None, "u", "<p>1 é</p>")]
    return [*out, out[1], out[0]]


@pytest.mark.parametrize("chunk", [1 << 20, 1000])
def test_round_trip(spark, tmp_path, chunk):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "page_id long, url string, html string, digest int").repartition(3)
    index = warc.write(df, f"file://{tmp_path}/a", chunk)
    newest = {}
    for i, _, h in rows():
        if i is not None:
            newest[h or ""] = max(newest.get(h or "", -1), i)
    chunks = warc.read(index, chunk=chunk)
    got = chunks.collect()
    texts = {}
    for r in sorted(got, key=lambda r: r["chunk_no"]):
        texts.setdefault((r["page_id"], r["record_type"]), []).append(r)
    for i, u, h in rows():
        want = (h or "").encode()
        main = newest.get(h or "") == i
        kind = "response" if main else "revisit"
        mine = texts[i, kind]
        if main:
            n = rows().count((i, u, h))  # repeated rows
            assert b"".join(r["data"] for r in mine[::n]) == want
            for r in mine:
                upto = want[: r["bytes_so_far"]]
                assert r["digest_so_far"] == sha(upto) and len(r["data"]) <= chunk
        assert mine[0]["header_digest"] == sha(want) and mine[0]["header_bytes"] == len(want)
        assert mine[0]["refers_to"] == (None if main else newest[h or ""])
        assert "\n" not in mine[0]["url"]
    records = {}
    for r in got:
        records.setdefault(r["record_id"], set()).add((r["file"], r["start"]))
    assert sorted(map(len, records.values()))[-2:] == [1, 2]  # the repeated rows are one record written twice
    for r in got:
        assert r["refers_to_record"] is None or r["refers_to_record"] == warc.record_id(r["refers_to"]) in records
    flat = {(r["page_id"], r["record_type"]): r for r in warc.digests(chunks).collect()}
    for i, _, h in rows():
        main = newest.get(h or "") == i
        r = flat[i, "response" if main else "revisit"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((h or "").encode()), sha((h or "").encode()))
    assert warc.digests(chunks).count() == len(rows())


def test_lost_chunks_are_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 5000), (2, "u", "x" * 5000), (3, "u", "y")], "page_id long, url string, html string")
    chunks = warc.read(warc.write(df, f"file://{tmp_path}/a", 1000), chunk=1000)
    got = {r["page_id"]: r["payload_bytes"] for r in warc.digests(chunks.where("chunk_no <> 3")).collect()}
    assert got == {1: None, 2: None, 3: 1}


def test_archives_are_plain_gzip_members(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "u", "<p>b</p>")], "page_id long, url string, html string").coalesce(1)
    warc.write(df, f"file://{tmp_path}/a")
    (file,) = (tmp_path / "a").iterdir()
    text = gzip.decompress(file.read_bytes()).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "<p>a</p>\r\n\r\nWARC/1.1" in text


def test_join_instead_of_broadcast(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
    test_round_trip(spark, tmp_path, 1 << 20)


def test_least_size_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.deduplicated(df, least=5).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    assert warc.read(warc.write(df.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_written_where_the_cluster_says(spark):
    assert warc.archive_folder(spark).startswith(spark.sparkContext.getCheckpointDir())
