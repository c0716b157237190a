from __future__ import annotations

import base64
import hashlib
import random

import pytest

from pairlab.llm import warc


@pytest.mark.parametrize("runs", range(9))
def test_loser_tree(runs):
    rnd = random.Random(runs)
    lists = [sorted(rnd.choices(range(20), k=rnd.randint(0, 9))) for _ in range(runs)]
    merged = list(warc.LoserTree(lists, lambda x: x))
    assert merged == sorted(x for run in lists for x in run)


def expected(rows, least):
    data = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, h in data:
        if i is not None and len(h) >= least:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, h in data:
        other = first.get(h) if i is not None else None
        visit = other is not None and other != i
        out.append(
            (
                i,
                len(h),
                base64.b32encode(hashlib.sha1(h).digest()).decode(),
                "revisit" if visit else "response",
                other if visit else None,
            )
        )
    return sorted(out, key=repr)


HTML = ["<p>a</p>", "", None, "<p>a</p>", "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n"]
HTML += ["WARC/1.0\r\n", "\r\n\r\n", "é漢😀", "WARC/1.0\r\n" * 5, "y" * 200_000, "\r\n"]


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    rows = [(k, HTML[k % len(HTML)]) for k in range(30)] + [(4, HTML[4]), (None, "z")]
    urls = ["http://b.org/x", "http://a.org/\r\nInjected: yes", None, "https://A.org/?q"]
    pages = spark.createDataFrame(
        [(i, urls[k % 4], h, "x", 1) for k, (i, h) in enumerate(rows)],
        "page_id bigint, url string, html string, same string, first int",
    ).repartition(3)
    found = warc.archive(pages, str(tmp_path / "w"), least)
    got = found.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    ).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, least)
    keys = [(r.urlkey, r.captured, r.page_id or -1) for r in found.collect()]
    assert keys == sorted(keys) and len(keys) == 32
    assert len({r.run for r in found.collect()}) > 3


def test_many_ranges_stay_in_order(spark, tmp_path):
    rows = [(k, f"http://h{k % 3}.org/", "p") for k in range(500)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.captures(pages.repartition(4)), path)
    found = warc.capture_histories(warc.read_archives(spark, path), rows_per_merge=50)
    assert found.rdd.getNumPartitions() > 5
    keys = [(r.urlkey, r.captured) for r in found.collect()]
    assert keys == sorted(keys) and len(keys) == 500


def test_archive_is_warc(spark, tmp_path):
    import gzip

    row = [(1, "http://a.org/", "hi")]
    pages = spark.createDataFrame(row, "page_id int, url string, html string").coalesce(1)
    warc.write_archives(warc.captures(pages), str(tmp_path / "w"))
    (file,) = [f for f in (tmp_path / "w").glob("part-*.gz")]
    data = gzip.decompress(file.read_bytes())
    head, _, rest = data.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.0\r\nWARC-Type: response\r\n")
    size = int(head.split(b"Content-Length: ")[1])
    assert rest[size:] == b"\r\n\r\n" and rest[:size].endswith(b"\r\n\r\nhi")


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive(pages, str(tmp_path / "w")).count() == 0


def test_damage_is_found():
    with pytest.raises(KeyError):
        warc.parse_record(b"no length\r\n\r\n")
    assert warc.parse_record(b"Content-Length: 5\r\n\r\nab") is None
