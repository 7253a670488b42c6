"""Round trips, and recovery after every kind of damage."""

import gzip
import io
import random

import pytest

from millrace.llm import warc
from millrace.session import scratch_folder


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, path string, gap int").repartition(3)


LONG = "<p>é" * 400


def test_round_trip(spark):
    rows = [
        (1, "http://a/", LONG), (2, "http://b/", LONG), (3, None, LONG), (4, "http://c\r\nX: y%", "short"), (5, "http://d/", "short"), (6, "e", None), (7, "f", ""),
        (8, "g", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (9, "h", "\x1f\x8b\x08" * 400), (3, None, LONG), (None, "i", LONG), (None, "j", "k"),
    ]
    got = sorted(map(str, warc.round_trip(pages(spark, rows)).collect()))
    size = len(LONG.encode())
    by_page = {}
    for r in warc.round_trip(pages(spark, rows)).collect():
        by_page.setdefault(r.page_id, []).append((r.payload_bytes, r.record_type, r.refers_to))
    assert len(got) == len(rows)
    assert by_page[1] == by_page[2] == [(size, "revisit", 3)] and by_page[3] == [(size, "response", None)] * 2
    assert by_page[4] == by_page[5] == [(5, "response", None)] and by_page[6] == by_page[7] == [(0, "response", None)]
    assert sorted(map(str, by_page[None])) == sorted(map(str, [(size, "revisit", 3), (1, "response", None)]))
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_payloads_and_targets_come_back(spark):
    rows = [(k, f"http://x/{k}\n%0A", f"text {k} é" * k) for k in range(200)]
    archives = warc.write_warc(pages(spark, rows), scratch_folder(spark, "warc"), archive_bytes=3_000)
    assert archives.count() > 10 and archives.agg({"records": "sum"}).first()[0] == 200
    found = {r.target: bytes(r.payload).decode() for r in warc.read_warc(archives).collect()}
    assert found == {u: h for _, u, h in rows}


def records(n=12, seed=0):
    rng = random.Random(seed)
    return [warc.record("response", str(k), f"http://x/{k}", bytes(rng.choices(range(256), k=rng.randint(0, 900))), None, "2020-01-01T00:00:00Z") for k in range(n)]


def read(data, chunk):
    found = list(warc.Salvage(io.BytesIO(data), chunk=chunk))
    got = [int(r.headers["warc-record-id"].strip("<>").rsplit(":", 1)[1]) for r in found if isinstance(r, warc.Record)]
    gaps = [(g.offset, g.offset + g.length) for g in found if isinstance(g, warc.Gap)]
    # records and gaps cover the file; records out of a damaged member lie in its gap
    marks = sorted({(r.offset, r.offset + r.length) for r in found if r.length is not None})
    assert all(any(g[0] <= r.offset < g[1] for g in gaps) for r in found if r.length is None)
    assert not data or (marks[0][0] == 0 and marks[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(marks, marks[1:])))
    return got, gaps


@pytest.mark.parametrize("chunk", [64, 1 << 20])
@pytest.mark.parametrize("packed", [True, False])
def test_salvage(chunk, packed):
    parts = [gzip.compress(r) if packed else r for r in records()]
    whole = b"".join(parts)
    starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    assert read(whole, chunk) == (list(range(12)), [])
    assert read(b"", chunk) == ([], [])
    # a byte flipped inside record 3, records 5 and 6 cut short, junk before 8, a tail that ends early
    broken = list(parts)
    broken[3] = broken[3][:-30] + bytes([broken[3][-30] ^ 255]) + broken[3][-29:]
    got, gaps = read(b"".join(broken), chunk)
    assert got == [k for k in range(12) if k != 3] and gaps == [(starts[3], starts[4])]
    broken[5], broken[6] = broken[5][:-7], broken[6][:40]
    broken[8] = b"junk \x1f\x8b\x08 WARC/1.0 junk" + broken[8]
    broken[11] = broken[11][: len(broken[11]) // 2]
    got, gaps = read(b"".join(broken), chunk)
    # of a member that lacks only its check sum the record, which has its digest, is taken
    assert got == ([0, 1, 2, 4, 5, 7, 8, 9, 10] if packed else [0, 1, 2, 4, 7, 8, 9, 10]) and len(gaps) == 4
    assert read(b"no archive at all", chunk) == ([], [(0, 17)])


@pytest.mark.parametrize("seed", range(6))
def test_random_damage_loses_only_what_it_hits(seed):
    rng = random.Random(seed)
    parts = [gzip.compress(r) for r in records(20, seed)]
    hit = set(rng.sample(range(20), 4))
    for k in hit:
        at = rng.randrange(10, len(parts[k]) - 8)
        parts[k] = rng.choice([parts[k][:at], parts[k][:at] + bytes([parts[k][at] ^ 0x55]) + parts[k][at + 1 :], b"", parts[k][at:]])
    got, _ = read(b"".join(parts), 256)
    assert set(got) >= set(range(20)) - hit


def test_gaps_are_logged(spark, tmp_path):
    parts = [gzip.compress(r) for r in records(5)]
    parts[2] = parts[2][:-9]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    paths = spark.createDataFrame([(str(path),), (None,)], "path string")
    rows = warc.read_warc(paths).collect()
    gaps = [r for r in rows if r.gap]
    assert len(rows) in (5, 6) and len(gaps) == 1 and gaps[0].offset == len(parts[0]) + len(parts[1]) and gaps[0].length == len(parts[2])


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_salvage_inside_a_member(chunk, monkeypatch):
    """A member of several records loses only what is damaged, as the same bytes unpacked do."""
    parts = records(7, 3)
    spoiled = [p if k != 2 else p[:-40] + bytes([p[-40] ^ 1]) + p[-39:] for k, p in enumerate(parts)]
    alone = gzip.compress(records(9, 3)[8])
    found = list(warc.Salvage(io.BytesIO(gzip.compress(b"".join(spoiled)) + alone), chunk=chunk))
    ids = [r.headers["warc-record-id"] for r in found if isinstance(r, warc.Record)]
    assert [int(i.strip("<>").rsplit(":", 1)[1]) for i in ids] == [0, 1, 3, 4, 5, 6, 8]
    (gap,) = [g for g in found if isinstance(g, warc.Gap)]
    assert "digest differs" in gap.reason and f"bytes {len(parts[0] + parts[1])} to {len(parts[0] + parts[1] + parts[2])}" in gap.reason
    # a damaged member that holds its records as they are: all but the one that is hit, each once
    whole = gzip.compress(b"".join(parts), 0)
    hurt = bytearray(whole)
    hurt[len(whole) // 2] ^= 255
    got, gaps = read(bytes(hurt) + alone, chunk)
    assert got[-1] == 8 and {0, 1} <= set(got) and len(set(range(7)) - set(got)) == 1 and len(got) == 7 and gaps
    # records of long members do not wait for its end, and its bytes are let go
    monkeypatch.setattr(warc, "WAITING", 1_000)
    monkeypatch.setattr(warc, "BEHIND", 500)
    assert [r.headers["warc-record-id"] for r in warc.Salvage(io.BytesIO(whole + alone), chunk=chunk)] == [f"<urn:page:{k}>" for k in (0, 1, 2, 3, 4, 5, 6, 8)]


def test_little_is_held_after_damage():
    class Junk(io.RawIOBase):
        left = 40_000_000

        def read(self, n):
            n, self.left = min(n, self.left), self.left - min(n, self.left)
            return b"x" * n

    reader, most = warc.Salvage(Junk(), chunk=1 << 16), 0
    more = reader._more

    def watched():
        nonlocal most
        out = more()
        most = max(most, len(reader.data))
        return out

    reader._more = watched
    (gap,) = list(reader)
    assert (gap.offset, gap.length) == (0, 40_000_000) and most < 1_000_000


def test_a_page_that_is_lost_is_an_error(spark, monkeypatch):
    schema = "path string, offset long, gap string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    monkeypatch.setattr(warc, "read_warc", lambda *_, **__: spark.createDataFrame([("a", 5, "record too long", *[None] * 5)], schema))
    with pytest.raises(Exception, match="gap in a at 5 record too long"):
        warc.round_trip(pages(spark, [(1, "u", "t")])).collect()
