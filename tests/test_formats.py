"""Binary formats, and their readers."""

from __future__ import annotations

import pytest

from tidemark.sources import binary as B


def log(n):
    return [B.log_record(i % 2, i + 1, f"k{i}".encode(), b"" if i % 2 else b"v" * i) for i in range(n)]


def test_log_round_trip():
    got = list(B.log_records(b"".join(log(9))))
    assert [(r[0], r[1]) for r in got] == [(i % 2, i + 1) for i in range(9)]


@pytest.mark.parametrize("cut", range(1, 40))
def test_torn_log(cut):
    parts = log(4)
    raw = b"".join(parts)
    whole = sum(1 for i in range(4) if sum(map(len, parts[: i + 1])) <= len(raw) - cut)
    assert len(list(B.log_records(raw[:-cut]))) == whole


def test_damaged_records_are_passed_over():
    parts = log(3)
    bad = bytearray(parts[1])
    bad[-5] ^= 1
    assert [r[1] for r in B.log_records(parts[0] + bytes(bad) + parts[2])] == [1, 3]
    wrong = bytearray(B.log_record(0, 7, b"x", b"y"))
    wrong[0] = 9
    assert [r[1] for r in B.log_records(bytes(wrong) + parts[2])] == [3]
    absurd = parts[0] + b"\x01" + bytes(8) + b"\xff\xff\xff\xff" + bytes(4) + parts[2]
    assert [r[1] for r in B.log_records(absurd)] == [1]
    with pytest.raises(B.FormatError):
        B.log_record(0, 1, b"k" * (B.MAX_LOG_KEY + 1))


def test_sorted_file():
    rows = [(i % 2, 100 - i, f"key{i:03d}".encode(), str(i).encode()) for i in range(50)]
    assert list(B.sorted_records(B.sorted_file(rows))) == rows
    assert B.sorted_file([]) == b""
    with pytest.raises(B.FormatError):
        B.sorted_file(rows[::-1])
    with pytest.raises(B.FormatError):
        list(B.sorted_records(b"short"))


def test_snapshot_image():
    rows = [(f"k{i}".encode(), b"v" * i) for i in range(9)]
    raw = B.snapshot_image(rows)
    assert list(B.snapshot_pairs(raw)) == rows
    for bad in (raw[:-1], raw + b"x", b"X" + raw[1:], B.snapshot_image(rows[::-1]), B.snapshot_image([(b"", b"")])):
        with pytest.raises(B.FormatError):
            list(B.snapshot_pairs(bad))


def test_bloom():
    b = B.Bloom.sized(1000)
    held = [f"key:{i:06d}".encode() for i in range(1000)]
    for k in held:
        b.add(k)
    assert all(map(b.may_contain, held))
    assert sum(b.may_contain(f"absent:{i}".encode()) for i in range(10_000)) < 200
    again = B.Bloom.decode(b.encode())
    assert again.words == b.words and again.hashes == b.hashes == 7 and b.bits % 64 == 0
    for bad in (b"", bytes(15), bytes(16), B.Bloom.sized(10).encode()[:-1]):
        with pytest.raises(B.FormatError):
            B.Bloom.decode(bad)
    assert B.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_readers(spark, tmp_path):
    (tmp_path / "1.wal").write_bytes(b"".join(log(4)) + b"torn")
    (tmp_path / "2.wal").write_bytes(b"")
    got = B.read(spark, f"{tmp_path}/*.wal", "log").orderBy("pos").collect()
    assert [(r["op"], r["seq"], bytes(r["key"])) for r in got] == [(i % 2, i + 1, f"k{i}".encode()) for i in range(4)]
    (tmp_path / "x.snap").write_bytes(B.snapshot_image([(b"a", b"1"), (b"b", b"2")]))
    assert B.read(spark, f"{tmp_path}/x.snap", "snapshot").count() == 2


def test_sorted_file_reads_by_its_index():
    records = [(i % 5 == 0, i, f"k{i:04d}".encode(), str(i).encode()) for i in range(0, 400, 2)]
    f = B.SortedFile(B.sorted_file([(int(a), b, c, d) for a, b, c, d in records]))
    assert (f.low, f.high, f.count, len(f.keys)) == (b"k0000", b"k0398", 200, 13)
    assert all(f.get(r[2]) == ("found", (int(r[0]), *r[1:])) for r in records)
    assert f.get(b"a")[0] == f.get(b"z")[0] == "outside"
    answers = [f.get(f"k{i:04d}".encode())[0] for i in range(1, 398, 2)]
    assert set(answers) <= {"skipped", "absent"} and answers.count("skipped") > 180
    for low, high in ((b"k0010", b"k0020"), (b"", b"z"), (b"k0011", b"k0011"), (b"k0398", b"z"), (b"z", b"zz"), (b"k0020", b"k0010")):
        assert [r[2] for r in f.scan(low, high)] == [r[2] for r in records if low <= r[2] <= high]
    assert all(B.Bloom.decode(f.bloom.encode()).may_contain(r[2]) for r in records)
    with pytest.raises(B.FormatError):
        B.SortedFile(f.raw[:-1])
