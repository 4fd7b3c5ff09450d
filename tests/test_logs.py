import random

import pytest

from tilespan.sources import logs


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_last_lines_are_those_of_a_whole_read(block):
    rng = random.Random(block)
    for end in (b"", b"\n"):
        data = b"\n".join("zeile é {} {}".format(i, "x" * rng.randrange(40)).encode() for i in range(30)) + end
        whole = data.decode().splitlines()
        for want in (1, 2, 5, 29, 30, 31, 100):
            asked = []

            def read(at, n, asked=asked, data=data):
                asked.append(n)
                return data[at : at + n]

            assert logs.last_lines(read, len(data), want, block) == whole[-want:]
            if want <= 5 and block < 100:
                assert sum(asked) <= (want + 2) * 60 + block  # and no more than it takes
    assert logs.last_lines(lambda at, n: b"\xff\n\xe9t\xc3"[at : at + n], 5, 9) == ["�", "�t�"]
    assert logs.last_lines(lambda at, n: b"", 0, 5) == []


def test_tails_over_rotations(spark, tmp_path):
    (tmp_path / "map").mkdir()
    line = "2024-05-01 10:00:{:02d} {} {}"
    (tmp_path / "map" / "7.log.1").write_text("\n".join(line.format(i, "INFO", f"old {i}") for i in range(10)) + "\n")
    (tmp_path / "map" / "7.log").write_text("\n".join([line.format(20, "ERROR", "failed token=abc"), "Traceback", "  at https://u:p@h/x?key=9", line.format(21, "INFO", "done")]) + "\n")
    (tmp_path / "8.log").write_text("  tail of a trace\n" + line.format(30, "CRITICAL", "gone") + "\n")
    (tmp_path / "9.log").write_bytes(b"")
    (tmp_path / "10.log.1").write_text(line.format(40, "INFO", "only the older part") + "\n")
    (tmp_path / "notes.txt").write_text(line.format(50, "ERROR", "no log"))
    rows = logs.entries(spark, str(tmp_path), limit=6).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.log, r.place)):
        got.setdefault(r.log, []).append((r.time, r.level, r.message))
    assert set(got) == {"map/7", "8", "10"}
    assert [m for _, _, m in got["map/7"]] == ["old 8", "old 9", "failed token=***\nTraceback\n  at https://***:***@h/x?key=***", "done"]
    assert got["8"] == [(None, None, "  tail of a trace"), ("2024-05-01 10:00:30", "CRITICAL", "gone")]
    errors = logs.entries(spark, str(tmp_path), limit=6, errors_only=True).collect()
    assert sorted((r.log, r.level) for r in errors) == [("8", "CRITICAL"), ("map/7", "ERROR")]
    assert [r.message for r in logs.entries(spark, str(tmp_path), limit=1).where("log = 'map/7'").collect()] == ["done"]
    report = {r.log: r.report for r in logs.diagnostics(logs.entries(spark, str(tmp_path), limit=2), {"version": "1", "proxy": "http://a:b@p/"}).collect()}
    assert report["8"] == "version: 1\nproxy: http://***:***@p/\nlog: 8\n\ntail of a trace\n2024-05-01 10:00:30 CRITICAL gone\n"
