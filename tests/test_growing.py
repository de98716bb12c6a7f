"""Following growing event logs: every finished line once, also over restarts."""

import json

import pytest

from gaugeline.operators import logs
from gaugeline.sources import files
from gaugeline.streaming import growing, monitor


def follow(stream, folder):
    """The lines of one micro-batch of everything there is, as (path, at, raw)."""
    found = []
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: found.extend(tuple(r) for r in batch.collect()))
        .option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return found


def names(found):
    return sorted((path.rsplit("/", 1)[-1], at, raw) for path, at, raw in found)


def test_appended_lines_arrive_once_and_unfinished_ones_are_held_back(spark, tmp_path):
    logs_, state = tmp_path / "logs", tmp_path / "state"
    (logs_ / "deep").mkdir(parents=True)
    a, b = logs_ / "a.jsonl", logs_ / "deep" / "b.jsonl"
    a.write_bytes(b"one\ntwo\r\nthr")
    (logs_ / "other.txt").write_text("no\n")

    def stream():
        return growing.growing_lines(spark, str(logs_))

    assert names(follow(stream(), state)) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    with a.open("ab") as file:
        file.write(b"ee\n\n\xc3\xa9\xff\n")
    b.write_bytes(b"first\n")
    assert names(follow(stream(), state)) == [("a.jsonl", 9, "three"), ("a.jsonl", 15, ""), ("a.jsonl", 16, "é�"), ("b.jsonl", 0, "first")]
    assert follow(stream(), state) == []
    with b.open("ab") as file:
        file.write(b"second")
    assert follow(stream(), state) == []
    with b.open("ab") as file:
        file.write(b"\nthird\n")
    assert names(follow(stream(), state)) == [("b.jsonl", 6, "second"), ("b.jsonl", 13, "third")]
    a.write_bytes(b"new\n")
    assert names(follow(stream(), state)) == [("a.jsonl", 0, "new")]


@pytest.mark.parametrize("split, read", [(1, 3), (7, 2), (64, 1 << 20)])
def test_splits_part_files_between_lines(tmp_path, monkeypatch, split, read):
    monkeypatch.setattr(growing, "SPLIT_BYTES", split)
    monkeypatch.setattr(growing, "READ_BYTES", read)
    lines = ["", "a", "bb", "", "a longer line of the file", "é", "x" * 40, "end"]
    file = tmp_path / "f.jsonl"
    file.write_text("\n".join(lines) + "\nrest")
    reader = growing.StreamReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    expected, at = [], 0
    for line in lines:
        expected.append((at, line))
        at += len(line.encode()) + 1
    assert end == {str(file): at}

    def read_between(start, end):
        found = []
        for p in reader.partitions(start, end):
            for batch in reader.read(p):
                found += zip(batch.column("at").to_pylist(), batch.column("raw").to_pylist())
        return found

    assert read_between({}, end) == expected
    for cut in [at for at, _ in expected]:
        middle = {str(file): cut}
        assert read_between({}, middle) + read_between(middle, end) == expected


def test_a_followed_log_equals_the_batch_scan(spark, tmp_path):
    events = [json.dumps({"type": t, "n": i}) for i, t in enumerate(["system", "assistant", "user", "result"] * 5)]
    results, state = tmp_path / "results", tmp_path / "state"
    results.mkdir()
    rows, done = [], 0
    for upto in (3, 4, 11, 20):
        for run in ("r1", "r2"):
            with (results / f"{run}.events.jsonl").open("a") as file:
                file.write("".join(line + "\n" for line in [*events[done:upto], "{broken"]))
        done = upto
        stream = monitor.stream_events(growing.growing_events(spark, str(results)))
        rows += follow(stream.select("run_id", "seq", "type"), state)
    batch = logs.parse_events(files.read_event_lines(spark, str(results))).select("run_id", "type").collect()
    assert sorted((r[0], r[2]) for r in rows) == sorted(tuple(r) for r in batch) and len(rows) == 40
    order = [r[2] for r in sorted(rows, key=lambda r: r[1]) if r[0] == "r1"]
    assert order == ["system", "assistant", "user", "result"] * 5
    assert spark.read.format("growing_lines").load(str(results)).count() == 48
