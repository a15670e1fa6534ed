"""The resume log as a stream equals the log in batch, whatever comes late, again or after a restart."""

import json
import random

from tessera.sources import boards
from tessera.streaming import progress

SCHEMA = "id string, line_no bigint, name string, error string"


def put(folder, number, rows):
    (folder / f"part-{number:03d}.json").write_text("\n".join(json.dumps(dict(zip(("id", "line_no", "name", "error"), r))) for r in rows))


def run(spark, folder, tmp):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).json(str(folder))
    q = progress.write(progress.last_records(stream), str(tmp / "out"), str(tmp / "state"))
    assert q.awaitTermination(240) and q.exception() is None
    return sorted(map(str, progress.current(spark, str(tmp / "out")).collect()))


def test_late_repeated_and_restarted_input(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    rng = random.Random(3)
    lines = [(f"x:{rng.randrange(25)}", n, f"name {n}", rng.choice([None, "no page"])) for n in range(200)] + [(None, 1, "no id", None), ("y", None, "no number", None)]
    late = lines[:]
    rng.shuffle(late)
    want = lambda: sorted(map(str, boards.last_records(spark.read.schema(SCHEMA).json(str(folder)).where("id is not null and line_no is not null")).collect()))
    for i in range(4):
        put(folder, i, late[i * 30 : i * 30 + 40])  # files overlap
    assert run(spark, folder, tmp_path) == want()
    batches = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(batches) >= 2
    put(folder, 4, late[100:])
    put(folder, 5, lines[:10])  # all late
    assert run(spark, folder, tmp_path) == want() and len(want()) >= 25
    # A batch that runs again, as after a failure between its write and its commit, overwrites itself.
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "state" / "commits" / str(last)).unlink()
    for p in (tmp_path / "state" / "commits").glob(f".{last}.*"):
        p.unlink()
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert run(spark, folder, tmp_path) == want() and spark.read.parquet(str(tmp_path / "out")).count() == n


def test_only_newer_records_leave(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    put(folder, 0, [("a", 5, "five", None), ("a", 3, "three", None), ("b", 1, "one", None)])
    put(folder, 1, [("a", 4, "four", None)])
    put(folder, 2, [("a", 5, "five", None), ("b", 2, "two", None)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    assert progress.write(progress.last_records(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(240)
    assert sorted((r.id, r.line_no, r.name) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 5, "five"), ("b", 1, "one"), ("b", 2, "two")]
