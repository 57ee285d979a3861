from __future__ import annotations

import random
from contextlib import contextmanager

import pytest

from tests.conftest import rows
from visitline.session import release
from visitline.sources import inventory as V, records as R, tables as S


@contextmanager
def ranges(spark, size):
    """Files split every ``size`` bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def spelled(rng: random.Random) -> str:
    kind = rng.randrange(6)
    if kind == 0:
        return ""
    if kind == 1:
        return f'{rng.randrange(99)}" pipe'
    text = "".join(rng.choice(['a', 'b', ',', '\n', '""', ' ', '\n\n', 'é']) for _ in range(rng.randrange(12)))
    return f'"{text}"' if kind < 5 else str(rng.randrange(10**6))


@pytest.mark.parametrize("seed, ending", [(1, "\n"), (3, "\r\n")])
def test_split_files_read_as_whole_ones(spark, tmp_path, seed, ending):
    rng = random.Random(seed)
    for name in ("a", "b"):
        body = [",".join([str(i), spelled(rng), spelled(rng)]) + rng.choice(["", "", "\n"]) for i in range(120)]
        text = "\n".join([' id ,"two\nlines",c', *body]) + rng.choice(["", "\n"])
        (tmp_path / f"{name}.csv").write_bytes(text.replace("\n", ending).encode())
    path = str(tmp_path)
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    expected = rows(whole)
    with ranges(spark, 500):
        lines = R.csv_lines(spark.read, path)
        assert lines.rdd.getNumPartitions() > 4
        for part_bytes in (60, 1 << 20):
            assert rows(R.read_records(spark, path, part_bytes=part_bytes)) == expected
        counts = S.csv_record_counts(spark, path).collect()
    assert sorted(r["rows"] for r in counts) == [120, 120] and len(expected) == 240
    read = S.read_csv(spark, path)
    assert read.columns == ["id", "two\nlines", "c"] and rows(read) == expected
    release(read)


def test_line_effects():
    assert R.line_effect(b'a,"b') == (True, False)
    assert R.line_effect(b'a,"b","c') == (True, True)
    assert R.line_effect(b'5" pipe,x') == (False, False)
    assert R.line_effect(b'"a""b') == (True, False)
    assert R.line_effect(b'x""",y') == (False, False)
    assert R.line_effect(b'""') == (False, True)


def test_one_cell_over_many_ranges(spark, tmp_path):
    cell = "\n".join(f"line, {i}" for i in range(2000))
    (tmp_path / "x.csv").write_text(f'id,note\n1,"{cell}"\n2,"{cell}"\n3,z\n')
    with ranges(spark, 500):
        assert rows(R.read_records(spark, str(tmp_path), part_bytes=100)) == [("1", cell), ("2", cell), ("3", "z")]


def test_cut_off_file_is_partial(spark, tmp_path):
    body = "".join(f'{i},"a\nb"\n' for i in range(200))
    (tmp_path / "cut.csv").write_text("RID,note\n" + body + '200,"a\nb')
    (tmp_path / "good.csv").write_text("RID,note\n" + body)
    with ranges(spark, 300):
        got = {r["file"].split("/")[-1]: r for r in V.scan_folder(spark, str(tmp_path)).collect()}
    assert (got["cut.csv"]["read_status"], got["cut.csv"]["read_error"], got["cut.csv"]["rows"]) == ("partial", "RecordCountError", None)
    assert (got["good.csv"]["read_status"], got["good.csv"]["rows"]) == ("ok", 200)


def test_empty_and_header_only(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("\n\na,b,a,\n")
    assert rows(S.csv_record_counts(spark, str(tmp_path)), "rows", "closed") == [(0, True)]
    read = S.read_csv(spark, str(tmp_path))
    assert read.columns == ["a0", "b", "a2", "_c3"] and read.count() == 0
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert S.read_csv(spark, str(tmp_path / "none")).columns == []


def test_inferred_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text('i,l,d,t,s,n\n1,1,1.5,2020-01-02 03:04:05,"a\nb",\n2,9999999999,2,2021-01-01 00:00:00,2,\n')
    read = S.read_csv(spark, str(tmp_path), infer_types=True)
    assert [f.dataType.simpleString() for f in read.schema] == ["int", "bigint", "double", "timestamp", "string", "string"]
    assert read.where("i = 1").first()["s"] == "a\nb"


def test_parts_of_a_batch_become_objects_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from visitline.sources import records as R

    fields = pa.schema([*R._PART_FIELDS[:3], ("lines", pa.list_(pa.binary())), ("inside", pa.bool_()), ("before", pa.int64())])
    part = {"file": "f", "block": 0, "lines": [b"1,2,3"] * 2000, "inside": False}
    batch = pa.RecordBatch.from_pylist([{**part, "part": i, "before": 2000 * i} for i in range(60)], schema=fields)
    tracemalloc.start()
    rows = sum(len(out) for out in R._pieces(iter([batch]), False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 120_000 and peak < 2_000_000  # 2,000 lines of 40 to 50 bytes each, twice, and their lists
