"""Files cut into small blocks against Spark's one-task readers and the
``csv`` and ``json`` modules."""

import csv
import json
import random

import pytest

from evalsmith.sources.readers import read_records, read_table_csv
from evalsmith.sources.splits import read_split_csv, read_split_json

CSV_SCHEMA = "a string, b string, n int"
JSON_SCHEMA = "id int, t string, o struct<x:string,y:array<struct<z:int>>>"
CELLS = ["", "x", "N/A", 'say "hi"', "two\nlines", "a,b", '"', '""', "\n", '\n"\n', ",\n,", "é\n漢字 🙂", "}\n{", 'end"', "long " * 40 + "\n" * 5, "it's 5\" wide"]


@pytest.fixture()
def block(spark):
    """Sets the bytes a block, for the session."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def set_bytes(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "0")

    yield set_bytes
    for n, v in before.items():
        spark.conf.set(n, v)


def _bag(df):
    return sorted(map(repr, df.collect()))


def _write_csv(path, rows, ending="\n", last=True):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=ending).writerows([("a", "b", "n"), *rows])
    if not last:
        with open(path) as f:
            whole = f.read()
        with open(path, "w") as f:
            f.write(whole.rstrip("\n"))


@pytest.mark.parametrize("size,ending,last", [(2_011, "\n", True), (3_307, "\r\n", False)])
def test_csv_equals_the_one_task_reader(spark, block, tmp_path, size, ending, last):
    rng = random.Random(size)
    for k in range(2):
        rows = [(rng.choice(CELLS), rng.choice(CELLS), i) for i in range(400)]
        _write_csv(tmp_path / f"{k}.csv", rows, ending, last)
    want = _bag(read_table_csv(spark, str(tmp_path), CSV_SCHEMA))
    assert len(want) == 800
    block(size)
    assert _bag(read_split_csv(spark, str(tmp_path), CSV_SCHEMA)) == want
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 8


def test_csv_quotes_inside_plain_fields_blank_lines_and_long_records(spark, block, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,n\n5" pipe,6" pipe,1\n\n"' + "q\n" * 4_000 + '",,2\nx,"y",3\n')
    want = _bag(read_table_csv(spark, str(tmp_path), CSV_SCHEMA))
    block(2_000)
    assert _bag(read_split_csv(spark, str(tmp_path), CSV_SCHEMA)) == want and len(want) == 3


def test_csv_without_rows_and_malformed(spark, block, tmp_path):
    block(2_000)
    (tmp_path / "a.csv").write_text("a,b,n\n")
    (tmp_path / "b.csv").write_text("")
    got = read_split_csv(spark, str(tmp_path), CSV_SCHEMA)
    assert got.count() == 0 and got.columns == ["a", "b", "n"]
    (tmp_path / "a.csv").write_text("a,b,n\nx,y,notanumber\n")
    with pytest.raises(Exception):
        read_split_csv(spark, str(tmp_path), CSV_SCHEMA).collect()


TEXTS = ["", "}", "{", "[]", '"', '\\', '\\"}', "},{", "]", "a\nb", "é漢🙂", "}" * 30, "x" * 300, '\\\\"']


def _objects(rng, n):
    return [{"id": i, "t": rng.choice([*TEXTS, None]), "o": {"x": rng.choice(TEXTS), "y": [{"z": j} for j in range(rng.randrange(3))]}} for i in range(n)]


@pytest.mark.parametrize("size,indent", [(2_011, None), (3_307, 2)])
def test_json_equals_the_one_task_reader(spark, block, tmp_path, size, indent):
    rng = random.Random(size)
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps(_objects(rng, 150), indent=indent, ensure_ascii=bool(k)))
    want = _bag(read_records(spark, str(tmp_path), JSON_SCHEMA, jsonl=False))
    assert len(want) == 300
    block(size)
    assert _bag(read_split_json(spark, str(tmp_path), JSON_SCHEMA)) == want


def test_json_empty_arrays(spark, block, tmp_path):
    block(2_000)
    (tmp_path / "a.json").write_text(" [ \n ]\n")
    (tmp_path / "b.json").write_text('[{}, {"id": 7}]')
    assert _bag(read_split_json(spark, str(tmp_path), "id int")) == ["Row(id=7)", "Row(id=None)"]


@pytest.mark.parametrize(
    "text",
    ['[{"id": 1}, {"id": 2', '[{"id": 1} {"id": 2}]', '{"id": 1}', '[{"id": 1}] x', '[1, 2]', '[{"id": 1}, null]', '[{"id": "open}]'],
)
def test_json_that_is_no_array_of_objects_fails(spark, block, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    block(2_000)
    with pytest.raises(Exception):
        read_split_json(spark, str(tmp_path), "id int").collect()
