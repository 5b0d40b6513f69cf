"""CSV files read by ranges equal the reader that takes a whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import ranges, tables


@pytest.fixture
def written(tmp_path):
    def write(label, text):
        path = tmp_path / f"{label}.csv"
        path.write_bytes(text.encode())
        return str(path)
    return write


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(seed, rows, end="\n"):
    draw = random.Random(seed)
    cells = ["", "plain", "two words", "a,b", 'say ""hi""'.replace('""', '"'), "line" + end + "break", end, "x" * 150, end.join("abcdefgh") * 12,
             'ends with "', '"', "5 o'clock", "ünï" + end + "cödé"]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    data = [(str(i), draw.choice(cells), draw.choice(cells)) for i in range(rows)]
    writer.writerow(["id", "first cell", "the, last" + end + "one"])
    writer.writerows(data)
    return out.getvalue(), data


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_tasks_read_what_one_reads(spark, small_ranges, written, end):
    text, data = made(1, 300, end)
    path = written("many", text)
    lines = ranges.line_ranges(spark, path)
    assert lines.select("start").distinct().count() > 100
    states = ranges.begin_states(lines, ",")
    assert states.filter("inside").count() > 10
    schema = "id int, a string, b string"
    found = sorted(tuple(r) for r in ranges.read_csv(spark, path, schema=schema).collect())
    whole = spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(path)
    assert found == sorted(tuple(r) for r in whole.collect())
    assert found == sorted((int(i), a.replace(end, "\n") or None, b.replace(end, "\n") or None) for i, a, b in data)


def test_many_ranges_are_joined(spark, small_ranges, written, hot):
    # more ranges than may be broadcast: lines are joined with their states and sorted back
    text, data = made(2, 200)
    found = ranges.read_csv(spark, written("joined", text), schema="id int, a string, b string")
    assert sorted(tuple(r) for r in found.collect()) == sorted((int(i), a or None, b or None) for i, a, b in data)


def test_states_of_lines():
    for line, sep, outside, inside in [("", ",", False, True), ("a,b", ",", False, True), ('"a', ",", True, False), ('a"', ",", False, False),
                                       ('"a""b"', ",", False, False), ('x","y', ",", True, True), ('x"\t"y', "\t", True, True), ('"a" b", c', ",", False, False),
                                       ('5" pipe, 6" pipe', ",", False, False), ('"",""', ",", False, True), (',"', ",", True, False)]:
        assert (ranges.inside_after(line, False, sep), ranges.inside_after(line, True, sep)) == (outside, inside), line


def test_inch_marks_do_not_open_cells(spark, written):
    path = written("inches", 'id,size\n1,5" pipe\n2,plain\n\n3,6" pipe\n')
    assert sorted(tuple(r) for r in tables.read_table(spark, path).collect()) == [(1, '5" pipe'), (2, "plain"), (3, '6" pipe')]


def test_unbalanced_quotes_raise(spark, small_ranges, written):
    path = written("open", "id,a\n" + "1,x\n" * 60 + '2,"never closed\n' + "3,y\n" * 60)
    with pytest.raises(ValueError, match="not balanced"):
        tables.read_table(spark, path)


def test_types_and_inventory(spark, small_ranges, written):
    text = "i,l,d,day,at,b,s,none\n" + "".join(
        f'{n},{n * 10**10},{n}.5,2024-01-{n % 28 + 1:02d},2024-01-01 0{n % 10}:00:00,{"true" if n % 2 else "FALSE"},"v\n{n}",\n' for n in range(40))
    path = written("types", text)
    df = tables.read_table(spark, path)
    assert [t for _, t in df.dtypes] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]
    whole = spark.read.options(header=True, escape='"', multiLine=True, inferSchema=True).csv(path)
    assert df.dtypes == whole.dtypes and sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    with open(written("broken", "a,b\n1,2\n"), "ab") as f:
        f.write(b"\xff\xfe,1\n")
    written("open", 'a,"b\n""c"",x"\n1,2\n"rest\n\nof it')
    found = {r.path.rsplit("/", 1)[1]: (r.columns, r.row_count) for r in tables.file_inventory(spark, path.rsplit("/", 1)[0]).collect()}
    assert found == {"types.csv": ("i l d day at b s none".split(), 40), "open.csv": (["a", 'b\n"c",x'], 2)}
