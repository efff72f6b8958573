"""Arrays of JSON objects in files of many byte ranges, against Python's reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from recollect.sources import arrays

ODD = ['quote " and \\ slash', "} ] , [ {", '\\" }', "line\nbreak", "ünï 🙂 ﷽", "", "{" * 30, '"', "\\", "\\\\\"}", "a" * 300]


def objects(seed, n):
    rng = random.Random(seed)
    deep = lambda d: rng.choice([rng.choice(ODD), rng.randint(-5, 5), None, True, [], {}]) if d == 0 else rng.choice([[deep(d - 1) for _ in range(rng.randint(0, 3))], {rng.choice(ODD) + str(k): deep(d - 1) for k in range(rng.randint(0, 3))}])
    return [{"id": k, rng.choice(ODD): rng.choice(ODD), "deep": deep(rng.randint(0, 3))} for k in range(n)]


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("ascii_", [True, False])
def test_objects_of_many_ranges(spark, tmp_path, small_ranges, indent, ascii_):
    want = {}
    for k, n in enumerate((40, 1, 0, 7)):
        want[k] = objects(k, n)
        (tmp_path / f"{k}.json").write_text(json.dumps(want[k], indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    found = arrays.array_objects(spark, str(tmp_path))
    assert arrays._pieces(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 10
    rows = found.collect()
    for k, own in want.items():
        mine = sorted((r.number, r.value) for r in rows if r.file.endswith(f"/{k}.json"))
        assert [json.loads(v) for _, v in mine] == own and [n for n, _ in mine] == list(range(len(own)))


@pytest.mark.parametrize(
    "text",
    ["", " ", "{}", '{"a": 1}', "[", '[{"a": 1}', '[{"a": 1},', '[{"a": 1}, {"b', '[{"a": "x}]', '[{"a": 1}]]', '[{"a": 1}] x', '[{"a": 1} {"a": 2}]', '[{"a": 1},, {"a": 2}]', '[1, {"a": 2}]', '[{"a": 1}, 2]', '[{"a": 1},]', '[{"a": [1}]', "x[]", '[[{"a": 1}]]'],
)
def test_what_is_no_array_of_objects_is_an_error(spark, tmp_path, text):
    (tmp_path / "good.json").write_text('[{"a": 1}]')
    (tmp_path / "odd.json").write_text(text)
    if not text:  # an empty file has no piece to be wrong
        assert arrays.array_objects(spark, str(tmp_path)).count() == 1
        return
    with pytest.raises(Exception, match="odd.json|Malformed|MALFORMED"):
        arrays.read_array(spark, str(tmp_path), "a int").collect()


def test_rows_of_a_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [ {"a": 1, "b": {"c": "}"}} ,\n {"a": null, "x": 2} ] \n')
    assert sorted(map(str, arrays.read_array(spark, str(tmp_path), "a int, b struct<c:string>").collect())) == sorted(["Row(a=1, b=Row(c='}'))", "Row(a=None, b=None)"])
    (tmp_path / "b.json").write_text('[{"a": "text"}]')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        arrays.read_array(spark, str(tmp_path), "a int, b struct<c:string>").collect()
