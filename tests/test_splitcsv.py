"""CSV read in byte ranges against Spark's own multi-line reader."""
import random

import pytest

from quarry.sources import files
from quarry.sources.splitcsv import read_split_csv


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def awkward_rows():
    rnd = random.Random(3)
    bits = ["plain", 'a "quoted" word', "line\nbreak", "two\n\nbreaks", "comma, here", "é\tñ", '"', '""', "NA", "null", "x" * 90,
            "ends with\n", "\nstarts", "car\r\nriage"]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randrange(0, 9))) or None, None) for i in range(300)]
    rows += [(1000, "long\n" * 700 + 'quote " in it\n' * 100, None), (1001, None, None), (1002, "\n" * 1500, None)]
    return rows


def test_equal_to_the_multi_line_reader(spark, tmp_path, small_splits):
    df = spark.createDataFrame(awkward_rows(), files.PARAGRAPH_SCHEMA)
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    files.write_csv(df.coalesce(1), one)
    files.write_csv(df.repartition(5), many)
    for path in (one, many):
        got = read_split_csv(spark, path, files.PARAGRAPH_SCHEMA)
        assert got.dtypes == files.read_csv(spark, path, files.PARAGRAPH_SCHEMA).dtypes
        assert _rows(got) == _rows(files.read_csv(spark, path, files.PARAGRAPH_SCHEMA))


def test_one_file_is_many_tasks(spark, tmp_path, small_splits):
    from quarry.sources import splitcsv
    path = str(tmp_path / "one")
    files.write_csv(spark.createDataFrame(awkward_rows(), files.PARAGRAPH_SCHEMA).coalesce(1), path)
    assert splitcsv._lines(spark, path).rdd.getNumPartitions() >= 20


def test_no_rows_no_header_and_other_quotes(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    (tmp_path / "x.csv").write_text("a,b\n")
    assert read_split_csv(spark, str(tmp_path / "x.csv"), schema).count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert read_split_csv(spark, str(tmp_path / "empty.csv"), schema).count() == 0
    (tmp_path / "y.csv").write_text("1,'it''s\ntwo'\r\n2,\"x\r\n3,")
    got = read_split_csv(spark, str(tmp_path / "y.csv"), schema, header=False, quote="'")
    assert _rows(got) == [(1, "it's\ntwo"), (2, '"x'), (3, None)]
    (tmp_path / "z.csv").write_text("a,b\nnot a number,x\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        read_split_csv(spark, str(tmp_path / "z.csv"), schema).collect()
