"""Readers: numbering over many splits, typing of columns, bad fields."""

import pytest

from clustrel.sources import points as src


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return [(r["id"], r["features"]) for r in df.orderBy("id").collect()]


def test_ids_are_line_order_over_many_partitions(spark, tmp_path, small_splits):
    for name, lo, hi in (("b.csv", 300, 420), ("a.csv", 0, 300)):
        (tmp_path / name).write_text("".join(f"{k},{k % 7}.5\n" + "\n" * (k % 3) for k in range(lo, hi)))
    df = src.read_csv(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    assert rows(df) == [(k, [float(k), k % 7 + 0.5]) for k in range(420)]
    plan = src._numbered(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") <= 1 and "HashAggregate" in plan
    (tmp_path / "c.txt").write_text("9 1 2\n 8\t3   4 \n" * 40)
    assert rows(src.read_whitespace(spark, str(tmp_path / "c.txt"), [1, 2])) == [(k, [1.0, 2.0] if k % 2 == 0 else [3.0, 4.0]) for k in range(80)]


def test_bad_fields_keep_their_place_or_raise(spark, tmp_path):
    at = tmp_path / "x.csv"
    at.write_text("5.1,3.5,1.4,0.2,setosa\n4.9,NA,1.4,0.2,setosa\n4.7,3.2,,0.2,setosa\n4.6,3.1\n")
    assert rows(src.read_csv(spark, str(at), bad="null")) == [(0, [5.1, 3.5, 1.4, 0.2]), (1, [4.9, None, 1.4, 0.2]), (2, [4.7, 3.2, None, 0.2]), (3, [4.6, 3.1, None, None])]
    assert rows(src.read_csv(spark, str(at), [3, 0], bad="null"))[0] == (0, [0.2, 5.1])
    with pytest.raises(Exception, match="not a number"):
        src.read_csv(spark, str(at)).collect()
    with pytest.raises(Exception, match="not a number"):
        src.read_csv(spark, str(at), [4]).collect()
    with pytest.raises(ValueError):
        src.read_csv(spark, str(at), bad="drop")


def test_header_separator_and_empty_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a|b|c\n1|x|2\n\n3|y|-4e1\n")
    assert rows(src.read_csv(spark, str(tmp_path / "h.csv"), header=True, sep="|")) == [(0, [1.0, 2.0]), (1, [3.0, -40.0])]
    (tmp_path / "e.csv").write_text("\n\n")
    assert src.read_csv(spark, str(tmp_path / "e.csv")).count() == 0


def test_literal_points_and_json(spark, tmp_path):
    df = src.literal(spark, [[1, 2], [3, 4.5]])
    assert rows(df) == [(0, [1.0, 2.0]), (1, [3.0, 4.5])] and src.literal(spark, []).count() == 0
    with pytest.raises(ValueError):
        src.literal(spark, [[1], [2, 3]])
    src.write_json(df, str(tmp_path / "j"))
    assert rows(spark.read.schema(df.schema).json(str(tmp_path / "j"))) == rows(df)


def test_a_cluster_without_a_shared_folder_is_refused():
    from clustrel import shared

    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="share"):
        shared.folder(Session())
