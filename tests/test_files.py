import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafloom.limits import Limits
from leafloom.operators import extract as E
from leafloom.sources import files
from leafloom.sources.pages import Pages, read


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    for i in range(7):
        (tmp_path / "a" / f"p{i}.html").write_text(f"<title>t{i}</title>" + "x" * (i * 100))
    (tmp_path / "big.HTM").write_bytes(b"<title>b</title>" + b"y" * 300_000)
    (tmp_path / "note.txt").write_text("no page")
    (tmp_path / "_hidden.html").write_text("no page")
    return tmp_path


def test_batches(spark, folder):
    files.register_source(spark)
    df = spark.read.format("html_files").option("path", str(folder)).option("limit", 200_000).option("filesPerPartition", 3).load()
    got = {r["page_id"].rsplit("/", 1)[1]: r for r in df.collect()}
    assert sorted(got) == ["big.HTM", *(f"p{i}.html" for i in range(7))] and df.rdd.getNumPartitions() == 3
    assert got["p2.html"]["length"] == 217 and bytes(got["p2.html"]["content"]).startswith(b"<title>t2") and got["p2.html"]["error"] is None and got["p2.html"]["url"] == f"file://{folder}/a/p2.html"
    big = got["big.HTM"]
    assert big["content"] is None and big["error"] == "over 200000 bytes" and 200_000 < big["length"] <= 200_000 + files.CHUNK  # not read to its end
    titles = {r["title"] for r in E.title(Pages(df.where("error IS NULL"), "content", base_url="url")).collect()}
    assert titles == {f"t{i}" for i in range(7)}
    assert df.where(F.col("page_id").endswith("p1.html")).count() == 1
    one = spark.read.format("html_files").load(str(folder / "a" / "p3.html")).collect()
    assert [r["length"] for r in one] == [317]


def test_partitions_have_like_sizes(folder):
    parts = files.BatchReader(files.Options({"path": str(folder), "filesPerPartition": "4"})).partitions()
    with_big, other = sorted(parts, key=lambda p: f"{folder}/big.HTM" not in p.paths)
    assert len(with_big.paths) <= 2 and len(with_big.paths) + len(other.paths) == 8  # the others make up for its size


def test_streams_go_on_where_they_were(spark, folder, tmp_path_factory):
    files.register_source(spark)
    out, state = str(tmp_path_factory.mktemp("out")), str(tmp_path_factory.mktemp("state"))

    def run():
        rows = spark.readStream.format("html_files").option("path", str(folder / "a")).option("filesPerPartition", 4).load().select("page_id", "length")
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["page_id"].rsplit("/", 1)[1] for r in spark.read.parquet(out).collect())

    assert run() == [f"p{i}.html" for i in range(7)]
    (folder / "a" / "p8.html").write_text("<p>late")
    assert run() == [*(f"p{i}.html" for i in range(7)), "p8.html"]


def test_wrong_options_and_lost_files(spark, folder):
    with pytest.raises(ValueError):
        files.Options({})
    with pytest.raises(ValueError):
        files.Options({"path": "x", "limit": "0"})
    with pytest.raises(ValueError):
        files.Options({"path": str(folder / "none")}).found()
    assert list(files.rows((str(folder / "gone.html"),), 9))[0][3:] == (None, "cannot be read: No such file or directory")


def test_each_row_becomes_a_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), ("b", None)], "k string, v string").coalesce(2)
    files.write_files(rows, str(tmp_path / "new"), F.concat(F.lit("k="), "k"), F.col("v"))
    got = spark.read.format("binaryFile").load(str(tmp_path / "new")).selectExpr("regexp_extract(path, '[0-9]+-([^/]*)[.]html$', 1) AS k", "cast(content AS string) AS v")
    assert sorted(map(tuple, got.collect())) == [("", "z"), ("k=a", "x"), ("k=a", "y")]  # binaryFile leaves empty files out
    assert len(list((tmp_path / "new").iterdir())) == 2 and [p.stat().st_size for p in (tmp_path / "new").glob("*/*k=b.html")] == [0]
    files.write_files(rows.limit(0), str(tmp_path / "none"), F.col("k"), F.col("v"))
    assert spark.read.format("binaryFile").load(str(tmp_path / "none")).count() == 0


def test_a_task_that_runs_again_leaves_each_row_once(spark, tmp_path):
    batch = pa.record_batch({"name": ["a", "b", "c"], "content": [b"1", b"2", b"3"]})

    def lost():
        yield batch.slice(0, 2)
        raise OSError("lost")

    with pytest.raises(OSError):
        files.store_files(lost(), str(tmp_path), 4, 10)
    assert spark.read.format("binaryFile").load(str(tmp_path)).count() == 0
    files.store_files(iter([batch.slice(2, 1), batch.slice(0, 2)]), str(tmp_path), 4, 11)
    files.store_files(iter([batch]), str(tmp_path), 4, 12)
    got = spark.read.format("binaryFile").load(str(tmp_path)).collect()
    assert sorted(bytes(r["content"]) for r in got) == [b"1", b"2", b"3"]


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("id", "if(id % 2 = 0, repeat('y', 500), '<title>t</title>') AS v").coalesce(1)
    files.write_files(rows, str(tmp_path / "new"), F.col("id").cast("string"), F.col("v"))
    many, few = (read(spark, str(tmp_path / "new"), Limits(max_input=100), tasks) for tasks in (None, 3))
    assert many.rdd.getNumPartitions() > 20 and few.rdd.getNumPartitions() == 6
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect())) and few.where("error.kind = 'limit'").count() == 200
