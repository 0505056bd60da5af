import os

import pytest
from pyspark.sql import functions as F

from lexiforge.sources import corpus, sinks


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(sinks.PageFiles)


def files(folder):
    """Files and their texts, but for the records of commits."""
    found = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if sinks.COMMITS not in d ]
    return {os.path.relpath(f, folder): open(f).read() for f in found}


def test_batch(spark, tmp_path):
    pages = spark.createDataFrame([(f"https://e.org/docs/p{k}", f"Title {k}", f"Body {k}") for k in range(30)], "url string, title string, markdown string").repartition(4)
    folder = str(tmp_path / "out")
    sinks.as_files(pages).write.format("page_files").mode("append").save(folder)
    got = files(folder)
    assert len(got) == 30 and all(t.startswith("---\nurl: \"https://e.org/docs/p") for t in got.values())
    assert sinks.STAGING not in os.listdir(folder) and len(os.listdir(f"{folder}/{sinks.COMMITS}")) == 1
    back = corpus.read_markdown(spark, folder)
    assert {r.url for r in back.collect()} == {r.url for r in pages.collect()}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    good = spark.createDataFrame([("kept.md", "old")], "path string, text string")
    good.write.format("page_files").mode("append").save(folder)
    before = files(folder)
    rows = spark.range(20).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 17, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("string").alias("text")).repartition(1)
    with pytest.raises(Exception, match="lost"):
        rows.write.format("page_files").mode("append").save(folder)
    assert files(folder) == before and sinks.STAGING not in os.listdir(folder)


@pytest.mark.parametrize("path", [None, "", "../up", "_staging/x", "/"])
def test_bad_paths(spark, tmp_path, path):
    folder = str(tmp_path / "out")
    with pytest.raises(Exception, match="no path of a page"):
        spark.createDataFrame([(path, "x")], "path string, text string").write.format("page_files").mode("append").save(folder)
    assert not os.path.exists(folder) or files(folder) == {}


def test_a_repeated_task_writes_no_second_file(tmp_path):
    """Two attempts of one task: the one that Spark accepts counts, the other goes with the staging folder."""
    folder = str(tmp_path / "out")
    writer = sinks._BatchWriter(folder)
    rows = [{"path": "a/b.md", "text": "one"}, {"path": "c.md", "text": None}, {"path": "c.md", "text": "last"}]
    writer.write(iter(rows[:1]))
    done = writer.write(iter(rows))
    writer.commit([done, None])
    assert files(folder) == {"a/b.md": "one", "c.md": "last"}


def test_a_batch_that_was_committed_is_not_written_again(tmp_path):
    folder = str(tmp_path / "out")
    first, again = sinks._StreamWriter(folder), sinks._StreamWriter(folder)
    first.commit([first.write(iter([{"path": "a.md", "text": "one"}]))], 4)
    again.commit([again.write(iter([{"path": "a.md", "text": "two"}, {"path": "b.md", "text": "two"}]))], 4)
    assert files(folder) == {"a.md": "one"}
    again.write(iter([{"path": "c.md", "text": "x"}]))
    again.abort([None], 5)
    assert files(folder) == {"a.md": "one"}


def test_stream(spark, tmp_path):
    source, folder, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    schema = "path string, text string"
    for k in range(3):
        spark.createDataFrame([(f"d{k}/p{j}.md", f"{k} {j}") for j in range(4)], schema).coalesce(2).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source).writeStream.format("page_files").option("path", folder).option("checkpointLocation", marks).start()
        q.processAllAvailable()
        q.stop()
    assert files(folder) == {f"d{k}/p{j}.md": f"{k} {j}" for k in range(3) for j in range(4)}
    assert len(os.listdir(f"{folder}/{sinks.COMMITS}")) >= 3 and sinks.STAGING not in os.listdir(folder)
