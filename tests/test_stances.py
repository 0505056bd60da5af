import re
import time

from pyspark.sql import functions as F

from lexiforge.operators import research


def test_spaced(spark):
    texts = ["", " ", "...", "a", " a", "a.", "--a  b_c9\n", "é a", "a é", "x" * 50, "\na-b\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", research.spaced(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [re.sub("[^a-z0-9_]+", " ", r.t) for r in rows]


def test_a_long_text_is_normalised_once_for_all_terms(spark):
    """Eighty terms take about the time of one."""
    long = spark.range(400, numPartitions=4).select(F.concat(F.repeat(F.lit("word, other. "), 2000), F.col("id").cast("string")).alias("text"))

    def seconds(n):
        asked = F.lit(" ".join(f"term{k}" for k in range(n)))
        begun = time.time()
        assert long.select(research.overlap(asked, F.col("text")).alias("o")).agg(F.max("o")).first()[0] == 0
        return time.time() - begun

    seconds(1)
    assert seconds(80) < 8 * seconds(1) + 2
