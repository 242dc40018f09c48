"""Indexes and the stream of pages: what is opened and read, beside what is found."""

import pytest
from pyspark.sql import functions as F

from sidewind.operators import dml, indexes
from sidewind.sources import page_stream


def test_lookups_open_only_files_that_can_hold_the_key(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.range(0, 4000, 2).select((F.col("id") * 7 % 4001).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, 1), (None, 2)], "k long, v long"))
    indexes.write_indexed(df, root, 1, "k", files=16)
    assert dml.versions(spark, root) == [1]
    keys = [r.k for r in df.where("k IS NOT NULL").orderBy("k").limit(2000).collect()]
    for k in keys[::400]:
        files = indexes.files_of(spark, root, k)
        assert 1 <= len(files) <= 2
        assert [tuple(r) for r in indexes.point(spark, root, "k", k).collect()] == [tuple(r) for r in df.where(F.col("k") == k).collect()]
    missing = sorted(set(range(4001)) - set(keys))
    opened = [len(indexes.files_of(spark, root, k)) for k in missing[:: len(missing) // 8]]
    # A false file comes up in about one of a hundred lookups within its range.
    assert sum(opened) <= 2 and indexes.point(spark, root, "k", 99_999).count() == 0
    assert indexes.point(spark, root, "k", None).count() == 2
    indexes.write_indexed(df.where("k < 10"), root, 2, "k", files=2)
    assert indexes.point(spark, root, "k", keys[-1]).count() == 0 and indexes.point(spark, root, "k", keys[-1], version=1).count() == 1


def test_keys_of_words(spark, tmp_path):
    df = spark.createDataFrame([(f"name {i}", i) for i in range(300)], "name string, v int")
    indexes.write_indexed(df, str(tmp_path / "t"), 1, "name", files=6)
    assert [r.v for r in indexes.point(spark, str(tmp_path / "t"), "name", "name 77").collect()] == [77]
    indexes.write_indexed(df.where("false"), str(tmp_path / "e"), 1, "name", files=2)
    assert indexes.point(spark, str(tmp_path / "e"), "name", "x").count() == 0


def pages(spark, path, low, high):
    spark.range(low, high).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.lit("<p>").alias("html"), F.lit(1).alias("extra")).write.mode("append").parquet(path)


def test_a_restart_reads_only_later_pages(spark, tmp_path):
    page_stream.register(spark)
    path = str(tmp_path / "pages")
    pages(spark, path, 0, 25)
    batches = []

    def run():
        out = spark.readStream.format("sidewind_pages").option("path", path).option("partitions", "3").load()
        out.writeStream.foreachBatch(lambda b, n: batches.append(sorted(r.page_id for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination()

    run()
    pages(spark, path, 25, 40)
    run()
    run()
    assert [b for b in batches if b] == [list(range(25)), list(range(25, 40))]
    # The same as the batch anti-join of all pages with the known ones.
    known = spark.range(25).withColumnRenamed("id", "page_id")
    every = spark.read.format("sidewind_pages").option("path", path).load()
    assert sorted(r.page_id for r in every.join(known, "page_id", "left_anti").collect()) == batches[1] and every.count() == 40


def test_pages_of_the_test_tables(spark, sf):
    page_stream.register(spark)
    got = spark.read.format("sidewind_pages").option("path", f"{sf}/pages.parquet").load()
    want = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize(("low", "high", "n"), [(-1, -1, 4), (-1, 0, 4), (3, 10, 3), (0, 100, 7)])
def test_ranges_hold_every_id_once(low, high, n):
    assert [i for r in page_stream.ranges(low, high, n) for i in range(r.low + 1, r.high + 1)] == list(range(low + 1, high + 1))
