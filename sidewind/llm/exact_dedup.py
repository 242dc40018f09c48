"""Exact dedup by an extendible-hash index on shared files.

Texts count as equal when they are identical after each run of white space becomes one space. Keys
are 64-bit hashes of the normalised text. A directory of key prefixes doubles as long as a bucket
holds more text than its capacity; a bucket that is still overfull at the greatest depth is read as
a stream and so needs no more memory. One owner task per bucket takes its key range in order,
chains the texts whose keys collide, compares their bytes, and writes the bucket's entries to the
shared folder. Rows then look their group up in the index.

Hot groups: each map task first folds the copies it has seen into one row, so a text reaches its
owner at most once per map task and cache turn-over, whatever its share of all rows.

Defined results: null text is the empty text; a null id never is the one to keep unless the group
has no other; rows that repeat the kept id count in group_size, and exactly one of them is kept;
an empty table gives an empty result. Other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import json
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, join_groups, materialize, partitions, shared_dir, ship

#: Bytes of text that a map task holds to fold copies together.
FOLD_BYTES = 32 << 20


def normalise(text: Column) -> Column:
    """Each run of white space becomes one space. Single spaces, which most runs are, need no replacement."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}{{2,}}|[\x09-\x0D]", " ")


def directory(loads: dict[int, int], max_depth: int, capacity: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Doubles the directory until each bucket fits. loads: bytes by prefix of max_depth bits.

    Returns the directory (a bucket number for each prefix of the global depth) and the buckets
    (prefix, local depth, bytes), numbered in key order.
    """
    levels = [loads]
    for _ in range(max_depth):
        up: dict[int, int] = {}
        for k, v in levels[0].items():
            up[k >> 1] = up.get(k >> 1, 0) + v
        levels.insert(0, up)
    buckets, todo = [], [(0, 0)]
    while todo:
        prefix, depth = todo.pop()
        load = levels[depth].get(prefix, 0)
        if load > capacity and depth < max_depth:
            todo += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
        else:
            buckets.append((prefix, depth, load))
    depth = max(d for _, d, _ in buckets)
    entries: list[int] = []
    for n, (_, d, _) in enumerate(buckets):
        entries += [n] * (1 << (depth - d))
    return entries, buckets


def _fold(batches):
    """Folds equal texts among those seen lately: one row per text leaves the task, with its count."""
    seen: OrderedDict = OrderedDict()
    held = 0
    names = ("h", "sha", "text", "doc_id", "n", "n_keep")

    def put_out(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names
        )

    for batch in batches:
        out = []
        for h, sha, text, doc_id in zip(*(batch.column(c).to_pylist() for c in ("h", "sha", "text", "doc_id")), strict=True):
            old = seen.get((h, text))
            if old is not None:
                old[4] += 1
                if doc_id is not None and (old[3] is None or doc_id < old[3]):
                    old[3], old[5] = doc_id, 1
                elif doc_id == old[3]:
                    old[5] += 1
                seen.move_to_end((h, text))
                continue
            seen[h, text] = [h, sha, text, doc_id, 1, 1]
            held += len(text) + 200
            while held > FOLD_BYTES and len(seen) > 1:
                row = seen.popitem(last=False)[1]
                held -= len(row[2]) + 200
                out.append(row)
        if out:
            yield put_out(out)
    rows = list(seen.values())
    for i in range(0, len(rows), 1000):
        yield put_out(rows[i : i + 1000])


def _own(batches):
    """An owner task: its rows come in key order; colliding keys chain, and bytes are compared."""
    now, chain = None, []
    names = ("bucket", "h", "place", "sha", "keep_id", "group_size", "n_keep")
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def entries(key, rows):
        return [(key[0], key[1], place, sha, keep, n, n_keep) for place, (_, sha, keep, n, n_keep) in enumerate(rows)]

    def put_out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        out = []
        for bucket, h, sha, text, doc_id, n, n_keep in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "sha", "text", "doc_id", "n", "n_keep")), strict=True):
            if (bucket, h) != now:
                if chain:
                    out += entries(now, chain)
                now, chain = (bucket, h), []
            for link in chain:
                if link[0] == text:
                    link[3] += n
                    if doc_id is not None and (link[2] is None or doc_id < link[2]):
                        link[2], link[4] = doc_id, n_keep
                    elif doc_id == link[2]:
                        link[4] += n_keep
                    break
            else:
                chain.append([text, sha, doc_id, n, n_keep])
        if out:
            yield put_out(out)
    if chain:
        yield put_out(entries(now, chain))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_depth: int = 16, bucket_bytes: int = 64 << 20, key: Column | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    key: another 64-bit key of the column ``text`` (tests force collisions by it).
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalise(F.col(text_col)).alias("text"))
    key = F.xxhash64("text") if key is None else key
    digest = materialize(rows.select("doc_id", key.alias("h"), F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("bytes")), "digests")
    total = digest.count()
    # At most 2 ** max_depth rows reach the driver.
    loads = (
        digest.groupBy("h").agg(F.max("bytes").alias("bytes"))
        .groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("prefix")).agg(F.sum("bytes").alias("bytes")).collect()
    )
    entries, buckets = directory({r.prefix: r.bytes for r in loads}, max_depth, bucket_bytes)
    depth = len(entries).bit_length() - 1
    at = F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)
    bucket = F.get(F.from_json(F.lit(json.dumps(entries)), "array<int>"), at).alias("bucket")
    path = shared_dir(spark)
    spark.createDataFrame([(n, p, d, b) for n, (p, d, b) in enumerate(buckets)], "bucket int, prefix int, depth int, bytes long").write.parquet(f"{path}/directory")
    folded = rows.select("doc_id", "text", key.alias("h"), F.sha2("text", 256).alias("sha")).mapInArrow(
        _fold, "h long, sha string, text string, doc_id long, n long, n_keep long"
    )
    schema = "bucket int, h long, place int, sha string, keep_id long, group_size long, n_keep long"
    (
        folded.select(bucket, "*")
        .repartition(max(len(buckets), partitions(spark)), "bucket", F.shiftrightunsigned("h", max(0, 52 - depth)))
        .sortWithinPartitions("bucket", "h")
        .mapInArrow(_own, schema)
        .write.parquet(f"{path}/buckets")
    )
    index = spark.read.schema(schema).parquet(f"{path}/buckets")
    groups = index.where("group_size > 1").select("h", "sha", "keep_id", "group_size", "n_keep")
    out = join_groups(digest.select("doc_id", "h", "sha"), groups, ["h", "sha"], "group_size", total).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("n_keep", F.lit(1)).alias("n_keep"),
        F.col("sha").alias("text_sha256"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if groups.agg(F.max("n_keep")).first()[0] in (None, 1):
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    # Some rows repeat the id to keep: one of them stays.
    again = kept & (F.col("n_keep") > 1)
    first = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(1))) == 1
    return (
        out.where(~again).withColumn("kept", kept).unionByName(out.where(again).withColumn("kept", first))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )
