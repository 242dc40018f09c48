"""Tables that take batches as deltas: append only, merged on read, compacted by key range.

A table is a folder. ``deltas/_batch=N~NAME/_slice=K`` holds batch number N, one row per key;
``base/_base=N/_slice=K`` holds what compaction made of a slice; ``manifest`` says for each slice which base
holds, and up to which batch. A slice is a range of the keys' hash, so slices are even, and of any
number that suits the table. A batch writes only its own rows, and a compaction only the slices that
batches have touched since: neither rewrites the table. Readers see the complete batches after each
slice's base, and the newest by key counts.

A batch has a name, and applying a name twice changes nothing; what a dead writer left is skipped, as
only folders with a success marker count, and its number is not used again. One writer at a time.

Rules: ``replace`` (a key's newest row), ``coalesce`` (of each column the newest value that is not null, for
the named columns not empty either), ``ignore`` (a key's first row). Of rows of a batch with one key the
order is that of ``order``, then of a hash of the row, so that results do not depend on the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dml import next_version, versions, write_version


@dataclass
class DeltaTable:
    spark: SparkSession
    root: str
    schema: str
    keys: list[str]
    order: tuple[str, ...] = ()
    rule: str = "replace"
    empty_is_null: tuple[str, ...] = ()
    slices: int = 16

    @property
    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def slice_of(self) -> Column:
        """Even ranges of the keys' hash."""
        return F.pmod(F.shiftright(F.xxhash64(*self.keys), 17), F.lit(self.slices)).cast("int")

    # What is there.
    def _folders(self, path: str) -> list:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []

    def batches(self, torn: bool = False) -> dict[int, str]:
        """Names of complete batches by number; torn: also those whose writer died."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        out = {}
        for p in self._folders("deltas"):
            if torn or p.getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
                number, _, name = p.getName().removeprefix("_batch=").partition("~")
                out[int(number)] = name
        return dict(sorted(out.items()))

    def manifest(self) -> dict[int, tuple[int, int]]:
        """(version of the base, number of the last batch in it) of each slice that has one."""
        at = f"{self.root}/manifest"
        found = versions(self.spark, at)
        return {r["slice"]: (r.base, r.upto) for r in self.spark.read.parquet(f"{at}/v={found[-1]:06d}").collect()} if found else {}

    def pending(self) -> dict[int, list[int]]:
        """Batches of each slice that its base does not hold yet."""
        done, out = self.manifest(), {}
        for number, name in self.batches().items():
            for p in self._folders(f"deltas/_batch={number:08d}~{name}"):
                k = int(p.getName().removeprefix("_slice="))
                if number > done.get(k, (0, -1))[1]:
                    out.setdefault(k, []).append(number)
        return out

    # Merging.
    def _merged(self, rows: DataFrame, at: Column) -> DataFrame:
        """One row per key of rows, whose order is the column ``at``, by one aggregation with map-side combination."""
        rest = [c for c in self.columns if c not in self.keys]
        rows = rows.withColumn("_at", at)
        if self.rule == "coalesce":
            value = lambda c: F.nullif(F.col(c), F.lit("")) if c in self.empty_is_null else F.col(c)
            picks = [F.max_by(value(c), F.when(value(c).isNotNull(), F.col("_at"))).alias(c) for c in rest]
            return rows.groupBy("_slice", *self.keys).agg(*(picks or [F.count("*").alias("_n")])).select("_slice", *self.columns)
        pick = F.min_by if self.rule == "ignore" else F.max_by
        whole = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))
        return rows.groupBy("_slice", *self.keys).agg(pick(whole, F.col("_at")).alias("_row")).select("_slice", *self.keys, *([F.col(f"_row.{c}") for c in rest])).select("_slice", *self.columns)

    def append(self, batch: DataFrame, name: str) -> bool:
        """Adds a batch under a name; False if that name is there already."""
        known = self.batches(torn=True)
        if name in self.batches().values():
            return False
        rows = batch.select(*self.columns).withColumn("_slice", self.slice_of())
        one = self._merged(rows, F.struct(*self.order, F.xxhash64(*self.columns).alias("_hash")))
        path = f"{self.root}/deltas/_batch={max(known, default=0) + 1:08d}~{name}"
        one.repartition("_slice").write.partitionBy("_slice").mode("errorifexists").parquet(path)
        return True

    def _rows(self, only: list[int] | None = None) -> DataFrame | None:
        """All rows of these slices (all, if none are given), bases and pending batches, with their batch number ``_n``."""
        take = lambda k: only is None or k in only
        base = [f"{self.root}/base/_base={v:06d}/_slice={k}" for k, (v, _) in self.manifest().items() if take(k)]
        names = self.batches()
        delta = [f"{self.root}/deltas/_batch={n:08d}~{names[n]}/_slice={k}" for k, ns in self.pending().items() if take(k) for n in ns]
        read = lambda kind, paths, part: self.spark.read.schema(f"{self.schema}, {part}, _slice int").option("basePath", f"{self.root}/{kind}").parquet(*paths)
        out = []
        if base:
            out.append(read("base", base, "_base string").select("_slice", *self.columns, F.lit(-1).cast("long").alias("_n")))
        if delta:
            number = F.split_part(F.col("_batch"), F.lit("~"), F.lit(1)).cast("long")
            out.append(read("deltas", delta, "_batch string").select("_slice", *self.columns, number.alias("_n")))
        return out[0].unionByName(out[1]) if len(out) == 2 else out[0] if out else None

    def read(self) -> DataFrame:
        rows = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(rows, F.col("_n")).select(*self.columns)

    def compact(self, least: int = 1) -> list[int]:
        """Merges the slices with at least so many pending batches into new bases; returns these slices. Others are not touched."""
        done, pending = self.manifest(), self.pending()
        todo = sorted(k for k, ns in pending.items() if len(ns) >= least)
        if not todo:
            return []
        version = max((int(p.getName().removeprefix("_base=")) for p in self._folders("base")), default=0) + 1
        self._merged(self._rows(todo), F.col("_n")).repartition("_slice").write.partitionBy("_slice").mode("errorifexists").parquet(f"{self.root}/base/_base={version:06d}")
        rows = done | {k: (version, max(pending[k])) for k in todo}
        table = self.spark.createDataFrame([(k, *v) for k, v in sorted(rows.items())], "slice int, base long, upto long")
        write_version(table.coalesce(1), f"{self.root}/manifest", next_version(self.spark, f"{self.root}/manifest"))
        return todo

    def vacuum(self) -> int:
        """Removes base slices and batches that no reader of the newest manifest needs; returns how many folders. For when no reader is older."""
        done, pending, conf = self.manifest(), self.pending(), self.spark._jsc.hadoopConfiguration()
        gone = []
        for v in self._folders("base"):
            gone += [p for p in self._folders(f"base/{v.getName()}") if (k := int(p.getName().removeprefix("_slice="))) not in done or done[k][0] != int(v.getName().removeprefix("_base="))]
        needed = {n for ns in pending.values() for n in ns}
        for number, name in self.batches().items():
            # The marker of a batch stays, so that its name is still known.
            gone += [] if number in needed else self._folders(f"deltas/_batch={number:08d}~{name}")
        return sum(bool(p.getFileSystem(conf).delete(p, True)) for p in gone)

