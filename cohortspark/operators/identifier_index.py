"""A persistent index of identifiers already seen, for messages delivered at least once.

The index is a set of immutable runs. A run holds, for each hash prefix, one sorted array
of 128-bit identifier hashes beside the owner (the record that came first). An incoming
batch is deduplicated locally, its identifiers are looked up by binary search in the
arrays of their prefix, and those not found become a new run. When more than ``fan_in``
runs exist they are merged into one, with more prefixes if the arrays have grown too long.

A manifest names the live runs and the batch that each came from. It is written last, as a
whole, so a lost executor or a failed job leaves the index as it was, and the index can be
opened again by its path. A batch that is run again doesn't see its own run, which it replaces.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.skew import hot_keys, salted_join
from cohortspark.operators.storage import Folder

#: Identifiers in one sorted array that a task handles easily.
ARRAY = 100_000
RUN = "prefix int, h1 array<bigint>, h2 array<bigint>, owner array<bigint>"
_FOUND = "h1 bigint, h2 bigint, owner bigint, n bigint, first_owner bigint"


def hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes, together the identity of ``key``."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


class IdentifierIndex:
    """The index below ``path``, opened if there is one; else new, with ``prefixes`` (a power of two) sorted arrays a run."""

    def __init__(self, spark: SparkSession, path: str, prefixes: int = 256, fan_in: int = 2):
        self.spark, self.path, self.fan_in, self._folder = spark, path.rstrip("/"), fan_in, Folder(spark, path)
        written = [n for n in self._folder.names() if n.startswith("manifest-")]
        held = json.loads(self._folder.read(written[-1])) if written else {"prefixes": prefixes, "runs": []}
        self.version = int(written[-1].removeprefix("manifest-")) if written else 0
        self.prefixes, self.runs = held["prefixes"], held["runs"]

    @property
    def last(self) -> int:
        """Number of the latest batch, -1 before the first."""
        return max((r["batch"] for r in self.runs), default=-1)

    def _prefix(self) -> Column:
        return F.shiftrightunsigned("h1", 64 - (self.prefixes.bit_length() - 1)).cast("int") if self.prefixes > 1 else F.lit(0)

    def entries(self) -> DataFrame:
        """All runs as one table of arrays."""
        return self._read(self.runs)

    def _read(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*(f"{self.path}/{r['name']}" for r in runs)) if runs else self.spark.createDataFrame([], RUN)

    def _write(self, entries: DataFrame, batch: int) -> dict:
        """A run of the entries (h1, h2, owner); its arrays are sorted, their length is bounded by the number of prefixes."""
        run = {"name": f"run-{batch:010d}-{uuid.uuid4().hex[:8]}", "batch": batch}
        arrays = entries.withColumn("prefix", self._prefix()).groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("h1", "h2", "owner"))).alias("e"))
        at = f"{self.path}/{run['name']}"
        arrays.select("prefix", *(F.col(f"e.{c}").alias(c) for c in ("h1", "h2", "owner"))).write.option("compression", "zstd").parquet(at)
        return run | {"n": self.spark.read.schema(RUN).parquet(at).agg(F.coalesce(F.sum(F.size("h1")), F.lit(0))).first()[0]}

    def _commit(self, runs: list[dict]) -> None:
        """Makes ``runs`` the live ones and deletes those they replace."""
        gone = {r["name"] for r in self.runs} - {r["name"] for r in runs}
        self._folder.write(f"manifest-{self.version + 1:012d}", json.dumps({"prefixes": self.prefixes, "runs": runs}))
        self.version, self.runs = self.version + 1, runs
        for name in gone:
            self._folder.delete(name)
        for name in [n for n in self._folder.names() if n.startswith("manifest-")][:-2]:
            self._folder.delete(name)

    def absorb(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """Looks up a batch (h1, h2, owner) and adds what is new.

        Returns one row for each distinct identifier of the batch: h1, h2, owner (its first record in the
        batch), n (records in the batch), first_owner (its first record in earlier batches, or null). Rows
        with null hashes are ignored; an empty batch changes nothing. Repeats within the batch are
        combined before the shuffle, so an identifier repeated often costs one row a task. ``number``, the next
        one if none is given, tells batches apart: one given again is looked up in earlier batches only and takes
        its former run's place. Runs are merged before the lookup, when no earlier batch can come again.
        """
        number = self.last + 1 if number is None else number
        earlier = [r for r in self.runs if r["batch"] < number]
        if len(earlier) > self.fan_in:
            earlier = [self._merged(earlier)]
        distinct = batch.where("h1 is not null").groupBy("h1", "h2").agg(F.min("owner").alias("owner"), F.count("*").alias("n"))
        found_path = f"{self.path}/found-{number:010d}-{uuid.uuid4().hex[:8]}"
        if earlier:
            looked = distinct.withColumn("prefix", self._prefix()).groupBy("prefix").cogroup(self._read(earlier).groupBy("prefix")).applyInPandas(_search, _FOUND)
        else:
            looked = distinct.select("h1", "h2", "owner", "n", F.lit(None).cast("bigint").alias("first_owner"))
        looked.write.option("compression", "zstd").parquet(found_path)
        found = self.spark.read.schema(_FOUND).parquet(found_path)
        self._commit([*earlier, self._write(found.where("first_owner is null"), number)])
        return found

    def _merged(self, runs: list[dict]) -> dict:
        """One run in place of ``runs``; live once it is committed."""
        self.prefixes = max(self.prefixes, prefixes_for(sum(r["n"] for r in runs)))
        return self._write(self._read(runs).select(F.inline(F.arrays_zip("h1", "h2", "owner"))), max(r["batch"] for r in runs))

    def merge(self) -> None:
        """Replaces all runs by one."""
        if self.runs:
            self._commit([self._merged(self.runs)])

    def drop_found(self, before: int) -> None:
        """Deletes the results of batches before number ``before``, which nobody reads any more."""
        for name in self._folder.names():
            if name.startswith("found-") and int(name.split("-")[1]) < before:
                self._folder.delete(name)


def _search(batch: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """Binary search of a batch's identifiers in the sorted arrays of their prefix."""
    h1, h2 = batch["h1"].to_numpy(np.int64), batch["h2"].to_numpy(np.int64)
    first = np.full(len(batch), np.iinfo(np.int64).max, np.int64)
    for keys, seconds, owners in zip(runs["h1"], runs["h2"], runs["owner"], strict=True):
        keys, seconds, owners = (np.asarray(x, np.int64) for x in (keys, seconds, owners))
        at = np.searchsorted(keys, h1, "left")
        todo = np.arange(len(h1))
        while len(todo := todo[at[todo] < len(keys)]):
            todo = todo[keys[at[todo]] == h1[todo]]
            hit = todo[seconds[at[todo]] == h2[todo]]
            first[hit] = np.minimum(first[hit], owners[at[hit]])
            at[todo] += 1
    known = first != np.iinfo(np.int64).max
    return pd.DataFrame({"h1": h1, "h2": h2, "owner": batch["owner"], "n": batch["n"], "first_owner": pd.Series(np.where(known, first, 0)).astype("Int64").where(known)})


def prefixes_for(identifiers: int) -> int:
    """Hash prefixes, a power of two, with which the arrays of so many identifiers hold about ARRAY each; at least 16."""
    return max(16, 1 << max(0, identifiers // ARRAY).bit_length())


def arrival_batches(rows: DataFrame, order: str, n: int) -> Iterator[Column]:
    """Conditions that split ``rows`` into about ``n`` batches by ``order``; an empty table gives none."""
    cuts = rows.stat.approxQuantile(order, [i / n for i in range(1, n)], 0.01) if n > 1 else []
    cuts = sorted(set(map(int, cuts)))
    c = F.col(order)
    if not cuts:
        yield F.lit(True)
        return
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        yield (F.lit(True) if low is None else c > low) & (F.lit(True) if high is None else c <= high)


def surplus_deliveries(spark: SparkSession, keyed: DataFrame, path: str, batches: int = 4, prefixes: int | None = None) -> DataFrame:
    """Surplus rows of ``keyed`` (row_id bigint, h1, h2): kept_id, row_id, hot identifiers spread over tasks.

    ``row_id`` ascends in order of arrival; the first row of each identifier is kept. The index grows batch
    by batch under ``path``; ``keyed`` should be stored, as it is read once a batch and once more at the end. The number
    of hash prefixes follows the number of identifiers.
    """
    total = keyed.count()
    index, results = IdentifierIndex(spark, path, prefixes or prefixes_for(total)), []
    for condition in arrival_batches(keyed, "row_id", batches):
        part = keyed.where(condition)
        found = index.absorb(part.select("h1", "h2", F.col("row_id").alias("owner")))
        repeated = found.where("n > 1 or first_owner is not null")
        keep = repeated.select("h1", "h2", F.least("owner", "first_owner").alias("kept_id"))
        hot = hot_keys(repeated, ["h1", "h2"], "n", total)
        results.append(salted_join(part, keep, ["h1", "h2"], hot, F.col("row_id")).where("row_id <> kept_id").select("kept_id", "row_id"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
