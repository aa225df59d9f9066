"""Versioned baselines (SC2, SC5): immutable versions, one manifest each, readers that pin a version.

A version is a folder of parquet tables (``grains``, the joined tiers ``fine``, ``coarse`` and ``cause``) and a list of
parts of its state, the value counts of the history: a refresh writes only what it adds. It exists once its manifest does: the manifest is written beside and renamed to
``manifest-<number>.json``, which fails if that name is taken. So of two writers that publish at the same time one gets
the number and the other the next; a reader sees whole versions only, and keeps the one it pinned while newer ones come.
``expire`` removes manifests first and folders after, newest versions stay.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadcast import config as C
from roadcast.operators import baseline as B
from roadcast.operators.match import Baselines
from roadcast.sources.sinks import children


#: Parts of a state that are added up at each read; a version that would have more sums them.
MOST_PARTS = 16


class Version(NamedTuple):
    number: int
    grains: DataFrame
    state: DataFrame
    tiers: Baselines


class BaselineStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        return [int(n[9:-5]) for n in children(self.spark, self.root) if n.startswith("manifest-") and n.endswith(".json")]

    def publish(self, grains: DataFrame, counts: DataFrame, after: Version | None = None, note: str = "") -> int:
        """Writes a version and returns its number. ``counts``: the whole state, or what is added to that of ``after``."""
        folder = f"data-{uuid.uuid4().hex}"
        path = os.path.join(self.root, folder)
        # ordered by cause, so that a refresh's filter on causes skips row groups
        counts.select(*B.SOURCE).repartitionByRange("event_cause").sortWithinPartitions("event_cause").write.parquet(os.path.join(path, "state"))
        parts = [folder, *(self.manifest(after.number)["state"] if after else [])]
        if len(parts) > MOST_PARTS:
            whole = B.add_counts(self._state(parts))
            whole.repartitionByRange("event_cause").sortWithinPartitions("event_cause").write.parquet(os.path.join(path, "summed"))
            parts = [f"{folder}/summed"]
        grains.write.parquet(os.path.join(path, "grains"))
        stored = self.spark.read.schema(grains.schema).parquet(os.path.join(path, "grains"))
        for name, tier in (("fine", B.fine_baseline(stored)), ("cause", B.cause_baseline(stored)),
                           ("coarse", B.coarse_baseline(stored).where(F.col("duration_count") >= C.MIN_EVENTS))):
            tier.write.parquet(os.path.join(path, name))
        taken = self.numbers()
        number = (taken[-1] if taken else 0) + 1
        while not self._named(number, {"folder": folder, "state": parts, "note": note}):
            number += 1
        return number

    def _state(self, parts: list[str]) -> DataFrame:
        paths = [os.path.join(self.root, p if "/" in p else f"{p}/state") for p in parts]
        return self.spark.read.parquet(*paths).select(*B.SOURCE)

    def _named(self, number: int, manifest: dict) -> bool:
        """Puts the manifest under its number; False if another writer has it."""
        draft, fs = self._fs(os.path.join(self.root, f".draft-{uuid.uuid4().hex}"))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": number, **manifest}).encode()))
        out.close()
        final, _ = self._fs(os.path.join(self.root, f"manifest-{number:08d}.json"))
        jvm = self.spark._jvm
        try:  # a rename without the overwrite option fails if the name exists
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(context.makeQualified(draft), context.makeQualified(final),
                           self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as failed:  # noqa: BLE001
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(failed):
                return False
            raise
        return True

    def manifest(self, number: int) -> dict:
        rows = self.spark.read.text(os.path.join(self.root, f"manifest-{number:08d}.json"), wholetext=True).collect()
        return json.loads(rows[0][0])

    def read(self, number: int | None = None) -> Version:
        """A version, the newest unless named; it stays what it is while others are published."""
        taken = self.numbers()
        if not taken:
            raise LookupError(f"no baseline was published in {self.root}")
        number = taken[-1] if number is None else number
        manifest = self.manifest(number)
        path = os.path.join(self.root, manifest["folder"])
        table = lambda name: self.spark.read.parquet(os.path.join(path, name))
        return Version(number, table("grains"), self._state(manifest["state"]), Baselines(table("fine"), table("coarse"), table("cause")))

    def expire(self, keep: int) -> list[int]:
        """Removes all but the newest ``keep`` versions; readers of a removed one must have ended.

        Counts that a kept version adds up stay.
        """
        taken = self.numbers()
        old = taken[:len(taken) - keep]
        needed = {p.split("/")[0] for n in taken[len(old):] for p in self.manifest(n)["state"]}
        for number in old:
            folder = self.manifest(number)["folder"]
            tables = ["grains", "fine", "coarse", "cause"] if folder in needed else [""]
            for name in (f"manifest-{number:08d}.json", *(os.path.join(folder, t) if t else folder for t in tables)):
                where, fs = self._fs(os.path.join(self.root, name))
                fs.delete(where, True)
        return old
