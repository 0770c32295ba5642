"""Saves of a sparse label layer as revisions that never change.

A revision is a small manifest that names a base (voxels, brick directory,
occupancy, label rows) and the edits appended since, each in a folder of its own
that is written once.  The manifest is written last and takes a number that
nobody else has: readers of an older revision go on reading its folders, a save
that stops half way is never seen, and of two savers that start from one
revision the second is refused.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as ops
from . import storage

VOXELS = "t int, z int, y int, x int, label long"
EDITS = f"{VOXELS}, seq long"
#: Tables of a base beside its voxels.
DERIVED = ("directory", "occupancy", "labels")


class StaleRevision(ValueError):
    """Someone else has saved since the revision that this save started from."""


class LabelRevisions:
    def __init__(self, spark: SparkSession, path: str, size: tuple[int, int, int], levels: int = 4):
        self.spark, self.path, self.size, self.levels = spark, path.rstrip("/"), size, levels
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._root = self._hadoop.Path(self.path)
        self._files = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests.

    def revisions(self) -> list[int]:
        """Numbers of the revisions that can be read, oldest first."""
        folder = self._hadoop.Path(f"{self.path}/revisions")
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, revision: int | None = None) -> dict:
        """revision, parent, base, edits, note of a revision; the newest one where none is named."""
        known = self.revisions()
        if not known or (revision is not None and revision not in known):
            raise ValueError(f"{self.path}: no revision {'' if revision is None else revision}".rstrip())
        stream = self._files.open(self._hadoop.Path(f"{self.path}/revisions/{known[-1] if revision is None else revision}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, parent: int | None, base: str, edits: list[str], note: str) -> int:
        """Writes a hidden file and renames it to the next number, which fails where that number is taken."""
        number = 1 if parent is None else parent + 1
        text = json.dumps({"revision": number, "parent": parent, "base": base, "edits": edits, "note": note}).encode()
        hidden = self._hadoop.Path(f"{self.path}/revisions/.{uuid.uuid4().hex}")
        out = self._files.create(hidden)
        out.write(text)
        out.close()
        rename = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        rename[0] = getattr(self._hadoop, "Options$Rename").NONE
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(hidden, self._hadoop.Path(f"{self.path}/revisions/{number}.json"), rename)
        except Exception as e:
            self._files.delete(hidden, False)
            if "FileAlreadyExists" in str(e):
                raise StaleRevision(f"{self.path}: revision {number} exists already") from e
            raise
        return number

    def _newest(self, parent: int | None) -> int | None:
        """What a save starts from: the newest revision; another one is refused."""
        known = self.revisions()
        newest = known[-1] if known else None
        if parent is not None and parent != newest:
            raise StaleRevision(f"{self.path}: revision {parent} is no longer the newest, {newest} is")
        return newest

    # Saves.

    def save(self, labels: DataFrame, note: str = "", parent: int | None = None) -> int:
        """A whole field (t, z, y, x, label) as a new revision, with its directory, occupancy and label rows."""
        return self._save(labels, note, self._newest(parent))

    def _save(self, labels: DataFrame, note: str, start: int | None) -> int:
        base = f"base-{uuid.uuid4().hex[:12]}"
        storage.write_labels(labels.select(*_typed(VOXELS)), f"{self.path}/{base}", self.size, self.levels)
        return self._commit(start, base, [], note)

    def append(self, edits: DataFrame, note: str = "", parent: int | None = None) -> int:
        """Edits (t, z, y, x, label, seq) on top of the newest revision; only they are written.

        Label 0 erases, the largest ``seq`` of a voxel holds, and a later revision
        holds over an earlier one.  Edits without a place or a label do nothing.
        """
        start = self._newest(parent)
        if start is None:
            raise ValueError(f"{self.path}: save a field before its edits")
        old = self.manifest(start)
        name = f"edits-{uuid.uuid4().hex[:12]}"
        typed = edits.select(*_typed(EDITS)).dropna(subset=["t", "z", "y", "x", "label"])
        typed.write.partitionBy("t").parquet(f"{self.path}/{name}")
        return self._commit(start, old["base"], [*old["edits"], name], note)

    def compact(self, note: str = "compacted") -> int:
        """A revision with the newest field as its base and no edits; what was appended meanwhile refuses it."""
        start = self._newest(None)
        return self._save(self.read(start), note, start)

    # Reads.

    def read(self, revision: int | None = None) -> DataFrame:
        """t, z, y, x, label as of a revision; filters of ``t`` open the folders of that timepoint alone."""
        m = self.manifest(revision)
        base = self._stored(f"{m['base']}/voxels", VOXELS)
        if not m["edits"]:
            return base
        rows = base.withColumn("seq", F.struct(F.lit(-1).alias("save"), F.lit(0).cast("long").alias("seq")))
        for k, name in enumerate(m["edits"]):
            rows = rows.unionByName(self._stored(name, EDITS).withColumn("seq", F.struct(F.lit(k).alias("save"), F.col("seq"))))
        return rows.groupBy("t", "z", "y", "x").agg(F.max_by("label", "seq").alias("label")).where("label <> 0")

    def table(self, name: str, revision: int | None = None) -> DataFrame:
        """directory, occupancy or labels as of a revision: stored ones where it has no edits, else derived."""
        if name not in DERIVED:
            raise ValueError(f"no table {name}; there are {', '.join(DERIVED)}")
        m = self.manifest(revision)
        if not m["edits"]:
            return self.spark.read.parquet(f"{self.path}/{m['base']}/{name}")
        return storage.label_tables(self.read(revision), self.size, self.levels)[name]

    def changes(self, older: int, newer: int | None = None) -> DataFrame:
        """t, z, y, x, before, after of voxels that differ between two revisions; 0 where there is no label."""
        sides = [self.read(r).select("t", "z", "y", "x", F.col("label").alias(n)) for r, n in ((older, "before"), (newer, "after"))]
        both = sides[0].join(sides[1], ["t", "z", "y", "x"], "full")
        return both.select("t", "z", "y", "x", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("before", "after"))).where("before <> after")

    def _stored(self, name: str, schema: str) -> DataFrame:
        """A folder by a stated schema, so that one without files is an empty table."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*_typed(schema))

    # Upkeep.

    def vacuum(self, keep: int = 1, older_than: float = 7 * 86400.0) -> list[str]:
        """Removes all but the last ``keep`` revisions, then folders that none names; returns what went.

        Folders younger than ``older_than`` seconds stay: a save may be writing them.
        """
        if keep < 1:
            raise ValueError("one revision at least stays")
        known = self.revisions()
        gone = [f"revisions/{n}.json" for n in known[:-keep]]
        for name in gone:
            self._files.delete(self._hadoop.Path(f"{self.path}/{name}"), False)
        used = {n for r in known[-keep:] for m in [self.manifest(r)] for n in (m["base"], *m["edits"])}
        now = time.time() * 1000
        for s in self._files.listStatus(self._root):
            name = s.getPath().getName()
            if name.startswith(("base-", "edits-")) and name not in used and now - s.getModificationTime() >= older_than * 1000:
                self._files.delete(s.getPath(), True)
                gone.append(name)
        return gone


def _typed(schema: str) -> list:
    return [F.col(n).cast(kind) for n, kind in (c.split() for c in schema.split(", "))]
