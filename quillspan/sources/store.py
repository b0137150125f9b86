"""Generations of an index on any Hadoop file system: versioned folders and a pointer to the live one.

A pointer is replaced by writing a new file and renaming it, so readers see the old generation or the new one. All access
goes through Spark's own file systems, so object stores and HDFS work as local disks do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.definition import IndexDefinition
from ..plans.search import Index
from . import documents as docs


class Files:
    """Small text files and folders of one file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def write(self, name: str, text: str, replace: bool = True) -> bool:
        """Write beside, then rename; without ``replace`` an existing file wins."""
        if not replace and self.exists(name):
            return False
        tmp = self.at(f".{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if replace and self.exists(name):
            self._fs.delete(self.at(name), False)
        return bool(self._fs.rename(tmp, self.at(name)))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        got = self._fs.open(self.at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(got)).decode()
        finally:
            got.close()

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(name))) if self.exists(name) else []

    def drop(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


class Store:
    """One named index: definition, settings, generations, commits."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark, root), root.rstrip("/")

    def create(self, definition: dict, if_none_match: bool = True) -> None:
        IndexDefinition.of(definition)
        if if_none_match and self.files.exists("definition.json"):
            raise EngineError("index:exists", self.root)
        self.files.write("definition.json", json.dumps(definition))
        if not self.files.exists("LIVE"):
            self.files.write("LIVE", json.dumps({"generation": 0, "commit": 0}))

    @property
    def definition(self) -> IndexDefinition:
        text = self.files.read("definition.json")
        if text is None:
            raise EngineError("index:not_found", self.root)
        return IndexDefinition.of(text)

    def settings(self) -> dict:
        return json.loads(self.files.read("settings.json") or "{}")

    def put_settings(self, settings: dict) -> None:
        self.files.write("settings.json", json.dumps(settings | {"version": self.settings().get("version", 0) + 1}))

    def patch_settings(self, changes: dict) -> dict:
        """Dotted paths into the settings; null removes."""
        got = self.settings()
        for path, value in changes.items():
            *way, last = path.split(".")
            node = got
            for w in way:
                node = node.setdefault(w, {})
            if value is None:
                node.pop(last, None)
            else:
                node[last] = value
        self.put_settings(got)
        return got

    def live(self) -> dict:
        return json.loads(self.files.read("LIVE") or '{"generation": 0, "commit": 0}')

    def token(self) -> str:
        """Generation, commit and settings version: what a reader can ask to have seen."""
        at = self.live()
        return f"{at['generation']}.{at['commit']}.{self.settings().get('version', 0)}"

    def fresh(self, token: str) -> bool:
        have, want = ([int(x) for x in t.split(".")] for t in (self.token(), token))
        return have >= want

    def _folder(self, generation: int, commit: int) -> str:
        return f"gen={generation}/commit={commit}"

    def frame(self, generation: int | None = None) -> DataFrame:
        at = self.live()
        if generation is not None and generation != at["generation"]:
            at = {"generation": generation, "commit": self._last(generation)}
        folder = self._folder(at["generation"], at["commit"])
        if not self.files.exists(folder):
            return self.spark.createDataFrame([], self.definition.schema())
        return self.spark.read.schema(self.definition.schema()).parquet(f"{self.root}/{folder}")

    def _last(self, generation: int) -> int:
        return max([int(x.split("=")[1]) for x in self.files.list(f"gen={generation}") if x.startswith("commit=")], default=0)

    def commit(self, rows: DataFrame, generation: int | None = None) -> str:
        """Write rows as the next commit of a generation and point to it. A commit is a whole table: readers of the one
        before keep it until ``vacuum``."""
        at = self.live()
        own = generation is None or generation == at["generation"]
        gen = at["generation"] if own else generation
        nxt = self._last(gen) + 1
        rows.write.parquet(f"{self.root}/{self._folder(gen, nxt)}")
        if own:
            self.files.write("LIVE", json.dumps({"generation": gen, "commit": nxt}))
        return self.token()

    def upsert(self, new: DataFrame, order: str | None = None) -> str:
        rows = docs.valid(new, self.definition)
        self._logged(rows)
        return self.commit(docs.upserted(self.frame(), rows, self.definition.pk, order))

    def delete(self, keys: list) -> str:
        pk = self.definition.pk
        self._logged(self.spark.createDataFrame([(k,) for k in keys], self.definition.schema()[pk].dataType.simpleString().join((f"{pk} ", ""))) if keys else None)
        return self.commit(docs.deleted(self.frame(), keys, pk))

    def _logged(self, rows: DataFrame | None) -> None:
        """While a reindex runs, the keys of changes are kept beside it."""
        if rows is not None and (job := self.job()) and job["phase"] in {"COPYING", "REPLAYING"}:
            rows.select(self.definition.pk).write.mode("append").parquet(f"{self.root}/changes")

    def index(self, **how) -> Index:
        return Index(self.definition, self.frame(), self.settings(), **how)

    def vacuum(self) -> None:
        at = self.live()
        for x in self.files.list(f"gen={at['generation']}"):
            if x != f"commit={at['commit']}":
                self.files.drop(f"gen={at['generation']}/{x}")

    # reindexing ---------------------------------------------------------------------------------------------------------

    def job(self) -> dict | None:
        text = self.files.read("reindex.json")
        return json.loads(text) if text else None

    def _phase(self, job: dict, phase: str) -> dict:
        job = job | {"phase": phase}
        self.files.write("reindex.json", json.dumps(job))
        return job

    def start_reindex(self, transform=None) -> dict:
        """Copy the live generation into a new one; changes made meanwhile are logged for the replay."""
        job = self.job()
        if job and job["phase"] not in {"DONE", "FAILED", "CANCELLED"}:
            raise EngineError("reindex:running", job["phase"])
        self.files.drop("changes")
        gens = [int(x.split("=")[1]) for x in self.files.list() if x.startswith("gen=")]
        job = self._phase({"from": self.live()["generation"], "to": max(gens, default=0) + 1}, "PENDING")
        job = self._phase(job, "COPYING")
        rows = self.frame()
        try:
            self.commit(transform(rows) if transform else rows, job["to"])
        except Exception:
            self._phase(job, "FAILED")
            raise
        return self._phase(job, "REPLAYING")

    def replay(self, transform=None) -> dict:
        """Bring the changed keys over: what they hold now, or their absence."""
        job = self.job()
        if not job or job["phase"] not in {"REPLAYING", "READY"}:
            raise EngineError("reindex:not_replaying", str(job))
        if self.files.exists("changes"):
            pk = self.definition.pk
            keys = self.spark.read.parquet(f"{self.root}/changes").distinct()
            now = self.frame().join(keys, pk, "left_semi")
            kept = self.frame(job["to"]).join(keys, pk, "left_anti")
            self.commit(kept.unionByName(transform(now) if transform else now), job["to"])
            self.files.drop("changes")
        return self._phase(job, "READY")

    def cancel_reindex(self) -> dict:
        job = self.job()
        self.files.drop(f"gen={job['to']}")
        return self._phase(job, "CANCELLED")

    def promote(self, expected_live: int | None = None) -> dict:
        """Make the new generation the live one, if the live one is still the expected."""
        job = self.job()
        if not job or job["phase"] != "READY":
            raise EngineError("reindex:not_ready", str(job))
        if expected_live is not None and self.live()["generation"] != expected_live:
            raise EngineError("index:generation_changed", str(self.live()["generation"]))
        job = self._phase(job, "PROMOTING")
        self.files.write("LIVE", json.dumps({"generation": job["to"], "commit": self._last(job["to"])}))
        return self._phase(job, "DONE")

    def export_ndjson(self, path: str) -> None:
        docs.as_ndjson(self.frame().select(*(F.col(f"`{n}`") for n in self.definition.fields))).write.text(path)
