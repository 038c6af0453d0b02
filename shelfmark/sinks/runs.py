"""Tables that grow by committed runs.

A run (a batch job, a micro-batch of a stream) writes each of its tables to a folder of its own and then
becomes visible as a whole, by one small commit file. A run that dies before leaves folders that no
reader follows; a run that is repeated under its name or number changes nothing. Readers go by the
commits, never by what lies in the folders.

``compact`` writes what counts into one new folder per table and starts a new generation of commits with it, so the
folders and commits that a reader opens stay bounded however many runs there were. The switch is that
one commit file again. Older folders are no longer read and can be deleted by age.

One writer at a time; readers at any time. A generation's commits are one row each.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import join_shuffled

COMMIT = (
    "seq long, run string, number long, paths map<string,string>, schemas map<string,string>, "
    "runs array<string>, through long"
)


@dataclass
class Written:
    """Folders and schemas of a run's tables, not yet visible."""

    paths: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)


class RunLog:
    """Tables under ``path``. With ``keys`` and ``version`` names, see ``latest``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ commits

    def _generation(self) -> int:
        """The newest generation of commits, 0 if there is none. Lists files, opens none."""
        try:
            files = self.spark.read.schema(COMMIT).parquet(f"{self.path}/_commits").inputFiles()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return max((int(f.split("/generation=")[1].split("/")[0]) for f in files), default=0)

    def commits(self) -> list[T.Row]:
        """Commits of the newest generation in order; the first of a later one stands for all before it."""
        newest = self._generation()
        if not newest:
            return []
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/_commits/generation={newest}").collect()
        return sorted(rows, key=lambda r: r.seq)

    def has(self, run: str | None = None, number: int | None = None, commits: list[T.Row] | None = None) -> bool:
        """Is the run, or the numbered batch, committed?"""
        commits = self.commits() if commits is None else commits
        if number is not None:
            return any(number <= r.through if r.through is not None else r.number == number for r in commits)
        return any(run == r.run or run in (r.runs or ()) for r in commits)

    def write(self, tables: dict[str, DataFrame]) -> Written:
        """Write the tables to fresh folders; nothing is visible yet."""
        out, attempt = Written(), uuid.uuid4().hex
        for name, rows in tables.items():
            out.paths[name] = f"{self.path}/{name}/{attempt}"
            out.schemas[name] = rows.schema.json()
            rows.write.parquet(out.paths[name])
        return out

    def commit(self, written: Written, run: str | None = None, number: int | None = None) -> bool:
        """Make a run visible; False if a run of that name or number is already."""
        commits = self.commits()
        if self.has(run, number, commits):
            return False
        seq = commits[-1].seq + 1 if commits else 1
        self._put(self._generation() or 1, (seq, run, number, written.paths, written.schemas, None, None))
        return True

    def _put(self, generation: int, row: tuple) -> None:
        one = self.spark.createDataFrame([row], COMMIT).coalesce(1)
        one.write.mode("append").parquet(f"{self.path}/_commits/generation={generation}")

    def append(self, tables: dict[str, DataFrame], run: str | None = None, number: int | None = None) -> bool:
        """Write and commit; a run that is committed already is not written again."""
        if (run is None) == (number is None):
            raise ValueError("a run has a name, or a batch a number")
        return not self.has(run, number) and self.commit(self.write(tables), run, number)

    # ------------------------------------------------------------ reading

    def folders(self, name: str) -> list[str]:
        """Folders a reader of the table opens."""
        return [r.paths[name] for r in self.commits() if name in r.paths]

    def read(self, name: str) -> DataFrame:
        """All rows of committed runs."""
        found = [r for r in self.commits() if name in r.paths]
        if not found:
            raise ValueError(f"no committed run has a table {name!r}")
        schema = T.StructType.fromJson(json.loads(found[-1].schemas[name]))
        return self.spark.read.schema(schema).parquet(*[r.paths[name] for r in found])

    # ------------------------------------------------------------ compaction

    def compact(self, tables: dict[str, DataFrame] | None = None, after: int = 1) -> bool:
        """Replace what is committed by ``tables`` (all rows of all tables, if not given) once ``after`` runs
        have come since the last time. Runs that were committed stay so."""
        commits = self.commits()
        base = bool(commits) and commits[0].runs is not None
        if not commits or len(commits) - base < after:
            return False
        names = dict.fromkeys(n for r in commits for n in r.paths)
        written = self.write({n: self.read(n) for n in names} if tables is None else tables)
        runs = [n for r in commits for n in [r.run, *(r.runs or ())] if n is not None]
        through = max((n for r in commits for n in (r.number, r.through) if n is not None), default=None)
        row = (commits[-1].seq + 1, None, None, written.paths, written.schemas, runs, through)
        self._put(self._generation() + 1, row)
        return True


class ChangeLog(RunLog):
    """Tables of which each run brings whole new sets of rows for the keys it touches.

    A run's ``changed`` table names the keys with the version of their new set; the other tables hold
    rows with ``key`` and ``version``. A set replaces all older ones of its key, also by no rows.
    """

    CHANGED = "changed"

    def latest(self, name: str) -> DataFrame:
        """The rows of each key's newest set."""
        newest = self.read(self.CHANGED).groupBy("key").agg(F.max("version").alias("version"))
        if name == self.CHANGED:
            return newest
        same = F.col("r.key").eqNullSafe(F.col("n.key")) & (F.col("r.version") == F.col("n.version"))
        return join_shuffled(self.read(name).alias("r"), newest.alias("n"), same, "left_semi")

    def compact(self, tables: dict[str, DataFrame] | None = None, after: int = 1) -> bool:
        """Keep the newest sets only."""
        if tables is None and len(self.commits()) > after:
            names = dict.fromkeys(n for r in self.commits() for n in r.paths)
            tables = {n: self.latest(n) for n in names}
        return super().compact(tables, after)
