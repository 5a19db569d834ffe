"""The log of a city's runs: what a run is about to write is committed as one record before anything is written.

A record is published by creating the next number, which fails if another run was first; of two runs that
started from one state one wins, and the other has changed nothing. A record names files that are complete
by then, so whoever finds one that isn't closed can carry it out again. Every step gives the same tables
when repeated: a run that stops anywhere leaves either the old state or one that `settle` completes.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .keyed import Conflict, children, create_text, read_text

APPLIED, REFUSED = "applied", "refused"


class RunLog:
    """Numbered records under one folder, each closed by a file beside it once it is carried out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _numbers(self, ending: str) -> list[int]:
        _, statuses = children(self.spark, self.path)
        names = [s.getPath().getName() for s in statuses]
        return sorted(int(n[:8]) for n in names if n.endswith(ending) and not n.startswith("."))

    def last(self) -> int:
        """The number of the last record, 0 if there is none."""
        return max(self._numbers(".json"), default=0)

    def commit(self, after: int, record: dict) -> int:
        """Publish the record that follows number `after`; Conflict if another run was first."""
        create_text(self.spark, f"{self.path}/{after + 1:08d}.json", json.dumps(record))
        return after + 1

    def record(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/{number:08d}.json"))

    def outcome(self, number: int) -> str | None:
        """`applied` or `refused`, None while a record is open."""
        return read_text(self.spark, f"{self.path}/{number:08d}.end") if number in self._numbers(".end") else None

    def pending(self) -> int | None:
        """The number of the open record. There is one at most: a run begins after the last is closed."""
        last = self.last()
        return last if last and last not in self._numbers(".end") else None

    def close(self, number: int, outcome: str) -> None:
        try:
            create_text(self.spark, f"{self.path}/{number:08d}.end", outcome)
        except Conflict:
            pass  # another job carried it out as well
