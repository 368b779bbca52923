"""Keys and values of a store in numbered version files; a change is the creation of the next number, which only one writer can make."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from pulsegrid.sources import files

#: Versions that stay behind the latest, for readers that still hold its number.
KEPT = 20


class State:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[1:13]) for n in files.names(self.spark, self.folder) if n.startswith("v") and n.endswith(".json")]

    def latest(self) -> tuple[int, dict[str, str]]:
        """The newest version's number and values; 0 and none before the first."""
        version = max(self.versions(), default=0)
        return version, json.loads(files.read_text(self.spark, self._path(version))) if version else {}

    def swap(self, version: int, values: dict[str, str]) -> bool:
        """Put ``values`` in place of ``version``; False, without effect, where somebody has put other ones there since."""
        if not files.create_once(self.spark, self._path(version + 1), json.dumps(values, sort_keys=True)):
            return False
        for old in self.versions():
            if old <= version - KEPT:
                files.delete(self.spark, self._path(old))
        return True

    def get(self, key: str) -> str | None:
        return self.latest()[1].get(key)

    def update(self, change) -> dict[str, str]:
        """Apply ``change`` to the newest values until it meets no other writer: no change is lost."""
        while True:
            version, values = self.latest()
            new = change(dict(values))
            if new == values or self.swap(version, new):
                return new

    def set(self, key: str, value: str | None) -> None:
        def change(values):
            values.pop(key, None)
            return values if value is None else values | {key: value}

        self.update(change)
