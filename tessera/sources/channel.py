"""A channel's messages as a Python data source, batch and stream, over any client that lists messages in order.

A client is a function (after_id, limit) -> list of (message_id, date, text). The registered default reads JSON lines from a local folder;
a real client is passed by subclassing `ChannelSource.client`.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "message_id long, date string, text string"


def jittered(delay: float, pick: random.Random) -> float:
    """The pause between requests, varied by 30 percent."""
    return delay * pick.uniform(0.7, 1.3)


class ChannelSource(DataSource):
    """Options: path, start, end (dates, the end day included), limit, known (comma-separated ids to skip), delay (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "channel"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChannelReader:
        return ChannelReader(self.options)

    def simpleStreamReader(self, schema) -> ChannelStream:
        return ChannelStream(self.options)


def messages(options: dict) -> Iterator[tuple[int, str, str]]:
    """The eligible messages in order of id."""
    known = {int(x) for x in options.get("known", "").split(",") if x.strip()}
    start, end, limit = options.get("start", ""), options.get("end", ""), int(options.get("limit", "0"))
    delay, pick, given = float(options.get("delay", "0")), random.Random(0), 0
    rows = [json.loads(line) for f in sorted(Path(options["path"]).glob("*.jsonl")) for line in f.read_text().splitlines() if line.strip()]
    for row in sorted(rows, key=lambda r: r["message_id"]):
        day = str(row.get("date", ""))[:10]
        if row["message_id"] in known or (start and day < start) or (end and day > end):
            continue
        if limit and given >= limit:
            return
        given += 1
        if delay:
            time.sleep(jittered(delay, pick))
        yield row["message_id"], row.get("date"), row.get("text")


class ChannelReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a channel is listed by one client

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from messages(self.options)


class ChannelStream(SimpleDataSourceStreamReader):
    """The offset is the last id that was given out."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"after": -1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [m for m in messages(self.options) if m[0] > start["after"]][:1000]
        return iter(rows), {"after": rows[-1][0] if rows else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([m for m in messages(self.options) if start["after"] < m[0] <= end["after"]])

    def commit(self, end: dict) -> None:
        pass
