"""Connectors for model inference (transcription, translation, text recognition, detection, probing).

A connector is a class whose instance is made once in a worker (the model is loaded there) and called with batches. An error on an item gives null
and a message; it never ends the batch. Items are filtered before the costly call. The engine ships deterministic stubs: models are not part of it.
"""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Connector(Protocol):
    def __call__(self, items: list) -> list: ...


def enrich(rows: DataFrame, item: str, make: Callable[[], Connector], kind: str, name: str, when: Column | None = None, batch: int = 64) -> DataFrame:
    """`rows` with `name` (of type `kind`) and `name`_error. Rows where `when` does not hold are not sent to the model."""
    asked = rows if when is None else rows.where(F.coalesce(when, F.lit(False)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"{name} {kind}", f"{name}_error string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            values, errors = [], []
            for i in range(0, len(frame), batch):
                items = frame[item].iloc[i : i + batch].tolist()
                try:
                    found, failed = list(model(items)), [None] * len(items)
                    if len(found) != len(items):
                        raise ValueError("the model's answers don't match its items")
                except Exception:  # one by one: what fails is null
                    found, failed = [], []
                    for x in items:
                        try:
                            found.append(model([x])[0])
                            failed.append(None)
                        except Exception as error:
                            found.append(None)
                            failed.append(str(error)[:200])
                values += found
                errors += failed
            yield frame.assign(**{name: values, f"{name}_error": errors})

    done = asked.mapInPandas(run, schema)
    if when is None:
        return done
    rest = rows.where(~F.coalesce(when, F.lit(False)))
    return done.unionByName(rest.withColumns({name: F.lit(None).cast(kind), f"{name}_error": F.lit(None).cast("string")}))


class Echo:
    """A stub: gives its items back, in upper case if they are text."""

    def __call__(self, items: list) -> list:
        return [x.upper() if isinstance(x, str) else x for x in items]


class NumberedTranslator:
    """Sends items as one numbered list and parses the answer; an answer of another length is asked again item by item."""

    def __init__(self, engine: Callable[[str], str]):
        self.engine = engine

    def __call__(self, items: list[str]) -> list[str]:
        answer = self.engine("\n".join(f"{i + 1}. {x}" for i, x in enumerate(items)))
        found = re.findall(r"(?m)^\s*\d+\.[ \t]*(.*)$", answer)
        return [x.strip() for x in found] if len(found) == len(items) else [self.engine(x) for x in items]


class Batched:
    """A model that takes `items` items and `size` characters at a time at most; an item longer than that goes alone."""

    def __init__(self, model: Callable[[list], list], items: int = 50, size: int = 5000):
        self.model, self.items, self.size = model, items, size

    def __call__(self, items: list) -> list:
        out, part, used = [], [], 0
        for x in items:
            n = len(x) if isinstance(x, str) else 0
            if part and (len(part) == self.items or used + n > self.size):
                out += self.model(part)
                part, used = [], 0
            part.append(x)
            used += n
        return out + (self.model(part) if part else [])


def first_available(engines: Sequence[tuple[str, Callable[[], bool]]]) -> str | None:
    """The first engine, in order of preference, that is available."""
    return next((name for name, there in engines if there()), None)


class Probe:
    """The JSON of a media probe; null after `timeout` seconds, on failure and for invalid JSON."""

    def __init__(self, command: Sequence[str] = ("ffprobe", "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams"), timeout: float = 10.0):
        self.command, self.timeout = list(command), timeout

    def __call__(self, items: list[str]) -> list[str | None]:
        return [self.one(x) for x in items]

    def one(self, path: str) -> str | None:
        try:
            found = subprocess.run([*self.command, path], capture_output=True, timeout=self.timeout, text=True, check=True).stdout
            json.loads(found)
            return found
        except (OSError, subprocess.SubprocessError, ValueError):
            return None
