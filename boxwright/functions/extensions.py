"""Extension points: user functions over batches of images, boxes and vectors."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

DETECTION = "image_id long, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, source_model string"


class Detector(ABC):
    """Turns batches of image rows into detection rows (U01, U05). ``initialise`` runs once a task."""

    def initialise(self) -> None:
        return None

    @abstractmethod
    def predict(self, images: pd.DataFrame) -> pd.DataFrame: ...


class StubDetector(Detector):
    """A deterministic detector for tests: one box an image, from its id."""

    def __init__(self, names: tuple[str, ...]):
        self.names = names

    def predict(self, images: pd.DataFrame) -> pd.DataFrame:
        i = images["image_id"]
        class_id = (i % len(self.names)).astype("int32")
        x = (i % 50).astype(float)
        return pd.DataFrame({"image_id": i, "class_id": class_id, "class_name": [self.names[c] for c in class_id], "confidence": (i % 100) / 100.0, "x1": x, "y1": x, "x2": x + 20.0, "y2": x + 30.0, "source_model": "stub"})


def detect(images: DataFrame, detector: Detector) -> DataFrame:
    """Runs a detector over partitions in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector.initialise()
        for batch in batches:
            yield detector.predict(batch)

    return images.mapInPandas(run, DETECTION)


def explode_with(rows: DataFrame, propose: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A table function: any number of rows for each input batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield propose(batch)

    return rows.mapInPandas(run, schema)


def extended(names: tuple[str, ...], more: tuple[str, ...]) -> tuple[str, ...]:
    """A registry with more classes at its end; known names may not come again."""
    if set(names) & set(more):
        raise ValueError(f"classes come twice: {sorted(set(names) & set(more))}")
    return names + more
