"""Model inference as a pluggable stage over rows of images."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isfinite

import pandas as pd
from pyspark.sql import DataFrame

PREDICTIONS = "image string, pred_id int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"


def parameter_errors(confidence: float, iou: float, size: int) -> list[str]:
    """What is wrong with inference parameters; booleans are no numbers."""
    errors = []
    for name, value, top in (("confidence", confidence, 1.0), ("iou", iou, 1.0), ("size", size, None)):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            errors.append(f"{name} must be a number")
        elif not isfinite(value):
            errors.append(f"{name} must be finite")
        elif top is not None and not 0 <= value <= top:
            errors.append(f"{name} must be between 0 and 1")
        elif top is None and (value <= 0 or value != int(value)):
            errors.append(f"{name} must be a positive whole number")
    return errors


def predict(images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Predictions of the rows of ``images``; ``load`` runs once per task and gives a function over batches.

    Classes besides 0 are dropped. The model is never needed to import this module.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return images.mapInPandas(run, PREDICTIONS).where("class_id = 0")
