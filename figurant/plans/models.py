"""Recognition models as plug-ins. None is included; each runs batch by batch on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

#: Input and output columns of each kind of model.
CONTRACTS = {
    "arrow_classifier": ("fig_id string, panel_id int, crop binary", "fig_id string, panel_id int, scores array<float>"),
    "detector": ("fig_id string, tile_id int, width int, height int, data binary", "fig_id string, tile_id int, x1 float, y1 float, x2 float, y2 float, class int, score float"),
    "text_recogniser": ("fig_id string, panel_id int, crop binary", "fig_id string, panel_id int, lines array<string>, confidence float"),
    "structure_recogniser": ("fig_id string, panel_id int, crop binary", "fig_id string, panel_id int, smiles string"),
}


class Model(Protocol):
    def predict(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def applied(rows: DataFrame, kind: str, load: Callable[[], Model]) -> DataFrame:
    """The model's output for ``rows``, and ``error``. ``load`` is called once per task. Rows of
    a batch that fails keep their keys, with nulls in what the model would give and the
    exception's type and message as ``error``; elsewhere that is null."""
    given, made = CONTRACTS[kind]
    names = [c.split()[0] for c in made.split(", ")]
    keys = [c for c in names if c in [x.split()[0] for x in given.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            try:
                yield model.predict(f)[names].assign(error=None)
            except Exception as e:  # noqa: BLE001  a figure that fails must not end the batch
                yield f[keys].reindex(columns=names).astype(object).where(lambda x: x.notna(), None).assign(error=f"{type(e).__name__}: {e}")

    return rows.mapInPandas(run, f"{made}, error string")
