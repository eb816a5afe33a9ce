"""Schemas of the relations that the operators take and return, as DDL."""

from __future__ import annotations

FIGURES = ("fig_id string, path string, width int, height int, scaling_factor double, single_bond_length double, pixels binary")
PANELS = ("fig_id long, panel_id int, t int, l int, b int, r int, role string, tags array<int>, parent_id int")
DETECTIONS = ("fig_id long, det_id long, x1 float, y1 float, x2 float, y2 float, class int, score float, tile_id int")
CLASS_SCORES = ("fig_id long, panel_id int, scores array<float>")
QUANTITY = "struct<value_num: double, value_text: string, units: string>"
CONDITIONS = (
    "catalysts array<string>, coreactants array<string>, other_species array<string>, "
    + ", ".join(f"{k} array<{QUANTITY}>" for k in ("temperature", "pressure", "time", "yield"))
)
LABELS = ("fig_id long, panel_id int, text array<string>, type string, root string, variants array<string>")
STEPS = ("fig_id long, step_id int, arrow_id int, reactants array<int>, products array<int>, single_line boolean")
OCR_TREE = ("doc_id long, blocks array<struct<lines: array<struct<words: array<struct<text: string, confidence: double>>>>>>")
GRAPH = ("fig_id long, adjacency map<int, array<int>>, nodes array<array<string>>, is_incomplete boolean")
