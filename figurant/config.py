"""Tunable constants of the extraction, as one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed values. Distances are in pixels of the working resolution, areas in fractions."""

    semantics: str = "intended"  # or "faithful": with the known defects
    diagram_iou: float = 0.75
    reclassify_factor: float = 2.0
    detection_score: float = 0.25
    ioa_filter: float = 0.9
    tile_area_percentile: float = 0.2
    tile_height: int = 600
    tile_width: int = 800
    tile_extension: int = 100
    arrow_diagram_distance: float = 80.0
    dilation_extent: int = 50
    diagram_area_fraction: float = 0.45
    conditions_area_fraction: float = 1.5
    conditions_arrow_distance: float = 75.0
    label_reassignment_distance: float = 75.0
    binarise_threshold: int = 70
    ocr_confidence: float = 70.0
    ocr_piece_area: float = 100.0
    working_dimension: int = 1024
    equilibrium_pair_distance: float = 40.0
    arrow_cluster_distance: float = 30.0
    curly_area_percent: float = 0.1
    component_area_fraction: float = 0.95
    least_probe_distance: float = 50.0
    probe_factor: float = 0.3
    block_factor: float = 0.2
    row_eps_factor: float = 0.75
    single_bond_length: float = 1.54
    bond_limit: float = 2.12
    corner_prune_factor: float = 0.6


DEFAULT = Config()
