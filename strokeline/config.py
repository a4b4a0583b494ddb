"""Thresholds of the drawing profile, in pixels and degrees of a page."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    # Fixed values, to the end of the class: geometry
    min_line_length: float = 12.0
    max_residual: float = 2.5
    min_r_squared: float = 0.92
    # snapping
    max_snap_angle: float = 4.0
    min_axis_confidence: float = 0.35
    min_primitive_length: float = 20.0
    max_endpoint_displacement: float = 8.0
    max_snapped_residual: float = 3.5
    endpoint_align_tolerance: float = 6.0
    dimension_overlap: float = 0.25
    # topology
    endpoint_cluster_tolerance: float = 8.0
    intersection_proximity: float = 6.0
    min_branch_angle: float = 35.0
    collinear_max_gap: float = 14.0
    collinear_angle: float = 8.0
    ink_step: float = 3.0
    min_ink_coverage: float = 0.45
    symbol_buffer: float = 4.0
    hypothesis_margin: float = 0.15
    elbow_angles: tuple[float, float] = (55.0, 130.0)
    # text and symbols
    min_text_confidence: float = 0.45
    conflict_margin: float = 0.08
    context_radius: float = 48.0
    nearby_limit: int = 8
    symbol_margin: float = 0.08
    port_tolerance: float = 12.0
    nearby_text_radius: float = 64.0
    # associations
    witness_text_distance: float = 48.0
    dimension_target_distance: float = 72.0
    annotation_target_distance: float = 96.0
    leader_bonus: float = 0.15
    target_margin: float = 0.08
    # control plane
    lease_seconds: int = 120
    max_attempts: int = 3
    outbox_batch: int = 100
    grace_seconds: int = 300
    terms: tuple[str, ...] = ("NPT", "valve", "main", "drop", "clamp", "strut", "flange", "elbow", "tee", "connection", "threaded")
    abbreviations: dict[str, str] = field(default_factory=lambda: {"conn": "connection", "conn.": "connection", "thrd": "threaded", "maint": "maintenance"})


PROFILE = Profile()
