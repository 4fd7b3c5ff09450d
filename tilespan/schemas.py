"""Enumerations and fixed values of the catalogue."""

#: Task states, outcomes, pipelines, style codes.
TASK_STATES = ("pending", "running", "paused", "retrying", "pending_decision", "completed", "completed_with_gaps", "failed")
ACTIVE_STATES = ("pending", "running", "paused", "retrying", "pending_decision")
SUCCESSFUL_STATES = ("completed", "completed_with_gaps")
GAP_OUTCOMES = ("no_data", "retryable_failure", "permanent_failure", "cache_failure")
OUTCOMES = ("success", *GAP_OUTCOMES)
RETRYABLE_OUTCOMES = ("retryable_failure", "cache_failure")
EXPLAINED_OUTCOMES = ("success", "no_data")
PIPELINES = ("map", "dem", "local_terrain", "contour", "plugin")
STYLE_CODES = ("m", "s", "y", "t")

MAX_ZOOM = 21
WEB_MERCATOR_MAX_LAT = 85.0511
EARTH_RADIUS = 6378137.0
ECCENTRICITY_2 = 6.69437999014e-3
METRES_PER_DEGREE = 111320.0
