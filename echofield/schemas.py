"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame

POINTS = "sensor string, frame_no long, seq long, stamp_ns long, frame_id string, x float, y float, z float, intensity float, ring int, time float"
PACKETS = "sensor string, scan_id long, packet_no int, stamp_ns long, data binary, data_stamp_ns long, gps_status boolean"
CALIBRATION = "sensor string, laser_id int, rot_correction double, vert_correction double, dist_correction double, two_pt_correction_available boolean, dist_correction_x double, dist_correction_y double, vert_offset_correction double, horiz_offset_correction double, min_intensity int, max_intensity int, focal_distance double, focal_slope double, ring int"
TRANSFORMS = "child string, parent string, x double, y double, z double, yaw double, pitch double, roll double"
REGISTERS = "ts timestamp_ntz, address int, raw int, scale double, is_signed boolean"

#: What fusion asks of a cloud.
REQUIRED_FIELDS = ("x", "y", "z", "intensity", "ring", "time")


def validate(frame: DataFrame, required: tuple[str, ...] = REQUIRED_FIELDS) -> DataFrame:
    """The frame, if it has the columns; the missing ones are named otherwise."""
    if missing := [c for c in required if c not in frame.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame
