"""Schemas of the engine's tables."""

from __future__ import annotations

RAW_CLOUD = "stamp timestamp, frame_id string, height int, width int, point_step int, row_step int, is_dense boolean, fields array<struct<name:string,offset:int,datatype:int,count:int>>, data binary"
POINTS = "scan_id bigint, stamp timestamp, ring int, col int, x float, y float, z float, intensity float"
POINTS_MM = "scan_id bigint, idx bigint, x bigint, y bigint, z bigint"
VOXELS = "ix bigint, iy bigint, iz bigint, value bigint, weight bigint"
MAP_CHUNKS = "cx bigint, cy bigint, cz bigint, data array<bigint>"
MAP_META = "tau int, map_size_x int, map_size_y int, map_size_z int, max_distance float, map_resolution int, max_weight int"
POSES = "pose_id bigint, tx float, ty float, tz float, qx float, qy float, qz float, qw float"
IMU = "sensor_id bigint, stamp timestamp, wx double, wy double, wz double, qx double, qy double, qz double, qw double"
FEATURES = "scan_id bigint, ring int, col int, kind string, curvature double"
TIMINGS = "task string, seq bigint, micros bigint"
