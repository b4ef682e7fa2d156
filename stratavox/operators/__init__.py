"""Operators over points, voxels, poses and samples."""
