"""Column functions: fixed-point and voxel arithmetic, linear algebra on arrays, text helpers."""
