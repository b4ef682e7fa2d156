"""Whole pipelines over batches of scans: point-to-map (W, C) and feature-based (F)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions.grid import fixed_matrix, fixed_transform
from stratavox.operators import filters as FI
from stratavox.operators import neighbours as NB
from stratavox.operators import registration as RG
from stratavox.operators import solvers as SO
from stratavox.operators import tsdf as TD
from stratavox.operators import voxels as VX
from stratavox.params import Params
from stratavox.sources import adapters as A

AXES = ("x", "y", "z")


def preprocess(points: DataFrame, pose: np.ndarray, res: int, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Stage 2 of pipeline W: near-origin reject, voxel centres, fixed-point pose, distinct."""
    return VX.distinct_voxels(FI.drop_near_origin(points), res, fixed_matrix(pose.tolist()), keys)


def preprocess_first_hit(points: DataFrame, res: int) -> DataFrame:
    """Stage 2 of pipeline C: near-origin reject and the first point of each cell."""
    return VX.first_hit(FI.drop_near_origin(points), res)


def integrate(points: DataFrame, voxels: DataFrame | None, params: Params, pos: tuple[int, int, int] = (0, 0, 0), dz_per_distance: int | None = None) -> DataFrame:
    """Stage 4: the map version after one scan; one query from points to upserted voxels."""
    m = params.map
    cells = TD.merge_nearest(TD.ray_march(points, m.resolution, m.tau, pos=pos, window=(pos, m.odd_cells), dz_per_distance=dz_per_distance))
    if voxels is None:
        return cells
    return TD.upsert(voxels, cells, m.scaled_max_weight)


def map_and_register(scans: list[DataFrame], params: Params, cut=lambda df: df.checkpoint()) -> tuple[list[np.ndarray], DataFrame]:
    """Pipeline W or C over scans in order (each with scan_id, idx, x, y, z in mm): poses and the final map.

    Scan k needs the map and pose of scan k - 1, so scans run in turn; each step is distributed over its points and voxels. `cut`
    ends the lineage of each map version; by default a reliable checkpoint.
    """
    m, r = params.map, params.registration
    pose, poses, voxels, last = np.eye(4), [], None, None
    for scan in scans:
        points = FI.drop_near_origin(scan)
        if voxels is not None:
            points = points.cache()
            pose, _, _ = RG.register(points, RG.gradients(voxels).cache(), m.resolution, pose, r.max_iterations, r.it_weight_gradient, r.epsilon)
        poses.append(pose)
        moved = points.select("scan_id", "idx", *[c.alias(a) for c, a in zip(fixed_transform("x", "y", "z", fixed_matrix(pose.tolist())), AXES, strict=True)])
        if last is None or np.linalg.norm(pose[:3, 3] - last) >= m.update_distance * 1000 or voxels is None:
            pos = tuple(int(v // m.resolution) for v in pose[:3, 3])
            voxels = cut(integrate(moved, voxels, params, pos))
            last = pose[:3, 3].copy()
        points.unpersist()
    return poses, voxels


def feature_odometry(edges: DataFrame, surfs: DataFrame, map_edges: DataFrame, map_surfs: DataFrame, params: Params, prior: np.ndarray | None = None, near: float = 1.0, rounds: int | None = None) -> np.ndarray:
    """Pipeline F's pose of a frame (metres): down-sampled features meet their five nearest map points, lines and planes are fitted, and the pose solved."""
    f = params.floam
    pose = np.eye(4) if prior is None else np.array(prior, float)
    mm = lambda df, leaf: VX.voxel_centroid(df.select(*[(F.col(a) * 1000).cast("bigint").alias(a) for a in AXES]), int(leaf * 1000)).select(*[F.col(a).cast("bigint").alias(a) for a in AXES], F.xxhash64("ix", "iy", "iz").alias("id"))
    # Both leaves come from the edge parameter, as the reference codes it.
    e, s = mm(edges, f.edge_resolution).cache(), mm(surfs, f.edge_resolution * 2).cache()
    me, ms = (df.select(*[(F.col(a) * 1000).cast("bigint").alias(a) for a in AXES]).withColumn("id", F.xxhash64(*AXES)).cache() for df in (map_edges, map_surfs))
    for _ in range(rounds or f.optimization_steps):
        tf = pose.copy()
        tf[:3, 3] *= 1000
        m = fixed_matrix(tf.tolist())

        def matched(q: DataFrame, p: DataFrame, m=m) -> DataFrame:
            moved = q.select("id", *[F.col(a).alias(f"o{a}") for a in AXES], *[c.alias(a) for c, a in zip(fixed_transform("x", "y", "z", m), AXES, strict=True)])
            knn = NB.knn_join(moved, p, 5, int(near * 1000), ["id"])
            knn = NB.accepted(knn, ["q_id"], 5, int(near * 1000) ** 2)
            return NB.scatter(knn, ["q_id", "q_ox", "q_oy", "q_oz"])

        lines = NB.principal_axes(matched(e, me)).filter("is_line")
        lines = lines.select(*[(F.col(f"q_o{a}") / 1000).alias(f"p{a}") for a in AXES], *[((F.col(f"m{a}") + 100 * F.col(f"l{a}")) / 1000).alias(f"a{a}") for a in AXES], *[((F.col(f"m{a}") - 100 * F.col(f"l{a}")) / 1000).alias(f"b{a}") for a in AXES])
        planes = NB.plane_fit(matched(s, ms)).filter("a is not null and not isnan(a)")
        planes = planes.select(*[(F.col(f"q_o{a}") / 1000).alias(f"p{a}") for a in AXES], F.col("a").alias("nx"), F.col("b").alias("ny"), F.col("c").alias("nz"), (F.col("d") / 1000).alias("d"))
        pose = SO.align_features(lines, planes, pose, outer=1)
    return pose


def register_scans(spark: SparkSession, sf_dir: str, res: int, tau: int, window: tuple, max_iterations: int = 30) -> DataFrame:
    """The registration loop on the point table: all scans make the map, the even ones, displaced by 100 mm, are registered to it."""
    p = A.points(spark, sf_dir)
    voxels = TD.merge_nearest(TD.ray_march(p, res, tau, window=window))
    grads = RG.gradients(voxels).cache()
    source = p.filter("scan_id % 2 = 0").select("scan_id", "idx", (F.col("x") - 100).alias("x"), "y", "z").cache()
    pose, n, err = RG.register(source, grads, res, None, max_iterations)
    source.unpersist()
    grads.unpersist()
    rows = [(i, j, float(pose[i, j]), int(n), float(err)) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "row int, col int, value double, iterations int, mean_error double")
