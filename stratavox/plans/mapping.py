"""Pipeline W over scans (I1, I4, T7, T8): register, integrate, shift the window, and go on while a version of the map is written."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions.grid import fixed_matrix, fixed_transform, lng
from stratavox.operators import filters as FI
from stratavox.operators import registration as RG
from stratavox.operators import tsdf as TD
from stratavox.operators import voxels as VX
from stratavox.operators.mapstore import MapVersions
from stratavox.params import Params

AXES = ("x", "y", "z")


@dataclass
class Step:
    """What became of a scan: its pose (4x4, mm), the cell the window stands on, and the version that holds its points."""

    number: int
    pose: np.ndarray
    iterations: int
    error: float
    centre: tuple[int, int, int]
    version: int
    shifted: bool


class Mapping:
    """Scans in order against a versioned map.

    A scan is registered to the newest whole version, from the pose that the last motion predicts. Its points, moved, wait in `gathered`
    while a version is being written; once it is whole, what has gathered is subsampled (the approximate grid, at cell size), marched from the
    newest pose and merged into the next version. When the pose has gone `shift` metres since the window was last moved, the window
    moves to it, and the version that this scan makes is written beside the next `writing` scans, which gather; else it is written at
    once. A version holds all cells; the window only bounds what is marched and registered to, and which chunks are read.
    """

    def __init__(self, spark: SparkSession, path: str, params: Params, writing: int = 1, dz_per_distance: int | None = None, snap: int | None = None, metric: bool = True):
        self.spark, self.params, self.writing, self.dz, self.snap, self.metric = spark, params, writing, dz_per_distance, snap, metric
        self.versions = MapVersions(spark, path)
        self.steps: list[Step] = []
        self.whole = -1  # the newest version that counts; one under way does not, whether or not it is done
        self.gathered: list[DataFrame] = []
        self.held: list[DataFrame] = []
        self.pending: tuple[InheritableThread, int] | None = None  # the write under way, and the scans that may still pass before it is waited for
        self.failed: list[BaseException] = []
        self.centre, self.shifted_at = (0, 0, 0), np.zeros(3)
        self._grads: tuple[tuple, DataFrame] | None = None

    def _cells_of(self, pose: np.ndarray) -> tuple[int, int, int]:
        return tuple(int(v // self.params.map.resolution) for v in pose[:3, 3])

    def _register(self, points: DataFrame) -> tuple[np.ndarray, int, float]:
        m, r = self.params.map, self.params.registration
        last = self.steps[-1].pose
        prior = last @ np.linalg.inv(self.steps[-2].pose) @ last if len(self.steps) > 1 else last
        if self._grads is None or self._grads[0] != (self.whole, self.centre):
            if self._grads is not None:
                self._grads[1].unpersist()
            self._grads = (self.whole, self.centre), RG.gradients(self.versions.read(self.whole, (self.centre, m.odd_cells))).cache()
        pose, n, error = RG.register(points, self._grads[1], m.resolution, prior, r.max_iterations, r.it_weight_gradient, r.epsilon, metric=self.metric)
        if self.snap:  # to whole ticks, as an odometer's, without a turn
            pose = np.block([[np.eye(3), np.round(pose[:3, 3:] / self.snap) * self.snap], [np.zeros((1, 3)), np.ones((1, 1))]])
        return pose, n, error

    def _merged(self) -> DataFrame:
        """The next version's cells: what has gathered, marched from the newest pose, into the newest version."""
        m, points = self.params.map, self.gathered[0]
        for more in self.gathered[1:]:
            points = points.unionByName(more)
        if len(self.gathered) > 1:  # one hash table for all, as one cloud; means are truncated
            grid = VX.approximate_grid(points.withColumn("all", F.lit(0)), m.resolution, ("all",), ("scan_id", "idx"))
            points = grid.select(F.lit(self.steps[-1].number).cast("bigint").alias("scan_id"), (F.col("run") * 512 + F.col("slot")).alias("idx"), *[lng(a).alias(a) for a in AXES])
        cells = TD.merge_nearest(TD.ray_march(points, m.resolution, m.tau, pos=self._cells_of(self.steps[-1].pose), window=(self.centre, m.odd_cells), dz_per_distance=self.dz))
        return cells if self.whole < 0 else TD.upsert(self.versions.read(self.whole), cells, m.scaled_max_weight)

    def _publish(self, cells: DataFrame) -> None:
        try:
            self.versions.publish(cells)
        except BaseException as e:  # noqa: BLE001  told to whoever waits for it
            self.failed.append(e)

    def finish(self) -> None:
        """Waits for the write under way, whose version then counts."""
        if self.pending is not None:
            self.pending[0].join()
            self.pending = None
        if self.failed:
            raise self.failed[0]
        self.whole = self.versions.versions()[-1]
        for df in self.held:
            df.unpersist()
        self.held = []

    def add(self, number: int, scan: DataFrame) -> Step:
        """The next scan: scan_id, idx, x, y, z (mm, as the sensor sees them)."""
        if self.pending is not None:
            if not self.pending[1]:
                self.finish()
            else:
                self.pending = (self.pending[0], self.pending[1] - 1)
        points = FI.drop_near_origin(scan).cache()
        pose, n, error = (np.eye(4), 0, 0.0) if not self.steps else self._register(points)
        self.gathered.append(points.select("scan_id", "idx", *[c.alias(a) for c, a in zip(fixed_transform("x", "y", "z", fixed_matrix(pose.tolist())), AXES, strict=True)]))
        shifts = self.pending is None and float(np.linalg.norm(pose[:3, 3] - self.shifted_at)) >= self.params.map.shift * 1000
        if shifts:
            self.centre, self.shifted_at = self._cells_of(pose), pose[:3, 3].copy()
        self.steps.append(Step(number, pose, n, error, self.centre, self.whole + (1 if self.pending is None else 2), shifts))
        self.held.append(points)
        if self.pending is None:
            cells, self.gathered = self._merged(), []
            thread = InheritableThread(target=self._publish, args=(cells,))
            thread.start()
            self.pending = (thread, self.writing if shifts else 0)
            if not shifts or not self.writing:
                self.finish()
        return self.steps[-1]
