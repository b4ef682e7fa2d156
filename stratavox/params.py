"""Engine options with their defaults and derived values; loaded from YAML or dictionaries."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import PurePosixPath

from stratavox.functions.grid import WEIGHT_RESOLUTION
from stratavox.functions.text import run_identifier


@dataclass
class Lidar:
    channels: int = 128
    reg_channels: int = 16
    vfov: float = 45.0
    frequency: float = 20.0
    hresolution: int = 1024


@dataclass
class Floam:
    pcl_topic: str = ""
    edge_resolution: float = 0.4
    edge_threshold: float = 2.0
    surf_resolution: float = 0.8
    surf_threshold: float = 0.1
    min_distance: float = 2.0
    max_distance: float = 60.0
    enrich: int = 3
    optimization_steps: int = 2
    vgicp_fitness_score: float = 6.0


@dataclass
class Registration:
    lidar_topic: str = ""
    imu_topic: str = ""
    link: str = ""
    max_iterations: int = 200
    it_weight_gradient: float = 0.1
    epsilon: float = 0.03


@dataclass
class Map:
    """Lengths in metres but for resolution (millimetres a cell). tau, scaled weight and size in cells are derived."""

    resolution: int = 64
    comment: str = ""
    max_distance: float = 0.6
    update_distance: float = 0.5
    max_weight: int = 10
    shift: float = 3.0
    size: dict = field(default_factory=lambda: {"x": 20, "y": 20, "z": 5})
    initial_weight: int = 0
    refinement: bool = True
    filename: str = ""
    dir: str = ""

    @property
    def tau(self) -> int:
        return int(self.max_distance * 1000 + 1e-6)

    @property
    def scaled_max_weight(self) -> int:
        return int(self.max_weight) * WEIGHT_RESOLUTION

    @property
    def cells(self) -> tuple[int, int, int]:
        return tuple(int(self.size[a]) * 1000 // self.resolution for a in "xyz")

    @property
    def odd_cells(self) -> tuple[int, int, int]:
        return tuple(n + 1 - n % 2 for n in self.cells)

    @property
    def identifier(self) -> str:
        return run_identifier(self.resolution, self.update_distance, self.max_distance, self.scaled_max_weight, self.cells, self.comment, self.refinement)

    @property
    def path(self) -> str:
        """The map's place: filename without its extension, or dir and the identifier."""
        if self.filename:
            p = PurePosixPath(self.filename)
            return str(p.with_suffix(""))
        return f"{self.dir}/{self.identifier}"

    def metadata(self) -> dict:
        x, y, z = self.cells
        return {"tau": self.tau, "map_size_x": x, "map_size_y": y, "map_size_z": z, "max_distance": float(self.max_distance), "map_resolution": self.resolution, "max_weight": self.scaled_max_weight}


@dataclass
class Params:
    lidar: Lidar = field(default_factory=Lidar)
    floam: Floam = field(default_factory=Floam)
    registration: Registration = field(default_factory=Registration)
    map: Map = field(default_factory=Map)

    @classmethod
    def of(cls, values: dict | None) -> Params:
        """Groups and keys that are missing keep their defaults; unknown ones are an error."""
        out = cls()
        for group, items in (values or {}).items():
            if group not in {f.name for f in fields(cls)}:
                raise KeyError(f"no option group {group}")
            part = getattr(out, group)
            for key, value in (items or {}).items():
                if key not in {f.name for f in fields(part)}:
                    raise KeyError(f"no option {group}.{key}")
                have = getattr(part, key)
                setattr(part, key, {**have, **value} if isinstance(have, dict) else type(have)(value))
        return out

    @classmethod
    def load(cls, path: str) -> Params:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.of(yaml.safe_load(f))
