"""Parameters of the operators. Presets differ in what a site overrides."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def positive(value: float, default: float) -> float:
    return value if value > 0 else default


@dataclass(frozen=True)
class Geometry:
    """Equipment geometry: regions in metres of base_link (x ahead, y left, z up) and validity limits."""

    ground_x: tuple[float, float] = (-4.0, 4.0)
    ground_y: tuple[float, float] = (-2.5, 2.5)
    ground_z: tuple[float, float] = (-2.0, 0.5)
    wall_x: tuple[float, float] = (-6.0, 6.0)
    wall_y_abs: tuple[float, float] = (0.8, 4.0)
    wall_z: tuple[float, float] = (-1.0, 2.5)
    front_m: float = 2.0
    rear_m: float = 2.0
    window_m: float = 0.4
    side_y_abs: tuple[float, float] = (0.2, 5.0)
    side_z: tuple[float, float] = (-1.5, 1.5)
    percentile: float = 0.10
    half_width_m: float = 0.0
    min_clearance_m: float = -0.2
    max_rmse: float = 0.08
    min_normal_z: float = 0.85
    max_wall_diff_deg: float = 8.0
    min_ground: int = 20
    min_wall: int = 20
    min_distance: int = 5
    min_total: int = 100
    forward_sign: int = 1
    #: Read for old files and not used: +y is always left.
    left_sign: int = 1
    ransac_rounds: int = 80
    ransac_seed: int = 7

    def __post_init__(self):
        object.__setattr__(self, "percentile", min(1.0, max(0.0, self.percentile)))
        object.__setattr__(self, "window_m", positive(self.window_m, 0.4))
        for name in ("forward_sign", "left_sign"):
            object.__setattr__(self, name, 1 if getattr(self, name) >= 0 else -1)

    @property
    def stations(self) -> list[tuple[str, float, int]]:
        """Name, x and side of the four places at which the side distance is sampled."""
        front, rear = self.forward_sign * self.front_m, -self.forward_sign * self.rear_m
        return [("left_front", front, 1), ("left_rear", rear, 1), ("right_front", front, -1), ("right_rear", rear, -1)]


@dataclass(frozen=True)
class Equipment:
    geometry: Geometry = field(default_factory=Geometry)
    max_age_s: float = 0.5
    distance_alpha: float = 0.3
    max_distance_jump_m: float = 0.3
    angle_alpha: float = 0.1
    max_angle_jump_deg: float = 3.0

    def __post_init__(self):
        for name in ("distance_alpha", "angle_alpha"):
            object.__setattr__(self, name, min(1.0, max(0.0, getattr(self, name))))


@dataclass(frozen=True)
class Tracker:
    good_inliers: int = 25
    min_inliers: int = 8
    good_rms: float = 0.015
    max_rms: float = 0.05
    max_jump: float = 1.0
    max_speed: float = 2.0
    lost_after: int = 3
    hold: float = 0.3


@dataclass(frozen=True)
class Target:
    roi_x: tuple[float, float] = (-12.0, -4.0)
    roi_y: tuple[float, float] = (-2.0, 2.0)
    roi_z: tuple[float, float] = (-1.342, 0.858)
    leaf: float = 0.02
    intensity_above: float = 180.0
    sor_k: int = 20
    sor_sigma: float = 1.0
    tolerance: float = 0.02
    radius: tuple[float, float] = (0.095, 0.155)
    min_points: int = 20
    reference_z: float = -0.142
    zero: tuple[float, float] = (-8.0, 0.0)

    @property
    def mean_radius(self) -> float:
        return 0.5 * (self.radius[0] + self.radius[1])


@dataclass(frozen=True)
class Fusion:
    slop_s: float = 0.05
    leaf: float = 0.05
    min_points: int = 0
    drop_empty: bool = True
    queue: int = 20
    tf_wait_s: float = 0.05
    output_frame: str = "base_link"
    topics: tuple[str, ...] = ("left", "right", "rear")

    def __post_init__(self):
        """Numbers that make no sense fall back to their defaults; a structure that makes none is an error."""
        if len(self.topics) not in (2, 3):
            raise ValueError("two or three sensors are fused")
        if not all(self.topics) or not self.output_frame:
            raise ValueError("topics and the output frame need names")
        for name, default in (("slop_s", 0.05), ("leaf", 0.05), ("tf_wait_s", 0.05)):
            object.__setattr__(self, name, positive(getattr(self, name), default))
        object.__setattr__(self, "queue", self.queue if self.queue >= 1 else 20)
        object.__setattr__(self, "min_points", max(0, self.min_points))


@dataclass(frozen=True)
class Path:
    min_step_m: float = 0.05
    reset_jump_m: float = 5.0
    regression_s: float = 0.1
    max_points: int = 20_000


#: Named presets: code defaults, a site with smaller targets, and a wide region without holding.
PRESETS: dict[str, tuple[Target, Tracker]] = {
    "default": (Target(), Tracker()),
    "site": (Target(radius=(0.065, 0.085)), Tracker()),
    "runtime": (Target(radius=(0.065, 0.085), roi_x=(-10.0, 10.0), roi_y=(-10.0, 10.0)), Tracker(hold=0.0)),
}


def resolve(name: str, *sources: dict, default=None):
    """The first source that has the parameter: nested names as a.b, then the flat name."""
    for source in sources:
        here = source
        for part in name.split("."):
            here = here.get(part) if isinstance(here, dict) else None
        if here is not None:
            return here
        if (flat := source.get(name.rpartition(".")[2])) is not None and not isinstance(flat, dict):
            return flat
    return default


#: The sensor families and the names that a site's file may use for them.
FAMILIES = {"tm16": "tm16", "timoo": "tm16", "tmlidar": "tmlidar", "timoo_sdk": "timoo_sdk"}


def sensor_family(text: str = "", override: str = "", default: str = "tm16") -> str:
    """The sensor family: the override, or what the first driver_family line of a site's file says, or the default. A name that
    is not allowed is an error."""
    found = re.search(r"(?m)^[ \t]*driver_family[ \t]*:([^#:\n]*)", text)
    name = override or (found[1].strip(" \t\"'") if found else "")
    if not name:
        return default
    if name not in FAMILIES:
        raise ValueError(f"{name} is no sensor family; one of {', '.join(sorted(FAMILIES))} is")
    return FAMILIES[name]
