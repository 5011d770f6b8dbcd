"""Configuration files (TOML) with defaults and checks; read on the driver."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Solver:
    """Settings of orbit determination. Every key has a default and a range."""

    max_iterations: int = 10_000
    max_seconds: float = 120.0
    tolerance: float = 1e-6
    outlier_threshold: float = 5.0
    outlier_rounds: int = 10
    huber: float = 3.0
    use_j2: bool = False
    use_drag: bool = False
    integrator: str = "rk4"
    gyro_sigma: float = 8.726e-4
    acceleration_sigma: float = 1e-5
    cd_nominal: float = 2.2
    cd_sigma: float = 1.0
    compute_covariance: bool = True

    def supported(self) -> None:
        """An error for settings that the solver can't obey."""
        if self.integrator not in ("rk4", "euler"):
            raise ValueError(f"unknown integrator: {self.integrator}")


def _checked(name: str, value, default):
    if isinstance(default, bool) != isinstance(value, bool) or not isinstance(value, (type(default), int if isinstance(default, float) else type(default))):
        raise TypeError(f"{name} must be {type(default).__name__}")
    if isinstance(default, (int, float)) and not isinstance(default, bool) and value < 0:
        raise ValueError(f"{name} must not be negative")
    return type(default)(value)


def solver_config(text: str = "", **overrides) -> Solver:
    """Defaults, then the text's [solver] section, then overrides; unknown keys are an error."""
    values = {**tomllib.loads(text).get("solver", {}), **{k: v for k, v in overrides.items() if v is not None}}
    known = {f.name: f.default for f in fields(Solver)}
    if unknown := set(values) - set(known):
        raise KeyError(f"unknown settings: {sorted(unknown)}")
    return Solver(**{k: _checked(k, v, known[k]) for k, v in values.items()})


def update_section(text: str, section: str, values: dict, allowed: set[str]) -> str:
    """The text with keys of a section set; keys outside `allowed` are an error. Other lines stay as they are."""
    if bad := set(values) - allowed:
        raise KeyError(f"not allowed: {sorted(bad)}")
    show = lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else repr(v)
    lines, out, inside, left = text.splitlines(), [], False, dict(values)
    for line in lines:
        head = line.strip()
        if head.startswith("["):
            if inside:
                out += [f"{k} = {show(v)}" for k, v in left.items()]
                left = {}
            inside = head == f"[{section}]"
        key = head.split("=")[0].strip()
        if inside and key in left:
            line = f"{key} = {show(left.pop(key))}"
        out.append(line)
    if left:
        out += ([] if inside else [f"[{section}]"]) + [f"{k} = {show(v)}" for k, v in left.items()]
    return "\n".join(out) + "\n"


# Sections, defaults and ranges of the system's configuration.
CAMERAS = 4


@dataclass(frozen=True)
class Camera:
    id: int = 0
    path: str = ""
    resolution_width: int = 640
    resolution_height: int = 480
    enabled: bool = True
    cam_to_body: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


@dataclass(frozen=True)
class Inertial:
    chipid: int = 0xD8
    i2c_addr: int = 0x68
    i2c_path: str = "/dev/i2c-7"


@dataclass(frozen=True)
class Calibration:
    camera_matrix: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    dist_coeffs: tuple[float, ...] = (0.0,) * 5


@dataclass(frozen=True)
class Inference:
    """Versions of None stay as they are."""

    rc_version: int | None = None
    ld_version: int | None = None
    weight_quant: int | None = None
    input_width: int | None = None
    input_height: int | None = None
    embedded_nms: bool | None = None
    use_trt: bool | None = None


@dataclass(frozen=True)
class Dataset:
    maximum_period: float = 600.0
    target_frame_nb: int = 10
    dataset_capture_mode: int = 2
    imu_collection_mode: int = 0
    image_capture_rate: int = 5
    imu_sample_rate_hz: float = 1.0
    target_processing_stage: int = 0
    capture_start_time: int = 0
    active_cameras: tuple[bool, ...] = (True,) * CAMERAS


@dataclass(frozen=True)
class System:
    cameras: tuple[Camera, ...]
    inertial: Inertial
    calibration: Calibration
    isp: dict
    inference: Inference


def _typed(table: dict, kind: type) -> dict:
    """Values of a section that have their field's type (numbers in lists of the right length); others keep their defaults."""
    out = {}
    for f in fields(kind):
        v = table.get(f.name)
        if isinstance(f.default, tuple):
            if isinstance(v, list) and len(v) == len(f.default) and all(isinstance(x, (int, float)) for x in v):
                out[f.name] = tuple(type(d)(x) for d, x in zip(f.default, v, strict=True))
        elif type(v) is type(f.default):
            out[f.name] = v
    return out


def inference_config(table: dict) -> Inference:
    """The [inference] section: every key is optional, one outside its range is an error."""
    both = {**{k: v for k, v in table.items() if k != "ldnet"}, **table.get("ldnet", {})}
    known = {f.name for f in fields(Inference)}
    values = {k: v for k, v in both.items() if k in known and (isinstance(v, bool) if k in ("embedded_nms", "use_trt") else isinstance(v, int) and not isinstance(v, bool))}
    for name in ("rc_version", "ld_version", "input_width", "input_height"):
        if values.get(name, 1) <= 0:
            raise ValueError(f"{name} must be above 0")
    if not 0 <= values.get("weight_quant", 0) <= 2:
        raise ValueError("weight_quant must be 0, 1 or 2")
    return Inference(**values)


def system_config(text: str) -> System:
    """Cameras (four, with ids of their own from 0 to 3, by id), inertial unit, calibration, image processor and inference. A missing camera or inertial section is an error; other faults keep defaults."""
    data = tomllib.loads(text)
    for name in ("camera-device", "imu-device"):
        if not isinstance(data.get(name), dict):
            raise KeyError(f"the section {name} is missing")
    cameras = [Camera(**_typed(t, Camera)) for t in data["camera-device"].values() if isinstance(t, dict)]
    if len(data["camera-device"]) != CAMERAS:
        raise ValueError(f"{CAMERAS} cameras are expected")
    if any(not 0 <= c.id < CAMERAS for c in cameras) or len({c.id for c in cameras}) < len(cameras):
        raise ValueError(f"cameras must have ids of their own from 0 to {CAMERAS - 1}")
    return System(
        tuple(sorted(cameras, key=lambda c: c.id)), Inertial(**_typed(data["imu-device"], Inertial)), Calibration(**_typed(data.get("camera-calibration", {}), Calibration)),
        dict(data.get("camera-isp", {})), inference_config(data.get("inference", {})),
    )


def dataset_config(text: str) -> Dataset:
    """A dataset's configuration: absent keys have defaults, a key of another type or a value out of range is an error."""
    data = tomllib.loads(text)
    values: dict = {}
    for f in fields(Dataset):
        if f.name not in data:
            continue
        v = data[f.name]
        if isinstance(f.default, tuple):
            if not isinstance(v, list) or len(v) != CAMERAS:
                raise ValueError(f"{f.name} must have {CAMERAS} elements")
            values[f.name] = tuple(map(bool, v))
        elif isinstance(v, bool) or not isinstance(v, (int, float) if isinstance(f.default, float) else int):
            raise TypeError(f"{f.name} must be a number")
        else:
            values[f.name] = type(f.default)(v)
    d = Dataset(**values)
    ranges = {
        "maximum_period": (0.1, 10_800), "target_frame_nb": (1, 255), "dataset_capture_mode": (2, 5), "imu_collection_mode": (0, 3), "image_capture_rate": (1, 254), "target_processing_stage": (0, 3),
    }
    for name, (low, high) in ranges.items():
        if not low <= getattr(d, name) <= high:
            raise ValueError(f"{name} must be from {low} to {high}")
    if not 0 < d.imu_sample_rate_hz <= 25:
        raise ValueError("imu_sample_rate_hz must be above 0 and at most 25")
    if d.target_processing_stage < max(0, d.dataset_capture_mode - 2):
        raise ValueError("target_processing_stage is below the capture mode's stage")
    return d
