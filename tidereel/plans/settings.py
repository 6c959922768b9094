"""Settings of a run, their checks, named presets and fingerprint: C1, C7, C8, F10, P19."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace
from pathlib import Path

#: Frame height and rate of each sampling preset. Fixed values.
SAMPLING = {"low": (240, 6.0), "medium": (360, 12.0), "high": (540, 18.0), "max": (720, 24.0)}
#: Sampling preset, motion threshold, window seconds, detector, person threshold of each mode. Fixed values.
MODES = {
    "bulk": ("medium", 1.8, 1.0, False, 0.42),
    "movement": ("high", 1.8, 2.0, False, 0.42),
    "best": ("max", 1.4, 3.0, False, 0.42),
    "people": ("high", 1.8, 1.5, True, 0.42),
}
#: Part of every fingerprint: results of another version are not reused.
VERSION = 1


@dataclass(frozen=True)
class Settings:
    """What decides the segments of a source. A motion threshold of 0 or less is found from each source's scores (A3)."""

    height: int = 360
    fps: float = 12.0
    window_seconds: float = 1.0
    motion_threshold: float = 1.8
    person_threshold: float = 0.42
    detector: bool = False
    model: str | None = None

    def __post_init__(self):
        for ok, what in (
            (self.height > 0, "height must be above 0"),
            (self.fps > 0, "fps must be above 0"),
            (self.window_seconds > 0, "window_seconds must be above 0"),
            (0 <= self.person_threshold <= 1, "person_threshold must be from 0 to 1"),
            (self.fps * self.window_seconds + 0.5 >= 2, "a window must have two frames or more"),
        ):
            if not ok:
                raise ValueError(what)

    @classmethod
    def mode(cls, name: str, **changes) -> Settings:
        sampling, threshold, seconds, detector, person = MODES[name]
        height, fps = SAMPLING[sampling]
        return replace(cls(height, fps, seconds, threshold, person, detector), **changes)

    @property
    def fingerprint(self) -> str:
        """Equal for equal settings and an equal model file, which counts by size and time."""
        known = {k: v.hex() if isinstance(v, float) else v for k, v in asdict(self).items()}
        if self.model is not None:
            stat = Path(self.model).stat() if Path(self.model).exists() else None
            known["model_file"] = stat and [stat.st_size, stat.st_mtime_ns]
        return f"v{VERSION}-{hashlib.sha256(json.dumps(known, sort_keys=True).encode()).hexdigest()}"


def even_width(width: int, height: int, to_height: int) -> int:
    """Width of a frame scaled to a height, rounded and then raised to an even number."""
    if height <= 0 or to_height <= 0:
        return 0
    w = max(int(width * to_height / height + 0.5), 2)
    return w + w % 2
