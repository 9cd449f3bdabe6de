"""Settings of the compression pipeline, checked when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass

#: Compression modes and the uniformity criterion each stands for.
MODES = {"strict": "range", "fast": "variance"}
MAX_SIDE = 4096
EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
ROI_METHODS = ("classical", "u2net", "mask-dir")


class ConfigError(ValueError):
    """A setting that no plan can be built from."""


def resolve_mode(mode: str) -> str:
    """The criterion of a mode."""
    if mode not in MODES:
        raise ConfigError(f"unknown mode {mode!r}; expected one of {', '.join(MODES)}")
    return MODES[mode]


@dataclass(frozen=True)
class PipelineConfig:
    """merge_tolerance None stands for the threshold; target_cr None always tries the entropy coder; with compat a
    leaf that fails the tolerance alone leaves the rest of its band uncut, as in archives of the original program."""

    mode: str = "strict"
    threshold: float = 12.0
    min_block: int = 2
    merge_tolerance: float | None = None
    max_merge_run: int = 64
    target_cr: float | None = 4.0
    roi_method: str = "classical"
    model_path: str | None = None
    mask_dir: str | None = None
    percentile: float = 90.0
    dilate_px: int = 5
    compat: bool = False

    def __post_init__(self) -> None:
        resolve_mode(self.mode)
        if self.threshold < 0:
            raise ConfigError("threshold must not be negative")
        if self.merge_tolerance is not None and self.merge_tolerance < 0:
            raise ConfigError("merge_tolerance must not be negative")
        if self.min_block < 1 or self.max_merge_run < 1:
            raise ConfigError("min_block and max_merge_run must be 1 or more")
        if self.target_cr is not None and self.target_cr <= 0:
            raise ConfigError("target_cr must be positive")
        if not 0 <= self.percentile <= 100 or self.dilate_px < 0:
            raise ConfigError("percentile must be 0 to 100 and dilate_px not negative")
        if self.roi_method not in ROI_METHODS:
            raise ConfigError(f"unknown ROI method {self.roi_method!r}")
        if self.roi_method == "mask-dir" and not self.mask_dir:
            raise ConfigError("mask-dir needs mask_dir")

    @property
    def criterion(self) -> str:
        return MODES[self.mode]

    @property
    def tolerance(self) -> float:
        return self.threshold if self.merge_tolerance is None else self.merge_tolerance
