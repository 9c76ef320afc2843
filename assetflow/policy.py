"""Planning policy: the defaults and the fixed name lists every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

# File classes, as the library layout defines them.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp")
COMPANION_EXTENSION = ".jxl"
JPEG_EXTENSIONS = (".jpg", ".jpeg")
METADATA_EXTENSIONS = (".xml", ".json", ".txt", ".opf", ".nfo", ".yaml", ".yml")
METADATA_NAMES = (".nomedia",)

# In-flight journal phases, known actions and encode modes.
IN_FLIGHT_PHASES = ("prepared", "encoded", "output_ready")
ACTIONS = ("legacy_replace", "sr", "transcode_only", "adopt_existing_jxl")
ENCODE_MODES = ("pixels", "jpeg_reconstruction")
ADOPT = "adopt_existing_jxl"
TRANSCODE_MODEL_SHA256 = "no-model:transcode-only:v1"

# Plan reasons.
REASON_TARGET_MET = "short edge already meets target"
REASON_LONG_EDGE = "long edge exceeds SR safety limit"
REASON_OUTPUT_LIMIT = "planned output exceeds safety limit"

# Checkpoint files by profile family.
MODEL_ROWS = (
    # family, variant, scale, filename, label
    ("real-hat", "normal", 4, "Real_HAT_GAN_SRx4.pth", "Real-HAT-GAN-x4-normal"),
    ("real-hat", "sharper", 4, "Real_HAT_GAN_SRx4_sharper.pth", "Real-HAT-GAN-x4-sharper"),
    ("hat-s", "x2", 2, "HAT-S_SRx2.pth", "HAT-S-x2"),
    ("hat-s", "x4", 4, "HAT-S_SRx4.pth", "HAT-S-x4"),
)
PROFILE_FAMILY = {
    "real-hat-auto": "real-hat",
    "hat-auto": "hat-s",
    "hat-fast": "hat-s",
    "hat-s": "hat-s",
}


@dataclass(frozen=True)
class PlanPolicy:
    """Resolution, routing and tiling limits (the defaults are the accepted settings)."""

    target_short_edge: int = 1600
    max_long_edge: int = 3200
    max_factor: int = 4
    max_output_long_edge: int = 6400
    max_output_megapixels: float = 24.0
    sharper_min_short_edge: int = 1000
    tile_candidates: tuple[int, ...] = (256, 320)
    tile_overlap: int = 16
    grayscale_tolerance: int = 3


@dataclass(frozen=True)
class ReplacePolicy:
    """Consents that in-place replacement asks for."""

    replace: bool = True
    allow_metadata_loss: bool = False
    allow_alpha_flatten: bool = False
    allow_bit_depth_loss: bool = False
    distance: float = 0.5
