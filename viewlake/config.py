"""Settings of an audit."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AuditConfig:
    # fixed values: the defaults that users of such audits expect
    min_image_count: int = 10
    warn_image_count: int = 30
    duplicate_distance: int = 6
    resolution_variation: float = 0.25
    blur_threshold: float = 80.0
    exposure_min: float = 0.20
    exposure_max: float = 0.80
    clipped_threshold: float = 0.03
    noise_threshold: float = 0.12
    sky_threshold: float = 0.35
    recursive: bool = False
    fps: float = 2.0
    strict: bool = False
    quality: bool = False


# fixed values: limits of the scene checks and of the clean-up advice
#: Scene checks: readable images, images of a folder, folders, ratio of focal lengths.
SCENE_IMAGES, FOLDER_IMAGES, FOLDERS, FOCAL_RATIO = 10, 3, 3, 2.0
#: From this many flagged images on, a clean-up is recommended.
CLEANUP_IMAGES = 3
# fixed values: suffixes of inputs and files of a sparse model
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp", ".ppm")
VIDEO_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")
MODEL_FILES = ("cameras", "images", "points3D")
