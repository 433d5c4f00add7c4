"""What kind of input a path is, and its image records."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from viewlake.config import AuditConfig
from viewlake.session import local_path, shared_dir
from viewlake.sources import colmap, images, video

IMAGE_FOLDER, VIDEO, MODEL_TEXT, MODEL_BINARY = "image_folder", "video", "colmap_text", "colmap_binary"
#: Names that a caller may force, and the modes they allow.
FORCED = {"images": {IMAGE_FOLDER}, "image_folder": {IMAGE_FOLDER}, "video": {VIDEO}, "colmap": {MODEL_TEXT, MODEL_BINARY}, "colmap_text": {MODEL_TEXT}, "colmap_binary": {MODEL_BINARY}}


def _found(path: Path, recursive: bool) -> str:
    if path.is_file():
        if path.suffix.lower() == ".ply":
            raise ValueError("PLY files are results of a reconstruction, not its input")
        if video.is_video(path.name):
            return VIDEO
        raise ValueError(f"unsupported file: {path}")
    kind = colmap.detect_model(str(path))
    if kind:
        try:
            colmap.check_model(str(path), kind)
            return MODEL_BINARY if kind == "binary" else MODEL_TEXT
        except ValueError:
            pass  # a damaged model beside images counts as an image folder
    if images.list_images(str(path), recursive):
        return IMAGE_FOLDER
    raise ValueError(f"could not detect the kind of input: {path}")


def detect_mode(path: str, forced: str | None = None, recursive: bool = False) -> str:
    """Mode of an input path; a sparse model goes before images of the same folder. ValueError where nothing fits or a forced mode contradicts."""
    p = Path(path)
    if not p.exists():
        raise ValueError(f"input does not exist: {path}")
    found = _found(p, recursive)
    if forced is None:
        return found
    allowed = FORCED.get(forced.strip().lower())
    if allowed is None:
        raise ValueError(f"unknown mode {forced!r}; use one of {', '.join(FORCED)}")
    if found in allowed:
        return found
    model, is_model = {MODEL_TEXT, MODEL_BINARY}, found in (MODEL_TEXT, MODEL_BINARY)
    if allowed <= model and not is_model:
        return sorted(allowed)[-1]  # decided by the parser, which then fails on what is there
    raise ValueError(f"input looks like {found}, not {forced}")


@dataclass
class Loaded:
    mode: str
    records: DataFrame
    metadata: dict = field(default_factory=dict)

    @property
    def sparse_model(self) -> bool:
        return self.mode in (MODEL_TEXT, MODEL_BINARY)


def load(spark: SparkSession, path: str, forced: str | None = None, config: AuditConfig = AuditConfig(), extractor=video._ffmpeg) -> Loaded:
    mode = detect_mode(path, forced, config.recursive)
    if mode == IMAGE_FOLDER:
        found = images.list_images(path, config.recursive)
        return Loaded(mode, images.scan(spark, found, path))
    if mode == VIDEO:
        frames = video.extract_frames(path, config.fps, local_path(f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"), extractor=extractor)
        folder = str(Path(frames[0]).parent)
        return Loaded(mode, images.scan(spark, frames, folder), {"extracted_frame_dir": folder, "extracted_frame_count": len(frames)})
    kind, cameras, pictures = colmap.read_model(spark, path)
    return Loaded(mode, colmap.model_records(pictures, cameras), {"colmap_model_type": kind})
