"""Frames of a video, taken by an external program before the Spark job."""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from pathlib import Path

from viewlake.config import VIDEO_SUFFIXES


def is_video(name: str) -> bool:
    return Path(name).suffix.lower() in VIDEO_SUFFIXES


def _ffmpeg(video: str, pattern: str, fps: float) -> None:
    try:
        done = subprocess.run(["ffmpeg", "-i", video, "-vf", f"fps={fps}", pattern], capture_output=True, text=True)
    except FileNotFoundError as e:
        raise ValueError("ffmpeg is needed to read videos") from e
    if done.returncode:
        raise ValueError(f"ffmpeg failed: {done.stderr[-300:]}")


def extract_frames(video: str, fps: float, folder: str, extractor: Callable[[str, str, float], None] = _ffmpeg) -> list[str]:
    """Frames of a video as files in order. ``folder`` must be visible to all executors; ``extractor`` writes numbered files by a pattern."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    extractor(video, f"{folder}/frame_%06d.png", fps)
    frames = sorted(str(p) for p in Path(folder).glob("frame_*"))
    if not frames:
        raise ValueError(f"no frames in {video}")
    return frames
