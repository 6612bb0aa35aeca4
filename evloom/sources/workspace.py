"""A job's own folder tree, and the frames' transform tokens."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid


class Workspace:
    """frames/, vision/ and downloads/ of one job. The tree goes only after success was marked, or by force; nothing outside it ever does."""

    PARTS = ("frames", "vision", "downloads")

    def __init__(self, root: str | None = None):
        self.root = root or os.path.join(tempfile.gettempdir(), "evloom-jobs", uuid.uuid4().hex)
        self.done = False
        for part in self.PARTS:
            os.makedirs(os.path.join(self.root, part), exist_ok=True)

    def path(self, part: str) -> str:
        return os.path.join(self.root, part)

    def mark_success(self) -> None:
        self.done = True

    def cleanup(self, force: bool = False) -> bool:
        if self.done or force:
            shutil.rmtree(self.root, ignore_errors=True)
            return True
        return False

    def size(self) -> int:
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(self.root) for f in names)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.mark_success()
        self.cleanup()


def transform_token(crop: tuple[int, int, int, int] | None, scale: tuple[int, int] | None) -> str:
    """Identity of what is done to a frame's pixels; equal requests have equal tokens."""
    part = lambda x: "-" if x is None else ",".join(map(str, x))
    return f"c{part(crop)}:s{part(scale)}"


def read_local(path: str) -> str:
    """An existing, non-empty local file's absolute path."""
    path = os.path.abspath(os.path.expanduser((path or "").strip()))
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no such file: {path}")
    if not os.path.getsize(path):
        raise ValueError(f"empty file: {path}")
    return path
