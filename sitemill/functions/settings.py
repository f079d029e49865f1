"""Settings read on the driver: devices and paths."""

from __future__ import annotations

import os
import re


def device_map(device: str) -> dict[str, int] | None:
    """Where a whole model goes: GPU 0 for ``cuda``, GPU N for ``cuda:N``, no
    map for anything that isn't a GPU. Other GPU names are refused."""
    if not device.startswith("cuda"):
        return None
    found = re.fullmatch(r"cuda(?::\s*([+-]?\d+)\s*)?", device)
    if not found:
        raise ValueError(f"not a GPU: {device!r}")
    return {"": int(found[1] or 0)}


def absolute(path: str) -> str:
    """A path from the root, a leading ``~`` being the user's home."""
    return os.path.abspath(os.path.expanduser(path))
