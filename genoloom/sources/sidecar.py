"""The pseudohaploid sidecar of a panel: a small, strict JSON document."""

from __future__ import annotations

import json
import os

from ..model import InvariantBroken, IOFailed


def sidecar_path(prefix: str) -> str:
    return f"{prefix}.pseudohaploid.json"


def read_sidecar(prefix: str) -> dict[str, int]:
    """Flags by sample id; none if there is no file.

    ``{"schema_version": 1, "samples": {id: {"pseudohaploid": 0 or 1}}}``, with
    integers alone: true, 1.0 and "1" are refused.
    """
    path = sidecar_path(prefix)
    if not os.path.exists(path):
        return {}
    try:
        with open(path, encoding="utf-8") as f:
            document = json.load(f)
    except (OSError, UnicodeDecodeError) as e:
        raise IOFailed(f"cannot read {path}: {e}") from e
    except json.JSONDecodeError as e:
        raise InvariantBroken(f"{path} is no JSON: {e}") from e
    if not isinstance(document, dict) or type(document.get("schema_version")) is not int or document["schema_version"] != 1:
        raise InvariantBroken(f"{path}: schema_version must be 1")
    entries = document.get("samples")
    if not isinstance(entries, dict):
        raise InvariantBroken(f"{path}: samples must be an object")
    out = {}
    for iid, entry in entries.items():
        value = entry.get("pseudohaploid") if isinstance(entry, dict) else None
        if type(value) is not int or value not in (0, 1):
            raise InvariantBroken(f"{path}: pseudohaploid of {iid!r} must be 0 or 1")
        out[iid] = value
    return out
