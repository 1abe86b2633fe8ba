"""Values kept one by one in a folder that all executors share: results of paid calls, searches and pages."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path
from typing import Any


class FolderCache:
    """Values by key, a file each, below a folder that executors share; a file appears whole or not at all."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, key: str) -> Path:
        h = hashlib.sha256(key.encode()).hexdigest()
        return self.folder / h[:2] / f"{h}.json"

    def get(self, key: str) -> Any:
        try:
            held = json.loads(self._path(key).read_text(encoding="utf-8"))
            return held["value"] if held["key"] == key else None
        except (OSError, ValueError, KeyError):
            return None

    def set(self, key: str, value: Any) -> None:
        path = self._path(key)
        path.parent.mkdir(exist_ok=True)
        new = path.with_suffix(f".{uuid.uuid4().hex}")
        with open(new, "w", encoding="utf-8") as f:
            json.dump({"key": key, "value": value}, f, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(new, path)
