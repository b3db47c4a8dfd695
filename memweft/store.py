"""Versioned snapshots of a vault's index, published by swapping one small file.

A version writes what it changes to a folder ``v=<n>`` and names, in ``CURRENT``, the folders of all its tables, of
earlier versions too. Writers hold an exclusive lock, write their folder in full and then replace ``CURRENT``; readers
resolve ``CURRENT`` once and keep what they resolved, so they never see half an index. Folders that none of
the last few versions names are dropped.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
from contextlib import contextmanager

KEEP = 3
SCHEMA_VERSION = 3


class SnapshotStore:
    def __init__(self, root: str):
        self.root = root
        os.makedirs(root, exist_ok=True)

    @contextmanager
    def lock(self):
        """Exclusive among processes and threads; waits."""
        with open(os.path.join(self.root, "LOCK"), "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            try:
                yield
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)

    def current(self) -> dict | None:
        """What CURRENT says, or None if there is no snapshot (or it can't be read)."""
        try:
            with open(os.path.join(self.root, "CURRENT")) as f:
                meta = json.load(f)
        except (OSError, ValueError):
            return None
        return meta if meta.get("schema") == SCHEMA_VERSION else None

    def path(self, version: int, name: str) -> str:
        return os.path.join(self.root, f"v={version}", name)

    def next_version(self) -> int:
        have = [int(d[2:]) for d in os.listdir(self.root) if d.startswith("v=") and d[2:].isdigit()]
        return max(have, default=0) + 1

    def publish(self, version: int, meta: dict) -> None:
        """Make ``version`` current, atomically and durably, and drop folders that no recent version names."""
        named = sorted({int(folder.split("/")[0][2:]) for table in meta["tables"].values() for folder, _ in table.values()} | {version})
        recent = [*((self.current() or {}).get("recent", [])), named][-KEEP:]
        tmp = os.path.join(self.root, f"CURRENT.{version}.tmp")
        with open(tmp, "w") as f:
            json.dump({"version": version, "schema": SCHEMA_VERSION, "recent": recent, **meta}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, os.path.join(self.root, "CURRENT"))
        for d in os.listdir(self.root):
            if d.startswith("v=") and d[2:].isdigit() and int(d[2:]) <= version and not any(int(d[2:]) in names for names in recent):
                shutil.rmtree(os.path.join(self.root, d), ignore_errors=True)

    def discard(self, version: int) -> None:
        shutil.rmtree(os.path.join(self.root, f"v={version}"), ignore_errors=True)
