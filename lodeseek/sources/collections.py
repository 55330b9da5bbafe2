"""The registry of collections: a name for each store and its source folder."""

from __future__ import annotations

import json
import os
import re
import shutil
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path


@dataclass
class Collection:
    store_path: str
    source_path: str
    created_at: str
    update_command: str | None = None


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds")


def checked_name(name: str) -> str:
    if not re.fullmatch(r"[a-zA-Z0-9_-]+", name):
        raise ValueError(f"collection name {name!r} may hold letters, digits, hyphens and underscores only")
    return name


class Registry:
    """Collections under a home folder; the registry file is replaced in one step."""

    def __init__(self, home: str | Path | None = None):
        self.home = Path(home or os.environ.get("LODESEEK_HOME") or Path.home() / ".lodeseek")
        (self.home / "collections").mkdir(parents=True, exist_ok=True)
        self.file = self.home / "registry.json"

    def read(self) -> dict[str, Collection]:
        return {k: Collection(**v) for k, v in json.loads(self.file.read_text()).items()} if self.file.exists() else {}

    def write(self, all_: dict[str, Collection]) -> None:
        new = self.file.with_suffix(".new")
        new.write_text(json.dumps({k: asdict(v) for k, v in all_.items()}, indent=2))
        new.replace(self.file)

    def store_path(self, name: str) -> str:
        return str(self.home / "collections" / checked_name(name))

    def register(self, name: str, source_path: str, update_command: str | None = None) -> Collection:
        all_ = self.read()
        if checked_name(name) in all_:
            raise ValueError(f"collection {name!r} exists")
        all_[name] = Collection(self.store_path(name), str(Path(source_path).resolve()), _now(), update_command)
        self.write(all_)
        return all_[name]

    def get(self, name: str) -> Collection:
        all_ = self.read()
        if name not in all_:
            raise ValueError(f"no collection {name!r}; known: {', '.join(sorted(all_)) or 'none'}")
        return all_[name]

    def update(self, name: str, **changes: str | None) -> Collection:
        all_ = self.read()
        self.get(name)
        for k, v in changes.items():
            setattr(all_[name], k, v)
        self.write(all_)
        return all_[name]

    def remove(self, name: str, delete: bool = False) -> None:
        all_ = self.read()
        gone = all_.pop(self.get(name) and name)
        self.write(all_)
        if delete:
            shutil.rmtree(gone.store_path, ignore_errors=True)

    def names(self) -> list[str]:
        return sorted(self.read())

    def copy(self, source: str, name: str, source_path: str) -> Collection:
        return self.import_store(name, self.get(source).store_path, source_path)

    def import_store(self, name: str, store: str, source_path: str) -> Collection:
        if not Path(store).is_dir():
            raise ValueError(f"no store at {store}")
        new = self.register(name, source_path)
        shutil.copytree(store, new.store_path, dirs_exist_ok=True)
        return new

    def export_store(self, name: str, to: str) -> None:
        shutil.copytree(self.get(name).store_path, to, dirs_exist_ok=False)
