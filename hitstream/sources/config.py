"""Run configuration: parameters stated in files, validated when they are read."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

from hitstream.streaming.gate import GateConfig

#: Sections of a pipeline configuration.
SECTIONS = ("input_sources", "scan_params", "filter_params", "flt0_params", "flt1_params", "slt_params")


@dataclass(frozen=True)
class ScanParams:
    t_start: float
    t_end: float
    t_step: float

    def __post_init__(self) -> None:
        if self.t_step <= 0:
            raise ValueError("t_step must be positive")
        if self.t_end <= self.t_start:
            raise ValueError("t_end must lie after t_start")


def pipeline_config(path: str | Path) -> dict[str, dict]:
    """All sections of a pipeline configuration; a missing one is an error and not a default."""
    body = json.loads(Path(path).read_text())
    if gone := [s for s in SECTIONS if s not in body]:
        raise ValueError(f"{path}: missing sections {', '.join(gone)}")
    ScanParams(**{f.name: float(body["scan_params"][f.name]) for f in fields(ScanParams)})
    return {s: dict(body[s]) for s in SECTIONS}


@dataclass(frozen=True)
class DataUnit:
    id: int
    ip: str
    port: int
    type: str = ""

    @staticmethod
    def of(entry: object) -> DataUnit:
        if not isinstance(entry, dict):
            raise ValueError("a data unit must be a map")
        try:
            unit = int(entry["ID"])
        except KeyError:
            raise ValueError("a data unit lacks ID") from None
        except (TypeError, ValueError):
            raise ValueError(f"a data unit's ID must be an integer: {entry['ID']!r}") from None
        ip, port = str(entry.get("ip") or ""), int(entry.get("port") or 0)
        if not ip:
            raise ValueError("a data unit's ip must not be empty")
        if not 1 <= port <= 65_535:
            raise ValueError("a data unit's port must lie between 1 and 65535")
        return DataUnit(unit, ip, port, str(entry.get("type") or ""))


def _plain_yaml(text: str) -> dict:
    """Nested maps, lists of maps and scalars by indentation: what run configurations use, without a YAML library."""
    rows = []
    for raw in text.splitlines():
        line = "" if raw.lstrip().startswith("#") else raw.split(" #")[0].rstrip()
        if line.strip():
            rows.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, depth: int) -> tuple[object, int]:
        if rows[at][1].startswith("- "):
            items: list = []
            while at < len(rows) and rows[at][0] == depth and rows[at][1].startswith("- "):
                rows[at] = (depth + 2, rows[at][1][2:].strip())
                item, at = block(at, depth + 2)
                items.append(item)
            return items, at
        out: dict = {}
        while at < len(rows) and rows[at][0] == depth and not rows[at][1].startswith("- "):
            name, _, value = rows[at][1].partition(":")
            at += 1
            if value.strip():
                out[name.strip()] = _scalar(value.strip().strip("'\""))
            elif at < len(rows) and (rows[at][0] > depth or (rows[at][0] == depth and rows[at][1].startswith("- "))):
                out[name.strip()], at = block(at, rows[at][0])
            else:
                out[name.strip()] = None
        return out, at

    return block(0, rows[0][0])[0] if rows else {}


def _scalar(text: str) -> object:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "~": None}.get(text.lower(), text)


@dataclass
class RunConfig:
    scalars: dict[str, object]
    units: list[DataUnit] = field(default_factory=list)

    def gate(self, names: dict[str, str], **given) -> GateConfig:
        """Gate parameters from scalars under the names of ``names`` and from ``given``; GateConfig validates them."""
        return GateConfig(**({k: int(self.scalars[v]) for k, v in names.items() if v in self.scalars} | given))


def run_config(path: str | Path) -> RunConfig:
    """``global`` scalars and the list ``dataUnits`` of a run configuration (YAML, or JSON)."""
    text = Path(path).read_text()
    if Path(path).suffix == ".json":
        body = json.loads(text)
    else:
        try:
            import yaml

            body = yaml.safe_load(text)
        except ModuleNotFoundError:
            body = _plain_yaml(text)
    if not isinstance(body, dict) or not isinstance(body.get("global"), dict):
        raise ValueError(f"{path}: section 'global' is missing")
    units = body.get("dataUnits") or []
    return RunConfig(dict(body["global"]), [DataUnit.of(u) for u in units])


def resolve(name: str, variable: str, *folders: str | Path) -> Path:
    """A configuration file: where the environment variable says, else the first of the folders that holds it."""
    if given := os.environ.get(variable):
        return Path(given)
    for folder in folders:
        if (path := Path(folder) / name).is_file():
            return path
    raise FileNotFoundError(f"{name} is neither named by {variable} nor in {', '.join(map(str, folders))}")
