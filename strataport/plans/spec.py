"""Migration specs: what becomes of each table, as immutable records, from YAML."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from ..errors import SpecError


@dataclass(frozen=True)
class ColumnSpec:
    type: str | None = None
    rename: str | None = None
    drop: bool = False


@dataclass(frozen=True)
class AddColumn:
    name: str
    type: str
    default: str | None = None


@dataclass(frozen=True)
class TableSpec:
    """A sparse spec: columns that it doesn't name are copied as they are."""

    name: str
    columns: dict[str, ColumnSpec] = field(default_factory=dict)
    add_columns: tuple[AddColumn, ...] = ()
    optimize_column_order: bool = False

    def target_name(self, column: str) -> str:
        spec = self.columns.get(column)
        return spec.rename if spec and spec.rename else column

    def target_key(self, key: list[str]) -> list[str]:
        return [self.target_name(c) for c in key]

    @property
    def drops(self) -> list[str]:
        return [c for c, s in self.columns.items() if s.drop]

    @property
    def renames(self) -> dict[str, str]:
        return {c: s.rename for c, s in self.columns.items() if s.rename}


@dataclass(frozen=True)
class Endpoint:
    host: str
    database: str
    user: str
    port: int = 5432
    password: str | None = None


@dataclass(frozen=True)
class MigrateSpec:
    tables: tuple[TableSpec, ...]
    slot: str
    publication: str
    checkpoint: str = "./checkpoint"
    batch_size: int = 10_000
    lag_threshold_bytes: int = 1_048_576
    max_rows_per_second: int | None = None


@dataclass(frozen=True)
class Config:
    source: Endpoint
    target: Endpoint | None = None
    migrate: MigrateSpec | None = None
    analyze_tables: tuple[str, ...] = ()
    sample_size: int = 1_000
    sequence_buffer: int = 1_000
    lag_drain_timeout: int = 300


def _endpoint(raw: object, where: str, faults: list[str]) -> Endpoint | None:
    if not isinstance(raw, dict):
        faults.append(f"{where}: must be a map")
        return None
    for k in ("host", "database", "user"):
        if not isinstance(raw.get(k), str) or not raw[k]:
            faults.append(f"{where}.{k}: is missing or empty")
    port = raw.get("port", 5432)
    if not isinstance(port, int) or not 1 <= port <= 65535:
        faults.append(f"{where}.port: must be between 1 and 65535")
    password = raw.get("password") or os.environ.get(f"{where.upper()}_PASSWORD")
    return Endpoint(str(raw.get("host")), str(raw.get("database")), str(raw.get("user")), port if isinstance(port, int) else 0, password)


def _number(raw: dict, key: str, default, least: int, where: str, faults: list[str]):
    value = raw.get(key, default)
    if value is not default and (not isinstance(value, int) or isinstance(value, bool) or value < least):
        faults.append(f"{where}.{key}: must be a whole number of {least} or more")
    return value


def table_spec(raw: dict, faults: list[str] | None = None) -> TableSpec:
    """A table's spec from a map."""
    own: list[str] = [] if faults is None else faults
    name = raw.get("name")
    if not isinstance(name, str) or not name:
        own.append("tables[].name: is missing or empty")
    columns = {}
    for column, c in (raw.get("columns") or {}).items():
        c = c or {}
        if c.get("drop") and (c.get("type") or c.get("rename")):
            own.append(f"{name}.{column}: drop can't go with type or rename")
        columns[str(column)] = ColumnSpec(c.get("type"), c.get("rename"), bool(c.get("drop", False)))
    adds = []
    for a in raw.get("add_columns") or []:
        if not a.get("name") or not a.get("type"):
            own.append(f"{name}.add_columns: name and type are required")
        adds.append(AddColumn(str(a.get("name")), str(a.get("type")), None if a.get("default") is None else str(a["default"])))
    if faults is None and own:
        raise SpecError("; ".join(own))
    return TableSpec(str(name), columns, tuple(adds), bool(raw.get("optimize_column_order", False)))


def load_config(text: str) -> Config:
    """A config from YAML text; a SpecError names all faults at once."""
    import yaml

    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise SpecError(f"not YAML: {e}") from e
    if not isinstance(raw, dict):
        raise SpecError("the config must be a map")
    faults: list[str] = []
    source = _endpoint(raw.get("source"), "source", faults)
    target = _endpoint(raw["target"], "target", faults) if raw.get("target") is not None else None
    migrate = None
    if (m := raw.get("migrate")) is not None:
        tables = tuple(table_spec(t, faults) for t in m.get("tables") or [])
        base = re.sub(r"\W", "_", tables[0].name).lower() if tables else "migration"
        for k in ("replication_slot", "publication"):
            if k in m and (not isinstance(m[k], str) or not m[k]):
                faults.append(f"migrate.{k}: must not be empty")
        migrate = MigrateSpec(
            tables, m.get("replication_slot") or f"slot_{base}", m.get("publication") or f"pub_{base}", m.get("checkpoint_db") or "./checkpoint",
            _number(m, "batch_size", 10_000, 1, "migrate", faults), _number(
                m, "lag_threshold_bytes", 1_048_576, 1, "migrate", faults
            ), _number(m, "max_rows_per_second", None, 1, "migrate", faults),
        )
    verify, cutover, analyze = raw.get("verify") or {}, raw.get("cutover") or {}, raw.get("analyze") or {}
    out = Config(
        source, target, migrate, tuple(analyze.get("tables") or ()), _number(verify, "sample_size", 1_000, 1, "verify", faults),
        _number(cutover, "sequence_buffer", 1_000, 0, "cutover", faults), _number(cutover, "lag_drain_timeout", 300, 1, "cutover", faults),
    )
    if faults:
        raise SpecError("; ".join(faults))
    return out
