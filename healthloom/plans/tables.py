"""Table schemas: what to tabulate from which resources, read from YAML or JSON and checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import quote, urlencode

SELECTIONS, TYPES = ("first", "last", "random", "all"), ("string", "number", "boolean")


@dataclass(frozen=True)
class Reference:
    """forward: the anchor's field names the other; reverse: the other's field names the anchor."""

    direction: str
    resource_type: str
    field: str


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    fhir_path: str
    selection_criteria: str = "first"
    data_type: str = "string"
    invalid_values: tuple = ()
    reference: Reference | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    resource_type: str
    columns: tuple[ColumnSpec, ...]
    query_params: dict = field(default_factory=dict)
    results_per_page: int | None = None
    earliest_update_datetime: str | None = None


def read_schema(path: str) -> dict:
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(Path(path).read_text())
    if path.endswith(".json"):
        return json.loads(Path(path).read_text())
    raise ValueError(f"a schema is a .yaml or .json file: {path}")


def reference_of(text: str | None) -> Reference | None:
    if not text:
        return None
    parts = text.split(":")
    if len(parts) != 3 or parts[0] not in ("forward", "reverse"):
        raise ValueError(f"a reference is forward:Type:field or reverse:Type:field, not {text}")
    return Reference(*parts)


def checked(schema: dict) -> dict[str, TableSpec]:
    """The tables of a schema by name; ValueError names what is wrong."""
    if not isinstance(schema, dict) or not isinstance(schema.get("tables"), dict) or not schema["tables"]:
        raise ValueError("a schema needs tables")
    shared, found = schema.get("metadata") or {}, {}
    for name, t in schema["tables"].items():
        if not isinstance(t, dict) or "resource_type" not in t or not isinstance(t.get("columns"), dict):
            raise ValueError(f"table {name} needs resource_type and columns")
        columns = []
        for c, spec in t["columns"].items():
            if not isinstance(spec, dict) or "fhir_path" not in spec:
                raise ValueError(f"column {c} of {name} needs fhir_path")
            if spec.get("selection_criteria", "first") not in SELECTIONS or spec.get("data_type", "string") not in TYPES:
                raise ValueError(f"column {c} of {name} has an unknown selection or type")
            columns.append(ColumnSpec(c, spec["fhir_path"], spec.get("selection_criteria", "first"), spec.get("data_type", "string"), tuple(spec.get("invalid_values") or ()), reference_of(spec.get("reference_location"))))
        found[name] = TableSpec(name, t["resource_type"], tuple(columns), dict(t.get("query_params") or {}), t.get("results_per_page", shared.get("results_per_page")), t.get("earliest_update_datetime", shared.get("earliest_update_datetime")))
    return found


def search_url(table: TableSpec) -> str:
    """The FHIR search of a table, relative to a server: filters and joins that the source itself can do."""
    params: list[tuple[str, str]] = [(k, v) for k, vs in table.query_params.items() for v in (vs if isinstance(vs, list) else [vs])]
    for ref in dict.fromkeys(c.reference for c in table.columns if c.reference):
        dashed = "".join(f"-{ch.lower()}" if ch.isupper() else ch for ch in ref.field)
        params.append(("_include", f"{table.resource_type}:{dashed}") if ref.direction == "forward" else ("_revinclude", f"{ref.resource_type}:{dashed}"))
    names = {k for k, _ in params}
    if table.results_per_page and "_count" not in names:
        params.append(("_count", str(table.results_per_page)))
    if table.earliest_update_datetime and "_since" not in names:
        params.append(("_since", table.earliest_update_datetime))
    return f"{table.resource_type}?{urlencode(params, quote_via=quote, safe=':,')}" if params else table.resource_type


def search_urls(tables: dict[str, TableSpec]) -> dict[str, str]:
    return {name: search_url(t) for name, t in tables.items()}


def code_search_urls(resource_types: dict[str, list[str]], patient: str, since: str | None = None) -> dict[str, str]:
    """Searches for a patient's resources of given codes, by resource type."""
    found = {}
    for kind, codes in resource_types.items():
        subject = "patient" if kind in ("Encounter", "Immunization", "MedicationRequest") else "subject"
        params = [(subject, f"Patient/{patient}")] + ([("code", ",".join(codes))] if codes else []) + ([("date", f"ge{since}")] if since else [])
        found[kind] = f"{kind}?{urlencode(params, quote_via=quote, safe=':,/')}"
    return found
