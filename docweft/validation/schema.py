"""Schema texts: parsing, imports, composition and serialisation."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

MAX_DEPTH, MAX_IMPORTS = 32, 100


class SchemaError(ValueError):
    """A fault of the schema itself (V017 unless stated)."""

    def __init__(self, message: str, code: str = "V017"):
        super().__init__(f"[{code}] {message}")
        self.code = code


@dataclass(frozen=True)
class Field:
    """One declared field: kinds (a union has several), flags and constraints."""

    kinds: tuple[str, ...]
    required: bool = False
    confidential: bool = False
    deprecated: bool = False
    nullable: bool = False
    type_ref: str | None = None
    default: object = None
    bounds: tuple[object, object] | None = None
    pattern: str | None = None
    enum: tuple[str, ...] | None = None
    format: str | None = None
    condition: tuple[str, str, str, bool] | None = None
    flags: tuple[str, ...] = ()


@dataclass
class Schema:
    """Fields by path, array rules, object rules, types, imports and metadata."""

    fields: dict[str, Field] = field(default_factory=dict)
    arrays: dict[str, dict] = field(default_factory=dict)
    rules: list[tuple[str, str, str]] = field(default_factory=list)
    types: dict[str, dict[str, Field]] = field(default_factory=dict)
    parents: dict[str, list[str]] = field(default_factory=dict)
    imports: list[tuple[str, str | None]] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)


KINDS = {"##": "integer", "#$": "currency", "#%": "percent", "#": "number", "?": "boolean", "^": "binary", "~": "null"}
TEMPORAL = ("date", "timestamp", "time", "duration", "datetime")


def _literal(text: str):
    text = text.strip()
    for kind in (int, float):
        try:
            return kind(text.lstrip("#$%"))
        except ValueError:
            pass
    return text.strip('"') or None


def parse_field(text: str) -> Field:
    """The right side of a field line."""
    flags = {"required": False, "confidential": False, "deprecated": False, "nullable": False}
    names = {"!": "required", "*": "confidential", "-": "deprecated"}
    body = text.strip()
    while body and body[0] in names:
        flags[names[body[0]]], body = True, body[1:].lstrip()
    if body.startswith("~") and len(body) > 1:
        flags["nullable"], body = True, body[1:].lstrip()
    out: dict = {}
    pattern = re.search(r':pattern\s+"((?:[^"\\]|\\.)*)"|:/((?:[^/\\]|\\.)*)/', body)
    if pattern:
        out["pattern"] = pattern[1] if pattern[1] is not None else pattern[2]
        body = body.replace(pattern[0], " ")
    for name in ("if", "unless"):
        m = re.search(rf":{name}\s+(\S+)\s*(=|==|!=|<>|<=|>=|<|>)\s*(\"[^\"]*\"|\S+)", body)
        if m:
            out["condition"] = (m[1], m[2], m[3].strip('"'), name == "if")
            body = body.replace(m[0], " ")
    m = re.search(r":enum\s*\(([^)]*)\)", body)
    if m:
        out["enum"] = tuple(x.strip().strip('"') for x in m[1].split(","))
        body = body.replace(m[0], " ")
    m = re.search(r":format\s+([\w-]+)", body)
    if m:
        out["format"] = m[1]
        body = body.replace(m[0], " ")
    m = re.search(r":?\(([^()]*)\)", body)
    if m:
        inner = m[1]
        if ".." in inner:
            low, _, high = inner.partition("..")
            out["bounds"] = (_literal(low), _literal(high))
        elif "," in inner:
            out["enum"] = tuple(x.strip().strip('"') for x in inner.split(","))
        else:
            out["bounds"] = (_literal(inner), _literal(inner))
        body = body.replace(m[0], " ")
    extra = []
    for m in re.finditer(r":(\w+)(?:\s+\"[^\"]*\")?", body):
        if m[1] == "required":
            flags["required"] = True
        elif m[1] == "optional":
            flags["required"] = False
        else:
            extra.append(m[1])
    body = re.sub(r":(\w+)(?:\s+\"[^\"]*\")?", " ", body).strip()
    kinds: list[str] = []
    for part in filter(None, (p.strip() for p in body.split("|"))) if body else ["string"]:
        mark = next((k for k in KINDS if part.startswith(k)), None)
        if part.startswith("@"):
            kinds.append("reference" if part == "@" else "type")
            out["type_ref"] = part[1:] or None
        elif mark:
            kinds.append(KINDS[mark])
            rest = part[len(mark) :]
            if rest and not rest.startswith(".") and mark != "^":
                out["default"] = _literal(rest)
        elif part in TEMPORAL:
            kinds.append("timestamp" if part == "datetime" else part)
        else:
            kinds.append("string")
            if part.strip('"') and part not in ("string", "text"):
                out["default"] = part.strip('"')
    return Field(tuple(kinds or ["string"]), flags=tuple(extra), **flags, **out)


def parse_schema(text: str) -> Schema:
    """Read a schema, line by line."""
    out = Schema()
    where, kind = "", "section"
    for raw in text.replace("\r\n", "\n").split("\n"):
        line = re.sub(r'\s*;(?=(?:[^"]*"[^"]*")*[^"]*$).*$', "", raw).strip()
        if not line:
            continue
        if line.startswith("@import"):
            m = re.match(r'@import\s+"([^"]+)"(?:\s+as\s+(\w+))?', line)
            if not m:
                raise SchemaError(f"bad import {line!r}")
            out.imports.append((m[1], m[2]))
        elif line.startswith("@"):
            m = re.match(r"@([\w.]+)(?:\s*:\s*(.+)|\s*=\s*(.+))?$", line)
            where, kind = m[1], "type"
            out.types.setdefault(where, {})
            out.parents[where] = [p.strip().split(" ")[0].lstrip("@") for p in (m[2] or m[3] or "").split("&") if p.strip()]
        elif line.startswith("{"):
            body = line.strip("{}").strip()
            if body == "$":
                where, kind = "", "meta"
            elif body.startswith("@"):
                where, kind = body[1:], "type"
                out.types.setdefault(where, {})
            elif "[]" in body:
                name, _, columns = body.partition(":")
                path = name.strip().removesuffix("[]")
                where, kind = f"{path}[]", "section"
                rule = out.arrays.setdefault(path, {})
                if columns.strip():
                    rule["columns"] = [c.strip() for c in columns.split(",")]
            elif body.startswith("."):
                where, kind = f"{where.split('.')[0]}{body}", "section"
            else:
                where, kind = body, "section"
        elif line.startswith(":") or line.startswith("("):
            m = re.match(r"(?::(?:items)?\s*)?\((\d*)\.\.(\d*)\)", line)
            if m and where.endswith("[]"):
                rule = out.arrays.setdefault(where.removesuffix("[]"), {})
                rule["min"], rule["max"] = (int(m[1]) if m[1] else None), (int(m[2]) if m[2] else None)
            elif line.startswith(":unique"):
                out.arrays.setdefault(where.removesuffix("[]"), {})["unique"] = True
            else:
                m = re.match(r":(invariant|exactly_one|at_most_one|one_of|of)\s*(.*)$", line)
                if not m:
                    raise SchemaError(f"unknown rule {line!r}")
                out.rules.append((where, m[1], m[2]))
        elif "=" in line:
            key, _, value = (x.strip() for x in line.partition("="))
            if kind == "meta":
                out.metadata[key] = value.strip('"')
            elif kind == "type":
                out.types[where][key] = parse_field(value)
            else:
                out.fields[f"{where}.{key}" if where else key] = parse_field(value)
        else:
            raise SchemaError(f"unexpected {line!r}")
    return out


def serialize_schema(schema: Schema) -> str:
    """A text that parses to the same schema."""
    marks = {v: k for k, v in KINDS.items()}

    def one(f: Field) -> str:
        kinds = "|".join((f"@{f.type_ref or ''}" if k in ("type", "reference") else marks.get(k, "" if k == "string" else k)) for k in f.kinds)
        parts = ["!" * f.required + "*" * f.confidential + "-" * f.deprecated + "~" * f.nullable + kinds]
        if f.bounds:
            parts.append(f":({'' if f.bounds[0] is None else f.bounds[0]}..{'' if f.bounds[1] is None else f.bounds[1]})")
        if f.enum:
            parts.append(f":enum({', '.join(f.enum)})")
        if f.format:
            parts.append(f":format {f.format}")
        if f.pattern:
            parts.append(f':pattern "{f.pattern}"')
        if f.condition:
            parts.append(f":{'if' if f.condition[3] else 'unless'} {f.condition[0]} {f.condition[1]} {f.condition[2]}")
        return " ".join([*filter(None, parts), *(f":{x}" for x in f.flags)])

    lines = ["{$}", *(f'{k} = "{v}"' for k, v in schema.metadata.items())] if schema.metadata else []
    lines += [f'@import "{p}"' + (f" as {a}" if a else "") for p, a in schema.imports]
    for name, fields in schema.types.items():
        lines += [f"@{name}" + (" : " + " & ".join(f"@{p}" for p in schema.parents.get(name, [])) if schema.parents.get(name) else "")]
        lines += [f"{k} = {one(f)}" for k, f in fields.items()]
    groups: dict[str, list[str]] = {}
    for path, f in schema.fields.items():
        head, _, leaf = path.rpartition(".")
        groups.setdefault(head, []).append(f"{leaf} = {one(f)}")
    for path, rule in schema.arrays.items():
        own = groups.setdefault(f"{path}[]", [])
        if "min" in rule or "max" in rule:
            own.insert(0, f":({'' if rule.get('min') is None else rule['min']}..{'' if rule.get('max') is None else rule['max']})")
        if rule.get("unique"):
            own.insert(0, ":unique")
    for where, name, text in schema.rules:
        groups.setdefault(where, []).append(f":{name} {text}")
    for head, own in groups.items():
        lines += [f"{{{head}}}", *own]
    return "\n".join(lines) + "\n"


def expand(schema: Schema) -> Schema:
    """Types with their parents' fields, and sections with the fields of the types they refer to."""

    def fields_of(name: str, seen: tuple[str, ...] = ()) -> dict[str, Field]:
        if name in seen:
            raise SchemaError(f"circular type {name}", "V013")
        if name not in schema.types:
            raise SchemaError(f"unknown type {name}")
        out: dict[str, Field] = {}
        for parent in schema.parents.get(name, []):
            for key, f in fields_of(parent, (*seen, name)).items():
                if key in out and out[key].kinds != f.kinds:
                    raise SchemaError(f"parents of {name} disagree on {key}")
                out[key] = f
        for key, f in schema.types[name].items():
            if key in out and out[key].kinds != f.kinds and "override" not in f.flags:
                raise SchemaError(f"{name}.{key} overrides another type")
            out[key] = f
        return out

    fields = dict(schema.fields)
    for path, f in schema.fields.items():
        if "type" in f.kinds and f.type_ref in schema.types:
            for key, inner in fields_of(f.type_ref).items():
                fields.setdefault(f"{path}.{key}", replace(inner, flags=(*inner.flags, f"within:{path}")))
    return replace(schema, fields=fields, types={n: fields_of(n) for n in schema.types})


def resolve(path: str, load: Callable[[str], str]) -> Schema:
    """A schema with all that it imports, under their aliases; types that nothing refers to are left out."""
    loaded: dict[str, Schema] = {}

    def visit(name: str, chain: tuple[str, ...]) -> Schema:
        if name in chain:
            raise SchemaError(f"circular import {name}", "V013")
        if len(chain) >= MAX_DEPTH or len(loaded) >= MAX_IMPORTS:
            raise SchemaError("too many imports")
        if name not in loaded:
            loaded[name] = parse_schema(load(name))
        own = loaded[name]
        out = replace(own, types=dict(own.types), parents=dict(own.parents), imports=[])
        for other, alias in own.imports:
            inner = visit(other, (*chain, name))
            for key, fields in inner.types.items():
                out.types.setdefault(f"{alias}.{key}" if alias else key, fields)
                out.parents.setdefault(f"{alias}.{key}" if alias else key, [f"{alias}.{p}" if alias else p for p in inner.parents.get(key, [])])
        return out

    whole = visit(path, ())
    used, todo = set(), [f.type_ref for f in whole.fields.values() if f.type_ref] + [n for n in loaded[path].types]
    while todo:
        name = todo.pop()
        if name in whole.types and name not in used:
            used.add(name)
            todo += whole.parents.get(name, []) + [f.type_ref for f in whole.types[name].values() if f.type_ref]
    return replace(whole, types={n: f for n, f in whole.types.items() if n in used})
