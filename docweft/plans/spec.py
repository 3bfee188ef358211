"""Transform texts to specifications."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from docweft.functions.values import TransformError

from .expressions import Mapping, parse_expression
from .notation import Section, parse_value, sections


@dataclass
class LookupTable:
    """Rows of an embedded table and its default."""

    columns: list[str]
    rows: list[list[object]]
    default: object = None


@dataclass
class Segment:
    """One output object, or array if it loops or its name ends with `[]`."""

    name: str
    is_array: bool = False
    loops: list[tuple[str, str | None]] = field(default_factory=list)
    counter: str | None = None
    source: str | None = None
    branch: str | None = None
    condition: object = None
    discriminator: str | None = None
    number: int = 1
    mappings: list[Mapping] = field(default_factory=list)
    children: list[Segment] = field(default_factory=list)
    literal: list[str] = field(default_factory=list)


@dataclass
class Transform:
    """A whole specification."""

    metadata: dict[str, object] = field(default_factory=dict)
    constants: dict[str, object] = field(default_factory=dict)
    accumulators: dict[str, object] = field(default_factory=dict)
    persistent: set[str] = field(default_factory=set)
    tables: dict[str, LookupTable] = field(default_factory=dict)
    imports: list[tuple[str, str | None]] = field(default_factory=list)
    segments: list[Segment] = field(default_factory=list)

    @property
    def passes(self) -> list[int]:
        return sorted({s.number for s in self.segments})

    def option(self, name: str, default=None):
        return self.metadata.get(name, default)


def parse_transform(text: str) -> Transform:
    """Read a transform. `{.name} = %verb ...` lines count as `name = %verb ...`."""
    text = re.sub(r"(?m)^\{\.([\w.\[\]]+)\}\s*=\s*", r"\1 = ", text)
    out = Transform()
    stack: dict[str, Segment] = {}
    for part in sections(text)[0]:
        for name, argument in part.directives:
            if name == "@" and argument.startswith("import"):
                words = argument.split()
                out.imports.append((words[1].strip('"'), words[3] if len(words) > 3 else None))
        if part.name.startswith("$table."):
            table = LookupTable(part.columns or [], [[parse_value(c, n).value if c else None for c in row] for row, n in part.rows])
            for key, value, n in part.lines:
                if key == "_default":
                    table.default = parse_value(value, n).value
            out.tables[part.name[7:]] = table
        elif part.name.startswith("$"):
            _metadata(out, part)
        elif part.name or part.lines:
            _segment(out, stack, part)
    return out


def _plain(text: str, line: int):
    v = parse_value(text, line)
    return v.value[0] if v.kind == "currency" else v.value


def _metadata(out: Transform, part: Section) -> None:
    block = part.name[1:]
    for key, text, line in part.lines:
        if block == "const":
            out.constants[key] = _plain(text, line)
        elif block == "accumulator":
            if key.endswith("._persist"):
                if _plain(text, line):
                    out.persistent.add(key.removesuffix("._persist"))
            else:
                out.accumulators[key] = _plain(text, line)
        else:
            out.metadata[f"{block}.{key}" if block else key] = _plain(text, line)
    for key in [k for k in out.constants if re.search(r"\[\d+\]$", k)]:  # indexed constants become arrays
        out.constants.setdefault(key.partition("[")[0], []).append(out.constants.pop(key))


def _loop(argument: str) -> tuple[str, str | None]:
    path, _, alias = argument.strip('"').partition(":as")
    return path.strip().lstrip("@"), alias.strip() or None


def _segment(out: Transform, stack: dict[str, Segment], part: Section) -> None:
    name = part.name.removesuffix("[]")
    segment = stack.get(name)
    directives = list(part.directives)
    new = segment is None or any(d[0] in ("if", "elif", "else") for d in directives)
    if new:
        segment = Segment(name, part.name.endswith("[]"))
        parent_name, _, leaf = name.rpartition(".")
        parent = stack.get(parent_name)
        if parent is not None:
            segment.name = leaf
            parent.children.append(segment)
        else:
            out.segments.append(segment)
        stack[name] = segment
    segment.literal += part.literal
    for key, text, line in part.lines:
        if key in ("_loop", "_from", "_counter", "_pass", "_if", "_elif", "_else", "_discriminator"):
            directives.append((key[1:], text.strip('"') if key not in ("_if", "_elif") else text))
        else:
            expression, rest = parse_expression(text)
            segment.mappings.append(Mapping(key, expression, rest))
    for key, argument in directives:
        if key == "loop":
            segment.loops.append(_loop(argument))
            segment.is_array = True
        elif key == "from":
            segment.source = argument.lstrip("@")
        elif key == "counter":
            segment.counter = argument
        elif key == "pass":
            segment.number = int(re.sub(r"\D", "", argument) or 1)
        elif key == "discriminator":
            segment.discriminator = argument
        elif key in ("if", "elif", "else"):
            segment.branch = key
            segment.condition = None if key == "else" else condition(argument)


def condition(text: str):
    """A segment's condition: a verb expression, a reference, or `@x = "y"`."""
    text = text.strip()
    m = re.match(r'^(@\S+)\s*(=|==|!=|<>|<=|>=|<|>)\s*(.+)$', text)
    if m and not text.startswith("%"):
        verb = {"=": "eq", "==": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}[m[2]]
        right = m[3] if re.match(r'["#@?~]|true$|false$', m[3]) else f'"{m[3]}"'
        return parse_expression(f"%{verb} {m[1]} {right}")[0]
    if text.startswith('"') and text.endswith('"'):
        return condition(text[1:-1])
    return parse_expression(text)[0]


def check_branches(segments: list[Segment]) -> None:
    """An elif or else must follow an if or elif."""
    last = None
    for s in segments:
        if s.branch in ("elif", "else") and last not in ("if", "elif"):
            raise TransformError("T012", f"{s.branch} of {s.name} follows no if")
        last = s.branch
        check_branches(s.children)
