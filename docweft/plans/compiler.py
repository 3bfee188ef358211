"""Specifications to DataFrames: every segment becomes a column, every mapping an expression that Catalyst sees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.functions.dates import stamp
from docweft.functions.logic import common, iso_date
from docweft.functions.values import Context, TransformError, fmt, half_up, num, to_boolean, truthy, verbs

from .expressions import Call, Lit, Mapping, Ref
from .spec import Segment, Transform, check_branches, parse_transform

ERROR = "struct<code:string,message:string,path:string>"


class LoopContext(Context):
    """Types inside a lambda: asked once of a frame with the array exploded, then replayed in the same order."""

    def __init__(self, outer: Context, frame: DataFrame):
        super().__init__(frame, outer.tables, outer.literals, outer.order, outer.sequence, outer.kept)
        self.types: list[T.DataType] = []
        self.replay = False
        self.at = 0

    def type(self, column: Column) -> T.DataType:
        if self.replay:
            self.at += 1
            return self.types[self.at - 1]
        self.types.append(super().type(column))
        return self.types[-1]


class Scope:
    """What references mean at one place: the current item, aliases, constants, outputs made so far."""

    def __init__(self, compiler: Compiler, ctx: Context, item: Callable[[str], Column | None] | None, aliases: dict[str, Column], index: Column | None = None):
        self.compiler, self.ctx, self.item, self.aliases, self.index = compiler, ctx, item, aliases, index
        self.depth = 0

    def walk(self, column: Column, path: str) -> Column:
        for step in path.replace("[", ".").replace("]", "").split("."):
            if step == "":
                continue
            t = self.ctx.type(column)
            if isinstance(t, T.StructType):
                column = column[step] if step in t.names else F.lit(None).cast("string")
            elif isinstance(t, T.MapType):
                column = F.try_element_at(column, F.lit(step))
            elif isinstance(t, T.ArrayType) and step.lstrip("-").isdigit():
                column = F.get(column, F.lit(int(step)))
            elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) and step in t.elementType.names:
                column = F.transform(column, lambda x, step=step: x[step])
            elif isinstance(t, T.VariantType):
                column = F.try_variant_get(column, f"$.{step}", "variant")
            else:
                return F.lit(None).cast("string")
        return column

    def ref(self, path: str) -> Column:
        if path.startswith("$const."):
            head, _, rest = path[7:].partition("[")
            if head not in self.compiler.spec.constants:
                raise TransformError("T005", f"no constant {head}")
            value = self.compiler.spec.constants[head]
            column = F.array(*map(F.lit, value)) if isinstance(value, list) else self.ctx.lit(value)
            return self.walk(column, rest) if rest else column
        if path.startswith(("$accumulator.", "$accumulators.")):
            return self.compiler.totals.get(path.partition(".")[2], F.lit(None).cast("double"))
        if path in ("$index", "_index") and self.index is not None:
            return self.index
        head, _, rest = path.lstrip(".").partition(".")
        stem = head.partition("[")[0]
        if not path.startswith(".") and stem in self.aliases:
            return self.walk(self.aliases[stem], path[len(stem) :])
        if self.item is not None and (path.startswith(".") or path == ""):
            return self.item(path)
        return self.compiler.column(self.ctx, path.lstrip("."), self)


class Compiler:
    """One specification over one DataFrame."""

    def __init__(self, spec: Transform, frame: DataFrame, custom: dict[str, Callable[..., Column]] | None = None):
        check_branches(spec.segments)
        self.spec, self.frame, self.custom = spec, frame, custom or {}
        self.totals: dict[str, Column] = {k: F.lit(v) for k, v in spec.accumulators.items()}
        self.outputs: dict[str, Column] = {}
        self.errors: list[Column] = []
        self.loop_values: Callable | None = None
        self.loops: dict[tuple, LoopContext] = {}
        self.placed = False  # pos and len place a field in the output instead of cutting the input

    def context(self) -> Context:
        return Context(self.frame, self.spec.tables)

    def column(self, ctx: Context, path: str, scope: Scope) -> Column:
        head = path.partition(".")[0].partition("[")[0]
        if head in self.outputs:
            return scope.walk(self.outputs[head], path[len(head) :])
        if head in self.frame.columns:
            return scope.walk(F.col(f"`{head}`"), path[len(head) :])
        return F.lit(None).cast("string")

    def expression(self, scope: Scope, e) -> Column:
        ctx = scope.ctx
        if isinstance(e, Lit):
            return ctx.lit(e.value) if e.value is not None else F.lit(None)
        if isinstance(e, Ref):
            column = scope.ref(e.path)
            return cast(ctx, column, e.cast) if e.cast else column
        if e.custom:
            if e.name not in self.custom:
                raise TransformError("T001", f"unknown custom verb {e.name}")
            return self.custom[e.name](ctx, *(self.expression(scope, a) for a in e.args))
        if e.name == "accumulate" and self.loop_values is not None and isinstance(e.args[0], Lit):
            return self.loop_values(scope, str(e.args[0].value), e.args[1])
        function = self.custom.get(e.name) or verbs.get(e.name)
        if function is None:
            raise TransformError("T001", f"unknown verb {e.name}")
        return function(ctx, *(self.expression(scope, a) for a in e.args))

    def mapping(self, scope: Scope, m: Mapping) -> Column:
        return directed(self, scope, self.expression(scope, m.expression), m)

    def object(self, scope: Scope, segment: Segment) -> Column:
        tree: dict = {}
        for m in segment.mappings:
            column = self.mapping(scope, m)
            if column is None:
                continue
            here, steps = tree, m.target.split(".")
            for step in steps[:-1]:
                here = here.setdefault(step, {})
            here[steps[-1]] = column
        for child in segment.children:
            tree[child.name] = self.segment(scope, child)
        if segment.literal:
            lines = [F.concat(*(F.lit(p) if k % 2 == 0 else F.coalesce(fmt(scope.ctx, scope.ref(p.strip().lstrip("@"))), F.lit("")) for k, p in enumerate(_placeholders(line)))) for line in segment.literal]
            tree["_literal"] = F.array(*lines)
        return _struct(tree)

    def segment(self, scope: Scope, segment: Segment) -> Column:
        if segment.loops or segment.source:
            loops = segment.loops or [(segment.source, None)]
            out = self.loop(scope, segment, loops)
        else:
            out = self.object(scope, segment)
            out = F.array(out) if segment.is_array else out
        return out

    def loop(self, scope: Scope, segment: Segment, loops: list[tuple[str, str | None]]) -> Column:
        """Objects for each element; further loops give every combination, the last one fastest."""
        (path, alias), rest = loops[0], loops[1:]
        source = scope.ref(path) if path.startswith(".") or path.split(".")[0] in scope.aliases else self.column(scope.ctx, path.lstrip("."), scope)
        if scope.item is not None and not path.startswith(".") and path.split(".")[0] not in scope.aliases:
            inner = scope.item("." + path)
            source = inner if not isinstance(scope.ctx.type(inner), T.StringType) else source
        t = scope.ctx.type(source)
        if not isinstance(t, T.ArrayType):
            if isinstance(t, (T.StringType, T.NullType)):
                return F.expr("CAST(NULL AS ARRAY<STRING>)")
            raise TransformError("T009", f"{path} is not an array")
        depth = scope.depth
        key = (id(segment), len(rest), depth)
        known = key in self.loops and isinstance(scope.ctx, LoopContext) and scope.ctx.replay
        if not known:
            self.loops[key] = LoopContext(scope.ctx, scope.ctx.frame.select("*", F.explode(source).alias(f"__item{depth}"), F.lit(0).alias(f"__index{depth}")))
        ctx = self.loops[key]

        def build(x: Column, i: Column) -> Column:
            inner = Scope(self, ctx, None, {**scope.aliases, **({alias: x} if alias else {}), **({segment.counter: i.cast("long")} if segment.counter else {})}, i.cast("long"))
            inner.item = lambda p: inner.walk(x, p)
            inner.depth = depth + 1
            ctx.sequence = i.cast("long")
            before, self.loop_values = self.loop_values, (lambda s, name, value: self._running(scope, source, ctx, inner, name, value, i))
            try:
                return self.loop(inner, segment, rest) if rest else self.object(inner, segment)
            finally:
                self.loop_values = before

        errors = list(self.errors)
        if not known:
            build(F.col(f"__item{depth}"), F.col(f"__index{depth}"))
        self.errors = errors  # errors inside loops stay with the items, as nulls
        ctx.replay = True

        def again(x, i):
            ctx.at = 0
            out = build(x, i)
            self.errors = errors
            return out

        out = F.transform(source, again)
        return F.flatten(out) if rest else out

    def _running(self, scope, source, ctx, inner, name, value, index) -> Column:
        """An accumulator inside a loop: its start plus the values of all items so far."""
        one = lambda y: num(ctx, self._of(inner, y, value))
        start = F.lit(float(self.spec.accumulators.get(name, 0) or 0))
        values = lambda: F.transform(source, one)
        x = values()
        self.totals[name] = F.aggregate(x, start, lambda a, v: a + v)
        return F.aggregate(F.slice(x, F.lit(1), (index + 1).cast("int")), start, lambda a, v: a + v)

    def _of(self, inner: Scope, y: Column, value) -> Column:
        other = Scope(self, inner.ctx, None, dict(inner.aliases), inner.index)
        other.item = lambda p: other.walk(y, p) if not isinstance(inner.ctx, LoopContext) or inner.ctx.replay else inner.item(p)
        return self.expression(other, value)

    def run(self, keep: list[Column] | None = None) -> DataFrame:
        """All segments as columns, and `errors`; a numbered pass sees the outputs of those before it."""
        names: list[str] = []
        for number in self.spec.passes:
            chosen: dict[str, Column] = {}
            taken: Column | None = None
            for segment in [s for s in self.spec.segments if s.number == number]:
                ctx = self.context()
                scope = Scope(self, ctx, None, {})
                column = self.segment(scope, segment)
                if segment.branch:
                    test = F.lit(True) if segment.condition is None else truthy(ctx, self.expression(scope, segment.condition))
                    if segment.branch == "if":
                        taken = None
                    column = F.when(test & ~taken if taken is not None else test, column)
                    taken = test if taken is None else taken | test
                name = segment.name or "root"
                chosen[name] = F.coalesce(chosen[name], column) if name in chosen else column
            for name, column in chosen.items():
                self.outputs[name] = column
                names.append(name)
        failed = F.filter(F.array(*self.errors), lambda e: e.isNotNull()) if self.errors else F.array().cast(f"array<{ERROR}>")
        return self.frame.select(*(keep or []), *(self.outputs[n].alias(n) for n in dict.fromkeys(names)), failed.alias("errors"))


def _placeholders(line: str) -> list[str]:
    import re

    return re.split(r"\$?\{(@[^}]*)\}", line)


def _struct(tree: dict) -> Column:
    return F.struct(*((_struct(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()))


def cast(ctx: Context, c: Column, kind: str) -> Column:
    """A value in the type that a directive or a typed reference names."""
    if kind == "integer":
        return F.floor(num(ctx, c)).cast("long")
    if kind in ("number", "percent"):
        return num(ctx, c)
    if kind == "currency":
        return half_up(num(ctx, c), 2)
    if kind == "boolean":
        return to_boolean(ctx, c)
    if kind == "date":
        return iso_date(ctx, c).cast("string")
    if kind == "timestamp":
        return F.date_format(stamp(ctx, c), "yyyy-MM-dd'T'HH:mm:ss")
    if kind == "string":
        return fmt(ctx, c)
    raise TransformError("T007", f"unknown type {kind}")


def directed(compiler: Compiler, scope: Scope, c: Column, m: Mapping) -> Column | None:
    """A mapping's value after its directives, in the order written; required, enum and range faults are reported."""
    from .expressions import parse_expression

    ctx = scope.ctx
    fault = lambda test, code, message: compiler.errors.append(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(m.target).alias("path"))))
    given = dict(m.directives)
    for name, argument in m.directives:
        if name == "type":
            c = cast(ctx, c, argument)
        elif name in ("integer", "number", "currency", "percent", "boolean", "date", "timestamp", "string"):
            c = cast(ctx, c, name)
        elif name == "default":
            c = F.coalesce(*common(ctx, c, ctx.lit(argument)))
        elif compiler.placed and name in ("pos", "len", "leftPad", "rightPad"):
            continue
        elif name == "pos":
            start, count = int(argument), int(given["len"]) if "len" in given else 1 << 20
            c = F.substring(fmt(ctx, c), start + 1, count)
        elif name == "field":
            c = F.try_element_at(F.split(fmt(ctx, c), given.get("delimiter", ","), -1), F.lit(int(argument) + 1))
        elif name in ("trim", "upper", "lower"):
            c = getattr(F, name)(fmt(ctx, c))
        elif name in ("leftPad", "rightPad"):
            width, _, sign = argument.partition(",")
            c = verbs["padLeft" if name == "leftPad" else "padRight"](ctx, fmt(ctx, c), ctx.lit(int(width)), ctx.lit(sign or " "))
        elif name == "truncate":
            c = F.substring(fmt(ctx, c), 1, int(argument))
        elif name == "decimals":
            c = half_up(num(ctx, c), int(argument))
        elif name in ("if", "unless"):
            test = truthy(ctx, compiler.expression(scope, parse_expression(argument)[0]))
            c = F.when(test if name == "if" else ~test, c)
        elif name == "required":
            fault(c.isNull(), "SOURCE_MISSING", f"{m.target} is required")
        elif name == "enum":
            fault(c.isNotNull() & ~fmt(ctx, c).isin(*argument.split("|")), "T013", f"{m.target} is not one of {argument}")
        elif name == "range":
            low, _, high = argument.partition("..")
            fault(c.isNotNull() & ~num(ctx, c).between(float(low or "-inf"), float(high or "inf")), "T013", f"{m.target} is out of {argument}")
        elif name == "validate":
            fault(c.isNotNull() & ~F.rlike(fmt(ctx, c), F.lit(argument)), "T013", f"{m.target} does not match")
        elif name == "confidential":
            c = masked(ctx, c, str(compiler.spec.option("enforceConfidential", "")))
    return c


def masked(ctx: Context, c: Column, mode: str) -> Column:
    """redact: null; mask: texts as asterisks, all else null; no mode: as it is."""
    if mode == "redact":
        return F.lit(None).cast(ctx.type(c))
    if mode == "mask":
        t = ctx.type(c)
        return F.repeat(F.lit("*"), F.length(c)) if isinstance(t, T.StringType) else F.lit(None).cast(t)
    return c


def transform(text: str | Transform, frame: DataFrame, custom: dict[str, Callable[..., Column]] | None = None) -> DataFrame:
    """Apply a transform to every row of a DataFrame: one output document per row."""
    spec = parse_transform(text) if isinstance(text, str) else text
    return Compiler(spec, frame, custom).run()


def select(frame: DataFrame, keep: list[str], mappings: dict[str, str], tables: dict | None = None, custom=None) -> DataFrame:
    """Columns `keep` and one column per verb expression."""
    from .expressions import parse_expression

    compiler = Compiler(Transform(tables=tables or {}), frame, custom)
    scope = Scope(compiler, compiler.context(), None, {})
    made = [compiler.expression(scope, parse_expression(e)[0]).alias(name) for name, e in mappings.items()]
    return frame.select(*keep, *made)


def multi_record(text: str | Transform, lines: DataFrame, custom=None) -> dict[str, DataFrame]:
    """One DataFrame per segment with a discriminator value, over the lines (column `value`) that carry it.

    The source's `discriminator` is `position:length` or a field number.
    """
    spec = parse_transform(text) if isinstance(text, str) else text
    where = str(spec.option("source.discriminator", "0:1"))
    if ":" in where:
        a, n = map(int, where.split(":"))
        kind = F.substring("value", a + 1, n)
    else:
        kind = F.try_element_at(F.split("value", str(spec.option("source.delimiter", ",")), -1), F.lit(int(where) + 1))
    out = {}
    for segment in spec.segments:
        rows = lines.filter(kind == segment.discriminator) if segment.discriminator else lines
        part = Transform(spec.metadata, spec.constants, spec.accumulators, spec.persistent, spec.tables, [], [segment])
        out[segment.name] = Compiler(part, rows.withColumn("_line", F.col("value")), custom).run()
    return out


__all__ = ["Call", "Compiler", "multi_record", "select", "transform"]
