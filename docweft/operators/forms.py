"""Forms: the data part. A form is a table of elements; regions that overflow run on over pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.plans.notation import parse

INPUTS = ("text", "checkbox", "radio", "select", "date", "number", "signature", "multiline")
SHAPES = ("line", "rect", "circle", "ellipse", "path", "polygon", "label", "image", "barcode")


def parse_form(text: str) -> list[dict]:
    """Elements of a form text: page, element name, kind and their properties, in order."""
    found: dict[tuple[int, str], dict] = {}
    for path, value in parse(text).assignments.items():
        m = re.match(r"page\[(\d+)\]\.([^.]+(?:\.[^.]+)?)\.([\w-]+)$", path)
        if m:
            name = m[2].rpartition(".")
            kind = name[0] or m[2]
            element = found.setdefault((int(m[1]), m[2]), {"page": int(m[1]), "name": name[2], "kind": kind if kind in INPUTS + SHAPES else "field"})
            element[m[3]] = value.value
    return list(found.values())


def paginate(rows: DataFrame, group: list[str], order: list[str], per_page: int) -> DataFrame:
    """Page and place on it (both from 0) of each row of a region that holds `per_page` rows a page."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return rows.withColumn("__n", n).withColumn("page", F.floor(F.col("__n") / per_page)).withColumn("place", F.col("__n") % per_page).drop("__n")


def luminance(hex_color: Column) -> Column:
    """Relative luminance of a `#rrggbb` colour."""

    def part(at: int) -> Column:
        v = F.conv(F.substring(hex_color, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)


def meets_contrast(front: Column, back: Column, least: float = 4.5) -> Column:
    """Whether two colours have the contrast that readable text needs."""
    a, b = luminance(front), luminance(back)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05) >= least


def render(elements: list[dict], data: DataFrame) -> Column:
    """HTML of a form for each row: inputs bound to the columns that their names give, values escaped."""
    from docweft.sources.writers import _escape

    out = [F.lit('<form class="form">')]
    for e in elements:
        style = "".join(f"{k}:{e[v]}in;" for k, v in (("left", "x"), ("top", "y"), ("width", "w"), ("height", "h")) if v in e)
        column = e.get("bind", e["name"])
        column = str(column).lstrip("@.")
        value = _escape(F.coalesce(F.col(column).cast("string"), F.lit(""))) if column in data.columns else F.lit("")
        label = e.get("label", e["name"])
        if e["kind"] in INPUTS or e["kind"] == "field":
            out += [F.lit(f'<label style="{style}">{label}<input name="{e["name"]}" type="{e["kind"] if e["kind"] in ("checkbox", "radio", "date", "number") else "text"}" value="'), value, F.lit('"/></label>')]
        else:
            out.append(F.lit(f'<div class="{e["kind"]}" style="{style}">{e.get("text", "")}</div>'))
    return F.concat(*out, F.lit("</form>"))
