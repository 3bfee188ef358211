"""Document operators, readers and writers, validation, streaming."""

import pytest
from pyspark.sql import functions as F

from docweft.operators import documents as docs
from docweft.operators import forms
from docweft.sources import read_source, write_target
from docweft.sources.readers import parse_yaml
from docweft.streaming import notation_events, read_lines, totals, transform_stream
from docweft.validation import parse_schema, serialize_schema, validate, validate_references
from docweft.validation.rules import safe_pattern
from docweft.validation.schema import SchemaError, expand, resolve


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, doc_seq int, pos int, path string, type string, value string")


def test_diff_then_patch_gives_the_new_document(spark):
    old = table(spark, [("d", 0, 0, "a", "string", "1"), ("d", 0, 1, "b", "string", "2"), ("d", 0, 2, "c", "string", "9"), ("d", 0, 3, "gone", "string", "7")])
    new = table(spark, [("d", 0, 0, "a", "string", "1"), ("d", 0, 1, "b", "string", "3"), ("d", 0, 2, "moved", "string", "9"), ("d", 0, 3, "new", "string", "8")])
    changes = docs.diff(old, new)
    assert sorted((r["op"], r["path"], r["source"]) for r in changes.collect()) == [("add", "new", None), ("change", "b", None), ("move", "moved", "c"), ("remove", "gone", None)]
    after, errors = docs.patch(old, changes)
    assert sorted((r["path"], r["value"]) for r in after.collect()) == sorted((r["path"], r["value"]) for r in new.collect())
    assert errors.count() == 0
    assert docs.patch(old.filter("path <> 'gone'"), changes)[1].collect()[0]["path"] == "gone"


def test_collapse(spark):
    rows = [("d", 0, 0, "a.b", "string", "1"), ("d", 0, 1, "a.c[0].x", "string", "2"), ("d", 0, 2, "ab", "string", "3"), ("d", 0, 3, "l[0]", "string", "4"), ("d", 1, 0, "a", "null", None), ("d", 1, 1, "l[]", "null", None), ("d", 2, 0, "a.b", "string", "5")]
    assert sorted((r["path"], r["value"]) for r in docs.collapse(table(spark, rows)).collect()) == [("a.b", "5"), ("ab", "3")]


def test_references(spark):
    rows = [("d", 0, 0, "a", "reference", "@b"), ("d", 0, 1, "b", "reference", "@c"), ("d", 0, 2, "c", "string", "x"), ("d", 0, 3, "p", "reference", "@q"), ("d", 0, 4, "q", "reference", "@p"), ("d", 0, 5, "z", "reference", "@none")]
    t = table(spark, rows)
    assert {r["path"]: (r["value"], r["error"]) for r in docs.resolve_references(t).collect()} == {"a": ("x", None), "b": ("x", None), "c": ("x", None), "p": (None, "V013"), "q": (None, "V013"), "z": (None, "V012")}
    assert validate_references(t).count() == 3


@pytest.mark.parametrize("name,options", [("json", {}), ("csv", {}), ("xml", {})])
def test_round_trips(spark, tmp_path, name, options):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, "x<y & z")], "id int, name string")
    path = str(tmp_path / name)
    write_target(df, name, path, **options)
    back = read_source(spark, name, path, **({"row_tag": "row"} if name == "xml" else {"multi_line": False} if name == "json" else {}))
    assert sorted((int(r["id"]), r["name"]) for r in back.select("id", "name").collect()) == [(1, 'a "q", b'), (2, "x<y & z")]


def test_text_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    for name, options in (("fixed-width", {"fields": [("id", 0, 3), ("name", 3, 4)], "width": 8}), ("flat", {}), ("odin", {})):
        write_target(df, name, str(tmp_path / name), **options)
    assert read_source(spark, "fixed-width", str(tmp_path / "fixed-width"), fields=[("id", 0, 3), ("name", 3, 4)]).collect()[0]["name"] == "a"
    assert {r["path"]: r["value"] for r in read_source(spark, "flat", str(tmp_path / "flat")).collect()} == {"id": "1", "name": "a"}
    assert {r["path"]: r["value"] for r in read_source(spark, "odin", str(tmp_path / "odin")).collect()} == {"id": "1", "name": "a"}
    (tmp_path / "y.yaml").write_text("a: 1\nb:\n  - x: yes\n    y: 'q'\n  - 2.5\nc:\n  d: ~\n")
    assert read_source(spark, "yaml", str(tmp_path / "y.yaml")).select(F.to_json("doc").alias("j")).first()["j"].replace(" ", "") == '{"a":1,"b":[{"x":true,"y":"q"},2.5],"c":{"d":null}}'
    assert parse_yaml("# nothing\n") is None


SCHEMA = '{$}\nid = "s"\n@Base\nid = !##\n@Address : @Base\nzip = :format zip\n{}\nname = ! :(2..5)\nage = ##:(0..120)\nhome = @Address\ntag = :enum(a, b)\n:exactly_one(x, y)\nx = ##\ny = ##\n{list[]}\n:(1..2)\n:unique\n'


def test_validation(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'ann', 5, named_struct('id', 1, 'zip', '12345'), 'a', 1, CAST(NULL AS INT), array(1, 2)), (2, 'a', 500, named_struct('id', CAST(NULL AS INT), 'zip', 'x'), 'z', 1, 2, array(1, 1, 1)) AS t(k, name, age, home, tag, x, y, list)")
    got = {r["k"]: (r["valid"], sorted((e["code"], e["path"]) for e in r["errors"])) for r in validate(df, SCHEMA, ["k"]).collect()}
    assert got[1] == (True, [])
    assert got[2] == (False, [("V001", "home.id"), ("V003", "age"), ("V003", "name"), ("V004", "home.zip"), ("V005", "tag"), ("V006", "list"), ("V007", "list"), ("V009", "")])
    assert validate(df, "{}\nname = !\n", ["k"], strict=True).first()["valid"] is False


def test_schema_texts():
    s = parse_schema(SCHEMA)
    again = parse_schema(serialize_schema(s))
    assert (again.fields, again.types, again.arrays, again.rules) == (s.fields, s.types, s.arrays, s.rules)
    assert expand(s).fields["home.zip"].format == "zip"
    with pytest.raises(SchemaError):
        expand(parse_schema("@A : @B\n@B : @A\nx = ##\n"))
    files = {"main": '@import "lib" as l\n{}\nhome = @l.T\n', "lib": "@T\nx = ##\n@Unused\ny = ##\n"}
    assert set(resolve("main", files.__getitem__).types) == {"l.T"}
    with pytest.raises(SchemaError):
        resolve("a", {"a": '@import "b"\n', "b": '@import "a"\n'}.__getitem__)
    assert safe_pattern("^a+$") and not safe_pattern("(a+)+") and not safe_pattern("a" * 2000) and not safe_pattern("(")


def test_forms(spark):
    elements = forms.parse_form('{page[0].text.name}\nx = #1\ny = #2\nlabel = "Name"\n')
    html = spark.sql("SELECT '<b>' AS name").select(forms.render(elements, spark.sql("SELECT 1 AS name")).alias("h")).first()["h"]
    assert 'value="&lt;b&gt;"' in html and "left:1.0in" in html
    assert spark.range(1).select(forms.meets_contrast(F.lit("#000000"), F.lit("#ffffff")).alias("x")).first()["x"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{sec}\nx = ##1\n; c\n---\n')
    lines = read_lines(spark, str(tmp_path / "in"))
    for name, frame in (("events_out", notation_events(lines)), ("shout", transform_stream('{$}\nodin = "1.0.0"\n{O}\nt = %upper @.value\n', lines))):
        q = frame.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r["event"] for r in spark.table("events_out").collect()] == ["header", "assignment", "comment", "document"]
    assert spark.table("shout").first()["O"]["t"] == "{SEC}"
    rates = spark.readStream.format("rate").load().withColumn("k", F.lit("a"))
    assert totals(rates, "timestamp", "k", "value").isStreaming


def test_transform_imports():
    from docweft.functions.values import TransformError
    from docweft.plans.render import with_imports

    files = {"lib": '{$const}\nvat = #0.2\nown = ##1\n{Extra}\nx = ##1\n', "loop": '@import "loop"\n'}
    spec = with_imports('@import "lib"\n{$const}\nown = ##2\n{Main}\ny = ##3\n', files.__getitem__)
    assert spec.constants == {"vat": 0.2, "own": 2} and [s.name for s in spec.segments] == ["Extra", "Main"]
    assert with_imports('@import "lib" as l\n{Main}\ny = ##3\n', files.__getitem__).constants["l.vat"] == 0.2
    with pytest.raises(TransformError):
        with_imports('@import "loop"\n', files.__getitem__)


def test_long_chains_of_references(spark):
    rows = [("d", k, f"p{k}", "reference", f"@p{k + 1}") for k in range(60)] + [("d", 60, "p60", "string", "end")]
    t = spark.createDataFrame(rows, "doc_id string, pos int, path string, type string, value string")
    assert {(r["value"], r["error"]) for r in docs.resolve_references(t).collect()} == {("end", None)}


def test_drop_first_with_equal_rows(spark):
    from docweft.operators import relational

    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "k int")
    assert sorted(str(r["k"]) for r in relational.drop_first(df, 4, [F.asc("k")]).collect()) == ["1", "2"]
