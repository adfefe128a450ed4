import json

import pytest

from weftline.sources import notes, schemas


def test_notes_round_trip(spark, tmp_path):
    at = str(tmp_path / "notes")
    a = notes.write(at, "Where is it?", "useful", [("n2", "B  (b.ts)"), ("n1", "A"), ("n1", "A")], 1_700_000_000, "There.\nReally.")
    b = notes.write(at, "Why?", "corrected", [], 1_700_000_001, "No.", "Because.")
    (tmp_path / "notes" / "bad.md").write_text("no front matter")
    found, bad = notes.read(spark, at)
    rows = {r.id: r for r in found.collect()}
    assert bad == 1 and set(rows) == {a, b} and len(a) == 10
    assert [(n.id, n.label) for n in rows[a].nodes] == [("n1", "A"), ("n2", "B (b.ts)")]
    assert (rows[a].question, rows[a].answer, rows[a].correction) == ("Where is it?", "There.\nReally.", None)
    assert rows[b].correction == "Because." and rows[b]["at"].year == 2023
    assert {r.node for r in notes.signals(found).collect()} == {"n1", "n2"}
    for wrong in (("", "useful", None), ("q", "nice", None), ("q", "useful", "c"), ("q", "corrected", None)):
        with pytest.raises(ValueError):
            notes.write(at, wrong[0], wrong[1], [], 0, correction=wrong[2])


def test_saved_schema_and_drift(spark, tmp_path):
    column = lambda n, t, o=True: {"name": n, "sql_type": t, "nullable": o}
    make = lambda *tables: {"tables": [{"schema": "app", "name": n, "is_view": False, "columns": cs} for n, cs in tables]}
    (tmp_path / "want.json").write_text(json.dumps(make(("t", [column("a", "character varying(10)"), column("b", "int4"), column("c", "text")]))))
    (tmp_path / "have.json").write_text(json.dumps(make(("t", [column("a", "varchar (10)"), column("b", "bigint"), column("d", "text")]), ("databasechangelog", [column("id", "int")]))))
    (tmp_path / "bad.json").write_text("{")
    want, have = schemas.saved(spark, str(tmp_path / "want.json")), schemas.saved(spark, str(tmp_path / "have.json"))
    assert {(r.column, r.problem) for r in schemas.drift(want, have).collect()} == {("app.t.b", "different"), ("app.t.c", "missing"), ("app.t.d", "extra")}
    assert schemas.saved(spark, str(tmp_path / "bad.json")) is None and schemas.saved(spark, str(tmp_path / "none.json")) is None
