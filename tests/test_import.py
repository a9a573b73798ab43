"""CSV rows to allocations, mass-casualty cases and rejects."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from allocspark.operators import imports, listing
from allocspark.sources import csv_import as C
from allocspark.streaming.ingest import ingest

HEAD = "Krankenhaus-Kurzname;Versorgungsbereich;Datum (Erstellungsdatum);Uhrzeit (Erstellungsdatum);Datum (Eintreffzeit);Uhrzeit (Eintreffzeit);Geschlecht;Alter;Transportmittel;PZC;PZC und Text;Fachgebiet;Fachbereich;Grund;Schockraum;Ansteckungsfähig;Freitext"
GOOD = 'Klinik West;Leitstelle Musterland (neu);19.08.2021;06:05;19.08.21;07:40:11;W;52;rtw;345213;345 Bauchschmerz;Chirurgie;Notaufnahme;Patient;H+;k.A.;"zwei\nZeilen; mit Zeichen"'
BAD = "Klinik West;Ort;31.02.2021;06:05;19.08.2021;07:40;;0;Schiff;12;;Chirurgie;;;vielleicht;Noro;"
MASS = ";Ort;19.08.2021;06:05;19.08.2021;07:40;;;;;;;;;;;"


def test_names_and_encodings():
    assert C.normalized_header(["﻿Straße", "Straße", "", "A (b)"]) == ["strasse", "strasse_2", "col_3", "a_b"]
    assert C.detected_encoding("ä".encode()) == "UTF-8" and C.detected_encoding(b"\xe4b") == "ISO-8859-1" and C.detected_encoding("ä".encode()[:1]) == "UTF-8"
    assert [C.outcome(*x) for x in ((0, 0), (100, 4), (100, 5), (100, 35))] == ["failed", "completed", "partial", "failed"]


def test_rows_and_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\n".join((HEAD, GOOD, ";" * 16, BAD)).encode("iso-8859-1"))
    rows = C.read_rows(spark, str(tmp_path / "a.csv"))
    assert rows.count() == 2 and "ansteckungsfaehig" in rows.columns
    assert {r[0] for r in rows.select(C.row_type(rows)).collect()} == {"ALLOCATION"}
    C.allocations(rows).write.parquet(str(tmp_path / "typed"))
    valid, rejects = C.validated(spark.read.parquet(str(tmp_path / "typed")))
    v = valid.first()
    assert (v.dispatch_area, v.gender, v.age, v.transport_type, v.urgency, v.code, v.indication, v.infection, v.requires_resus, v.is_cpr) == ("Musterland", "F", 52, "G", 3, 345, "Bauchschmerz", None, True, False)
    assert str(v.arrival_at) == "2021-08-19 07:40:00" and v.notes == "zwei\nZeilen; mit Zeichen" and v._line == 2
    r = rejects.first()
    assert {m.field for m in r.messages} == {"created_at", "age", "urgency", "code", "indication", "department", "assignment", "requires_resus"} and r._line == 5  # the line in the file: the row before has a line break in a cell
    assert C.reject_groups(rejects).where("field = 'age'").first().value == "0"
    assert C.rejects_markdown(C.reject_groups(rejects).where("field = 'age'")).first().line == "| age | 0 | must be between 1 and 99 | 1 |"
    C.write_rejects(rejects, str(tmp_path / "rejects"))
    assert spark.read.csv(str(tmp_path / "rejects"), header=True, escape='"').columns == ["file", "line", "messages", "row"]
    known = spark.createDataFrame([(1, "klinik  WEST")], "id int, name string")
    assert C.resolved(valid, known, "hospital", "hospital_id").first().hospital_id == 1
    good, lost = C.referenced(valid, {"hospital": (known, {}), "department": (known, {"notaufnahme": "nirgends"})})
    assert good.count() == 0 and [(m.field, m.value) for m in lost.first().messages] == [("department", "Notaufnahme")]


def test_files_of_other_headers_and_composed_letters(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿PZC;Alter\n123451;1 \n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Alter;Fachgebiet\n\t2;A\u0308rzte;zu viel\n3\n", encoding="utf-8")
    got = {(r._line, r.pzc, r.alter, r.fachgebiet) for r in C.read_rows(spark, str(tmp_path)).collect()}
    assert got == {(2, "123451", "1", None), (2, None, "2", "Ärzte"), (3, None, "3", None)}
    (tmp_path / "c.csv").write_text("")
    with pytest.raises(ValueError):
        C.read_rows(spark, str(tmp_path))


def test_wide_files_are_parsed_once_and_planned_quickly(spark, tmp_path):
    (tmp_path / "a.csv").write_text(";".join(f"c{i}" for i in range(10)) + "\n" + ";" * 9 + "\n" + "1" + ";" * 9 + "\n")
    plan = C.read_rows(spark, str(tmp_path / "a.csv"))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("from_csv(") == 1  # not again for each cell
    assert plan.constraints().size() < 50  # not one for every set of cells


def test_rules_of_cells(spark):
    def each(f, *texts):
        return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]

    assert each(C.gender, "m", "W", "F", "d", None) == ["M", "F", "X", "X", "X"]
    assert each(C.transport, "Boden", "ITW", "luft", "Bodenlos", None) == ["G", "G", "A", None, None]
    assert each(C.boolean, "S+", "R-", "Ja", "schwanger", "N", "vielleicht", None) == [True, False, True, True, False, None, None]
    assert each(C.number, "7", "7.9", "1e1", "alt", None) == [7, 7, 10, None, None]
    assert [str(x) for x in each(lambda c: C.moment(c, F.lit("08:09:10")), "01.02.69", "1.2.70", "01.02.2003", "30.02.2003", "2003-02-01")] == ["2069-02-01 08:09:00", "1970-02-01 08:09:00", "2003-02-01 08:09:00", "None", "None"]
    assert each(lambda c: C.assessment("airway", C.unlettered(c)), "A-frei", "krit.", "Tubus", "B-", None) == ["free", "critical", "Tubus", None, None]
    assert each(lambda c: C.assessment("disability", C.unlettered(c)), "D-GCS<15", "gcs  < 9", "wach", "GCS 3") == ["gcs_below_15", "gcs_below_9", "awake", "GCS 3"]
    assert each(lambda c: C.assessment("circulation", C.unlettered(c)), "C-laufende Rea", "stabil u. Med.") == ["cpr", "medication"]
    assert each(C.area_name, "Leitstelle Aachtal", "Kreis Bergen (alt)", "Cella - Kreis", " ") == ["Aachtal", "Bergen", "Cella", ""]
    for secret in (b"key", b"k" * 100):
        assert each(lambda c, s=secret: C.case_hash(c, s), "E-12 3", "none", None) == [hmac.new(secret, b"123", "sha256").digest(), None, None]
    assert each(lambda c: C.indication_key(F.lit(7), c), " A  b", None) == [hashlib.md5(b"007_a b").hexdigest(), hashlib.md5(b"007_").hexdigest()]


def test_export_cells(spark, tmp_path):
    rows = spark.createDataFrame([("=1", 0.5, None), ("a,b", 3.0, 7), ("", None, 1)], "t string, x double, n int")
    assert [r.line for r in listing.csv_cells(rows).collect()] == ["'=1,0.5,", '"a,b",3,7', ",,1"]
    listing.write_csv(rows, str(tmp_path / "out"))
    assert any(f.read_bytes().startswith("﻿t,x,n".encode()) for f in (tmp_path / "out").glob("part*"))


def test_stream_writes_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    untyped = "Klinik" + ";" * 17
    (tmp_path / "in" / "a.csv").write_text("\n".join((HEAD + ";MANV", GOOD.replace("\n", " ") + ";", BAD + ";", MASS + ";Zug", untyped)))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), C.normalized_header((HEAD + ";MANV").split(";")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "valid")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out" / "mass_casualties")).first().mci_title == "Zug"
    told = [m.reason for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).collect() for m in r.messages]
    assert told.count("has no known type") == 1 and "must not be blank" in told


def test_bound_export_has_every_column_of_the_rules(spark):
    assert {"manv", "enr", "airway", "grund"} <= set(C.normalized_header(list(imports.EXPORT)))
