"""Sequences of edits folded over records."""

import datetime as dt

import pytest

from tallyline.operators.edits import apply_edit_log

T0 = dt.datetime(2026, 3, 1, 12, tzinfo=dt.timezone.utc)
PARSED = ("struct<item_text:string,part_number:string,quantity:double,unit:string,location_text:string,"
          "location_id:string,description:string>")
RECORD = (f"id string, device_id string, status string, language string, parsed {PARSED}, "
          "confidence struct<asr:double,quantity:double,location:double,item:double>, review_reasons array<string>, "
          "needs_review boolean")
EDIT = "id string, field string, value string, at timestamp, pos int, asr_confidence double"


def record(i, status="draft", lang="en"):
    return (i, "d1", status, lang, ("bolts", None, 4.0, None, "B-2", None, None), (0.9, 0.4, 0.9, 0.9),
            ["low quantity confidence"], True)


@pytest.fixture(scope="module")
def after(spark):
    at = [T0 + dt.timedelta(minutes=m) for m in range(9)]
    records = spark.createDataFrame([
        record("a"), record("b"), record("c", "synced"), record("d"), record("e"), record("f", lang=None)], RECORD)
    edits = spark.createDataFrame([
        # a: the second edit sees the first, whatever the order of the rows
        ("a", "quantity", "nine", at[2], 0, None), ("a", "quantity", "seven", at[1], 0, None),
        ("a", "description", " dusty ", at[3], 1, None), ("a", "description", "", at[3], 2, None),
        # b: an edit, then all fields are spoken again, then an edit of the result
        ("b", "unit", " Reels ", at[1], 0, None), ("b", "dictation", "three boxes of rj45 plug in bin A-14", at[2], 0, 0.8),
        ("b", "location", "bin c 7", at[3], 0, None),
        # c: synced records stay; d: what is not understood changes nothing
        ("c", "item", "nuts", at[1], 0, None), ("c", "item", "", at[2], 0, None),
        ("d", "location", " ", at[1], 0, None), ("d", "quantity", None, at[2], 0, None), ("d", "colour", "red", at[3], 0, None),
        # e: a dictation comes last
        ("e", "dictation", "a few nuts", at[1], 0, 0.9),
        ("gone", "item", "nuts", at[1], 0, None), ("gone", "dictation", "two boxes of nuts", at[2], 0, None),
        ("f", "item", "rj45 plug", at[1], 0, None),
    ], EDIT)
    locations = spark.createDataFrame([("LOC-1", "Bin A-14", ["A-14"])], "id string, name string, aliases array<string>")
    parts = spark.createDataFrame([("PN-1", "RJ45 plug", [])], "part_number string, name string, aliases array<string>")
    return {r.id: r for r in apply_edit_log(records, edits, locations, parts).collect()}


def log(r):
    return [(c["field"], c["from"], c["to"]) for c in r.corrections]


def test_a_second_edit_sees_the_first(after):
    r = after["a"]
    assert r.outcomes == ["applied"] * 4
    assert log(r) == [("quantity", "4", "7"), ("quantity", "7", "9"), ("description", "", "dusty"),
                      ("description", "dusty", "")]
    assert (r.parsed.quantity, r.parsed.description, r.parsed.item_text) == (9.0, None, "bolts")
    assert (r.confidence.quantity, r.confidence.location) == (0.95, 0.9)
    assert (r.review_reasons, r.needs_review) == ([], False)


def test_a_new_dictation_replaces_the_record(after):
    r = after["b"]
    assert r.outcomes == ["applied"] * 3
    assert log(r) == [("unit", "", "reels"), ("item", "bolts", "rj45 plug"), ("quantity", "4", "3"),
                      ("location", "B-2", "A-14"), ("location", "A-14", "C-7")]
    p = r.parsed
    assert (p.item_text, p.part_number, p.quantity, p.unit, p.location_text, p.location_id) == (
        "rj45 plug", "PN-1", 3.0, "boxes", "C-7", None)
    assert r.confidence.asr == 0.8 and r.confidence.location == 0.9
    assert r.review_reasons == []


def test_immutable_and_misunderstood_edits_change_nothing(after):
    c, d = after["c"], after["d"]
    assert c.outcomes == ["immutable", "not_understood"] and d.outcomes == ["not_understood"] * 3
    for r in (c, d):
        assert (log(r), r.parsed.item_text, r.confidence.quantity) == ([], "bolts", 0.4)
        assert (r.review_reasons, r.needs_review) == (["low quantity confidence"], True)


def test_reasons_of_a_last_dictation_are_those_of_a_capture(after):
    r = after["e"]
    assert r.outcomes == ["applied"] and r.needs_review
    assert r.review_reasons[0] == "no location spoken" and "item not in part vocabulary" in r.review_reasons


def test_unknown_records_and_languages(after):
    r = after["gone"]
    assert (r.outcomes, r.parsed, r.corrections, r.needs_review) == (["not_found"] * 2, None, None, None)
    assert after["f"].parsed.part_number == "PN-1"
