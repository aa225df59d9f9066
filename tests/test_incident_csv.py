"""The incident log as CSV: names, tokens, quotes, broken lines."""

import pytest

from roadcast.operators import cleaning
from roadcast.sources import incident_csv as IC

HEADER = "Event ID,event_type,cause,corridor,priority,requires_road_closure,start_datetime,closed_datetime,end_datetime,resolved_datetime,note"
LINES = ['1,planned,vip,"MG Road, north",High,Yes,2024-01-01T10:00:00Z,2024-01-01 11:30:00,,NULL,"says ""go"""',
         "2,unplanned,debris,null,NULL,False,2024-01-06 20:00:00+00:00,,,,",
         "3,unplanned,debris,x,Low,true,not a time,,,,",
         "4,unplanned",
         "5,unplanned,debris,x,Low,true,2024-01-01 10:00:00,,,,note,one too many"]


@pytest.fixture
def path(tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *LINES]) + "\n")
    (tmp_path / "empty.csv").write_text(HEADER + "\n")
    return f"file://{tmp_path}"


def test_rows_are_named_and_null_tokens_are_null(spark, path):
    rows = {r.id: r for r in IC.read_incidents(spark, path).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"].corridor == "MG Road, north" and rows["1"].note == 'says "go"' and rows["1"].resolved_datetime is None
    assert rows["2"].corridor is None and rows["2"].priority is None and rows["2"].latitude is None


def test_cleaning_takes_the_texts(spark, path):
    rows = {r.id: r for r in cleaning.clean_incidents(IC.read_incidents(spark, path)).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].duration_minutes == 90.0 and rows["1"].requires_road_closure and rows["1"].hour_of_day == 15
    assert rows["2"].corridor == "Non-corridor" and rows["2"].zone == "Unknown" and rows["2"].duration_minutes is None


def test_broken_lines_are_rejected_whole(spark, path):
    assert sorted((r.id, r.line, r.fields) for r in IC.read_rejects(spark, path).collect()) == [("4", LINES[3], 2), ("5", LINES[4], 12)]


def test_another_header_is_an_error(spark, path, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER.replace("corridor,priority", "priority,corridor") + "\n" + LINES[1] + "\n")
    with pytest.raises(Exception):
        IC.read_incidents(spark, path).collect()
