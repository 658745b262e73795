"""Sections of tables, their headers and generated answers, by hand."""

from __future__ import annotations

from fieldbook.operators import citations, wellsections

WORDS = {"casing": ["Casing strings"], "mud": ["Mud data"]}
COLUMNS = {"casing": {"size": ["size", "od"], "depth": ["depth"], "grade": ["^grade$"]}, "mud": {"weight": ["weight"], "kind": ["type"]}}
SCHEMA = "doc_id string, page int, table_no int, row_no int, cells array<string>"


def test_sections_and_headers(spark):
    table = [["report of the mud data and more of it"], None, ["CASING STRINGS", None], ["OD", "Set depth", "Grade"], ["9 5/8", "4,000", "L80"], ["", "x casing strings"], ["Size\n7", "x", "grade\n N80 \n\n Q"], ["Mud Data: today"], ["Weight"], ["Mud type", "Weight\n10"], ["Casing strings again"], ["a", "b"]]
    rows = spark.createDataFrame([("d", 1, 0, k, c) for k, c in enumerate(table)], SCHEMA)
    got = {r.section: (r.start_row, r.end_row) for r in wellsections.locate_sections(rows, WORDS, strict=True).collect()}
    assert got == {"casing": (2, 7), "mud": (7, 10)}
    loose = {r.section: (r.start_row, r.end_row) for r in wellsections.locate_sections(rows, WORDS).collect()}
    assert loose == {"casing": (2, 7), "mud": (0, 2)}
    located = wellsections.locate_sections(rows, WORDS, strict=True)
    heads = wellsections.section_headers(rows, located, COLUMNS)
    assert {r.section: (r.header_row, r.column_map) for r in heads.collect()} == {"casing": (3, {"size": 1, "depth": 2, "grade": 3}), "mud": (9, {"kind": 1, "weight": 2})}
    cells = {(r.row_no, r.column): r.value for r in wellsections.section_cells(rows, heads).collect()}
    assert cells[4, "grade"] == "L80" and cells[6, "size"] == "7" and cells[6, "grade"] == "N80 Q" and cells[5, "depth"] == "x casing strings" and cells[5, "grade"] == ""
    assert wellsections.section_headers(rows, located, COLUMNS, least=4).filter("header_row IS NOT NULL").count() == 0
    assert wellsections.locate_sections(rows.limit(0), WORDS).count() == 0


def test_answer_outcomes(spark):
    said = [
        (1, "Rose [chunk_id=doc:c1, page=1].", "ok", True), (2, "Rose without a citation", "ok", True), (3, None, None, False), (4, '{"answer": " 1,250 ", "citations": [{"chunk_id": "doc:c1", "page": "1"}, {"chunk": "doc:c1", "pages": [7]}]}', "OK", True),
        (5, "```json\n{\"answer\": \"x\", \"citations\": [\"(chunk_id: doc:c1, page: 1)\", 3]}\n```", "ok", True), (6, "Insufficient evidence in retrieved context.", "ok", True), (7, "text", "Timeout", True), (8, "", "ok", True), (9, '{"answer": "x"} chunk_id=doc:c1 page=1', "ok", True)]
    answers = spark.createDataFrame(said, "query_id int, raw_answer string, raw_status string, requested boolean")
    found = spark.createDataFrame([(q, r, c, p) for q in range(1, 10) for r, c, p in ((1, "doc:c1", [9]), (2, "doc:c1", [1]), (3, "doc:c2", [4]))], "query_id int, rank int, chunk_id string, pages array<int>")
    got = {r.query_id: (r.status, r.answer, r.citations, r.confidence, r.citations_parsed, r.citations_valid, r.citations_rejected, r.parse_mode) for r in citations.answer_outcomes(answers, found).collect()}
    assert got == {
        1: ("ok", said[0][1], "doc:c1#1", 1.0, 1, 1, 0, "text_fallback"), 2: ("insufficient_evidence", None, "", None, 0, 0, 0, "text_fallback"), 3: ("skipped", None, "", None, 0, 0, 0, "empty"),
        4: ("ok", "1,250", "doc:c1#1", 0.5, 2, 1, 1, "json"), 5: ("ok", "x", "doc:c1#1", 1.0, 1, 1, 0, "json"), 6: ("insufficient_evidence", None, "", None, 0, 0, 0, "text_fallback"),
        7: ("timeout", None, "", None, 0, 0, 0, "text_fallback"), 8: ("ok", None, "", None, 0, 0, 0, "empty"), 9: ("ok", said[8][1], "doc:c1#1", 1.0, 1, 1, 0, "text_fallback")}
