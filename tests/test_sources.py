import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lorespark.operators.traces import step_totals
from lorespark.plans import build
from lorespark.plans.catalogue import Catalogue
from lorespark.sources import documents, ingestion, jsonl, tables
from lorespark.streaming import traces as stream


def test_typed_csv(spark, tmp_path):
    path = tmp_path / "pokemon.csv"
    path.write_text("﻿id,identifier,is_default,height\n1,a,1,\n2,,0,7\n", encoding="utf-8")
    rows = tables.read_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [(1, "a", 1, None), (2, None, 0, 7)]
    for name, body in (("arity", "id,identifier\n1,a\n2,b,c\n"), ("number", "id,identifier\nx,a\n")):
        bad = tmp_path / f"{name}.csv"
        bad.write_text(body)
        with pytest.raises(Exception, match="MALFORMED"):
            tables.read_csv(spark, str(bad)).collect()
    assert list(tables.read_csv_folder(spark, str(tmp_path))) == ["pokemon"]


def _workbook(path):
    cell = lambda ref, value, kind=None: f'<c r="{ref}"' + (f' t="{kind}"' if kind else "") + f"><v>{value}</v></c>"
    sheet = "".join([
        '<row r="1">', cell("A1", 0, "s"), cell("B1", 1, "s"), cell("C1", 1, "s"), "</row>",
        '<row r="2">', cell("A2", 2, "s"), cell("B2", "3.0"), cell("C2", "1.5"), "</row>", '<row r="3">', cell("A3", "", "str"), "</row>",
        '<row r="4">', cell("B4", 1, "b"), cell("C4", 2), "</row>", "<row r='9'></row>"])
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Nom</t></si><si><t>Âge</t></si><si><r><t>Re</t></r><r><t>nard</t></r></si></sst>")
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   '<sheets><sheet name="Fiche" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    _workbook(tmp_path / "w.xlsx")
    df = tables.sheet_table(tables.read_workbooks(spark, str(tmp_path / "w.xlsx")), "Fiche")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("source_row", "int"), ("nom", "string"), ("age", "int"), ("age_2", "double")]
    assert [tuple(r) for r in df.orderBy("source_row").collect()] == [(2, "Renard", 3, 1.5), (3, None, 1, 2.0)]


def test_build_links_and_view(spark):
    source = {
        "pokemon_species": spark.createDataFrame([(1, "a")], "id int, identifier string"),
        "pokemon": spark.createDataFrame([(10, 1, "a")], "id int, species_id int, identifier string"),
        "pokemon_forms": spark.createDataFrame([(100, 10, "a", None)], "id int, pokemon_id int, identifier string, form_identifier string"),
    }
    mapping = ("source_row int, pokeapi_species_id string, pokeapi_pokemon_id string, pokeapi_form_id string, pokeapi_pokemon_identifier string,"
               " pokeapi_form_identifier string, pokeapi_is_default string, pokeapi_mapping_status string")
    fr = spark.createDataFrame([(2, "1", " 10 ", "100", "a", "", "1", "ok", "Renard", 7), (3, "", None, None, None, None, None, None, "Seul", 8)],
                               mapping + ", nom string, numero int")
    en = spark.createDataFrame([(2, "1", " 10 ", "100", "a", "", "1", "ok", "Fox")], mapping + ", name string")
    cat = build.build_catalogue(source, fr, en, expected_species=1)
    rows = {r.source_row: r for r in cat["entry"].collect()}
    assert (rows[2].name_fr, rows[2].name_en, rows[2].entity_id, rows[2].signature_move_fr) == ("Renard", "Fox", 10, None)
    assert rows[3].name_en is None and rows[3].species_id is None
    with pytest.raises(ValueError, match="entity_id: 1"):
        build.build_catalogue(source, fr.withColumn("pokeapi_pokemon_id", F.lit("11")).filter("source_row = 2"), en)
    with pytest.raises(ValueError, match="mapping columns missing"):
        build.linked_sheet(fr.drop("pokeapi_form_id"))
    with pytest.raises(ValueError, match="mapping_by_language"):
        build.build_catalogue(source, fr, en.withColumn("pokeapi_mapping_status", F.lit("other")))


def test_pages_and_markdown(spark, tmp_path):
    page = {"title": "Bulbi", "page_id": 3, "revision_id": 4, "revision_timestamp": "t", "source_url": "u", "content": "== Habitat ==\n" + "Le Bulbi vit ici. " * 30}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0001_bulbi.json").write_text(json.dumps(page), encoding="utf-8")
    pages = documents.read_pages(spark, str(tmp_path / "in"))
    assert documents.new_pages(pages, pages.withColumn("title", F.upper("title"))).isEmpty()
    report = documents.markdown_pages(pages)
    assert report.first().status == "WARNING"
    documents.write_markdown(report, str(tmp_path / "out"))
    row = documents.read_markdown(spark, str(tmp_path / "out")).first()
    assert (row.source_file, row.national_number, row.slug, row.title) == ("0001_bulbi.md", 1, "bulbi", "Bulbi")
    assert row.text.startswith("# Bulbi\n\n> Source : Poképédia\n> Page ID : 3")


def test_questions_and_traces(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# x\n\n Qui ? \n")
    assert [r.question for r in documents.read_questions(spark, str(tmp_path / "q.txt")).collect()] == ["Qui ?"]
    attempt = {"step": "router", "attempt": 1, "duration_seconds": 2.0, "status": "SUCCESS", "timings": {"router": 2.0}}
    lines = [json.dumps({"trace_id": "a", "timings": {"router": 2.0}, "attempts": [attempt, {**attempt, "status": "ERROR"}]}), ""]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.jsonl").write_text("\n".join(lines))
    found = documents.read_traces(spark, str(tmp_path / "t"))
    totals = step_totals(documents.attempts_of(found), []).first()
    assert (totals.calls, totals.errors, totals.duration_seconds) == (2, 1, 4.0)
    target, mark = str(tmp_path / "log"), str(tmp_path / "mark")
    for _ in range(2):
        stream.start_attempt_log(spark, str(tmp_path / "t"), target, mark).awaitTermination(60)
    assert spark.read.parquet(target).count() == 2
    query = stream.step_total_stream(spark, str(tmp_path / "t")).writeStream.format("memory").queryName("steps").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("steps").first().calls == 2
    (tmp_path / "t" / "b.jsonl").write_text('{"model": "x"}\n')
    with pytest.raises(ValueError, match="model"):
        documents.read_traces(spark, str(tmp_path / "t"))


def test_vector_store(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [0.0, 1.0])], "chunk_id string, doc_id long, vector array<double>")
    assert documents.write_vectors(chunks, str(tmp_path / "v")) == 2
    documents.check_export(chunks, spark.read.parquet(str(tmp_path / "v")))
    with pytest.raises(ValueError):
        documents.write_vectors(chunks.withColumn("chunk_id", F.lit("a")), str(tmp_path / "w"))


def test_missing_role_is_an_error(spark):
    with pytest.raises(LookupError):
        Catalogue({})["species"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    texts = {f"f{n}.jsonl": [f"{n} {k} " + "x" * (k % 60) for k in range(200 * n)] for n in range(1, 4)}
    for name, lines in texts.items():
        (folder / name).write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    (folder / "empty.jsonl").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = jsonl.numbered_lines(spark, str(folder))
        assert rows.select("file").rdd.getNumPartitions() >= 1
        found = {(r["file"].rsplit("/", 1)[1], r["line_number"]): r["line"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {(name, k + 1): line for name, lines in texts.items() for k, line in enumerate(lines)}


def test_trace_formats_are_told_apart_by_line(spark, tmp_path):
    web = {"trace_id": "w", "outcome": "answered", "seconds": {"total": 1.5}, "tools": [{"name": "search", "arguments": {"a": 1}}]}
    good = [json.dumps(web), "", json.dumps({**web, "trace_id": "v"})]
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "a.jsonl").write_text("\n".join(good))
    found = jsonl.read_web_traces(spark, str(tmp_path / "web")).orderBy("trace_id").collect()
    assert [(r["trace_id"], r["seconds"]["total"], r["tools"][0]["name"]) for r in found] == [("v", 1.5, "search"), ("w", 1.5, "search")]
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "b.jsonl").write_text("\n".join([*good, json.dumps({"timings": {}}), "{", "3", '{"z": 1}']))
    kinds = {r["line_number"]: r["kind"] for r in jsonl.trace_lines(spark, str(tmp_path / "mixed")).collect()}
    assert kinds == {1: "web", 2: "blank", 3: "web", 4: "graph", 5: "malformed", 6: "not an object", 7: "foreign"}
    with pytest.raises(ValueError, match="b.jsonl line 1: web"):
        documents.read_traces(spark, str(tmp_path / "mixed"))


def test_catalogue_build_checks_types_nulls_and_keys(spark, tmp_path):
    fact = spark.createDataFrame([(1, 2, 3, 4, 5), (1, 2, 3, 4, None)], "pokemon_id int, version_group_id int, move_id int, pokemon_move_method_id int, level int")
    names = spark.createDataFrame([(1, "a"), (1, "b")], "id int, name string")
    folder = str(tmp_path / "cat")
    with pytest.raises(ValueError, match="pokemon_moves.level: int expected, string found"):
        tables.write_catalogue({"pokemon_moves": fact.withColumn("level", F.lit("7"))}, folder)
    with pytest.raises(ValueError, match="pokemon_moves.move_id: int expected, no column found"):
        tables.write_catalogue({"pokemon_moves": fact.drop("move_id")}, folder)
    with pytest.raises(ValueError, match="pokemon_moves.level: 1 of 2 rows without a value"):
        tables.write_catalogue({"pokemon_moves": fact}, folder)
    with pytest.raises(ValueError, match=r"names\(id\): 1 repeated keys"):
        tables.write_catalogue({"names": names}, folder, {"names": {"keys": [["id"]]}})
    assert tables.write_catalogue({"pokemon_moves": fact.filter("level IS NOT NULL"), "names": names}, folder) == {"pokemon_moves": 1, "names": 2}
    read = tables.read_catalogue(spark, folder, ["pokemon_moves", "names"])
    assert read["pokemon_moves"].first().level == 5 and read["names"].count() == 2


def test_ingestion_writes_only_what_changed(spark, tmp_path):
    schema = "title string, content string, revision_id long"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    folder = str(tmp_path / "pages")
    pages = [(f"Page {n}", f"texte {n}", 1) for n in range(40)]
    first = ingestion.ingest_pages(frame(pages + [("PAGE 3", "ancien", 0)]), folder, buckets=8)
    assert (first.new, first.changed, first.unchanged) == (40, 0, 0) and first.partitions <= 8
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "pages").rglob("*.parquet")}
    assert ingestion.ingest_pages(frame(pages), folder, buckets=8) == ingestion.Ingestion(0, 0, 40, 0)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "pages").rglob("*.parquet")} == before
    assert ingestion.ingest_pages(frame([("page 5", "texte neuf", 2)]), folder, buckets=8) == ingestion.Ingestion(0, 1, 0, 1)
    after = set((tmp_path / "pages").rglob("*.parquet"))
    assert len({p.parent for p in set(before) - after}) == 1
    texts = {r["title_key"]: r["content"] for r in spark.read.parquet(folder).collect()}
    assert len(texts) == 40 and "texte neuf" in texts.values() and "texte 5" not in texts.values() and "ancien" not in texts.values()
    assert ingestion.ingest_pages(frame([("autre", "x", 1), (None, None, None)]), folder, buckets=8).new >= 1
    empty = ingestion.ingest_pages(frame([]), str(tmp_path / "none"))
    assert empty == ingestion.Ingestion(0, 0, 0, 0)


def test_a_trace_costs_one_read_and_one_write_of_its_state():
    from pyspark.sql import Row
    from lorespark.streaming.attempts import AttemptNumbers

    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return value

    value, processor = Value(), AttemptNumbers("click", "view")
    processor.init(Handle())
    batches = [[(3, 9, "view"), (1, 5, "click"), (2, 5, "click"), (4, None, "click")], [(5, 1, "view"), (6, 1, "view"), (7, 2, "other")]]
    rows = [list(processor.handleInputRows((8,), iter([Row(event_id=i, ts=t, step=s) for i, t, s in batch]), None)) for batch in batches]
    assert value.calls == 4
    assert [(r.event_id, r.attempt, r.call_id, r.response_id) for r in rows[0]] == [(1, 1, None, None), (2, 2, None, None), (3, 1, 1, 3), (4, 3, None, None)]
    assert [(r.event_id, r.attempt, r.call_id, r.response_id) for r in rows[1]] == [(5, 2, 2, 5), (6, 3, 4, 6), (7, 1, None, None)]


def test_streamed_events_without_a_time_come_last(spark, tmp_path):
    from lorespark.plans import trace_queries

    spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP'2024-01-01', 1L, 'click', 1.0D, '{}'), (2L, NULL, 1L, 'click', 1.0D, '{}'), (3L, TIMESTAMP'2024-01-03', 1L, 'click', 1.0D, '{}')"
              " AS t(event_id, ts, user_id, event_type, value, props)").write.parquet(f"{tmp_path}/events.parquet")
    rows = trace_queries.QUERIES["streamed_attempt_numbers"](spark, str(tmp_path)).collect()
    assert sorted((r.event_id, r.attempt) for r in rows) == [(1, 1), (2, 3), (3, 2)]
