from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.operators import layout
from lexiquarry.sources import page_scan, store, tables
from lexiquarry.streaming import incremental


def test_csv_contract(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("﻿source_id,title\n a , Title \nb,\n", encoding="utf-8")
    schema = tables.strings("source_id", "title")
    assert [tuple(r) for r in tables.read_csv(spark, str(path), schema).collect()] == [("a", "Title"), ("b", "")]
    with pytest.raises(tables.ContractError, match="authority"):
        tables.read_csv(spark, str(path), tables.strings("source_id", "authority"))
    path.write_text("source_id,title\na,b,c\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        tables.read_csv(spark, str(path), schema).collect()


def test_csv_cells_with_line_ends(spark, tmp_path):
    df = spark.createDataFrame([("a", 'two\nlines, "quoted"'), ("b", "")], "id string, text string")
    tables.write_csv(df.coalesce(1), str(tmp_path / "out"), ["id", "text"])
    got = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path / "out")).fillna("").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", 'two\nlines, "quoted"'), ("b", "")]


def test_json_lines_keep_nulls_and_letters(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "a string, b int")
    tables.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":"é","b":null}'
    assert tables.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect() == df.collect()


def test_questions(spark, tmp_path):
    for k, extra in enumerate(({"forbidden_source_ids": ["x"]}, {})):
        (tmp_path / f"q{k}.json").write_text(json.dumps([{"id": f"q{k}", "question": "?", "should_answer": True, "expected_source_ids": ["s"], **extra}]))
    rows = tables.read_questions(spark, str(tmp_path / "q0.json"), str(tmp_path / "q1.json")).orderBy("id").collect()
    assert [(r.id, r.forbidden_source_ids, r.require_all_expected_sources) for r in rows] == [("q0", ["x"], False), ("q1", [], False)]


def test_layout(spark, tmp_path):
    line = {"text": "a", "page": 1, "box": [1.0, 2.0, 3.0, 4.0], "size": 9.0, "bold": True, "block": 0, "table": False, "warnings": []}
    (tmp_path / "l.jsonl").write_text(json.dumps({"height": 800.0, "width": 600.0, "raw_chars": 1, "tables": 0, "warnings": [], "lines": [line, line]}) + "\n")
    pages, lines = tables.read_layout(spark, str(tmp_path / "l.jsonl"), "S")
    assert pages.first().page == 1
    assert [(r.line_no, r.x0, r.y1) for r in lines.orderBy("line_no").collect()] == [(0, 1.0, 4.0), (1, 1.0, 4.0)]


def test_binary_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\x0ctwo")
    rows = tables.read_pages(spark, str(tmp_path), lambda raw: raw.decode().split("\x0c")).orderBy("page").collect()
    assert [(r.page, r.text) for r in rows] == [(1, "one"), (2, "two")] and len(rows[0].sha256) == 64


def test_html_lines(spark):
    html = "<head><title>x</title></head><p>A &amp; b</p><!-- c --><script>var t='</p>';</script><li>two <b>bold</b></li>"
    rows = tables.html_lines(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id").collect()
    assert [r.text for r in rows] == ["A & b", "two bold"]


@pytest.mark.parametrize(("relative", "want"), [("a/b.pdf", "/d/a/b.pdf"), ("a/../b", "/d/b"), ("./x", "/d/x"), ("..\\x", None), ("/x", None), ("C:/x", None), ("", None)])
def test_resolved(relative, want):
    if want:
        assert tables.resolved("/d/", relative) == want
    else:
        with pytest.raises(tables.ContractError):
            tables.resolved("/d", relative)


def test_env_pairs(spark):
    df = spark.createDataFrame([("# c",), ("A=1",), (' B = "x=y" ',), ("",), ("bad",), (None,), ("=x",), ("C=",)], "line string")
    assert {r.key: r.value for r in tables.env_pairs(df, "line").collect()} == {"A": "1", "B": "x=y", "C": ""}


def test_csv_header_with_commas(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text('"a, b",c\n1,2\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_csv(spark, str(path), tables.strings("a, b", "c")).collect()] == [("1", "2")]


def test_store_reuses_what_is_sound(spark, tmp_path):
    folder, built = f"file://{tmp_path}/t", []

    def build():
        built.append(1)
        return spark.range(5).toDF("id")

    for signature, force, reused in (("a", False, False), ("a", False, True), ("b", False, False), ("b", True, False), ("b", False, True)):
        table, was = store.reused(spark, folder, signature, build, force)
        assert was is reused and table.count() == 5
    (last,) = store.manifests(spark, folder).collect()
    data = tmp_path / "t" / last.files[0].name
    same_length = data.read_bytes()[:-1] + b"x"
    data.write_bytes(same_length)
    assert store.reused(spark, folder, "b", lambda: spark.range(0).toDF("id"), verify=True)[1] is False  # other bytes than the manifest tells
    assert store.reused(spark, folder, "b", build) [0].count() == 0  # an empty table is one too
    assert store.reused(spark, folder, "c", build)[1] is False
    for f in (tmp_path / "t" / "data" / "_all").iterdir():
        f.unlink()
    assert store.reused(spark, folder, "c", build)[1] is False  # files are gone
    newest = sorted((tmp_path / "t" / "manifests" / "_all").glob("*.json"))[-1]
    newest.write_text("{broken")
    assert store.reused(spark, folder, "c", build)[1] is False


def test_a_failed_write_leaves_what_was(spark, tmp_path):
    """Of a write of which one task fails, nothing is to be read; what its other tasks wrote is not named."""
    folder = f"file://{tmp_path}/t"
    store.commit(spark.range(4).toDF("id"), folder, "a")
    broken = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        store.commit(broken, folder, "b")
    assert [r.signature for r in store.manifests(spark, folder).collect()] == ["a"]
    assert sorted(r.id for r in store.read(spark, folder).collect()) == [0, 1, 2, 3]


def test_a_crash_before_the_manifest_leaves_what_was(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/t"
    rows = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    store.commit(rows, folder, "a", "k")
    system, root = store.opened(folder)
    writer = store.CommittedWriter({"path": folder, "key": "k", "signature": "b"})
    batch = store.pa.table({"k": [0, 0], "id": [7, 8]}).to_batches()[0]
    monkeypatch.setattr(store.TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 0})()))
    told = writer.write(iter([batch]))
    assert {r.signature for r in store.manifests(spark, folder).collect()} == {"a"} and store.read(spark, folder).count() == 10
    writer.abort([told])
    assert not [f for f in (tmp_path / "t").rglob("*.parquet") if writer.at in f.name]
    writer.commit([writer.write(iter([batch]))])
    assert sorted(tuple(r) for r in store.read(spark, folder).where("k = 0").collect()) == [(0, 7), (0, 8)]
    assert store.read(spark, folder, [1]).count() == 5


def test_only_changed_keys_are_written(spark, tmp_path):
    folder, asked = f"file://{tmp_path}/t", []

    def run(signatures, refused=(), **more):
        current = spark.createDataFrame(list(signatures.items()), "k string, signature string")

        def build(wanted):
            asked.append(sorted(r.k for r in wanted.collect()))
            rows = wanted.where(~F.col("k").isin("none")).select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("v"), F.concat("k", "signature").alias("t"))
            return rows.withColumn("error", F.when(F.col("k").isin(*refused, "-") & (F.col("v") == 2), "bad file"))

        return {r.k: (r.status, r.rows) for r in store.rebuilt(current, folder, "k", build, failed="error", **more).collect()}

    names = {"a": "1", "b/ä?": "1", "c": "1"}
    assert run(names) == dict.fromkeys(names, ("built", 2))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*") if f.is_file()}
    assert run(names) == dict.fromkeys(names, ("reused", 2)) and len(asked) == 1
    assert run(names | {"c": "2"}) == {"a": ("reused", 2), "b/ä?": ("reused", 2), "c": ("built", 2)}
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*") if f.is_file()}
    assert all(after[f] == x for f, x in before.items()) and all("kc" in str(f) for f in set(after) - set(before))
    assert asked[-1] == ["c"] and sorted(r.t for r in store.read(spark, folder, ["c"]).collect()) == ["c2", "c2"]
    # A key that fails keeps what it had and does not touch the others; one without rows has failed too.
    assert run(names | {"a": "9", "c": "3", "none": "1"}, refused=["a"]) == {"a": ("failed", 2), "b/ä?": ("reused", 2), "c": ("built", 2), "none": ("failed", None)}
    assert sorted(r.t for r in store.read(spark, folder, ["a"]).collect()) == ["a1", "a1"]
    assert run(names | {"a": "9", "c": "4"}, only=["a"]) == {"a": ("built", 2), "b/ä?": ("reused", 2), "c": ("stale", 2)}
    assert run(names | {"a": "9", "c": "3"}, only=["b/ä?"], force=True) == {"a": ("reused", 2), "b/ä?": ("built", 2), "c": ("reused", 2)}
    next((tmp_path / "t" / "data" / "kc").iterdir()).write_text("corrupt")
    for f in (tmp_path / "t" / "data" / "kc").iterdir():
        f.write_text("corrupt")
    assert run(names | {"a": "9", "c": "3"})["c"] == ("built", 2)


@pytest.mark.parametrize("kind", ["csv", "jsonl"])
def test_committed_text_files(spark, tmp_path, kind):
    folder = f"file://{tmp_path}/t"
    rows = [("é", 'two\nlines, "q"', 1), ("b", None, None)]
    store.commit(spark.createDataFrame(rows, "a string, b string, c long").coalesce(1), folder, "s", kind=kind)
    (own,) = store.manifests(spark, folder).collect()
    path = f"{folder}/{own.files[0].name}"
    back = spark.read.schema("a string, b string, c long")
    got = back.json(path) if kind == "jsonl" else back.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    assert sorted(map(tuple, got.collect())) == sorted(rows) and own.files[0].rows == 2


HTML = "<html><head><title>x</title></head><body><h1>Fees &amp; more</h1><p><b>Bold part</b> and plain text of a paragraph</p><table><tr><th>Crop</th><th>Rate</th></tr><tr><td>Rice</td><td>2 percent</td></tr></table></body></html>"


def page_files(tmp_path, **texts):
    (tmp_path / "in" / "sub").mkdir(parents=True, exist_ok=True)
    for name, text in texts.items():
        (tmp_path / "in" / "sub" / f"{name}.html").write_text(text)
    return f"file://{tmp_path}/in"


def test_page_scan(spark, tmp_path):
    folder = page_files(tmp_path, a=HTML, b="<p>" + "word " * 3000, c=" ")
    rows = {(r.path.rsplit("/", 1)[1], r.page): r for r in page_scan.scan(spark, folder, partition_bytes=100).collect()}
    a = rows["a.html", 1]
    assert [(s.text, s.size, s.bold, s.block) for s in a.spans][:3] == [("Fees & more", 20.0, True, 0), ("Bold part", 10.0, True, 1), ("and plain text of a paragraph", 10.0, False, 1)]
    assert a.spans[1].y0 == a.spans[2].y0 == 60.0 and a.spans[2].x0 > a.spans[1].x1 and (a.height, a.width) == (792.0, 612.0)
    assert a.tables[0].cells == [["Crop", "Rate"], ["Rice", "2 percent"]] and a.tables[0].columns == 2
    pages = sorted(p for n, p in rows if n == "b.html")
    assert pages == list(range(1, len(pages) + 1)) and len(pages) > 1
    assert sum(len(s.text.split()) for p in pages for s in rows["b.html", p].spans) == 3000
    assert all(s.x1 <= 576 and s.y1 <= 756 for r in rows.values() for s in r.spans or ())
    assert "empty file" in rows["c.html", 0].error and rows["c.html", 0].spans is None
    lines, cells = page_scan.lines_of(page_scan.scan(spark, folder))
    merged = layout.merged_spans(lines.where("source_id like '%a.html'"))
    grid = layout.grid_tables(merged, cells)
    assert "Crop | Rate\nRice | 2 percent" in [r.text for r in grid.collect()]


@pytest.mark.parametrize(("html", "want"), [("<h1>and&amp</h1>", "and&amp"), ("<p>a&lt b&#39 c&copyx &notit; &zz;</p>", "a&lt b&#39 c&copyx &notit; &zz;"), ("<p>a&amp;b &copy;&#39;&#x41; &amp;lt; x & y</p>", "a&b ©'A &lt; x & y")])
def test_references_that_were_cut_off_stay_as_they_are(html, want):
    """As in the other reader of pages, a reference has its semicolon."""
    from lexiquarry.sources import html_layout

    assert [s.text for p in html_layout.parse(html.encode()) for s in p.spans] == [want]


def test_page_scan_makes_only_what_is_asked_for(spark, tmp_path):
    folder = page_files(tmp_path, a=HTML, b=HTML)
    only = page_scan.scan(spark, folder, ("path", "sha256"), parser="no.such_module:parse")
    assert len({r.sha256 for r in only.collect()}) == 1 and only.count() == 2
    path = only.first().path
    assert [r.path for r in page_scan.scan(spark, folder, ("path", "page")).where(F.col("path") == path).collect()] == [path]
    assert [len(p.files) for p in page_scan.dealt([("a", 5), ("b", 5), ("c", 20), ("d", 1)], 10)] == [2, 1, 1]


def test_cached_scan_parses_only_new_content(spark, tmp_path):
    folder, cache = page_files(tmp_path, a=HTML, b="<p>one</p>", copy=HTML), f"file://{tmp_path}/cache"
    first, parsed = page_scan.cached(spark, folder, cache)
    assert parsed == 2  # copies are parsed once
    want = sorted(map(repr, first.collect()))
    again, parsed = page_scan.cached(spark, folder, cache)
    assert parsed == 0 and sorted(map(repr, again.collect())) == want == sorted(map(repr, page_scan.scan(spark, folder).collect()))
    page_files(tmp_path, b="<p>two</p>")
    changed, parsed = page_scan.cached(spark, folder, cache)
    assert parsed == 1 and {r.spans[0].text for r in changed.where("path like '%b.html'").collect()} == {"two"}
    assert page_scan.cached(spark, page_files(tmp_path / "none"), f"file://{tmp_path}/c2")[1] == 0


def test_paths_of_a_cached_scan_stay_in_tables(spark, tmp_path, monkeypatch):
    """The driver neither lists all files nor names those to parse; tasks find the ones that it would list."""
    folder, cache = page_files(tmp_path, a=HTML, b="<p>one</p>", _hidden="x"), f"file://{tmp_path}/cache"
    (tmp_path / "in" / "top.html").write_text("<p>two</p>")
    assert sorted(map(tuple, page_scan.found(spark, folder).collect())) == page_scan.listed(folder)
    monkeypatch.setattr(page_scan, "listed", lambda folder: pytest.fail("listed on the driver"))
    pages, parsed = page_scan.cached(spark, folder, cache)
    assert parsed == 3 and {r.path.rsplit("/", 1)[1] for r in pages.collect()} == {"a.html", "b.html", "top.html"}


def test_only_changed_rows_are_built(spark):
    known = spark.createDataFrame([("a", "1", 10), ("b", "1", 20), ("gone", "1", 30)], "k string, sig string, v int")
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "k string, sig string")
    got = incremental.refreshed(current, known, "k", "sig", lambda d: d.withColumn("v", F.lit(99)))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "1", 10), ("b", "2", 99), ("c", "1", 99)]


def test_a_failure_stays_alone(spark):
    good, bad = incremental.isolated(spark.createDataFrame([("a", None), ("b", "boom")], "k string, error string"), "k")
    assert [r.k for r in good.collect()] == ["a"]
    assert [tuple(r) for r in bad.collect()] == [("b", "ERROR", "boom")]


def test_landed_files_are_built_once(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType())])
    (tmp_path / "in").mkdir()
    for k, want in ((1, {2}), (2, {2, 4})):
        (tmp_path / "in" / f"f{k}.json").write_text(json.dumps({"id": k}) + "\n")
        incremental.landed(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.select((F.col("id") * 2).alias("id"))).awaitTermination()
        rows = [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        assert set(rows) == want and len(rows) == len(want)
