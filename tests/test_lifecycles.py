"""Evaluation, gold, DOCX, service, streaming, configuration, and queries against SQL."""

import json

import pytest
from pyspark.sql import functions as F

from textguard import cli, service
from textguard.operators import evaluate, gold
from textguard.plans import queries as core
from textguard.plans.redact import line_units
from textguard.schema import Settings, load_settings
from textguard.sources import docx, docx_writer
from textguard.sources import gold as gold_io
from textguard.streaming import redact as stream

SPANS = "unit_id string, ord long, start int, end int, category string"


def scores(spark, preds, golds, mode, **kw):
    frames = [spark.createDataFrame([(u, k, s, e, c) for k, (u, s, e, c) in enumerate(x)], SPANS) for x in (preds, golds)]
    return {r["category"]: r for r in evaluate.metrics(*frames, mode, **kw).collect()}


def test_strict_and_overlap(spark):
    p, g = [("u", 2, 8, "NAME")], [("u", 0, 10, "NAME")]
    assert scores(spark, p, g, "strict")["NAME"]["tp"] == 0
    assert scores(spark, p, g, "overlap")["NAME"]["tp"] == 1


def test_one_to_one_and_undefined(spark):
    got = scores(spark, [("u", 0, 5, "NAME")], [("u", 0, 5, "NAME"), ("u", 3, 11, "NAME")], "overlap")
    assert (got["NAME"]["tp"], got["NAME"]["fn"], got["MICRO"]["tp"]) == (1, 1, 1)
    assert got["SSN"]["precision"] is None and got["SSN"]["support"] == 0


def test_scope_restricts(spark):
    scope = spark.createDataFrame([("u",)], "unit_id string")
    got = scores(spark, [("u", 0, 5, "IP"), ("v", 0, 5, "IP")], [("u", 0, 5, "IP")], "strict", scope=scope)
    assert (got["IP"]["tp"], got["IP"]["fp"]) == (1, 0)


def test_units_of_several_documents_are_judged_apart(spark):
    keys = "doc_id string, unit_id string, ord long, start int, end int, category string"
    p = spark.createDataFrame([("a", "body-0", 0, 0, 5, "IP"), (None, "body-0", 0, 1, 4, "IP")], keys)
    g = spark.createDataFrame([("b", "body-0", 0, 0, 5, "IP"), (None, "body-0", 0, 1, 4, "IP")], keys)
    got = {r["category"]: r for r in evaluate.metrics(p, g, "strict").collect()}["IP"]
    assert (got["tp"], got["fp"], got["fn"]) == (1, 1, 1)
    lengths = spark.createDataFrame([("a", "body-0", 10), ("b", "body-0", 10), (None, "body-0", 10)], "doc_id string, unit_id string, n int")
    assert evaluate.character_accuracy(p, g, lengths).first()["correct"] == 20
    scope = spark.createDataFrame([("a", "body-0")], "doc_id string, unit_id string")
    assert evaluate.character_accuracy(p, g, lengths, scope).first()["total"] == 10


def test_character_accuracy_and_report(spark):
    p, g = ([("u", 0, 0, 4, "IP")], [("u", 0, 2, 99, "IP")])
    frames = [spark.createDataFrame(x, SPANS) for x in (p, g)]
    lengths = spark.createDataFrame([("u", 10), ("v", 0)], "unit_id string, n int")
    assert evaluate.character_accuracy(*frames, lengths).first()["accuracy"] == pytest.approx(0.2)
    text = evaluate.render(evaluate.metrics(*frames), "overlap", 0.2)
    assert "| IP | 1 | 0 | 0 | 1.000 | 1.000 | 1.000 | 1 |" in text and "(not present)" in text and "0.2000" in text


def test_gold_build_and_files(spark, tmp_path):
    notes = spark.createDataFrame([("u", 0, "NAME", "ab"), ("u", 1, "NAME", "ab"), ("u", 2, "NAME", "zz"), ("x", 0, "IP", "1")], "unit_id string, ordinal int, category string, substring string")
    found, problems = gold.build_gold(notes, spark.createDataFrame([("u", "ab-ab")], "unit_id string, text string"))
    assert sorted((r["start"], r["end"]) for r in found.collect()) == [(0, 2), (3, 5)]
    assert {(r["unit_id"], r["reason"]) for r in problems.collect()} == {("u", "substring is missing"), ("x", "unit is missing")}
    path = tmp_path / "gold.jsonl"
    path.write_text('# head\n\n{"unit_id": "u", "start": 0, "end": 2, "category": "NAME"}\n')
    assert [(r["unit_id"], r["end"]) for r in gold_io.read_gold(spark, str(path)).collect()] == [("u", 2)]
    gold_io.write_gold(found, str(tmp_path / "written"))
    assert gold_io.read_gold(spark, str(tmp_path / "written")).count() == 2
    gold_io.write_scope(found, str(tmp_path / "scope"))
    assert [r["unit_id"] for r in gold_io.read_scope(spark, str(tmp_path / "scope")).collect()] == ["u"]


def sample():
    merged = '<w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc>'
    nested = f"<w:tc>{docx_writer.paragraph('outer')}{docx_writer.table([['inner a@x.com']])}</w:tc>"
    grid = docx_writer.table([["Name", "Designation"], ["Kiran Desai", "Director"], [nested, merged]])
    return docx_writer.build(["Contact Person: Asha Rao", [("Email: ", "b"), "", ("jane@", "i"), "example.org end"], grid, "Kiran Desai spoke"], header="head b@x.com", footer="foot")


def test_docx_units():
    units = docx.parse(sample())
    assert [u["unit_id"] for u in units] == ["body-0", "body-1", "cell-2", "cell-3", "cell-4", "cell-5", "cell-6", "cell-7", "body-8", "hdr-0-9", "ftr-0-10"]
    assert units[1]["text"] == "Email: jane@example.org end" and units[7]["table_id"] is None and units[4]["row"] == 1


def test_changed_runs_keep_tabs_and_breaks():
    run = '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t><w:tab/><w:t>mail x@y.org</w:t><w:br w:type="page"/><w:t>end</w:t></w:r></w:p>'
    done = docx.patch(docx_writer.build([run]), {"body-0": ["a\tmail NEW\nmore\n\tend"]})
    body = docx.unzip(done)["word/document.xml"].decode()
    assert docx.parse(done)[0]["text"] == "a\tmail NEW\nmore\n\tend" and body.count("<w:tab") == 2 and body.count("<w:br") == 2
    assert 'w:type="page"' in body and body.index("<w:rPr>") < body.index("<w:tab") and "\t" not in body.split("<w:body>")[1]


def test_folders_with_equal_file_names(spark, tmp_path):
    for folder, mail in (("a", "x@one.org"), ("b", "y@two.org")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "same.docx").write_bytes(docx_writer.build([f"mail {mail} now", "host 10.0.0.1" if folder == "b" else "none"]))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    summary = service.redact_folder(spark, source, target, str(tmp_path / "log"), Settings())
    assert summary["by_category"] == {"EMAIL": 2, "IP": 1}
    texts = {f: docx.parse((tmp_path / "out" / f / "same.docx").read_bytes())[0]["text"] for f in "ab"}
    assert all("@example.com" in t for t in texts.values()) and not list((tmp_path / "out").rglob("*.part"))
    assert docx.relative_name("file:/x/in/a/b.docx", "file:///x/in/") == "a/b.docx" and docx.relative_name("s3://o/z/b.docx", "s3://o/y").endswith("-b.docx")
    gold_file = tmp_path / "gold.jsonl"
    gold_file.write_text('{"doc_id": "a/same.docx", "unit_id": "body-0", "start": 5, "end": 14, "category": "EMAIL"}\n')
    text = cli.report(spark, source, str(gold_file), Settings(), modes=("strict", "overlap"))
    assert text.count("| EMAIL | 1 | 1 | 0 |") == 2 and "| IP | 0 | 1 | 0 |" in text
    gold_file.write_text('{"unit_id": "body-0", "start": 5, "end": 14, "category": "EMAIL"}\n')
    with pytest.raises(ValueError):
        cli.report(spark, source, str(gold_file), Settings())


def test_scratch_is_deleted(spark):
    from pathlib import Path

    from textguard.sources.scratch import Scratch, scratch_dir, sweep

    with Scratch(spark, "trial") as work:
        frame = work.put(spark.sql("SELECT id, id % 2 = 0 AS even FROM range(10)"), "ids", ("even",))
        assert frame.where("even").count() == 5 and Path(work.path).exists()
    assert not Path(work.path).exists()
    kept = Scratch(spark, "trial")
    kept.put(spark.range(3), "ids")
    sweep(spark)
    assert not Path(scratch_dir(spark)).exists()


def test_service_round_trip(spark):
    out = service.redact_bytes(spark, sample(), ("EMAIL", "NAME"), settings=Settings())
    texts = {u["unit_id"]: u for u in docx.parse(out["redacted_bytes"])}
    assert out["redacted_bytes"][:2] == b"PK" and "jane@" not in texts["body-1"]["text"] and texts["body-1"]["runs"][0]["text"] == "Email: "
    assert "@example.com" in texts["hdr-0-9"]["text"] and "@example.com" in texts["cell-7"]["text"] and "Kiran" not in texts["body-8"]["text"]
    body = docx.unzip(out["redacted_bytes"])["word/document.xml"].decode()
    assert "<w:b" in body and "<w:i" in body
    log = [json.loads(x) for x in out["audit_bytes"].decode().splitlines()]
    assert len(log) == out["summary"]["total_redactions"] == 6 and "jane" not in out["audit_bytes"].decode() and set(out["summary"]["by_category"]) == {"EMAIL", "NAME"}


def test_category_selection(spark):
    out = service.redact_bytes(spark, docx_writer.build(["a@x.com 022-55501234"]), ("PHONE",), settings=Settings())
    assert "a@x.com" in docx.parse(out["redacted_bytes"])[0]["text"] and "EMAIL" not in out["summary"]["by_category"]


def test_settings(tmp_path, monkeypatch):
    path = tmp_path / "policy.yaml"
    path.write_text("categories: {EMAIL: true, IP: false}\npseudonymization: {salt: abc}\n")
    monkeypatch.delenv("PII_SALT", raising=False)
    assert load_settings(str(path)).categories == ("EMAIL",) and load_settings(str(path)).salt == "abc"
    monkeypatch.setenv("PII_SALT", "env")
    assert load_settings(str(path)).salt == "env"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT cast(id as string) AS doc_id, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int),0) AS ts, concat('u', id, '@x.org from 10.0.0.', id) AS text FROM range(20)")
    rows.write.parquet(str(tmp_path / "in"))
    policy = Settings().only(("EMAIL", "IP"))
    live = stream.redact_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), policy)
    query = live.select("doc_id", "redacted_text").writeStream.format("memory").queryName("redacted").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    want = {tuple(r) for r in stream.redact_stream(rows, policy).select("doc_id", "redacted_text").collect()}
    assert {tuple(r) for r in spark.table("redacted").collect()} == want
    counts = stream.audit_windows(stream.redact_stream(rows, policy)).groupBy("category").agg(F.sum("redactions")).collect()
    assert sorted(tuple(r) for r in counts) == [("EMAIL", 20), ("IP", 20)]


def test_documents_per_micro_batch(spark, tmp_path):
    rows = spark.createDataFrame([("d", "Contact Person: Asha Rao\nthen Asha Rao spoke")], "doc_id string, text string")
    units = line_units(rows)
    assert [r["unit_id"] for r in units.orderBy("ordinal").collect()] == ["body-0", "body-1"]
    units.write.parquet(str(tmp_path / "in"))
    seen = []
    query = stream.redact_batches(spark.readStream.schema(units.schema).parquet(str(tmp_path / "in")), Settings().only(("NAME",)), lambda run, n: seen.extend(run.texts().collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 2 and not any("Asha" in r["redacted_text"] for r in seen)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(core.ORACLES[name])
    frame = core.QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    plain = lambda row: tuple("" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)
    got = sorted(plain([r[c] for c in columns]) for r in frame.collect())
    assert got == sorted(plain(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def brute_page_spans(text):
    import re

    from textguard.functions import patterns as P
    from textguard.schema import PRIORITY

    figures = lambda v: "".join(c for c in v if c.isdigit())
    found = [(m.start(), m.end(), "EMAIL") for m in re.finditer(P.EMAIL, text)]
    for m in re.finditer(P.PHONE[4:], text):
        v, d = m[0], figures(m[0])
        before, after = text[max(m.start() - 2, 0) : m.start()].lower(), text[m.end() : m.end() + 12].lower()
        shaped = (len(d) == 10 and d[0] in "6789") or (d[:2] == "91" and len(d) in (11, 12)) or v.strip(" ")[0] == "+" or (re.search("[- ]", v) and len(d) in (10, 11))
        if 10 <= len(d) <= 13 and "₹" not in before and "rs" not in before and not re.match(P.PHONE_UNITS[4:], after) and shaped:
            found.append((m.start() + len(v) - len(v.lstrip(" -")), m.end() - len(v) + len(v.rstrip(" -")), "PHONE"))
    for m in re.finditer(P.CREDIT_CARD[4:], text):
        d = [int(c) for c in figures(m[0])][::-1]
        if 13 <= len(d) <= 16 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0:
            found.append((m.start(), m.start() + len(m[0].rstrip(" -")), "CREDIT_CARD"))
    found += [(m.start(), m.end(), "IP") for m in re.finditer(P.IP[4:], text) if all(int(o) <= 255 for o in m[0].split("."))]
    kept = []
    for s in sorted(found, key=lambda s: (-PRIORITY[s[2]], s[0] - s[1], s[0])):
        if all(s[1] <= o[0] or o[1] <= s[0] for o in kept):
            kept.append(s)
    return kept


def test_page_spans_equal_brute_force(spark, tmp_path):
    made = {1: "<p>call +91 98765 43210 or <b>022-55501234</b></p>", 2: '<td>4111 1111 1111 1111</td><a href="mailto:a@x.com">10.20.30.40</a>', 3: "<i>4111111111111112 and 999.1.1.1, ₹9876543210</i>", 4: None, 5: ""}
    spark.createDataFrame(list(made.items()), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    for folder, texts in ((str(tmp_path), made), ("/root/testdata/sf0.01", {r["page_id"]: r["html"] for r in pages.collect()})):
        got = core.QUERIES["page_spans"](spark, folder).collect()
        assert all(texts[int(r["doc_id"])][r["span_start"] : r["span_end"]] == r["value"] for r in got)
        want = sorted((str(k), *s) for k, t in texts.items() for s in brute_page_spans(t or ""))
        assert sorted((r["doc_id"], r["span_start"], r["span_end"], r["category"]) for r in got) == want
        assert {"PHONE", "CREDIT_CARD"} <= {s[3] for s in want}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
