"""Detectors on single texts, precision guards, resolution, rewriting and pseudonyms."""

import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from textguard.functions import entities, registry
from textguard.functions.detectors import STRUCTURED
from textguard.functions.patterns import ADDRESS, ADDRESS_KEYWORD
from textguard.functions.spans import matches
from textguard.operators import audit, pseudonym
from textguard.operators.resolve import resolve
from textguard.operators.rewrite import rewrite_runs, run_offsets
from textguard.plans.redact import detect, redact, redact_rows
from textguard.schema import ALLOWLIST, CATEGORIES, PRIORITY, SPAN, Settings


def spans(spark, text, detector):
    row = spark.createDataFrame([(text,)], "text string").select(detector(F.col("text")).alias("s")).first()
    for s in row["s"]:
        assert text[s["start"] : s["end"]] == s["text"]
    return [s["text"] for s in row["s"]]


@pytest.mark.parametrize(
    ("category", "text", "want"),
    [
        ("EMAIL", "write to jane.doe@example.com please", ["jane.doe@example.com"]),
        ("EMAIL", "é😀 a@x.com and b.c@in.mail.example.org", ["a@x.com", "b.c@in.mail.example.org"]),
        ("PHONE", "Tel: +91 98765 43210", ["+91 98765 43210"]),
        ("PHONE", "call 022-55501234 today", ["022-55501234"]),
        ("PHONE", "+91 22 55501234, +91 22 55501235 and +91 22 55501236", ["+91 22 55501234", "+91 22 55501235", "+91 22 55501236"]),
        ("PHONE", "x +1 (743) 555-3824 y", ["(743) 555-3824"]),
        ("PHONE", "+1 (743) 555-3824%%%", []),
        ("PHONE", "26,704,570 shares of 7,100.00 million", []),
        ("PHONE", "Pune 411 045", []),
        ("PHONE", "see page 269", []),
        ("PHONE", "DIN 00000000", []),
        ("PHONE", "₹9876543210 or Rs9876543210 or 9876543210 crore", []),
        ("SSN", "SSN 123-45-6789.", ["123-45-6789"]),
        ("CREDIT_CARD", "card 4111111111111111", ["4111111111111111"]),
        ("CREDIT_CARD", "card 4111111111111112", []),
        ("CREDIT_CARD", "4111 1111 1111 1111 ok", ["4111 1111 1111 1111"]),
        ("CREDIT_CARD", "CIN U12345MH2001PLC123456", []),
        ("IP", "10.20.30.40", ["10.20.30.40"]),
        ("IP", "999.1.1.1", []),
        ("DOB", "Date of birth: January 05, 1980", ["January 05, 1980"]),
        ("DOB", "founded on July 30, 1979", []),
        ("DOB", "born on 5 May 2020", []),
    ],
)
def test_structured(spark, category, text, want):
    assert spans(spark, text, STRUCTURED[category]) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("appointed Blue Lake Wealth Limited as lead", ["Blue Lake Wealth Limited"]),
        ("Alpha Bank Limited and Beta Bank Limited", ["Alpha Bank Limited", "Beta Bank Limited"]),
        ("by BSE Limited today", []),
        ("a Private Limited form", []),
        ("the Rao Family Trust", ["Rao Family Trust"]),
        ("₹[●] per Equity Share", []),
        ("Working Capital requirements", []),
    ],
)
def test_company(spark, text, want):
    assert spans(spark, text, lambda c: entities.company(c, ALLOWLIST)) == want


def test_address_of_long_texts(spark):
    """A text without an address is gone through once, not once more for each of its figures, and nothing else changes."""
    import time

    long = "A1 " * 200_000 + "Pune 411 045"
    spark.range(1).select(entities.address(F.lit("x"))).collect()
    began = time.perf_counter()
    assert spans(spark, long, entities.address) == ["Pune 411 045"]
    assert time.perf_counter() - began < 8
    odd = ["Plot x1 411 008", "Some Plot 1\n411 008 Pune 411 008", "In the Park x411 008, Pune 411008", "Big Test Road 12345 411 0089 Goa - 403 001", "Test Park, " + "x" * 200 + " 411 008"]
    rule = re.compile(ADDRESS.removeprefix("(?U)"))
    for text in odd:
        assert [t for t in spans(spark, text, entities.address) if re.search(ADDRESS_KEYWORD, t)] == rule.findall(text)


def test_address(spark):
    assert spans(spark, "B12, Sample Society, Test Road, Pune – 411 008, India", entities.address) == ["B12, Sample Society, Test Road, Pune – 411 008"]
    assert spans(spark, "plant at Plot 7, Test Road, Pune 411 008", entities.address) == ["Plot 7, Test Road, Pune 411 008"]
    assert spans(spark, "near Pune – 411 045 only", entities.address) == ["Pune – 411 045"]


def test_names_across_units_and_aliases(spark):
    units = spark.createDataFrame([("d", "body-0", 0, "Contact Person: Asha Mohan Rao"), ("d", "body-1", 1, "Email of Asha Rao here"), ("e", "body-0", 0, "Asha Rao")], "doc_id string, unit_id string, ordinal int, text string")
    kb = {tuple(r) for r in entities.knowledge_base(units).collect()}
    assert kb == {("d", "Asha Mohan Rao"), ("d", "Asha Rao")}
    found = detect(units, Settings().only(("NAME",))).select("doc_id", "unit_id", F.explode("spans").alias("s")).collect()
    assert sorted((r["doc_id"], r["unit_id"], r["s"]["text"]) for r in found) == [("d", "body-0", "Asha Mohan Rao"), ("d", "body-1", "Asha Rao")]


def test_table_mining(spark):
    rows = [("d", 0, 0, 0, 0, "Name"), ("d", 1, 0, 0, 1, "Designation"), ("d", 2, 0, 1, 0, "Kiran Desai*"), ("d", 3, 0, 1, 1, "Chief Officer"), ("d", 4, 0, 2, 0, "Total")]
    cells = spark.createDataFrame(rows, "doc_id string, ordinal int, table_id int, row int, col int, text string")
    assert [r["person"] for r in entities.mine_tables(cells).collect()] == ["Kiran Desai"]


def test_matches_equal_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    for r in docs.select("text", matches(F.col("text"), pattern).alias("m")).collect():
        assert [(m["start"], m["end"]) for m in r["m"]] == [m.span() for m in re.finditer(pattern, r["text"])]


def test_resolve_against_greedy(spark):
    import random

    rng, rows = random.Random(3), []
    for k in range(60):
        made = []
        for _ in range(rng.randint(0, 12)):
            start = rng.randint(0, 30)
            made.append((start, start + rng.randint(1, 9), "", rng.choice([*CATEGORIES, "OTHER"]), "", 1.0))
        rows.append((k, made))
    got = spark.createDataFrame(rows, f"k int, s array<{SPAN}>").select("k", resolve(F.col("s")).alias("r")).collect()
    for r in got:
        order = sorted(rows[r["k"]][1], key=lambda s: (-PRIORITY.get(s[3], 0), s[0] - s[1], s[0]))
        kept = []
        for s in order:
            if all(s[1] <= o[0] or o[1] <= s[0] for o in kept):
                kept.append(s)
        assert [(s["start"], s["end"], s["category"]) for s in r["r"]] == sorted((s[0], s[1], s[3]) for s in kept)


def test_digest_is_an_hmac_and_normalises(spark):
    rows = [("PHONE", "+91 22 55501234"), ("PHONE", "+912255501234"), ("EMAIL", "A@B.COM"), ("EMAIL", "a@b.com"), ("NAME", "Asha  Rao"), ("NAME", "Ravi Rao")]
    for salt in ("s", "long" * 40):
        got = [r["h"] for r in spark.createDataFrame(rows, "c string, v string").select(pseudonym.entity_id(F.col("c"), F.col("v"), salt).alias("h")).collect()]
        assert got[0] == hmac.new(salt.encode(), b"PHONE:912255501234", hashlib.sha256).hexdigest()[:16]
        assert got[0] == got[1] and got[2] == got[3] and got[4] != got[5] and all(re.fullmatch("[0-9a-f]{16}", h) for h in got)


def test_replacement_shapes(spark):
    rows = [("EMAIL", "x@y.org"), ("PHONE", "+91 98765 43210"), ("PHONE", "(743) 555-3824"), ("CREDIT_CARD", "4111 1111 1111 1111"), ("SSN", "123-45-6789"), ("IP", "1.2.3.4"), ("DOB", "1/2/1980"), ("NAME", "A B C"), ("COMPANY", "X Tools LLP"), ("COMPANY", "Rao Family Trust"), ("ADDRESS", "x 411 008"), ("ODD", "x")]
    shapes = [r"[a-z]+\.[a-z]+@example\.com", r"\+91 [7-9]\d{4} \d{5}", r"\([6-9]\d\d\) \d{3}-\d{4}", r"\d{4} \d{4} \d{4} \d{4}", r"\d{3}-\d{2}-\d{4}", r"(\d{1,3}\.){3}\d{1,3}", r"[A-Z][a-z]+ \d\d, \d{4}", r"\w+ \w+ \w+", r"\w+ LLP", r"\w+ Family Trust", r"\d+, [\w ]+ – \d{6}", r"\[REDACTED\]"]
    frame = spark.createDataFrame(rows, "c string, v string")
    got = [r["x"] for r in frame.select(pseudonym.replacement(F.col("c"), F.col("v"), pseudonym.entity_id(F.col("c"), F.col("v"), "s"), "2024-01-01").alias("x")).collect()]
    for x, shape, (_, v) in zip(got, shapes, rows, strict=True):
        assert re.fullmatch(shape, x) and x != v
    figures = [int(c) for c in got[3] if c.isdigit()][::-1]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(figures)) % 10 == 0


def test_run_rewrite_with_empty_runs(spark):
    texts = ["Email: ", "", "jane.doe@", "", "example.com", " end"]
    frame = spark.createDataFrame([(texts,)], "t array<string>").select(run_offsets(F.col("t")).alias("runs"))
    whole = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    rep = F.array(F.struct(F.lit(7).alias("start"), F.lit(27).alias("end"), F.lit("NEW").alias("replacement")))
    got = frame.select(rewrite_runs(whole, F.col("runs"), rep).alias("r")).first()["r"]
    assert [r["text"] for r in got] == ["Email: ", "", "NEW", "", "", " end"]


def test_redaction_is_stable_and_leaks_nothing(spark):
    texts = [("1", "body-0", 0, "mail a@x.com, phone +91 22 55501234"), ("2", "body-0", 0, "again A@X.com and +912255501234"), ("3", "body-0", 0, None), ("4", "body-0", 0, "  ")]
    units = spark.createDataFrame(texts, "doc_id string, unit_id string, ordinal int, text string")
    outs = []
    for parts in (1, 8):
        run = redact(units.repartition(parts), Settings().only(("EMAIL", "PHONE")))
        outs.append(sorted((r["doc_id"], r["redacted_text"]) for r in run.texts().collect() if r["redacted_text"]))
        assert run.leaks().count() == 0
        summary = {r["category"]: (r["redactions"], r["unique_entities"]) for r in run.summary().collect()}
        assert summary == {"EMAIL": (2, 1), "PHONE": (2, 1), None: (4, 2)}
    assert outs[0] == outs[1] and "@example.com" in outs[0][0][1] and "a@x.com" not in outs[0][0][1]


def test_rows_equal_own_layout(spark):
    units = spark.createDataFrame([("1", "body-0", 0, "host 10.0.0.1 and a@x.com")], "doc_id string, unit_id string, ordinal int, text string")
    policy = Settings().only(("EMAIL", "IP"))
    assert redact_rows(units, policy).first()["redacted_text"] == redact(units, policy, "own").texts().first()["redacted_text"]


def test_rows_with_one_id_or_none_keep_their_own_spans(spark):
    texts = [(None, "mail a.b@x.org now"), ("2", "zz yy manav@y.org and 10.20.30.40 here"), ("2", "and plain words here, 10.20.30.41"), (None, "mail a.b@x.org now"), (None, None), ("2", "A.B@x.org, call +91 22 55501234 or +912255501234")]
    units = spark.createDataFrame(texts, "doc_id string, text string").selectExpr("doc_id", "'body-0' AS unit_id", "0 AS ordinal", "text")
    policy = Settings().only(("EMAIL", "IP", "PHONE"))
    for layout in ("first_seen", "own"):
        run = redact(units, policy, layout)
        out = [r["redacted_text"] for r in run.texts().collect()]
        assert len(out) == len(texts) and out.count(None) == 1
        assert sum(bool(re.fullmatch(r"mail \S+@example\.com now", t or "")) for t in out) == 2
        assert sum(bool(re.fullmatch(r"zz yy \S+@example\.com and [\d.]+ here", t or "")) for t in out) == 1
        assert sum(bool(re.fullmatch(r"and plain words here, [\d.]+", t or "")) for t in out) == 1
        raw = ["a.b@x.org", "A.B@x.org", "manav@y.org", "10.20.30.40", "10.20.30.41", "55501234"]
        assert not any(v in (t or "") for v in raw for t in out) and run.leaks().count() == 0
        assert {r["category"]: r["redactions"] for r in run.summary().collect()} == {"EMAIL": 4, "IP": 2, "PHONE": 2, None: 8}
        assert run.spans.where("category = 'PHONE'").select("replacement").distinct().count() == 1
        run.close()


def test_leaks_are_seen_in_rows_without_an_id(spark):
    units = spark.createDataFrame([(None, "body-0", 0, "mail a@x.com twice"), (None, "body-0", 0, "host 10.0.0.1")], "doc_id string, unit_id string, ordinal int, text string")
    run = redact(units, Settings().only(("EMAIL", "IP")))
    assert audit.leaks(run.rows.withColumn("redacted_text", F.col("text"))).count() == 2 and run.leaks().count() == 0


def test_units_without_a_document_are_documents(spark):
    rows = [(None, "body-0", 0, "Contact Person: Asha Rao"), (None, "body-1", 1, "then Asha Rao"), (None, "body-2", 2, "Contact Person: Ravi Jain, and Ravi Jain")]
    units = spark.createDataFrame(rows, "doc_id string, unit_id string, ordinal int, text string")
    found = detect(units, Settings().only(("NAME",))).select("unit_id", F.explode("spans").alias("s")).collect()
    assert sorted((r["unit_id"], r["s"]["text"]) for r in found) == [("body-0", "Asha Rao"), ("body-2", "Ravi Jain"), ("body-2", "Ravi Jain")]


def test_registered_detectors(spark):
    registry.register("tickets", registry.python_detector(lambda t: [(m.start(), m.end(), "TICKET") for m in re.finditer(r"T-\d+", t)], "python.ticket", 0.8))
    try:
        units = spark.createDataFrame([("1", "body-0", 0, "see T-42 and a@x.com")], "doc_id string, unit_id string, ordinal int, text string")
        run = redact(units, Settings().only(("EMAIL",)))
        assert "[REDACTED]" in run.texts().first()["redacted_text"]
    finally:
        registry.unregister("tickets")
    assert registry.ner_detector(("NAME",), "no_such_model") is None
