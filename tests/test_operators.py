import datetime as dt
import random

from pyspark.sql import functions as F

from fieldbook.functions import dates, npt, numeric, text
from fieldbook.operators import audit, graph, ordered, quantiles, retrieval
from fieldbook.sources import sinks, tables
from fieldbook.streaming import ingest


def one(spark, expr, **vals):
    df = spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} string" for k in vals))
    return df.select(expr().alias("v")).first()["v"]


def test_narrative_classes(spark):
    cases = [
        ("Good returns throughout job. No losses.", "Run Csg & Cement", False, "productive"),
        ("Drill ahead 92 ft. Mud fluids seepage losses in six hours 9 bbls.", "Drilling", False, "productive"),
        ("Mud pump number one went down; bearing broke. Frontier Rig on NPT.", "Trips", True, "equipment"),
        ("Attempted multiple times to set packers. Ball did not seat and packers did not set.", "Other", True, "downhole_tools"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, op string, n boolean, c string")
    e = F.lit("")
    got = df.select("n", "c", npt.classify_narrative(F.col("t"), F.col("op"), e, e).alias("r")).collect()
    assert all(r.n == r.r.is_npt and r.c == r.r.category for r in got)
    for t, want in [("Mud pump number one went down", "Pump"), ("Hydraulic line failed on grabber box. Replace line.", "Hydraulic System"),
                    ("Equipment failure caused delay. Repair completed.", "Unspecified")]:
        assert one(spark, lambda: npt.equipment_subtype(F.col("t")), t=t) == want


def test_filenames(spark):
    names = [
        "RigAlpha DDR 7 FLDX R2 18.04.2024.pdf", "RigAlpha DDR 107FLDX R2 27.07.2024..pdf",
        "North_Site_SITE_16A_(78)-32_Drilling-C_01032021_01032021_15_1_reporttmp 2.pdf",
        "North_Site_SITE_16A_[78]-32_Drilling-C_11920201192020_11_reporttmp.pdf", "notes.txt",
    ]
    df = spark.createDataFrame([(n, 10) for n in names], "source_filename string, file_size_bytes bigint")
    r = {x.source_filename: x for x in audit.parse_filenames(df).collect()}
    a = r[names[0]]
    assert (a.ddr_number, a.wellbore, a.block_wellbore, a.safe_doc_id) == (7, "FLDX-R2", "00/00a-R2", "RigAlpha-DDR-007-FLDX-R2-2024-04-18")
    assert sorted(r[names[1]].warnings) == ["extra_dot_before_pdf_extension", "missing_space_after_ddr_number"]
    assert (r[names[2]].report_date, r[names[2]].ddr_number) == (dt.date(2021, 1, 3), 75)
    assert r[names[2]].warnings == ["filename_copy_marker", "filename_source_revision_marker"]
    assert (r[names[3]].report_date, r[names[3]].ddr_number) == (dt.date(2020, 11, 9), 20)
    assert r[names[4]].parse_error == "unsupported_file_extension"


def test_missing_report(spark):
    df = spark.createDataFrame([("RigAlpha DDR 1 FLDX RB 12.04.2024.pdf", 1), ("RigAlpha DDR 3 FLDX RB 14.04.2024.pdf", 1)],
                               "source_filename string, file_size_bytes bigint")
    m = audit.missing_reports(audit.parse_filenames(df), width=2).collect()
    assert [(x.expected_ddr_number, x.expected_report_date, x.inferred_filename) for x in m] == [
        (2, dt.date(2024, 4, 13), "RigAlpha DDR 2 FLDX RB 13.04.2024.pdf")]


def test_report_order_and_dates(spark):
    assert one(spark, lambda: dates.report_hour(F.col("t")), t="02:00") > one(spark, lambda: dates.report_hour(F.col("t")), t="23:00")
    assert one(spark, lambda: dates.report_date(F.col("t")), t="2020-12-01") == dt.date(2020, 12, 1)
    assert one(spark, lambda: dates.report_date(F.col("t")), t="01/12/2020") == dt.date(2020, 12, 1)
    assert one(spark, lambda: dates.period_end(F.col("t")), t="for the period ended 31 March 2023") == "2023-03-31"
    assert one(spark, lambda: dates.year_range(F.col("t")), t="Accounts 2022 to 2023") == "2022-2023"


def test_numbers(spark):
    assert one(spark, lambda: numeric.table_number(F.col("t"))["value"], t="(1,234)") == -1234
    assert one(spark, lambda: numeric.table_number(F.col("t"))["is_percent"], t="12.5%") is True
    assert one(spark, lambda: numeric.table_number(F.col("t"))["value"], t="n/a") is None
    assert one(spark, lambda: numeric.cell_number(F.col("t")), t="14.950") == 14950
    assert one(spark, lambda: numeric.canonical_figure(F.col("t")), t="£1.5 million") == "£1,500,000"


def test_vocabulary(spark):
    v = text.Vocabulary(stop_words=["with"], unit_tokens=["psi"], compounds=[("run in hole", "rih"), ("tight hole", "tight-hole")],
                        abbreviations={"sbp": "surface-back-pressure", "npt": None})
    assert one(spark, lambda: text.graph_tokens(F.col("t"), v), t="Run in hole with BHA; tight hole at 13354ft, SBP 500psi NPT") == [
        "rih", "bha", "tight-hole", "surface-back-pressure"]
    assert one(spark, lambda: text.graph_tokens(F.col("t"), v), t="") == []


def test_dehyphenate_pairwise(spark):
    got = one(spark, lambda: text.dehyphenate(F.split(F.col("t"), "\n")), t="develop-\nment of-\nwells\nEnd-\nUpper")
    assert got == ["development of-", "wells", "End-", "Upper"]


def test_ordered_scans_match_plain_loop(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else f"k{i % 7}", i // 13, i, rnd.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, b int, o int, v int").repartition(7)
    df = ordered.prefix_sum(df, ["k"], "b", ["o"], F.coalesce("v", F.lit(0)), "run")
    df = ordered.carry_last(df, ["k"], "b", ["o"], F.col("v"), "seen")
    df = ordered.lag_across(df, ["k"], "b", ["o"], F.col("o"), "prev")
    got = {r.o: r for r in df.collect()}
    run, seen, prev = {}, {}, {}
    for k, _, o, v in rows:
        run[k] = run.get(k, 0) + (v or 0)
        seen[k] = v if v is not None else seen.get(k)
        assert (got[o].run, got[o].seen, got[o].prev) == (run[k], seen[k], prev.get(k))
        prev[k] = o


def test_exact_quantiles(spark):
    rnd = random.Random(2)
    rows = [("a" if i % 3 else "b", rnd.choice([rnd.random() * 100, 5.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "x", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, cells=16).collect()}
    want = df.groupBy("k").agg(F.expr("percentile(x, array(0.1, 0.5, 0.99))").alias("p")).collect()
    for w in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip((got[w.k].p10, got[w.k].p50, got[w.k].p99), w.p))


def test_chunks_cover_every_word(spark):
    words = [f"w{i}" for i in range(1000)]
    df = spark.createDataFrame([(1, 1, " ".join(words)), (2, 1, "short"), (3, 1, " ")], "doc_id int, page int, clean_text string")
    ch = retrieval.word_chunks(df).filter("doc_id = 1").orderBy("chunk_no").collect()
    seen = []
    for c in ch:
        w = c.chunk_text.split(" ")
        seen += w if not seen else w[42:]
    assert seen == words
    assert retrieval.word_chunks(df).filter("doc_id > 1").count() == 1


def test_communities_on_two_cliques(spark):
    import itertools
    e = [("p", a, b, 5) for g in (["a", "b", "c", "d"], ["w", "x", "y", "z"]) for a, b in itertools.combinations(g, 2)] + [("p", "d", "w", 1)]
    df = spark.createDataFrame(e, "phase string, a string, b string, weight bigint")
    c = {r.term: r.community for r in graph.communities(df).collect()}
    assert len({c[t] for t in "abcd"}) == 1 and len({c[t] for t in "wxyz"}) == 1 and c["a"] != c["z"]


def test_ingest_replaces_late_report(spark, tmp_path):
    src, dst, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "doc_id string, v int"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).coalesce(1).write.parquet(src)
    st = spark.read.parquet(src).schema
    ingest.ingest(spark, src, st, dst, ck).awaitTermination(60)
    spark.createDataFrame([("a", 2)], schema).coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(spark, src, st, dst, ck).awaitTermination(60)
    got = ingest.current(tables.report_table(spark, dst)).select("doc_id", "v").collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("b", 1)]


def test_eval_items_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"query_id": "q1", "question": "x", "expected_pages": [1, 2]}]')
    (tmp_path / "b.json").write_text('{"queries": [{"query_id": "q2", "question": "y"}]}')
    got = tables.eval_items(spark, str(tmp_path)).select("query_id").collect()
    assert sorted(r[0] for r in got) == ["q1", "q2"]


def test_upsert(spark):
    a = spark.createDataFrame([("k1", 1), ("k2", 1)], "k string, v int")
    b = spark.createDataFrame([("k2", 2)], "k string, v int")
    assert sorted(map(tuple, sinks.upsert(a, b, "k").collect())) == [("k1", 1), ("k2", 2)]


def _events(spark, *texts):
    from fieldbook.operators import events

    df = spark.createDataFrame([(i, None, "INTRM1", t) for i, t in enumerate(texts)], "seq int, report_date date, phase string, operation_text string")
    out = {}
    for r in events.extract_events(df).collect():
        out.setdefault(r.seq, []).append((r.sub_type, r.depth_ft, r.force_klbs))
    return [out.get(i, []) for i in range(len(texts))]


def test_restrictions_in_order(spark):
    far = " while circulating at full rate and reciprocating the string over the whole stand length, then "
    got = _events(
        spark, "Tight spot at 7,000 ft and packoff at 7,500 ft", "Tight spot at 7,000 ft" + far + "tight spot at 7,010 ft",
        "Tight spot at 7,000 ft and packoff at 7,010 ft", "20klbs restriction at 5000ft, tight spot at 5,020 ft, restriction at 6000 ft 15-30 klbs",
        "tagged TOC at 900 ft with 15klbs", "packoff, depth 800 ft", "",
    )
    assert [[e[:2] for e in g] for g in got] == [
        [("restriction", 7000.0), ("restriction", 7500.0)], [("restriction", 7000.0)], [("restriction", 7000.0)],
        [("restriction", 5000.0), ("restriction", 6000.0)], [], [("packoff", 800.0)], []]
    assert got[3][0][2] == 20.0


def test_overpulls(spark):
    got = _events(
        spark, "Confirmed latched with 5klbs overpull at 900 ft", "30k overpull at 4,500 ft", "overpull of 40 klbs. Set slips. Bit at 6,000 ft",
        "At 3,000 ft saw 10-25klbs overpull, then 60 Klbs overpull",
    )
    assert got == [[], [("overpull", 4500.0, 30.0)], [("overpull", 6000.0, 40.0)], [("overpull", 3000.0, 25.0), ("overpull", 3000.0, 60.0)]]


def test_fit_lot_nearest_limit(spark):
    from fieldbook.operators import events

    rows = [(1, "2024-01-01", "A", "FIT to 12.5 ppge. Later performed LOT to 14.25 ppge until divergence at 9-7/8\" casing shoe"), (2, "2024-01-01", "A", "DFIT 12.5 ppge"), (3, "2024-01-02", "A", "FIT good, 9.9 ppge")]
    df = spark.createDataFrame(rows, "seq int, report_date string, phase string, operation_text string")
    got = sorted((r.seq, r.test_type, r.limit_ppge, r.result, r.casing_shoe) for r in events.fit_lot(df).collect())
    assert got == [(1, "FIT", 12.5, "initiation", '9-7/8" casing'), (1, "LOT", 14.25, "initiation", '9-7/8" casing')]
