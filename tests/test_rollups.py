import json

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import scalars
from lorekeep.operators import builds, coverage, issues, runs, status, textscan
from lorekeep.operators.linecount import source_line_counts
from lorekeep.sinks.reports import coverage_documents, write_coverage
from lorekeep.sources import reports


def one(spark, col):
    return spark.range(1).select(col).first()[0]


@pytest.mark.parametrize("text, n", [
    ("32 failed, 6883 passed, 19 skipped", 6883), ("16159 passed, 8 skipped", 16159), ("no tests ran", 0),
    ("3 passed\n7 passed", 7), ("", 0)])
def test_passed_count(spark, text, n):
    assert one(spark, scalars.last_passed_count(F.lit(text))) == n


@pytest.mark.parametrize("text, n", [("268B", 268), ("4.62kB", 4620), ("61.7MB", 61_700_000), ("3.83GB", 3_830_000_000),
                                     ("0B", 0), ("big", None), ("", None)])
def test_printed_size(spark, text, n):
    assert one(spark, scalars.printed_size_bytes(F.lit(text))) == n


@pytest.mark.parametrize("doc, state, rows", [
    ('{"state":"completed","bioquery":{"payload":{"rows":["a","b"]}}}', "COMPLETED", 2),
    ('{"state":null,"bioquery":null}', "UNKNOWN", 0), ('{"state":"","bioquery":{"payload":{"rows":null}}}', "UNKNOWN", 0),
    ("{}", "UNKNOWN", 0), ('{"bioquery":{"payload":{"rows":[]}}}', "UNKNOWN", 0)])
def test_json_defaults(spark, doc, state, rows):
    got = spark.range(1).select(scalars.json_state(F.lit(doc)), scalars.json_row_count(F.lit(doc))).first()
    assert tuple(got) == (state, rows)


def test_coverage_reader_merge_and_report(spark, tmp_path, rows):
    def report(files, stmts, covered):
        return json.dumps({"meta": {}, "files": files, "totals": {
            "num_statements": stmts, "covered_lines": covered, "missing_lines": stmts - covered,
            "percent_covered": covered / stmts * 100 if stmts else 0}})

    (tmp_path / "svc.json").write_text(report({"a.py": {"n": 1}, "b.py": {"n": 2}}, 200, 150))
    (tmp_path / "plg.json").write_text(report({"b.py": {"n": 3}}, 100, 100))
    (tmp_path / "ninety.json").write_text(report({}, 10, 9))
    (tmp_path / "eighty.json").write_text(report({}, 10, 8))
    (tmp_path / "zero.json").write_text(report({}, 0, 0))
    (tmp_path / "bad.json").write_text("{ not json")
    (tmp_path / "test_counts.json").write_text('{"ninety": 7}')

    parts = reports.read_coverage(spark, str(tmp_path)).where("repo in ('svc', 'plg')")
    merged = coverage.merge_parts(parts.withColumn("repo", F.lit("both")))
    assert rows(merged) == [("both", 300, 250, 50, 83.33)]
    files = coverage.merge_files(reports.read_coverage_files(spark, str(tmp_path), ["svc.json", "plg.json"])
                                 .withColumn("repo", F.lit("both")))
    assert rows(files.select("file", "entry")) == [("a.py", '{"n":1}'), ("b.py", '{"n":3}')]

    docs = coverage_documents(merged, files, per_document=10)
    doc = json.loads(docs.first().value)
    assert doc["files"] == {"a.py": {"n": 1}, "b.py": {"n": 3}} and doc["totals"]["percent_covered_display"] == "83.33%"
    split = coverage_documents(merged, files, per_document=1).orderBy("part")
    assert {r.parts for r in split.collect()} == {2} and docs.first().parts == 1
    assert [json.loads(r.value)["totals"]["num_statements"] for r in split.collect()] == [300, 0]
    write_coverage(docs, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == doc

    listed = reports.read_coverage(spark, str(tmp_path), skip=["svc.json", "plg.json"]).unionByName(merged)
    table = coverage.coverage_report(listed, reports.read_test_counts(spark, str(tmp_path / "test_counts.json")))
    got = [(r.repo, r.tests, r.percent_covered, r.band) for r in coverage.weakest_first(table).collect()]
    assert got == [("bad", 0, 0.0, "unknown"), ("zero", 0, 0.0, "low"), ("eighty", 0, 80.0, "warn"),
                   ("both", 0, 83.33, "warn"), ("ninety", 7, 90.0, "ok")]
    total = coverage.coverage_total(table).first()
    assert (total.tests, total.num_statements, total.covered_lines) == (7, 320, 267)
    assert total.percent_covered == pytest.approx(267 / 320 * 100)
    assert {r.repo for r in coverage.coverage_gaps(table).collect()} == {"eighty", "both"}
    assert coverage.coverage_rollup(table).where("repo = 'TOTAL'").first().covered_lines == 267
    assert tuple(coverage.coverage_total(table.limit(0)).first()) == (0, 0, 0, 0, 0.0)
    sums = coverage.merge_counts(spark.createDataFrame([("r", 2), ("r", 3)], "repo string, tests long"))
    assert rows(sums) == [("r", 5)]


def test_status(spark, rows):
    repos = spark.createDataFrame([("clean", "main"), ("new", "master"), ("ahead", None), ("many", "dev"), ("data", "main")],
                                  "repo string, branch string")
    lines = spark.createDataFrame([("new", 1, "?? f"), ("many", 0, "")] + [("many", i, f" M f{i}") for i in range(1, 15)],
                                  "repo string, line_no int, line string")
    ahead = spark.createDataFrame([("ahead", 2)], "repo string, unpushed long")
    table = status.status_rollup(repos, lines, ahead)
    assert rows(table) == [("ahead", "unknown", 0, 0, 2, False, True), ("clean", "main", 0, 0, 0, True, False),
                           ("many", "dev", 14, 0, 0, False, True), ("new", "master", 0, 1, 0, False, False)]
    assert tuple(status.status_totals(table).first()) == (4, 1, 3, 2)
    details = status.dirty_details(table, lines)
    assert details.where("repo = 'many'").count() == 10 and details.agg(F.max("line_no")).first()[0] == 10
    assert rows(status.non_main_repos(table)) == [("many", "dev")]


def test_issues(spark, rows):
    df = spark.createDataFrame(
        [("r2", "t" * 80, "Low", ["x"], "n1"), ("r1", "t", "Critical", [], ""), ("r1", "u", "Odd", [], None), ("r1", "v", "Low", [], "DRY_NODE")],
        "repo string, title string, priority string, labels array<string>, node_id string")
    assert [tuple(r) for r in issues.counts_by_priority(df).collect()] == [("Critical", 1, 1), ("Low", 2, 4)]
    assert [tuple(r) for r in issues.counts_by_repo(df).collect()] == [("r1", 3), ("r2", 1)]
    assert tuple(issues.linked_total(df).first()) == (1, 4)
    assert issues.repos_touched(df).first()[0] == 2
    assert issues.with_priority_label(df).where("repo = 'r2'").first().labels == ["x", "Low"]
    assert len(df.select(issues.shown_title(F.col("title")).alias("t")).first().t) == 60
    have = spark.createDataFrame([("r1", "a"), ("r1", "a"), ("r2", "b")], "repo string, label string")
    assert rows(issues.missing_labels(df, ["a", "b"], have)) == [("r1", "b"), ("r2", "a")]


def test_topics(spark):
    df = spark.createDataFrame([("r", 2, 'say "hi"'), ("r", 1, "css"), ("r", 3, "css")], "repo string, pos int, topic string")
    got = issues.topic_payloads(df, per_payload=500).collect()
    assert [json.loads(r.payload) for r in got] == [{"names": ["css", 'say "hi"', "css"]}] and got[0].parts == 1
    many = spark.range(230).selectExpr("'r' as repo", "id as pos", "concat('t', id) as topic")
    assert [(r.part, r.parts) for r in issues.topic_payloads(many, 100).orderBy("part").collect()] == [(0, 3), (1, 3), (2, 3)]
    assert len(json.loads(issues.topic_payloads(many, 1000).first().payload)["names"]) == 230


def test_specs_and_outcomes(spark, rows):
    specs = builds.parse_specs(spark.createDataFrame([("a|x y|",), ("b||z",), ("c||",)], "spec string"))
    assert rows(specs) == [("a", "x y", None), ("b", None, "z"), ("c", None, None)]
    logs = spark.createDataFrame([("a", 1, "start"), ("a", 2, f"#9 {builds.SUCCESS_MARKER} done"), ("a", 3, "end"), ("b", 1, "error")],
                                 "tool string, line_no int, text string")
    assert rows(builds.build_outcomes(specs, logs).select("tool", "outcome")) == [("a", "success"), ("b", "failed"), ("c", "failed")]


LOG = """✅ reg/tes:new built successfully

── tes ──
new\t61.7MB\t2026-05-08 18:25:23 +0000 UTC
latest\t292MB\t2026-04-23 03:11:25 +0000 UTC

── lims ──
  new\t3.83GB\t2026-05-08 18:26:07 +0000 UTC

── reg/tes:new ──
0B\tCMD x
268B\tCOPY a
184kB\tCOPY b
"""


def test_build_log(spark, tmp_path, rows):
    (tmp_path / "build.txt").write_text(LOG)
    out = reports.parse_build_log(reports.read_build_log(spark, str(tmp_path)))
    sizes = out.where("kind = 'size'")
    assert rows(builds.compare_sizes(sizes).select("image", "new_bytes", "old_bytes")) == [
        ("lims", 3_830_000_000, None), ("tes", 61_700_000, 292_000_000)]
    layers = out.where("kind = 'layer'")
    assert rows(builds.first_layers(layers, 1).select("image", "size_txt", "command")) == [("reg/tes:new", "268B", "COPY a")]
    assert rows(out.where("kind = 'built'").select("image")) == [("reg/tes:new",)]


def test_build_log_in_splits(spark, tmp_path):
    text = [f"line {i}" if i % 90 else f"── s{i} ──" for i in range(1500)]
    (tmp_path / "a.log").write_text("\n".join(text) + "\n")
    (tmp_path / "b.log").write_text("x\ny\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        lines = reports.read_build_log(spark, str(tmp_path), rows_per_range=100).where("log = 'a.log'")
        assert [r.text for r in lines.orderBy("line_no").collect()] == text
        assert tuple(lines.agg(F.min("line_no"), F.max("line_no")).first()) == (1, 1500)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_first_match(spark, rows):
    df = spark.createDataFrame(
        [("p", 1, 1, "FROM x"), ("p", 1, 2, "# --platform=linux/amd64 --platform z"), ("p", 1, 3, "--platform linux/b"),
         ("p", 2, 1, "--platform readme"), ("q", 1, 1, "none"), ("q", 2, 4, "run --platform linux/arm64"), ("n", 1, 1, "x")],
        "plugin string, source_rank int, line_no int, text string")
    got = builds.first_match(df, scalars.platform_flag(F.col("text")), ["plugin"])
    assert rows(got.select("plugin", "value")) == [("p", "linux/amd64"), ("q", "linux/arm64")]
    assert one(spark, scalars.image_tag(F.lit('DOCKER_IMAGE =  "ghcr.io/x:1"  # "y"'))) == "ghcr.io/x:1"


def test_text_tree(spark, tmp_path, rows):
    for name, data in {
        "a/x.py": b"# ref ex.io\nref ex.io and ex.io\n", "a/node_modules/y.py": b"ex.io", "a/b.log": b"ex.io",
        "a/bin.dat": b"ex.io\0", "a/dotted.txt": b"exxio", "b/no newline.txt": b"\n\nex.io", "b/c%d.txt": b"none\n", "b/e+f.txt": b"x",
        "pkg/__init__.py": b"", "_lib/b.py": b"x", ".github/w.yml": b"y", ".env": b"z", ".git/config": b"ex.io",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    files = reports.read_text_tree(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"a/x.py", "a/dotted.txt", "b/no newline.txt", "b/c%d.txt", "b/e+f.txt",
                                                "pkg/__init__.py", "_lib/b.py", ".github/w.yml", ".env"}
    hits = textscan.find_literal(files, "ex.io", "new.io")
    assert rows(hits) == [
        ("a/x.py", 1, "# ref ex.io", "# ref new.io"), ("a/x.py", 2, "ref ex.io and ex.io", "ref new.io and new.io"),
        ("b/no newline.txt", 3, "ex.io", "new.io")]
    assert tuple(textscan.scan_totals(files, "ex.io").first()) == (3, 2)
    assert tuple(textscan.scan_totals(files, "absent").first()) == (0, 0)
    replaced = textscan.replace_in_files(files, "ex.io", "new.io").where("path like 'a%'").first().text
    assert replaced == "# ref new.io\nref new.io and new.io\n"
    by_repo = files.withColumn("repo", F.element_at(F.split("path", "/"), 1))
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo string")
    assert rows(textscan.sweep(by_repo, repos, "ex.io")) == [("a", 2, 1, "hit"), ("b", 1, 1, "hit"), ("c", 0, 0, "skip")]
    assert rows(textscan.sweep(by_repo, repos, "new"))[0] == ("a", 0, 0, "ok")


def test_line_counts(spark, rows):
    files = spark.createDataFrame(
        [("a.py", "# c\n\n  # d\nx = 1\n\t\n"), ("b/Dockerfile.x", "FROM y\n"), ("c.js", "// z\ncode"), ("d.css", "/* x */\n"), ("e.unknown", "x"),
         ("f.min.js", "x")], "path string, text string")
    kept = files.where(textscan.lacks_extension(F.col("path"), textscan.COUNT_EXCLUDED_EXTENSIONS)).withColumn(
        "language", textscan.language_of(F.col("path"))).where("language is not null")
    assert rows(textscan.line_counts(kept)) == [
        ("CSS", 1, 0, 0, 1), ("Dockerfile", 1, 0, 0, 1), ("JavaScript", 1, 0, 1, 1), ("Python", 1, 2, 2, 1), ("TOTAL", 4, 2, 3, 4)]


@pytest.mark.parametrize("language, text, want", [
    ("JavaScript", "/* a\n\n b */\ncode // x\n// y", (1, 3, 1)),
    ("JavaScript", 'let s = "/*"\nlet t = \'//\'\nlet u = `/*\n*/`', (0, 0, 4)),
    ("JavaScript", "f() // don't /* no\ng()", (0, 0, 2)),
    ("JavaScript", "a /* b\nc */ d\n/* e */", (0, 1, 2)),
    ("TypeScript", "/* never closed\nx\n", (0, 2, 0)),
    ("JavaScript", 'let s = "open\n/* c */\nlet t = "a\\"/*"', (0, 1, 2)),
    ("CSS", "/* x */\n// no comment\na{}", (0, 1, 2)),
    ("SCSS", "// yes\n/* x\ny */ a{}", (0, 2, 1)),
    ("HTML", "<p>it's</p>\n<!-- a\nb -->\n<b>//</b>", (0, 2, 2)),
    ("Python", '"""Doc\n\nmore."""\nx = 1  # c\n# d\ny = """not\n# a comment"""', (1, 3, 3)),
    ("Python", "s = '# \"\"\"'\nt = 2", (0, 0, 2)),
    ("Python", "def f():\n    r\'\'\'doc\'\'\'\n    return 1", (0, 1, 2)),
    ("Groovy", "def s = \'\'\'/*\n*/\'\'\'\n/* x */", (0, 1, 2)),
    ("YAML", "# c\na: it's # d\n\n", (1, 1, 1)),
    ("Unknown", "# c\n\n", (1, 0, 1)),
    ("Python", "", (0, 0, 0)),
    ("Python", None, (0, 0, 0)),
    (None, "x", (0, 0, 1)),
])
def test_source_line_counts(spark, rows, language, text, want):
    df = spark.createDataFrame([(language, text)], "language string, text string")
    assert rows(source_line_counts(df)) == sorted([(language, 1, *want), ("TOTAL", 1, *want)], key=repr)


def test_source_line_counts_of_long_texts(spark, rows):
    n = 200_000
    long = [("JavaScript", "/*" + "x\n" * n + "*/"), ("JavaScript", '"' + "a\\\"" * n + '"'), ("Python", '"""' + "\\x" * n),
            ("CSS", "/" * n), ("HTML", "<" * n)]
    got = rows(source_line_counts(spark.createDataFrame(long, "language string, text string")))
    assert got == [("CSS", 1, 0, 0, 1), ("HTML", 1, 0, 0, 1), ("JavaScript", 2, 0, n + 1, 1), ("Python", 1, 0, 1, 0), ("TOTAL", 5, 0, n + 2, 3)]
    assert rows(source_line_counts(spark.createDataFrame([], "language string, text string"))) in ([], [("TOTAL", 0, None, None, None)])


def test_run_outcomes(spark, rows):
    at = lambda s: f"2026-01-01 00:{s // 60:02d}:{s % 60:02d}"
    df = spark.createDataFrame(
        [("ok", "RUNNING", at(0)), ("ok", "COMPLETED", at(30)), ("ok", "FAILED", at(40)), ("bad", "FAILED", at(5)),
         ("late", "RUNNING", at(0)), ("late", "COMPLETED", at(130)), ("never", "RUNNING", at(1)), ("open", "RUNNING", at(300))],
        "run_id string, state string, t string").select("run_id", "state", F.col("t").cast("timestamp").alias("observed_at"))
    got = runs.run_outcomes(df, 120).select("run_id", "outcome")
    assert rows(got) == [("bad", "FAILED"), ("late", "TIMED_OUT"), ("never", "TIMED_OUT"), ("ok", "COMPLETED")]
    assert rows(runs.latest_state(df).select("run_id", "state"))[0] == ("bad", "FAILED")


def test_unreadable_when_a_total_is_missing(spark, rows):
    df = spark.createDataFrame([("a", None, 5, 50.0), ("b", 10, 5, None)],
                               "repo string, num_statements long, covered_lines long, percent_covered double")
    counts = spark.createDataFrame([("a", 3)], "repo string, tests long")
    assert rows(coverage.coverage_report(df, counts)) == [("a", 0, 0, 0, 0.0, "unknown"), ("b", 0, 0, 0, 0.0, "unknown")]


def test_report_rows(spark, tmp_path):
    from lorekeep.sinks.reports import write_rows

    write_rows(spark.createDataFrame([("r", 1)], "repo string, number int"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"repo":"r","number":1}']


def test_logs_of_one_name_are_two_logs(spark, tmp_path):
    for folder in ("a", "c"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "b.log").write_text("one\ntwo\n")
    lines = reports.read_build_log(spark, str(tmp_path / "*"))
    assert sorted(r.line_no for r in lines.collect()) == [1, 1, 2, 2] and {r.log for r in lines.collect()} == {"b.log"}


def test_label_colours_and_unpushed(spark, tmp_path, rows):
    missing = spark.createDataFrame([("r", "bug"), ("r", "odd")], "repo string, label string")
    assert rows(issues.label_plan(missing, {"bug": "ff0000"})) == [("r", "bug", "ff0000"), ("r", "odd", "ededed")]
    (tmp_path / "u.json").write_text('{"repo":"a","unpushed":3}\n{"repo":"b","unpushed":"?"}\nnot json\n')
    assert rows(reports.read_unpushed(spark, str(tmp_path))) == [("a", 3), ("b", 0)]
    (tmp_path / "s.json").write_text('{"repo":"a","branch":null,"line":"?? f"}\n')
    assert rows(reports.read_status_lines(spark, str(tmp_path / "s.json"))) == [("a", None, "?? f")]
