import json

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.scalars import human_size
from lorekeep.operators import catalog
from lorekeep.sinks.reports import registry_document, write_registry, write_registry_document
from lorekeep.sources.catalogs import read_inventory, read_registry, read_registry_document


def test_upsert_keeps_the_place_of_the_first(spark):
    df = spark.createDataFrame(
        [("g", "a", "1", 1), ("g", "b", "1", 2), ("g", "c", "1", 3), ("d", "b", "1", 4), ("g", "b", "2", 5)],
        "category string, name string, path string, seq long")
    out = catalog.upsert_registry(df, ["seq"]).orderBy("category", "position")
    assert [tuple(r) for r in out.collect()] == [
        ("d", "b", "1", 4), ("g", "a", "1", 1), ("g", "b", "2", 2), ("g", "c", "1", 3)]
    assert tuple(catalog.registry_size(out).first()) == (4, 2)


def test_registry_document_round_trip(spark, tmp_path):
    doc = {"genomes": [{"name": "h", "organism": "human", "files": ["f1", "f2"], "path": "/p"}, {"name": "m", "path": "/q"}],
           "databases": [{"name": "x", "sources": ["s"], "path": "/r"}]}
    (tmp_path / "reg.json").write_text(json.dumps(doc, indent=2))
    rows = read_registry_document(spark, str(tmp_path / "reg.json"))
    assert rows.count() == 3
    whole = lambda df: json.loads("".join(r.value for r in registry_document(df).orderBy("category", "position").collect()))
    assert whole(rows) == doc
    write_registry_document(rows, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert json.loads(text) == doc
    big = spark.range(120_000).selectExpr("concat('c', id % 7) as category", "id as position", "id as name")
    assert registry_document(big).count() == 120_000
    write_registry_document(rows.limit(0), str(tmp_path / "none_doc"))
    assert "".join(p.read_text() for p in (tmp_path / "none_doc").glob("part-*")).strip() == "{}"
    write_registry(rows, str(tmp_path / "out"), dry_run=True)
    assert not (tmp_path / "out").exists()
    write_registry(rows, str(tmp_path / "out"))
    again = read_registry(spark, str(tmp_path / "out"))
    assert whole(again) == doc
    assert read_registry(spark, str(tmp_path / "none")).count() == 0
    assert read_registry_document(spark, str(tmp_path / "none")).count() == 0


def test_registry_document_of_several_parts_reads_back_whole(spark, tmp_path, rows):
    """Names that hold quotes, brackets and line ends; categories that span parts."""
    df = spark.createDataFrame(
        [(f'c"{i // 70}', i % 70, f'n{i}\n"}},{{"]}}', ["f", str(i)]) for i in range(200)],
        "category string, position long, name string, files array<string>")
    path = str(tmp_path / "doc")
    write_registry_document(df.repartition(8), path)
    registry_document(df).repartitionByRange(4, "category", "position").sortWithinPartitions("category", "position").select(
        "value").write.mode("overwrite").text(path)
    assert len(list((tmp_path / "doc").glob("part-*"))) == 4
    for many in (7, 100_000):
        got = read_registry_document(spark, path, many).select("category", "position", "name", "files")
        assert rows(got) == rows(df)


def test_registry_documents_of_any_layout(spark, tmp_path, rows):
    doc = {"a": [{"name": "x"}, {"name": "y"}], "b": [{"name": "z"}]}
    want = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    texts = [json.dumps(doc), json.dumps(doc, indent=1), '{"a":[{"name":"x"},{"name":"y"}],\n"b":[{"name":"z"}]}',
             '{"a":[{"name":"x"}\n,{"name":"y"}],\n"b":[{"name":"z"}]\n}']
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
        assert rows(read_registry_document(spark, str(tmp_path / f"{i}.json")).select("category", "position", "name")) == want
    (tmp_path / "bad.json").write_text('{"a": [{"name": "x"')
    with pytest.raises(Exception, match="does not parse"):
        read_registry_document(spark, str(tmp_path / "bad.json")).collect()


@pytest.fixture
def defaults(spark):
    rows = [(s, a, i) for s, asm in catalog.SPECIES_ASSEMBLIES.items() for i, a in enumerate(asm)]
    return spark.createDataFrame(rows, "species string, assembly string, pos int")


@pytest.mark.parametrize("species, assemblies, want", [
    (None, ["GRCm39", "nope", "GRCm39"], ["GRCm39", "nope", "GRCm39"]),
    (["mouse", "human", "mouse"], None, ["GRCm39", "GRCm38", "GRCh38", "GRCh37", "T2T-CHM13"]),
    (["mouse"], ["GRCh38", "GRCm38", "GRCm38"], ["GRCm38", "GRCm38"]),
    (["yeast"], ["GRCh38"], []),
    (None, None, []),
])
def test_selection_modes(spark, defaults, species, assemblies, want):
    def listed(values, name):
        return None if values is None else spark.createDataFrame(list(enumerate(values)), f"pos int, {name} string")

    out = catalog.resolve_selection(defaults, listed(species, "species"), listed(assemblies, "assembly"))
    assert [r.assembly for r in out.orderBy("pos").collect()] == want


def test_manifest_skips_unknown(spark, rows):
    targets = spark.createDataFrame([(0, "a"), (1, "z")], "pos int, assembly string")
    manifest = spark.createDataFrame([("a", "f1"), ("a", "f2")], "assembly string, file string")
    assert catalog.match_manifest(targets, manifest).count() == 2
    assert rows(catalog.unknown_assemblies(targets, manifest).select("assembly")) == [("z",)]


@pytest.mark.parametrize("size, text", [
    (0, "0.0B"), (1023, "1023.0B"), (1024, "1.0KB"), (1280, "1.2KB"), (1792, "1.8KB"),
    (1024**5 - 1, "1024.0TB"), (1024**5, "1.0PB"), (1024**6, "1024.0PB"), (None, None)])
def test_human_size(spark, size, text):
    assert spark.createDataFrame([(size,)], "n long").select(human_size(F.col("n"))).first()[0] == text


def test_status_and_plan_differ_on_empty_files(spark, tmp_path, rows):
    (tmp_path / "org" / "human data").mkdir(parents=True)
    (tmp_path / "org" / "human data" / "a+b.fa").write_bytes(b"x" * 2048)
    (tmp_path / "org" / "empty.fa").write_bytes(b"")
    (tmp_path / "org" / "human data" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "org" / "human data" / "deep" / "er" / ".hidden").write_bytes(b"abc")
    inventory = read_inventory(spark, str(tmp_path))
    assert rows(inventory) == [
        ("org", False, None), ("org/empty.fa", True, 0), ("org/human data", False, None),
        ("org/human data/a+b.fa", True, 2048), ("org/human data/deep", False, None),
        ("org/human data/deep/er", False, None), ("org/human data/deep/er/.hidden", True, 3)]
    checks = spark.createDataFrame(
        [("A", "org/human data/a+b.fa"), ("B", "org/empty.fa"), ("C", "org/human data"), ("D", "org/none.fa")],
        "label string, path string")
    report = catalog.status_report(checks, inventory)
    assert rows(report.select("label", "present", "size_text")) == [
        ("A", True, "2.0KB"), ("B", True, "0.0B"), ("C", True, ""), ("D", False, "")]
    assert tuple(catalog.status_totals(report).first()) == (3, 1)
    files = checks.where("label <> 'C'")
    assert rows(catalog.fetch_plan(files, inventory).select("label")) == [("B",), ("D",)]
    assert catalog.register_present(checks, inventory).count() == 3
    assert catalog.register_present(checks, inventory, only_present=False).count() == 4


def test_chromosome_grid(spark):
    grid = catalog.chromosome_files(spark.range(2), (".vcf", ".tbi"))
    assert grid.count() == 2 * 24 * 2
    assert {r.chrom for r in grid.collect()} == {str(i) for i in range(1, 23)} | {"X", "Y"}


def test_empty_lists_count_as_absent(spark):
    defaults = spark.createDataFrame([("s", "a", 0), ("s", "b", 1)], "species string, assembly string, pos int")
    species = spark.createDataFrame([(0, "s")], "pos int, species string")
    given = spark.createDataFrame([(0, "z"), (1, "a")], "pos int, assembly string")
    names = lambda df: [r.assembly for r in df.orderBy("pos").collect()]
    assert names(catalog.resolve_selection(defaults, species.limit(0), given)) == ["z", "a"]
    assert names(catalog.resolve_selection(defaults, species, given.limit(0))) == ["a", "b"]
    assert names(catalog.resolve_selection(defaults, species, given)) == ["a"]
    assert names(catalog.resolve_selection(defaults, species.limit(0), given.limit(0))) == []
    assert catalog.resolve_selection(defaults, species).dtypes[0] == ("pos", "bigint")


def test_pages_of_any_name(spark, tmp_path, rows):
    from lorekeep.sources import catalogs

    (tmp_path / "_p2.json").write_text('[{"name": "x", "visibility": "public"}]')
    (tmp_path / "p3.json").write_text('{"message": "later"}')
    assert rows(catalogs.read_package_pages(spark, str(tmp_path)).select("name")) == [("x",)]
    assert rows(catalogs.listing_status(spark, str(tmp_path))) == [("_p2.json", "ok"), ("p3.json", "failed")]
    (tmp_path / "v" / "pkg").mkdir(parents=True)
    (tmp_path / "v" / "pkg" / "_1.json").write_text('[{"metadata":{"container":{"tags":["a","a"]}}},{"metadata":{}}]')
    assert rows(catalogs.read_version_tags(spark, str(tmp_path / "v"))) == [("pkg", "a"), ("pkg", "a")]
