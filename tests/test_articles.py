import gzip

import pytest
from pyspark.sql import functions as F

from lorekeep.plans.corpus_queries import article_xml
from lorekeep.plans.views import Tables
from lorekeep.sources import articles as A



def record(pmid, title="T", abstracts=("a",), year="2020", mesh=("m",), extra="", attrs=""):
    parts = "".join(f"<AbstractText{attrs}>{a}</AbstractText>" for a in abstracts)
    heads = "".join(f"<MeshHeading><DescriptorName UI='D1'>{m}</DescriptorName></MeshHeading>" for m in mesh)
    pub = f"<PubDate><Year>{year}</Year></PubDate>" if year is not None else "<PubDate><MedlineDate>x</MedlineDate></PubDate>"
    head = f"<ArticleTitle>{title}</ArticleTitle>" if title is not None else ""
    return (f"<PubmedArticle Status='x'><MedlineCitation><PMID Version='1'>{pmid}</PMID><Article><Journal>{pub}</Journal>"
            f"{head}<Abstract>{parts}</Abstract></Article><MeshHeadingList>{heads}</MeshHeadingList>{extra}"
            "</MedlineCitation></PubmedArticle>")


def feed(*records, tail=""):
    return ("<?xml version='1.0'?><!DOCTYPE PubmedArticleSet>\n<PubmedArticleSet>" + "\n".join(records)
            + tail + "</PubmedArticleSet>").encode()


def write(path, name, data):
    with gzip.open(path / name, "wb") as f:
        f.write(data)


def read(spark, path):
    got = A.read_articles(spark, str(path)).orderBy("feed_file", "feed_pos").collect()
    return [(r.feed_file, r.pmid, r.title, r.abstract, r.year, r.mesh_terms) for r in got]


def test_text_rules(spark, tmp_path):
    write(tmp_path, "u1.xml.gz", feed(
        record("1", "Al <b>x</b> tail", ("one <i>i</i> two", "<i>lead</i> lost", "three")),
        record("2", None, ("a &lt;b&gt; &amp; c",), None, ()),
        record("3", "", ("<i>only child</i>",)),                       # empty abstract: dropped
        record("4", abstracts=()),                                     # none at all: dropped
        record("5", "<b>lead</b>", ("x",), extra="<OtherAbstract><AbstractText>other</AbstractText></OtherAbstract>"),
        record("6", extra="<MeshHeading><QualifierName>q</QualifierName></MeshHeading>"),
        record("1", "again"),
        tail="<DeleteCitation><PMID>9</PMID></DeleteCitation>",
    ))
    assert read(spark, tmp_path) == [
        ("u1.xml.gz", "1", "Al ", "one  three", "2020", ["m"]),
        ("u1.xml.gz", "2", "", "a <b> & c", "", []),
        ("u1.xml.gz", "5", None, "x other", "2020", ["m"]),
        ("u1.xml.gz", "6", "T", "a", "2020", ["m"]),
        ("u1.xml.gz", "1", "again", "a", "2020", ["m"]),
    ]


def test_bad_record_is_skipped_alone(spark, tmp_path):
    write(tmp_path, "u1.xml.gz", feed(record("1"), record("2", "<b>open"), record("3", "a & b"),
                                      record("4", "a&nope;b"), record("5")))
    assert [r[1] for r in read(spark, tmp_path)] == ["1", "5"]


def test_loose_end_tag(spark, tmp_path):
    loose = record("1").replace("</PubmedArticle>", "</PubmedArticle\n>")
    write(tmp_path, "u1.xml.gz", feed(loose, record("2")))
    assert [r[1] for r in read(spark, tmp_path)] == ["1", "2"]


def test_broken_off_file_gives_no_rows(spark, tmp_path, rows):
    write(tmp_path, "u1.xml.gz", feed(record("1")))
    write(tmp_path, "u2.xml.gz", feed(*[record(str(i), abstracts=("long " * 50,)) for i in range(200)]))
    whole = (tmp_path / "u2.xml.gz").read_bytes()
    (tmp_path / "u2.xml.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "u3.xml.gz").write_bytes(b"this is no gzip file")
    assert [r[:2] for r in read(spark, tmp_path)] == [("u1.xml.gz", "1")]
    status = dict(rows(A.feed_status(A.read_feed_pieces(spark, str(tmp_path)))))
    assert status["u1.xml.gz"] == "ok" and status.get("u2.xml.gz", "corrupt") == "corrupt"


def test_listing_is_sorted_and_skips_checksums(spark, tmp_path):
    for name in ("u2.xml.gz", "u1.xml.gz", "u1.xml.gz.md5"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.file for r in A.list_feed(spark, str(tmp_path)).collect()] == ["u1.xml.gz", "u2.xml.gz"]


CASES = [
    record("1"), record("2", "A <b>x</b>", ("p <i>q</i>", "r")), record("3", None, ("t",), None),
    record("4", attrs=" Label='A > B' NlmCategory=\"C\""), record("5", "", ("x", "", "y")),
    record("6", "&lt;&gt;&amp;&quot;&apos;"), record("7", abstracts=("a\r\nb",)),
    "<PubmedArticle><PMID>8</PMID><ArticleTitle/><PubDate><Month>1</Month><Year>1999</Year></PubDate>"
    "<AbstractText/><AbstractText>z</AbstractText></PubmedArticle>",
    "<PubmedArticle><PMID>9</PMID><PubDate><Month/></PubDate><X><Year>1</Year></X><PubDate> <Year>2</Year></PubDate>"
    "<AbstractText>z</AbstractText><MeshHeading><QualifierName>q</QualifierName><DescriptorName>d</DescriptorName>"
    "</MeshHeading></PubmedArticle>",
    "<PubmedArticle><AbstractText>no id</AbstractText></PubmedArticle>",
]
NOT_PLAIN = [
    record("a", abstracts=("x<!-- c -->y",)), record("b", abstracts=("<![CDATA[x<y]]>",)),
    record("c", abstracts=("&#233;",)), record("d", abstracts=("<?pi x?>t",)),
    record("e").replace("<Year>2020</Year>", "<D><Year>1</Year></D><Year>2020</Year>"),
]


def test_patterns_and_xpath_agree(spark):
    df = spark.createDataFrame([(x.replace("\r\n", "\n"),) for x in CASES], "x string")
    x = F.col("x")
    got = df.select(A.is_plain(x).alias("plain"), A.article_by_pattern(x).alias("p"), A.article_by_xpath(x).alias("q"))
    for r in got.collect():
        assert r.plain and r.p == r.q
    odd = spark.createDataFrame([(x,) for x in NOT_PLAIN], "x string").select(A.is_plain(x)).collect()
    assert not any(r[0] for r in odd)


def test_not_plain_records_are_read(spark):
    pieces = spark.createDataFrame([(x[: -len(A.RECORD_END)],) for x in NOT_PLAIN], "value string")
    got = {r.pmid: (r.abstract, r.year) for r in A.parse_articles(pieces).collect()}
    assert got == {"a": ("xy", "2020"), "b": ("x<y", "2020"), "c": ("é", "2020"), "d": ("t", "2020"), "e": ("a", "2020")}


def test_patterns_and_xpath_agree_on_documents(spark):
    docs = article_xml(Tables(spark, "/root/testdata/sf0.001").documents)
    x = A.record_block(F.col("value"))
    both = docs.select(A.article_by_pattern(x).alias("p"), A.article_by_xpath(x).alias("q"))
    assert both.count() == 200 and both.where("not (p <=> q)").count() == 0


@pytest.mark.parametrize("inner", [
    "a\x01b", "a&#0;b", "a&#x1;b", "a ]]> b", "a<!-- x -- y -->", "<?xml version='1.0'?>a", "a￿b",
    "&#1114112;", "&#xD800;", "</AbstractText><x a='<'/><AbstractText>", "<p:x/>", "<1x/>", "<", "<!-- x",
    "</AbstractText><x a='1' a='2'/><AbstractText>", "<![CDATA[ x", "</AbstractText><!DOCTYPE x><AbstractText>",
])
def test_ill_formed_text_never_fails_the_job(spark, inner):
    piece = f"<PubmedArticle><PMID>1</PMID><AbstractText>{inner}</AbstractText>"
    assert A.parse_articles(spark.createDataFrame([(piece,)], "value string")).collect() == []


def test_json_corpus(spark, tmp_path, rows):
    for domain, name, text in [
        ("d1", "1.json", '{"pmid":"1","title":null,"abstract":"x","year":"","mesh_terms":[],"last_updated":"2026-06-02T00:00:00"}'),
        ("d2", "1.json", '{"pmid":"1","title":"t","abstract":"y","year":"1999","mesh_terms":["m"]}'),
        ("d2", "2.json", '{"pmid": broken'),
        ("_general", "3.txt", "no json"),
        ("_general_corpus", "_4.json", '{"pmid":"4","title":"t","abstract":"z"}'),
        ("heart failure", "1.json", '{"pmid":"9","title":"t","abstract":"h"}'),
    ]:
        (tmp_path / domain).mkdir(exist_ok=True)
        (tmp_path / domain / name).write_text(text)
    got = A.read_json_corpus(spark, str(tmp_path)).select("domain", "pmid", "abstract")
    assert rows(got) == [("_general_corpus", "4", "z"), ("d1", "1", "x"), ("d2", "1", "y"), ("heart failure", "9", "h")]
    assert A.without_chunks(got, "d2").count() == 3


def test_state_defaults(spark, tmp_path):
    state = A.sync_state(A.read_sync_log(spark, str(tmp_path / "none"))).first()
    assert tuple(state) == (None, None, 0, 0, 0, [])


def test_records_with_very_many_children(spark, tmp_path):
    qualifiers = "".join(f"<QualifierName UI='Q{i}'>q{i}</QualifierName>" for i in range(10_000))
    heading = f"<MeshHeadingList><MeshHeading><DescriptorName>first</DescriptorName>{qualifiers}</MeshHeading></MeshHeadingList>"
    late = f"<MeshHeadingList><MeshHeading>{qualifiers}<DescriptorName>last</DescriptorName></MeshHeading></MeshHeadingList>"
    write(tmp_path, "u1.xml.gz", feed(record("1", extra=heading), record("2", extra=late), record("3", extra=heading + "<!-- c -->")))
    got = {r[1]: r[5] for r in read(spark, tmp_path)}
    assert got == {"1": ["m", "first"], "2": ["m", "last"], "3": ["m", "first"]}


def test_empty_descriptors_stay_as_null(spark, tmp_path):
    empty = "<MeshHeadingList><MeshHeading><DescriptorName UI='D'/></MeshHeading><MeshHeading><DescriptorName></DescriptorName></MeshHeading>" \
        "<MeshHeading><Other>x</Other></MeshHeading></MeshHeadingList>"
    write(tmp_path, "u1.xml.gz", feed(record("1", mesh=("a",), extra=empty), record("2", mesh=("", "b"), extra="<!-- c -->" + empty)))
    got = {r[1]: r[5] for r in read(spark, tmp_path)}
    assert got == {"1": ["a", None, None], "2": [None, "b", None, None]}
