"""Readers, writers and streaming forms on files made here."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.sources import knowledge_base as kb
from marginalia.sources import office, web
from marginalia.streaming import logs


def test_knowledge_base_forms(spark, tmp_path):
    page = {"content_id": "c1", "url": "https://a.test/1", "title": "T", "keywords": ["k"], "metrics": {"word_count": 3}, "other": 1}
    (tmp_path / "a.json").write_text(json.dumps({"pages": [page, page], "metadata": {"total_urls_found": 2}}))
    (tmp_path / "b.json").write_text(json.dumps([page | {"content_id": "c2"}]))
    (tmp_path / "c.json").write_text("{ not json")
    (tmp_path / "d.json").write_text(json.dumps({"nothing": []}))
    got = kb.read_pages(spark, str(tmp_path / "*.json"))
    assert sorted(r.content_id for r in got.collect()) == ["c1", "c1", "c2"]
    assert kb.read_metadata(spark, str(tmp_path / "a.json")).first().total_urls_found == 2
    assert kb.changed_since(spark, str(tmp_path / "*.json"), "1990-01-01").count() == 4
    kb.write_pages(got, str(tmp_path / "out"), by="content_id")
    assert [r.url for r in kb.read_pages(spark, str(tmp_path / "out" / "content_id=c2")).collect()] == ["https://a.test/1"]
    kb.write_report(got.withColumn("category", F.lit("x")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().pages == 3


def test_stopwords_and_cache(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" The \n\nand\nTHE\n")
    assert sorted(r.word for r in kb.read_stopwords(spark, str(tmp_path / "s.txt"), ["x"]).collect()) == ["and", "the"]
    assert [r.word for r in kb.read_stopwords(spark, str(tmp_path / "none.txt"), ["x", "x"]).collect()] == ["x"]
    entries = spark.sql("select 'a' as cache_key, 'keep' as category, 60 as ttl, timestamp_ntz'2024-01-01 00:00:00' as ts union all select 'b', 'keep', 0, timestamp_ntz'2020-01-01 00:00:00' union all select 'c', 'drop', 0, timestamp_ntz'2024-01-01 00:00:00' union all select 'd', 'keep', 60, timestamp_ntz'2023-01-01 00:00:00'")
    kb.write_cache(entries, str(tmp_path / "cache"), ["keep"], "2024-01-01 00:01:00")
    schema = "cache_key string, category string, ttl int, ts timestamp_ntz"
    assert sorted(r.cache_key for r in kb.read_cache(spark, str(tmp_path / "cache"), schema, "2024-01-01 00:01:00").collect()) == ["a", "b"]
    assert [r.cache_key for r in kb.read_cache(spark, str(tmp_path / "cache"), schema, "2024-01-01 00:01:01").collect()] == ["b"]
    kb.write_dictionary(spark.createDataFrame([("b", ["x"]), ("a", ["y"])], "category string, keywords array<string>"), str(tmp_path / "dict"))
    assert spark.read.parquet(str(tmp_path / "dict")).count() == 2
    kb.write_dictionary_yaml(spark.createDataFrame([("b", ["x\\y", 'say "no"']), ("a", ["yes", "كلمة"]), ("c", [])], "category string, keywords array<string>"), str(tmp_path / "yaml"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "yaml").glob("part-*")))
    assert text == '"a":\n- "yes"\n- "كلمة"\n"b":\n- "x\\\\y"\n- "say \\"no\\""\n"c": []\n'
    log = spark.createDataFrame([("k", "a", 10, "hit"), ("k", "a", 10, "absent"), ("l", "a", None, "expired"), ("m", "b", 5, "absent")], "cache_key string, category string, size_bytes int, outcome string")
    kb.write_cache_statistics(log, str(tmp_path / "stats"))
    assert {r.category: (r.hits, r.misses, r.hit_rate, r.entries, r.size_bytes) for r in spark.read.json(str(tmp_path / "stats")).collect()} == {"a": (1, 2, 33.33, 2, 10), "b": (0, 1, 0.0, 1, 5)}


def test_office(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Info" r:id="r1"/><sheet name="Data" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet2.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {s}><sheetData><row><c><v>9</v></c></row></sheetData></worksheet>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "n.txt").write_text("x")
    assert office.discover(spark, str(tmp_path)).count() == 3
    got = {r.path.rsplit("/", 1)[-1]: r for r in office.read_office(spark, str(tmp_path)).collect()}
    assert (got["a.docx"].title, got["a.docx"].content) == ("Head", "Head\nx | y")
    assert got["b.xlsx"].content == "Sheet: Data\nhello | 5"
    assert got["bad.docx"].content is None and "BadZipFile" in got["bad.docx"].error


def test_web(spark):
    html = "<title>Big Library Guide</title><nav>menu</nav><article><h1>Opening hours</h1><p>The library opens at eight every single day.<ul><li>one<li>two</ul><a href='/x'>x</a><a href='#y'>y</a><img src='a.png'></article>"
    rows = spark.createDataFrame([(1, html, "https://a.test/p", 0), (2, None, "https://a.test/q", 0), (3, "", "https://a.test/r", 0), (4, "<body>" + "word " * 20000, None, 0), (5, "<nav>x</nav><div class='page-content'>inside</div><div>outside</div>", None, 0), (6, "<div>all</div><script>no()</script> of it", None, 0)], "k long, h string, u string, title int")
    got = {r.k: r for r in web.parsed(rows, "k", "h", "u").collect()}
    p = got[1]
    assert p.title == "Big Library Guide" and p.content == "Opening hours The library opens at eight every single day. one two x y" and p.headings[0].text == "Opening hours" and p.lists[0]["items"] == ["one", "two"] and p.hrefs == ["/x", "#y"]
    assert p.keywords[:4] == ["opening", "hours", "library", "guide"] and "eight" in p.keywords and p.paragraphs == ["The library opens at eight every single day."] and p.images == ["a.png"]
    assert got[2].title is None and got[2].keywords == [] and got[3].title == "/r" and got[4].title == "Untitled" and len(got[4].content) == 75003 and got[5].content == "inside" and got[6].content == "all of it"
    assert [r.js for r in rows.orderBy("k").select(web.needs_scripts(F.col("h")).alias("js")).collect()] == [True, None, True, False, True, True]
    index = "<sitemapindex><sitemap><loc>https://a.test/s1.xml</loc></sitemap><sitemap><loc>https://a.test/none.xml</loc></sitemap></sitemapindex>"
    tree = spark.createDataFrame([("https://a.test/sitemap.xml", index), ("https://a.test/s1.xml", "<urlset><url><loc>https://a.test/in</loc></url></urlset>"), ("https://a.test/s2.xml", "<urlset><url><loc>https://a.test/out</loc></url></urlset>"), ("https://a.test/sitemap.txt", "https://a.test/line")], "address string, value string")
    assert [r.url for r in web.sitemap_tree(tree, ["https://a.test/sitemap.xml", "https://a.test/sitemap.txt"]).collect()] == ["https://a.test/in", "https://a.test/line"]
    maps = spark.createDataFrame([("<urlset><url><loc>https://a.test/1</loc></url><url><loc> https://a.test/x.pdf </loc></url></urlset>",), ("https://a.test/2\nhttps://a.test/1\nnope",)], "value string")
    urls = web.sitemap_urls(maps)
    assert [r.url for r in urls.collect()] == ["https://a.test/1", "https://a.test/2"]
    crawled = spark.createDataFrame([("https://a.test/3",), ("https://a.test/1",)], "url string")
    assert [r.url for r in web.start_urls("https://a.test", urls, crawled).collect()] == ["https://a.test", "https://a.test/1", "https://a.test/2", "https://a.test/3"]


def _run(query, name):
    query = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)


@pytest.mark.filterwarnings("ignore")
def test_streaming(spark, tmp_path):
    rows = [(i, "k" if i % 2 else "l", 100 * i, 250) for i in range(8)]
    spark.createDataFrame(rows, "seq long, cache_key string, t long, ttl int").withColumn("ts", F.timestamp_seconds("t")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    _run(logs.ttl_hits(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "ttl_stream")
    got = {r.seq: r.hit for r in spark.table("ttl_stream").collect()}
    assert got == {i: i // 2 % 2 == 1 for i in range(8)}  # every second access of a key, 200 seconds apart, still finds its entry
    log = spark.createDataFrame([(1, "m", 100, True, 5), (1, "m", 100, True, 5), (2, "m", 110, False, 7), (3, "m", 90000, True, 1)], "seq long, model string, t long, success boolean, tokens long").withColumn("ts", F.timestamp_seconds("t"))
    # three files, read one by one: the last one's row is older than the watermark that the first one set
    later = [[(5, "m", 180000, True, 1)], [(4, "m", 120, True, 9)]]
    for i, part in enumerate([log, *(spark.createDataFrame(r, "seq long, model string, t long, success boolean, tokens long").withColumn("ts", F.timestamp_seconds("t")) for r in later)]):
        part.coalesce(1).write.parquet(str(tmp_path / "part"), mode="overwrite")
        (tmp_path / "log").mkdir(exist_ok=True)
        (file,) = (tmp_path / "part").glob("*.parquet")
        os.utime(file, (1_000_000_000 + i, 1_000_000_000 + i))
        file.rename(tmp_path / "log" / f"{i}.parquet")
    _run(logs.windowed_requests(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))), "req_stream")
    assert sorted((r.n, r.n_ok, r.tokens) for r in spark.table("req_stream").collect()) == [(1, 1, 1), (2, 1, 12)]
