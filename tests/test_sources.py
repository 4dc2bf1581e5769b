import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.functions.staging import path_is_complete
from newsloom.functions.text import alphabetic_words, first_bytes, surface_tokens
from newsloom.operators.features import tokenise
from newsloom.plans.ingest import ingest_pages, main, stored_articles
from newsloom.sources import pages as page_texts
from newsloom.sources import (
    append_ids,
    extract_articles,
    materialise_tokens,
    read_corpus_file,
    read_doc_topics_file,
    read_manifest,
    read_posts,
    read_text_folder,
    read_topic_keys_file,
    read_work_list,
    rejected_pages,
    write_text_folder,
)


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize("length, wanted", [(0, ""), (1, "h"), (2, "h"), (3, "hé"), (4, "hé"), (5, "héé"), (9, "héé")])
def test_cut_inside_a_character(spark, length, wanted):
    assert one(spark, "héé", lambda t: first_bytes(t, length)) == wanted


def test_cut_inside_four_byte_character(spark):
    assert [one(spark, "a😀b", lambda t, n=n: first_bytes(t, n)) for n in range(1, 7)] == ["a", "a", "a", "a", "a😀", "a😀b"]


def test_whole_text_and_null(spark):
    assert one(spark, "héé", lambda t: first_bytes(t, None)) == "héé"
    assert one(spark, None, lambda t: first_bytes(t, 3)) is None


def test_tokens(spark):
    text = "Don't PAY 42€, naïve Ünits!"
    assert one(spark, text, alphabetic_words) == ["don", "t", "pay", "naïve", "ünits"]
    assert one(spark, text, surface_tokens) == ["Don", "'", "t", "PAY", "42", "€", ",", "naïve", "Ünits", "!"]


def test_text_folder(spark, tmp_path):
    (tmp_path / "12.txt").write_bytes("naïve\n".encode())
    (tmp_path / "7.txt").write_bytes(b"\n")
    (tmp_path / "8.txt").write_bytes(b"")  # skipped by Spark
    rows = read_text_folder(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.text) for r in rows] == [(7, "\n"), (12, "naïve\n")]


def test_text_folder_rejects_other_encodings(spark, tmp_path):
    (tmp_path / "1.txt").write_bytes("naïve".encode("latin-1"))
    with pytest.raises(Exception, match="INVALID_UTF8"):
        read_text_folder(spark, str(tmp_path)).collect()


def test_work_list_and_manifest(spark, tmp_path):
    (tmp_path / "work").write_text("3 http://a/b extra\n\n  4\thttp://c \n")
    rows = read_work_list(spark, str(tmp_path / "work")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(3, "http://a/b"), (4, "http://c")]
    (tmp_path / "done").write_text("3\n10\n")
    assert {r.id for r in read_manifest(spark, str(tmp_path / "done")).collect()} == {3, 10}
    assert read_manifest(spark, str(tmp_path / "absent")).count() == 0


def test_manifest_keeps_the_last_few_ids(spark, tmp_path):
    path = str(tmp_path / "done")
    append_ids(spark.range(25), path)
    append_ids(spark.range(25, 28), path)
    assert read_manifest(spark, path).count() == 28


def test_posts_from_csv(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text(
        "id,title,url,num_points,author,created_at\n"
        '1,"Say ""hi"", all",http://a,50,ann,9/26/2016 3:26\n'
        "2,Plain,http://b,,bob,10/1/2015 23:59\n"
    )
    rows = read_posts(spark, str(path), "csv", "M/d/yyyy H:mm").orderBy("id").collect()
    assert rows[0].title == 'Say "hi", all' and rows[0].num_points == 50
    assert str(rows[0].created_at) == "2016-09-26 03:26:00" and str(rows[0].created_date) == "2016-09-26"
    assert rows[1].num_points is None and str(rows[1].created_date) == "2015-10-01"


PAGES = {
    1: "<html><title>A &amp; B</title><body><nav>menu</nav><article><h1>A</h1><p>One <b>two</b>.<p>Three&nbsp;four"
    "<script>var t='</p>';</script></article><p>after</p></body></html>",
    2: "<body><div class='x ads top'>buy</div><p>No article\nelement</p><!-- <p>hidden</p> --><footer>foot</footer>",
    3: "<body><p>kept</p><script>never closed <p>text</p>",
    4: "<body><script>only()</script></body>",
    5: None,
    6: "",
    7: "plain 1 < 2 text &lt;b&gt; &amp;lt;",
    9: "<p>&#8211;&#x2014;&#65;&eacute;&hellip; &#1114112; &#xD800; &bogus; &#38;lt; &#160;&lsquo;x&rsquo; &#128512;</p>",
    8: "<ARTICLE class='a'><P>Upper</P><BR/>case<ul><li>x</li><li>y</li></ul></ARTICLE>",
}


def pages(spark):
    return spark.createDataFrame([(i, f"http://p/{i}", h) for i, h in PAGES.items()], "page_id long, url string, html string")


def test_article_text(spark):
    found = {r.id: (r.title, r.text) for r in extract_articles(pages(spark)).collect()}
    assert found == {
        1: ("A & B", "One two.\n\nThree four"),
        2: ("", "No article element"),
        3: ("", "kept"),
        7: ("", "plain 1 < 2 text <b> &lt;"),
        9: ("", "–—Aé… &#1114112; &#xD800; &bogus; &lt; ‘x’ 😀"),
        8: ("", "Upper\n\ncase\n\nx\n\ny"),
    }


def test_rejected_pages(spark):
    found = {r.id: r.reason for r in rejected_pages(pages(spark)).collect()}
    assert found == {4: "no article text", 5: "no page", 6: "no article text"}


def test_pages_are_parsed_once(spark):
    plan = extract_articles(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Python" not in plan.replace("MapInArrow", "")


def test_tokens_are_built_once(spark, tmp_path):
    path, calls = str(tmp_path / "tokens"), []
    texts = spark.createDataFrame([(2, "b"), (1, "a")], "id long, text string")

    def build(rows):
        calls.append(1)
        return tokenise(rows)

    for _ in range(2):
        assert materialise_tokens(spark, path, texts, build).count() == 2
    assert len(calls) == 1


def test_half_written_tokens_are_replaced(spark, tmp_path):
    (tmp_path / "tokens").mkdir()
    (tmp_path / "tokens" / "part-00000.parquet").write_bytes(b"half")
    path = str(tmp_path / "tokens")
    assert not path_is_complete(spark, path)
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    built = materialise_tokens(spark, path, texts, tokenise)
    assert built.count() == 1


def test_model_files(spark, tmp_path):
    (tmp_path / "keys").write_text("0\t0.05\tone two \n1\t0.05\tthree \n")
    keys = read_topic_keys_file(spark, str(tmp_path / "keys")).orderBy("topic_id").collect()
    assert [(k.topic_id, k.alpha, k.words) for k in keys] == [(0, 0.05, ["one", "two"]), (1, 0.05, ["three"])]
    (tmp_path / "shares").write_text("#doc name topic proportion ...\n0\ta7\t2.5E-1\t0.75\n")
    shares = read_doc_topics_file(spark, str(tmp_path / "shares")).collect()
    assert [(s.id, s.name, s.shares) for s in shares] == [(0, "a7", [0.25, 0.75])]
    (tmp_path / "corpus").write_text("5 0 one one two\n6 0\n")
    corpus = read_corpus_file(spark, str(tmp_path / "corpus")).orderBy("id").collect()
    assert [(c.id, c.label, c.tokens) for c in corpus] == [(5, "0", ["one", "one", "two"]), (6, "0", [])]


def test_ingest_skips_what_is_done(spark, tmp_path):
    articles, done = str(tmp_path / "articles"), str(tmp_path / "done")
    all_pages = pages(spark)
    work = all_pages.select(F.col("page_id").alias("id"), "url")
    first = ingest_pages(work.where("id < 3"), all_pages, articles, done)
    assert first["articles"] == 2 and first["articles_per_second"] > 0
    second = ingest_pages(work, all_pages, articles, done, min_article_length=5)
    assert second["articles"] == 3  # 7, 8 and 9; 3 is too short
    rows = stored_articles(spark, articles, done).collect()
    assert sorted(r.id for r in rows) == [1, 2, 7, 8, 9]


def test_ingest_as_a_stream(spark, tmp_path, monkeypatch):
    """Restarted after a batch that was killed between its articles and its ids; each id is stored once."""
    import shutil

    from newsloom.plans import ingest

    all_pages = pages(spark).where("page_id in (1, 2, 3, 7, 8, 9)")
    for i, row in enumerate(all_pages.collect()):
        spark.createDataFrame([row], all_pages.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "arriving"))
    articles, done, checkpoint = (str(tmp_path / name) for name in ("articles", "done", "checkpoint"))
    append_ids(spark.createDataFrame([(8,)], "id long"), f"{done}/run=before")
    work = all_pages.select(F.col("page_id").alias("id"), "url")
    stream = spark.readStream.schema(all_pages.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "arriving"))
    reports, real = [], ingest.article_metrics

    def killed(frame, name):
        if len(reports) == 1:
            raise RuntimeError("killed")
        return real(frame, name)

    monkeypatch.setattr(ingest, "article_metrics", killed)
    with pytest.raises(Exception, match="killed"):
        ingest.ingest_stream(work, stream, articles, done, checkpoint, report=reports.append).awaitTermination()
    assert [r["batch"] for r in reports] == [0]
    monkeypatch.setattr(ingest, "article_metrics", real)
    ingest.ingest_stream(work, stream, articles, done, checkpoint, report=reports.append).awaitTermination()
    assert [r["batch"] for r in reports] == [0, 1, 2]
    assert sorted(r.id for r in stored_articles(spark, articles, done).collect()) == [1, 2, 3, 7, 9]
    listed = [r.id for r in spark.read.schema("id long").csv(done).collect()]
    assert sorted(listed) == [1, 2, 3, 7, 8, 9]
    assert reports[-1]["total_articles"] == sum(r["articles"] for r in reports[1:])
    assert all(r[key] >= 0 for r in reports for key in ("articles_per_second", "total_articles_per_second", "total_characters_per_second"))
    # The checkpoint forgets its last batch: the same run is written again and nothing doubles.
    shutil.rmtree(f"{checkpoint}/commits")
    shutil.rmtree(f"{checkpoint}/offsets")
    shutil.rmtree(f"{checkpoint}/sources")
    ingest.ingest_stream(work, stream, articles, done, checkpoint).awaitTermination()
    assert sorted(r.id for r in stored_articles(spark, articles, done).collect()) == [1, 2, 3, 7, 9]
    assert sorted(r.id for r in spark.read.schema("id long").csv(done).collect()) == [1, 2, 3, 7, 8, 9]


def test_ingest_as_a_job(spark, tmp_path, capsys):
    (tmp_path / "work").write_text("1 http://p/1\n4 http://p/4\n")
    pages(spark).write.parquet(str(tmp_path / "pages"))
    main([f"--{name}={tmp_path / name}" for name in ("work", "pages", "articles", "manifest")])
    assert capsys.readouterr().out.startswith("articles 1, characters ")
    stored = stored_articles(spark, str(tmp_path / "articles"), str(tmp_path / "manifest"))
    assert [r.id for r in stored.collect()] == [1]


def test_unfinished_run_is_not_read(spark, tmp_path):
    articles, done = str(tmp_path / "articles"), str(tmp_path / "done")
    ingest_pages(pages(spark).selectExpr("page_id as id", "url").where("id = 1"), pages(spark), articles, done)
    # A run that stored an article and died before its manifest was written.
    spark.createDataFrame([(2, "t", "x")], "id long, title string, text string").write.parquet(f"{articles}/run=dead")
    assert [r.id for r in stored_articles(spark, articles, done).collect()] == [1]


@pytest.mark.parametrize(
    "html, text",
    [
        ('<body><div class="story no-ads"><p>Body text one.</p></div><p>tail</p></body>', "Body text one.\n\ntail"),
        ('<body><form><p>All of it.</p><select><option>x</select><button>Go</button></form></body>', "All of it."),
        ("<body><nav><p>Menu never closed</p><p>The text.</p></body>", "Menu never closed\n\nThe text."),
        ('<body><div class="big ads top">Buy</div><p>Text.</p></body>', "Text."),
        ("<body><p>Text.</p><script>var x = '</p>';</body>", "Text."),
        # Elements end at their own depth.
        ('<div class="ads"><div>inner</div> inner ad text</div><p>Body.</p>', "Body."),
        ("<nav>menu <p>Body after an open menu.</p><nav>x</nav><p>more</p>", "menu\n\nBody after an open menu.\n\nmore"),
        ("<aside>a<aside>b</aside>c</aside><p>Text.</p>", "Text."),
        ("<aside><article>other story</article></aside><article>The story.</article><p>after</p>", "The story."),
        ("<article>One<article>quoted</article>two</article>three", "One\n\nquoted\n\ntwo"),
        # End tags that are missing or implied, and ones without a start.
        ("<div><nav>menu</div><p>Body.</p>", "Body."),
        ('<ul><li>one<div class="ad">x<li>two</ul><p>three', "one\n\ntwo\n\nthree"),
        ('<p>a<div class="ad">x</p>y</div>b', "a\n\nb"),
        ('<b><div class="ad">x</b>y</div>b', "b"),
        ("</nav></div><p>Body.</p></aside>", "Body."),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "a\n\nb\n\nc\n\nd"),
        ("<article><p>open to the end</body> tail", "open to the end"),
        ("<p>a<img src=x><br/>b<hr>c", "a\n\nb\n\nc"),
        ("<p>1 <2 and <never closed", "1 <2 and <never closed"),
        ("<h1>Head</h1><p>a<!-- never closed <p>b", "a"),
        ('<p>a<DIV CLASS=ads>x</DIV>b<div class="ads-free">c</div>', "a\n\nb\n\nc"),
        ("<p>&#0;&#99999999999999;&#x41;&amp;amp;&", "&#0;&#99999999999999;A&amp;&"),
    ],
)
def test_page_text_is_not_lost(spark, html, text):
    from newsloom.sources.pages import article_text_from_html

    page = spark.createDataFrame([(html,)], "html string")
    assert page.select(article_text_from_html(page.html).alias("t")).first().t == text


def test_pages_take_time_in_proportion_to_their_length():
    from newsloom.sources.pages import article_text

    for page in ("<a" * 200_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "<p>" * 100_000 + "x", "&" * 200_000, "<b>" * 20_000 + "</i>" * 20_000):
        began = time.monotonic()
        article_text(page)
        assert time.monotonic() - began < 20


def test_empty_files_have_an_empty_text(spark, tmp_path):
    (tmp_path / "more").mkdir()
    for name, text in (("1.txt", "one"), ("2.txt", ""), ("more/3.txt", ""), ("more/notes.md", ""), ("4.txt", " ")):
        (tmp_path / name).write_text(text)
    (tmp_path / "more" / "1.txt").write_text("")  # the same id again, without content
    rows = sorted((r.id, r.text) for r in read_text_folder(spark, str(tmp_path)).collect() if r.id is not None)
    assert rows == [(1, "one"), (2, ""), (3, ""), (4, " ")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "5.txt").write_text("")
    assert [tuple(r) for r in read_text_folder(spark, str(tmp_path / "none")).collect()] == [(5, "")]


def test_text_folder_in_another_encoding(spark, tmp_path):
    (tmp_path / "7.txt").write_bytes("déjà".encode("latin-1"))
    assert [tuple(r) for r in read_text_folder(spark, str(tmp_path), encoding="ISO-8859-1").collect()] == [(7, "déjà")]


def test_texts_are_written_without_a_folder_for_each(spark, tmp_path):
    path = f"{tmp_path}/texts"
    rows = [(k, f"text {k}\nnaïve") for k in range(100)] + [(7, "again"), (200, None)]
    write_text_folder(spark.createDataFrame(rows, "id long, text string"), path)
    assert len(list((tmp_path / "texts").iterdir())) < 50
    found = {r.id: r.text for r in read_text_folder(spark, path, r"/id=([0-9]+)\.txt$").collect()}
    assert sorted(found.pop(7).split("\n")) == ["", "again", "naïve", "text 7"]
    assert found == {k: f"text {k}\nnaïve\n" for k in range(100) if k != 7} | {200: "\n"}


def test_pages_are_read_in_pieces(monkeypatch):
    html = pa.array([f"<article>{k} {'x' * 30_000}</article>" for k in range(200)] + [None, "", "y" * 3_000_000])
    tracemalloc.start()
    lengths = page_texts._texts(html, lambda page: str(len(page)))
    assert tracemalloc.get_traced_memory()[1] < 5 << 20
    tracemalloc.stop()
    assert lengths.to_pylist() == [None if page is None else str(len(page)) for page in html.to_pylist()]
    monkeypatch.setattr(page_texts, "PIECE_BYTES", 10)
    assert [len(piece) for piece in page_texts._pieces(pa.array(["a" * 4] * 5), 10)] == [3, 2]
    assert page_texts._texts(pa.array([], pa.string()), len).to_pylist() == []
