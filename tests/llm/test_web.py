import hashlib

import pytest

from helpers import as_dicts, prose, with_odd_columns
from timeline_lake.llm import html_template as H
from timeline_lake.llm import warc

PAGES = "page_id long, url string, html string"


# --- WARC ------------------------------------------------------------------------------------------------------------


def test_gzip_members_end_with_zero_and_come_apart():
    parts = [b"", b"a", b"x" * 100, bytes(range(256)) * 70_000]
    members = [warc.gzip_member(p) for p in parts]
    assert all(m[-1] == 0 for m in members)
    assert warc.gunzipped(b"".join(members)) == b"".join(parts)
    assert b"".join(warc.member_chunks(b"".join(members))) == b"".join(parts)
    with pytest.raises(ValueError):
        list(warc.member_chunks(b"".join(members)[:-1000]))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_declared_length(version):
    nasty = b"HTTP/1.1 200 OK\r\n\r\nhttp://x.example/ 0.0.0.0 20000101000000 text/html 5\nhello\n\nWARC/1.0\r\n\r\n"
    data = warc.arc_version_block(version, "a.arc") + warc.arc_record(version, "http://a.example/b c", nasty) + warc.arc_record(version, "http://b.example/", b"")
    found = list(warc.read_arc([data]))
    assert [b for _, b in found] == [nasty, b""]
    assert found[0][0]["URL"] == "http://a.example/b%20c" and found[0][0]["Archive-date"] == warc.CRAWL_DATE
    assert ("Result-code" in found[0][0]) == (version == 2)
    with pytest.raises(ValueError):
        list(warc.read_arc([data[:-5]]))


def test_arc_without_version_block_and_with_own_fields():
    line = b"http://a.example/ 1.2.3.4 19970101 text/plain 3\nabc\n"
    assert list(warc.read_arc([line])) == [(dict(zip(warc.ARC_FIELDS[1].split(), ["http://a.example/", "1.2.3.4", "19970101", "text/plain", "3"])), b"abc")]
    own = b"1 0 archive\nURL Archive-date Archive-length\n"
    data = b"filedesc://x 0.0.0.0 19970101 text/plain %d\n" % len(own) + own + b"\nhttp://a.example/ 19970101 3\nabc\n"
    assert list(warc.read_arc([data]))[0][0] == {"URL": "http://a.example/", "Archive-date": "19970101", "Archive-length": "3"}


def test_warc_record_round_trip():
    fields = {"URL": "http://a.example/", "IP-address": "0.0.0.0", "Archive-date": "19991231", "Content-type": "text/html"}
    block = warc.page_block(7, "é".encode() * 600)
    response, revisit = warc.warc_record(fields, block, None), warc.warc_record(fields, block, "<urn:uuid:x>")
    (h1, b1), (h2, b2) = warc.read_warc([response + revisit])
    assert b1 == block and b2 == warc.http_parts(block)[0]
    assert warc.header_value(h1, "WARC-Date") == "1999-12-31T00:00:00Z"
    assert warc.header_value(h2, "WARC-Type") == "revisit" and warc.header_value(h2, "warc-refers-to") == "<urn:uuid:x>"
    assert warc.header_value(h1, "WARC-Payload-Digest") == warc.header_value(h2, "WARC-Payload-Digest") == warc.base32_sha1("é".encode() * 600)


def test_pages_to_warc_and_back(spark, tmp_path):
    long = "x" * 1000
    data = [(1, "http://a.example/", long), (5, "http://b.example/ ü", long), (9, None, long), (2, "http://a.example/", "y" * 999), (3, "u", "y" * 999)]
    data += [(4, "http://c.example/", None), (6, "http://c.example/", ""), (7, "u", "é\r\n\r\nWARC/1.0\r\n" * 200), (None, "n", long), (None, "n", long)]
    pages = with_odd_columns(spark.createDataFrame(data, PAGES)).repartition(3)
    warc.write_arc(pages, str(tmp_path / "arc"))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    found = as_dicts(warc.read_back(spark, str(tmp_path / "warc")))
    ids = {r["record_id"]: r["page_id"] for r in found if r["record_type"] == "response"}
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], ids.get(r["target"])) for r in found)
    want = []
    for page_id, _, html in data:
        payload = (html or "").encode()
        revisit = page_id in (1, 5)
        want.append((str(page_id), len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3]))


def test_repeated_page_rows_and_one_id_under_two_urls(spark, tmp_path):
    """Each page row is one row of the result, and no page revisits itself: as the SQL has it."""
    import duckdb

    long = "h" * 1500
    data = [(5, "A", long), (5, "A", long), (3, "B", long), (7, "C", "small"), (9, "A", "n" * 2000), (9, "B", "n" * 2000), (1, "Z", "n" * 2000), (4, "same", None), (4, "same", None)]
    pages = spark.createDataFrame(data, PAGES)
    pages.repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({warc.OP2_SQL})").fetchall()
    got = [tuple(r[n] for n in names) for r in warc.op2_warc_from_arc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_what_a_foreign_archive_holds_is_kept():
    import hashlib as h

    body = b"HTTP/1.0 404 Not Found\r\n\r\nno"
    lines = [
        (b"dns:a.example 1.2.3.4 19990102030405 text/dns 200 - - 0 x.arc 3", b"ns1"),
        (b"http://a.example/ 1.2.3.4 19990102030405 text/html 404 " + h.md5(body).hexdigest().encode() + b" http://b.example/ 77 x.arc %d" % len(body), body),
        (b"http://a.example/2 1.2.3.4 19990102030405 text/html 404 " + b"0" * 32 + b" - 99 x.arc %d" % len(body), body),
    ]
    data = warc.arc_version_block(2, "x.arc") + b"".join(line + b"\n" + block + b"\n" for line, block in lines)
    records = list(warc.read_arc([data], version_blocks=True))
    made = b"".join(warc.warc_record(f, b, None, f"x.arc#{i}") for i, (f, b) in enumerate(records))
    heads = [h for h, _ in warc.read_warc([made])]
    assert [warc.header_value(h, "WARC-Type") for h in heads] == ["warcinfo", "resource", "response", "response"]
    assert warc.header_value(heads[0], "WARC-Filename") == "x.arc" and warc.header_value(heads[1], "Content-Type") == "text/dns"
    assert [warc.header_value(heads[2], f"X-Arc-{n}") for n in ("Result-code", "Location", "Offset", "Filename")] == ["404", "http://b.example/", "77", "x.arc"]
    assert [warc.header_value(h, "X-Arc-Checksum-Failed") for h in heads] == [None, None, None, "true"]
    assert len({warc.header_value(h, "WARC-Record-ID") for h in heads}) == 4


def test_no_pages(spark, tmp_path):
    warc.write_arc(spark.createDataFrame([], PAGES), str(tmp_path / "arc"))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    assert warc.read_back(spark, str(tmp_path / "warc")).count() == 0


# --- extraction ------------------------------------------------------------------------------------------------------


def page(body: str, n: int = 0) -> str:
    return (
        f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";x({n})</script></head><body><nav><ul><li><a href="/a">Home{n}'
        f'</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy {n}</div><article>{body}</article><footer>&copy; {n}</footer>'
    )


@pytest.mark.parametrize(
    "body, want",
    [
        ("<h1>A &amp; B</h1><p>one\n two<br>three<p>four <b>five<i>six</i></b>", "A & B\n\none two three\n\nfour fivesix"),
        ("", ""),
        ("<p> </p><p>&nbsp;x&#233;&eacute;y </p>", "xééy"),
        ("<header><h1>Title</h1></header><p>x</p><aside>no</aside><form><input>no</form><section class='comments'><p>no</p></section>", "Title\n\nx"),
        ("plain <span>text</span><ul><li>a<li>b</ul>", "plain text\n\na\n\nb"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        ("<p>a < b and c > d</p><p title='>'>e</p>", "a < b and c > d\n\ne"),
        ("<p hidden>no</p><p style='display: none'>no</p><noscript>no</noscript><p>yes</p>", "yes"),
    ],
    ids=range(8),
)
def test_extract_alone_and_by_template(spark, body, want):
    assert H.extract(page(body), None) == want
    assert H.extract(page(body), [">html>body>article"]) == want


def test_text_without_article_element():
    words = " ".join(prose(1, 40).split())
    source = f"<body><div class='top-menu'><a>x</a></div><div id='wrap'><div id='middle'><p>{words}</p><p>more</p></div><div class=sidebar>no</div></div>"
    assert H.extract(source, None) == f"{words}\n\nmore"
    assert H.extract("no markup at all", None) == "no markup at all"
    assert H.extract("<p>open &lt;", None) == "open <"


def test_hosts_have_templates(spark):
    data = [(i, f"http://H.example/{i}", page(f"<h1>T{i}</h1><p>{prose(i, 30)}</p><p>Read on every page</p>", i)) for i in range(30)]
    data += [(100, "http://one.example/", page("<p>alone</p>")), (101, None, page("<p>no url</p>")), (102, "http://h.example/x", "<div>other kind of page</div>")]
    data += [(103, "http://h.example/y", None), (104, "http://h.example/z", ""), (105, "http://h.example/z", page("<p>twice</p>")), (105, "http://h.example/z", page("<p>twice</p>"))]
    pages = with_odd_columns(spark.createDataFrame(data, PAGES)).repartition(4)
    found = as_dicts(H.main_text(pages))
    assert len(found) == len(data)
    texts = {r["page_id"]: r["text"] for r in found}
    for i in range(30):
        assert texts[i] == f"T{i}\n\n{prose(i, 30)}\n\nRead on every page"
    assert [texts[i] for i in range(100, 106)] == ["alone", "no url", "other kind of page", "", "", "twice"]
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert H.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_a_text_of_the_template_goes_with_its_element(spark):
    """By its class: the element around it is there once in every page, for nothing else."""
    share = "<div class=foot><p>Follow the author</p></div>"
    data = [(i, "http://h.example/", page(f"<p>{prose(i, 30)}</p>{share}", i)) for i in range(25)]
    # Without a named slot, by its class alone.
    bare = "<body><div id=a><p>{}</p><p>{}</p><p>Share this</p></div></body>"
    data += [(100 + i, "http://bare.example/", bare.format(prose(i, 60), prose(50 + i, 60))) for i in range(25)]
    texts = {r["page_id"]: r["text"] for r in as_dicts(H.main_text(spark.createDataFrame(data, PAGES).repartition(3)))}
    assert all(texts[i] == prose(i, 30) for i in range(25))
    assert all(texts[100 + i] == f"{prose(i, 60)}\n\n{prose(50 + i, 60)}" for i in range(25))


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_a_sentence_that_all_articles_share_stays(spark, n):
    data = [(i, "http://h.example/", page(f"<p>{prose(i, 30)}</p><p>It is what it is.</p><p>{prose(900 + i, 9)}</p>", i)) for i in range(n)]
    found = as_dicts(H.main_text(spark.createDataFrame(data, PAGES)))
    assert all(r["text"] == f"{prose(r['page_id'], 30)}\n\nIt is what it is.\n\n{prose(900 + r['page_id'], 9)}" for r in found)


def test_names_inside_an_article_count_only_alone():
    body = "<p>a</p><section class='search-history'><p>b</p></section><p class='notice-text'>c</p><div class='share-buttons'>no</div><div class='ad'>no</div><section id='comments-section'>no</section>"
    assert H.extract(page(body), None) == "a\n\nb\n\nc"


def test_copies_are_no_template_and_headings_stay(spark):
    data = [(i, "http://copies.example/", page("<p>one article</p><p>in copies</p>", i)) for i in range(25)]
    data += [(100 + i, "http://heads.example/", page(f"<h2>Abstract</h2><p>{prose(i, 30)}</p><p>Share this</p>", i)) for i in range(25)]
    data += [(200, "http://heads.example/", None), (201, "http://heads.example/", "<div>an error page</div>")]
    texts = {r["page_id"]: r["text"] for r in as_dicts(H.main_text(spark.createDataFrame(data, PAGES).repartition(3)))}
    assert all(texts[i] == "one article\n\nin copies" for i in range(25))
    assert all(texts[100 + i] == f"Abstract\n\n{prose(i, 30)}\n\nShare this" for i in range(25)) and texts[200] == ""


def test_names_that_differ_by_page(spark):
    word = ["".join("abcdefghij"[int(x)] for x in str(i)) for i in range(100, 130)]
    source = "<body><div class=tagline>Constant words</div><main><article id=post-{0}><p>{1}</p><p>end {0}</p></article></main></body>"
    data = [(i, "http://names.example/", source.format(w, prose(i, 30))) for i, w in enumerate(word)]
    texts = {r["page_id"]: r["text"] for r in as_dicts(H.main_text(spark.createDataFrame(data, PAGES).repartition(3)))}
    assert all(texts[i] == f"{prose(i, 30)}\n\nend {w}" for i, w in enumerate(word))


def test_very_long_page():
    body = "".join(f"<p>{i} {'w' * 50}</p>" for i in range(20_000))
    assert H.extract(page(body), None).count("\n\n") == 19_999
