import base64
import hashlib

import pytest

from audira.llm import html_text, warc

RECORD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
HOSTILE = [
    (1, "http://a b\r\n/x", f"x{RECORD}y"), (2, None, None), (3, "", ""), (4, "u", "WARC/1.0\r\n" * 50), (5, "u", RECORD * 30), (6, "u", RECORD * 30),
    (7, "u", "é" * 500 + "WARC/1.0\r\nWARC/1.0\r\n" + "z" * 3000), (None, "n", "null page"), (8, "u", "\r\n\r\n" + RECORD), (9, "u", "WARC/1.0\r"),
    (10, "u", "\nWARC/1.0\r\nContent-Length: 9999999\r\n\r\nabc"), (11, "u", "y" * 200_000), (12, "u", "plain"), (13, "u", "plain"), (14, "u", "plain"),
]
SCHEMA = "page_id long, url string, html string"


def expected(rows, min_bytes=0):
    largest = {}
    for i, _, h in rows:
        h = (h or "").encode()
        largest[h] = max(largest.get(h, -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        revisit = len(h) >= min_bytes and largest[h] != (-1 if i is None else i)
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", largest[h] if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_archives_give_back_every_page(spark, clashing, small_splits, min_bytes):
    pages = clashing(spark.createDataFrame(HOSTILE, SCHEMA).repartition(2, "page_id"))
    got = sorted((tuple(r)[:5] for r in warc.warc_report(pages, min_bytes=min_bytes).collect()), key=repr)
    assert got == expected(HOSTILE, min_bytes)


def test_payloads_come_back_whole(spark, small_splits, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_warc(spark.createDataFrame(HOSTILE, SCHEMA).coalesce(1), path)
    records = warc.read_warc(spark, path, with_payload=True).collect()
    assert len(records) == len(HOSTILE)
    text = {i: h or "" for i, _, h in HOSTILE}
    for r in records:
        page = r.record_id.removeprefix("<urn:page:").removesuffix(">")
        if r.record_type == "response" and page != "null":
            assert bytes(r.payload).decode() == text[int(page)]
    assert {r.target_uri for r in records if r.record_id == "<urn:page:1>"} == {"http://a%20b%20%20/x"}


def test_two_readings_may_be_split_differently(spark, small_splits, tmp_path, monkeypatch):
    """Splits follow from settings and cores, which may change between the readings; no payload may go for it."""
    path, second = str(tmp_path / "warc"), warc.read_payloads
    warc.write_warc(spark.createDataFrame(HOSTILE, SCHEMA).coalesce(1), path)

    def later(spark, path, wanted):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "6500")
        return second(spark, path, wanted)

    monkeypatch.setattr(warc, "read_payloads", later)
    for with_payload in (False, True):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        records = warc.read_warc(spark, path, with_payload).collect()
        assert len(records) == len(HOSTILE)
        assert all(r.stated_digest.endswith(r.payload_digest) for r in records if r.record_type == "response")


def test_a_missing_piece_is_an_error(spark, small_splits, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_warc(spark.createDataFrame(HOSTILE, SCHEMA).coalesce(1), path)
    file = warc._chunks(spark, path).first().file
    wanted = spark.createDataFrame([(file, "0" * 32, 5, 5)], "file string, chunk_md5 string, offset long, owner long")
    with pytest.raises(Exception, match="is gone"):
        warc.read_payloads(spark, path, wanted).collect()


def test_files_that_are_no_archives(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.warc").write_text("no archive\n" + RECORD, newline="")
    (tmp_path / "d" / "b.warc").write_text(RECORD + "broken WARC/1.0\r\n" + RECORD, newline="")
    (tmp_path / "d" / "c.warc").write_text("")
    got = warc.read_warc(spark, str(tmp_path / "d")).collect()
    assert [(r.file[-6:], r.offset, r.length) for r in got] == [("b.warc", 0, 5)]


def test_archives_of_nothing_and_of_equal_pages(spark):
    assert warc.warc_report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(3, "u", "same")] * 2 + [(1, "u", "same")]
    got = sorted((tuple(r)[:1] + tuple(r)[3:5] for r in warc.warc_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == [(1, "revisit", 3), (3, "response", None), (3, "response", None)]


PAGES = {
    "": "",
    "<p>a<p>b": "a\nb",
    "plain &amp; <b>text</b>": "plain & text",
    "<body><header><h1>Site</h1></header><main><article><header><h1>Title</h1><p>by me</p></header><p>One <b>two</b><br>three</p><ul><li>x<li>y</ul>"
    "<pre> a\n b</pre><div class='comments'><p>nice</p></div><form>no</form><table><tr><td>c1<td>c2<tr><td>c3</table></article></main><footer>f</footer>": (
        "Title\nOne two three\nx\ny\na b\nc1\nc2\nc3"
    ),
    "<div>a</b>b<span>c</div>d<!-- x <p>no</p> --><script>if(a<b){'</p>'}</script>e&nbsp;&nbsp;f": "abc\nde f",
    "<p title='a>b'>q</p><p>1 < 2 and <3</p>": "q\n1 < 2 and <3",
    "<div class=no-sidebar>kept</div><div id=sidebar>left</div><p hidden>no</p><div style='display: none'>no</div><div role=banner>no</div>": "kept",
    "<p>x<!-- never ends": "x",
    "<p>x</p><a href='": "x",
    "<script>never ends <p>x</p>": "",
}


@pytest.mark.parametrize("source", list(PAGES))
def test_text_of_a_page(source):
    page = html_text.parse(source)
    assert page.text({0}) == PAGES[source]


@pytest.mark.parametrize("source", ["<div>" * 20000 + "x" + "</div>" * 20000, "<b>x" * 20000, "<p>x" * 50000, "<a href='" * 30000, "<" * 50000, "<!--" * 20000, '<a "' * 20001, "&amp" * 20000])
def test_hostile_pages_take_linear_time(source):
    import time

    begin = time.process_time()
    html_text.main_text(source, "body>article")
    assert time.process_time() - begin < 5


def page(kind, i):
    boilerplate = "<nav><a href=/>menu</a></nav><div class='ad-box'>buy</div>"
    side = f"<div class='col{i}'>" + "".join(f"<p>aside {i} {k} and a long line that is not the text of this page at all</p>" for k in range(12)) + "</div>"
    main = f"<div class='text v{i}'><p>main {i}</p><p>second &lt;{i}&gt;</p></div>"
    return f"<html><body>{boilerplate}{main}{side if kind == 'noisy' else ''}<footer>f</footer></body></html>"


def test_hosts_agree_on_the_container(spark, clashing):
    """On one page of ten the largest container is a side column; the votes of the host's other pages keep it out."""
    rows = [(i, f"https://user@WWW.a.example:80/{i}?x", page("noisy" if i == 5 else "plain", i)) for i in range(10)]
    rows += [(20, None, "<p>lone</p>"), (21, "no host", None), (22, "https://b.example", "<main><p>b</p></main>"), (22, "https://b.example", "<main><p>b</p></main>")]
    got = html_text.page_texts(clashing(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 14
    text = {r.page_id: r for r in got}
    for i in range(10):
        assert text[i].text == f"main {i}\nsecond <{i}>" and text[i].host == "www.a.example" and text[i].by_consensus
        assert text[i].n_chars == len(text[i].text)
    assert text[20].text == "lone" and text[21].text == "" and text[21].n_chars == 0 and text[22].text == "b"
    assert html_text.page_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_articles(spark):
    """A heading beside a body, sections of unequal size and classes, and articles inside articles stay together."""
    long, short = "a long line of the text " * 25, "a shorter line " * 30
    held = {
        "body": f"<article><h1>Title</h1><p>Lead</p><div class=body><p>{long}</p></div></article>",
        "sections": f"<article><section class=a><p>{long}</p></section><section class=b><p>{short}</p></section></article>",
        "main": f"<div class=page><main><h1>Title</h1><div class=body><p>{long}</p></div></main><div class=col><p>{short}</p></div></div>",
        "cards": f"<main><p>{short}</p><article><h1>Title</h1><div><article class=card><p>{long}</p></article></div></article></main>",
    }
    want = {"body": f"Title\nLead\n{long.strip()}", "sections": f"{long.strip()}\n{short.strip()}", "main": f"Title\n{long.strip()}", "cards": f"Title\n{long.strip()}"}
    rows = [(i, f"https://{kind}.example/{i}", f"<body><nav>menu</nav>{source}<footer>f</footer></body>") for kind, source in held.items() for i in range(3)]
    got = html_text.page_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.host, r.page_id) for r in got if r.text != want[r.host.split(".")[0]] or not r.by_consensus] == [] and len(got) == len(rows)


def test_forms_and_parts_that_are_text():
    """A page in one form, a lead in a hero banner, a section on related work; search boxes and link lists go."""
    prose = "a long line of the text of this page, one of many. " * 12
    control = "<input name=q><button>Go</button>"
    cases = {
        f"<body><form action=x><input type=hidden><div><p>{prose}</p><p>{prose}</p></div></form></body>": f"{prose.strip()}\n{prose.strip()}",
        f"<body><article><form><label>Search this site</label>{control}</form><p>{prose}</p></article></body>": prose.strip(),
        f"<body><article><div class=hero-banner><p>{prose}</p></div><p>Body</p></article></body>": f"{prose.strip()}\nBody",
        f"<body><article><p>{prose}</p><section class=related-work><h2>Related work</h2><p>{prose}</p></section></article></body>": f"{prose.strip()}\nRelated work\n{prose.strip()}",
        f"<body><article><p>{prose}</p><div class=related>" + "<a href=x>another page to read next</a> " * 9 + "</div></article></body>": prose.strip(),
        f"<body><article><p>{prose}</p><p class=share-price>{prose}</p><div class=share><a href=x>Share</a></div></article></body>": f"{prose.strip()}\n{prose.strip()}",
        f"<body><div class=related><p>{prose}</p></div><article><p>Body</p></article></body>": "Body",
        f"<body><form><p>{prose}": prose.strip(),
    }
    for source, want in cases.items():
        assert html_text.main_text(source, None)[0] == want, source


def test_real_pages(spark, sf_dir):
    """Against the article element of the given pages."""
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = html_text.page_texts(pages).collect()
    assert len(got) == len(source)
    for r in got:
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
