"""Extraction on planted pages, alignment against brute force, derived records and round trips."""

import json
import random

from plumbline.llm import pages, warc


def test_structure():
    page = (
        "<html><head><title>t</title></head><body><header>H</header><nav>N</nav><div class='cookie-notice'>C</div><article><header><h1>T &amp; u</h1></header>"
        "<p>a <b>x</b>y\n  z<p>second<script>if(a<b)</script><form>F</form><aside>S</aside><section id=comments><p>c</section></article><footer>f</footer>"
    )
    assert pages.main_text(pages.lines(page), None) == ("T & u\n\na xy z\n\nsecond", 0)
    assert pages.main_text(pages.lines(""), None) == ("", 0)
    assert pages.lines("&lt;b&gt; &am <b") == [(pages.ELSEWHERE, "<b> &am")]


def test_alignment_is_longest():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pages.shared(a, b)) == best[-1][-1]


def test_differencing_deletes_what_neighbours_share(spark):
    frame = "<body><div>Site line</div><div>%s</div><div>Bottom line</div></body>"
    rows = [(k, f"http://h.example/a/{k}", frame % f"own {k}", "x") for k in range(4)] + [(9, None, None, "x"), (10, "http://lone.example/", frame % "lone", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [got[k][0] for k in range(4)] == [f"own {k}" for k in range(4)]
    assert got[9] == ("", 0) and got[10][0] == "Site line\n\nlone\n\nBottom line"
    assert pages.extract(df.where("false")).count() == 0


def plain_extract(rows):
    """The rule page by page, in plain terms."""
    keyed = sorted((*pages.url_key(u), i, u, pages.lines(h or "")) for i, u, h in rows)
    out = []
    for k, (host, path, i, u, own) in enumerate(keyed):
        lo, hi = k, k
        while lo and keyed[lo - 1][0] == host and keyed[lo - 1][4] == own:
            lo -= 1
        while hi + 1 < len(keyed) and keyed[hi + 1][0] == host and keyed[hi + 1][4] == own:
            hi += 1
        near = [keyed[x] if 0 <= x < len(keyed) and keyed[x][0] == host else None for x in (lo - 1, hi + 1)]

        def start(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        pick = near[0] or near[1]
        if near[0] and near[1] and start(near[1][1], keyed[hi][1]) > start(near[0][1], keyed[lo][1]):
            pick = near[1]
        gone = pages.shared([t for _, t in own], [t for _, t in pick[4]]) if pick else set()
        left = [(p, t) for j, (p, t) in enumerate(own) if p == pages.ARTICLE or j not in gone]
        best = pages.ARTICLE if any(p == pages.ARTICLE for p, _ in left) else pages.ELSEWHERE
        out.append((i, u, "\n\n".join(t for p, t in left if p == best), len(own) - len(left)))
    return sorted(map(str, out))


def test_whole_query_by_brute_force_however_dealt(spark):
    r = random.Random(6)
    rows = [(x.page_id, x.url, x.html) for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    site = ["Home", "About us", "Terms", "Mail us", "Top stories"]
    for k in range(160):
        own = [f"own words {r.randrange(40)}" for _ in range(r.randint(0, 3))]
        body = "".join(f"<div>{x}</div>" for x in (*site[: r.randint(1, 5)], *own, *site[r.randint(2, 5) :]))
        rows.append((10_000 + k, f"http://h{r.randrange(2)}.example/{r.choice('ab')}/{r.choice('cd')}{r.randrange(30)}", body))
    rows += [(20_000 + k, f"http://copies.example/{k:02d}", "<p>same</p><div>all</div>") for k in range(40)] + [(30_000, "http://copies.example/99", "<p>same</p>more")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = plain_extract(rows)
    for n in ("1", "4", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = [(x.page_id, x.url, x.text, x.n_shared) for x in pages.extract(df).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert sorted(map(str, got)) == want, n
    table = {x[0]: x for x in got if x[0] < 10_000}
    print("lines that differencing deletes on sf0.01:", sum(x[3] for x in table.values()))
    assert sum(x[3] for x in table.values()) > 0


def test_very_long_page(spark):
    page = "<nav>" + "<a href=x>menu</a>" * 50_000 + "</nav><article>" + "<p>word and word</p>" * 100_000 + "</article>" + "<" * 200_000
    df = spark.createDataFrame([(1, "http://a.example/1", page), (2, "http://a.example/2", page)], "page_id long, url string, html string")
    assert [r.n_chars for r in pages.extract(df).collect()] == [100_000 * 15 - 2] * 2


def test_derived_records(spark):
    df = spark.createDataFrame(
        [(1, "http://a.example/x", '<title>T</title><a href="y?a&amp;b">l</a><p>Text é</p>', 1), (2, None, None, 2), (2, None, None, 2)],
        "page_id long, url string, html string, kind int",
    )
    responses = warc.responses_of(df)
    rows = warc.build(responses).collect()
    assert len(rows) == 6
    one = {r.kind: r for r in rows if r.page_id == 1}
    meta = json.loads(one["metadata"].block.decode())
    assert meta["title"] == "T" and meta["links"] == [{"path": "a", "url": "http://a.example/y?a&b"}] and meta["status"] == "HTTP/1.1 200 OK"
    assert one["conversion"].block.decode() == "l\nText é" and one["metadata"].refers_to == one["conversion"].refers_to
    block = bytes(responses.where("page_id = 1").first().block)
    assert one["conversion"].refers_to == warc.record_id("response", "http://a.example/x", "2024-01-01T00:00:00Z", warc.digest(block))
    for r in rows:
        assert r.headers["WARC-Block-Digest"] == warc.digest(bytes(r.block)) and r.headers["Content-Length"] == str(len(r.block))
    members = [bytes(r.bytes) for r in warc.write_warc(warc.build(responses)).collect()]
    back = list(warc.parse(b"".join(members)))
    assert sorted(h["WARC-Record-ID"] for h, _ in back) == sorted(r.record_id for r in rows)
    assert sorted(b for _, b in back) == sorted(bytes(r.block) for r in rows)


def test_read_warc(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(warc.to_bytes({"WARC-Type": "response", "Content-Length": "3"}, b"abc"))
    assert [bytes(r.block) for r in warc.read_warc(spark, str(tmp_path)).collect()] == [b"abc"]


def test_from_archive_to_derived_records(spark, tmp_path):
    import gzip
    import zlib

    page = "<p>Text é".encode() * 50
    packed = gzip.compress(page)
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (packed[:20], packed[20:])) + b"0\r\n\r\n"
    raw = zlib.compress(page)[2:-4]
    bodies = {
        "gz": (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n", chunked), "zl": (b"Content-Encoding: deflate\r\n", zlib.compress(page)),
        "raw": (b"Content-Encoding: deflate\r\n", raw), "br": (b"Content-Encoding: br\r\n", b"\x01\x02"), "plain": (b"Content-Encoding: gzip\r\n", page),
    }
    data = b""
    for name, (extra, body) in bodies.items():
        block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n" + extra + b"\r\n" + body
        head = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:{name}>", "WARC-Target-URI": f"http://x.example/{name}", "WARC-Date": "2020-01-01T00:00:00Z",
                "WARC-IP-Address": "10.0.0.1", "WARC-Payload-Digest": "sha1:SOURCE", "WARC-Block-Digest": "sha1:BLOCK", "Content-Length": str(len(block))}
        data += warc.to_bytes(head, block)
    data += warc.to_bytes({"WARC-Type": "request", "Content-Length": "0"}, b"")
    (tmp_path / "a.warc").write_bytes(data)
    rows = warc.build(warc.responses_from(warc.read_warc(spark, str(tmp_path)))).collect()
    assert len(rows) == 10
    for r in rows:
        name = r.target_uri.rsplit("/")[-1]
        assert r.refers_to == f"<urn:{name}>" and r.headers["WARC-IP-Address"] == "10.0.0.1" and r.headers["WARC-Payload-Digest"] == "sha1:SOURCE"
        if r.kind == "conversion":
            assert bytes(r.block).decode() == ("" if name == "br" else warc.plain_text(page.decode())), name
        else:
            meta = json.loads(bytes(r.block))
            assert meta["headers"][:2] == [["Set-Cookie", "a=1"], ["Set-Cookie", "b=2"]] and ["WARC-Block-Digest", "sha1:BLOCK"] in meta["source-headers"]
            assert meta["encoding-left"] == ("br" if name == "br" else "")


def test_neighbours_across_tasks_and_copies(spark):
    frame = "<body><div>Site line</div><div>%s</div><div>Bottom line</div></body>"
    rows = [(k, f"http://h.example/a/{k:03d}", frame % f"own {k // 3}") for k in range(60)] + [(100 + k, f"http://i.example/{k}", frame % "same") for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        for n, coalesce in (("1", "true"), ("7", "false"), ("40", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set(key, coalesce)
            got = {r.page_id: r.text for r in pages.extract(df).collect()}
            assert got == {k: f"own {k // 3}" for k in range(60)} | {100 + k: "Site line\n\nsame\n\nBottom line" for k in range(3)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set(key, "true")
