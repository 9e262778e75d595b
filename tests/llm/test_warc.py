import gzip
import os

from corpusmill.llm import warc as W
from llm_helpers import DOCS, docs_of, duck, ordered, tables  # noqa: F401

PAGES = "page_id long, url string, html string"
COLS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _pages():
    texts = ["<p>one</p>", "é" * 3000, "", None, "x\r\n\r\ny", "WARC/1.1\r\n\r\n", "<p>one</p>", "\0"] + ["<html>copy</html>"] * 40 + [f"<p>{i}</p>" for i in range(60)]
    return [(i * 3 % 109, f"http://a.example/{i} é\r\nX: y", t) for i, t in enumerate(texts)]


def brute(pages):
    last = {}
    for i, _, t in pages:
        b = (t or "").encode()
        last[b] = max(last.get(b, i), i)
    return sorted(((i, len(b := (t or "").encode()), W.payload_digest(b), *(("response", None) if last[b] == i else ("revisit", last[b])))
                   for i, _, t in pages), key=repr)


def test_query_round_trip(spark, tables):
    got = W.op6_warc_pages(spark, tables("pages", _pages(), PAGES)).collect()
    assert ordered(got, *COLS) == brute(_pages())


def test_payloads_and_urls_come_back(spark, tmp_path):
    path = str(tmp_path / "a")
    W.write(W.page_records(spark.createDataFrame(_pages(), PAGES)), path, fileBytes="2000")
    back = W.read(spark, path, partitionBytes="3000")
    assert back.rdd.getNumPartitions() > 1
    texts = {i: (t or "").encode() for i, _, t in _pages()}
    for r in back.collect():
        i = int(r.record_id[12:-1])
        assert "\n" not in r.target_uri and r.target_uri.startswith("http://a.example/")
        assert (bytes(r.payload) == texts[i]) if r.record_type == "response" else r.payload is None
        assert r.payload_length == len(texts[i]) and r.payload_digest == "sha1:" + W.payload_digest(texts[i])


def test_predicates_reach_the_headers_and_blocks_stay_shut(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    W.write(W.page_records(spark.createDataFrame(_pages(), PAGES)), path)
    want = [r for r in brute(_pages()) if r[3] == "revisit"]
    some = W.read(spark, path).where("record_type = 'revisit' and refers_to is not null")
    assert some.count() == len(want)
    assert "Filter" not in some._jdf.queryExecution().optimizedPlan().toString()
    # a reader with the same predicate opens no other block
    reader = W.WarcReader({"path": path})
    rest = list(reader.pushFilters([W.EqualTo(("record_type",), "response"), W.StringStartsWith(("target_uri",), "http://a.example/1"), W.EqualTo(("payload",), b"")]))
    assert len(rest) == 1
    opened = []
    keep = W._payload
    monkeypatch.setattr(W, "_payload", lambda h, b: opened.append(h) or keep(h, b))
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == len(opened) > 0 and all(h["warc-type"] == "response" and h["warc-target-uri"].startswith("http://a.example/1") for h in opened)


def test_plain_archives_foreign_members_and_long_headers(spark, tmp_path):
    records = [W.encode_record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:x-page:{i}>", "X-Long": "v" * n}, b"p" * n) for i, n in enumerate((0, 5, 9000, 70_000, 3))]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))  # without a skip length
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(W._member, records)))
    (tmp_path / "_d.warc").write_bytes(b"not finished")
    for f in ("a.warc", "b.warc.gz", "c.warc.gz", ""):
        got = W.read(spark, os.path.join(tmp_path, f)).collect()
        one = sorted([(f"<urn:x-page:{i}>", n) for i, n in enumerate((0, 5, 9000, 70_000, 3))])
        assert sorted((r.record_id, len(r.payload)) for r in got) == sorted(one * (1 if f else 3))
        assert all(r.payload is None for r in W.read(spark, os.path.join(tmp_path, f), payload="skip").collect())


def test_nulls_ties_empty_and_clashing_columns(spark, tmp_path):
    rows = [(None, None, None, 1), (None, "u", "a", 2), (4, "u", "a", 3), (4, "u", "a", 4), (3, None, "a", 5), (5, "", "b", 6), (5, "", "b", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int")
    path = str(tmp_path / "a")
    W.write(W.page_records(df), path)
    got = ordered(W.read(spark, path).collect(), "record_id", "record_type", "refers_to")
    u = lambda i: f"<urn:x-page:{i}>"
    assert got == sorted([(u("null"), "response", None), (u("null"), "revisit", u(4)), (u(4), "response", None), (u(4), "response", None),
                          (u(3), "revisit", u(4)), (u(5), "response", None), (u(5), "response", None)], key=repr)
    W.write(W.page_records(df.limit(0)), str(tmp_path / "b"))
    assert W.read(spark, str(tmp_path / "b")).count() == 0
