import hashlib
import zlib

from util import AWKWARD, DOCS, by_id, docs_table

from voxtable.llm import media


def test_sequence_keeps_order_positions_and_captions():
    page = ("<h1>Title &amp; more</h1><script>var x='<p>no</p>';</script><p>before <b>bold</b> text"
            "<figure><img src='media:abc' alt='short'><figcaption>A <i>long</i> caption</figcaption></figure>after</p>"
            "<img src='http://x/y.png' alt='alone' data-digest='def'><video src=v.mp4></video><img alt='no source'>")
    got = [(i["position"], i["kind"], i["text"] or i["ref"], i["digest"], i["caption"]) for i in media.parse_page(page)]
    assert got == [(0, "text", "Title & more", None, None), (1, "text", "before bold text", None, None),
                   (2, "image", "media:abc", "abc", "A long caption"), (3, "text", "after", None, None),
                   (4, "image", "http://x/y.png", "def", "alone"), (5, "video", "v.mp4", None, None)]


def test_broken_and_empty_pages():
    assert media.parse_page(None) == [] and media.parse_page("") == []
    assert [i["text"] for i in media.parse_page("<p>a<p>b</div></figcaption><b>c")] == ["a", "b", "c"]
    assert media.parse_page("<![x")[:0] == []


def test_round_trip():
    for raw in (b"", b"a", b"x" * 192, b"\n5\n" * 100, bytes(range(256))):
        payload = media.padded(raw)
        assert len(payload) % 192 == 0 and payload and media.from_image(media.to_image(payload)) == payload
        assert payload.rstrip(b" ") == raw.rstrip(b" ")


def test_report_matches_plain_hashes(spark):
    docs = docs_table(spark, AWKWARD)
    rows = by_id(media.media_report(docs))
    assert len(rows) == len(AWKWARD)
    for r, text in zip(rows, AWKWARD):
        raw = (text or "").encode()
        payload = media.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        stored = media.to_image(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[0]["feature"] == rows[6]["feature"] and rows[1]["feature"] == rows[2]["feature"]
    assert media.media_report(spark.createDataFrame([], DOCS)).count() == 0


def test_interleave_resolves_and_keeps_unresolved(spark):
    kept = media.store_media(docs_table(spark, ["same", "same", "other"]))
    digest = kept.filter("doc_id = 0").first()["digest"]
    pages = spark.createDataFrame(
        [(1, f"<p>x</p><img src='media:{digest}'>"), (2, "<img src='media:gone'>"), (3, None)], "page_id long, html string")
    rows = sorted(media.interleave(pages, media.describe(kept), "page_id").collect(),
                  key=lambda r: (r["page_id"], r["position"]))
    assert [(r["page_id"], r["position"], r["kind"], r["payload_bytes"]) for r in rows] == [
        (1, 0, "text", None), (1, 1, "image", 192), (2, 0, "image", None)]
