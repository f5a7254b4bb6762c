import hashlib
import zlib

from symptomlake.llm import media


def test_positions_and_captions():
    page = ("<title>T</title><p>one &amp; <b>two</b></p><script>no()</script><figure><img src='a.png' alt='x'>"
            "<figcaption>The <i>caption</i></figcaption></figure>tail<img data-digest='ff' title='t'><br>end")
    items = media.parse_page(page)
    assert [i["position"] for i in items] == list(range(len(items)))
    assert [(i["kind"], i["text"] or i["src"] or i["digest"], i["caption"]) for i in items] == [
        ("text", "T", None), ("text", "one & two", None), ("media", "a.png", "The caption"), ("text", "tail", None),
        ("media", "ff", "t"), ("text", "end", None)]
    assert media.parse_page(None) == [] and media.parse_page("<p>a<i>b")[0]["text"] == "ab"


def test_picture_round_trip():
    for raw in (b"", b"a", b"a\x00", bytes(range(256)) * 9, b"x" * 64):
        samples, n = media.from_png(media.to_png(raw))
        assert n == len(raw) and samples[:n] == raw and not any(samples[n:])
        assert len(samples) % 64 == 0 and len(samples) >= 64 and len(samples) - len(raw) <= 64
    assert media.to_png(b"a") != media.to_png(b"a\x00")


def test_documents(spark):
    rows = [(1, "<p>a & b</p>\n\n<img src=x>", 0), (2, "", 0), (3, None, 0), (4, "é" * 5000, 0), (4, "é" * 5000, 0), (None, "z", 0)]
    out = media.document_media(spark.createDataFrame(rows, "doc_id long, text string, digest int")).collect()
    assert len(out) == len(rows)
    text = dict((i, t or "") for i, t, _ in rows)
    for r in out:
        raw = text[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        png = media.to_png(raw)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert f"sum={sum(payload)} " in r.feature and r.caption == f"payload {hashlib.sha256(png).hexdigest()[:12]}"
    assert len({r.feature for r in out if r.doc_id in (2, 3)}) == 1


def test_references_without_payload_stay(spark):
    pages = spark.createDataFrame([(1, "<img src='sha256:aa'>x<img src='b'>"), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("aa", 7)], "digest string, n int")
    rows = media.resolve(media.references(media.sequences(pages)), store).orderBy("position").collect()
    assert [(r.page_id, r.position, r.digest, r.n) for r in rows] == [(1, 0, "aa", 7), (1, 2, None, None)]


def shown(page):
    return [i["text"] or f"{i['src']}={i['caption']}" for i in media.parse_page(page)]


def test_broken_markup_loses_no_text():
    assert shown("<figure><img src=a><figcaption>cap<p>more</figure><p>after</p>") == ["a=cap more", "after"] or \
        shown("<figure><img src=a><figcaption>cap<p>more</figure><p>after</p>") == ["a=capmore", "after"]
    assert shown("<figcaption>loose</figcaption><p>text") == ["loose", "text"]
    assert shown("<figure><figcaption>no media</figcaption></figure>end") == ["no media", "end"]
    assert shown("<figure><img src=a><figcaption>open<section>next</section>") == ["a=open", "next"]
    assert shown("<figure><img src=a><figcaption>one</figcaption><figcaption>two</figcaption></figure>") == ["a=one", "two"]
    assert shown("<noscript>shown after all <p>x") == ["shown after all x"] or shown("<noscript>shown after all <p>x") == ["shown after all", "x"]
    assert shown("<noscript>gone</noscript>kept<template>gone</template>") == ["kept"]
    assert shown("a<script>var x = '<p>no</p>'") == ["a"] and shown("</figure></figcaption></noscript>b<figure>") == ["b"]
    assert shown("<p>" + "word " * 200_000 + "<figcaption>end") == [" ".join(["word"] * 200_000), "end"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media.document_media(empty).count() == 0
    assert media.sequences(spark.createDataFrame([], "page_id long, html string")).count() == 0
