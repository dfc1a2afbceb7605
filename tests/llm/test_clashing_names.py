"""Operators keep columns of the input whatever their names, and take empty tables and nulls."""

import hashlib
import zlib

import public_tokenizers
import pytest

from caselake.llm import bpe, dac, media, mixing, sarray, urlrules
from caselake.llm.common import Scratch


def test_urls(spark):
    pages = spark.createDataFrame([(1, "https://a.example.net/en/x", "mine", "r", 7), (2, None, None, None, None)], "page_id long, url string, _salt string, row string, salt int")
    got = {r.page_id: r for r in urlrules.match_urls(pages, urlrules.rules_frame(spark, urlrules.RULES)).collect()}
    assert (got[1]._salt, got[1].row, got[1].salt, got[1].rule) == ("mine", "r", 7, "example.net/en/") and got[2].verdict == "allow"
    assert urlrules.match_urls(pages.limit(0), urlrules.rules_frame(spark, urlrules.RULES)).count() == 0


def test_mixing_and_weights(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else None, "mine", i) for i in range(300)], "doc_id long, source string, _md5 string, k int")
    out = mixing.mix(docs, block_docs=1).collect()
    assert len(out) == 300 and all(r._md5 == "mine" and r.k == r.doc_id for r in out)
    weights = spark.createDataFrame([("a", 1.0), (None, 3.0)], "source string, weight double")
    first = sorted(mixing.mix(docs, block_docs=1, units=16, weights=weights).collect(), key=lambda r: r.slot)[:16]
    assert 3 <= sum(r.source == "a" for r in first) <= 5


def test_repeats_and_chunks(spark):
    text = "a passage of well over fifty bytes that stands in both of the documents of this test "
    docs = spark.createDataFrame([(1, text * 9, 5, "s", "x", "k"), (2, text * 9 + "end", 6, "t", "y", "l"), (2, None, 7, "u", "z", "m")], "doc_id long, text string, text_hash long, spans string, _doc string, _key string")
    cut = {r.text_hash: r for r in sarray.cut_repeats(docs, Scratch(spark), sarray.digest, sarray.DIGEST).collect()}
    assert cut[6].spans == "t" and cut[6]._doc == "y" and cut[6].n_removed == len(text) * 9 and cut[5].n_removed == 0 and cut[7].n_bytes == 0
    ids = {r.text_hash: r for r in bpe.encode(docs, Scratch(spark), public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert [ids[k]._key for k in (5, 6, 7)] == ["k", "l", "m"] and ids[7].ids == b"" and ids[6].ids.startswith(ids[5].ids)


def test_second_batch_of_a_stored_family(spark, tmp_path):
    passage = "passage of the first batch, long enough to count as a repeat when it comes again "
    root = f"file://{tmp_path}/family"
    for k in range(4):
        docs = spark.createDataFrame([(10 * k, f"{k} " + passage), (10 * k + 1, f"nothing of this stands anywhere else: {k}" * 2)], "doc_id long, text string")
        family = sarray.SuffixFamily(spark, root)
        got = {r.doc_id: r.n_removed for r in sarray.cut_repeats(docs, Scratch(spark), sarray.digest, sarray.DIGEST, batches=1, family=family).collect()}
        assert (got[10 * k] >= len(passage)) == (k > 0) and got[10 * k + 1] >= 0, k
        # equal levels are merged
        assert [n for n, _ in family.levels] == [[1], [2], [2, 1], [4]][k]
    with pytest.raises(ValueError):
        sarray.SuffixFamily(spark, root).add(docs)


def test_shards_of_repeated_rows(spark):
    docs = spark.createDataFrame([(2, "same text"), (2, "same text"), (1, "other"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, dac.read_documents(dac.write_shards(docs, Scratch(spark), public_tokenizers.path("byte_bpe_50k.json"), shard_ids=1)).collect()), key=lambda r: r[1])
    starts, sizes = [r[1] for r in got], [r[2] for r in got]
    assert len(got) == 4 and starts == [sum(sizes[:k]) for k in range(4)] and [r[0] for r in got] == [None, 1, 2, 2]


def test_media_against_plain_python(spark):
    texts = ["", None, "a" * 64, "é" * 100, "text " * 1000, "", "text " * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = media.media_table(docs, Scratch(spark))
    rows = media.resolve(media.interleave(media.document_figures(docs)), media.facts(stored)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        image = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
    page = "<p>one</p><img src=a.png alt=A><p>two</p><figure><img src=b.png><figcaption>B</figcaption></figure><script src=\"x\"/>three"
    assert [(i["kind"], i["text"], i["caption"]) for i in media.read_items(page)] == [("text", "one", None), ("media", "a.png", "A"), ("text", "two", None), ("media", "b.png", "B"), ("text", "three", None)]
