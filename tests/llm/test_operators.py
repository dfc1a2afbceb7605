"""Corpus operators against brute force on small fixtures with nulls, empty texts, ties and repeated rows."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caselake.llm import bpe, dac, itq, jaccard, langid, license, media, mixing, sarray, urlrules
from caselake.llm.common import Scratch, build_sieve, connected_components, in_sieve

EN = "the quick brown fox jumps over the lazy dog and runs through the green forest near the old river bank every morning "
DE = "der schnelle braune fuchs springt über den faulen hund und läuft jeden morgen durch den grünen wald am alten fluss "
COMMON = "this passage of more than fifty bytes stands in several of the documents of this fixture "
TEXTS = [
    (0, EN * 3), (1, EN * 3), (2, DE * 3), (3, None), (4, ""), (5, "one two three"), (6, "one two three"), (7, EN + COMMON + DE), (8, "zzz " + COMMON + "yyy  double  blanks\n\n and\ttabs é 日本語"),
    (9, EN * 2 + "with another ending of the text here"), (10, "Licensed under the MIT License. CC BY-NC 4.0, Apache License, Version 2.0"), (11, "<|endoftext|> It's 12345 !!! \U0001f600"), (12, "aaaa" * 50), (13, "aaaa" * 60), (13, "aaaa" * 60),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if t and "fuchs" in t else "en", f"s{i % 3}", "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_removed string")


def test_components_and_sieve(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 7), (3, 20)], "a long, b long")
    got = {r.id: r.component for r in connected_components(e, Scratch(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 8: 8, 9: 8}
    bits = build_sieve(spark.createDataFrame([(0,), (-5,), (1 << 24,)], "k long"), "k")
    assert in_sieve(bits, np.array([0, -5, 1 << 24, 77])).tolist() == [True, True, True, False]


def test_language(spark, docs):
    known = langid.learn(docs.filter("doc_id IN (0, 2)"))
    got = {r.doc_id: r for r in langid.identify(docs, known).collect()}
    assert got[0].lang_pred == "en" and got[2].lang_pred == "de" and 0 <= got[0].score <= 1
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[3].rejected
    assert langid.identify(docs, {}).filter("lang_pred <> 'und'").count() == 0


def test_repeats(spark, docs):
    got = {(r.doc_id, r.n_bytes): tuple(r)[-4:] for r in sarray.cut_repeats(docs, Scratch(spark), sarray.digest, sarray.DIGEST).collect()}
    for i, t in TEXTS:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 49):
            if any(j < i and b[s : s + 50] in (u or "").encode() for j, u in TEXTS):
                covered[s : s + 50] = b"\1" * 50
        left = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(1 for k in range(len(b)) if covered[k] and not (k and covered[k - 1]))
        assert got[i, len(b)] == (len(b), sum(covered), spans, hashlib.sha256(left).hexdigest()), i


def test_jaccard(spark, docs):
    got = {r.doc_id: r for r in jaccard.similar_documents(docs, Scratch(spark)).collect()}
    sets = {}
    for i, t in TEXTS:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), root[i]) for i in sets}


def test_tokens(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, *(lambda ids: (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))(t.encode(x or "", add_special_tokens=False).ids)) for i, x in TEXTS)
    got = bpe.encode(docs.select("doc_id", "text"), Scratch(spark), public_tokenizers.path("word_bpe_49k.json"), bpe.id_and_text_hashes, bpe.HASHES)
    assert sorted(map(tuple, got.collect())) == want


def test_chunk_joins():
    from caselake.llm.tokens import PieceEncoder

    e = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), "dropped")
    rng = np.random.default_rng(2)
    data = "".join("".join(map(chr, rng.integers(97, 123, rng.integers(1, 12)))) + (" " if rng.random() < 0.8 else "\n") for _ in range(2000)).encode()
    known, start = {}, 0
    for end in bpe.cuts(data):
        known[bpe.digest(data[start:end])] = e.encode_all([data[start:end].decode()])[0]
        start = end
    assert len(known) > 1 and bpe.assemble(data, known, e) == e.encode_all([data.decode()])[0]


@pytest.mark.parametrize(("name", "blank"), [("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")])
def test_kept_pieces_change_generations(name, blank):
    from caselake.llm.tokens import PieceEncoder

    path = public_tokenizers.path(name)
    e, t = PieceEncoder(path, blank, keep=20), Tokenizer.from_file(path)
    rng, letters, old = np.random.default_rng(3), "abehnorst", False
    for _ in range(30):
        words = ["".join(rng.choice(list(letters), rng.integers(1, 4))) for _ in range(40)]
        texts = [" ".join(words[:20]), ", ".join(words[20:]) + ".\n", "", "  two  blanks\n x"]
        want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        assert e.encode_all(texts) == want
        old |= bool(e.kept["old"])
    assert old


def test_dac(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    shards = dac.write_shards(docs, Scratch(spark), public_tokenizers.path("byte_bpe_50k.json"), shard_ids=150)
    got = sorted(map(tuple, dac.read_documents(shards).collect()))
    at, want = 0, []
    for i, x in TEXTS:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    ids = np.random.default_rng(1).integers(0, 1 << 20, 3000, dtype=np.uint32)
    s = dac.Shard(dac.pack(ids, np.array([1000, 3000])))
    assert (s.all_ids() == ids).all() and all(s.id_at(k) == ids[k] for k in (0, 1, 511, 512, 513, 1999, 2999))


def test_licenses():
    ordered = license.rules()
    assert len(ordered) > 200
    found = [(a, z, r.label) for a, z, r in license.detect(TEXTS[10][1].encode(), ordered)]
    assert {x[2] for x in found} >= {"mit", "cc-by-nc", "apache-2"}
    assert license.count_words("a-b é日 1".encode()) == 4 and license.detect(b"", ordered) == []


def test_media(spark, docs):
    items = media.read_items('<p>Hi <b>you</b><script>no</script></p><figure><img src="media:sha256/ab"><figcaption>cap</figcaption></figure>tail')
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [(0, "text", "Hi you", None, None), (1, "media", None, "ab", "cap"), (2, "text", "tail", None, None)]
    stored = media.media_table(docs, Scratch(spark))
    got = media.resolve(media.interleave(media.document_figures(docs)), media.facts(stored)).collect()
    want = {(i, hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for i, t in TEXTS}
    assert {(r.doc_id, r.payload_sha256) for r in got} == want and len(got) == len(TEXTS)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://NET/", "https://a.example.net/en/x?y", "ftp://example.com/de/#z", "http://org/fr/", "http://x.org", "http://xnet/", "http://a.net", "x://y.net/?q://org/fr/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.match_urls(pages, urlrules.rules_frame(spark, urlrules.RULES)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("net", "/", "net/", "block") and got[4][2:] == ("example.net/en/", "allow") and got[5][2:] == ("example.com/de/", "block")
    assert got[6][2:] == ("org/fr/", "allow") and got[7][2] is None and got[8][2] is None and got[9][1:3] == ("", None) and got[10][2] == "net/"


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.vstack([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[:5]])
    rows = [(i, v.tolist(), i % 3 if i < 60 else (i - 60) % 3 if i < 80 else (i - 80) % 3) for i, v in enumerate(x)]
    odd = [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0] * 16, None), (204, [], 2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), Scratch(spark)).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (n @ n.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    assert [got[i][0] for i in range(len(x))] == link.sum(axis=1).tolist()
    assert all(got[i] == (0, i) for i, _, _ in odd)


def test_mixing(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 4}" if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(df, block_docs=4, units=100)
    assert got.count() == 3000
    blocks = got.select("source", "block", "slot", "release", "deadline").distinct().collect()
    assert len({b.slot for b in blocks}) == len(blocks) and all(b.release <= b.slot < b.deadline for b in blocks)
    assert mixing.mix(df.limit(0)).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert jaccard.similar_documents(empty, Scratch(spark)).count() == 0
    assert sarray.cut_repeats(empty, Scratch(spark), sarray.digest, sarray.DIGEST).count() == 0
    assert dac.read_documents(dac.write_shards(empty, Scratch(spark), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    assert license.scan(empty).count() == 0 and langid.learn(empty) == {}
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), Scratch(spark)).count() == 0
    assert bpe.encode(empty, Scratch(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0
