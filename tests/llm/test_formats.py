import io
import json
import re
import struct
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from helpers import ODD, empty, prose, table, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm import piece_sampler, sharding, textkit, token_store, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=900), st.integers(1, 9))
def test_coder_round_trip(ids, lanes):
    ids = np.array(ids, np.uint16)
    tokens, counts = np.unique(ids, return_counts=True)
    t = token_store.Table(tokens, counts)
    assert t.freqs.sum() == 1 << token_store.BITS and (t.freqs > 0).all()
    stream, x, marks = token_store.encode_ids(t, ids, lanes)
    starts = [(0, 0, x), *marks]
    assert (token_store.decode_ids(t, stream, starts, len(ids), lanes) == ids).all()
    for i in range(len(starts)):  # a decoder may start at any checkpoint, or use a few of them
        step, at, _ = starts[i]
        later = [(a - step, b - at, c) for a, b, c in starts[i::2]]
        assert (token_store.decode_ids(t, stream[at:], later, len(ids) - step * lanes, lanes) == ids[step * lanes :]).all()
    if marks:
        bad = [(t_, at, s + np.uint64(1)) if i == len(starts) - 1 else (t_, at, s) for i, (t_, at, s) in enumerate(starts)]
        with pytest.raises(ValueError):
            token_store.decode_ids(t, stream, bad, len(ids), lanes)


def thue_morse(order, a="a", b="b"):
    x, y = a, b
    for _ in range(order):
        x, y = x + y, y + x
    return x, y


def test_strings_that_defeat_polynomial_hashes(spark):
    x, y = thue_morse(10)
    long = ["a" * 5000 + x, "a" * 5000 + y, "b" * 100_000 + x]
    texts = [x, y, x + " " + y, y.upper(), *long]
    library = Tokenizer.from_file(WORD_BPE)
    rows = token_store.read_blocks(*token_store.write_blocks(table(spark, texts), WORD_BPE)).where("doc_id is not null").collect()
    assert {r.doc_id: r.ids for r in rows} == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    coded = piece_sampler.decode(piece_sampler.encode(table(spark, texts), PIECES), PIECES).collect()
    assert all(r.decoded == r.text for r in coded)
    hashed = textkit.words(*textkit.buffers(pa.array(texts)), textkit.NOT_SPACE, False).hash
    assert len(set(hashed.tolist())) == 6  # the third text repeats two words


def test_equal_hashes_of_other_bytes_are_told_apart():
    known = textkit.ByteTable(4)
    buf = np.frombuffer(b"abcdefghi abcdefghj xy", np.uint8)
    start, end = np.array([0, 10, 20, 0]), np.array([9, 19, 22, 9])
    same = np.full(4, 7, np.uint64)
    number, reps = known.add(same, buf, start, end)
    assert number[0] == number[3] and len(set(number.tolist())) == 3 and sorted(reps.tolist()) == [0, 1, 2]
    got = known.find(same, buf, start, end)
    assert set(got.tolist()) <= {-1, *number.tolist()} and all(g in (-1, n) for g, n in zip(got, number))


@pytest.mark.parametrize("piece", [3, 7, 64])
def test_pieces_and_slices_do_not_show(monkeypatch, piece):
    texts = [*[t or "" for t in ODD], prose(1, 200), "x" * 300 + " y", "", prose(2, 30)]
    buf, off = textkit.buffers(pa.array(texts))
    whole = [textkit.words(buf, off, mask, fold) for mask in (textkit.NOT_SPACE, textkit.ALNUM) for fold in (False, True)]
    grams = [textkit.grams(whole[0].hash, k) for k in (1, 2, 3, 5, 7, 25, 50)]
    monkeypatch.setattr(textkit, "PIECE", piece)
    cut = [textkit.words(buf, off, mask, fold) for mask in (textkit.NOT_SPACE, textkit.ALNUM) for fold in (False, True)]
    for a, b in zip(whole, cut):
        assert all((getattr(a, k) == getattr(b, k)).all() for k in ("start", "end", "hash", "first"))
    assert all((a == textkit.grams(whole[0].hash, k)).all() for a, k in zip(grams, (1, 2, 3, 5, 7, 25, 50)))
    want = [m.encode() for t in texts for m in words(t, fold=False)]
    raw = buf.tobytes()
    assert [raw[a:b] for a, b in zip(whole[0].start, whole[0].end)] == want


def test_damaged_block_is_noticed():
    ids = np.arange(500, dtype=np.uint16) % 7
    t = token_store.Table(np.arange(7), np.ones(7))
    raw = token_store.pack_block(t, [1, None], np.array([200, 300]), ids)
    assert (token_store.Block(raw).decode(t) == ids).all() and token_store.Block(raw).doc_ids == [1, None]
    with pytest.raises(ValueError):
        token_store.Block(raw[:60] + bytes([raw[60] ^ 1]) + raw[61:])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé'sdt.,!<|>1 \ń ẞΣ#\x00\x1c​"), max_size=25), max_size=4))
def test_chunked_tokens_equal_whole_texts(texts):
    texts = [*texts, "it's <|endoftext|> <|ENDOFTEXT|> x,y"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, first = token_store._coder(WORD_BPE).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    whole = [e.ids for e in Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == whole


def test_token_store_against_the_library(spark):
    docs = table(spark, [*ODD, prose(1, 300)])
    rows = token_store.read_blocks(*token_store.write_blocks(docs, WORD_BPE)).collect()
    library, at = Tokenizer.from_file(WORD_BPE), 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert token_store.read_blocks(*token_store.write_blocks(empty(spark), WORD_BPE)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t ▁\U0001f600日\x00"), max_size=40))
def test_pieces_are_lossless(text):
    sampler = piece_sampler._sampler(PIECES, 0.7)
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, first = sampler.sample(raw, np.array([0, len(raw)]), np.array([5], np.uint64))
    back, _ = piece_sampler.decode_ids(sampler.p, ids, first)
    assert back.tobytes().decode() == text
    assert sentencepiece.SentencePieceProcessor(model_file=PIECES).decode(ids.tolist()) == text


def test_long_chunks_are_drawn_alike(monkeypatch):
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("abcdefghé"), 700)), "日本語の文章" * 90, "x" * 400, "a b " + "".join(r.choice(list("etaoin"), 300))]
    buf, off = textkit.buffers(pa.array(texts))
    seeds = np.array([5, 6, 7, 8], np.uint64)
    p = piece_sampler.Pieces(PIECES)
    want = piece_sampler.Sampler(p).sample(buf, off, seeds)
    monkeypatch.setattr(piece_sampler, "LONG", 100)
    monkeypatch.setattr(piece_sampler, "_STRIDE", 64)
    got = piece_sampler.Sampler(p).sample(buf, off, seeds)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_sampling_follows_the_lattice():
    sampler = piece_sampler._sampler(PIECES, 0.7)
    p, full = sampler.p, "▁then"
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = {model.id_to_piece(i): i for i in range(model.vocab_size())}
    found = []

    def walk(i, done):
        if i == len(full):
            found.append(tuple(done))
        for j in range(i + 1, len(full) + 1):
            if full[i:j] in ids:
                walk(j, [*done, ids[full[i:j]]])

    walk(0, [])
    weight = np.array([np.exp(p.log[list(s)].sum()) for s in found])
    n = 8000
    raw = np.frombuffer(b"then" * n, np.uint8)
    out, first = sampler.sample(raw, np.arange(n + 1) * 4, np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    drawn = [tuple(out[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    share = np.array([drawn.count(s) / n for s in found])
    assert abs(share.sum() - 1) < 1e-9 and np.abs(share - weight / weight.sum()).max() < 0.03


def test_piece_columns(spark):
    docs = table(spark, ODD)
    coded = piece_sampler.decode(piece_sampler.encode(docs, PIECES), PIECES)
    rows = {r.doc_id: r for r in coded.collect()}
    assert all(r.decoded == r.text for r in rows.values()) and rows[0].ids is None and rows[1].ids == []
    again = {r.doc_id: r.ids for r in piece_sampler.encode(docs.repartition(3), PIECES).collect()}
    assert again == {k: r.ids for k, r in rows.items()}
    both = {r.doc_id: r for r in piece_sampler.round_trip(docs, PIECES).collect()}
    assert all(r.lossless and r.ids == again[k] for k, r in both.items())
    assert piece_sampler.round_trip(empty(spark), PIECES).count() == 0


def test_communication_matrix_sums_and_mean():
    rows, sizes = np.array([5, 0, 17, 8]), sharding.shard_sizes(30, 4)
    draws = np.array([sharding.communication_matrix(rows, sizes, s) for s in range(400)])
    assert (draws.sum(axis=2) == rows).all() and (draws.sum(axis=1) == sizes).all()
    assert np.abs(draws.mean(axis=0) - rows[:, None] * sizes / 30).max() < 0.4


@pytest.mark.parametrize("n", [1, 7, 40])
def test_shards_are_exact(spark, n):
    docs = table(spark, [*ODD, *["same"] * 90]).repartition(5)
    rows = sharding.digest(sharding.shuffle_into_shards(docs, n)).collect()
    assert len(rows) == len(ODD) + 91 and {r.law for r in rows} == {"rows"}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    assert sharding.shuffle_into_shards(empty(spark), n).count() == 0


def test_shards_leave_other_columns_alone(spark, monkeypatch):
    names = ["_key", "_range", "_offset", "_rank", "_place", "_n", "key", "range", "offset", "rank", "place", "n", "Shard2"]
    docs = spark.createDataFrame([(i, f"t{i}", *[f"{c}{i}" for c in names]) for i in range(50)], ", ".join(["doc_id long", "text string", *[f"{c} string" for c in names]]))
    monkeypatch.setattr(sharding, "RANGE_BYTES", 300)
    out = sharding.shuffle_into_shards(docs.withColumns({"shard": F.lit("old"), "slot": F.lit("old")}), 3)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert sorted(map(tuple, out.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    for s in range(3):
        slots = sorted(r.slot for r in out.collect() if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (16, 17)


def test_shards_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 4)
    rows = sharding.shuffle_into_shards(spark.range(101).withColumnRenamed("id", "doc_id"), 3).collect()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    places = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert places != sorted(places)


def test_warc_derivatives(spark, tmp_path):
    page = '<html><head><title>A &amp; B</title><meta name=d content=c><script>no</script></head><body><p>One<p>two <a href="/x">three</a><br>four</body></html>'
    pages = spark.createDataFrame([(1, "http://a/b", page, 9), (2, None, None, 9), (3, "http://c\r\nX: y", "<![if x]>odd", 9)], "page_id long, url string, html string, record int")
    source = warc.responses(pages)
    rows = {(r.page_id, r.warc_type): r for r in warc.derivatives(source).collect()}
    assert len(rows) == 6 and all(r.digest_ok for r in rows.values())
    text, meta = rows[1, "conversion"], rows[1, "metadata"]
    assert text.content == "One\ntwo three\nfour" and text.title == "A & B" and text.n_links == 1
    about = json.loads(meta.content)
    assert about["HTML-Metadata"]["links"] == [{"path": "a@/href", "url": "/x"}] and about["HTTP-Response-Metadata"]["Status"] == "HTTP/1.1 200 OK"
    assert rows[2, "conversion"].content == "" and rows[2, "conversion"].target_uri is None
    raw = {r.page_id: bytes(r.record) for r in source.collect()}
    for k in raw:
        (headers, block), = warc.records(raw[k])
        for kind in ("conversion", "metadata"):
            (made, data), = warc.records(bytes(rows[k, kind].record))
            assert warc.value(made, "WARC-Refers-To") == warc.value(headers, "WARC-Record-ID")
            assert warc.value(made, "WARC-Payload-Digest") == warc.value(headers, "WARC-Payload-Digest")
            assert warc.value(made, "WARC-Block-Digest") == warc.sha1(data) and int(warc.value(made, "Content-Length")) == len(data)
        assert (warc.value(made, "WARC-Concurrent-To") == rows[k, "conversion"].record_id)
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in raw.values()))
    (tmp_path / "b.warc").write_bytes(b"".join(raw.values()) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut")
    again = warc.read_warc(spark, str(tmp_path))
    assert again.where("skipped = 0").count() == 6 and warc.derivatives(again, "source").count() == 12
    assert [r.skipped > 0 for r in again.where("record is null").collect()] == [True]
    assert warc.derivatives(source.where("false")).count() == 0


def plain_records(data):
    """A reader of its own: header lines, then as many bytes as they say."""
    out, stream = [], io.BytesIO(data)
    while (line := stream.readline()):
        if line.strip() != b"WARC/1.1":
            assert not line.strip()
            continue
        head = {}
        while (line := stream.readline().strip()):
            k, _, v = line.partition(b":")
            head[k.strip().lower()] = v.strip()
        out.append((head, stream.read(int(head[b"content-length"]))))
    return out


def test_derivatives_read_by_another_reader(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").limit(60)
    html = {r.page_id: r.html for r in pages.collect()}
    source = {r.page_id: bytes(r.record) for r in warc.responses(pages).collect()}
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 2 * len(html)
    for r in made:
        (head, block), = plain_records(source[r.page_id])
        payload = block.split(b"\r\n\r\n", 1)[1]
        assert payload == html[r.page_id].encode()
        (own, data), = plain_records(bytes(r.record))
        for name in (b"warc-target-uri", b"warc-date", b"warc-payload-digest"):
            assert own[name] == head[name]
        assert own[b"warc-refers-to"] == head[b"warc-record-id"] != own[b"warc-record-id"] and own[b"warc-type"] == r.warc_type.encode()
        if r.warc_type == "conversion":
            assert data.decode() == r.content and "<p" not in r.content
            shown = re.sub(r"(?is)<(script|style|noscript|template|svg|iframe|object)\b.*?</\1>|<title.*?</title>|<!--.*?-->", " ", html[r.page_id])
            bare = lambda x: "".join(x.split())
            assert bare(unescape(re.sub(r"<[^>]*>", " ", shown))) == bare(r.content)
        else:
            told = json.loads(data)
            assert told["Envelope"]["Payload-Length"] == len(payload) and dict(told["Envelope"]["WARC-Header-Metadata"])["WARC-Record-ID"].encode() == head[b"warc-record-id"]


def test_damaged_records_cost_themselves_alone(spark, tmp_path):
    page = lambda i: warc.response(f"http://x/{i}", str(i), f"<p>page {i} {prose(i, 40)}".encode())
    inner = warc.serialize([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:x:1>")], page(7) + b"more")  # a block with records in it
    shorter = page(2).replace(b"Content-Length: ", b"Content-Length: 1", 2)
    cases = {"long": shorter, "none": page(2).replace(b"\r\nContent-Length:", b"\r\nLength:"), "odd": page(2).replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x"), "huge": re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: 99999999999\r\n\r\nHTTP", page(2)), "small": re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: 7\r\n\r\nHTTP", page(2))}
    for name, bad in cases.items():
        data = page(1) + bad + inner + page(3)
        got = list(warc.records(data))
        assert [warc.value(h, "WARC-Target-URI") for h, _ in got] == ["http://x/1", None, "http://x/3"], name
        assert got[1][1] == page(7) + b"more"
        (tmp_path / f"{name}.warc").write_bytes(data)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 4 * len(cases) and sum(r.record is None for r in rows) == len(cases)
    assert all(r.skipped > 100 for r in rows if r.record is None)


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>T</title><p>Hello", "Hello"), ("<head><title>T</title>Hello <b>you", "Hello you"), ("<head><meta name=a content=b><script>no</script>\n<style>no</style><div>Hello", "Hello"),
    ("<head><noscript><p>no</noscript><title>T</title></head>Hello", "Hello"), ("<head><title>T</title><svg><text>no</text></svg>Hello", "Hello"),
])
def test_head_ends_without_its_tag(page, text):
    assert warc.page_text(page)[0] == text


def test_codings_are_undone(spark):
    import gzip

    page = ("<p>Grüße an alle" + " und viele Wörter" * 50).encode()
    raw = zlib.compressobj(wbits=-15)
    chunk = lambda x: b"".join(b"%x;a=b\r\n%s\r\n" % (len(x[i : i + 99]), x[i : i + 99]) for i in range(0, len(x), 99)) + b"0\r\n\r\n"
    cases = [
        ("Content-Encoding: gzip", gzip.compress(page)), ("content-encoding: x-gzip", gzip.compress(page[:40]) + gzip.compress(page[40:])), ("Content-Encoding: deflate", zlib.compress(page)),
        ("Content-Encoding: deflate", raw.compress(page) + raw.flush()), ("Transfer-Encoding: chunked", chunk(page)), ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunk(gzip.compress(page))),
        ("Transfer-Encoding: gzip, chunked", chunk(gzip.compress(page))), ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", page), ("Content-Encoding: identity", page), ("Content-Encoding: br", b"unknown"),
    ]
    rows = []
    for i, (header, payload) in enumerate(cases):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{header}\r\n\r\n".encode() + payload
        digest = warc.sha1(gzip.compress(page) if i == 5 else payload)  # as the standard has it: transfer coding undone
        rows.append((i, warc.serialize([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{i}>"), ("WARC-Payload-Digest", digest)], block)))
    found = warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    want = page.decode().removeprefix("<p>")
    assert {r.page_id: r.content for r in found if r.warc_type == "conversion"} == dict.fromkeys(range(9), want)
    assert len(found) == 19 and all(r.digest_ok for r in found)


def test_communication_matrix_beyond_numpys_sampler(monkeypatch):
    rows = np.array([700_000_000, 0, 3_000_000_000, 5, 1_300_000_002])
    sizes = sharding.shard_sizes(int(rows.sum()), 7)
    got = sharding.communication_matrix(rows, sizes, 3)
    assert (got.sum(axis=1) == rows).all() and (got.sum(axis=0) == sizes).all() and (got >= 0).all()
    assert np.abs(got - rows[:, None] * sizes / rows.sum()).max() < 10 * 3e9**0.5
    monkeypatch.setattr(sharding, "SAMPLER_ROWS", 0)  # the law, where it can be counted
    from math import comb

    for good, bad, n in ((7, 5, 6), (3, 40, 20), (1, 1, 2), (0, 9, 4), (9, 0, 4), (30, 2, 31)):
        rng = np.random.default_rng(good)
        seen = np.bincount([sharding._hypergeometric(rng, good, bad, n) for _ in range(4000)], minlength=n + 1) / 4000
        assert np.abs(seen - [comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(n + 1)]).max() < 0.035
    test_communication_matrix_sums_and_mean()
