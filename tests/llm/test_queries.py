"""The queries over the smallest tables: whole tables in, one row for each document out, and the columns that are agreed."""

import random
import zlib

import public_tokenizers
import pytest

from weftline.llm import packing, queries, simhash

COLUMNS = {
    "op3_token_counts": ["doc_id", "n_tokens"],
    "op5_substring_dedup": ["doc_id", "n_removed", "removed", "kept_sha256"],
    "op7_simhash": ["doc_id", "fingerprint", "component_id"],
    "op8_quality": ["doc_id", "lang", "n_bytes", "perplexity", "threshold", "keep"],
    "op9_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_each_document(spark, data, texts, name):
    out = queries.QUERIES[name](spark, data)
    assert out.columns == COLUMNS[name]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name == "op7_simhash":
        assert all(r.fingerprint == f"{simhash.fingerprint(texts[r.doc_id].encode()):016x}" for r in rows)
    if name == "op10_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)


def test_packed_pieces_hold_every_id_once(spark, data, texts):
    rows = queries.op4_packing(spark, data).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    encode = packing.Encoder(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS), public_tokenizers.PATTERN)
    for d, own in by_doc.items():
        ids = encode.exact.encode(texts[d], add_special_tokens=False).ids + [packing.END_ID]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length])
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_both_libraries_give_the_same_ids():
    encode = packing.Encoder(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS), public_tokenizers.PATTERN)
    rng = random.Random(17)
    plain = [chr(i) for i in range(0x250)] + list("‐‑‒–—―‖‗‘’‚‛“”„‟†‡•‣․‥…‧€")
    words = ["'s", "don't", " 12", "\r\n", "  ", "\t", "été", "Straße", "x_y", "1,000.50", "'LL", " ", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choice(plain) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randrange(1, 40)))
        assert encode(text).tolist() == encode.exact.encode(text, add_special_tokens=False).ids, repr(text)
