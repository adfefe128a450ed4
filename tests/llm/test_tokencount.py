import random
import re

import public_tokenizers
from tokenizers import Tokenizer, models

from weftline.llm import tokencount

from .corpora import edge_rows, empty, frame, words

PATH = public_tokenizers.path("piece_bpe_32k.model")


def exact():
    pieces, _ = tokencount.model_pieces(PATH)
    return Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True)), pieces


def split_specials(text):
    """The library cuts a text at the strings of special tokens; the counter reads them as characters."""
    return [x for x in re.split(r"(</?s>|<unk>|<0x[0-9A-F]{2}>)", text) if x]


def test_counts_match_the_library(spark):
    tokenizer, pieces = exact()
    rng = random.Random(6)
    rows = [*((r[0], r[1]) for r in edge_rows()), *((100 + i, t) for i, t in enumerate([words(rng, 50), "Hello,  world  ", "  \n\n x", "漢字 🙂 é", "a < b and c > d <s", "aaaaaaaaaaaaaaaa", "▁▁ ▁a", "tab\tand\rreturn", words(rng, 3000).replace(" ", ""), "漢字" * 2000]))]
    _, skipped = tokencount.model_pieces(PATH)
    found = {r.doc_id: r.n_tokens for r in tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), pieces, skipped).collect()}
    for d, t in rows:
        assert len(split_specials(t or "")) <= 1
        assert found[d] == (len(tokenizer.encode("▁" + t.replace(" ", "▁")).ids) if t else 0), (d, (t or "")[:80])
    assert tokencount.token_counts(empty(spark), pieces, skipped).count() == 0
    assert tokencount.token_counts(frame(spark, edge_rows()), pieces, skipped).count() == len(edge_rows())


def test_special_strings_are_characters():
    pieces, skipped = tokencount.model_pieces(PATH)
    counter = tokencount.Counter(pieces, skipped)
    assert counter.count("<s>") > 1 and counter.count("<0x0A>") > 1


def test_memory_of_long_units_is_bounded(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(tokencount, "REMEMBERED", 100_000)
    pieces, skipped = tokencount.model_pieces(PATH)
    counter, rng = tokencount.Counter(pieces, skipped), random.Random(1)
    text = "".join(rng.choice("abcdefghij") for _ in range(300_000))
    tracemalloc.start()
    whole = counter.viterbi(text)
    assert tracemalloc.get_traced_memory()[1] < 6 * len(text)
    tracemalloc.stop()
    assert whole > 30_000
    for i in range(5000):
        counter.count(f"unit{i}")
    assert counter.held <= 101_000 and len(counter) < 800


def test_query_counts_every_document(spark, data):
    from weftline.llm import queries

    tokenizer, _ = exact()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op3_token_counts(spark, data).collect():
        t = texts.pop(r.doc_id)
        if len(split_specials(t or "")) <= 1:
            assert r.n_tokens == (len(tokenizer.encode("▁" + t.replace(" ", "▁")).ids) if t else 0)
    assert not texts


def test_ties_and_unknowns_match_on_small_vocabularies():
    rng = random.Random(1)
    for _ in range(300):
        alphabet = "ab▁"
        vocab = {"<unk>": 0.0}
        for _ in range(rng.randrange(1, 12)):
            vocab["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5)))] = float(-rng.randrange(4))
        pieces = list(vocab.items())
        tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
        counter = tokencount.Counter(pieces, [True] + [False] * (len(pieces) - 1), byte_fallback=False)
        for _ in range(10):
            text = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 12)))
            assert counter.count(text) == len(tokenizer.encode("▁" + text.replace(" ", "▁")).tokens), (pieces, text)
