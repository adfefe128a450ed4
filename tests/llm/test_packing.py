import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weftline.llm import packing

from .corpora import edge_rows, empty, frame, words


def test_every_id_once_in_gapless_sequences(spark):
    rng = random.Random(8)
    rows = [*((r[0], r[1]) for r in edge_rows()), *((100 + i, words(rng, rng.randrange(900))) for i in range(300)), (500, "a <|endoftext|> b"), (501, "漢字 и кириллица 🙂")]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(d, []).append(ids)
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got, sequences = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= 1024
        assert zlib.crc32(p.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        got.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    for d, texts in want.items():
        copies = len(texts)
        for n in {len(x) for x in texts}:
            same = [x for x in texts if len(x) == n]
            parts = sorted(got[d, n])
            assert sum(len(x) for _, x in parts) == n * len(same)
            if copies == 1:
                assert [i for _, x in parts for i in x] == same[0]
    assert packing.pack(empty(spark)).count() == 0
    assert packing.pack(frame(spark, edge_rows())).count() >= len(edge_rows())


def test_differencing_is_balanced_and_complete():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randrange(1, 513) for _ in range(rng.randrange(1, 300))]
        k = rng.randrange(1, 40)
        groups = packing.differencing(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
        assert len(groups) == k
        if len(sizes) > 8 * k:
            sums = [sum(sizes[i] for i in g) for g in groups]
            assert max(sums) - min(sums) <= 64


def test_windows_rise_until_all_fit_and_are_nearly_full():
    rng = random.Random(4)
    assert packing.windows([]) == []
    assert packing.windows([1024, 1024, 1]) and all(len(g) == 1 for g in packing.windows([1024, 1000, 900]))
    sizes = [rng.randrange(1, 513) for _ in range(1024)]
    found = packing.windows(sizes)
    assert max(sum(sizes[i] for i in g) for g in found) <= 1024
    assert sum(sizes) / 1024 / len(found) > 0.97
