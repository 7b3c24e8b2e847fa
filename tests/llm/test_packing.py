import random
import zlib

import numpy as np
import pytest

from tidemark.llm.packing import best_fit, encoder, pack
from tests.llm.helpers import docs

P = pytest.importorskip("public_tokenizers")
VOCAB = P.path("byte_bpe_50k.json")


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


@pytest.mark.parametrize("text", ["", " ", "  two  spaces\n\nlines \t end ", "it's we'll I'd", "a<|endoftext|>b <|endoftext|>", "Ünïcödé 漢字 ½ ² ٣ 🙂🙂", "x_y__z 123abc 4.5", "   odd　", "don’t", "\x1c\x1f\x85"])
def test_ids_equal_the_tokenizers_library(text):
    assert encoder(VOCAB)(text).tolist() == reference().encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_equals_one_by_one():
    for seed in range(30):
        rng = random.Random(seed)
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        fill = {}
        for length, _, items, low, each, offset in best_fit(counts, capacity):
            for i in range(items):
                b = fill.setdefault(low + i // each, [])
                b.append((offset + i % each * length, length))
        for parts in fill.values():
            parts.sort()
            assert [p[0] for p in parts] == list(np.cumsum([0, *[p[1] for p in parts[:-1]]]))
        assert sorted(capacity - sum(p[1] for p in parts) for parts in fill.values()) == plain_best_fit(lengths, capacity)


def test_pack(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x"), (4, "word " * 5000)] + [(10 + i, "many small words " * (i % 90)) for i in range(300)]
    got = pack(docs(spark, rows), VOCAB).collect()
    ref = reference()
    want = sorted((d if d is not None else -1, zlib.crc32(np.array([*ref.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())) for d, t in rows if len(ref.encode(t or "").ids) < 2048)
    whole = sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in got if r.doc_id != 4)
    assert whole == want
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 4)
    assert [r[2] for r in long[1:]] == [2048] * (len(long) - 1) and sum(r[2] for r in long) == len(ref.encode("word " * 5000).ids) + 1
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) == len(plain_best_fit([r.length for r in got], 2048))
    assert pack(docs(spark, []), VOCAB).count() == 0


def test_ids_equal_the_library_on_random_strings():
    rng, encode, library = random.Random(8), encoder(VOCAB), reference()
    pools = ["abc '’st \n\t", "0123 ½²٣ _-.,!", "äöüßéèñ ÀÉ", "漢字かなカナ한국어", "\u2028\u3000\xa0\x85\x1c\x1d ", "🙂👩‍💻🇩🇪\u0301\u200d", "<|endoftext|>", "".join(map(chr, range(0x250, 0x3400, 37)))]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 30)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
