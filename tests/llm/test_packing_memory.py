import random
import tracemalloc

import numpy as np
import pyarrow as pa

from marlstone.functions.parts import text_parts
from marlstone.llm import packing


def invented(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(4, 12))) for _ in range(n)]


def test_a_remembered_word_takes_little_memory():
    encoder = packing.Tokens(packing.default_tokenizer())
    texts = [" ".join(invented(k, 2000)) + ".\n" for k in range(40)]
    tracemalloc.start()
    for text in texts:
        encoder.encode([text])
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(encoder.number) > 70_000
    assert held < 300 * len(encoder.number)


def test_forgetting_changes_no_ids(monkeypatch):
    encoder = packing.Tokens(packing.default_tokenizer())
    words = [*invented(1, 300), "naïve", "über.", "Straße", "3.14", "don't", "C++", "...", "x!"]
    texts = [" ".join(random.Random(k).choices(words, k=120)) + random.Random(k).choice(["", ".", "\n", " \n \n"]) for k in range(60)]
    texts += ["", "\n", "one line\nand  another.\r\n\r\n", "日本語 beside words.", "<|endoftext|>"]
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
    whole = encoder.encode(texts)
    assert whole[0].tolist() == sum(want, [])
    monkeypatch.setattr(packing, "REMEMBER", 50)
    monkeypatch.setattr(packing, "LEARN", 7)
    few, forgot = packing.Tokens(packing.default_tokenizer()), 0
    for text, ids in zip(texts, want):
        known = len(few.number)
        got = few.encode([text])
        forgot += len(few.number) < known
        fresh = packing.Tokens.encode(encoder, [text])
        assert got[0].tolist() == ids
        assert all(np.array_equal(a, b) for a, b in zip(got, fresh))
    assert forgot


def test_texts_of_a_batch_become_pythons_part_by_part():
    texts = ["aaa", None, "éé", "c" * 20, "", "d", None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "t": pa.array(texts, pa.string())})
    got = [p.column(1).to_pylist() for p in text_parts(iter([batch, batch.slice(0, 0)]), 1, 5)]
    assert got == [["aaa", None, "éé"], ["c" * 20], ["", "d", None]]
