import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lorespark.llm import best_fit, token_output
from lorespark.llm.tokenizer import document_ids, encoder
from tests.llm.helpers import awkward, frame, prose


def test_ids_equal_the_tokenizers_library():
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["", "a", " " * 50, "x" * 3000, "<|endoftext|> é😀\n\n  ß", "a<|endoftext|>b <|endoftext|><|endoftext|> <|endoftext|", "<|endoftext|>" * 700, prose(rng, 500), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(2000))]
    for text in texts:
        assert document_ids(text) == reference.encode(text, add_special_tokens=False).ids + [2]
    assert document_ids(None) == [2]


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    for capacity in (10, 31, 1024):
        counts = {n: rng.choice([0, 1, 2, 7, 300]) for n in range(1, capacity + 1) if rng.random() < 0.5}
        runs = defaultdict(list)
        for length, rank, sequence, offset in sorted(best_fit.plan(counts, capacity)):
            runs[length].append((rank, sequence, offset))
        filled = defaultdict(list)
        for length, n in counts.items():
            ends = [r[0] for r in runs[length]][1:] + [n]
            for (rank, sequence, offset), end in zip(runs[length], ends):
                for k in range(end - rank):
                    filled[sequence + k].append((offset, length))
        assert sum(length for parts in filled.values() for _, length in parts) == sum(length * n for length, n in counts.items())
        for parts in filled.values():
            place = 0
            for offset, length in sorted(parts):
                assert offset == place
                place += length
            assert place <= capacity


def test_packing_keeps_every_token(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(0, 900)) for _ in range(60)] + [None, "", "same", "same"]
    docs = frame(spark, texts)
    rows = best_fit.best_fit_packing(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in enumerate(texts):
        ids, place = document_ids(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["piece"]):
            assert r["start"] == place and (r["length"] == 1024 or r["piece"] == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[place:place + r["length"]], dtype="<u4").tobytes())
            place += r["length"]
        assert place == len(ids)
    total = 0
    for parts in by_sequence.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 1024
        total += place
    assert len(by_sequence) <= -(-total // 1024) + 2
    assert len(best_fit.best_fit_packing(awkward(spark)).select("sequence_id", "offset").distinct().collect()) == best_fit.best_fit_packing(awkward(spark)).count()
    assert best_fit.best_fit_packing(frame(spark, [])).count() == 0


def test_segment_tree_finds_the_tightest_row():
    rng = random.Random(4)
    tree, kept = token_output.FreeCapacities(100), Counter()
    for row in range(3000):
        if rng.random() < 0.6:
            free = rng.randrange(1, 101)
            tree.add(free, row)
            kept[free] += 1
        else:
            least = rng.randrange(1, 101)
            want = min((f for f in kept if kept[f] and f >= least), default=None)
            got = tree.take(least)
            assert (got[0] if got else None) == want
            if got:
                kept[want] -= 1


def test_token_rows_round_trip(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(0, 1500)) for _ in range(40)] + ["é😀 ß", "", "y" * 9000]
    rows = token_output.token_rows(frame(spark, texts), width=512, window_tokens=20_000).collect()
    pieces = defaultdict(list)
    for r in rows:
        ids, ends = np.frombuffer(r["ids"], dtype="<u2"), r["cu_seqlens"]
        assert len(ids) == 512 and ends[0] == 0 and ends[-1] == r["n_tokens"] <= 512 and list(r["resets"]) == list(ends[:-1])
        for doc_id, start, a, b in zip(r["doc_ids"], r["starts"], ends, ends[1:]):
            pieces[doc_id].append((start, ids[a:b].tolist()))
    for doc_id, text in enumerate(texts):
        ids = [i for _, part in sorted(pieces[doc_id]) for i in part]
        assert ids == document_ids(text) and encoder().decode(ids[:-1]) == text
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert sum(len(r["doc_ids"]) for r in token_output.token_rows(awkward(spark)).collect()) >= 12
    assert token_output.token_rows(frame(spark, [])).count() == 0
