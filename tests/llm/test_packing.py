import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from lakeaccord.llm import packing

from .helpers import documents, odd_texts, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tricky():
    rng = random.Random(2)
    letters = "aB9 \n\t'.,é  　ß中<|>s\u0085\x1c"
    random_ones = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    return [*odd_texts(), *random_ones, "don't  <|endoftext|> stop", "<|endoftext|>", "end <|endoftext|> ", *(prose(i, n) for i, n in enumerate((10, 900, 1500, 5000)))]


def test_pieces_and_places(spark):
    texts = tricky()
    found = packing.pack(spark, documents(spark, texts, extra=["task", "rank", "room", "length", "sequence_id"]), PATH, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    of, bins = defaultdict(dict), defaultdict(list)
    for r in found:
        of[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = [of[i][k] for k in range(len(of[i]))]
        assert sum((p["ids"] for p in pieces), []) == ids, repr(text)[:80]
        assert [p["start"] for p in pieces] == list(np.cumsum([0, *(p["length"] for p in pieces)])[:-1])
        assert all(p["length"] == 2048 for p in pieces[1:]) and len(pieces) == -(-len(ids) // 2048)
        assert [p["ids_crc32"] for p in pieces] == [zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in pieces]
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in found)
    assert len(bins) <= -(-total // 2048) + 2


def test_as_few_sequences_as_best_fit(spark):
    rng = np.random.default_rng(4)
    sizes = np.clip(rng.lognormal(5.8, 1.2, 30_000).astype(int), 1, 2048)
    lengths, counts = (x[::-1].tolist() for x in np.unique(sizes, return_counts=True))
    large = [(x, n) for x, n in zip(lengths, counts) if x > 128]
    groups, _ = packing.grouped([x for x, _ in large], [n for _, n in large], packing.GROUPS)
    runs, bins = packing.configurations(groups, 2048)
    items = np.repeat([x for x, _ in large], [n for _, n in large])
    table = np.array(runs)
    at = np.searchsorted(table[:, 0], np.arange(len(items)), "right") - 1
    fill = np.bincount(table[at, 1] + np.arange(len(items)) - table[at, 0], weights=items, minlength=bins)
    assert fill.max() <= 2048 and (fill > 0).all()
    rooms = dict(zip(*(x.tolist() for x in np.unique(2048 - fill.astype(int), return_counts=True))))
    small = [(x, n) for x, n in zip(lengths, counts) if x <= 128]
    placed = packing.best_fit([x for x, _ in small], [n for _, n in small], rooms, 2048)
    rest = np.repeat([x for x, _ in small], [n for _, n in small])
    table = np.array(placed)
    at = np.searchsorted(table[:, 0], np.arange(len(rest)), "right") - 1
    number = table[at, 2] + np.arange(len(rest)) - table[at, 0]
    taken = defaultdict(int)
    for home, k, size in zip(table[at, 1].tolist(), number.tolist(), rest.tolist()):
        taken[home, k] += size
        assert taken[home, k] <= home or home == 0 and taken[home, k] <= 2048
    opened = len({k for home, k in taken if home == 0})
    assert bins + opened <= 1.01 * sizes.sum() / 2048 + 1


@pytest.mark.parametrize("texts", [[], [None], ["", "", ""], ["one two"] * 50])
def test_small_and_equal_tables(spark, texts):
    docs = documents(spark, texts)
    found = packing.pack(spark, docs, PATH).collect()
    assert len(found) == len(texts)
    assert len({r["sequence_id"] for r in found}) == min(1, len(texts))
    assert sorted(r["offset"] for r in found) == list(np.cumsum([0] + [r["length"] for r in found])[: len(texts)])


def test_rows_without_id_and_repeated_rows_are_packed(spark):
    docs = documents(spark, ["a b", "c"])
    found = packing.pack(spark, docs.union(docs).union(spark.createDataFrame([(None, "d", None, None, None)], docs.schema)), PATH).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["0", "0", "1", "1", "None"]
    assert sorted(r["offset"] for r in found)[0] == 0 and len({(r["sequence_id"], r["offset"]) for r in found}) == 5
