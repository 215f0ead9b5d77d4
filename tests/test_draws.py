"""Draws of whole arrays against MD5 key by key, and packed strata against joined ones."""

import hashlib

import numpy as np
import pytest

from jostle.functions import draws
from jostle.operators import inference as I


@pytest.mark.parametrize("head, blocks, middle, slots", [
    ("101:", range(8, 13), ":", 1234), ("", range(0, 1), ":", 1), ("7:", range(99, 102), ":ä label:", 101),
    ("a" * 70, range(0, 2), ":b:", 12), ("a" * 30, range(998, 1001), "b" * 80, 20_011),
])
def test_numbers_are_those_of_md5(head, blocks, middle, slots):
    words = draws.md5_words(head, blocks, middle, slots)
    for i, block in enumerate(blocks):
        for s in {*range(0, slots, max(1, slots // 60)), slots - 1}:
            text = hashlib.md5(f"{head}{block}{middle}{s}".encode()).hexdigest()
            assert "".join(int(w[i, s]).to_bytes(4, "little").hex() for w in words) == text
            assert draws.leading(words)[i, s] == int(text[:8], 16)
            assert [draws.indices(words, p, slots)[i, s] for p in (0, 1)] == [int(text[16 * p : 16 * p + 15], 16) % slots for p in (0, 1)]


def test_parts_cover_all_blocks_once():
    assert [b for part in draws.spans(range(3, 4000), 70_000) for b in part] == list(range(3, 4000))


@pytest.mark.parametrize("piece", [500_000, 7])
def test_packed_strata_equal_joined_ones(spark, monkeypatch, piece):
    monkeypatch.setattr(I, "PIECE_KEYS", piece)
    r = np.random.default_rng(3)
    data = [(k % 3, None if k == 50 else f"l{k % 2}", k, None if k % 17 == 0 else float(r.normal()), float(k % 5)) for k in range(130)]
    values = spark.createDataFrame(data, "g long, label string, source_id long, v double, w double")
    sides = []
    for limit in (None, 0):
        means = I.bootstrap_means(values, ["v", "w"], 45, 3, ["g"], ["label"], pack_rows=limit).collect()
        flips = I.signflip_test(values, "v", 67, 5, ["g"], pack_rows=limit).collect()
        alone = I.signflip_test(values, "v", 67, 5, pack_rows=limit).collect()
        low = I.within_label_permutation(values.where("label is not null"), "v", "w", "label", 40, 5, pack_rows=limit).collect()
        sides.append([sorted(tuple(round(c, 9) for c in row) for row in part) for part in (means, flips, alone, low)])
    assert sides[0] == sides[1]


def test_a_piece_reads_few_rows_and_only_sums_leave_it(spark, monkeypatch):
    monkeypatch.setattr(I, "PIECE_KEYS", 100)
    values = spark.range(50).selectExpr("id AS source_id", "cast(id AS double) AS v", "7 AS seed")
    packed = I._packed(values, [], ["v"], "source_id", None, "seed")
    seen = I._drawn(packed, [], 41, [], "first long, blocks long", lambda row, blocks: [I.pa.array([blocks.start]), I.pa.array([len(blocks)])]).collect()
    assert sorted(map(tuple, seen)) == [(k, min(2, 41 - k)) for k in range(0, 41, 2)]
