"""What counts as equal: long words whose polynomials are equal, and many rows of one vector."""

import numpy as np
import pyarrow as pa
import pytest

from lemmata.llm import ann, common, neardup, packing


def thue_morse(n):
    """A word of n letters and its complement; their polynomials modulo 2**64 are equal in every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_hashes_of_complementary_words(n):
    one, other = thue_morse(n)
    data, offsets = common.text_buffers(pa.array([one, other, one, "a", ""]))
    for base in packing._BASES:
        h = common.substring_hashes(data, offsets, base)
        assert h[0] == h[2] and len(set(h.tolist())) == 4
    _, _, words = common.runs(data, offsets, np.ones(len(data), bool))
    assert words[0] == words[2] and len(set(words.tolist())) == 3


@pytest.mark.parametrize("n", [1024, 4096])
def test_near_duplicates_of_complementary_words(spark, n):
    one, other = thue_morse(n)
    rows = [(1, one), (2, other), (3, f"{one} x {other} x"), (4, other)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=2, similarity=80).collect()}
    assert got == {1: (1, 1, True), 2: (1, 2, True), 3: (3, 3, True), 4: (1, 2, False)}


@pytest.mark.parametrize("n", [1024, 4096])
def test_ids_of_complementary_words(n):
    encoder = packing.Encoder(packing.default_tokenizer())
    for word in (*thue_morse(n), thue_morse(n)[0]):  # in slices of their own, as the parts are kept between them
        ids, offsets = encoder(pa.array([word, "then"]))
        assert ids[: offsets[1]].tolist() == encoder.tokenizer.encode(word, add_special_tokens=False).ids


def test_neighbours_of_a_repeated_own_id(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(0, same)] * 7 + [(1, same)] + [(2, [1.0, 2.0, 2.9]), (3, [1.0, 2.0, 2.8])] + [(4, same)] * 9
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame([(0, same)], "vec_id long, embedding array<double>"), k=3).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 4), (3, 4)]
    got = ann.search(spark.createDataFrame(rows[:8] + rows[8:10], "vec_id long, embedding array<double>"), spark.createDataFrame([(0, same)], "vec_id long, embedding array<double>"), k=5).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3]
