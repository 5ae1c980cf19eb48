import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from galena.llm import packing

ODD = ["a\x1cb  c d́ ́x ΑΣ ΟΔΟΣ İI don't's it's. 'S He'LL, x' y'. <|endoftext|> x<|startoftext|>y \t\v z q", None, "", "a\x01b \x01 c", "\n \n", "H̱. ẖ, Ḵ!?", "ab.-c. d-. 1. 1a. a1. ﬁ. ǅ, ª. ʰ! ...a", "_a_ a_. <|endoftext|>. <|ENDOFTEXT|>. A.́ a.́b", "word " * 9000]


def reference_ids(text):
    t = Tokenizer.from_file(packing.TOKENIZER)
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def encoder():
    with open(packing.TOKENIZER, encoding="utf-8") as f:
        return packing.Encoder(f.read())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30) | st.text("aB' .,<|>\n\x01éΣ1_", max_size=30), min_size=1, max_size=5))
def test_parts_give_the_ids_of_the_whole(texts):
    import pyarrow as pa

    e = encoder()
    ids, cuts = e(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(by_seq)


def test_pieces_and_places(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "null id", ""), (3, "a\x01b \x01 c", ""), (0, ODD[0], "")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string"), ids=True).collect()
    assert check_packing(got) == -(-sum(r["length"] for r in got) // 4096)
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for doc_id, text in enumerate(ODD):
        parts = sorted(found[doc_id], key=lambda r: r["piece"])
        want = reference_ids(text)
        if doc_id in (0, 3):
            assert len(parts) == 2 and parts[0]["ids"] == parts[1]["ids"] == want
            continue
        assert [r["piece"] for r in parts] == list(range(len(parts))) and [r["start"] for r in parts] == [i * 4096 for i in range(len(parts))]
        assert sum((r["ids"] for r in parts), []) == want


def test_empty_table(spark):
    assert packing.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 300) | st.integers(1, 9), min_size=1, max_size=20))
def test_configurations_place_all_pieces(counts):
    h = np.zeros(61, np.int64)
    for k, n in counts.items():
        h[k] = n
    placed = Counter()
    bins = 0
    priced, fitted, bound, value = packing.configurations(h)
    for config, times in priced + fitted:
        assert sum(k * a for k, a in config.items()) <= 60 and times > 0
        bins += times
        for k, a in config.items():
            placed[k] += a * times
    assert placed == Counter(counts)
    assert bound <= bins <= sum(n for _, n in packing.best_fit(h)) and value >= bound - 1 - 1e-6
    assert sum(n for _, n in packing.best_fit(h)) == one_by_one(h)


def one_by_one(h):
    rooms = []
    for k in range(len(h) - 1, 0, -1):
        for _ in range(int(h[k])):
            fits = [r for r in rooms if r >= k]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - k)
            else:
                rooms.append(len(h) - 1 - k)
    return len(rooms)


def test_plan_is_near_the_bound():
    lengths = np.clip(np.random.default_rng(0).lognormal(6.3, 1.1, 60_000).astype(int), 1, 4096)
    plan = packing.make_plan(np.bincount(lengths, minlength=4097))
    assert plan.sequences <= 1.001 * np.ceil(lengths.sum() / 4096)


@pytest.mark.parametrize("n", [100, 1000, 60_000])
def test_priced_configurations_make_the_plan(n):
    """At any size sequences come from the program, and the plan is never worse than best fit's."""
    lengths = np.clip(np.random.default_rng(n).lognormal(6.3, 1.1, n).astype(int), 1, 4096)
    h = np.bincount(lengths, minlength=4097)
    plan = packing.make_plan(h)
    best = sum(k for _, k in packing.best_fit(h))
    assert plan.priced >= 0.05 * plan.sequences and plan.bound <= plan.sequences <= best
    assert plan.bound >= lengths.sum() / 4096 and plan.value <= 1.02 * plan.bound + 1


def test_the_bound_is_more_than_the_tokens():
    """Pieces of which no two share a sequence: the prices show that each needs one."""
    h = np.zeros(101, np.int64)
    h[[51, 52, 60]] = 40, 30, 50
    plan = packing.make_plan(h)
    assert plan.sequences == 120 and plan.bound == 120


def test_knapsack_against_all_choices():
    rng = np.random.default_rng(3)
    price = np.where(rng.random(31) < 0.4, rng.random(31) * np.arange(31), 0)
    best = np.zeros(31)
    for c in range(1, 31):
        best[c] = max([best[c - 1]] + [price[k] + best[c - k] for k in range(1, c + 1)])
    assert np.allclose(packing.prices_to_values(price)[0], best)
