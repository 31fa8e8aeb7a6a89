import os
import random

import pytest

from legajo.llm import packing, tokens

needs_files = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.FOLDER, tokens.VOCABULARY)), reason="no vocabulary files")
TEXTS = [None, "", " ", "El año 2030: ¿qué pasó?", "<|endoftext|>x", "aaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 3001, "\n\n \t x", "日本語と한국어", "é \U0001f600 I'll we've", "palabra " * 5000]


@needs_files
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.FOLDER, tokens.VOCABULARY))
    t.encode_special_tokens = True
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abeñ '’.\n　Ω😀") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "text as ids")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.token_ids(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


@needs_files
def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    back = {r["doc_id"]: r["text"] for r in tokens.decoded(tokens.token_ids(df)).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}


def check(rows, sizes, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["container"], []).append(r)
    for items in by.values():
        items.sort(key=lambda r: r["place"])
        assert [r["place"] for r in items] == list(range(1, len(items) + 1))
        at = 0
        for r in items:
            assert r["start"] == at
            at += r["n_tokens"]
        assert at <= capacity
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["offset"] == whole.get(r["doc_id"], 0)
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["n_tokens"]
    assert whole == {k: v or 0 for k, v in sizes.items()}
    for k, v in sizes.items():
        assert sum(r["doc_id"] == k for r in rows) == max(1, -(-(v or 0) // capacity))
    assert set(by) == set(range(1, len(by) + 1))
    return len(by)


def best_fit_decreasing(sizes, capacity):
    """Containers that plain best fit over single pieces needs."""
    pieces = [min(capacity, n - a) for n in sizes for a in range(0, n, capacity)]
    spaces = []
    for n in sorted(pieces, reverse=True):
        fits = [i for i, s in enumerate(spaces) if s >= n]
        if fits:
            spaces[min(fits, key=lambda i: spaces[i])] -= n
        else:
            spaces.append(capacity - n)
    return len(spaces)


def test_packing(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice([None, 0, 1, 7, 7, 7, 50, 99, 100, 101, rng.randint(1, 350)]) for i in range(500)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    caps = spark.createDataFrame([(1, 100), (1, 100), (2, 64), (3, 0), (None, 5)], "capacity_id int, capacity_tokens int")
    rows = packing.pack(df, caps).collect()
    for c, capacity in ((1, 100), (2, 64)):
        used = check([r for r in rows if r["capacity_id"] == c], sizes, capacity)
        assert used == best_fit_decreasing([v or 0 for v in sizes.values()], capacity)
    assert {r["capacity_id"] for r in rows} == {1, 2}
    assert packing.pack(df.limit(0), caps).count() == 0


def test_plan_is_small_and_exact():
    h = {n: 1_000_000_007 + n for n in range(1, 513)}
    plan = packing.best_fit_plan(h, 512)
    assert len(plan) < 20_000
    placed = {}
    for length, a, b, *_ in plan:
        assert a == placed.get(length, 0)
        placed[length] = b
    assert placed == h
    with pytest.raises(ValueError):
        packing.best_fit_plan({513: 1}, 512)
