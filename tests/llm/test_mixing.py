import random

import pytest

from tramline.llm.mixing import default_tokenizer, mix_shares, mixed_documents, with_tokens

DOCS = "doc_id bigint, text string, source string, tokens int, copies int, p string"
TARGETS = "source_name string, target_share double, max_repeats int"


def corpus(spark, sizes, seed=9):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["stop", "line", "quai", s]) for _ in range(rng.randrange(3, 120))), s, 0, 0, "") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, DOCS)


def test_shares_are_reached_and_caps_kept(spark):
    docs = corpus(spark, {"a": 900, "b": 300, "c": 40, "other": 50})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("none", 0.05, 3)], TARGETS)
    mixed = mixed_documents(docs, targets)
    assert mixed.count() == 1290
    got = {r.source_name: r for r in mix_shares(mixed, targets).collect()}
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(got[s].share - want / 0.95) < 0.01 and got[s].most_copies <= {"a": 1, "b": 2, "c": 4}[s]
    assert got["none"].share == 0 and "other" not in got
    assert got["c"].most_copies == 4  # the source that bounds the mix is used as often as it may be


def test_a_larger_total_leaves_small_sources_at_their_cap(spark):
    docs = corpus(spark, {"a": 400, "c": 5})
    targets = spark.createDataFrame([("a", 0.5, 3), ("c", 0.5, 2)], TARGETS)
    tokens = {r.source: r.t for r in with_tokens(docs).groupBy("source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "t").collect()}
    got = {r.source_name: r for r in mix_shares(mixed_documents(docs, targets, total=2.0 * tokens["a"]), targets).collect()}
    assert got["c"].tokens_used == 2 * tokens["c"] and abs(got["a"].tokens_used / tokens["a"] - 1) < 0.02


def test_documents_without_a_source_follow_their_text(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["red", "warm"] if i % 2 else ["blue", "cold"]) for _ in range(60)), None if i >= 400 else "ab"[i % 2], 0, 0, "") for i in range(500)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    got = mixed_documents(spark.createDataFrame(rows, DOCS), targets).where("source is null")
    assert got.where("copies = 1").count() > 90


def test_tokens_round_trip(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(default_tokenizer()[0], "rb"))}
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["L'été <|endoftext|> à 5:30", "", None, "word " * 9000, "a" * 150_000, "x\n\t  y " * 40_000 + " " * 120_000 + "end", " " * 150_000, "q" * 99_999 + "  w " * 9]
    got = {r.doc_id: r.tokens for r in with_tokens(spark.createDataFrame([(i, t, None, 0, 0, "") for i, t in enumerate(texts)], DOCS)).collect()}
    assert [got[i] for i in range(len(texts))] == [len(coder.encode_ordinary(t or "")) for t in texts]
    assert coder.decode(coder.encode_ordinary(texts[0])) == texts[0]


@pytest.mark.parametrize("rows", [[], [(1, None, "a", 0, 0, ""), (2, "", None, 0, 0, ""), (None, "x", "a", 0, 0, "")]])
def test_nothing_to_mix(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for t in ([], [("a", 1.0, 2)], [(None, None, None), ("a", None, None)]):
        assert mixed_documents(docs, spark.createDataFrame(t, TARGETS)).where("copies > 0").collect() == []


def test_every_posterior_counts(spark):
    """Documents without a source whose text tells little are used as far as they belong, and a threshold is off by default."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["red", "warm", "x"] if i % 2 else ["blue", "cold", "x"]) for _ in range(40)), "ab"[i % 2], 0, 0, "") for i in range(400)]
    rows += [(i, " ".join(["x"] * 20 + [rng.choice(["red", "blue"])]), None, 0, 0, "") for i in range(400, 460)]
    rows += [(460, "x y", None, 0, 0, ""), (460, "x y", None, 0, 0, "")]
    docs, targets = spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("empty", 0.2, 3)], TARGETS)
    mixed = mixed_documents(docs, targets)
    soft = mixed.where("source is null").collect()
    assert len(soft) == 62 and all(abs(sum(r.p) - 1) < 1e-6 and r.p[2] == 0 for r in soft) and any(0.05 < max(r.p) < 0.95 for r in soft)
    assert sum(r.copies for r in soft) > 30
    got = {r.source_name: r.share for r in mix_shares(mixed, targets).collect()}
    assert abs(got["a"] - got["b"]) < 0.02 and got["empty"] == 0
    assert mixed_documents(docs, targets, confident=1.1).where("source is null and copies > 0").count() == 0
