"""Values after an equals sign are tested as tokens; buckets of vectors count the copies of hot cells."""

from __future__ import annotations

import random

from pointline.llm import secretscan, vecdedup


def test_values_after_an_equals_sign_are_tokens():
    rng = random.Random(11)
    value = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=48))
    for text in (f"auth={value}", f"http://h.x/?a=1&sig={value}&b=2", f"AWS_KEY={value}=="):
        assert value in [m[0].rstrip("=") for m in secretscan.TOKEN.finditer(text)]
        assert secretscan.random_tokens(text)


def test_buckets_count_the_copies_of_a_hot_cell(spark):
    counts = spark.createDataFrame([(8, 1, 300_000, 300_000, 293, 293), (8, 2, 10, 40, 1, 1)], "dim int, cell long, m long, v long, mb int, vb int")
    copies = 2 * 293 * 300_000 + 50
    assert vecdedup.bucket_count(counts) * vecdedup.GROUP >= copies
    assert vecdedup.bucket_count(counts.limit(0)) == 1
