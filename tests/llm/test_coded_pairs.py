"""Near copies meet by the Golay-code keys of their fingerprints before any band is read."""

import itertools

from seqspark.llm import near_copies
from seqspark.llm.simhash import fingerprint


def test_pairs_within_two_bits_meet(spark):
    texts = [" ".join(f"w{i * 7 % 997}" for i in range(700) if i != gone) for gone in (None, 3, 350, 699)] + ["other words that are here alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "h long, normal string")
    signed = near_copies._signed(docs, near_copies.NearCopyParams())
    met = {(r["a"], r["b"]) for r in near_copies.coded_pairs(signed).collect()}
    bits = {(a, b): bin(fingerprint(texts[a]) ^ fingerprint(texts[b])).count("1") for a, b in itertools.combinations(range(len(texts)), 2)}
    near = {p for p, n in bits.items() if 0 < n <= 2}
    assert {p for p in met if bits[p]} == near and any(n <= 2 for n in bits.values()) and met
    linked = near_copies.near_copy_components(docs, near_copies.NearCopyParams(rounds=0))
    assert {v for r in linked.collect() for v in (r["vertex"],)} == {v for p in met for v in p}
