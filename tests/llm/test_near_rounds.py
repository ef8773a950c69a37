"""Rounds of near-dedup where buckets hold many unlike texts."""

from tallyhouse.llm import neardup


def test_rounds_do_not_follow_pairs_of_one_bucket(spark, monkeypatch):
    """Eighty pairs of near copies that share two thirds with all others: an
    order drawn in their bucket links one pair, so most are left to the exact join."""
    passage = [f"p{i}" for i in range(200)]
    texts = []
    for i in range(80):
        own = [f"t{i}x{j}" for j in range(100)]
        texts += [" ".join(passage + own), " ".join(passage + own[:-1])]
    compared = []
    verified = neardup.verified

    def counted(pairs, *rest):
        compared.append(1)
        return verified(pairs, *rest)

    monkeypatch.setattr(neardup, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = neardup.near_duplicates(docs, settings=neardup.Settings(bands=1, rows=1)).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: i - i % 2 for i in range(160)}
    assert len(compared) <= 6, len(compared)
