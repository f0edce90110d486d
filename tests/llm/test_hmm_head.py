"""The words whose counts are broadcast."""

from juristrata.llm import hmm


def test_head_holds_whole_levels_of_counts_within_its_limit(spark):
    counts = spark.createDataFrame([(f"w{k}".encode(), 3) for k in range(50)] + [(b"often", 9), (b"once", 1)], "word binary, n long").repartition(3)
    assert hmm.head_words(counts, 21) == [(b"often", 9)] and hmm.head_words(counts, 0) == []
    assert len(hmm.head_words(counts, 51)) == 51 and len(hmm.head_words(counts, 100)) == 52
