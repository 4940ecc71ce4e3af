"""The bitmap that keeps unwanted texts out of a shuffle."""

import pytest

from tallyweir.llm import common

KEYS = "doc_id long, th long"


@pytest.mark.parametrize("words", [1, common.SIEVE_WORDS])
def test_sieve_loses_no_key(spark, monkeypatch, words):
    """A crowded bitmap lets most rows through, a roomy one hardly more than the wanted ones; null ids and repeated rows are kept, extra columns pass."""
    monkeypatch.setattr(common, "SIEVE_WORDS", words)
    rows = spark.createDataFrame([(i, i * i, "t") for i in range(2000)] + [(None, 7, "t"), (None, 7, "t"), (3, 10, "other")], KEYS + ", __x string")
    wanted = {(i, i * i) for i in range(0, 2000, 10)} | {(None, 7)}
    kept = [(r.doc_id, r.th) for r in common.sieved(rows, spark.createDataFrame(list(wanted), KEYS)).collect()]
    assert wanted <= set(kept) and kept.count((None, 7)) == 2
    assert (len(kept) > 1500) if words == 1 else len(kept) <= 210


def test_sieve_of_nothing(spark):
    none = spark.createDataFrame([], KEYS)
    assert common.sieved(spark.createDataFrame([(1, 2)], KEYS), none).count() == 0
    assert common.sieved(none, spark.createDataFrame([(1, 2)], KEYS)).count() == 0
