"""No language is dropped silently."""

import fixtures as fx
import pytest

from spectrafdr.llm import language_id


def test_too_many_languages_raise(spark):
    docs = fx.documents(spark, [(i, "some words", f"l{i % 4}", "a", 10) for i in range(9)])
    with pytest.raises(ValueError, match="4 languages"):
        language_id.fit(docs, max_languages=3)
    assert language_id.fit(docs, max_languages=4).languages == ["l0", "l1", "l2", "l3"]
