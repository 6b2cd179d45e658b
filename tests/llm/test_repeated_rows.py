import pytest

from echoloom.llm.decontaminate import decontaminate, drop_contaminated

from .helpers import docs
from .test_text_operators import hits_by_force


@pytest.mark.parametrize("times", [2, 3])
def test_repeated_contaminated_rows(spark, times):
    """Rows with the same id and text bring a window's postings several times, and are hit all the same."""
    passage = " ".join(f"b{i}" for i in range(14))
    rows = [(1, f"start {passage} end")] * times + [(2, "k9 " * 12)] * times + [(3, f"{passage} alone"), (4, "clean words"), (5, "what now"), (5, "what now"), (None, passage), (None, passage)]
    items = [(0, passage), (1, "K9 " * 10), (2, "what"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate(docs(spark, rows), bench).drop("key", "n_near").collect()), key=repr)
    assert got == sorted(((i, *hits_by_force(t, items)) for i, t in rows), key=repr)
    assert [r["doc_id"] for r in drop_contaminated(docs(spark, rows), bench).collect()] == [4]
