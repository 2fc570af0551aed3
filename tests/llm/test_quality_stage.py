import corpus_pipeline
from agrovane.llm import quality_rules as q
from tests.llm.conftest import prose


def test_clean_documents_with_repeated_lines_stay(spark, frame):
    """A refrain of one line between lines of plain prose: over 30 % of the lines repeat, and nothing else is wrong."""
    lines = [" ".join(prose(900 + k, 12)) for k in range(8)]
    clean = "\n".join(x for line in lines for x in (line, "so it goes"))
    bad = "\n".join(["# * $ %", "# * $ %", " ".join(prose(950, 60))] * 3)
    docs = frame([(1, clean), (2, bad), (3, "short\nshort")])
    ledger = {r["doc_id"]: r for r in q.op1(docs).collect()}
    bit = 1 << list(q.RULES).index("duplicate_lines")
    assert ledger[1]["fail_bits"] == bit and ledger[1]["kept"] is False
    assert ledger[2]["fail_bits"] & bit and ledger[3]["fail_bits"] & bit
    assert [r["doc_id"] for r in corpus_pipeline.quality(spark, docs, "").collect()] == [1]
