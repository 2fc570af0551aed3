import corpus_pipeline
from tests.llm.conftest import prose

LIVE, WEAK, EXAMPLE = "password=Qw3rTy99Zz81xk", "token=hunter22", "secret=Ex4mpleKey9Zz81"


def test_only_wide_values_stay(spark, frame):
    copied = " ".join(prose(1, 60))
    rows = [(k, f"{copied} {LIVE} end", f"s{k}") for k in range(8)]  # one text in eight sources
    rows += [(20 + k, " ".join(prose(50 + k, 40)) + " api_key=Tw0PlacesKey81xk tail", f"s{k}") for k in range(2)]
    rows += [(40, " ".join(prose(70, 40)) + f" {WEAK} tail", "s0"), (41, " ".join(prose(71, 40)), "s1")]
    rows += [(60 + k, " ".join(prose(90 + k, 40)) + f" {EXAMPLE} tail", f"s{k}") for k in range(8)]
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets(spark, frame(rows), "").collect()}
    assert len(texts) == len(rows)
    assert all(texts[k] == f"{copied} [assign] end" for k in range(8))
    assert all(texts[20 + k].endswith(" [assign] tail") for k in range(2))
    assert texts[40].endswith(" [assign] tail") and texts[41] == rows[11][1]
    assert all(texts[60 + k].endswith(f" {EXAMPLE} tail") for k in range(8))
