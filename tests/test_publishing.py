"""Works made of documents are searched in the whole text."""

from skein.plans import registry
from tests.conftest import write


def test_words_beyond_the_prefix(spark, tmp_path):
    far = "x" * 150
    texts = [(1, f"{far} The cat, AND more"), (2, f"{far} the cat"), (3, "the and"), (4, f"the {far} and"), (5, f"theand {far}"), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "src1", None if t is None else len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    part = spark.createDataFrame([(i, f"part {i}") for i in range(1, 121)], "p_partkey long, p_name string")
    path = write(tmp_path, documents=docs, part=part)
    both = [r["uri"] for r in registry.queries()["spb_q8"](spark, path).collect()]
    assert both == ["urn:work:1", "urn:work:3", "urn:work:4"]
    tags = {r["uri"] for r in registry.queries()["spb_a16"](spark, path).collect()}
    assert tags == {f"urn:work:{i}" for i in (1, 2, 3, 4)}
