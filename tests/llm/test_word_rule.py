import pytest

import corpus_pipeline
from losslens.llm import quality
from tests.conftest import SMALL

CONTENT = [f"{a}{b}on" for a in "garden silver mirror window letter candle basket ribbon".split() for b in "abcdefghijklmnopqrstuvwxy"]


@pytest.mark.parametrize("lang", sorted(quality.COMMON))
def test_content_words_alone_are_rejected(spark, lang):
    """200 distinct words of ordinary letters and none of them common; with common words among them the text stays."""
    common = [w for w, share in quality.COMMON[lang].items() for _ in range(round(300 * share))]
    rows = [(1, " ".join(CONTENT), lang), (2, " ".join(CONTENT + common), lang)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert got[1].n_words == 200 and not got[1].base_failed and not got[1].kept and got[2].kept
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["quality rules"](spark, docs, SMALL).collect()] == [2]
