import json

import pytest
from pyspark.sql import functions as F

from losslens.operators import report, stages, templates
from losslens.plans import catalog, exchange  # noqa: F401
from tests.conftest import SMALL


def test_stages_choose_their_processor():
    assert stages.processor("sft") is stages.supervised and stages.processor("sft", packing=True) is stages.packed_supervised
    assert stages.processor("sft", generate=True) is stages.unsupervised and stages.processor("ppo") is stages.unsupervised
    assert stages.processor("rm") is stages.pairwise and stages.processor("kto") is stages.feedback and stages.processor("pt") is stages.pretraining


def test_packs_hold_each_sample_once_and_are_padded(spark):
    rows = [(i, list(range(1, 1 + i % 5)), [7] * (i % 4)) for i in range(60)]
    packs = stages.packed_supervised(spark.createDataFrame(rows, "id long, source array<int>, target array<int>"), 10, pad=9).collect()
    assert all(len(p.input_ids) == len(p.labels) == len(p.attention) == len(p.positions) == 11 for p in packs)
    assert sorted(i for p in packs for i in p.ids) == list(range(60))
    for p in packs:
        n, at = len(p.ids), 0
        for k, i in enumerate(p.ids):
            source, target = rows[i][1:]
            end = at + len(source + target)
            assert p.input_ids[at:end] == source + target and p.labels[at:end] == [-100] * len(source) + target
            assert p.attention[at:end] == [k + 1] * (end - at) and p.positions[at:end] == list(range(end - at))
            at = end
        assert p.input_ids[at:] == [9] * (11 - at) and p.labels[at:] == [-100] * (11 - at) and p.attention[at:] == p.positions[at:] == [0] * (11 - at) and n


def test_stream_splits(spark):
    rows = spark.range(10)
    assert rows.count() == stages.take_and_skip(rows, 99, F.col("id")).where("validation").count()
    assert stages.take_and_skip(rows, 0, F.col("id")).where("validation").count() == 0
    assert stages.take_and_skip(rows.limit(0), 3, F.col("id")).count() == 0
    assert sorted(r.id for r in stages.take_and_skip(rows, 3, -F.col("id")).where("validation").collect()) == [7, 8, 9]
    with pytest.raises(ValueError):
        stages.take_and_skip(rows, 0.1, F.col("id"))


def test_names_are_given_once(spark):
    names = stages.Registry("thing")
    names.register("a", 1)
    with pytest.raises(ValueError):
        names.register("a", 2)
    with pytest.raises(KeyError, match="a"):
        names["b"]
    got = stages.run_kernels(spark.createDataFrame([("aab",), ("",), (None,), ("Ā",)], "t string"), "lzw", "t").collect()
    assert [r.output for r in got][1:3] == ["[]", None] and json.loads(got[0].output) == [97, 97, 98] and got[3].output.startswith("ERROR: KeyError")


def test_reports(spark):
    scores = spark.createDataFrame([("m", "rle", "t1", 50.0, 2), ("m", "rle", "t2", 100.0, 4), ("m", "lzw", "t1", 1.0, 1), ("m", "lzw", "OVERALL", 1.0, 9)], "model string, algo string, task string, score double, n long")
    assert {r.algo: (r.t1, r.t2, r.n) for r in report.pivot(scores, ["t1", "t2"]).collect()} == {"rle": (50.0, 100.0, 6), "lzw": (1.0, None, 9)}
    head = report.flat_header(5, 7)
    assert len(head[0]) == 12 + 1 + 7 + 1 + 9 + 1 + 10 and head[1] == "-" * 41
    assert {len(r.line) for r in report.flat_lines(scores, 5, 7).collect()} == {41}
    assert report.markdown(spark.createDataFrame([("a|b", None)], "x string, y double")) == "| x | y |\n| --- | --- |\n| a\\|b | - |"
    assert json.loads(report.stats_json(scores.where("algo = 'rle'").select("n"))) == [{"n": 2}, {"n": 4}]
    with pytest.raises(ValueError):
        report.markdown(spark.range(3), most=2)


@pytest.mark.parametrize("name", sorted(templates.TEMPLATES))
def test_templates_in_other_languages(name):
    t = templates.with_marks(templates.TEMPLATES[name], "<s>", "</s>")
    say = lambda *turns: t.prefix + "".join(f.replace("{{content}}", x) for f, x in turns)
    one = say((t.user, "{q1}"), (t.assistant, "{a1}"))
    two = say((t.user, "{q1}"), (t.assistant, "{a1}"), (t.user, "{q2}"), (t.assistant, "{a2}"))
    found = templates.infer_template(one, two)
    again = lambda *turns: found.prefix + "".join(f.replace("{{content}}", x) for f, x in turns)
    assert again((found.user, "{q1}"), (found.assistant, "{a1}")) == one
    jinja = templates.to_jinja(name, "<s>", "</s>")
    assert jinja.count("{%") == jinja.count("%}") and "message['content']" in jinja and "\n" not in jinja
    ollama = templates.to_ollama(name, "<s>", "</s>")
    assert ollama.count("{{ if") + ollama.count("{{ range") == ollama.count("{{ end }}") and "{{content}}" not in ollama
    with pytest.raises(ValueError):
        templates.infer_template("a", "b")
