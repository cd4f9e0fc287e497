import pytest
from pyspark.sql import functions as F

from losslens.operators import languages, templates

CHATS = [
    [("user", "q"), ("assistant", "a")], [("system", "s's"), ("user", "q"), ("assistant", "a"), ("user", "r")], [], [("assistant", "a"), ("user", None)], [("system", "only")],
]


def chats(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate(CHATS)], "id int, m array<struct<role:string,content:string>>")


def evaluated(spark, column):
    return [r.v for r in chats(spark).select("id", column.alias("v")).orderBy("id").collect()]


@pytest.mark.parametrize("name", sorted(templates.TEMPLATES))
def test_both_languages_say_what_the_template_says(spark, name):
    m = F.col("m")
    system = F.when(F.get(m, F.lit(0))["role"] == "system", F.get(m, F.lit(0))["content"])
    turns = F.filter(m, lambda x: x["role"] != "system")
    spoken = F.transform(turns, lambda x: F.struct(x["role"].alias("role"), F.coalesce(x["content"], F.lit("")).alias("content")))
    want = evaluated(spark, templates.render(name, spoken, system, "<s>", "</s>"))
    assert evaluated(spark, languages.Jinja(templates.to_jinja(name, "<s>", "</s>")).over(m)) == want
    default = F.lit(templates.TEMPLATES[name].default_system)
    assert evaluated(spark, languages.ModelFile(templates.to_ollama(name, "<s>", "</s>")).over(turns, F.coalesce(system, default))) == want


def test_what_templates_may_say(spark):
    say = lambda t: evaluated(spark, languages.Jinja(t).over(F.col("m")))[0]
    assert say("{% set x = 'a' + 'b' %}{{ x }}{% if y is defined %}no{% elif x == 'ab' %}yes{% else %}no{% endif %}") == "abyes"
    assert say("{% if x is defined %}no{% else %}{% set x = 'later' %}{% endif %}{{ x }}") == "later"
    assert say("{% for m in messages %}{% if loop.first and m['role'] == 'user' %}1{% else %}n{% endif %}{{ m['content'] }}{% endfor %}") == "1qna"
    model = lambda t: evaluated(spark, languages.ModelFile(t).over(F.col("m"), F.lit("sys")))[0]
    assert model('{{ if .System }}[{{ .System }}]{{ end }}{{ range $i, $_ := .Messages }}{{ if eq $i 0 }}first {{ end }}{{ if eq .Role "user" }}U{{ else }}A{{ end }}{{ .Content }}{{ end }}') == "[sys]first UqAa"


@pytest.mark.parametrize("template", ["{{ f(x) }}", "{% macro a %}", "{% if x == 'a' %}", "{{ nobody }}", "{% endif %}", "{{ 1 | tojson }}", "{{ 'a }}"])
def test_other_jinja_is_refused(template, spark):
    with pytest.raises(languages.TemplateError):
        languages.Jinja(template).over(F.col("m"))


@pytest.mark.parametrize("template", ["{{ .Nobody }}", "{{ if .System }}", "{{ end }}", "{{ template x }}"])
def test_other_model_files_are_refused(template, spark):
    with pytest.raises(languages.TemplateError):
        languages.ModelFile(template).over(F.col("m"), F.lit(""))
