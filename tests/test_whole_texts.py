"""Queries that must read their texts to the end."""

import re

from losslens.plans import texts


def test_answers_after_the_first_characters(spark):
    filler = "words that say nothing. " * 40
    rows = [
        (1, filler + '[ANSWER]{{"output": 7}}[/ANSWER]'),
        (2, '[ANSWER]{"output": 1}[/ANSWER] ' + filler + '[answer] {"output": 2} [/answer] ' + filler),
        (3, filler + '[ANSWER]{"output": 5}[/ANSWER]'),
        (4, "x" * 190 + '[ANSWER]{"output": 44}[/ANSWER]'),
        (5, filler),
        (7, None),
    ]

    def slow(i, text):
        if text is None:
            return None
        text = 'first [ANSWER]{{"output": 0}}[/ANSWER] then ' + text + f' [answer] {{{{"output": {i}}}}} [/answer]' if i % 3 == 0 else text
        found = re.findall(r"(?is)\[ANSWER\](.*?)\[/ANSWER\]", text)
        return found[-1].strip().replace("{{", "{").replace("}}", "}") if found else None

    got = {r.doc_id: (r.answer, r.output) for r in texts.extracted_answers(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: a for i, (a, _) in got.items()} == {i: slow(i, t) for i, t in rows}
    assert {i: o for i, (_, o) in got.items()} == {1: 7, 2: 2, 3: 3, 4: 44, 5: None, 7: None}
