import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from losslens.functions import answers, codecs, text
from losslens.operators import sft

BLOCKS = "AAABBBCCCDDDEEE112233AABBCC"


def test_golden_codecs():
    assert codecs.lzw_encode(BLOCKS, BLOCKS) == [3, 8, 4, 10, 5, 12, 6, 14, 7, 16, 0, 0, 1, 1, 2, 2, 9, 4, 12]
    book = codecs.huffman_codebook_ordered(BLOCKS)
    assert book == {"C": "00", "3": "010", "D": "011", "E": "100", "1": "1010", "2": "1011", "A": "110", "B": "111"}
    assert sum(len(book[c]) for c in BLOCKS) == 80
    hello = codecs.huffman_codebook_ordered("HELLO")
    assert "".join(hello[c] for c in "HELLO") == "0100111110"
    assert codecs.ae_lower_decimal("HELLO") == "0.22752"
    assert [f"{c}{n}" for c, n in codecs.rle_encode(BLOCKS)] == ["A3", "B3", "C3", "D3", "E3", "12", "22", "32", "A2", "B2", "C2"]
    assert codecs.huffman_encode("aaaa")[1] == {"a": "0"}
    with pytest.raises(KeyError):
        codecs.lzw_encode("aĀ")
    with pytest.raises(ValueError):
        codecs.lzw_decode([65, 999])


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=255), max_size=60))
def test_codecs_come_back(s):
    assert codecs.lzw_decode(codecs.lzw_encode(s)) == s
    assert codecs.lzw_decode(codecs.lzw_encode(s, s), s) == s
    assert "".join(c * n for c, n in codecs.rle_encode(s)) == s
    assert codecs.huffman_decode(*codecs.huffman_encode(s)) == s
    table, total = codecs.intervals(s)
    low, high = codecs.ae_encode_exact(s)
    assert 0 <= low < high <= 1 and codecs.ae_decode_exact((low + high) / 2, table, total) == s
    assert abs(codecs.ae_encode_float(s) - float((low + high) / 2)) < 1e-9


@pytest.mark.parametrize(
    "said, value",
    [
        ('x [ANSWER]{"output": 1}[/ANSWER] y [ANSWER]{"output": 2}[/ANSWER]', 2),
        ('[ANSWER]{{"output": [1, 2]}}[/ANSWER]', [1, 2]),
        ("[ANSWER]{'output': None,}[/ANSWER]", None),
        ("it's so: {\"output\": \"a}b\"}", "a}b"),
        ("{'output': 'a}b'}", "a}b"),
        ('[ANSWER]{"output": “x”}[/ANSWER]', "x"),
        ('cut off {"output": 12', 12),
        ('cut off {"output": "ab\\"c', 'ab\\"c'),
        ('cut off {"output": "ab\n[/ANSWER]', "ab"),
        ('{"foo": 3}', {"foo": 3}),
        ("nothing here", answers.MISSING),
        (None, answers.MISSING),
        ("[ANSWER][1, [2, 3]][/ANSWER]", [1, [2, 3]]),
    ],
)
def test_extracted_answers(said, value):
    assert answers.extract(said) == value


def test_equality_and_verdicts():
    assert answers.deep_equal("1.0", "1.0005") and not answers.deep_equal(1, 2) and answers.deep_equal((1, [2]), [1, [2]])
    assert not answers.deep_equal(float("nan"), float("nan")) and answers.deep_equal(True, 1) and answers.deep_equal({"a": 1.0}, {"a": 1.0005})
    assert answers.decimal("28/29") == answers.decimal("Fraction(28, 29)") and answers.fractions_equal("0.5", "1/2") and not answers.fractions_equal("0.5004", "1/2")
    assert answers.is_close([1.9999], [1.9998]) and not answers.is_close(2.0, 1.9999) and not answers.is_close(float("inf"), float("inf")) and answers.is_close({"a": "x"}, {"a": "x"})
    assert answers.verdict('{"output": 0.5004}', 0.5, "ae") == "correct" and answers.verdict('{"output": 0.6}', 0.5, "ae") == "wrong"
    assert answers.verdict('{"output": [1.0, 2]}', [1, 2], "lzw") == "correct" and answers.verdict('{"output": "x"}', [1], "lzw") == "wrong"
    assert answers.verdict('{"output": [["a", 1], ["a", 2]]}', [("a", 3)], "rle", text="aaa") == "correct"  # another writing of the same text
    assert answers.formatted_truth("[ANSWER]x[/ANSWER]", "3.0") == '[ANSWER]\n{"output": 3}\n[/ANSWER]' and answers.formatted_truth("x", '"a"') == '{"output": "a"}' and answers.formatted_truth(None, 2.5) == '{"output": 2.5}'
    assert answers.csv_text("a\ud800") == "a\\ud800" and answers.json_text([float("nan"), ..., (1,)]) == "[null, null, [1]]"


def heap_by_hand(items):
    """The order in which a binary heap of (count, tree), built bottom up and compared by counts only, gives its items back."""
    heap = list(items)

    def down(at, start):
        item, n = heap[at], len(heap)
        child = 2 * at + 1
        while child < n:  # to the bottom along the smaller children, the right one of equals
            if child + 1 < n and not heap[child][0] < heap[child + 1][0]:
                child += 1
            heap[at], at = heap[child], child
            child = 2 * at + 1
        heap[at] = item
        up(at, start)

    def up(at, start):
        item = heap[at]
        while at > start and item[0] < heap[(at - 1) >> 1][0]:
            heap[at], at = heap[(at - 1) >> 1], (at - 1) >> 1
        heap[at] = item

    def pop():
        last = heap.pop()
        if not heap:
            return last
        first, heap[0] = heap[0], last
        down(0, 0)
        return first

    for at in reversed(range(len(heap) // 2)):
        down(at, at)
    while len(heap) > 1:
        a, b = pop(), pop()
        heap.append((a[0] + b[0], (a[1], b[1])))
        up(len(heap) - 1, 0)
    return heap[0][1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefghij", min_size=1, max_size=40))
def test_equal_counts_leave_the_heap_in_its_order(s):
    from collections import Counter

    def walk(tree, bits):
        return {tree: bits or "0"} if isinstance(tree, str) else {**walk(tree[0], bits + "0"), **walk(tree[1], bits + "1")}

    assert codecs.huffman_codebook(s) == walk(heap_by_hand([(n, c) for c, n in Counter(s).items()]), "")


def test_long_codes_are_decoded_bit_by_bit(monkeypatch):
    text = "".join(chr(65 + i) * (1 << i) for i in range(14))
    data = codecs.huffman_encode(text)
    assert codecs.huffman_decode(*data) == text
    monkeypatch.setattr(codecs, "TABLE_BITS", 3)
    assert codecs.huffman_decode(*data) == text


@pytest.mark.parametrize("case", [((3000, 2000), (600, 400)), ((2000, 3000), (400, 600)), ((1000, 100), (900, 100)), ((100, 1000), (100, 900)), ((100, 500), (100, 500)), ((500, 100), (500, 100)), ((10, 10), (10, 10))])
def test_truncation_budget(spark, case):
    (a, b), want = case
    assert tuple(spark.range(1).select(*text.truncation_budget(F.lit(a), F.lit(b), F.lit(1000))).first()) == want


def test_knapsack_and_metrics():
    assert sft.knapsack([5, 3, 4, 6], 8) == [[6], [5, 3], [4]]
    with pytest.raises(ValueError):
        sft.knapsack([9], 8)
    words = "a b c d e".split()
    assert sft.rouge(words, words) == (1, 1, 1) and sft.bleu4(words, words) == pytest.approx(1)
    assert sft.rouge([], words) == (0, 0, 0) and sft.bleu4([], words) == 0 and sft.bleu4(["x"], words) == 0


def test_blinded_names(spark):
    from losslens.operators.prompts import blind

    said = "Huffman coding algorithm, run-length encoding and lzw; ARITHMETIC CODING, Lempel Ziv Welch; paella"
    want = "a custom algorithm, a custom algorithm and a custom algorithm; a custom algorithm, a custom algorithm; paella"
    assert spark.range(1).select(blind(F.lit(said)).alias("x")).first().x == want
