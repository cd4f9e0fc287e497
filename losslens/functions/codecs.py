"""The four codec families as row kernels, and their Arrow-batched columns.

Kernels are loops with state that no built-in expression has; each runs over a
whole Arrow column at a time.  Bad input gives null and an error text.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extra symbol that ends an arithmetic-coded text.
STOP = "EOF"


def lzw_encode(text: str, alphabet: str | None = None) -> list[int]:
    """Codes of the longest known phrases; seeded with 256 characters or a given alphabet.  A character outside raises KeyError.

    A phrase is known by its code: longer ones are looked up by (code, next
    character), so that no phrase is ever copied.
    """
    first = {c: i for i, c in enumerate(sorted(set(alphabet)) if alphabet is not None else map(chr, range(256)))}
    symbols = [first[c] for c in text]
    if not symbols:
        return []
    size, known, out, code = len(first), {}, [], symbols[0]
    fresh = size
    for c in symbols[1:]:
        key = code * size + c
        longer = known.get(key)
        if longer is None:
            out.append(code)
            known[key] = fresh
            fresh += 1
            code = c
        else:
            code = longer
    return [*out, code]


def lzw_decode(codes: list[int], alphabet: str | None = None) -> str:
    if not codes:
        return ""
    known = list(sorted(set(alphabet)) if alphabet is not None else map(chr, range(256)))
    last = known[codes[0]]
    out = [last]
    for code in codes[1:]:
        if code > len(known):
            raise ValueError(f"bad code {code}")
        entry = known[code] if code < len(known) else last + last[0]
        out.append(entry)
        known.append(last + entry[0])
        last = entry
    return "".join(out)


def intervals(text: str, stop: bool = True) -> tuple[dict[str, tuple[int, int]], int]:
    """Cumulative counts of the text's symbols in code-point order (and the stop symbol), and their total."""
    counts = Counter(text)
    if stop:
        counts[STOP] = 1
    low, out = 0, {}
    for symbol in sorted(counts):
        out[symbol] = low, low + counts[symbol]
        low += counts[symbol]
    return out, low


def ae_encode_float(text: str) -> float:
    """Midpoint of the text's interval in binary64, stop symbol last."""
    table, total = intervals(text)
    low, high = 0.0, 1.0
    for symbol in [*text, STOP]:
        a, b = table[symbol]
        width = high - low
        low, high = low + width * a / total, low + width * b / total
    return (low + high) / 2


def ae_encode_exact(text: str, stop: bool = True) -> tuple[Fraction, Fraction]:
    table, total = intervals(text, stop)
    low, width, scale = 0, 1, 1  # all over the common denominator ``scale``
    for symbol in [*text, *[STOP] * stop]:
        a, b = table[symbol]
        low, width, scale = low * total + width * a, width * (b - a), scale * total
    return Fraction(low, scale), Fraction(low + width, scale)


def ae_decode_exact(value: Fraction, table: dict[str, tuple[int, int]], total: int, most: int | None = None) -> str:
    """Symbols until the stop symbol; ValueError after ``most`` symbols without one."""
    out, top, bottom = [], value.numerator, value.denominator
    while most is None or len(out) <= most:
        at = top * total // bottom
        symbol = next(s for s, (a, b) in table.items() if a <= at < b)
        if symbol == STOP:
            return "".join(out)
        a, b = table[symbol]
        top, bottom = top * total - a * bottom, bottom * (b - a)
        out.append(symbol)
    raise ValueError("no end found")


def ae_lower_decimal(text: str, digits: int = 80) -> str:
    """Lower bound without a stop symbol, as a decimal text of at most ``digits`` significant digits."""
    from decimal import Decimal, localcontext

    low, _ = ae_encode_exact(text, stop=False)
    with localcontext() as c:
        c.prec = digits
        return format(Decimal(low.numerator) / Decimal(low.denominator), "f")


#: Pieces coded at a time, and the bits of the lower limb of their whole numbers.
AT_A_TIME, LIMB = 1 << 12, 36
#: Characters of texts whose pieces are gathered before they are coded.
HELD = 1 << 20


def symbol_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol of each piece (a column): how many of the piece's are less, how many are equal, and its place among all in order."""
    below, equal, rank = (np.zeros(keys.shape, np.int8) for _ in range(3))
    for k, one in enumerate(keys):
        below += np.less(one, keys).view(np.int8)
        same = np.equal(one, keys).view(np.int8)
        equal += same
        rank[k + 1 :] += same[k + 1 :]
    return below, equal, below + rank


def cut(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the text's whole pieces, one a row, and those of its shorter last piece."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    whole = len(points) // size * size
    return points[:whole].reshape(-1, size), points[whole:]


def carried(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Limbs with what is over LIMB bits in the lower one carried on (or borrowed); the higher one keeps its sign."""
    return low & ((1 << LIMB) - 1), high + (low >> LIMB)


def pieces_come_back(points: np.ndarray) -> np.ndarray:
    """``ae_encode_exact`` and ``ae_decode_exact`` of many equally long pieces (rows of at most 16 code points): whether each comes back.

    The interval is kept over total ** (symbols so far), as whole numbers of two
    limbs (2 * 17 ** 17 has 71 bits), and the value decoded is its middle, over
    twice that.  A symbol's number is the quotient of the value and the width of
    one count at its place; a quotient guessed in binary64 is put right by its
    exact remainder.
    """
    n, size = points.shape
    if not n or not size:
        return np.ones(n, bool)
    if size > 16:
        raise ValueError("a piece is too long for two limbs")
    total = size + 1
    keys = np.empty((total, n), np.uint32)
    keys[:size], keys[size] = 2 * points.T, 2 * ord(STOP[0]) + 1  # the stop symbol sorts behind its first letter
    below, equal, rank = symbol_counts(keys)
    columns = np.arange(n)
    place = np.empty((total, n), np.int8)
    place[rank, columns] = np.arange(total, dtype=np.int8)[:, None]
    low, width = (np.zeros(n, np.int64), np.zeros(n, np.int64)), (np.ones(n, np.int64), np.zeros(n, np.int64))
    for a, c in zip(below.astype(np.int64), equal.astype(np.int64)):
        low = carried(low[0] * total + width[0] * a, low[1] * total + width[1] * a)
        width = carried(width[0] * c, width[1] * c)
    value = carried(2 * low[0] + width[0], 2 * low[1] + width[1])
    scale, ok = 2 * total**total, np.ones(n, bool)
    unit = np.full(n, scale & ((1 << LIMB) - 1)), np.full(n, scale >> LIMB)
    for key in keys:
        high = unit[1] // total  # a count's width at this place: the symbol's width over the total, which leaves no rest
        unit = (unit[0] + (unit[1] - high * total << LIMB)) // total, high
        at = ((value[0] + value[1] * 2.0**LIMB) / (unit[0] + unit[1] * 2.0**LIMB)).astype(np.int64)
        rest = carried(value[0] - at * unit[0], value[1] - at * unit[1])
        at -= rest[1] < 0
        at += carried(rest[0] - unit[0], rest[1] - unit[1])[1] >= 0
        found = place[np.clip(at, 0, total - 1), columns]
        ok &= keys[found, columns] == key
        first, count = below[found, columns].astype(np.int64), equal[found, columns].astype(np.int64)
        value = carried(value[0] - first * unit[0], value[1] - first * unit[1])
        unit = carried(count * unit[0], count * unit[1])
    return ok


def come_back(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of each text's whole pieces and rest (as ``cut`` gives them): how many pieces there are, and how many come back; equally long pieces of all texts are coded together."""
    groups: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, (whole, rest) in enumerate(held):
        for piece in (whole, rest[None]):
            if piece.size:
                groups.setdefault(piece.shape[1], []).append((i, piece))
    good = np.zeros(len(held), np.int64)
    for some in groups.values():
        points, owners = np.concatenate([p for _, p in some]), np.repeat([i for i, _ in some], [len(p) for _, p in some])
        for at in range(0, len(points), AT_A_TIME):
            np.add.at(good, owners[at : at + AT_A_TIME], pieces_come_back(points[at : at + AT_A_TIME]))
    return [(len(whole) + bool(len(rest)), int(n)) for (whole, rest), n in zip(held, good)]


def piecewise_round_trips(texts: Iterable[str | None], size: int = 16) -> list[tuple[int, int] | None]:
    """Pieces of each text, and how many of them come back from their exact fractions; about HELD characters are held at a time."""
    out: list[tuple[int, int] | None] = []
    held, places, n = [], [], 0
    for text in texts:
        out.append(None)
        if text is not None:
            held.append(cut(text, size))
            places.append(len(out) - 1)
            n += len(text)
        if n >= HELD:
            for i, found in zip(places, come_back(held)):
                out[i] = found
            held, places, n = [], [], 0
    for i, found in zip(places, come_back(held)):
        out[i] = found
    return out


def piecewise_round_trip(text: str, size: int = 16) -> tuple[int, int] | None:
    return piecewise_round_trips([text], size)[0]


def piecewise_lower_decimals(text: str, size: int = 8) -> list[str]:
    """``ae_lower_decimal`` of the text's pieces of ``size`` characters (8 at most), the last one filled up with x."""
    whole, _ = cut(text + "x" * (-len(text) % size), size)
    out = []
    for start in range(0, len(whole), AT_A_TIME):
        points = whole[start : start + AT_A_TIME]
        below, equal, _ = symbol_counts(np.ascontiguousarray(points.T))
        low, width = np.zeros(len(points), np.int64), np.ones(len(points), np.int64)
        for a, c in zip(below.astype(np.int64), equal.astype(np.int64)):
            low, width = low * size + width * a, width * c
        digits = len(f"{size**size:b}") - 1  # the denominator is a power of two, so of ten with as many digits
        out += ["0." + f"{x * 5**digits:0{digits}d}".rstrip("0") if x else "0" for x in low.tolist()]
    return out


def piecewise_lower_digest(text: str) -> tuple[int, str]:
    """The pieces of ``piecewise_lower_decimals``, and the SHA-256 of all with a space between them."""
    lows = piecewise_lower_decimals(text)
    return len(lows), hashlib.sha256(" ".join(lows).encode()).hexdigest()


def rle_encode(text: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for c in text:
        if out and out[-1][0] == c:
            out[-1] = c, out[-1][1] + 1
        else:
            out.append((c, 1))
    return out


class FrequencyHeap:
    """A binary heap that compares frequencies only, so equal ones leave in the order the sifting gives."""

    def __init__(self, items: list[tuple[int, object]]):
        import heapq

        class Node:
            __slots__ = ("freq", "tree")

            def __init__(self, freq, tree):
                self.freq, self.tree = freq, tree

            def __lt__(self, other):
                return self.freq < other.freq

        self.node, self.heapq = Node, heapq
        self.queue = [Node(freq, tree) for freq, tree in items]
        heapq.heapify(self.queue)  # all at once: pushing one by one leaves equal frequencies in another order

    def join(self):
        while len(self.queue) > 1:
            a, b = self.heapq.heappop(self.queue), self.heapq.heappop(self.queue)
            self.heapq.heappush(self.queue, self.node(a.freq + b.freq, (a.tree, b.tree)))
        return self.queue[0].tree if self.queue else None


def codes_of(tree) -> dict[str, str]:
    """Bit texts by symbol: 0 to the first child, 1 to the second; a lone symbol has 0."""
    if tree is None:
        return {}
    if isinstance(tree, str):
        return {tree: "0"}
    out, todo = {}, [(tree, "")]
    while todo:
        node, bits = todo.pop()
        if isinstance(node, str):
            out[node] = bits
        else:
            todo += [(node[1], bits + "1"), (node[0], bits + "0")]
    return out


def huffman_codebook(text: str) -> dict[str, str]:
    """Ties are left to the heap, symbols entering by first occurrence."""
    return codes_of(FrequencyHeap([(n, c) for c, n in Counter(text).items()]).join())


def huffman_codebook_ordered(text: str) -> dict[str, str]:
    """Ties go by age, symbols entering in code-point order: another codebook than the first."""
    import heapq

    queue = [(n, i, c) for i, (c, n) in enumerate(sorted(Counter(text).items()))]
    heapq.heapify(queue)
    serial = len(queue)
    while len(queue) > 1:
        a, b = heapq.heappop(queue), heapq.heappop(queue)
        heapq.heappush(queue, (a[0] + b[0], serial, (a[2], b[2])))
        serial += 1
    return codes_of(queue[0][2] if queue else None)


def huffman_encode(text: str) -> tuple[list[int], dict[str, str], int]:
    """Bytes, codebook, and the zero bits that fill the last byte."""
    book = huffman_codebook(text)
    bits = text.translate({ord(c): code for c, code in book.items()})
    padding = -len(bits) % 8
    return list(int(bits + "0" * padding, 2).to_bytes((len(bits) + padding) // 8, "big")) if bits else [], book, padding


#: Codes up to this length are decoded through one table.
TABLE_BITS = 16


def huffman_decode(data: list[int], book: dict[str, str], padding: int) -> str:
    """The text; a window of bits at each place tells its symbol and where the next one begins."""
    bits = np.unpackbits(np.frombuffer(bytes(data), np.uint8))
    bits = bits[: len(bits) - padding]
    longest = max(map(len, book.values()), default=0)
    if longest > TABLE_BITS:
        return decode_bit_by_bit(bits, book)
    symbols = list(book)
    symbol, length = np.zeros(1 << longest, np.int32), np.full(1 << longest, 1, np.int32)
    for i, c in enumerate(symbols):
        free = longest - len(book[c])
        at = int(book[c], 2) << free
        symbol[at : at + (1 << free)], length[at : at + (1 << free)] = i, len(book[c])
    wide = np.concatenate([bits, np.zeros(longest, np.uint8)]).astype(np.int32)
    window = np.zeros(len(bits), np.int32)
    for i in range(longest):
        window = window << 1 | wide[i : i + len(bits)]
    steps, at, starts = length[window].tolist(), 0, []
    while at < len(steps):
        starts.append(at)
        at += steps[at]
    return "".join([symbols[i] for i in symbol[window[starts]].tolist()]) if starts else ""


def decode_bit_by_bit(bits: np.ndarray, book: dict[str, str]) -> str:
    back, out, code = {v: k for k, v in book.items()}, [], ""
    for bit in "".join(map(str, bits.tolist())):
        code += bit
        if code in back:
            out.append(back[code])
            code = ""
    return "".join(out)


def column(kernel: Callable, kind: str) -> Callable[[Column], Column]:
    """An Arrow-batched column of a kernel over texts; null in, or a KeyError or ValueError, gives null."""

    names = [field.split()[0] for field in kind[7:-1].split(", ")] if kind.startswith("struct<") else []

    def one(x):
        try:
            return None if x is None else kernel(x)
        except (KeyError, ValueError):
            return None

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    def run_struct(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) or (None,) * len(names) for x in s], columns=names, dtype=object)

    if names:
        return F.pandas_udf(run_struct, kind)
    return F.pandas_udf(run, kind)


def lzw_round_trip(text: str) -> tuple[int, bool]:
    codes = lzw_encode(text)
    return len(codes), lzw_decode(codes) == text


def huffman_summary(text: str) -> tuple[int, int, float, bool]:
    """Bits, symbols, the codebook's Kraft sum, and whether the text comes back."""
    data, book, padding = huffman_encode(text)
    return 8 * len(data) - padding, len(book), math.fsum(2.0 ** -len(c) for c in book.values()), huffman_decode(data, book, padding) == text


def huffman_digest(text: str) -> tuple[str, str]:
    """The codebook in the order of its symbols, and the bytes in hexadecimal."""
    data, book, _ = huffman_encode(text)
    return " ".join(f"{c}={book[c]}" for c in sorted(book)), bytes(data).hex()
