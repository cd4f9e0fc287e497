"""Chat templates in two template languages, read as far as chat templates use them and made into Columns."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)


class TemplateError(ValueError):
    """A template says something that isn't read here."""


@dataclass
class Block:
    """A piece of a template: text, what is put in, a choice between blocks, or a loop."""

    kind: str
    words: str = ""
    parts: list = field(default_factory=list)


def blocks(pieces: list[tuple[str, str]], ends: tuple[str, ...] = ()) -> tuple[list[Block], str]:
    """Blocks up to one of the closing words, and that word with what follows it; uses up the pieces."""
    out: list[Block] = []
    while pieces:
        kind, words = pieces.pop(0)
        if kind in ends:
            return out, f"{kind} {words}".strip()
        if kind in ("if", "for"):
            made = Block(kind, words)
            while True:
                inner, end = blocks(pieces, ("elif", "else", "end"))
                made.parts.append((words, inner))
                if end == "end":
                    break
                words = end.partition(" ")[2]  # nothing behind else
                kind = "else"
            out.append(made)
        elif kind in ("elif", "else", "end"):
            raise TemplateError(f"{kind} without a beginning")
        else:
            out.append(Block(kind, words))
    if ends:
        raise TemplateError("a block isn't closed")
    return out, ""


def jinja_pieces(template: str) -> list[tuple[str, str]]:
    out = []
    for piece in MARKS.split(template):
        if piece.startswith("{{"):
            out.append(("put", piece[2:-2].strip()))
        elif piece.startswith("{%"):
            word, _, rest = piece[2:-2].strip(" -").partition(" ")
            out.append(({"endif": "end", "endfor": "end"}.get(word, word), rest.strip()))
        elif piece:
            out.append(("text", piece))
    return out


def model_file_pieces(template: str) -> list[tuple[str, str]]:
    out = []
    for piece in MARKS.split(template):
        if not piece.startswith("{{"):
            if piece:
                out.append(("text", piece))
            continue
        words = piece[2:-2].strip()
        first, _, rest = words.partition(" ")
        if first == "else":
            out.append(("elif", rest.removeprefix("if ").strip()) if rest else ("else", ""))
        elif first in ("if", "end", "range"):
            out.append(("for" if first == "range" else first, rest.strip()))
        else:
            out.append(("put", words))
    return out


class Jinja:
    """Evaluates a template over ``messages`` (array of role, content): names, items, slices, sums, == and ``is defined``, set, if and for."""

    def __init__(self, template: str):
        self.body, _ = blocks(jinja_pieces(template))

    def over(self, messages: Column) -> Column:
        return self.run(self.body, {"messages": (F.lit(True), messages)})

    def value(self, node: ast.expr, names: dict) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.Name) and node.id in names:
            return names[node.id][1]
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "loop" and node.attr == "first":
            return names["loop"][1] == 0
        if isinstance(node, ast.Subscript):
            of, at = self.value(node.value, names), node.slice
            if isinstance(at, ast.Slice) and isinstance(at.lower, ast.Constant) and at.upper is None:
                return F.slice(of, F.lit(at.lower.value + 1), F.greatest(F.size(of), F.lit(1)))
            if isinstance(at, ast.Constant):
                return F.get(of, F.lit(at.value)) if isinstance(at.value, int) else of[at.value]
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            return F.concat(*[F.coalesce(self.value(x, names), F.lit("")) for x in (node.left, node.right)])
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and isinstance(node.ops[0], ast.Eq):
            return F.coalesce(self.value(node.left, names) == self.value(node.comparators[0], names), F.lit(False))
        if isinstance(node, ast.BoolOp) and isinstance(node.op, ast.And):
            both = self.value(node.values[0], names)
            for more in node.values[1:]:
                both &= self.value(more, names)
            return both
        raise TemplateError(f"not read: {ast.unparse(node)}")

    def said(self, words: str, names: dict) -> Column:
        try:
            return self.value(ast.parse(words, mode="eval").body, names)
        except SyntaxError as e:
            raise TemplateError(f"not read: {words}") from e

    def true(self, words: str, names: dict) -> Column:
        name, defined, rest = words.partition(" is defined")
        if defined and not rest:
            return names[name][0] if name in names else F.lit(False)
        return self.said(words, names)

    def run(self, body: list[Block], names: dict) -> Column:
        """The text of the blocks; names that they set are left in ``names``, each with whether it is set."""
        out = [F.lit("")]
        for block in body:
            if block.kind == "text":
                out.append(F.lit(block.words))
            elif block.kind == "put":
                out.append(F.coalesce(self.said(block.words, names), F.lit("")))
            elif block.kind == "set":
                name, _, words = block.words.partition("=")
                names[name.strip()] = F.lit(True), self.said(words.strip(), names)
            elif block.kind == "for":
                name, _, over = block.words.partition(" in ")
                inner = block.parts[0][1]
                turn = lambda x, i: self.run(inner, names | {name.strip(): (F.lit(True), x), "loop": (F.lit(True), i)})  # noqa: B023, E731
                out.append(F.array_join(F.transform(self.said(over.strip(), names), turn), ""))
            elif block.kind == "if":
                out.append(self.choose(block, names))
            else:
                raise TemplateError(f"not read: {block.kind}")
        return F.concat(*out)

    def choose(self, block: Block, names: dict) -> Column:
        text, taken, before = None, F.lit(False), dict(names)
        for words, inner in block.parts:
            here = self.true(words, before) if words else F.lit(True)
            own = dict(before)
            part = self.run(inner, own)
            text = F.when(here, part) if text is None else text.when(here, part)
            for name, (there, value) in own.items():
                if name not in before or before[name] is not own[name]:
                    old = names.get(name)
                    now = here & ~taken
                    names[name] = (now & there, F.when(now, value)) if old is None else (old[0] | (now & there), F.when(now, value).otherwise(old[1]))
            taken = taken | here
        return text.otherwise("")


class ModelFile:
    """Evaluates a model file's template over ``.System`` and ``.Messages``: fields, ``eq``, if and range."""

    def __init__(self, template: str):
        self.body, _ = blocks(model_file_pieces(template))

    def over(self, messages: Column, system: Column) -> Column:
        return self.run(self.body, {"$.System": system, ".System": system, ".Messages": messages})

    def value(self, word: str, names: dict) -> Column:
        if word in names:
            return names[word]
        if word.startswith(".") and "." in names:
            return names["."][word[1:].lower()]
        try:
            return F.lit(ast.literal_eval(word))
        except (ValueError, SyntaxError) as e:
            raise TemplateError(f"not read: {word}") from e

    def true(self, words: str, names: dict) -> Column:
        if words.startswith("eq "):
            a, b = words[3:].split(" ", 1)
            return F.coalesce(self.value(a, names) == self.value(b.strip(), names), F.lit(False))
        return F.coalesce(self.value(words, names) != "", F.lit(False))

    def run(self, body: list[Block], names: dict) -> Column:
        out = [F.lit("")]
        for block in body:
            if block.kind == "text":
                out.append(F.lit(block.words))
            elif block.kind == "put":
                out.append(F.coalesce(self.value(block.words, names), F.lit("")))
            elif block.kind == "for":
                variables, _, over = block.words.rpartition(":=")
                index = variables.split(",")[0].strip()
                inner = block.parts[0][1]
                turn = lambda x, i: self.run(inner, names | {".": x} | ({index: i} if index else {}))  # noqa: B023, E731
                out.append(F.array_join(F.transform(self.value(over.strip(), names), turn), ""))
            else:
                text = None
                for words, inner in block.parts:
                    here, part = self.true(words, names) if words else F.lit(True), self.run(inner, names)
                    text = F.when(here, part) if text is None else text.when(here, part)
                out.append(text.otherwise(""))
        return F.concat(*out)
