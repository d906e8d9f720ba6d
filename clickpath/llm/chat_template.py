"""Chat formatting by a compiled, sandboxed template.

The language: text, ``{{ expression }}``, ``{% for x in name %}``, ``{% if %}``
with ``elif`` and ``else``, and ``{% generation %}`` around what a model is
trained on. Expressions have strings, whole numbers, names, fields
(``m.role``), ``loop.first`` and ``loop.index0``, ``==``, ``!=``, ``and``,
``or``, ``not``, ``+`` and the filters given to the compiler. Nothing else can
be reached: no calls, no attributes of Python objects.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Closure = Callable[[dict], Any]
Chunks = Callable[[dict], Iterator[tuple[str, bool]]]

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKENS = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.+|()]))""")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class TemplateError(ValueError):
    pass


# syntax trees are tuples: (kind, ...)

def _expression(source: str) -> tuple:
    tokens, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        tokens.append(next((kind, text) for kind, text in zip(("str", "int", "name", "op"), m.groups()) if text))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def take(*texts: str) -> str | None:
        nonlocal place
        if tokens[place][0] != "str" and tokens[place][1] in texts:
            place += 1
            return tokens[place - 1][1]
        return None

    def either() -> tuple:
        left = both()
        while take("or"):
            left = ("or", left, both())
        return left

    def both() -> tuple:
        left = inverse()
        while take("and"):
            left = ("and", left, inverse())
        return left

    def inverse() -> tuple:
        return ("not", inverse()) if take("not") else comparison()

    def comparison() -> tuple:
        left = joined()
        sign = take("==", "!=")
        return (sign, left, joined()) if sign else left

    def joined() -> tuple:
        left = filtered()
        while take("+"):
            left = ("+", left, filtered())
        return left

    def filtered() -> tuple:
        left = primary()
        while take("|"):
            left = ("filter", left, name())
        return left

    def name() -> str:
        nonlocal place
        kind, text = tokens[place]
        if kind != "name":
            raise TemplateError(f"a name is missing in {source!r}")
        place += 1
        return text

    def primary() -> tuple:
        nonlocal place
        kind, text = tokens[place]
        if take("("):
            inner = either()
            if not take(")"):
                raise TemplateError(f"no ) in {source!r}")
            return inner
        if kind == "str":
            place += 1
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            place += 1
            return ("const", int(text))
        tree = ("name", name())
        while take("."):
            tree = ("field", tree, name())
        return tree

    tree = either()
    if tokens[place][0] != "end":
        raise TemplateError(f"unexpected {tokens[place][1]!r} in {source!r}")
    return tree


def parse(template: str) -> list[tuple]:
    """The syntax tree: a list of nodes."""
    parts = [p for p in _PARTS.split(template) if p]
    place = 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal place
        nodes: list[tuple] = []
        while place < len(parts):
            part = parts[place]
            place += 1
            if part.startswith("{{"):
                nodes.append(("put", _expression(part[2:-2])))
            elif part.startswith("{%"):
                body = part[2:-2].strip()
                word, _, rest = body.partition(" ")
                if word in ends:
                    return nodes, body
                if word == "for":
                    m = re.fullmatch(r"(\w+)\s+in\s+(\w+)", rest.strip())
                    if not m:
                        raise TemplateError(f"cannot read {part!r}")
                    inner, _ = block(("endfor",))
                    nodes.append(("for", m[1], m[2], inner))
                elif word == "if":
                    arms, end = [], body
                    while not end.startswith("endif"):
                        test = ("const", True) if end.startswith("else") else _expression(end.partition(" ")[2])
                        inner, end = block(("elif", "else", "endif"))
                        arms.append((test, inner))
                    nodes.append(("if", arms))
                elif word == "generation":
                    inner, _ = block(("endgeneration",))
                    nodes.append(("generation", inner))
                else:
                    raise TemplateError(f"unknown tag {part!r}")
            else:
                nodes.append(("put", ("const", part)))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    return block(())[0]


def fold(tree: tuple, filters: dict[str, Callable[[str], str]]) -> tuple:
    """An expression with its constant parts worked out."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "field":
        return (kind, fold(tree[1], filters), tree[2])
    if kind == "filter":
        inner = fold(tree[1], filters)
        if tree[2] not in filters:
            raise TemplateError(f"unknown filter {tree[2]!r}")
        return ("const", filters[tree[2]](str(inner[1]))) if inner[0] == "const" else (kind, inner, tree[2])
    inner = [fold(t, filters) for t in tree[1:]]
    if kind == "+" and inner[0][0] == "+" and inner[1][0] == inner[0][2][0] == "const":
        return ("+", inner[0][1], ("const", _text(inner[0][2][1]) + _text(inner[1][1])))
    if all(t[0] == "const" for t in inner):
        return ("const", _closure((kind, *inner), filters)({}))
    return (kind, *inner)


def fold_nodes(nodes: list[tuple], filters: dict[str, Callable[[str], str]]) -> list[tuple]:
    """Nodes with constants folded: neighbouring texts joined, dead branches gone."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "put":
            node = ("put", fold(node[1], filters))
            if node[1][0] == "const" and out and out[-1][0] == "put" and out[-1][1][0] == "const":
                node = ("put", ("const", _text(out.pop()[1][1]) + _text(node[1][1])))
        elif node[0] == "for":
            node = (*node[:3], fold_nodes(node[3], filters))
        elif node[0] == "generation":
            node = ("generation", fold_nodes(node[1], filters))
        else:
            arms = []
            for test, inner in node[1]:
                test = fold(test, filters)
                if test[0] != "const" or test[1]:
                    arms.append((test, fold_nodes(inner, filters)))
                if test[0] == "const" and test[1]:
                    break
            if not arms:
                continue
            if arms[0][0][0] == "const":
                out += arms[0][1]
                continue
            node = ("if", arms)
        out.append(node)
    return out


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _closure(tree: tuple, filters: dict[str, Callable[[str], str]]) -> Closure:
    kind, *rest = tree
    if kind == "const":
        return lambda env, value=rest[0]: value
    if kind == "name":
        return lambda env, key=rest[0]: env.get(key)
    if kind == "field":
        inner, key = _closure(rest[0], filters), rest[1]

        def field(env: dict) -> Any:
            value = inner(env)
            return value.get(key) if isinstance(value, dict) else None

        return field
    if kind == "filter":
        inner, apply = _closure(rest[0], filters), filters[rest[1]]
        return lambda env: apply(_text(inner(env)))
    sides = [_closure(t, filters) for t in rest]
    a, b = sides[0], sides[-1]
    return {
        "or": lambda env: a(env) or b(env),
        "and": lambda env: a(env) and b(env),
        "not": lambda env: not a(env),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "+": lambda env: _text(a(env)) + _text(b(env)),
    }[kind]


def _chunks(nodes: list[tuple], filters: dict[str, Callable[[str], str]], trained: bool) -> Chunks:
    steps: list[Chunks] = []
    for node in nodes:
        if node[0] == "put":
            value = _closure(node[1], filters)
            steps.append(lambda env, value=value: iter(((_text(value(env)), trained),)))
        elif node[0] == "generation":
            steps.append(_chunks(node[1], filters, True))
        elif node[0] == "if":
            arms = [(_closure(test, filters), _chunks(inner, filters, trained)) for test, inner in node[1]]
            steps.append(lambda env, arms=arms: next((body(env) for test, body in arms if test(env)), iter(())))
        else:
            body = _chunks(node[3], filters, trained)

            def loop(env: dict, item: str = node[1], items: str = node[2], body: Chunks = body):
                for i, value in enumerate(env.get(items) or ()):
                    yield from body(env | {item: value, "loop": {"index0": i, "first": i == 0}})

            steps.append(loop)
    return lambda env: itertools.chain.from_iterable(step(env) for step in steps)


def compile_template(template: str, filters: dict[str, Callable[[str], str]]) -> Chunks:
    """A function from the variables to (text, trained on) chunks, made on demand.

    The loops pull their items one by one, so ``messages`` may be an iterator
    over a conversation of any length.
    """
    return _chunks(fold_nodes(parse(template), filters), filters, False)


# the format used here: control strings open with <|, which no escaped text holds

def escape(text: str) -> str:
    """``<|`` becomes ``<||``: what follows ``<|`` is then never a control word."""
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def escape_name(text: str) -> str:
    """For roles, which stand on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_name(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
FILTERS = {"escape": escape, "escape_name": escape_name}
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' + (m.role | escape_name) + '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_end|>' + '\\n' }}{% endfor %}"
)

PARTS_SCHEMA = "conv_id long, part long, formatted string, loss array<struct<start: long, end: long>>"


def formatted(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = 1 << 20) -> DataFrame:
    """conv_id, part, formatted, loss: the rendered conversations in parts.

    Parts of a conversation follow each other in their partition and join up to
    its whole output; a part ends after the chunk that reaches ``part_chars``.
    ``loss`` holds the spans of the part, in code points, that a model is
    trained on. Rows are rendered by (turn, role, text), nulls first; null
    roles and texts are empty; rows of a null conv_id are one conversation. A
    task holds one row and one part at a time, however long a conversation is.
    """
    rows = (conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        messages = (row for batch in batches for row in batch.to_pylist())
        out: list[tuple] = []
        held = 0
        for conv_id, turns in itertools.groupby(messages, key=lambda row: row["conv_id"]):
            part, chunks, loss, length = 0, [], [], 0
            for text, trained in render({"messages": turns}):
                if trained and text:
                    loss.append({"start": length, "end": length + len(text)})
                chunks.append(text)
                length += len(text)
                if length >= part_chars:
                    out.append((conv_id, part, "".join(chunks), loss))
                    held += length
                    part, chunks, loss, length = part + 1, [], [], 0
            if chunks or not part:
                out.append((conv_id, part, "".join(chunks), loss))
                held += length
            if held >= part_chars or len(out) >= 1000:
                yield _parts(out)
                out, held = [], 0
        if out:
            yield _parts(out)

    return rows.mapInArrow(run, PARTS_SCHEMA)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = dict(zip(("conv_id", "part", "formatted", "loss"), (pa.int64(), pa.int64(), pa.string(), spans)))
    return pa.RecordBatch.from_pydict(
        {name: pa.array([row[i] for row in rows], kind) for i, (name, kind) in enumerate(kinds.items())})


def read_turns(texts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn from the formatted output, piece by piece."""
    rest = ""
    for text in texts:
        *turns, rest = (rest + text).split(CLOSE)
        for turn in turns:
            role, _, body = turn.removeprefix(OPEN).partition("\n")
            yield unescape_name(role), unescape(body)
    if rest:
        raise ValueError("the output ends inside a turn")


READ_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
               "formatted_chars long")


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation, read from ``formatted``'s output alone.

    Takes the parts as ``formatted`` lays them out, so no further shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        out: list[tuple] = []
        for conv_id, own in itertools.groupby(rows, key=lambda row: row["conv_id"]):
            loss, chars, masked = hashlib.sha256(), 0, 0

            def texts(own=own):
                nonlocal chars, masked
                for row in own:
                    for span in row["loss"]:
                        trained = unescape(row["formatted"][span["start"]:span["end"]])
                        masked += len(trained)
                        loss.update(trained.encode())
                    chars += len(row["formatted"])
                    yield row["formatted"]

            digest, n = hashlib.sha256(), 0
            for role, text in read_turns(texts()):
                digest.update(f"{role}\n{text}\n".encode())
                n += 1
            out.append((conv_id, n, digest.hexdigest(), masked, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield _batch(names, out)
                out = []
        if out:
            yield _batch(names, out)

    return parts.mapInArrow(run, READ_SCHEMA)


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if "sha256" in n else pa.int64() for n in names]
    return pa.RecordBatch.from_pydict(
        {name: pa.array([row[i] for row in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds))})
