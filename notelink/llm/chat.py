"""Operator 8: chat formatting with a compiled template.

A template is parsed into a small syntax tree, constants are folded, and the
tree becomes nested Python closures that append to an output buffer. The
language is closed: names, keys of mappings, literals, comparisons, boolean
words, ``~`` for joining and the filters given to the compiler; there are no
calls, no attributes of Python objects, no imports.

    {{ expression }}    {% for x in list %}...{% endfor %}
    {% if a %}...{% elif b %}...{% else %}...{% endif %}
    {% generation %}...{% endgeneration %}   what a model is trained on

Expressions: ``'text'``, ``12``, ``true/false/none``, ``name.key.key``,
``loop.index/first/last``, ``== != and or not ~``, ``( )``, ``value | filter``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelink.llm.common import append_columns

# The markers of the format and other strings that a model's
# tokenizer may treat as control tokens.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]"]

TEMPLATE = (
    "{% for m in messages %}" + START + "{{ m.role | escape }}" + SEP
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    + "{% else %}{{ m.text | escape }}{% endif %}" + END + "{% endfor %}"
)


class TemplateError(ValueError):
    pass


# --- escaping ----------------------------------------------------------------

def _escape_re(control: list[str]) -> re.Pattern:
    """A backslash, or the first character of a control string (overlaps included)."""
    for c in control:
        if len(c) < 2 or "\\" in c:
            raise TemplateError(f"not usable as a control string: {c!r}")
    return re.compile("|".join([r"\\", *[f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in control]]))


_ESCAPE = _escape_re(CONTROL)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    r"""No control string is left, and ``unescape`` gives the text back: a backslash
    stands before the second character of each control string and before each backslash."""
    return _ESCAPE.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


# --- syntax tree -------------------------------------------------------------
# Statements: ("text", s) ("emit", e) ("for", name, e, body) ("if", [(e, body)], body) ("generation", body)
# Expressions: ("const", v) ("path", [keys]) ("not", e) (op, e, e) ("filter", name, e)

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z]\w*(?:\.[A-Za-z]\w*)*)|(==|!=|[()|~]))")
_WORDS = {"true": True, "false": False, "none": None}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        text, number, name, sign = m.groups()
        if text is not None:
            out.append(("const", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), text[1:-1])))
        elif number is not None:
            out.append(("const", int(number)))
        elif name in _WORDS:
            out.append(("const", _WORDS[name]))
        else:
            out.append(("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent: or < and < not < == != < ~ < filter < atom."""

    def __init__(self, source: str, filters: dict):
        self.tokens, self.at, self.filters = _tokens(source), 0, filters

    def take(self, *wanted) -> object | None:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self):
        tree = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def _left(self, below, *signs):
        tree = below()
        while (sign := self.take(*signs)) is not None:
            tree = fold_constant((sign, tree, below()))
        return tree

    def either(self):
        return self._left(self.both, ("name", "or"))

    def both(self):
        return self._left(self.negated, ("name", "and"))

    def negated(self):
        if self.take(("name", "not")):
            return fold_constant(("not", self.negated()))
        return self._left(self.joined, ("sign", "=="), ("sign", "!="))

    def joined(self):
        return self._left(self.filtered, ("sign", "~"))

    def filtered(self):
        tree = self.atom()
        while self.take(("sign", "|")):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def atom(self):
        if self.take(("sign", "(")):
            tree = self.either()
            if not self.take(("sign", ")")):
                raise TemplateError("missing )")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return ("const", value)
        if kind == "name" and value not in ("and", "or", "not"):
            return ("path", value.split("."))
        raise TemplateError(f"unexpected {value!r}")


def show(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


_BINARY = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "~": lambda a, b: show(a) + show(b),
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def fold_constant(tree):
    """An operation on constants is a constant."""
    if tree[0] == "not" and tree[1][0] == "const":
        return ("const", not tree[1][1])
    if tree[0] in _BINARY and tree[1][0] == tree[2][0] == "const":
        return ("const", _BINARY[tree[0]](tree[1][1], tree[2][1]))
    return tree


def parse(source: str, filters: dict[str, Callable] = FILTERS) -> list:
    """The folded syntax tree of a template."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at:m.start()]))
        pieces.append(("expr", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    stream = iter(pieces)
    tree, end = _body(stream, filters, False)
    if end:
        raise TemplateError(f"unexpected {end!r}")
    return tree


def _body(stream: Iterator, filters: dict, nested: bool) -> tuple[list, str]:
    """Statements up to a closing tag, and that tag ('' at the end of the template)."""
    out: list = []

    def put(text: str) -> None:
        if text and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + text)
        elif text:
            out.append(("text", text))

    for kind, value in stream:
        if kind == "text":
            put(value)
        elif kind == "expr":
            tree = _Expression(value, filters).whole()
            if tree[0] == "const":
                put(show(tree[1]))
            else:
                out.append(("emit", tree))
        else:
            word, _, rest = value.partition(" ")
            if word == "for":
                name, _, source = rest.strip().partition(" in ")
                if not re.fullmatch(r"[A-Za-z]\w*", name.strip()) or not source:
                    raise TemplateError(f"cannot read {value!r}")
                body, end = _body(stream, filters, True)
                _expect(end, "endfor")
                out.append(("for", name.strip(), _Expression(source, filters).whole(), body))
            elif word == "if":
                cases, last, test = [], [], _Expression(rest, filters).whole()
                while True:
                    body, end = _body(stream, filters, True)
                    cases.append((test, body))
                    if end.startswith("elif "):
                        test = _Expression(end[5:], filters).whole()
                        continue
                    if end == "else":
                        last, end = _body(stream, filters, True)
                    _expect(end, "endif")
                    break
                for s in _pruned(cases, last):
                    put(s[1]) if s[0] == "text" else out.append(s)
            elif word == "generation":
                body, end = _body(stream, filters, True)
                _expect(end, "endgeneration")
                out.append(("generation", body))
            elif nested and (word in ("endfor", "endif", "endgeneration", "else", "elif")):
                return out, value
            else:
                raise TemplateError(f"unexpected {value!r}")
    return out, ""


def _expect(found: str, wanted: str) -> None:
    if found != wanted:
        raise TemplateError(f"expected {wanted}, found {found!r}")


def _pruned(cases: list, last: list) -> list:
    """Cases with a constant test are decided while compiling."""
    left = []
    for test, body in cases:
        if test[0] != "const":
            left.append((test, body))
        elif test[1]:
            last = body
            break
    return [("if", left, last)] if left else last


# --- closures ----------------------------------------------------------------

class _Output:
    __slots__ = ("parts", "size", "spans", "depth")

    def __init__(self):
        self.parts, self.size, self.spans, self.depth = [], 0, [], 0

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(tree, filters: dict) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        v = tree[1]
        return lambda ctx: v
    if kind == "path":
        head, keys = tree[1][0], tree[1][1:]

        def look(ctx):
            v = ctx.get(head)
            for k in keys:
                v = v.get(k) if isinstance(v, dict) else None
            return v

        return look
    if kind == "not":
        inner = _value(tree[1], filters)
        return lambda ctx: not inner(ctx)
    if kind == "filter":
        inner, fn = _value(tree[2], filters), filters[tree[1]]
        return lambda ctx: fn(show(inner(ctx)))
    a, b = _value(tree[1], filters), _value(tree[2], filters)
    if kind == "and":
        return lambda ctx: a(ctx) and b(ctx)
    if kind == "or":
        return lambda ctx: a(ctx) or b(ctx)
    fn = _BINARY[kind]
    return lambda ctx: fn(a(ctx), b(ctx))


def _statements(body: list, filters: dict) -> Callable[[dict, _Output], None]:
    steps = [_statement(s, filters) for s in body]
    if len(steps) == 1:
        return steps[0]

    def run(ctx, out):
        for s in steps:
            s(ctx, out)

    return run


def _statement(s, filters: dict) -> Callable[[dict, _Output], None]:
    if s[0] == "text":
        text = s[1]
        return lambda ctx, out: out.put(text)
    if s[0] == "emit":
        value = _value(s[1], filters)
        return lambda ctx, out: out.put(show(value(ctx)))
    if s[0] == "generation":
        inner = _statements(s[1], filters)

        def marked(ctx, out):
            begin, out.depth = out.size, out.depth + 1
            inner(ctx, out)
            out.depth -= 1
            if not out.depth:
                out.spans.append((begin, out.size))

        return marked
    if s[0] == "if":
        cases, last = [(_value(t, filters), _statements(b, filters)) for t, b in s[1]], _statements(s[2], filters)

        def choose(ctx, out):
            for test, body in cases:
                if test(ctx):
                    return body(ctx, out)
            return last(ctx, out)

        return choose
    name, many, body = s[1], _value(s[2], filters), _statements(s[3], filters)

    def each(ctx, out):
        items = many(ctx)
        items = items if isinstance(items, list) else []
        for i, item in enumerate(items):
            body({**ctx, name: item, "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, out)

    return each


def compile_template(source: str, filters: dict[str, Callable] = FILTERS) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to the rendered text and its generation spans (characters)."""
    run = _statements(parse(source, filters), filters)

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        run(variables, out)
        return "".join(out.parts), out.spans

    return render


# --- on conversations --------------------------------------------------------

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_TURN = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def conversations(turns: DataFrame) -> DataFrame:
    """One row per ``conv_id`` with its messages by ``turn``; a formatted conversation is
    one value, so its turns do meet in one row. Equal turn numbers go by role, then
    text; a null turn comes first; null role or text is empty; repeated rows all stay; rows with a
    null ``conv_id`` are one conversation, whose id is null."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("messages"))


def format_chat(convs: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``convs`` (with ``messages``: array of role and text) with ``formatted`` and ``loss_spans``
    (character ranges that a generation block rendered; one per block, in order).

    An empty or null list of messages renders the template over no messages;
    existing columns with these names are replaced. A wrong template raises
    before any job starts.
    """
    parse(template)

    def build():
        render = compile_template(template)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            done = [render({"messages": m or []}) for m in batch.column("messages").to_pylist()]
            return [pa.array([t for t, _ in done], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done],
                             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]

        return each

    return append_columns(convs, [T.StructField("formatted", T.StringType()), T.StructField("loss_spans", _SPAN)], build)


_READ = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.S)


def read_chat(formatted: DataFrame) -> DataFrame:
    """The turns and the loss texts, read back from ``formatted`` and ``loss_spans`` alone."""

    def build():
        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column("formatted").to_pylist()
            spans = batch.column("loss_spans").to_pylist()
            turns = [[{"role": unescape(r), "text": unescape(t)} for r, t in _READ.findall(x or "")] for x in texts]
            loss = [[unescape(x[s["start"]:s["end"]]) for s in m or []] for x, m in zip(texts, spans)]
            return [pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                    pa.array(loss, pa.list_(pa.string()))]

        return each

    return append_columns(formatted, [T.StructField("turns", _TURN), T.StructField("loss_texts", T.ArrayType(T.StringType()))], build)
