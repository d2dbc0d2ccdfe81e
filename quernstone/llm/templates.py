"""A sandboxed template language for conversations, compiled to Python closures.

    {{ expression }}                                   output
    {% for m in messages %} ... {% endfor %}           the only loop is over the messages
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = e %}                                 from here on, within the message or the text outside the loop
    {% generation %} ... {% endgeneration %}           marks what a model is trained to produce
    {# comment #}

Expressions: strings, integers, true, false, none, names, message.role, message.content, loop.first, loop.last, loop.index,
loop.index0, + (texts or integers), == != < <= > >=, and, or, not, in, parentheses, and the filters escape_control, escape_line,
trim, upper, lower, length. There are no calls, other attributes or imports: a template can only read what it is given. The
parser makes a syntax tree, constant parts are folded, and each node becomes a closure that yields text and generation marks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

#: What a rendering yields for the two ends of a generation.
BEGIN, END = object(), object()

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+<>()|.]))""")
# What a backslash stands for in a string.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_CONSTANTS = {"true": True, "false": False, "none": None}
_KEYWORDS = {"and", "or", "not", "in"}


class TemplateError(ValueError):
    pass


def escape_control(text: str) -> str:
    r"""text without any "<|": each run of "<", backslashes and "|" gets one backslash more. unescape_control takes it back."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape_control(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_line(text: str) -> str:
    r"""text on one line and without control strings; unescape_line takes it back."""
    return escape_control(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_control(text), flags=re.S)


def _added(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str) or type(a) is int and type(b) is int:
        return a + b
    raise TemplateError(f"can't add {type(a).__name__} and {type(b).__name__}")


def _ordered(f: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    def compare(a: Any, b: Any) -> bool:
        if type(a) is not type(b) or not isinstance(a, int | str):
            raise TemplateError("only two texts or two integers have an order")
        return f(a, b)

    return compare


def _within(a: Any, b: Any) -> bool:
    if not (isinstance(a, str) and isinstance(b, str)):
        raise TemplateError("in takes two texts")
    return a in b


FILTERS: dict[str, Callable[[str], Any]] = {"escape_control": escape_control, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}
OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "+": _added, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": _within,
    "<": _ordered(lambda a, b: a < b), "<=": _ordered(lambda a, b: a <= b), ">": _ordered(lambda a, b: a > b), ">=": _ordered(lambda a, b: a >= b),
}


# The syntax tree.


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str
    attribute: str = ""


@dataclass(frozen=True)
class Op:
    sign: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    of: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Expression:
    """A parser by precedence over one tag's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str:
        kind, value = self.peek()
        if kind != "text" and value in values:
            self.at += 1
            return value
        return ""

    def whole(self) -> Any:
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Op("or", left, self.both())
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Op("and", left, self.negated())
        return left

    def negated(self) -> Any:
        return Not(self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.added()
        while sign := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            left = Op(sign, left, self.added())
        return left

    def added(self) -> Any:
        left = self.filtered()
        while self.take("+"):
            left = Op("+", left, self.filtered())
        return left

    def filtered(self) -> Any:
        tree = self.single()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = Filter(name, tree)
        return tree

    def single(self) -> Any:
        kind, value = self.peek()
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if value == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis isn't closed")
            return tree
        if kind == "name" and value in _CONSTANTS:
            return Const(_CONSTANTS[value])
        if kind == "name" and value not in _KEYWORDS:
            attribute = ""
            if self.take("."):
                kind, attribute = self.peek()
                self.at += 1
                if kind != "name":
                    raise TemplateError("an attribute's name is missing")
            return Name(value, attribute)
        raise TemplateError(f"unexpected {value!r}" if value else "the expression ends too soon")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    at, strip = 0, False

    def literal(text: str, before: bool) -> None:
        text = text.lstrip() if strip else text
        text = text.rstrip() if before else text
        if text:
            stack[-1][2].append(Output(Const(text)))

    for m in _TAGS.finditer(source):
        literal(source[at : m.start()], m[2] == "-")
        at, strip = m.end(), m[4] == "-"
        if m[1] is not None:
            stack[-1][2].append(Output(_Expression(m[1]).whole()))
        elif m[3] is not None:
            _tag(m[3].strip(), stack)
    literal(source[at:], False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return tuple(stack[0][2])


def _tag(text: str, stack: list) -> None:
    word, _, rest = text.partition(" ")
    body = stack[-1][2]
    if word == "for":
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
        if not m or any(kind == "for" for kind, _, _ in stack):
            raise TemplateError("a loop must be 'for name in messages', and loops can't be nested")
        stack.append(("for", m[1], []))
    elif word == "if":
        stack.append(("if", [], []))
        stack[-1][1].append((_Expression(rest).whole(), stack[-1][2]))
    elif word in ("elif", "else"):
        if stack[-1][0] != "if" or stack[-1][1][-1][0] is None:
            raise TemplateError(f"{word} without if")
        stack[-1] = ("if", stack[-1][1], [])
        stack[-1][1].append((_Expression(rest).whole() if word == "elif" else None, stack[-1][2]))
    elif word == "set":
        name, sign, value = rest.partition("=")
        if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
            raise TemplateError("set needs a name and a value")
        body.append(Set(name.strip(), _Expression(value).whole()))
    elif word == "generation":
        if any(kind == "generation" for kind, _, _ in stack):
            raise TemplateError("generations can't be nested")
        stack.append(("generation", None, []))
    elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
        kind, head, nodes = stack.pop()
        if kind == "for":
            made: tuple = (For(head, tuple(nodes)),)
        elif kind == "generation":
            made = (Generation(tuple(nodes)),)
        else:
            made = ()
            for test, branch in reversed(head):
                made = tuple(branch) if test is None else (If(test, tuple(branch), made),)
        stack[-1][2].extend(made)
    else:
        raise TemplateError(f"unexpected tag {text!r}")


def _shown(value: Any) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def fold(tree: Any) -> Any:
    """The tree with constant expressions worked out, decided branches chosen and neighbouring constant texts joined."""
    if isinstance(tree, tuple):
        out: list = []
        for node in map(fold, tree):
            for x in node if isinstance(node, tuple) else (node,):
                if isinstance(x, Output) and isinstance(x.of, Const):
                    x = Output(Const(_shown(x.of.value)))
                    if not x.of.value:
                        continue
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].of, Const):
                        out[-1] = Output(Const(out[-1].of.value + x.of.value))
                        continue
                out.append(x)
        return tuple(out)
    if isinstance(tree, Op):
        left, right = fold(tree.left), fold(tree.right)
        if isinstance(left, Const) and tree.sign in ("and", "or"):
            return right if bool(left.value) == (tree.sign == "and") else left
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(OPERATORS[tree.sign](left.value, right.value))
        return Op(tree.sign, left, right)
    if isinstance(tree, Not):
        of = fold(tree.of)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(tree, Filter):
        of = fold(tree.of)
        return Const(FILTERS[tree.name](_text(of.value))) if isinstance(of, Const) else Filter(tree.name, of)
    if isinstance(tree, Output):
        return Output(fold(tree.of))
    if isinstance(tree, If):
        test = fold(tree.test)
        if isinstance(test, Const):
            return fold(tree.then if test.value else tree.other)
        return If(test, fold(tree.then), fold(tree.other))
    if isinstance(tree, For):
        return For(tree.name, fold(tree.body))
    if isinstance(tree, Set):
        return Set(tree.name, fold(tree.of))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body))
    return tree


def _text(value: Any) -> str:
    if not isinstance(value, str):
        raise TemplateError("a filter needs a text")
    return value


def _value(tree: Any) -> Callable[[dict], Any]:
    """A closure that works out an expression."""
    if isinstance(tree, Const):
        return lambda scope: tree.value
    if isinstance(tree, Name):
        name, attribute = tree.name, tree.attribute

        def read(scope: dict) -> Any:
            if name not in scope:
                raise TemplateError(f"no name {name!r}")
            value = scope[name]
            if not attribute:
                return value
            if not isinstance(value, dict) or attribute not in value:
                raise TemplateError(f"{name} has no {attribute!r}")
            return value[attribute]

        return read
    if isinstance(tree, Not):
        of = _value(tree.of)
        return lambda scope: not of(scope)
    if isinstance(tree, Filter):
        of, f = _value(tree.of), FILTERS[tree.name]
        return lambda scope: f(_text(of(scope)))
    left, right = _value(tree.left), _value(tree.right)
    if tree.sign == "and":
        return lambda scope: left(scope) and right(scope)
    if tree.sign == "or":
        return lambda scope: left(scope) or right(scope)
    f = OPERATORS[tree.sign]
    return lambda scope: f(left(scope), right(scope))


def _closure(tree: Any) -> Callable[[dict, Iterable[dict]], Iterator]:
    """A closure that yields a node's texts and marks."""
    if isinstance(tree, tuple):
        parts = [_closure(x) for x in tree]

        def sequence(scope: dict, messages: Iterable[dict]) -> Iterator:
            for part in parts:
                yield from part(scope, messages)

        return sequence
    if isinstance(tree, Output):
        if isinstance(tree.of, Const):
            text = _shown(tree.of.value)
            return lambda scope, messages: iter((text,))
        value = _value(tree.of)
        return lambda scope, messages: iter((_shown(value(scope)),))
    if isinstance(tree, If):
        test, then, other = _value(tree.test), _closure(tree.then), _closure(tree.other)
        return lambda scope, messages: (then if test(scope) else other)(scope, messages)
    if isinstance(tree, Set):
        value, name = _value(tree.of), tree.name

        def assign(scope: dict, messages: Iterable[dict]) -> Iterator:
            scope[name] = value(scope)
            return iter(())

        return assign
    body = _closure(tree.body)
    if isinstance(tree, Generation):

        def generation(scope: dict, messages: Iterable[dict]) -> Iterator:
            yield BEGIN
            yield from body(scope, messages)
            yield END

        return generation
    name = tree.name

    def loop(scope: dict, messages: Iterable[dict]) -> Iterator:
        ahead = iter(messages)
        message, i = next(ahead, None), 0
        while message is not None:  # one message ahead is all that is held
            following = next(ahead, None)
            yield from body({**scope, name: message, "loop": {"first": i == 0, "last": following is None, "index": i + 1, "index0": i}}, ())
            message, i = following, i + 1

    return loop


class Template:
    """A compiled template. render(messages) yields texts, BEGIN and END; messages may be an iterator, of which one is held ahead."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = _closure(self.tree)

    def render(self, messages: Iterable[dict], **names: Any) -> Iterator:
        return self._run(dict(names), messages)
