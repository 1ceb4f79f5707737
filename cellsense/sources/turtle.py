"""A reader of Turtle texts."""

from __future__ import annotations

import re
from urllib.parse import urljoin

RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"

_TOKEN = re.compile(
    r"""(?P<space>\s++|\#[^\n]*+)
    |(?P<iri><[^<>"{}|^`\x00-\x20]*+>)
    |(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3})
    |(?P<text>"(?:[^"\\\n\r]|\\.)*+"|'(?:[^'\\\n\r]|\\.)*+')
    |(?P<order>@prefix\b|@base\b|(?i:prefix|base)(?=\s))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<double>[+-]?(?:\d+\.\d*|\.?\d+)[eE][+-]?\d+)|(?P<decimal>[+-]?\d*\.\d+)|(?P<integer>[+-]?\d+)
    |(?P<blank>_:\w(?:[\w.-]*[\w-])?)
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:[\w:%-]|\\.|\.(?=[\w:%.\\-]))*)
    |(?P<boolean>(?:true|false)\b)|(?P<a>a\b)
    |(?P<mark>\^\^|[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), s) if "\\" in s else s


class Failure(ValueError):
    """A place where a text isn't Turtle."""


class _Reader:
    def __init__(self, text: str, scope: str, out: list, prefixes: dict[str, str] | None = None, base: str = "", part: str = ""):
        self.text, self.scope, self.out, self.at, self.part = text, scope, out, 0, part
        self.prefixes: dict[str, str] = dict(prefixes or {})
        self.base, self.made = base, 0
        self.kind = self.value = ""
        self.next()

    def fail(self, what: str):
        raise Failure(f"{self.scope}: {what} expected at character {self.at - len(self.value)}, found {self.value[:40]!r}")

    def next(self) -> str:
        """Step to the next token; the value of the one before."""
        before = self.value
        while True:
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return before
            m = _TOKEN.match(self.text, self.at)
            if not m:
                self.value = self.text[self.at : self.at + 40]
                self.at += len(self.value)
                self.fail("a token")
            self.at, self.kind, self.value = m.end(), m.lastgroup, m[0]
            if self.kind != "space":
                return before

    def mark(self, value: str) -> bool:
        return self.kind == "mark" and self.value == value

    def expect(self, value: str) -> None:
        if not self.mark(value):
            self.fail(repr(value))
        self.next()

    def iri(self) -> str:
        if self.kind == "iri":
            return urljoin(self.base, x) if (x := _unescape(self.next()[1:-1])) and self.base and ":" not in x.split("/")[0] else x or self.base
        if self.kind == "name":
            prefix, _, local = self.value.partition(":")
            if prefix not in self.prefixes:
                self.fail("a known prefix")
            self.next()
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        self.fail("an address")

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}##{self.part}{self.made}"

    def resource(self) -> tuple[str, str] | None:
        """(value, kind) of a node that may be a subject."""
        if self.kind in ("iri", "name"):
            return self.iri(), "uri"
        if self.kind == "blank":
            return f"_:{self.scope}#{self.next()[2:]}", "blank"
        if self.mark("["):
            self.next()
            node = self.fresh()
            if not self.mark("]"):
                self.predicates(node)
            self.expect("]")
            return node, "blank"
        if self.mark("("):
            self.next()
            items = []
            while not self.mark(")"):
                items.append(self.object())
            self.next()
            nodes = [self.fresh() for _ in items]
            for i, (node, item) in enumerate(zip(nodes, items, strict=True)):
                self.out.append((node, RDF + "first", *item))
                rest = (nodes[i + 1], "blank") if i + 1 < len(nodes) else (RDF + "nil", "uri")
                self.out.append((node, RDF + "rest", *rest, None, None))
            return (nodes[0], "blank") if nodes else (RDF + "nil", "uri")
        return None

    def object(self) -> tuple:
        """(value, kind, datatype, language)."""
        if self.kind in ("text", "long"):
            cut = 3 if self.kind == "long" else 1
            value = _unescape(self.next()[cut:-cut])
            if self.kind == "lang":
                return value, "literal", None, self.next()[1:]
            if self.mark("^^"):
                self.next()
                return value, "literal", self.iri(), None
            return value, "literal", None, None
        if self.kind in ("integer", "decimal", "double", "boolean"):
            kind = self.kind
            return self.next(), "literal", XSD + kind, None
        if node := self.resource():
            return (*node, None, None)
        self.fail("an object")

    def predicates(self, subject: str) -> None:
        while True:
            if self.kind == "a":
                self.next()
                p = RDF + "type"
            else:
                p = self.iri()
            while True:
                self.out.append((subject, p, *self.object()))
                if not self.mark(","):
                    break
                self.next()
            if not self.mark(";"):
                return
            while self.mark(";"):
                self.next()
            if self.mark(".") or self.mark("]"):
                return

    def document(self) -> None:
        while self.kind != "end":
            if self.kind == "order":
                order = self.next()
                if order.lstrip("@").lower() == "prefix":
                    if self.kind != "name" or not self.value.endswith(":"):
                        self.fail("a prefix")
                    name = self.next()[:-1]
                    self.prefixes[name] = self.iri()
                else:
                    self.base = self.iri()
                if order.startswith("@"):
                    self.expect(".")
                continue
            bare = self.mark("[")
            node = self.resource()
            if node is None:
                self.fail("a subject")
            if not (bare and self.mark(".")):
                self.predicates(node[0])
            self.expect(".")


def parse(text: str, scope: str = "", strict: bool = True) -> list[tuple]:
    """(s, p, o, kind, datatype, language) of a Turtle text; ``scope`` keeps its blank nodes apart from others'."""
    out: list[tuple] = []
    try:
        _Reader(text, scope, out).document()
    except ValueError:
        if strict:
            raise
    return out


def statements(text: str, scope: str, out: list[tuple], prefixes: dict[str, str], base: str, part: str) -> None:
    """Append the triples of a part of a Turtle text; ``part`` keeps its nodes without a name apart from other parts'. Raises Failure."""
    _Reader(text, scope, out, prefixes, base, part).document()


def state_after(text: str, prefixes: dict[str, str], base: str) -> tuple[dict[str, str], str]:
    """The prefixes and the base behind a part of a Turtle text, as far as it can be read."""
    reader = None
    try:
        reader = _Reader(text, "", [], prefixes, base)
        reader.document()
    except Failure:
        pass
    return (reader.prefixes, reader.base) if reader else (prefixes, base)
