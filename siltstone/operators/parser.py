"""A reader of JavaScript and TypeScript that finds declarations and statements, and where they begin and end.

It is a lexer that knows strings, templates, regular expressions and comments, and a parser of statements, class bodies
and the blocks inside expressions. It gives the nodes that splitting needs, not a full syntax tree: types, enums and
expressions are nodes without a kind of their own. JSX text with unbalanced quotes or brackets isn't understood.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from ..functions.paths import LanguageProvider

_PUNCT = re.compile(r"=>|\.\.\.|[-+*/%=<>!&|^~?:]+=?|.", re.S)
_TOKEN = re.compile(
    r"\s*+(?:(?P<word>[\w$\u0080-￿#]+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<template>`)|(?P<slash>/)|(?P<punct>=>|\.\.\.|[-+*/%=<>!&|^~?:]+=?|.))?",
    re.S,
)
_CLOSED = re.compile(r"\s*+\}")
#: What matters for where a block ends: brackets, and what may hold some that don't count.
_BRACKETS = re.compile(r"[(){}\[\]`]|//[^\n]*|/\*.*?(?:\*/|\Z)|/|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S)
#: A method without decorators, modifiers, types or defaults, up to its body.
_METHOD = re.compile(r"\s*+([A-Za-z_$][\w$]*+)\s*+\(([\w$\s,]*+)\)\s*+\{")
#: An import of a module on one line but for what its braces hold, and a class without type parameters, up to its body.
_IMPORT = re.compile(r"\s*+(import(?![\w$])[\w$,* \t]*+(?:\{[\w$\s,]*+\}[ \t]*+from[ \t]*+)?(?:\"[^\"\\\n]*+\"|'[^'\\\n]*+')[ \t]*+;)")
_CLASS = re.compile(r"\s*+(export\s++)?((abstract\s++)?class\s++(?!(?:extends|implements|class|abstract)\b)([A-Za-z_$][\w$]*+)[\w$.,\s]*+)\{")
#: With these a block may end elsewhere than at the brace that matches.
_UNPLAIN = ("<", "@", "function", "class", "interface", "namespace", "module", "enum")


def _nested(depth: int) -> str:
    """What a block may hold up to so many brackets deep: no slash or template, and only strings that end."""
    held = r"[^(){}\[\]`/\"']++|\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'"
    inner = _nested(depth - 1) if depth else ""
    return rf"(?:{held}" + (rf"|\({inner}\)|\[{inner}\]|\{{{inner}\}}" if depth else "") + ")*+"


#: A block that is sure at a glance, and a method with one; the end of a text.
_BLOCK = re.compile(rf"\{{{_nested(3)}\}}", re.S)
_WHOLE_METHOD = re.compile(_METHOD.pattern.removesuffix(r"\{") + rf"(\{{{_nested(3)}\}})", re.S)
_END = re.compile(r"\s*+\Z")
#: Texts that aren't longer are looked through once for words that no plain block has.
_LOOKED_THROUGH = 4_000
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_CONTINUES = {"in", "of", "instanceof", "as", "satisfies", "extends", "implements"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "async", "get", "set", "declare", "accessor"}
_CLOSED_BY = {"(": ")", "[": "]", "{": "}"}
_STATEMENTS = {
    "if": "if_statement", "for": "for_statement", "while": "while_statement", "switch": "switch_statement", "try": "try_statement",
    "do": "do_statement",
}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int


class Node:
    """A declaration or statement. The body of a function that was passed over is read when it is asked for.

    `brace` is where the body of a plain one begins.
    """

    __slots__ = ("kind", "start", "end", "name", "children", "brace", "_body", "_later")

    def __init__(self, kind: str, start: int, end: int = 0, name: str | None = None):
        self.kind, self.start, self.end, self.name = kind, start, end, name
        self.children: list[Node] = []
        self.brace: int | None = None
        self._body: list[Node] | None = None
        self._later: tuple[str, bool, int] | None = None

    @property
    def body(self) -> list[Node] | None:
        if self._later is not None:
            self._body, self._later = Parser(*self._later).block(), None
        return self._body

    @body.setter
    def body(self, nodes: list[Node] | None) -> None:
        self._body = nodes


def tokens(text: str) -> list[Token]:
    reader = Parser(text, True)
    while reader.read():
        pass
    return reader.tokens


def _plain(text: str, at: int, end: int) -> int | None:
    block = text[at:end]
    for word in _UNPLAIN:
        if word in block:
            return None
    return end


def plain_end(text: str, at: int) -> int | None:
    """Where a block that begins at a brace ends, if that is sure without reading its statements: behind the brace that matches."""
    if m := _BLOCK.match(text, at):
        return _plain(text, at, m.end())
    open_: list[str] = []
    go_on = at
    while True:
        for m in _BRACKETS.finditer(text, go_on):
            mark = m[0]
            if mark in _CLOSED_BY:
                open_.append(_CLOSED_BY[mark])
            elif mark in (")", "]", "}"):
                if open_.pop() != mark:
                    return None
                if not open_:
                    return _plain(text, at, m.end())
            elif mark == "/":  # a division, or an expression that begins
                return None
            elif mark == "`":
                go_on = _template_end(text, m.start())
                break
        else:
            return None


def _regex_may_start(previous: Token | None) -> bool:
    if previous is None:
        return True
    if previous.kind == "word":
        return previous.text in _BEFORE_REGEX
    return previous.kind == "punct" and previous.text not in (")", "]", "}")


def _template_end(text: str, at: int) -> int:
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = _template_end(text, at)
                    continue
                depth += {"{": 1, "}": -1}.get(text[at], 0)
                at += 1
        else:
            at += 1
    return len(text)


class Parser:
    """Tokens are read as they are looked at, and bodies of functions are passed over where their end is sure."""

    def __init__(self, text: str, typed: bool, begin: int = 0):
        self.text, self.typed = text, typed
        self.tokens: list[Token] = []
        self.at, self.read_to, self.line, self.previous = 0, begin, 0, None
        self.listed = 0  # in how many brackets all tokens are wanted
        self.field_kind = "public_field_definition" if typed else "field_definition"

    def read(self) -> bool:
        """One token more; false at the text's end."""
        text, at = self.text, self.read_to
        m = _TOKEN.match(text, at)
        kind = m.lastgroup
        if kind is None:
            return False
        begin, end = m.span(kind)
        if begin != at:
            self.line += text.count("\n", at, begin)
        if kind == "template":
            kind, end = "string", _template_end(text, begin)
        elif kind == "slash":
            if _regex_may_start(self.previous) and (r := _REGEX.match(text, begin)):
                kind, end = "string", r.end()
            else:
                kind, end = "punct", _PUNCT.match(text, begin).end()
        if kind == "punct" and end - begin > 1 and (cut := text.find("/", begin + 1, end)) >= 0:
            end = cut
        token = Token(kind, text[begin:end], begin, end, self.line)
        self.tokens.append(token)
        self.read_to = end
        if kind != "comment":
            self.previous = token
        if kind in ("comment", "string"):
            self.line += token.text.count("\n")
        return True

    def peek(self, ahead: int = 0) -> Token | None:
        """The next token but for comments."""
        i, known = self.at, self.tokens
        while i < len(known) or self.read():
            token = known[i]
            if token.kind != "comment":
                if not ahead:
                    return token
                ahead -= 1
            i += 1
        return None

    def is_(self, *texts: str) -> bool:
        i, known = self.at, self.tokens
        while i < len(known) or self.read():
            token = known[i]
            if token.kind != "comment":
                return token.text in texts and token.kind != "string"
            i += 1
        return False

    def take(self, into: list[Node]) -> Token:
        """The next token; comments on the way become nodes."""
        self.comments(into)
        if self.at == len(self.tokens) and not self.read():
            return Token("end", "", self.last_end(), self.last_end(), 0)
        self.at += 1
        return self.tokens[self.at - 1]

    def comments(self, into: list[Node]) -> bool:
        """Comments that are next become nodes; whether there are any."""
        begin = self.at
        while (self.at < len(self.tokens) or self.read()) and self.tokens[self.at].kind == "comment":
            token = self.tokens[self.at]
            into.append(Node("comment", token.start, token.end))
            self.at += 1
        return self.at > begin

    def before(self) -> Token | None:
        """The last token that was taken, but for comments."""
        i = self.at - 1
        while i >= 0 and self.tokens[i].kind == "comment":
            i -= 1
        return self.tokens[i] if i >= 0 else None

    def last_end(self) -> int:
        return self.tokens[self.at - 1].end if self.at else 0

    def statements(self) -> list[Node]:
        """Up to a closing brace or the end."""
        out: list[Node] = []
        while True:
            self.plain_statements(out)
            if self.at == len(self.tokens) and _END.match(self.text, self.read_to):
                return out
            if self.comments(out):
                continue
            if self.peek() is None or self.is_("}"):
                return out
            before = self.at
            out.append(self.statement())
            if self.at == before:  # nothing was understood: go on behind it
                self.at += 1

    def block(self) -> list[Node]:
        """The statements between braces."""
        self.take([])
        out = self.statements()
        if self.peek() is not None:
            self.take(out)
        return out

    def function_body(self, node: Node) -> None:
        """The block of a function: passed over if its end is sure."""
        opened = self.peek()
        end = None if self.listed else plain_end(self.text, opened.start)
        if end is None:
            node.body = self.block()
            return
        self.take([])
        self.pass_over(node, opened, opened.start, end)

    def pass_over(self, node: Node, known: Token, brace: int, end: int) -> None:
        """Go on behind a block that begins at a brace, at or after a token that is known."""
        del self.tokens[self.at :]
        self.line = known.line + self.text.count("\n", known.start, end)
        self.previous = Token("punct", "}", end - 1, end, self.line)
        self.tokens.append(self.previous)
        self.at, self.read_to = self.at + 1, end
        node._later = (self.text, self.typed, brace)

    def next_start(self) -> int:
        """Where to look for what needs no tokens: at the next token that is known, or behind the last one."""
        return self.tokens[self.at].start if self.at < len(self.tokens) else self.read_to

    def go_on(self, end: int, kind: str, last: str) -> None:
        """Go on at a place further on without tokens; the last one before it is told."""
        begin = self.next_start()
        if self.at < len(self.tokens):
            self.line = self.tokens[self.at].line
            del self.tokens[self.at :]
        self.line += self.text.count("\n", begin, end)
        self.previous = Token(kind, last, end - len(last), end, self.line)
        self.tokens.append(self.previous)
        self.at, self.read_to = self.at + 1, end

    def plain_methods(self, out: list[Node]) -> None:
        """Methods that are next and need no tokens; they are added and passed over."""
        if self.listed:
            return
        text = self.text
        begin = at = self.next_start()
        clean = None
        while True:
            if m := _WHOLE_METHOD.match(text, at):
                if clean is None:
                    clean = len(text) - begin <= _LOOKED_THROUGH and _plain(text, begin, len(text)) is not None
                brace, end = m.span(3)
                if not clean and _plain(text, m.start(1), end) is None:
                    break
            else:
                m = _METHOD.match(text, at)
                if m is None or "class" in m[2] or "function" in m[2]:
                    break
                brace = m.end() - 1
                end = plain_end(text, brace)
                if end is None:
                    break
            node = Node("method_definition", m.start(1), end, m[1])
            node.brace, node._later = brace, (text, self.typed, brace)
            out.append(node)
            at = end
        if at > begin:
            self.go_on(at, "punct", "}")

    def plain_statements(self, out: list[Node]) -> None:
        """Imports and classes that are next and whose heads need no tokens."""
        text = self.text
        while not self.listed:
            at = self.next_start()
            if m := _IMPORT.match(text, at):
                if "class" in m[1] or "function" in m[1]:
                    return
                out.append(Node("import_statement", m.start(1), m.end()))
                self.go_on(m.end(), "punct", ";")
            elif m := _CLASS.match(text, at):
                node = Node("abstract_class_declaration" if m[3] else "class_declaration", m.start(2), name=m[4])
                node.brace = m.end() - 1
                self.go_on(m.end(), "punct", "{")
                node.body = self.members([])
                self.finish(node)
                if m[1]:
                    whole = Node("statement", m.start(1), node.end)
                    whole.children.append(node)
                    node = whole
                out.append(node)
            else:
                return

    def finish(self, node: Node) -> Node:
        node.end = self.last_end()
        return node

    def statement(self) -> Node:
        first = self.peek()
        node = Node("statement", first.start)
        if self.is_("{"):
            node.children = self.block()
            return self.finish(node)
        if self.is_("@"):
            self.decorators(node.children)
            if self.peek() is None:
                return self.finish(node)
        if first.kind == "word":
            word, following = first.text, self.peek(1)
            after = following.text if following else ""
            if word == "import" and after not in ("(", "."):
                node.kind = "import_statement"
                self.expression(node.children)
                return self.finish(node)
            if word == "export":
                self.take(node.children)
                while self.is_("default", "declare"):
                    self.take(node.children)
                if self.is_("class", "function", "async", "interface", "const", "let", "var", "abstract", "enum", "type", "namespace", "module", "@", "import"):
                    node.children.append(self.statement())
                else:
                    self.expression(node.children)
                return self.finish(node)
            if word == "declare" and following and following.kind == "word":
                self.take(node.children)
                node.children.append(self.statement())
                return self.finish(node)
            if word == "abstract" and after == "class" or word == "class":
                return self.class_(node, word == "abstract")
            if word == "interface" and following and following.kind == "word":
                node.kind, node.name = "interface_declaration", None
                self.until_brace(node.children)
                node.body = self.braces() if self.is_("{") else []
                return self.finish(node)
            if word == "function" or word == "async" and after == "function":
                return self.function(node)
            if word in ("const", "let") and not (word == "const" and after == "enum"):
                node.kind = "lexical_declaration"
                self.expression(node.children)
                return self.finish(node)
            if word in ("namespace", "module") and following and following.kind in ("word", "string"):
                self.until_brace(node.children)
                if self.is_("{"):
                    node.children += self.block()
                return self.finish(node)
            if word == "enum" or word == "const" and after == "enum":
                self.until_brace(node.children)
                node.children += self.braces() if self.is_("{") else []
                return self.finish(node)
            if word in _STATEMENTS and after != ":":
                return self.control(node, word)
        self.expression(node.children)
        return self.finish(node)

    def decorators(self, into: list[Node]) -> None:
        while self.is_("@"):
            self.take(into)
            self.take(into)
            while self.is_("."):
                self.take(into)
                self.take(into)
            if self.is_("("):
                self.brackets(into)

    def class_(self, node: Node, abstract: bool) -> Node:
        node.kind = "abstract_class_declaration" if abstract else "class_declaration"
        while self.is_("abstract", "class"):
            self.take(node.children)
        if not self.is_("{", "extends"):
            node.name = self.take(node.children).text
        self.until_brace(node.children)
        node.body = self.class_body() if self.is_("{") else []
        return self.finish(node)

    def function(self, node: Node) -> Node:
        node.kind = "function_declaration"
        while self.is_("async", "function", "*"):
            if self.take(node.children).text == "*":
                node.kind = "generator_function_declaration"
        if not self.is_("("):
            node.name = self.take(node.children).text
        self.signature(node.children)
        if self.is_("{"):
            self.function_body(node)
        else:  # an overload has no body
            node.kind = "function_signature"
            if self.is_(";"):
                self.take(node.children)
        return self.finish(node)

    def signature(self, into: list[Node]) -> None:
        """Type parameters, parameters and result type, up to a body or an end."""
        while self.peek() is not None and not self.is_("("):
            self.take(into)
        if self.is_("("):
            self.brackets(into)
        if self.is_(":"):
            self.take(into)
            while self.peek() is not None and not self.is_(";", "}"):
                if self.is_("{"):
                    before = self.before()
                    if before.text not in (":", "|", "&", "=>", "<", ",", "is"):
                        return
                    self.braces_into(into)
                elif self.is_("(", "["):
                    self.brackets(into)
                else:
                    before, following = self.tokens[self.at - 1], self.peek()
                    if following.line > before.line + before.text.count("\n") and before.text not in (":", "|", "&", "<", ",", "=>") and not self.is_("|", "&"):
                        return
                    self.take(into)

    def control(self, node: Node, word: str) -> Node:
        node.kind = _STATEMENTS[word]
        self.take(node.children)
        if word == "for" and self.is_("await"):
            self.take(node.children)
        if self.is_("("):
            opened = self.at
            self.listed += word == "for"
            self.brackets(node.children)
            self.listed -= word == "for"
            if word == "for" and self._loops_over(opened):
                node.kind = "for_in_statement"
        if word == "switch":
            node.body = self.block() if self.is_("{") else []
            return self.finish(node)
        first = self.branch()
        if word in ("for", "while", "try", "do"):
            node.body = first
        node.children += first
        while (word == "if" and self.is_("else")) or (word == "try" and self.is_("catch", "finally")) or (word == "do" and self.is_("while")):
            self.take(node.children)
            if self.is_("("):
                self.brackets(node.children)
            if word != "do":
                node.children += self.branch()
            elif self.is_(";"):
                self.take(node.children)
        return self.finish(node)

    def branch(self) -> list[Node]:
        if self.is_("{"):
            return self.block()
        return [self.statement()] if self.peek() is not None else []

    def _loops_over(self, opened: int) -> bool:
        inside = [t.text for t in self.tokens[opened : self.at] if t.kind in ("word", "punct")]
        return ";" not in inside and any(t in ("of", "in") for t in inside)

    def until_brace(self, into: list[Node]) -> None:
        while self.peek() is not None and not self.is_("{", ";"):
            if self.is_("(", "["):
                self.brackets(into)
            else:
                self.take(into)

    def braces(self) -> list[Node]:
        out: list[Node] = []
        self.braces_into(out)
        return out

    def braces_into(self, into: list[Node]) -> None:
        self.take(into)
        while self.peek() is not None and not self.is_("}"):
            if self.is_("{"):
                self.braces_into(into)
            elif self.is_("(", "["):
                self.brackets(into)
            else:
                self.take(into)
        if self.peek() is not None:
            self.take(into)

    def brackets(self, into: list[Node]) -> None:
        """A bracketed part of an expression, with what blocks and comments it holds."""
        self.take(into)
        while self.peek() is not None and not self.is_(")", "]"):
            if self.is_("}"):
                return
            self.piece(into)
        if self.peek() is not None:
            self.take(into)

    def piece(self, into: list[Node]) -> None:
        """One token of an expression, or a bracket, block, object or class with all it holds."""
        if self.is_("(", "["):
            self.brackets(into)
        elif self.is_("{"):
            before = self.before()
            if before is not None and before.text in ("=>", ")"):
                into += self.block()
            else:
                into += self.class_body(commas=True)
        elif self.is_("class"):
            inner = self.class_(Node("class", self.peek().start), False)
            inner.kind = "class"
            into.append(inner)
        elif self.is_("function") or self.is_("async") and self.peek(1) is not None and self.peek(1).text == "function":
            inner = self.function(Node("function_expression", self.peek().start))
            into += inner.children + (inner.body or [])
        else:
            self.take(into)

    def expression(self, into: list[Node]) -> None:
        """Up to a semicolon, a closing bracket, or a line's end where a statement may end."""
        depth_free = False
        while (token := self.peek()) is not None and not self.is_("}", ")", "]"):
            if self.is_(";"):
                self.take(into)
                return
            if depth_free and self._ends_before(token):
                return
            self.piece(into)
            depth_free = True

    def _ends_before(self, token: Token) -> bool:
        before = self.before()
        if token.line <= before.line + before.text.count("\n"):
            return False
        if before.kind == "punct" and before.text not in (")", "]", "}", "++", "--"):
            return False
        if token.kind == "punct" and token.text not in ("{", "@", "++", "--", "!"):
            return False
        return not (token.kind == "word" and token.text in _CONTINUES) and before.text not in ("const", "let", "var", "import", "from", "extends", "new", "typeof")

    def class_body(self, commas: bool = False) -> list[Node]:
        """Members of a class, or of an object if commas part them."""
        out: list[Node] = []
        self.take(out)
        return self.members(out, commas)

    def members(self, out: list[Node], commas: bool = False) -> list[Node]:
        """Members up to the brace that closes a body."""
        while True:
            self.plain_methods(out)
            if self.at == len(self.tokens) and (m := _CLOSED.match(self.text, self.read_to)):
                self.go_on(m.end(), "punct", "}")
                return out
            if self.comments(out):
                continue
            if self.peek() is None:
                return out
            if self.is_("}"):
                self.take(out)
                return out
            if self.is_(";", ","):
                self.take(out)
                continue
            before = self.at
            self.member(out, commas)
            if self.at == before:
                self.at += 1

    def member(self, out: list[Node], commas: bool) -> None:
        node = Node(self.field_kind, self.peek().start)
        self.decorators(node.children)
        while self.is_(*_MODIFIERS) and (after := self.peek(1)) is not None and after.text not in ("(", "=", ";", ":", ",", "}", "?", "!", "<"):
            self.take(node.children)
        if self.is_("*"):
            self.take(node.children)
        if self.is_("static") and self.peek(1).text == "{" or self.is_("{"):
            while not self.is_("{"):
                self.take(node.children)
            node.kind, node.children = "class_static_block", node.children + self.block()
            out.append(self.finish(node))
            return
        if self.is_("...", "["):
            self.piece(node.children)
        elif self.peek() is not None and not self.is_("}", ")", "]"):
            node.name = self.take(node.children).text
        if self.is_("?", "!"):
            self.take(node.children)
        if self.is_("(", "<"):
            self.signature(node.children)
            if self.is_("{"):
                node.kind = "method_definition"
                self.function_body(node)
            else:
                node.kind = "method_signature"
            out.append(self.finish(node))
            return
        if commas:
            while self.peek() is not None and not self.is_(",", "}"):
                if self.is_(")", "]", ";"):
                    self.take(node.children)
                else:
                    self.piece(node.children)
            out += node.children
            return
        started = False
        while (token := self.peek()) is not None and not self.is_(";", "}"):
            if started and self._ends_before(token) or not started and token.line > self.tokens[self.at - 1].line and not self.is_("=", ":"):
                break
            self.piece(node.children)
            started = True
        out.append(self.finish(node))


@dataclass(frozen=True)
class Chunk:
    chunk_type: str
    hierarchical_name: str
    source_text: str
    start_line: int
    end_line: int
    start_byte: int
    end_byte: int
    jsdoc_text: str | None


def split(text: str, file_name: str, provider: LanguageProvider) -> list[Chunk]:
    """Atomic chunks of a source text, in order: what is too long is entered, what has no kind is looked through."""
    top = Parser(text, provider.name == "typescript").statements()
    breaks = [m.start() for m in re.finditer("\n", text)]
    sizes = range(len(text) + 1) if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
    line = lambda i: bisect_left(breaks, i)
    out: list[Chunk] = []

    def visit(nodes: list[Node], name: str) -> None:
        for i, node in enumerate(nodes):
            if node.kind not in provider.splittable and node.kind not in provider.leaf:
                visit(node.children + (node.body or []) if node.body is not node.children else node.children, name)
                continue
            first, last = line(node.start), line(max(node.end - 1, node.start))
            own = node.name if node.kind in provider.named and node.name else f"{node.kind}_L{first}"
            if node.kind in provider.splittable and last - first > provider.max_lines:
                visit(node.children if node.body is None else node.body, f"{name}.{own}")
                continue
            before = nodes[i - 1] if i else None
            doc = None
            if before is not None and before.kind == "comment" and text.startswith("/**", before.start) and line(before.end - 1) == first - 1:
                doc = text[before.start : before.end]
            out.append(Chunk(node.kind, f"{name}.{own}", text[node.start : node.end], first, last, sizes[node.start], sizes[node.end], doc))

    visit(top, file_name.split(".")[0])
    return out
