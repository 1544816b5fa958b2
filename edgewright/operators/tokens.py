"""Source text as a token table: one row a token, with its bracket, its place among the arguments there, its statement and its scopes.

Comments, strings, templates and regular expressions are told apart before anything is matched, so later operators never see into them. What
is lexical is settled here, file by file; everything else is done on the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.operators.rounds import kept

PART = "struct<kind:string,value:string,source:string>"
#: ``parent`` is the token of the bracket or template around (-1: none), ``arg`` counts the commas before at its level, ``scopes`` are the statements of the functions and
#: classes around, outermost first; ``callee`` stands at the bracket of a call whose callee is a chain of names (or ends in one: ``chained`` false), ``block`` at the bracket of a body.
#: ``head`` is the text its statement begins with, ``holder`` the callee at the bracket around, ``summed`` tells of a ``+`` at its place of that bracket, ``declaring`` of a statement that may declare a
#: symbol: they let facts leave other tokens unread.
SCHEMA = (
    f"file string, language string, seq int, line int, end_line int, kind string, text string, value string, parts array<{PART}>, parent int, arg int, stmt int, scopes array<int>, "
    "in_class boolean, decorator boolean, header boolean, callee string, chained boolean, fresh boolean, call_line int, block boolean, fault string, head string, holder string, summed boolean, declaring boolean"
)

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_COMPOUND = {"class", "def", "if", "elif", "else", "for", "while", "try", "except", "finally", "with", "async"}
#: Names after which no value has ended, so that a slash begins a regular expression and a bracket no call.
_WORDS = {
    "if", "for", "while", "switch", "return", "catch", "with", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "await", "yield", "function",
    "and", "or", "not", "is", "elif", "assert", "del", "lambda", "except", "raise", "from", "import", "as", "extends", "implements", "default", "async",
}
#: Words that begin statements of a module only, and of Python those that no bracket can hold.
_TS_HEADS, _PY_HEADS = {"import", "export"}, {"def", "class", "import", "from"}
#: Words that begin declarations, those that declare variables and so need a module around, and what stands behind the name of a Python variable.
_PY_DECLARES, _TS_DECLARES = {"class", "def", "async"}, {"export", "default", "declare", "abstract", "async", "function", "class", "interface", "type", "enum"}
_TS_VARIABLES, _PY_ASSIGNS = {"const", "let", "var"}, {"=", ":"}
_TS_GOES_ON = {"instanceof", "in", "of", "as", "extends", "implements", "from", "else", "catch", "finally", "satisfies"}
_NAME = r"[^\W\d][\w$]*|[$#][\w$]+"
_PY = re.compile(
    rf"""(?P<space>[ \t\f]+|\\\r?\n)|(?P<line>\r?\n)|(?P<comment>\#[^\n]*)|(?P<string>[rRbBuUfFtT]{{0,2}}(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))"""
    rf"""|(?P<number>\d[\w.]*)|(?P<name>{_NAME})|(?P<op>\*\*=?|//=?|[-+*/%@&|^<>=!:]=|->|<<=?|>>=?|.)""",
    re.S,
)
_TS = re.compile(
    rf"""(?P<space>[ \t\f﻿ ]+)|(?P<line>\r?\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<template>`)"""
    rf"""|(?P<number>\.?\d[\w.]*)|(?P<name>{_NAME})|(?P<op>=>|\.\.\.|\?\.(?!\d)|\?\?=?|===?|!==?|\+\+|--|[-+*/%&|^]=|&&=?|\|\|=?|<=|>=|\*\*=?|.)""",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


def _template_end(text: str, at: int) -> tuple[int, list[tuple[str | None, int, int]]]:
    """Where the template opened before ``at`` ends, and its pieces: (text, _, _) or (None, from, to) of an expression."""
    pieces, begin, n = [], at, len(text)
    while at < n and text[at] != "`":
        if text[at] == "\\":
            at += 2
        elif text.startswith("${", at):
            if at > begin:
                pieces.append((text[begin:at], 0, 0))
            inner, depth, at = at + 2, 1, at + 2
            while at < n and depth:
                m = _TS.match(text, at)
                if m["template"]:
                    at = _template_end(text, at + 1)[0]
                    continue
                depth += {"{": 1, "}": -1}.get(m[0], 0)
                at = m.end()
            pieces.append((None, inner, at - 1))
            begin = at
        else:
            at += 1
    if at > begin:
        pieces.append((text[begin:at], 0, 0))
    return min(at + 1, n), pieces


def _f_string(body: str, base: int) -> list[tuple[str | None, int, int]]:
    """Pieces of an f-string's body as for templates; doubled braces are text, conversions and formats belong to no expression."""
    pieces, text, at = [], "", 0
    while at < len(body):
        if body[at : at + 2] in ("{{", "}}"):
            text, at = text + body[at], at + 2
        elif body[at] == "{":
            depth, end = 1, at + 1
            while end < len(body) and depth:
                depth += {"{": 1, "[": 1, "(": 1, "}": -1, "]": -1, ")": -1}.get(body[end], 0)
                end += 1
            source = body[at + 1 : end - 1]
            cut = re.search(r"(?:![rsa])?(?::[^\]\)'\"]*)?$|=$", source)
            if text:
                pieces.append((text, 0, 0))
            text = ""
            pieces.append((None, base + at + 1, base + at + 1 + (cut.start() if cut else len(source))))
            at = end
        else:
            text, at = text + body[at], at + 1
    if text:
        pieces.append((text, 0, 0))
    return pieces


class _File:
    """The tokens of one file, taken in order; brackets, statements and scopes are stacks."""

    def __init__(self, text: str, python: bool):
        self.text, self.python, self.rows = text, python, []
        self.line, self.at = 1, 0
        self.brackets: list[dict] = []
        self.bodied: set[int] = set()  # statements that head a function or class
        self.stmt, self.scopes, self.fresh_stmt = -1, [], True
        self.indents: list[tuple[int, int | None]] = []  # of headers that wait for their body: indentation, their statement if it is a scope
        self.newline = True

    def level(self) -> list[int]:
        """Tokens at this level of the present statement."""
        return self.brackets[-1]["tokens"] if self.brackets else self.top

    top: list[int]

    def add(self, kind: str, text: str, value: str | None = None, parts: list | None = None, block: bool = False, fault: str | None = None) -> dict:
        rows, around = self.rows, self.brackets[-1] if self.brackets else None
        seq = len(rows)
        if self.fresh_stmt:
            self.stmt, self.fresh_stmt, self.decorator = seq, False, self.python and text == "@"
            if around:
                around["tokens"] = []
            else:
                self.top = []
        if self.python:
            in_class = bool(self.scopes) and rows[self.scopes[-1]].get("is_class", False)
        else:
            in_class = bool(around and around["class"])
        row = {
            "seq": seq, "line": self.line, "end_line": self.line, "kind": kind, "text": text, "value": value, "parts": parts, "parent": around["seq"] if around else -1,
            "arg": around["arg"] if around and not around["block"] else -1, "stmt": self.stmt, "scopes": self.scopes, "in_class": in_class,
            "decorator": self.decorator, "header": False, "callee": None, "chained": None, "fresh": None, "call_line": None, "block": block, "fault": fault,
        }
        rows.append(row)
        (around["tokens"] if around else self.top).append(seq)
        return row

    def before(self, k: int = 1) -> dict | None:
        """The k-th last token at this level of the statement."""
        level = self.level() if not self.fresh_stmt else []
        return self.rows[level[-k]] if len(level) >= k else None

    def ended(self, row: dict | None) -> bool:
        """Whether a value can end at this token."""
        return row is not None and (row["kind"] in ("number", "string", "template", "regex", "close") or row["kind"] == "name" and row["text"] not in _WORDS)

    def called(self, row: dict) -> None:
        """Note the callee of the opening bracket ``row`` as far as it is a chain of names; the bracket itself is not yet at this level."""
        level = [self.rows[i] for i in self.level()[:-1]]
        i = len(level) - 1
        if i >= 0 and level[i]["text"] == ">" and not self.python:  # type arguments
            depth = 0
            while i >= 0:
                t = level[i]
                depth += {">": 1, "<": -1}.get(t["text"], 0)
                if not (t["kind"] in ("name", "string", "open", "close") or t["text"] in "<>,.|&?:"):
                    return
                i -= 1
                if not depth:
                    break
        if i < 0 or level[i]["kind"] != "name":
            return
        if level[i]["text"] in _WORDS and not (i and level[i - 1]["text"] in (".", "?.")):
            return
        names = [level[i]["text"]]
        i -= 1
        whole = True
        while i >= 0 and level[i]["text"] in (".", "?."):
            if i and level[i - 1]["kind"] == "name":
                names.insert(0, level[i - 1]["text"])
                i -= 2
            else:
                whole = False
                break
        fresh = i >= 0 and level[i]["text"] == "new"
        row |= {"callee": ".".join(names), "chained": whole, "fresh": fresh, "call_line": level[i if fresh else i + 1]["line"]}

    def heads(self) -> list[str]:
        """The words a statement begins with."""
        level = self.level() if not self.fresh_stmt else []
        return [self.rows[i]["text"] for i in level[:8]]

    def declares(self) -> str | None:
        """What the statement declares, if its body is a scope: function, class or method."""
        words = self.heads()
        while words and words[0] in ("export", "default", "declare", "async", "abstract"):
            words = words[1:]
        if words and words[0] in ("function", "class"):
            return words[0]
        if self.brackets and self.brackets[-1].get("class"):
            level = [self.rows[i]["text"] for i in self.level()]
            if "(" in level and "=" not in level[: level.index("(")]:
                return "method"
        return None

    def is_block(self) -> bool:
        """Whether a brace that opens here opens a body and not an object."""
        p, words = self.before(), self.heads()
        if p is None:
            return True
        words = [w for w in words if w not in ("export", "default", "declare", "abstract", "async")]
        if p["text"] in (")", "=>", "else", "try", "finally", "do") or p["block"] and p["kind"] == "close":
            return True
        if words and words[0] in ("class", "namespace", "module", "global") and p["text"] not in ("=", "("):
            return True
        if words and words[0] in ("function",) or self.brackets and self.brackets[-1].get("class"):
            level = [self.rows[i]["text"] for i in self.level()]
            closes = [k for k, t in enumerate(level) if t == ")"]
            return bool(closes) and level[closes[-1] + 1 : closes[-1] + 2] == [":"] and "=" not in level[closes[-1] :]
        return False

    def open(self, text: str) -> None:
        block = text == "{" and not self.python and (not self.brackets or self.brackets[-1]["block"] or self.before() is not None and self.before()["text"] in (")", "=>")) and self.is_block()
        declared = self.declares() if block else None
        row = self.add("open", text, block=block)
        if text == "(":
            self.called(row)
            # Declarations are no calls.
            words, ahead = self.heads(), [t["text"] if (t := self.before(k)) else None for k in (3, 4)]
            defines = words[:1] in (["def"], ["class"]) or words[:2] == ["async", "def"]
            if self.python and defines or not self.python and (ahead[0] == "function" or ahead == ["*", "function"]):
                row |= {"callee": None}
        self.brackets.append({"text": text, "seq": row["seq"], "arg": 0, "block": block, "class": declared == "class", "tokens": [], "stmt": self.stmt, "scopes": self.scopes})
        if block:
            self.fresh_stmt = True
            if declared and self.stmt >= 0:
                self.rows[self.stmt]["is_class"] = declared == "class"
                self.bodied.add(self.stmt)
                self.scopes = [*self.scopes, self.stmt]

    def close(self, text: str) -> None:
        k = next((k for k in range(len(self.brackets) - 1, -1, -1) if _OPEN[self.brackets[k]["text"]] == text), None)
        if k is None:
            self.add("op", text, fault="never-opened")
            return
        for b in self.brackets[k + 1 :]:
            self.rows[b["seq"]]["fault"] = "never-closed"
        bracket = self.brackets[k]
        del self.brackets[k:]
        self.stmt, self.scopes, self.fresh_stmt = bracket["stmt"], bracket["scopes"], False
        row = self.add("close", text, block=bracket["block"])
        opener = self.rows[bracket["seq"]]
        opener["end_line"] = row["line"]
        opener["close"] = row["seq"]
        if bracket["block"]:
            self.after_block = True

    after_block = decorator = False

    def run(self) -> list[dict]:
        self.top = []
        self.lex(0, len(self.text))
        for b in self.brackets:
            self.rows[b["seq"]]["fault"] = "never-closed"
        for row in self.rows:  # a method's head is followed by its body, perhaps behind a type
            if row["callee"] is not None and not self.python and row.get("close", len(self.rows)) + 1 < len(self.rows):
                after = self.rows[row["close"] + 1]
                beside = (row["stmt"], row["parent"]) == (after["stmt"], after["parent"])
                if beside and (after["block"] and after["kind"] == "open" or row["in_class"] and after["text"] == ":" and self._has_body(after)):
                    row |= {"callee": None}
        summed = {(r["stmt"], r["parent"], r["arg"]) for r in self.rows if r["text"] == "+"}
        second: dict[int, str] = {}
        for row in self.rows:
            if row["seq"] != row["stmt"]:
                second.setdefault(row["stmt"], row["text"])
        declaring = {row["seq"] for row in self.rows if row["seq"] == row["stmt"] and self.may_declare(row, second.get(row["seq"]))}
        for row in self.rows:
            stmt, parent = row["stmt"], row["parent"]
            row["declaring"] = stmt in declaring
            row["header"] = stmt in self.bodied
            row["head"] = self.rows[stmt]["text"] if stmt >= 0 else None
            row["holder"] = self.rows[parent]["callee"] if parent >= 0 else None
            row["summed"] = (stmt, parent, row["arg"]) in summed
        return self.rows

    def may_declare(self, first: dict, second: str | None) -> bool:
        """Whether a statement of these first tokens can declare a symbol: by its word, as a method, or as a variable of a module or of a Python class."""
        if self.python:
            return first["text"] in _PY_DECLARES or second in _PY_ASSIGNS and (first["in_class"] or not first["scopes"])
        return first["in_class"] or first["text"] in _TS_DECLARES or first["text"] in _TS_VARIABLES and (second == "enum" or not first["scopes"])

    def _has_body(self, row: dict) -> bool:
        return any(r["block"] and r["kind"] == "open" and r["stmt"] == row["stmt"] and r["parent"] == row["parent"] for r in self.rows[row["seq"] : row["seq"] + 60])

    def lex(self, at: int, end: int) -> None:
        """Take the tokens of text[at:end]; expressions in templates come here again."""
        text, pattern = self.text, _PY if self.python else _TS
        while at < end:
            m = pattern.match(text, at, end)
            kind, token = m.lastgroup, m[0]
            at = m.end()
            if kind in ("space", "comment"):
                self.line += token.count("\n")
                continue
            if kind == "line":
                self.line += 1
                if self.python and not self.brackets and not self.fresh_stmt:
                    self.fresh_stmt = True
                self.newline = True
                continue
            if self.newline and self.brackets and token in (_PY_HEADS if self.python else _TS_HEADS) and (not m.start() or text[m.start() - 1] == "\n"):
                self.recover()
            if self.python:
                self.python_statement(m.start(), token)
            else:
                self.typescript_statement(kind, token)
            self.newline = False
            if kind == "op" and token in _OPEN:
                self.open(token)
            elif kind == "op" and token in _CLOSE:
                self.close(token)
            elif kind == "op" and token == ";" and (not self.brackets or self.brackets[-1]["block"]):
                self.fresh_stmt = True
            elif kind == "op" and token == "/" and not self.python and not self.ended(self.before()) and (r := _REGEX.match(text, m.start(), end)):
                self.add("regex", r[0])
                at = r.end()
            elif kind == "template":
                at, pieces = _template_end(text, at)
                self.template(m.start(), at, pieces, text[m.start() : at])
            elif kind == "string":
                at = self.string(m.start(), token)
            else:
                row = self.add(kind, token)
                if token == "," and self.brackets:
                    self.brackets[-1]["arg"] += 1
                    row["arg"] = -1  # between arguments
                elif token == ":" and self.python and not self.brackets and self.heads()[0] in _COMPOUND:
                    self.header()

    def recover(self) -> None:
        """What can only begin a statement of the module stands at a line's begin: brackets still open are never closed."""
        if any(self.rows[b["seq"]]["kind"] != "open" for b in self.brackets):
            return  # in a template
        for b in self.brackets:
            self.rows[b["seq"]]["fault"] = "never-closed"
        self.scopes = self.brackets[0]["scopes"] if not self.python else self.scopes
        self.brackets, self.fresh_stmt = [], True

    def python_statement(self, at: int, token: str) -> None:
        """Statements begin on lines outside brackets; a less indented one leaves scopes."""
        if not self.newline or self.brackets:
            return
        self.fresh_stmt = True
        indent = at - (self.text.rfind("\n", 0, at) + 1)
        while self.indents and indent <= self.indents[-1][0]:
            if self.indents.pop()[1] is not None:
                self.scopes = self.scopes[:-1]
        self.indent = indent

    indent = 0

    def header(self) -> None:
        """A Python header's colon: its body is what is indented more, or the rest of the line."""
        words = self.heads()
        scope = words[0] in ("class", "def") or words[:2] == ["async", "def"]
        self.indents.append((self.indent, self.stmt if scope else None))
        if scope:
            self.rows[self.stmt]["is_class"] = words[0] == "class"
            self.bodied.add(self.stmt)
            self.scopes = [*self.scopes, self.stmt]
        self.fresh_stmt = True

    def typescript_statement(self, kind: str, token: str) -> None:
        """Where a statement ends without a semicolon: at a line end between what ends a value and what cannot go on, and behind a body."""
        if self.brackets and not self.brackets[-1]["block"] or self.fresh_stmt:
            self.after_block = False
            return
        p = self.before()
        goes_on = kind == "op" and token not in ("{", "@", "!", "++", "--", "~") or kind == "name" and token in _TS_GOES_ON
        if self.after_block:
            self.after_block = False
            self.fresh_stmt = not goes_on or self.newline and token in ("(", "[", "*", "<", "/")
        elif self.newline and not goes_on and self.ended(p):
            self.fresh_stmt = True

    def string(self, begin: int, token: str) -> int:
        """A string token; those over lines end further down, f-strings have parts."""
        quote = re.match(r"""[A-Za-z]*("{3}|'{3}|"|')""", token)
        closed = len(token) >= len(quote[0]) + len(quote[1]) and token.endswith(quote[1])  # a long string may lack its end
        prefix, body = quote[0][: -len(quote[1])], token[len(quote[0]) : -len(quote[1]) if closed else None]
        end = begin + len(token)
        if set(prefix.lower()) & set("ft"):
            self.template(begin, end, _f_string(body, begin + len(quote[0])), token, body)
            return end
        row = self.add("string", f'"{len(self.rows)}"', value=body)
        self.line += token.count("\n")
        row["end_line"] = self.line
        return end

    def template(self, begin: int, end: int, pieces: list, token: str, plain: str | None = None) -> None:
        """A template token with its parts, and the tokens of its expressions below it; an f-string without any is a plain string."""
        if self.python and all(t is not None for t, _, _ in pieces):
            row = self.add("string", f'"{len(self.rows)}"', value="".join(t for t, _, _ in pieces))
            self.line += token.count("\n")
            row["end_line"] = self.line
            return
        parts = [{"kind": "text", "value": t, "source": None} if t is not None else {"kind": "expression", "value": None, "source": self.text[a:b].strip()} for t, a, b in pieces]
        row = self.add("template", f"`{len(self.rows)}`", parts=parts, value=token if plain is None else plain)
        line, last = self.line, self.line + token.count("\n")
        row["end_line"] = last
        for n, (t, a, b) in enumerate(pieces):
            if t is None:
                self.line = line + self.text.count("\n", begin, a)
                self.brackets.append({"text": "(", "seq": row["seq"], "arg": n, "block": False, "class": False, "tokens": [], "stmt": self.stmt, "scopes": self.scopes})
                depth, held = len(self.brackets), self.newline
                self.stmt = -2 - row["seq"]  # an island of its own
                self.lex(a, b)
                self.stmt = self.brackets[depth - 1]["stmt"]
                for lost in self.brackets[depth:]:
                    self.rows[lost["seq"]]["fault"] = "never-closed"
                del self.brackets[depth - 1 :]
                self.newline, self.fresh_stmt = held, False
        self.line = last


#: Tokens handed on at once, unless a single file has more.
MOST_ROWS = 1 << 13


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.replace(PART, "part").split(", ")]
    columns, told = {n: [] for n in names}, itemgetter(*names[2:])

    def taken() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(columns[n], _TYPES.get(n)) for n in names], names=names)
        for values in columns.values():
            values.clear()
        return made

    for batch in batches:
        for file, language, text in zip(*batch.columns, strict=True):
            language = language.as_py()
            rows = _File(text.as_py(), language == "python").run()
            columns["file"] += [file.as_py()] * len(rows)
            columns["language"] += [language] * len(rows)
            for n, values in zip(names[2:], zip(*map(told, rows), strict=True), strict=False):
                columns[n] += values
            if len(columns["file"]) >= MOST_ROWS:
                yield taken()
    if columns["file"]:
        yield taken()


_INTS = {n: pa.int32() for n in ("seq", "line", "end_line", "parent", "arg", "stmt", "call_line")}
_TYPES = _INTS | {n: pa.string() for n in ("file", "language", "kind", "text", "value", "callee", "fault", "head", "holder")} | {n: pa.bool_() for n in ("in_class", "decorator", "header", "chained", "fresh", "block", "summed", "declaring")}
_TYPES |= {"scopes": pa.list_(pa.int32()), "parts": pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "value", "source")]))}


def tokens(files: DataFrame) -> DataFrame:
    """The tokens (SCHEMA) of complete files (path, language, status, text). Files are lexed one by one, whole.

    They are dealt out by path first, however few tasks they come in, and the table is written once: facts join it with itself several times, and lexing is the dear step.
    Its files pack tokens so well that their size says nothing of the rows; the hint keeps joins with it from sending a side to the driver.
    """
    spark = files.sparkSession
    dealt = files.where("status = 'complete'").select(F.col("path").alias("file"), "language", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return kept(dealt.mapInArrow(_lexed, SCHEMA), "tokens").hint("merge")
