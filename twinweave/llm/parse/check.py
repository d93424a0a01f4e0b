"""Whether a source text is valid for the language of its file name's extension."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property, lru_cache
from typing import NamedTuple

from twinweave.llm.parse import grammars
from twinweave.llm.parse.tables import Grammar, Recogniser, Tables

# Stand-ins in a text whose comments and literals have been replaced. FOLD is a line break inside a literal.
ERR, STR, CHR, LIFE, REGEX, JSX, FOLD = "\x02", "\x03", "\x04", "\x05", "\x06", "\x07", "\x0b"
_STANDS = {ERR: "$err", STR: "STR", CHR: "CHR", LIFE: "LIFE", REGEX: "REGEX", JSX: "JSX"}

_ID = r"[^\W\d]\w*"
_NUM = (
    r"(?:0[xX][\da-fA-F_']+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_']+|0[oO][0-7_]+"
    r"|\d(?:[\d_]|'(?=\d))*(?:\.(?!\.|[^\W\d])[\d_]*|\.(?=[eEfFdDlL]\b|[eE][-+\d])[\d_]*)?(?:[eE][+-]?\d[\d_]*)?"
    r"|\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?)"
)
_PYTHON_NUMBER = (
    r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|0(?:_?0)*|[1-9](?:_?\d)*)"
)
_PLAIN_NUMBERS = re.compile(r"\b[1-9]\d*\b(?![.'])")
_CONTROL = re.compile("[\x02-\x08\x0b]")
_QUOTED = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"


class Verdict(NamedTuple):
    """valid; else the 1-based line of the first token that fits no parse, and that token ('end' at the end of the text)."""

    valid: bool
    line: int | None = None
    token: str | None = None


VALID = Verdict(True)


class Language:
    """A language's grammar, literals and line rules.

    literals: (pattern, stand-in) of comments ('' as stand-in), strings and so on; what opens one without
    closing it is an error. suffix: letters that may end a number; prefix: letters that may precede a literal.
    soft: words that are also names.
    """

    def __init__(self, grammar: str, literals: list[tuple[str, str]], openers: str, suffix: str = "", soft: str = "", layout: str = "", prepare: Callable[[str], str] | None = None, names: str = _ID, prefix: str = "", number: str = "") -> None:
        self.grammar, self.soft, self.layout, self.prepare, self.names, self.suffix = grammar, frozenset(soft.split()), layout, prepare, names, suffix
        # without literals, prepare has replaced them. No groups: a pattern whose branches begin with plain letters is searched many times faster
        self.parts = [(re.compile(p), s) for p, s in [*literals, (openers, ERR)]]
        self.scan = re.compile("|".join(p.pattern for p, _ in self.parts)) if literals else None
        self.prefix = re.compile(rf"\b(?:{prefix})(?=[{STR}{CHR}])") if prefix else None
        self.number = number or (rf"{_NUM}(?:{suffix})?" if suffix else _NUM)

    @cached_property
    def parser(self) -> Recogniser:
        return Recogniser(Tables(Grammar(self.grammar)))

    @cached_property
    def words(self) -> frozenset[str]:
        return frozenset(t[1:-1] for t in self.parser.t.terminals if t[0] == "'" and re.match(r"\w", t[1]))

    @cached_property
    def lexer(self) -> re.Pattern[str]:
        marks = sorted((t[1:-1] for t in self.parser.t.terminals if t[0] == "'" and not re.match(r"\w", t[1])), key=len, reverse=True)
        return re.compile(rf"(?P<s>[\s\x0b]+)|(?P<w>{self.names})|(?P<n>{self.number}(?!\w))|(?P<l>[\x02-\x07])|(?P<m>{'|'.join(map(re.escape, marks))})|(?P<x>[\s\S])")

    @cached_property
    def plain_names(self) -> re.Pattern[str]:
        """Names of two words, to be written alike; it serves only to make more lines equal."""
        odd = sorted(w for w in self.words if re.fullmatch(r"[a-z]+[A-Z_0-9]\w*", w))
        return re.compile(rf"\b{f'(?!(?:{'|'.join(odd)})\b)' if odd else ''}[a-z]+[A-Z_0-9]\w*")

    def stripped(self, text: str) -> str:
        """The text with its comments and literals replaced, and as many line breaks as before."""
        parts = self.parts

        def put(m: re.Match[str]) -> str:
            start, end = m.span()
            stand = next(s for p, s in parts if (x := p.match(text, start)) and x.end() == end)
            breaks = text.count("\n", start, end)
            if stand == "":
                return "\n" * breaks if breaks else " "
            return stand if stand in (FOLD, ERR) else stand + FOLD * breaks

        text = _CONTROL.sub("\x01", text) if _CONTROL.search(text) else text
        done = self.scan.sub(put, text)
        return self.prefix.sub("", done) if self.prefix else done

    def tokens(self, line: str) -> tuple[str, ...]:
        out = []
        for m in self.lexer.finditer(line):
            kind, text = m.lastgroup, m.group()
            if kind == "w":
                out.append(f"'{text}'" if text in self.words else "PRIVATE" if text[0] == "#" else "ID")
            elif kind == "n":
                out.append("NUM")
            elif kind == "m":
                out.append(f"'{text}'")
            elif kind == "l":
                out.append(_STANDS[text])
            elif kind == "x":
                out.append("$err")
        return tuple(out)

    def _step(self, stacks: frozenset[int], token: str) -> frozenset[int] | None:
        p = self.parser
        out = p.step(stacks, token)
        if token[1:-1] in self.soft and token[0] == "'":
            name = p.step(stacks, "ID")
            out = name if out is None else out if name is None else out | name
        return out

    def _line(self, stacks: frozenset[int], line: str) -> tuple[frozenset[int] | None, int]:
        """(stacks after the line's tokens, or None and the number of tokens before the one that fits no parse)."""
        lazy = self.layout == "asi"
        for i, t in enumerate(tokens := self.tokens(line)):
            to = self._step(stacks, t)
            if to is None and lazy and (i == 0 or t == "'}'"):
                # a line break or a brace ends a statement where nothing else fits
                ended = self._step(stacks, "';'")
                to = ended and self._step(ended, t)
            if to is None:
                return None, i
            stacks = to
        if self.layout == "go" and tokens and (tokens[-1] in _GO_ENDS):
            to = self._step(stacks, "';'")
            if to is None:
                return None, len(tokens)
            stacks = to
        return stacks, len(tokens)

    def check(self, text: str) -> Verdict:
        p = self.parser
        p.tidy()
        text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
        if self.prepare:
            text = self.prepare(text)
        if self.scan:
            text = self.stripped(text)
        if not isinstance(self, StyleSheet):
            text = _PLAIN_NUMBERS.sub("1", self.plain_names.sub("aA", text))
        if self.layout == "indent":
            return self._check_indented(text)
        stacks, known, number = p.start, p.lines, 1
        for line in text.split("\n"):
            bare = line.strip()
            if bare:
                key = (stacks, bare)
                found = known.get(key)
                if found is None:
                    found = self._line(stacks, bare)
                    if len(bare) < 400:
                        known[key] = found
                to, at = found
                if to is None:
                    return self._verdict(number, bare, at)
                stacks = to
            number += 1 + line.count(FOLD)
        if not p.accepts(stacks):
            ended = self._step(stacks, "';'") if self.layout == "asi" else None
            if not ended or not p.accepts(ended):
                return Verdict(False, number - 1, "end")
        return VALID

    def _verdict(self, number: int, line: str, at: int) -> Verdict:
        tokens = self.tokens(line)
        folds = 0
        return Verdict(False, number + folds, tokens[at].strip("'") if at < len(tokens) else "line break")

    def _check_indented(self, text: str) -> Verdict:
        p = self.parser
        stacks, known, number, depth, levels = p.start, p.lines, 1, 0, [0]
        for line in text.split("\n"):
            bare = line.strip()
            if bare:
                lead: list[str] = []
                if depth == 0:
                    indent = len((line[: len(line) - len(line.lstrip())]).expandtabs(8))
                    if indent > levels[-1]:
                        levels.append(indent)
                        lead = ["INDENT"]
                    while indent < levels[-1]:
                        levels.pop()
                        lead.append("DEDENT")
                    if indent != levels[-1]:
                        return Verdict(False, number, "indent")
                key = (stacks, len(lead) if not lead or lead[0] == "DEDENT" else -1, bare, depth)
                found = known.get(key)
                if found is None:
                    found = self._python_line(stacks, lead, bare, depth)
                    if len(bare) < 400:
                        known[key] = found
                to, at, depth = found
                if to is None:
                    return Verdict(False, number, at)
                stacks = to
            number += 1 + line.count(FOLD)
        tail = ["NEWLINE"] * (depth > 0) + ["DEDENT"] * (len(levels) - 1)
        stacks, _ = p.feed(stacks, tail)
        if stacks is None or depth or not p.accepts(stacks):
            return Verdict(False, number - 1, "end")
        return VALID

    def _python_line(self, stacks: frozenset[int], lead: list[str], line: str, depth: int) -> tuple[frozenset[int] | None, str | None, int]:
        tokens = [*lead, *self.tokens(line)]
        for t in tokens:
            depth += (t in _OPEN) - (t in _CLOSE)
        if depth <= 0:
            tokens.append("NEWLINE")
        for t in tokens:
            stacks = self._step(stacks, t)
            if stacks is None:
                return None, t.strip("'"), depth
        return stacks, None, depth


_OPEN, _CLOSE = frozenset(("'('", "'['", "'{'")), frozenset(("')'", "']'", "'}'"))
_GO_ENDS = frozenset(("ID", "NUM", "STR", "CHR", "'break'", "'continue'", "'fallthrough'", "'return'", "'++'", "'--'", "')'", "']'", "'}'"))


def _preprocessed(text: str) -> str:
    """Directives blanked, with as many line breaks; an open or unopened conditional is an error."""
    depth = 0
    broken = False

    def blank(m: re.Match[str]) -> str:
        nonlocal depth, broken
        word = m.group(1)
        depth += word.startswith("if") - (word == "endif")
        broken |= depth < 0 or word in ("else", "elif") and depth < 1
        return "\n" * m.group().count("\n") + ("" if word in _DIRECTIVES else ERR)

    text = re.sub(r"^[ \t]*#[ \t]*(\w*)(?:[^\n\\/]|\\[\s\S]|/\*(?:[^*]|\*(?!/))*\*/|/)*", blank, text, flags=re.M)
    return text + "\n" + ERR if broken or depth else text


# Fixed value: the preprocessor directives of C, C++ and C#.
_DIRECTIVES = frozenset("define undef include include_next if ifdef ifndef elif elifdef else endif pragma error warning line import region endregion nullable using embed".split()) | {""}


def _nested_comments(text: str) -> str:
    """Rust's block comments, which nest, blanked; strings are left alone."""
    out, depth, last = [], 0, 0
    for m in re.finditer(r'/\*|\*/|//[^\n]*|b?r(#*)"[\s\S]*?"\1|"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\.)\'', text):
        t = m.group()
        if t == "/*":
            if depth == 0:
                out.append(text[last : m.start()])
                last = m.start()
            depth += 1
        elif t == "*/" and depth:
            depth -= 1
            if depth == 0:
                out.append(" " + "\n" * text.count("\n", last, m.end()))
                last = m.end()
        elif depth and len(t) > 2:
            # inside a comment nothing but comment marks counts
            for n in re.finditer(r"/\*|\*/", t):
                depth += 1 if n.group() == "/*" else -1
                if depth == 0:
                    out.append(" " + "\n" * text.count("\n", last, m.start() + n.end()))
                    last = m.start() + n.end()
                    break
    return "".join(out) + text[last:]


def _end_of_template(text: str, at: int, inner: list[tuple[int, int, bool]] | None = None) -> int:
    """Past the template literal that opens at ``at``; -1 if it stays open. The spans of what its ${} hold go to inner, see _unfit."""
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text.startswith("${", i):
            first, i = i + 2, _end_of_braces(text, i + 1)
            if i < 0:
                return -1
            if inner is not None:
                inner.append((first, i - 1, False))
        else:
            i += 1
    return -1


def _end_of_braces(text: str, at: int) -> int:
    """Past the brace that closes the one at ``at``, minding strings, templates and comments; -1 if it stays open."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return i + 1
        elif c in "\"'":
            m = re.compile(_QUOTED if c == '"' else _SINGLE).match(text, i)
            if m:
                i = m.end()
                continue
        elif c == "`":
            i = _end_of_template(text, i)
            if i < 0:
                return -1
            continue
        elif c == "/" and (m := re.compile(r"//[^\n]*|/\*[\s\S]*?\*/").match(text, i)):
            i = m.end()
            continue
        i += 1
    return -1


_MARKUP = re.compile(r"<(/?)([A-Za-z][\w.:-]*)?")


def _end_of_markup(text: str, at: int, inner: list[tuple[int, int, bool]]) -> int:
    """Past the JSX element that opens at ``at``; -1 if there is none. The spans of what its braces hold go to inner, see _unfit."""
    names: list[str] = []
    i, n = at, len(text)
    while i < n:
        m = _MARKUP.match(text, i)
        if not m:
            return -1
        name, i = m.group(2) or "", m.end()
        single = False
        while i < n and text[i] != ">":
            if text[i] in "\"'":
                i = text.find(text[i], i + 1) + 1
                if not i:
                    return -1
            elif text[i] == "{":
                first, i = i + 1, _end_of_braces(text, i)
                if i < 0:
                    return -1
                inner.append((first, i - 1, False))
            elif text.startswith("/>", i):
                single = True
                i += 1
                break
            elif text[i].isalnum() or text[i] in "_-:=. \t\n":
                i += 1
            else:
                return -1
        if i >= n:
            return -1
        i += 1
        if m.group(1):
            if not names or names.pop() != name:
                return -1
        elif not single:
            names.append(name)
        if not names:
            return i
        while i < n and text[i] != "<":
            if text[i] == "{":
                first, i = i + 1, _end_of_braces(text, i)
                if i < 0:
                    return -1
                inner.append((first, i - 1, True))
            elif text[i] in "}>":
                return -1
            else:
                i += 1
    return -1


_ECMA_OPENER = re.compile(r"""["'`/]|<(?=[A-Za-z>])""")
_ECMA_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/")
_ECMA_STRINGS = {'"': re.compile(_QUOTED), "'": re.compile(_SINGLE)}
_ECMA_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_BEFORE_OPERAND = re.compile(r"(?:[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|yield|await))\s*\Z|\A\s*\Z")


@lru_cache(maxsize=4096)
def _inner_verdict(name: str, text: str, markup: bool) -> Verdict:
    """Of an expression inside ${} or the braces of JSX, by the grammar of the text around it."""
    if markup and (spread := re.match(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*\.\.\.", text)):
        text = "\n" * spread.group().count("\n") + text[spread.end() :]
    # in brackets no line break ends a statement; both kinds, so that it can't close the one it stands in
    forms = [f"({text}\n)", f"[{text}\n]"]
    found = next((v for v in map(language(name).check, forms) if not v.valid), VALID)
    if not found.valid and not markup and name != "js" and all(language(name).check(f"type T = {x}").valid for x in forms):
        return VALID  # in the template of a type stand types
    return found


def _unfit(name: str, text: str, inner: list[tuple[int, int, bool]], markup: bool) -> int | None:
    """The place of the line of the first token that doesn't fit in the inner spans (first, end, whether it may be empty); None if all fit."""
    for first, end, empty in inner:
        part = text[first:end]
        if empty and not _ECMA_COMMENT.sub("", part).strip():
            continue
        v = _inner_verdict(name, part, markup)
        if not v.valid:
            return text.count("\n", 0, first) + min(v.line - 1, part.count("\n"))
    return None


def _ecma_literals(name: str) -> Callable[[str], str]:
    """Comments, strings, templates, regular expressions and JSX elements replaced: what a single pattern can't find.

    The expressions inside templates and JSX elements are checked on their own; one that doesn't fit leaves an error on its line.
    """
    markup = name != "ts"

    def prepare(text: str) -> str:
        if text.startswith("#!"):
            text = "//" + text[2:]
        text = _CONTROL.sub("\x01", text) if _CONTROL.search(text) else text
        out: list[str] = []
        at = kept = 0
        while m := _ECMA_OPENER.search(text, at):
            start, c = m.start(), m.group()
            end, stand = -1, ""
            inner: list[tuple[int, int, bool]] = []
            if c in _ECMA_STRINGS:
                if x := _ECMA_STRINGS[c].match(text, start):
                    end, stand = x.end(), STR
            elif c == "`":
                end, stand = _end_of_template(text, start, inner), STR
            elif c == "/" and text[start + 1 : start + 2] in ("/", "*"):
                if x := _ECMA_COMMENT.match(text, start):
                    end = x.end()
            else:
                # an operand may stand here only if none has just ended
                before = text[max(kept, start - 40) : start] or "".join(out[-1:])
                free = _BEFORE_OPERAND.search(before) is not None and not (before.strip() == "" and out and out[-1][:1] in (STR, REGEX, JSX))
                if free and c == "/":
                    if x := _ECMA_REGEX.match(text, start):
                        end, stand = x.end(), REGEX
                elif free and markup:
                    end, stand = _end_of_markup(text, start, inner), JSX
                if end < 0:
                    at = start + 1
                    continue
            if end < 0:
                out += [text[kept:start], ERR]
                return "".join(out)
            line = _unfit(name, text, inner, stand == JSX) if inner else None
            if line is not None:
                out += [text[kept:start], "\n" * (line - text.count("\n", 0, start)), ERR]
                return "".join(out)
            breaks = text.count("\n", start, end)
            out += [text[kept:start], stand + FOLD * breaks if stand else "\n" * breaks or " "]
            at = kept = end
        out.append(text[kept:])
        return "".join(out)

    return prepare


# A comment, or the prefix and opening quotes of a Python string.
_PYTHON_OPENER = re.compile(r"#[^\n]*|(?<!\w)([rRbBuUfFtT]{0,2})(\"\"\"|'''|\"|')")
_PYTHON_STRINGS = {q: re.compile(rf"(?:[^{q[0]}\\{'' if len(q) == 3 else chr(92) + 'n'}]|\\[\s\S]{f'|{q[0]}(?!{q[0] * 2})' if len(q) == 3 else ''})*{q}") for q in ('"', "'", '"""', "'''")}


def _end_of_f_string(text: str, i: int, quote: str, raw: bool, inner: list[tuple[int, int]], spec: bool = False) -> int:
    """Past the f-string whose quotes opened before i, or with ``spec`` at the brace that ends a format; -1 if there is no end. The spans of its expressions go to inner."""
    n = len(text)
    while i < n:
        c = text[i]
        if text.startswith(quote, i):
            return -1 if spec else i + len(quote)
        if c == "\\":
            if not raw and text.startswith("\\N{", i):
                i = text.find("}", i)
                if i < 0:
                    return -1
            i += 1 if text[i + 1 : i + 2] in ("{", "}") else 2
        elif c == "\n" and len(quote) == 1:
            return -1
        elif c == "}":
            if spec:
                return i
            if not text.startswith("}}", i):
                return -1
            i += 2
        elif c == "{" and not spec and text.startswith("{{", i):
            i += 2
        elif c == "{":
            i = _end_of_field(text, i + 1, quote, raw, inner)
            if i < 0:
                return -1
        else:
            i += 1
    return -1


def _end_of_field(text: str, first: int, quote: str, raw: bool, inner: list[tuple[int, int]]) -> int:
    """Past the brace that closes the replacement field whose expression begins at first; -1 if there is none."""
    i, depth, n = first, 0, len(text)
    while i < n:
        c = text[i]
        m = _PYTHON_OPENER.match(text, i) if c in "#rRbBuUfFtT\"'" else None
        if m and m.group(2):
            i = _end_of_f_string(text, m.end(), m.group(2), "r" in m.group(1).lower(), []) if "f" in m.group(1).lower() else x.end() if (x := _PYTHON_STRINGS[m.group(2)].match(text, m.end())) else -1
            if i < 0:
                return -1
            continue
        if m and c == "#":
            i = m.end()
            continue
        if c in "([{":
            depth += 1
        elif depth and c in ")]}":
            depth -= 1
        elif c in ")]":
            return -1
        elif not depth and (c in "}:" or c == "!" and not text.startswith("!=", i)):
            break
        i += 1
    else:
        return -1
    # name = and the like show the expression too
    shown = re.search(r"(?<![=!<>])=\s*\Z", text[first:i])
    inner.append((first, first + shown.start() if shown else i))
    if text[i] == "!":
        m = re.compile(r"![rsa]\s*").match(text, i)
        if not m:
            return -1
        i = m.end()
    if text[i : i + 1] == ":":
        i = _end_of_f_string(text, i + 1, quote, raw, inner, spec=True)
        if i < 0:
            return -1
    return i + 1 if text[i : i + 1] == "}" else -1


@lru_cache(maxsize=4096)
def _fits_python(expression: str) -> bool:
    return bool(expression.strip()) and language("python").check(f"({expression}\n)\n").valid


def _f_strings(text: str) -> str:
    """f-strings as plain strings of as many lines; their expressions are checked on their own, and one that doesn't fit leaves an error on its line."""
    if not re.search(r"[fF][rR]?[\"']", text):
        return text
    out: list[str] = []
    at = kept = 0
    while m := _PYTHON_OPENER.search(text, at):
        prefix, quote = (m.group(1) or "").lower(), m.group(2)
        if not quote:
            at = m.end()
        elif "f" not in prefix:
            x = _PYTHON_STRINGS[quote].match(text, m.end())
            if not x:
                break  # what stays open is an error anyway
            at = x.end()
        else:
            inner: list[tuple[int, int]] = []
            end = _end_of_f_string(text, m.end(), quote, "r" in prefix, inner)
            bad = next((a for a, b in inner if not _fits_python(text[a:b])), None) if end >= 0 else m.start()
            if bad is not None:
                return "".join([*out, text[kept : m.start()], "(", "\n" * text.count("\n", m.start(), bad), "$"])
            out += [text[kept : m.start()], f"'''{chr(10) * text.count(chr(10), m.start(), end)}'''"]
            at = kept = end
    return "".join([*out, text[kept:]])


_C_COMMENTS = [(r"//(?:[^\n\\]|\\[\s\S])*", ""), (r"/\*[\s\S]*?\*/", "")]
_C_OPENERS = r"/\*|\"|'"
_C_SUFFIX = r"[uUlLfFzZ]{1,3}|[fF](?:16|32|64|128)"
_CSS_NAMES = r"(?:--|-)?(?:[^\W\d]|\\.|#\{[^}\n]*\}|@\{[\w-]+\})(?:[\w-]|\\.|#\{[^}\n]*\}|@\{[\w-]+\})*|--[\w-]*"


class StyleSheet(Language):
    """Style sheets, whose words are lexed in their own way."""

    _LEX = re.compile(
        rf"(?P<s>[\s\x0b]+)|(?P<URL>url\([^()\"'\n]*\))|(?P<w>{_CSS_NAMES})|(?P<HASH>#[\w-]+)|(?P<AT>@@?[\w-]+)|(?P<VAR>\$[\w-]+)|(?P<PCT>(?:\d+\.?\d*|\.\d+)%)|(?P<DIM>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[A-Za-z_][\w-]*)"
        rf"|(?P<NUM>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<STR>\x03)|(?P<CDO><!--)|(?P<CDC>-->)|(?P<m>[^\w\s\x02-\x08@#\\])|(?P<x>[\s\S])"
    )

    def tokens(self, line: str) -> tuple[str, ...]:
        out = []
        for m in self._LEX.finditer(line):
            kind, text = m.lastgroup, m.group()
            if kind == "w":
                out.append(f"'{text}'" if text in self.words else "ID")
            elif kind == "m":
                out.append(f"'{text}'" if f"'{text}'" in self.parser.t.terminals else "$err")
            elif kind == "x":
                out.append("$err")
            elif kind != "s":
                out.append(kind)
        return tuple(out)


class Sass(StyleSheet):
    """The indented syntax: lines are fed to the grammar of SCSS, with braces for deeper and semicolons for equal indentation."""

    _MIXIN = ((re.compile(r"=\s*(?=[^\W\d]|-)"), "@mixin "), (re.compile(r"\+(?=[^\W\d]|-)"), "@include "))

    def check(self, text: str) -> Verdict:
        text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
        if "{" in re.sub(r"#\{", "", text):
            return language("scss").check(text)
        self.parser.tidy()
        lines, number = [], 1
        for line in self.stripped(_indented_comments(text)).split("\n"):
            if line.strip():
                lines.append((number, len((line[: len(line) - len(line.lstrip())]).expandtabs(8)), line.strip()))
            number += 1 + line.count(FOLD)
        stacks, levels, begun = self.parser.start, [0], False
        for i, (number, indent, line) in enumerate(lines):
            if (bad := self._open(line)) is not None:
                return Verdict(False, number, bad)
            below = lines[i + 1][1] if i + 1 < len(lines) else 0
            tokens: list[str] = []
            if not begun:  # the lines of a list of selectors need not be indented alike
                while indent < levels[-1]:
                    levels.pop()
                    tokens.append("'}'")
                if indent != levels[-1]:
                    return Verdict(False, number, "indent")
                for mark, word in self._MIXIN:
                    line = mark.sub(word, line, count=1) if mark.match(line) else line
            tokens += self.tokens(line)
            begun = line.endswith(",") and i + 1 < len(lines)
            ends = [[]] if begun else [["'{'"]] if below > levels[-1] else [["';'"]] if line.endswith(":") else [["';'"], ["'{'", "'}'"]]  # a selector may stand alone
            if ends == [["'{'"]]:
                levels.append(below)
            stacks, at = self._feed(stacks, tokens)
            if stacks is None:
                return Verdict(False, number, tokens[at].strip("'"))
            after = [to for e in ends if (to := self._feed(stacks, e)[0]) is not None]
            if not after or line.endswith(":") and below <= indent:
                return Verdict(False, number, "line break")
            stacks = frozenset().union(*after)
        stacks, _ = self._feed(stacks, ["'}'"] * (len(levels) - 1))
        return VALID if stacks is not None and self.parser.accepts(stacks) else Verdict(False, number - 1, "end")

    def _feed(self, stacks: frozenset[int], tokens: list[str]) -> tuple[frozenset[int] | None, int]:
        for i, t in enumerate(tokens):
            to = self._step(stacks, t)
            if to is None:
                return None, i
            stacks = to
        return stacks, len(tokens)

    @staticmethod
    def _open(line: str) -> str | None:
        """What leaves the brackets of a line open or unopened."""
        open_: list[str] = []
        for c in line:
            if c == ERR:
                return "$err"
            if c in "([{":
                open_.append(")]}"["([{".index(c)])
            elif c in ")]}" and (not open_ or open_.pop() != c):
                return c
        return "line break" if open_ else None


def _indented_comments(text: str) -> str:
    """Sass comments blanked: lines that begin with a comment mark, and the deeper ones below them."""
    out, level = [], -1
    closed = True
    for line in text.split("\n"):
        bare = line.strip()
        indent = len((line[: len(line) - len(line.lstrip())]).expandtabs(8))
        if bare and level >= 0 and indent <= level and not (not closed and bare.startswith("*")):
            level, closed = -1, True
        if level < 0 and bare.startswith(("//", "/*")) and not ("*/" in bare and not bare.endswith("*/")):
            level, closed = indent, not bare.startswith("/*")
        if level >= 0:
            closed |= "*/" in bare
        out.append("" if level >= 0 else line)
    return "\n".join(out)


def _c(cpp: bool) -> Language:
    raw = [(r'"(?<=R")(?P<d>[^()\\\s]{0,16})\([\s\S]*?\)(?P=d)"', STR)] if cpp else []
    literals = [*_C_COMMENTS, *raw, (_QUOTED, STR), (r"'(?<![0-9a-fA-F]')(?:[^'\\\n]|\\[^\n])+'", CHR)]
    return Language(grammars.CPP if cpp else grammars.C, literals, r"/\*|\"|'(?<![0-9a-fA-F]')", _C_SUFFIX, "asm typeof concept" if cpp else "asm typeof", prepare=_directives, prefix="(?:u8|[LuU])?R?")


def _directives(text: str) -> str:
    return _preprocessed(text) if "#" in text else text


@lru_cache(maxsize=None)
def language(name: str) -> Language:
    """The checker of a language, made on first use in each process."""
    css_literals = [(r"/\*[\s\S]*?\*/", ""), (_QUOTED, STR), (_SINGLE, STR)]
    lines = (r"//(?<![:\w]//)[^\n]*", "")
    if name == "json":
        return Language(grammars.JSON, [(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', STR)], r'"', number=r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
    if name == "css":
        return StyleSheet(grammars.css("css"), css_literals, r"/\*|\"|'", names=_CSS_NAMES)
    if name == "scss":
        return StyleSheet(grammars.css("scss"), [*css_literals, lines], r"/\*|\"|'", names=_CSS_NAMES)
    if name == "less":
        return StyleSheet(grammars.css("less"), [*css_literals, lines, (r"`[^`]*`", STR)], r"/\*|\"|'", soft="when", names=_CSS_NAMES)
    if name == "sass":
        return Sass(grammars.css("scss"), [*css_literals, lines], r"/\*|\"|'", names=_CSS_NAMES)
    if name in ("c", "cpp"):
        return _c(name == "cpp")
    if name == "go":
        return Language(grammars.GO, [(r"//[^\n]*", ""), (r"/\*[\s\S]*?\*/", ""), (_QUOTED, STR), (r"`[^`]*`", STR), (r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'", CHR)], r"/\*|\"|'|`", "i", layout="go")
    if name == "java":
        return Language(grammars.JAVA, [(r"//[^\n]*", ""), (r"/\*[\s\S]*?\*/", ""), (r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""', STR), (r'"(?:[^"\\\n]|\\[^\n])*"', STR), (r"'(?:[^'\\\n]|\\[^\n]{1,7}?)'", CHR)], _C_OPENERS, "[lLfFdD]", "record sealed permits non when yield")
    if name == "csharp":
        literals = [(r"//[^\n]*", ""), (r"/\*[\s\S]*?\*/", ""), (r'"""+[\s\S]*?"""+', STR), (r'@\$?"(?:[^"]|"")*"', STR), (r'\$@"(?:[^"]|"")*"', STR), (r'\$+"""+[\s\S]*?"""+', STR), (r'\$"(?:[^"\\\n{]|\\[^\n]|\{\{|\{[^{}\n]*\})*"', STR), (r'"(?:[^"\\\n]|\\[^\n])*"(?:u8)?', STR), (r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'", CHR), (r"@(?=[^\W\d])", "")]
        return Language(grammars.CSHARP, literals, _C_OPENERS, r"[uUlLfFdDmM]{1,2}", prepare=_directives)
    if name == "rust":
        literals = [(r"//[^\n]*", ""), (r'r(?<!\w\wr)(?P<h>#*)"[\s\S]*?"(?P=h)', STR), (r'"(?:[^"\\]|\\[\s\S])*"', STR), (r"'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u\{[^}\n]*\}|[^\n]))'", CHR), (r"'[^\W\d]\w*(?!')", LIFE), (r"r#(?<!\wr#)(?=[^\W\d])", "")]
        return Language(grammars.RUST, literals, r"/\*|\"|'", r"_?(?:[iu](?:8|16|32|64|128|size)|f32|f64)", "union auto raw box yield async await dyn", prepare=_nested_comments, prefix="[bc]")
    if name in ("js", "ts", "tsx"):
        return Language(grammars.ecma(name != "js"), [], r"/\*|\"|'|`", "n", layout="asi", prepare=_ecma_literals(name), names=_ECMA_NAMES)
    if name == "python":
        literals = [(r"#[^\n]*", ""), (r"\\\n", FOLD), (r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""', STR), (r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''", STR), (r'"(?!"")(?:[^"\\\n]|\\[\s\S])*"', STR), (r'""(?!")', STR), (r"'(?!'')(?:[^'\\\n]|\\[\s\S])*'", STR), (r"''(?!')", STR)]
        return Language(grammars.PYTHON, literals, r"\"|'", soft="match case type _", layout="indent", prepare=_f_strings, prefix="[rR][bBfF]?|[bBfF][rR]?|[uU]", number=_PYTHON_NUMBER)
    raise KeyError(name)


_ECMA_NAMES = r"(?:#?[^\W\d]|#?\$|\\u)[\w$\\]*"


# The language of each extension.
EXTENSIONS = {
    "rs": "rust", "ts": "ts", "tsx": "tsx", "js": "js", "jsx": "js", "cjs": "js", "mjs": "js", "py": "python", "go": "go", "java": "java", "c": "c", "h": "cpp_or_c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "hh": "cpp",
    "cxx": "cpp", "hxx": "cpp", "cs": "csharp", "css": "css", "scss": "scss", "sass": "sass", "less": "less", "json": "json",
}


def extension(path: str) -> str:
    """The last extension of a path's last component, in lower case."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def check_source(path: str | None, text: str | None) -> Verdict | None:
    """The verdict on a text by its path; None for a null text and for files of other extensions. Empty texts are valid."""
    name = EXTENSIONS.get(extension(path)) if path else None
    if name is None or text is None:
        return None
    if not text.strip("﻿ \t\r\n\f"):
        return VALID
    if name == "cpp_or_c":
        # a header may be of either language
        first = language("c").check(text)
        return first if first.valid or not language("cpp").check(text).valid else VALID
    return language(name).check(text)
