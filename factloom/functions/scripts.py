"""Declarations of JavaScript and TypeScript text by a scanner of tokens and brackets.

No grammar of the languages is at hand, so declarations are told by the tokens around a bracket. JSX, and calls inside of
template strings, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from .facts import Facts

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<number>0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?![\w$]))"""
    r"""|(?P<name>\#?[A-Za-z_$][\w$]*)|(?P<op>=>|\.\.\.|\?\.|===?|!==?|[<>]=|[{}()\[\];,.=?:!<>+\-*/%&|^~@#]|.)""",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/[a-z]*")
_KEYWORDS = frozenset("if for while switch catch return function await typeof new throw else do try class super import with in of case delete void yield instanceof extends".split())
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())
_STARTS = frozenset("const let var function class export import if for while return switch throw try async interface type enum namespace abstract".split())
#: Entries of a list that are kept by name.
ENTRIES = 60


def _template_end(text: str, at: int) -> int:
    """Past the template string that begins at ``at``; what it embeds may hold templates again."""
    open_, k = [], at + 1  # the braces that are open in every embedded expression around
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif open_ and open_[-1] >= 0:
            if c == "`":
                open_.append(-1)
            elif c in "\"'" and (quoted := _TOKEN.match(text, k)).lastgroup == "string":
                k = quoted.end() - 1
            elif c == "{":
                open_[-1] += 1
            elif c == "}":
                open_[-1] -= 1
                if open_[-1] < 0:
                    open_.pop()
        elif c == "`":
            if not open_:
                return k + 1
            open_.pop()
        elif c == "$" and text[k + 1 : k + 2] == "{":
            open_.append(0)
            k += 1
        k += 1
    return len(text)


def script_tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, offset) of the tokens; white space and comments are left out."""
    out, at = [], 0
    while at < len(text):
        last = out[-1] if out else ("op", "", 0)
        if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and (last[0] == "op" and last[1] not in (")", "]", "}") or last[1] in _BEFORE_REGEX) and (found := _REGEX.match(text, at)):
            out.append(("regex", found[0], at))
        elif text[at] == "`":
            end = _template_end(text, at)
            out.append(("string", text[at:end], at))
            at = end
            continue
        else:
            found = _TOKEN.match(text, at)
            if found.lastgroup != "skip":
                out.append((found.lastgroup, found[0], at))
        at = found.end()
    return out


def _brackets(tokens: list) -> dict[int, int]:
    """The closing bracket of every opening one; text whose brackets do not balance is malformed."""
    pairs, open_ = {}, []
    for i, (kind, t, _) in enumerate(tokens):
        if kind == "op" and t in "({[":
            open_.append(i)
        elif kind == "op" and t in ")}]":
            if not open_ or tokens[open_[-1]][1] + t not in ("()", "{}", "[]"):
                raise SyntaxError("brackets do not balance")
            pairs[open_.pop()] = i
    if open_:
        raise SyntaxError("brackets do not balance")
    return pairs


class Scanner:
    """Finds declarations as (first token, first token of the body, last token, facts) and counts their facts."""

    def __init__(self, text: str):
        self.text, self.tokens = text, script_tokens(text)
        self.pairs = _brackets(self.tokens)
        self.found: list[tuple[int, int, int, Facts]] = []
        self.walk(0, len(self.tokens), (), "code")
        self.found.sort(key=lambda x: (x[0], -x[2]))

    def at(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def line(self, i: int) -> int:
        return self.text.count("\n", 0, self.tokens[i][2]) + 1

    def after_generics(self, i: int) -> int:
        """Past the type parameters that may begin at ``i``."""
        if self.at(i) != "<":
            return i
        depth, k = 0, i
        while k < len(self.tokens):
            depth += (self.at(k) == "<") - (self.at(k) == ">")
            k += 1
            if depth == 0:
                break
        return k

    def params(self, i: int) -> int:
        """How many parameters stand between the bracket at ``i`` and its partner."""
        n, last, k = 0, ",", i + 1
        while k < self.pairs[i]:
            t = self.at(k)
            if t == ",":
                n += last != ","
            last = t
            k = self.pairs[k] + 1 if k in self.pairs else self.after_generics(k) if t == "<" else k + 1
        return n + (last != ",")

    def _body(self, i: int, ends: tuple[str, ...]) -> int | None:
        """The first of ``ends`` past a type annotation that may begin at ``i``."""
        if self.at(i) in ends:
            return i
        if self.at(i) != ":":
            return None
        k = i + 1
        while k < len(self.tokens) and self.at(k) not in (";", ")"):
            if self.at(k) in ends and k > i + 1:
                return k
            k = self.pairs[k] + 1 if k in self.pairs else self.after_generics(k) if self.at(k) == "<" else k + 1
        return None

    def _end(self, i: int) -> int:
        """The last token of the expression that begins at ``i``."""
        k = i
        while k < len(self.tokens):
            if self.at(k) in (",", ";", ")", "]", "}"):
                return k - 1
            if k > i and self.at(k) in _STARTS and self.kind(k) == "name" and "\n" in self.text[self.tokens[k - 1][2] : self.tokens[k][2]]:
                return k - 1
            k = self.pairs[k] + 1 if k in self.pairs else k + 1
        return len(self.tokens) - 1

    def function_at(self, i: int) -> tuple[int, int, int, int, str] | None:
        """(parameters, start of the body, end, number of parameters, own name) of a function or arrow that begins at ``i``."""
        k = i + (self.at(i) == "async" and self.at(i + 1) not in ("=>", ",", ")"))
        if self.at(k) == "function" and self.kind(k) == "name":
            k += 1 + (self.at(k + 1) == "*")
            name = self.at(k) if self.kind(k) == "name" else ""
            k = self.after_generics(k + bool(name))
            if self.at(k) == "(" and (b := self._body(self.pairs[k] + 1, ("{",))):
                return k, b, self.pairs[b], self.params(k), name
            return None
        k = self.after_generics(k)
        if self.kind(k) == "name" and self.at(k + 1) == "=>":
            arrow, n = k + 1, 1
        elif self.at(k) == "(" and (a := self._body(self.pairs[k] + 1, ("=>",))):
            arrow, n = a, self.params(k)
        else:
            return None
        b = arrow + 1
        return k, b, self.pairs[b] if self.at(b) == "{" else self._end(b), n, ""

    def declare(self, first: int, body: int, end: int, name: tuple, kind: str, n: int = 0, modifiers: tuple = ()) -> Facts:
        facts = Facts(".".join(name), kind, self.line(first), n, modifiers=list(modifiers))
        self.found.append((first, body, end, facts))
        return facts

    def value(self, first: int, i: int, scope: tuple, name: str | None, kind_of_place: str, modifiers: tuple = ()) -> int | None:
        """What a name is bound to, if that declares or scopes anything; the token after it."""
        inner = (*scope, name) if name else scope
        if found := self.function_at(i):
            _, body, end, n, _ = found
            if name:
                self.declare(first, i, end, inner, "function", n, modifiers)
            self.walk(i, found[0], scope, "code")
            self.walk(found[0], end + 1, inner, "code")
            return end + 1
        if kind_of_place == "field":
            return None
        if self.at(i) in ("{", "[") and i in self.pairs:
            end = self.pairs[i]
            if kind_of_place == "variable" and not scope:
                self.entries(self.declare(first, i, end, inner, "data"), i)
            self.walk(i + 1, end, inner if self.at(i) == "{" else scope, "object" if self.at(i) == "{" else "code")
            return end + 1
        if kind_of_place == "variable" and self.at(i) == "class":
            return self.klass(first, i, scope, name)
        return None

    def entries(self, facts: Facts, i: int) -> None:
        shown, k, end = [], i + 1, self.pairs[i]
        while k < end:
            to = k
            while to < end and self.at(to) != ",":
                to = self.pairs[to] + 1 if to in self.pairs else to + 1
            if to > k:
                if self.at(i) == "[":
                    shown.append(self.text[self.tokens[k][2] : self.tokens[to - 1][2] + len(self.at(to - 1))])
                else:
                    key = next((m for m in range(k, to) if self.at(m) == ":"), None)
                    if key is not None and self.kind(k) in ("name", "string", "number"):
                        shown.append(self.at(k))
            k = to + 1
        facts.shape, facts.entry_count = ("array" if self.at(i) == "[" else "object"), len(shown)
        facts.entries = [re.sub("^[\"'`]|[\"'`]$", "", x).strip() for x in shown[:ENTRIES]]

    def klass(self, first: int, i: int, scope: tuple, bound: str | None) -> int | None:
        own = self.at(i + 1) if self.kind(i + 1) == "name" and self.at(i + 1) not in ("extends", "implements") else ""
        k = i + 1
        while k < len(self.tokens) and self.at(k) != "{":
            k = self.pairs[k] + 1 if k in self.pairs else k + 1
        if k not in self.pairs:
            return None
        name = bound or own
        inner = (*scope, name) if name else scope
        if name:
            self.declare(first, k, self.pairs[k], inner, "class")
        self.walk(k + 1, self.pairs[k], inner, "class")
        return self.pairs[k] + 1

    def member(self, i: int, scope: tuple, place: str) -> int | None:
        """A method, accessor, field or pair that begins at ``i`` in a class or an object."""
        modifiers, k = [], i
        while self.kind(k) == "name" and self.at(k) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare") and (self.kind(k + 1) in ("name", "string", "number") or self.at(k + 1) in ("*", "[")):
            modifiers.append(self.at(k))
            k += 1
        if self.at(k) == "*":
            modifiers.append("generator")
            k += 1
        if self.at(k) == "[" and k in self.pairs:
            name, after = None, self.pairs[k] + 1
        elif self.kind(k) in ("name", "string", "number"):
            name, after = (self.at(k)[1:-1] if self.kind(k) == "string" else self.at(k)), k + 1
        else:
            return None
        kept = tuple(m for m in ("static", "async", "generator") if m in modifiers)
        after += place == "class" and self.at(after) in ("?", "!")
        call = self.after_generics(after)
        if self.at(call) == "(" and (b := self._body(self.pairs[call] + 1, ("{",))):
            kind = "getter" if "get" in modifiers else "setter" if "set" in modifiers else "method"
            inner = (*scope, name) if name is not None else scope
            if name is not None:
                self.declare(i, call, self.pairs[b], inner, kind, self.params(call), kept)
            self.walk(call, self.pairs[b] + 1, inner, "code")
            return self.pairs[b] + 1
        if place == "class":
            sign = after if self.at(after) == "=" else self._body(after, ("=",))
            return self.value(i, sign + 1, scope, name, "field", tuple(m for m in kept if m == "static")) if sign else None
        if self.at(after) == ":":
            return self.value(i, after + 1, scope, name, "pair")
        return None

    def walk(self, lo: int, hi: int, scope: tuple, place: str) -> None:
        i, fresh = lo, True
        while i < hi:
            t, kind, to = self.at(i), self.kind(i), None
            if place != "code":
                if fresh:
                    to = self.member(i, scope, place)
                if to is None:
                    fresh = t in (",", ";", "}") or self.pairs.get(i) is not None and place == "class" and t == "{"
                    if kind == "name" and t != "class" and (found := self.function_at(i)) and self.at(i - 1) not in (".",):
                        self.walk(found[0], found[2] + 1, scope, "code")
                        to = found[2] + 1
                    elif i in self.pairs:
                        to = self.group(i, scope)
                else:
                    fresh = True
                    to += self.at(to) in (",", ";") and to < hi
                i = to if to is not None else i + 1
                continue
            if kind == "name" and self.at(i - 1) != ".":
                if t in ("const", "let", "var"):
                    i = self.variables(i + 1, scope)
                    continue
                if t == "class" and (self.kind(i + 1) == "name" or self.at(i + 1) == "{"):
                    bound = self.at(i - 1) in ("=", "(", ",", ":", "return")  # an expression, which declares nothing by itself
                    to = self.anonymous_class(i, scope) if bound else self.klass(i, i, scope, None)
                elif t in ("namespace", "module") and self.kind(i + 1) == "name":
                    k = i + 1
                    while self.kind(k) == "name" or self.at(k) == ".":
                        k += 1
                    if self.at(k) == "{":
                        self.walk(k + 1, self.pairs[k], (*scope, "".join(self.at(m) for m in range(i + 1, k))), "code")
                        to = self.pairs[k] + 1
                elif (t == "function" or t == "async" and self.at(i + 1) == "function") and (found := self.function_at(i)):
                    before = self.at(i - 1)
                    statement = before in ("", ";", "{", "}", ")", "export", "default", "async") or self.kind(i - 1) in ("name", "string", "number") and before not in _KEYWORDS
                    inner = (*scope, found[4]) if found[4] else scope
                    if statement and found[4]:
                        self.declare(i, found[0], found[2], inner, "function", found[3])
                    self.walk(found[0], found[2] + 1, inner, "code")
                    to = found[2] + 1
                else:
                    to = self.assignment(i, scope)
            if to is None and i in self.pairs:
                to = self.group(i, scope)
            i = to if to is not None else i + 1

    def anonymous_class(self, i: int, scope: tuple) -> int | None:
        k = i + 1
        while k < len(self.tokens) and self.at(k) != "{":
            k = self.pairs[k] + 1 if k in self.pairs else k + 1
        if k not in self.pairs:
            return None
        self.walk(k + 1, self.pairs[k], scope, "class")
        return self.pairs[k] + 1

    def variables(self, i: int, scope: tuple) -> int:
        """The declarators of a const, let or var statement; the token after those that were read."""
        while True:
            if i in self.pairs and self.at(i) in ("{", "["):
                self.group(i, scope)
                i = self.pairs[i] + 1
                name = None
            elif self.kind(i) == "name":
                name = self.at(i)
                i += 1
            else:
                return i
            first = i - 1
            i += self.at(i) == "!"
            sign = i if self.at(i) == "=" else self._body(i, ("=",))
            if sign is None:
                if self.at(i) != ",":
                    return i
                i += 1
                continue
            to = self.value(first, sign + 1, scope, name, "variable")
            if to is None or self.at(to) not in (",", ";", "") and "\n" not in self.text[self.tokens[to - 1][2] : self.tokens[to][2]]:
                end = self._end(sign + 1)
                self.walk(to if to is not None else sign + 1, end + 1, scope, "code")
                to = end + 1
            if self.at(to) != ",":
                return to
            i = to + 1

    def assignment(self, i: int, scope: tuple) -> int | None:
        """``a.b = value`` where the value is a function or an object."""
        if self.at(i) in _KEYWORDS or self.at(i) == "this":
            return None
        k = i + 1
        while self.at(k) == "." and self.kind(k + 1) == "name":
            k += 2
        if self.at(k) != "=" or self.at(i - 1) in (".", ",", "?", ":"):
            return None
        name = "".join(self.at(m) for m in range(i, k))
        if self.at(k + 1) == "[":
            return None
        return self.value(i, k + 1, scope, name, "assignment")

    def group(self, i: int, scope: tuple) -> int:
        """What stands between a bracket and its partner; functions in a call with a string first belong to that string's scope."""
        end = self.pairs[i]
        if self.at(i) == "{" and self.is_object(i):
            self.walk(i + 1, end, scope, "object")
        elif self.at(i) == "(" and self.kind(i - 1) == "name" and self.at(i - 1) not in _KEYWORDS or self.at(i) == "(" and self.at(i - 1) in (")", "]"):
            label = self.at(i + 1)[1:-1].strip() if self.kind(i + 1) == "string" and self.at(i + 1)[0] != "`" and self.at(i + 2) in (",", ")") else ""
            k = i + 1
            while k < end:
                if (found := self.function_at(k)) and found[2] < end:
                    inner = (*scope, label) if label else (*scope, found[4]) if found[4] else scope
                    self.walk(found[0], found[2] + 1, inner, "code")
                    k = found[2] + 1
                else:
                    to = k
                    while to < end and self.at(to) != ",":
                        to = self.pairs[to] + 1 if to in self.pairs else to + 1
                    self.walk(k, to, scope, "code")
                    k = to
                k += self.at(k) == "," and k < end
        else:
            self.walk(i + 1, end, scope, "code")
        return end + 1

    def is_object(self, i: int) -> bool:
        """Whether the brace at ``i`` opens an object and not a block."""
        before = self.at(i - 1)
        if before in ("=", "(", ",", "[", ":", "?", "return", "&", "|", "...", "==", "===", "!=", "!=="):
            return not (before == ":" and self.kind(i + 1) == "name" and self.at(i + 2) not in (":", ",", "}", "("))
        return False

    def count(self, body: int, end: int, facts: Facts) -> None:
        """The facts of a declaration without those of the declarations inside."""
        inner = {x[0]: x[2] for x in reversed(self.found) if body <= x[0] and x[2] <= end and x[3] is not facts}
        i, open_ = body, []
        while i <= end and i < len(self.tokens):
            if i in inner:
                i = inner[i] + 1
                continue
            kind, t, _ = self.tokens[i]
            while open_ and open_[-1][1] < i:
                open_.pop()
            if i in self.pairs:
                open_.append((i, self.pairs[i], self.at(i) == "{" and (self.is_object(i) or i == body and facts.kind == "data")))
            if kind == "number":
                digits = t.lower()
                value = float(int(digits, 0)) if digits[:2] in ("0x", "0b", "0o") else float("nan") if "_" in digits or digits.endswith("n") else float(digits)
                if math.isfinite(value):
                    facts.numbers.add(value)
            elif kind == "name" and self.at(i - 1) not in (".", "?."):
                self.word(i, t, facts)
                if open_ and open_[-1][2] and self.at(i - 1) == ":" and self.at(i + 1) in (",", "}") and t not in ("null", "true", "false", "this", "undefined"):
                    facts.callbacks.add(t)
            i += 1

    def word(self, i: int, t: str, facts: Facts) -> None:
        at = self.at
        if t == "throw":
            facts.throws += 1
            if at(i + 1) == "new":
                k, name = i + 3, at(i + 2)
                while at(k) == "." and self.kind(k + 1) == "name":
                    name, k = f"{name}.{at(k + 1)}", k + 2
                facts.throw_types.add(name)
        elif t == "return":
            facts.returns += 1
            facts.returns_nullish += at(i + 1) in ("null", "undefined") and at(i + 2) in (";", "}", "")
        elif t == "await":
            facts.awaits += 1
        elif t == "catch":
            facts.catches += 1
            k = self.pairs.get(i + 1, i) + 1 if at(i + 1) == "(" else i + 1
            facts.empty_catches += at(k) == "{" and self.pairs[k] == k + 1
        elif t not in _KEYWORDS and t not in ("this", "async"):
            name, k = t, i + 1
            while at(k) in (".", "?.") and self.kind(k + 1) == "name":
                name, k = f"{name}.{at(k + 1)}", k + 2
            if self.at(self.after_generics(k)) == "(" and at(k - 1) != "." and at(i - 1) not in ("new", "function") and (at(k) == "(" or at(k) == "<"):
                facts.calls.add(name)


def script_declarations(text: str) -> Iterator[Facts]:
    """Classes, functions, methods, accessors, fields and named lists of a script, each with its facts.

    Brackets have to balance, else the text counts as malformed.
    """
    scanner = Scanner(text)
    for _, body, end, facts in scanner.found:
        scanner.count(body, end, facts)
        yield facts
