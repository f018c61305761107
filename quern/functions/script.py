"""TypeScript and JavaScript text to tokens, and from tokens to functions, imports, exports and markers.

The reader works on tokens, not on a syntax tree: brackets are matched once,
and every construct is found from its keyword or sign and the brackets around
it.  Strings, templates, regular expressions, comments and JSX are lexed as
such, so words inside them are never taken for code.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_SPACE = re.compile(r"\s+")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_NAME = re.compile(r"#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'?|\"(?:[^\"\\\n]|\\.)*\"?", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_SIGN = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#\\]")
#: The plain tokens, with the space before them, in one match: whatever starts otherwise (comments, regular expressions, templates, JSX, other scripts' letters) is told apart by its first character.
_PLAIN = re.compile(
    rf"\s*+(?:(?P<name>[A-Za-z_$][\w$\u0080-\U0010ffff]*)|(?P<string>{_STRING.pattern})|(?P<number>(?=\.?[0-9])(?:{_NUMBER.pattern}))|(?P<sign>\.\.\.|\.(?=[A-Za-z_$])|(?![./<#\\])(?:{_SIGN.pattern})))", re.S
)
#: A directive and a plain import in front of a script, a whole line each; words that are sought name nothing in it.
_FIRST = re.compile(r"""((['"])use [a-z]+\2)(;)[ \t]*\n""")
_IMPORTED = r"(?!(?:any|as|export|from|function|import|process|require|type|useEffect|useLayoutEffect)\b)[A-Za-z_$][\w$]*"
_HEAD = re.compile(rf"import[ \t]+(?:(type)[ \t]+)?(?:\{{[ \t]*({_IMPORTED}(?:[ \t]*,[ \t]*{_IMPORTED})*)[ \t]*\}}|{_IMPORTED})[ \t]+from[ \t]+(?:'([^'\\\n]*)'|\"([^\"\\\n]*)\")(;)[ \t]*\n", re.A)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Words after which a slash starts a regular expression and a less-than sign JSX.
_BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await default".split())
_CONTROL = frozenset("if for while do catch".split())
#: Words that stand before brackets without naming a method.
_NOT_METHODS = frozenset("if for while switch catch with function return typeof instanceof in of new delete void throw case do else yield await super import".split())
_MODIFIERS = frozenset("async static public private protected readonly override abstract get set declare accessor".split())
#: Words and signs that constructs are found by; a script is gone through once for all of them.
_SOUGHT = frozenset(("function", "=>", "(", "import", "export", "require", "any", "as", "process", "useEffect", "useLayoutEffect"))
#: Fixed: modules that run on a server only.
SERVER_ONLY = ("node:fs", "node:child_process", "node:crypto", "fs", "fs/promises", "child_process", "server-only", "pg", "mysql", "mysql2", "mongodb", "ioredis", "nodemailer")
#: Fixed: how many names of environment variables and path literals are kept of a file.
MAX_ENV_READS, MAX_PATH_LITERALS = 60, 200
_DIRECTIVE = re.compile(r"/[/*]+\s*@?(ts-ignore|ts-expect-error|eslint-disable(?:-next-line)?)\b")
_PATH_LITERAL = re.compile(r"""['"`]([^'"`\n\s]*/[^'"`\n\s]*\.[A-Za-z0-9]{1,5})['"`]""")


@dataclass(slots=True)
class Token:
    kind: str  # name, string, template, number, regex, sign, jsx
    text: str
    at: int
    end: int


class Lexer:
    """Tokens and comments of a text; ``jsx`` allows elements as values."""

    def __init__(self, text: str, jsx: bool) -> None:
        self.text, self.jsx = text, jsx
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, str]] = []
        self.heads: list[re.Match] = []
        self._run(self._head(), None)

    def _head(self) -> int:
        """Past the directives and plain imports in front, which most scripts say more of than of anything else: they are kept as matches, with the last one's end as a token."""
        i = 0
        while m := _FIRST.match(self.text, i):
            self._add("string", *m.span(1)), self._add("sign", *m.span(3))
            i = m.end()
        while m := _HEAD.match(self.text, i):
            self.heads.append(m)
            i = m.end()
        if self.heads:
            self._add("sign", *self.heads[-1].span(5))
        return i

    def _add(self, kind: str, at: int, end: int) -> int:
        self.tokens.append(Token(kind, self.text[at:end], at, end))
        return end

    def _value_next(self) -> bool:
        """Whether a value, not an operator, comes next."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "name":
            return t.text in _BEFORE_VALUE
        return t.kind == "sign" and t.text not in (")", "]", "}", "++", "--")

    def _run(self, i: int, stop: str | None) -> int:
        """Lex from ``i`` until the bracket that closes what ``stop`` names, or the end."""
        text, depth = self.text, 0
        n, plain, add = len(text), _PLAIN.match, self.tokens.append
        while i < n:
            if m := plain(text, i):
                kind = m.lastgroup
                word, end = m[kind], m.end()
                at = end - len(word)
                if stop and kind == "sign":
                    if word == "{":
                        depth += 1
                    elif word == "}":
                        if not depth:
                            return at
                        depth -= 1
                add(Token(kind, word, at, end))
                i = end
                continue
            c = text[i]
            if c.isspace():
                i = _SPACE.match(text, i).end()
            elif text.startswith(("//", "/*"), i):
                m = _COMMENT.match(text, i)
                self.comments.append((i, m[0]))
                i = m.end()
            elif c in "'\"":
                i = self._add("string", i, _STRING.match(text, i).end())
            elif c == "`":
                i = self._template(i)
            elif c.isdigit() or (c == "." and i + 1 < n and text[i + 1].isdigit()):
                i = self._add("number", i, max(_NUMBER.match(text, i).end(), i + 1))
            elif m := _NAME.match(text, i):
                i = self._add("name", i, m.end())
            elif c == "/" and (self._value_next() or self._after_condition()) and (m := _REGEX.match(text, i)):
                i = self._add("regex", i, m.end())
            elif c == "<" and self.jsx and self._value_next() and self._starts_element(i):
                i = self._element(i)
            elif m := _SIGN.match(text, i):
                if stop and c == "{":
                    depth += 1
                elif stop and c == "}":
                    if not depth:
                        return i
                    depth -= 1
                i = self._add("sign", i, m.end())
            else:
                i += 1
        return i

    def _after_condition(self) -> bool:
        """After the brackets of an if or while a value may follow."""
        if not self.tokens or self.tokens[-1].text != ")":
            return False
        depth = 0
        for k in range(len(self.tokens) - 1, -1, -1):
            t = self.tokens[k].text
            depth += (t == ")") - (t == "(")
            if not depth:
                return k > 0 and self.tokens[k - 1].text in ("if", "while", "for")
        return False

    def _template(self, i: int) -> int:
        """A template: its text is one token; what its placeholders hold is lexed after it."""
        text, n, start, holes = self.text, len(self.text), i, []
        i += 1
        self._add("template", start, start + 1)
        whole = self.tokens[-1]
        while i < n and text[i] != "`":
            if text[i] == "\\":
                i += 2
            elif text.startswith("${", i):
                holes.append(i)
                i = self._hole(i, 2)
            else:
                i += 1
        whole.end = min(i + 1, n)
        whole.text = text[start : whole.end] if not holes else "`"
        return whole.end

    def _starts_element(self, i: int) -> bool:
        m = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*)").match(self.text, i)
        if not m or m[0] == "<>":
            return bool(m)
        after = _SPACE.sub("", self.text[m.end() : m.end() + 40])
        return not after.startswith((",", "extends", "="))  # type parameters

    def _element(self, i: int) -> int:
        """An element with all its children; expressions inside are lexed as code."""
        self._add("jsx", i, i + 1)
        text, n, depth = self.text, len(self.text), 0
        while i < n:
            if text.startswith("</", i):
                i = (text.find(">", i) + 1) or n
                depth -= 1
            elif text[i] == "<":
                i, closed = self._tag(i + 1)
                depth += not closed
            elif text[i] == "{":
                i = self._hole(i, 1)
                continue
            else:
                i += 1
                continue
            if depth <= 0:
                break
        self._add("jsx", i, i)
        return i

    def _tag(self, i: int) -> tuple[int, bool]:
        """Past an opening tag: (where its children start, whether it closed itself)."""
        text, n = self.text, len(self.text)
        while i < n:
            c = text[i]
            if c == ">":
                return i + 1, False
            if text.startswith("/>", i):
                return i + 2, True
            if c in "'\"":
                i = (text.find(c, i + 1) + 1) or n
            elif c == "{":
                i = self._hole(i, 1)
            else:
                i += 1
        return n, True

    def _hole(self, i: int, width: int) -> int:
        """Past code in braces inside a template or element; its tokens stand in brackets of their own."""
        self.tokens.append(Token("sign", "[", i, i + width))
        end = min(self._run(i + width, "}") + 1, len(self.text))
        self.tokens.append(Token("sign", "]", end - 1, end))
        return end


class Script:
    """What a script declares and takes in, from its tokens."""

    def __init__(self, path: str, text: str) -> None:
        self.text = text
        lexer = Lexer(text, path.endswith((".tsx", ".jsx")))
        self.t, self.comments, self.heads = lexer.tokens, lexer.comments, lexer.heads
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.match: dict[int, int] = {}
        self.words: list[str] = []
        self.level: list[int] = []
        self.around: list[int] = []  # the bracket that holds each token
        self.strings: list[int] = []
        self.places: dict[str, list[int]] = {w: [] for w in _SOUGHT}
        stack: list[int] = []
        depth, top = 0, -1
        say, deep, hold = self.words.append, self.level.append, self.around.append
        for i, t in enumerate(self.t):
            kind, w = t.kind, t.text
            if kind == "sign":
                if w in _CLOSE and stack:
                    j = stack.pop()
                    self.match[i], self.match[j] = j, i
                    depth, top = len(stack), stack[-1] if stack else -1
                say(w), deep(depth), hold(top)
                if w in _OPEN:
                    stack.append(i)
                    depth, top = depth + 1, i
            else:
                say(w if kind == "name" else ""), deep(depth), hold(top)
                if kind == "string":
                    self.strings.append(i)
                    continue
            if w in _SOUGHT:
                self.places[w].append(i)
        self.functions = self._functions()

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def code(self, a: int, z: int) -> str:
        """The source from token ``a`` up to token ``z``, inclusive."""
        return self.text[self.t[a].at : max(t.end for t in self.t[a : z + 1])]

    def _sought(self, *words: str) -> list[tuple[int, Token]]:
        """The tokens that say one of ``words``, in order."""
        return [(i, self.t[i]) for i in (sorted(i for w in words for i in self.places[w]) if len(words) > 1 else self.places[words[0]])]

    def _is_property(self, i: int) -> bool:
        return self.word(i - 1) in (".", "?.")

    # statements ------------------------------------------------------------

    def _after(self, i: int) -> int:
        """The token after the bracket pair at ``i``."""
        return self.match.get(i, len(self.t) - 1) + 1

    def statement_end(self, i: int) -> int:
        """The last token of the statement that starts at ``i``."""
        n = len(self.t)
        if i >= n:
            return n - 1
        w = self.word(i)
        if w == "{":
            return self.match.get(i, n - 1)
        if w in ("if", "for", "while", "switch", "with") and not self._is_property(i):
            j = i + 1 + (self.word(i + 1) == "await")
            end = self.statement_end(self._after(j))
            if w == "if" and self.word(end + 1) == "else":
                end = self.statement_end(end + 2)
            return end
        if w == "do":
            end = self.statement_end(i + 1)
            if self.word(end + 1) == "while":
                end = self.match.get(end + 2, n - 1)
            return end + (self.word(end + 1) == ";")
        if w == "try":
            end = self.match.get(i + 1, n - 1)
            while self.word(end + 1) in ("catch", "finally"):
                k = end + 2
                k = self._after(k) if self.word(k) == "(" else k
                end = self.match.get(k, n - 1)
            return end
        return self.value_end(i, ";")

    def value_end(self, i: int, *stops: str) -> int:
        """The last token of the expression at ``i``: up to a stop or the bracket that closes what holds it."""
        n, j = len(self.t), i
        while j < n:
            t = self.t[j]
            if t.kind == "sign" and t.text in _CLOSE:
                return j - 1
            if t.kind == "sign" and t.text in stops:
                return j if t.text == ";" else j - 1
            if t.kind == "sign" and t.text in _OPEN:
                j = self.match.get(j, n - 1)
            if j + 1 < n and "\n" in self.text[self.t[j].end : self.t[j + 1].at] and self._breaks_after(j):
                return j
            j += 1
        return n - 1

    def _breaks_after(self, j: int) -> bool:
        """Whether a line break after token ``j`` ends a statement."""
        a, b = self.t[j], self.t[j + 1]
        ended = a.kind != "sign" and a.text not in _BEFORE_VALUE or a.kind == "sign" and a.text in (")", "]", "}", "++", "--")
        goes_on = b.kind == "sign" and b.text not in ("{", "}", "@", "!", "++", "--", "#") or b.text in ("instanceof", "in", "as", "satisfies", "of")
        return ended and not goes_on

    # functions ---------------------------------------------------------------

    def _functions(self) -> list[dict]:
        found = []
        for i, t in self._sought("function", "=>", "("):
            if t.kind == "name" and t.text == "function" and not self._is_property(i) and self.word(i + 1) != ":":
                got = self._declared(i)
            elif t.kind == "sign" and t.text == "=>":
                got = self._arrow(i)
            elif t.kind == "sign" and t.text == "(":
                got = self._method(i)
            else:
                continue
            if got:
                found.append(got)
        found.sort(key=lambda f: (f["first"], -f["last"]))
        for f in found:
            f["complexity"], f["max_nesting"] = self._measure(f, found)
            inside = range(f["body"], f["last"] + 1)
            named = "A" <= f["name"][:1] <= "Z"
            jsx = named and any(self.t[k].kind == "jsx" for k in inside)
            a, z = self.line(self.t[f["first"]].at), self.line(self.t[f["last"]].end)
            f.update(line=a, end_line=z, lines=z - a + 1, is_component=jsx)
        return found

    def _params(self, i: int) -> int:
        """How many parameters the brackets at ``i`` hold."""
        z = self.match.get(i, len(self.t) - 1)
        if z == i + 1:
            return 0
        angle, n = 0, 1
        j = i + 1
        while j < z:
            w = self.word(j)
            if w in _OPEN:
                j = self.match.get(j, z)
            elif w == "<":
                angle += 1
            elif w in (">", ">>") and angle:
                angle -= min(angle, len(w))
            elif w == "," and not angle and j + 1 < z:
                n += 1
            j += 1
        return n

    def _body_after(self, i: int) -> int:
        """The brace that opens the body after the parameters closed at ``i - 1``, past a return type; -1 for none."""
        if self.word(i) == ":":
            i += 1
            angle = 0
            while i < len(self.t):
                w = self.word(i)
                if w == "<":
                    angle += 1
                elif w in (">", ">>", ">>>"):
                    angle -= len(w)
                elif w == "{" and angle <= 0 and self.word(i - 1) not in (":", "|", "&", "=>", "<", ",", "is", "extends"):
                    break
                elif w in (";", "=") or w in _CLOSE:
                    return -1
                i = self._after(i) if w in _OPEN else i + 1
        return i if self.word(i) == "{" else -1

    def _declared(self, i: int) -> dict | None:
        first = i - 1 if self.word(i - 1) == "async" else i
        while self.word(first - 1) in ("export", "default", "declare"):
            first -= 1
        statement = first == 0 or self.word(first - 1) in (";", "{", "}", ")", "else", "do") or first != i and self.word(first) == "export" or self._line_starts(first)
        j = i + 1 + (self.word(i + 1) == "*")
        own = self.t[j].text if j < len(self.t) and self.t[j].kind == "name" else None
        j += own is not None
        j = self._past_types(j)
        if self.word(j) != "(":
            return None
        body = self._body_after(self._after(j))
        if body < 0:
            return None
        if statement:
            name, start = own or "<anonymous>", first
        else:
            start = i - 1 if self.word(i - 1) == "async" else i
            name = self._name_before(start)
        return {"first": start, "params": self._params(j), "body": body, "last": self.match.get(body, len(self.t) - 1), "name": name}

    def _line_starts(self, i: int) -> bool:
        return i > 0 and "\n" in self.text[self.t[i - 1].end : self.t[i].at] and self._breaks_after(i - 1)

    def _past_types(self, j: int) -> int:
        """Past type parameters in angle brackets."""
        if self.word(j) != "<":
            return j
        depth = 0
        while j < len(self.t):
            w = self.word(j)
            depth += (w == "<") - (len(w) if w in (">", ">>", ">>>") else 0)
            if depth <= 0:
                return j + 1
            j = self._after(j) if w in _OPEN else j + 1
        return j

    def _arrow(self, i: int) -> dict | None:
        j, params = i - 1, 1
        if self.word(j) == ")":
            opened = self.match.get(j, -1)
        else:
            opened = self._typed_params(i)
            if opened < 0 and self.t[j].kind != "name":
                return None
        if opened >= 0:
            first, params = opened, self._params(opened)
            if self.word(first - 1) in (">", ">>"):
                first = self._type_start(first - 1)
        else:
            first = j
        if self.word(first - 1) == "async":
            first -= 1
        if self._in_type(first, i):
            return None
        body = i + 1
        last = self.match.get(body, len(self.t) - 1) if self.word(body) == "{" else self.value_end(body, ",", ";", ":")
        last -= last < len(self.t) and self.word(last) == ";"
        if body >= len(self.t):
            return None
        return {"first": first, "params": params, "body": body, "last": max(last, body), "name": self._name_before(first)}

    def _typed_params(self, i: int) -> int:
        """The opening bracket of ``(…): Type =>`` whose arrow is at ``i``; -1 for none."""
        j = i - 1
        while j > 0 and i - j < 60:
            w = self.word(j)
            if w == ":" and self.word(j - 1) == ")":
                return self.match.get(j - 1, -1)
            if w in (";", "{", "(", "=", ",") and self.level[j] <= self.level[i] and w != ",":
                return -1
            j = self.match.get(j, j) - 1 if w in _CLOSE else j - 1
        return -1

    def _type_start(self, j: int) -> int:
        depth = 0
        while j >= 0:
            w = self.word(j)
            depth += len(w) if w in (">", ">>") else -(w == "<")
            if depth <= 0:
                return j
            j -= 1
        return 0

    def _in_type(self, first: int, arrow: int) -> bool:
        """Whether ``( … ) =>`` is a function type: after a type's colon, in angle brackets or a type alias."""
        before = self.word(first - 1)
        if before in ("|", "&", "<", "new") and before != "&&":
            return True
        if before == ":":
            j = first - 2  # `name:` of an object literal is a value, of a parameter or declaration a type
            if self.word(j) in (")", "?", "]") and not (self.word(j) == "]" and self._in_object(j)):
                return True
            k = self.around[first]
            if k >= 0 and self.word(k) == "(":
                return not self._ternary(first)
            if k >= 0 and self.word(k) == "{":
                return not self._in_object(first)
            return self.word(j - 1) in ("const", "let", "var")
        if before == "=":
            k = first - 2
            while k >= 0 and self.word(k) not in (";", "{", "}", "type", "const", "let", "var", "=", ")"):
                k -= 1
            return self.word(k) == "type" and self.level[k] == self.level[first]
        return False

    def _ternary(self, i: int) -> bool:
        j = i - 2
        while j >= 0 and self.word(j) not in ("(", ";", "{"):
            if self.word(j) == "?" and self.word(j + 1) not in (":", ",", ")"):
                return True
            j = self.match.get(j, j) - 1 if self.word(j) in _CLOSE else j - 1
        return False

    def _in_object(self, i: int) -> bool:
        """Whether the brace around ``i`` opens an object literal, not a block, class or type."""
        k = self.around[i]
        if k < 0 or self.word(k) != "{":
            return False
        w = self.word(k - 1)
        if w in ("=", "(", ",", "[", "return", "?", "&&", "||", "??", "default", "...", "yield", "await", "as", "satisfies"):
            head = k - 1
            while w == "=" and head >= 0 and self.word(head) not in (";", "{", "}", "type", "const", "let", "var"):
                head -= 1
            return not (w == "=" and self.word(head) == "type")
        return w == ":" and self._in_object(k) or w == "=>" and False

    def _in_class(self, i: int) -> bool:
        k = self.around[i]
        if k < 0 or self.word(k) != "{":
            return False
        j = k - 1
        while j >= 0 and self.word(j) not in (";", "{", "}", "=>", "=", "("):
            if self.word(j) == "class" and not self._is_property(j):
                return True
            if self.word(j) == "interface":
                return False
            j = self.match.get(j, j) - 1 if self.word(j) in _CLOSE else j - 1
        return False

    def _method(self, i: int) -> dict | None:
        """A method, constructor or accessor whose parameters open at ``i``."""
        j = i - 1
        if self.word(j) in (">", ">>"):
            j = self._type_start(j) - 1
        j -= self.word(j) == "?"
        if j < 0:
            return None
        t = self.t[j]
        head = self.match.get(j, j) if t.text == "]" and t.kind == "sign" else j
        if t.kind not in ("name", "string", "number") and head == j or t.kind == "name" and t.text in _NOT_METHODS or self._is_property(j):
            return None
        first, accessor = head, False
        while self.word(first - 1) in _MODIFIERS or self.word(first - 1) == "*":
            first -= 1
            accessor = accessor or self.word(first) in ("get", "set")
        before = self.word(first - 1)
        in_class = self._in_class(first)
        if not in_class and not (before in ("{", ",") and self._in_object(first)):
            return None
        if in_class and before not in ("{", "}", ";", ")", "]") and not self._line_starts(first):
            return None
        body = self._body_after(self._after(i))
        if body < 0:
            return None
        return {"first": first, "params": self._params(i), "body": body, "last": self.match.get(body, len(self.t) - 1), "name": self.code(head, j)}

    def _name_before(self, first: int) -> str:
        """The name that what holds an unnamed function gives it."""
        b = self.word(first - 1)
        if b == "=":
            j = first - 2
            if self.t[j].kind == "name" and self.word(j - 1) != ":":
                return self._declares(j)
            k = j  # a type annotation stands between
            while k > 0 and self.word(k) not in (";", "const", "let", "var", "{", "}"):
                if self.word(k) == ":" and self.level[k] == self.level[first] and self.t[k - 1].kind == "name":
                    return self.t[k - 1].text
                k -= 1
            return "<anonymous>"
        if b == ":" and self._in_object(first):
            j = first - 2
            return self.code(self.match.get(j, j), j) if self.word(j) == "]" else self.t[j].text
        if b == "default" and self.word(first - 2) == "export":
            return "default"
        if b in ("(", ",") and self.around[first] >= 0 and self.word(self.around[first]) == "(":
            z = self.around[first] - 1
            if self.word(z) in (">", ">>"):
                z = self._type_start(z) - 1
            a = self._callee_start(z)
            if a is not None:
                return f"{self.code(a, z)}(...)"
        return "<anonymous>"

    def _declares(self, j: int) -> str:
        """The declared name at ``j``; an assignment to what exists names nothing."""
        k = j - 1
        while self.word(k) in _MODIFIERS:
            k -= 1
        declared = self.word(k) in ("const", "let", "var", ",") or self._in_class(j) and not self._is_property(j)
        return self.t[j].text if declared else "<anonymous>"

    def _callee_start(self, z: int) -> int | None:
        """The first token of the expression called at ``z + 1``."""
        a = z
        while a >= 0:
            t = self.t[a]
            if t.kind == "sign" and t.text in (")", "]"):
                a = self.match.get(a, 0)
                if self.t[a - 1].kind == "name" and self.word(a - 1) not in _NOT_METHODS or self.word(a - 1) in (")", "]"):
                    a -= 1
                    continue
            elif t.kind != "name" or t.text in _NOT_METHODS - {"super", "import"}:
                return None
            if self.word(a - 1) in (".", "?."):
                a -= 2
                continue
            return a
        return None

    def _measure(self, f: dict, found: list[dict]) -> tuple[int, int]:
        """Branches and nesting of a body, without the functions inside it."""
        inner = [g for g in found if g is not f and f["body"] <= g["first"] and g["last"] <= f["last"]]
        skip, complexity, nesting = -1, 1, 0
        starts = {}
        for g in inner:
            starts[g["first"]] = max(starts.get(g["first"], 0), g["last"])
        open_until: list[int] = []
        done = set()
        i = f["body"]
        while i <= f["last"]:
            if i in starts:
                i = starts[i] + 1
                continue
            t = self.t[i]
            if t.kind == "name" and t.text in _CONTROL and not self._is_property(i) and self.word(i + 1) != ":" and i not in done:
                complexity += 1
                open_until = [z for z in open_until if z >= i]
                end = self._after_catch(i) if t.text == "catch" else self.statement_end(i)
                if t.text == "do":
                    k = self.statement_end(i + 1) + 1
                    done.add(k)  # its while is no loop of its own
                open_until.append(end)
                nesting = max(nesting, len(open_until))
            elif t.kind == "name" and t.text == "case" and not self._is_property(i) and self.word(i + 1) != ":":
                complexity += 1
            elif t.kind == "sign" and t.text in ("&&", "||", "??"):
                complexity += 1
            elif t.kind == "sign" and t.text == "?" and self.word(i + 1) not in (":", ")", ",", ";", "=", "]", "}", "("):
                complexity += 1
            elif t.kind == "sign" and t.text == "?" and self.word(i + 1) == "(" and self._ternary(self._after(i + 1) + 1):
                complexity += 1
            i += 1
        return complexity, nesting

    def _after_catch(self, i: int) -> int:
        k = i + 1
        k = self._after(k) if self.word(k) == "(" else k
        return self.match.get(k, len(self.t) - 1)

    # imports and exports -------------------------------------------------------

    def _string(self, i: int) -> str | None:
        t = self.t[i] if i < len(self.t) else None
        if not t or t.kind != "string":
            return None
        return re.sub(r"\\(.)", r"\1", t.text[1:-1]) if "\\" in t.text else t.text[1:-1]

    def _names(self, i: int, place: int) -> tuple[list[str], bool]:
        """(names in the braces at ``i``, whether all are types); ``place``: 0 for the name before ``as``, -1 for the one after."""
        names, types, z = [], [], self.match.get(i, i)
        part: list[str] = []
        for j in range(i + 1, z + 1):
            w = self.t[j].text
            if j == z or w == ",":
                if part:
                    typed = part[0] == "type" and len(part) > 1 and part[1] != "as" or part[:2] == ["type", "as"] and len(part) == 4
                    own = [p for p in (part[1:] if typed else part)]
                    names.append(own[place].strip("'\"")), types.append(typed)
                part = []
            else:
                part.append(w)
        return names, bool(types) and all(types)

    def imports(self) -> list[dict]:
        out = []

        def add(raw: str, kind: str, i: int, type_only: bool = False, names: list[str] | None = None, wildcard: bool = False, computed: bool = False) -> None:
            out.append({"raw": raw, "kind": kind, "line": self.line(self.t[i].at), "type_only": type_only, "names": names or None, "wildcard": wildcard, "computed": computed})

        for m in self.heads:
            typed, named, single, double, _ = m.groups()
            names = [n.strip() for n in named.split(",")] if named else ["default"]
            out.append({"raw": double if single is None else single, "kind": "import", "line": self.line(m.start()), "type_only": bool(typed), "names": names, "wildcard": False, "computed": False})
        for i, t in self._sought("import", "export", "require"):
            if t.kind != "name" or self._is_property(i):
                continue
            if t.text == "import" and self.word(i + 1) not in ("(", "."):
                self._import(i, add)
            elif t.text == "export":
                j = i + 1 + (self.word(i + 1) == "type")
                typed = j > i + 1
                if self.word(j) == "{":
                    z = self.match.get(j, j)
                    if self.word(z + 1) == "from" and (raw := self._string(z + 2)) is not None:
                        add(raw, "export-from", i, typed, self._names(j, 0)[0])
                elif self.word(j) == "*":
                    z = j + (3 if self.word(j + 1) == "as" else 1)
                    if self.word(z) == "from" and (raw := self._string(z + 1)) is not None:
                        add(raw, "export-from", i, typed, wildcard=True)
            elif t.text in ("require", "import") and self.word(i + 1) == "(":
                raw, end = self._string(i + 2), self.match.get(i + 1, i + 1)
                if raw is not None and self.word(i + 3) in (")", ","):
                    add(raw, "dynamic" if t.text == "import" else "require", i, wildcard=True)
                elif t.text == "import" and end > i + 2:
                    add(self.code(i + 2, self.value_end(i + 2, ",")), "dynamic", i, computed=True)
        return out

    def _import(self, i: int, add) -> None:
        if (raw := self._string(i + 1)) is not None:
            return add(raw, "import", i, wildcard=True)
        j = i + 1
        typed = self.word(j) == "type" and (self.word(j + 1) in ("{", "*") or self.t[j + 1].kind == "name" and self.word(j + 1) != "from" or self.word(j + 2) == "from") if j + 1 < len(self.t) else False
        j += typed
        names, wildcard, all_types, only_named = [], False, False, True
        if j < len(self.t) and self.t[j].kind == "name" and self.word(j) != "from":
            names.append("default")
            only_named = False
            j += 1
            j += self.word(j) == ","
        if self.word(j) == "*":
            names, wildcard, only_named = [], True, False
            j += 3
        elif self.word(j) == "{":
            own, all_types = self._names(j, 0)
            names += own
            j = self._after(j)
        if self.word(j) == "from" and (raw := self._string(j + 1)) is not None:
            add(raw, "import", i, typed or all_types, names, wildcard)

    def exports(self) -> list[str]:
        names = []
        for i, t in self._sought("export"):
            if t.kind != "name" or self.level[i] or self._is_property(i):
                continue
            j = i + 1
            if self.word(j) == "type" and self.word(j + 1) == "{":
                j += 1
            if self.word(j) == "=":
                names.append("default")
            elif self.word(j) == "{":
                names += self._names(j, -1)[0]
            elif self.word(j) != "*":
                default = self.word(j) == "default"
                j += default
                while self.word(j) in ("async", "abstract", "declare") and self.t[j + 1].kind == "name":
                    j += 1
                w = self.word(j)
                if w in ("function", "class", "interface", "enum") or w == "type" and not default or w == "const" and self.word(j + 1) == "enum":
                    j += 1 + (self.word(j + 1) in ("*", "enum"))
                    if j < len(self.t) and self.t[j].kind == "name" and self.t[j].text not in ("extends", "implements"):
                        names.append(self.t[j].text)
                elif default:
                    names.append("default")
                elif w in ("const", "let", "var"):
                    names += self._variables(j + 1)
        return names

    def _variables(self, j: int) -> list[str]:
        names, end = [], self.value_end(j, ";")
        while j <= end:
            z = self.match.get(j, j) if self.word(j) in ("{", "[") else j
            names.append(self.code(j, z))
            j = z + 1
            angle = 0
            while j <= end and (self.word(j) != "," or angle > 0):
                w = self.word(j)
                angle += (w == "<") - (len(w) if w in (">", ">>") and angle else 0)
                j = self._after(j) if w in _OPEN else j + 1
            j += 1
        return names

    # markers and signals ---------------------------------------------------------

    def markers(self, typed: bool) -> list[dict]:
        out = []
        if typed:
            for i, t in self._sought("any", "as"):
                if t.kind != "name":
                    continue
                if t.text == "any" and self._is_any_type(i):
                    out.append({"kind": "any", "line": self.line(t.at), "text": None})
                elif t.text == "as" and i and not self._renames(i):
                    self._assertion(i, out)
        for at, text in self.comments:
            if m := _DIRECTIVE.match(text):
                kind = "eslint-disable" if m[1].startswith("eslint") else m[1]
                out.append({"kind": kind, "line": self.line(at), "text": text.strip()})
        return out

    def _is_any_type(self, i: int) -> bool:
        before, after = self.word(i - 1), self.word(i + 1)
        if before in (".", "?.") or after in (":", "(", ".", "=>", "?."):
            return False
        if before in (":", "<", "|", "&", "as", "=>", "extends", "is", "satisfies", "readonly", "keyof"):
            return before != ":" or not self._in_object(i)
        if before == "," and after in (">", ">>", "[", ","):
            return True
        if before == "=":
            k = i - 2
            while k >= 0 and self.word(k) not in (";", "{", "}", "type", "const", "let", "var"):
                k -= 1
            return self.word(k) == "type" or self._in_angles(i)
        return before in ("[", "(") and after in ("]", ")", ",") and self.word(i + 2) in ("[", ">", "|", "=>")

    def _in_angles(self, i: int) -> bool:
        return self.word(i + 1) in (">", ",")

    def _renames(self, i: int) -> bool:
        """Whether ``as`` gives an import or export another name."""
        if self.word(i - 1) == "*":
            return True
        k = self.around[i]
        return k >= 0 and self.word(k) == "{" and (self.word(k - 1) in ("import", "export", "type", ",") and not self._in_object(i))

    def _type_end(self, i: int) -> int:
        """The last token of the type at ``i``, of the plain forms."""
        while self.word(i) in ("readonly", "keyof", "typeof"):
            i += 1
        j = self.match.get(i, i) if self.word(i) in _OPEN else i
        while j + 1 < len(self.t):
            w = self.word(j + 1)
            if w == ".":
                j += 2
            elif w == "[":
                j = self.match.get(j + 1, j + 1)
            elif w == "<":
                j = self._past_types(j + 1) - 1
            elif w in ("|", "&"):
                j = self._type_end(j + 2)
            else:
                break
        return min(j, len(self.t) - 1)

    def _assertion(self, i: int, out: list[dict]) -> None:
        end = self._type_end(i + 1)
        if self.word(end + 1) == "as":  # an inner one of a chain
            return
        text = self.code(i + 1, end) if i + 1 < len(self.t) else ""
        chain, k = False, i
        while self.word(k - 1) == "unknown" and self.word(k - 2) == "as":
            chain, k = True, k - 2
        first = k - 1
        first = self.match.get(first, first) if self.word(first) in _CLOSE else first
        if text in ("any", "unknown") or chain:
            out.append({"kind": "unsafe-assertion", "line": self.line(self.t[max(first, 0)].at), "text": text})

    def env_reads(self) -> list[dict]:
        out: dict[str, int] = {}
        for i, t in self._sought("process"):
            if t.kind != "name" or self._is_property(i) or self.word(i + 1) != "." or self.word(i + 2) != "env":
                continue
            name = None
            if self.word(i + 3) in (".", "?.") and i + 4 < len(self.t) and self.t[i + 4].kind == "name":
                name = self.t[i + 4].text
            elif self.word(i + 3) == "[" and self.word(i + 5) == "]":
                k = self.t[i + 4]
                name = k.text[1:-1] if k.kind in ("string", "template") and len(k.text) > 1 else None
            if name is not None and name not in out and len(out) < MAX_ENV_READS:
                out[name] = self.line(t.at)
        return [{"name": k, "line": v} for k, v in out.items()]

    def effects_without_deps(self) -> list[int]:
        out = []
        for i, t in self._sought("useEffect", "useLayoutEffect"):
            if t.kind == "name" and not self._is_property(i):
                j = self._past_types(i + 1)
                if self.word(j) == "(" and self.word(i - 1) != "function" and self._params(j) == 1:
                    out.append(self.line(t.at))
        return out

    def directives(self) -> set[str]:
        """String literals that are statements of the file."""
        out = set()
        for i in self.strings:
            t = self.t[i]
            if self.level[i]:
                continue
            starts = i == 0 or self.word(i - 1) in (";", "}") or self.t[i - 1].kind == "string" and self._line_starts(i)
            ends = i + 1 == len(self.t) or self.word(i + 1) == ";" or "\n" in self.text[t.end : self.t[i + 1].at]
            if starts and ends:
                out.add(t.text[1:-1])
        return out


def path_literals(text: str) -> list[str]:
    """Quoted strings that name a file, without the prefixes tools put in front."""
    out: dict[str, None] = {}
    for m in _PATH_LITERAL.finditer(text):
        value = re.sub(r"^<[^>]+>/", "", m[1])
        out[re.sub(r"^/", "", re.sub(r"^\.{1,2}/", "", value))] = None
        if len(out) >= MAX_PATH_LITERALS:
            break
    return list(out)
