"""From one file's text to rows: a module, its symbols, raw calls, heritage, imports with candidates, and identifier counts.

Python is read with its own parser. The other languages share one scanner: comments and strings are dropped, and the tokens
that are left are walked with a stack of blocks. It knows declarations by their keywords and shapes, not by a grammar.
"""

from __future__ import annotations

import ast
import io
import keyword
import posixpath
import re
import tokenize
from collections import Counter
from dataclasses import dataclass, field

from cartolina.sources.languages import BY_EXT, CHARACTERS, KEYWORDS, LANGUAGES, NAME_TICKS, Language

_COMMENTS = {
    "c": r"//[^\n]*|/\*.*?\*/",
    "php": r"//[^\n]*|\#[^\n]*|/\*.*?\*/",
    "hash": r"\#[^\n]*",
    "dash": r"--\[\[.*?\]\]|--[^\n]*",
    "star": r"\(\*.*?\*\)",
}
_DOUBLE = r'"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_CHARACTER = r"'(?:\\(?:u\{?[0-9A-Fa-f]+\}?|x[0-9A-Fa-f]+|[0-7]{1,3}|.)|[^'\\\n])'"
_TICKED = r"`(?:\\.|[^`\\])*`"


def _strings(name: str) -> str:
    ticks = "" if name in NAME_TICKS or name == "typescript" else f"|{_TICKED}"
    return f"{_DOUBLE}|{_CHARACTER if name in CHARACTERS else _SINGLE}{ticks}"


_TOKEN = {
    lang.name: re.compile(rf"(?P<skip>{_COMMENTS[lang.comments]})|(?P<str>{_strings(lang.name)})|(?P<id>[@$]?[A-Za-z_][A-Za-z0-9_]*[?!]?)|(?P<op>=>|->|::|[^\s\w])", re.S)
    for lang in LANGUAGES
    if lang.comments in _COMMENTS
}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: After these a slash begins a regular expression, not a division.
_BEFORE_REGEX = frozenset(("", "(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "return", "typeof", "case", "in", "of"))
_STUBS = {"typescript": ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")}


@dataclass
class Parsed:
    """symbols: (name, kind, line, exported, parent); calls: (symbol or None, callee); bases: (symbol, base, kind); imports: (spec, candidates (how, path))."""

    symbols: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    bases: list = field(default_factory=list)
    imports: dict = field(default_factory=dict)
    idents: Counter = field(default_factory=Counter)


def parse(rel: str, text: str, go_module: str | None = None) -> Parsed:
    """What a file declares. A file that can't be read as its language gives nothing but its module row, which the caller makes."""
    lang = BY_EXT[rel.rsplit(".", 1)[-1]]
    if lang.name == "python":
        return _python(rel, text)
    out = Parsed()
    if lang.blocks == "line":
        _ocaml(text, out)
    else:
        _Scanner(lang, text, out).run()
    _imports(lang, rel, text, out, go_module)
    return out


def _python(rel: str, text: str) -> Parsed:
    out = Parsed()
    tree = ast.parse(text)
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.NAME and not keyword.iskeyword(t.string):
            out.idents[t.string] += 1
    here = posixpath.dirname(rel)

    def offer(spec: str, base: str, dotted: str) -> None:
        path = posixpath.join(base, dotted.replace(".", "/")) if dotted else base
        out.imports.setdefault(spec, [("rel", f"{path}.py"), ("rel", posixpath.join(path, "__init__.py"))])

    def visit(node: ast.AST, owner: str | None, cls: str | None, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            now, in_cls, in_fn = owner, cls, inside
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef) and not inside:
                now = f"{cls}.{child.name}" if cls else child.name
                out.symbols.append((now, "method" if cls else "function", child.lineno, not child.name.startswith("_"), cls))
                in_fn, in_cls = True, None
            elif isinstance(child, ast.ClassDef):
                now = in_cls = child.name
                in_fn = False
                out.symbols.append((child.name, "class", child.lineno, not child.name.startswith("_"), None))
                out.bases += [(child.name, b.id, "extends") for b in child.bases if isinstance(b, ast.Name) and b.id != child.name]
            elif isinstance(child, ast.Call):
                callee = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if callee:
                    out.calls.append((owner, callee))
            elif isinstance(child, ast.Import):
                for a in child.names:
                    offer(a.name, "", a.name)
            elif isinstance(child, ast.ImportFrom):
                base = here
                for _ in range(child.level - 1):
                    base = posixpath.dirname(base)
                offer("." * child.level + (child.module or ""), base if child.level else "", child.module or "")
            visit(child, now, in_cls, in_fn)

    visit(tree, None, None, False)
    return out


class _Scanner:
    def __init__(self, lang: Language, text: str, out: Parsed):
        self.lang, self.out, self.text, self.keywords = lang, out, text, KEYWORDS[lang.name]
        self.tokens: list[tuple[str, int]] = []
        self.places: list[tuple[int, int]] = []  # where each token stands in the text
        self._line, self._at = 1, 0
        self._tokenise(0, len(text))
        self.closing = self._brackets()
        #: Open blocks: what opened it, the symbol that owns it, its class.
        self.stack: list[tuple[str, str | None, str | None]] = []
        #: Expressions that are a function's whole body: where they end, and the function.
        self.bodies: list[tuple[int, str]] = []

    def _put(self, word: str, start: int, end: int) -> None:
        self._line += self.text.count("\n", self._at, start)
        self._at = start
        self.tokens.append((word, self._line))
        self.places.append((start, end))

    def _tokenise(self, at: int, end: int) -> None:
        token, script = _TOKEN[self.lang.name], self.lang.name == "typescript"
        while at < end:
            m = token.search(self.text, at, end)
            if not m:
                return
            at = m.end()
            if m.lastgroup == "str":
                self._put("''", m.start(), at)
            elif script and m[0] == "`":
                at = self._template(m.start(), end)
            elif script and m[0] == "/" and (self.tokens[-1][0] if self.tokens else "") in _BEFORE_REGEX and (r := _REGEX.match(self.text, m.start(), end)):
                at = r.end()
                self._put("''", m.start(), at)
            elif m.lastgroup in ("id", "op"):
                self._put(m[0], m.start(), at)

    def _template(self, start: int, end: int) -> int:
        """A template string: a string with what its ${} hold in brackets after it; where it ends."""
        self._put("''", start, start + 1)
        at = start + 1
        while at < end and self.text[at] != "`":
            if self.text[at] == "\\":
                at += 2
            elif self.text.startswith("${", at):
                close = self._hole(at + 2, end)
                self._put("[", at, at + 2)
                self._tokenise(at + 2, close)
                self._put("]", close, close + 1)
                at = close + 1
            else:
                at += 1
        return min(at + 1, end)

    def _hole(self, at: int, end: int) -> int:
        """Where the bracket closes that opened a template string's expression; strings and templates within are passed over."""
        depth = 0
        while at < end:
            c = self.text[at]
            if c in "\"'":
                m = re.compile(f"{_DOUBLE}|{_SINGLE}").match(self.text, at, end)
                at = m.end() if m else at + 1
                continue
            if c == "`":
                at += 1
                while at < end and self.text[at] != "`":
                    at = self._hole(at + 2, end) + 1 if self.text.startswith("${", at) else at + 1 + (self.text[at] == "\\")
            elif c == "}" and depth == 0:
                return at
            depth += (c == "{") - (c == "}")
            at += 1
        return end

    def _brackets(self) -> dict[int, int]:
        """The place of each bracket's counterpart."""
        out, open_at = {}, {")": [], "]": [], "}": []}
        pairs = {"(": ")", "[": "]", "{": "}"}
        for i, (w, _) in enumerate(self.tokens):
            if w in pairs:
                open_at[pairs[w]].append(i)
            elif w in open_at and open_at[w]:
                out[open_at[w].pop()] = i
        return out

    def word(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def line(self, i: int) -> int:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else 1 << 30

    def is_name(self, i: int) -> bool:
        w = self.word(i)
        return bool(w) and (w[0].isalpha() or w[0] in "_$") and w not in self.keywords

    def close(self, i: int) -> int:
        """The place of the bracket that closes the one at i."""
        if self.word(i) != "<":
            return self.closing.get(i, len(self.tokens) - 1)
        depth = 0
        for j in range(i, len(self.tokens)):
            depth += (self.word(j) == "<") - (self.word(j) == ">")
            if depth == 0:
                return j
        return len(self.tokens) - 1

    def statement(self, i: int) -> list[str]:
        """The words that stand before i in its statement."""
        out, j = [], i - 1
        while j >= 0 and self.word(j) not in ("{", "}", ";") and (self.lang.blocks == "brace" and self.lang.name not in ("kotlin", "swift", "scala", "go") or self.line(j) == self.line(i)):
            out.append(self.word(j))
            j -= 1
        return out

    def exported(self, name: str, before: list[str]) -> bool:
        rule = self.lang.exported
        return {"always": True, "export": "export" in before, "public": "public" in before, "plain": not name.startswith("_"), "capital": name[:1].isupper(), "not static": "static" not in before, "not private": not {"private", "fileprivate", "internal"} & set(before), "pub": "pub" in before, "not local": "local" not in before, "def": True}[rule]

    @property
    def inside(self) -> bool:
        return any(kind == "function" for kind, _, _ in self.stack)

    def owner(self, i: int) -> str | None:
        while self.bodies and self.bodies[-1][0] <= i:
            self.bodies.pop()
        return self.bodies[-1][1] if self.bodies else next((o for _, o, _ in reversed(self.stack) if o), None)

    @property
    def cls(self) -> str | None:
        return self.stack[-1][2] if self.stack else None

    def add(self, name: str, kind: str, i: int, exported: bool, parent: str | None) -> None:
        self.out.symbols.append((name, kind, self.line(i), exported, parent))

    def run(self) -> None:
        for w, _ in self.tokens:
            if (w[0].isalpha() or w[0] in "_$") and w not in self.keywords:
                self.out.idents[w.lstrip("$")] += 1
        ends = self.lang.blocks == "end"
        pending: tuple[str, str | None, str | None] | None = None
        i = 0
        while i < len(self.tokens):
            w = self.word(i)
            found = self.declaration(i)
            if found:
                pending, i = found
                if ends and pending is not None:
                    self.stack.append(pending)
                    pending = None
                continue
            if not ends:
                if w == "{":
                    self.stack.append(pending or ("block", None, self.cls if self.stack and self.stack[-1][0] != "function" else None))
                    pending = None
                elif w == "}" and self.stack:
                    self.stack.pop()
                elif w == ";" or w == "@end":
                    pending = None
                    if w == "@end" and self.stack:
                        self.stack.clear()
            elif w == "end" and self.stack:
                self.stack.pop()
            elif self.opens(i):
                self.stack.append(("block", None, self.cls))
            if self.lang.calls and self.is_call(i):
                self.out.calls.append((self.owner(i), w.lstrip("$")))
            i += 1

    def is_call(self, i: int) -> bool:
        if not self.is_name(i) or self.word(i) in ("require", "require_relative"):
            return False
        script = self.lang.name == "typescript"
        if script and self.word(i - 1) == "new" and self.word(i + 1) not in ("(", "<", ".", "["):
            return True  # new without arguments
        if self.word(i + 1) != "(":
            return False
        if self.stack and self.stack[-1][0] == "class" and not (script and self.word(i - 1) in ("=", "new", ".", "(", ",", "=>", "&", "|", "?", ":", "[", "!", "await")):
            return False
        # In an object a name with parameters and a body is a method.
        close = self.close(i + 1)
        return not (script and self.word(close + 1) == "{" and self.line(close) == self.line(close + 1) and self.word(i - 1) in ("{", ",", "async", "get", "set", "*"))

    def opens(self, i: int) -> bool:
        """Whether a word opens a block that `end` closes, beside declarations."""
        w, first = self.word(i), i == 0 or self.line(i - 1) != self.line(i)
        if self.lang.name == "ruby":
            return w == "do" or w in ("if", "unless", "while", "until", "case", "begin", "for") and first
        if self.lang.name == "lua":
            return w in ("do", "if", "repeat") or w == "function"
        return w in ("do", "fn")

    def declaration(self, i: int) -> tuple[tuple | None, int] | None:
        """The block that a declaration at i opens and where to go on, or None."""
        w, lang = self.word(i), self.lang
        if lang.name == "go" and w == "type" and self.word(i + 2) in lang.classes:
            name = self.word(i + 1)
            self.add(name, lang.classes[self.word(i + 2)], i, self.exported(name, []), None)
            return ("class", name, name), i + 3
        if w in lang.containers:
            j = self.close(i + 1) + 1 if self.word(i + 1) == "<" else i + 1
            head = []
            while j < len(self.tokens) and self.word(j) != "{" and not (lang.name == "objc" and self.line(j) != self.line(i)):
                head.append(self.word(j))
                j += 1
            name = head[head.index("for") + 1] if "for" in head[:-1] else head[0] if head else None
            if lang.name == "objc":
                self.stack.append(("class", name, name))
                return None, j
            return ("class", None, name), j
        if w in lang.classes and lang.name != "go" and self.word(i - 1) not in (".", "::") and (self.is_name(i + 1)):
            return self.a_class(i)
        if w in lang.functions:
            return self.a_function(i)
        if lang.name == "bash" and self.is_name(i) and self.word(i + 1) == "(" and self.word(i + 2) == ")" and not self.inside:
            self.add(w, "function", i, True, None)
            return ("function", w, None), i + 3
        if lang.name == "typescript":
            return self.a_script(i)
        if lang.typed and not self.inside:
            return self.a_typed(i)
        return None

    def a_class(self, i: int) -> tuple[tuple | None, int] | None:
        lang, name, j = self.lang, self.word(i + 1), i + 2
        while lang.name == "elixir" and self.word(j) == ".":
            name, j = f"{name}.{self.word(j + 1)}", j + 2
        head, start = [], j
        while j < len(self.tokens) and self.word(j) not in ("{", ";", "}"):
            if lang.blocks == "end" and (self.line(j) != self.line(i) or self.word(j) == "do"):
                break
            if lang.name in ("kotlin", "scala", "swift", "objc") and self.line(j) != self.line(j - 1) and self.word(j - 1) not in (",", ":", "(", "extends", "with") and self.word(j) not in (":", "extends", "with", ")"):
                break
            if self.word(j) in "([<" and self.word(j) != "<" or self.word(j) == "<" and lang.heritage != "less":
                j = self.close(j) + 1
                continue
            head.append(self.word(j))
            j += 1
        body = self.word(j) == "{" or lang.blocks == "end" or lang.name in ("kotlin", "scala", "objc")
        if not body and lang.name in ("c", "cpp", "rust") and not (lang.name == "rust" and self.word(j) == ";"):
            return None
        if lang.name in ("c", "cpp") and self.word(j) != "{":
            return None
        before = self.statement(i)
        self.add(name, lang.classes[self.word(i)], i, self.exported(name, before), None)
        if lang.name == "typescript":
            if self.word(i) == "class":
                self.bases(name, start, j)
            head = []
        kind, fresh = "extends", False
        for h in head:
            if h in ("extends", "with", ":", "<", "implements"):
                fresh = lang.heritage == "words" and h in ("extends", "implements", "with") or lang.heritage == "colon" and h == ":" or lang.heritage == "less" and h == "<"
            elif h == ",":
                continue
            elif fresh and (h[0].isalpha() or h[0] == "_") and h not in self.keywords and h != name:
                self.out.bases.append((name, h, kind))
        if lang.name == "objc":
            self.stack.append(("class", name, name))
            return None, j
        if lang.blocks == "end" and self.word(j) == "do":
            j += 1
        return (("class", name, name) if self.word(j) == "{" or lang.blocks == "end" else None), j

    def bases(self, name: str, start: int, end: int) -> None:
        """TypeScript: what a class extends and implements, as it is written but for type arguments."""
        kind, first, last, j = None, None, None, start

        def put() -> None:
            if kind and first is not None:
                self.out.bases.append((name, self.text[self.places[first][0] : self.places[last][1]], kind))

        while j < end:
            w = self.word(j)
            if w in ("extends", "implements", ","):
                put()
                kind, first = kind if w == "," else w, None
            elif w == "<":
                j = self.close(j)
            elif kind:
                first = j if first is None else first
                j = last = self.close(j) if w in ("(", "[") else j
            j += 1
        put()

    def a_function(self, i: int) -> tuple[tuple | None, int] | None:
        lang, j, cls = self.lang, i + 1, self.cls
        before = self.statement(i)
        if lang.name == "go" and self.word(j) == "(":
            end = self.close(j)
            names = [self.word(k) for k in range(j + 1, end) if self.is_name(k)]
            cls, j = (names[-1] if names else None), end + 1
        if lang.name == "ruby" and self.word(j) == "self" and self.word(j + 1) == ".":
            j += 2
        if not re.match(r"[A-Za-z_$]", self.word(j)):  # after the keyword even a word that other languages keep is a name
            return (("block", None, cls), i + 1) if lang.name == "lua" else None
        name, j = self.word(j), j + 1
        while lang.name == "lua" and self.word(j) in (".", ":"):
            name, j = self.word(j + 1), j + 2
        if lang.name == "kotlin" and self.word(j) == ".":
            name, j = self.word(j + 1), j + 2
        nested = self.inside and lang.name != "typescript"
        if nested and lang.blocks == "end":
            return ("block", None, None), j
        shown = self.exported(name, before) if lang.exported != "def" else self.word(i) == "def"
        full = f"{cls}.{name}" if cls else name
        if lang.name == "typescript":
            full, cls = name, None
        if not nested:  # of functions within others the inner ones are no symbols, and what they call is the outer one's
            self.add(full, "method" if cls else "function", i, shown, cls)
        if self.word(j) == "<":
            j = self.close(j) + 1
        if self.word(j) == "(":
            j = self.close(j) + 1
        if lang.blocks == "end":
            if lang.name == "elixir":
                while j < len(self.tokens) and self.word(j) != "do" and self.line(j) == self.line(i):
                    j += 1
                if self.word(j) != "do" or self.word(j + 1) == ":":
                    return None, j  # a one-line body
                j += 1
            elif lang.name == "ruby" and self.word(j) == "=":
                return None, j  # a body without end
            return ("function", full, None), j
        while j < len(self.tokens) and self.word(j) not in ("{", ";", "}") and not (self.word(j) == "=" and lang.name in ("kotlin", "scala")) and not (lang.name in ("swift", "scala", "kotlin", "go") and self.line(j) != self.line(j - 1)):
            j += 1
        if self.word(j) != "{":
            return None, j
        return ("block", None, None) if nested else ("function", full, None), j

    def body_end(self, i: int) -> int:
        """Where an expression that begins at i ends."""
        joins = ("(", "[", "{", ".", "?", ":", "&", "|", "+", "-", "*", "/", "=", ",", "=>", "<", ">", "!")
        j = i
        while j < len(self.tokens):
            w = self.word(j)
            if w in (")", "]", "}", ";", ",") or j > i and self.line(j) != self.line(j - 1) and w not in joins and self.word(j - 1) not in joins:
                return j
            j = self.close(j) + 1 if w in ("(", "[", "{") else j + 1
        return j

    def a_script(self, i: int) -> tuple[tuple | None, int] | None:
        """TypeScript and JavaScript: aliases, functions held by variables, methods."""
        w = self.word(i)
        if w == "type" and self.is_name(i + 1) and self.word(i + 2) in ("=", "<") and self.word(i - 1) not in (".", ","):
            self.add(self.word(i + 1), "type", i, self.word(i - 1) == "export", None)
            return None, i + 2
        if w in ("const", "let", "var") and self.is_name(i + 1):
            name, j = self.word(i + 1), i + 2
            while j < len(self.tokens) and self.word(j) not in ("=", ";", "{", "=>"):
                j = self.close(j) + 1 if self.word(j) in ("(", "[") else j + 1
            j += 1
            j += self.word(j) == "async"
            arrow = j
            if self.word(j) == "<":
                arrow = self.close(j) + 1
            if self.word(arrow) == "(":
                arrow = self.close(arrow) + 1
                while self.word(arrow) not in ("=>", ";", "{", ",", ")", "") and self.line(arrow) == self.line(arrow - 1):
                    arrow += 1
            elif self.is_name(arrow):
                arrow += 1
            if self.word(j - 1) in ("=", "async") and (self.word(j) == "function" or self.word(arrow) == "=>"):
                self.add(name, "function", i, "export" in self.statement(i), None)
                if self.word(j) == "function":
                    return ("function", name, None), self.close(j + 1) + 1 if self.word(j + 1) == "(" else j + 2
                if self.word(arrow + 1) != "{":
                    self.bodies.append((self.body_end(arrow + 1), name))
                    return None, arrow + 1
                return ("function", name, None), arrow + 1
            return None
        at_class = self.stack and self.stack[-1][0] == "class"
        if at_class and self.is_name(i) and self.word(i + 1) in ("(", "<") and self.word(i - 1) not in (".", "new", "=", "(", ",", "=>", "&", "|", "?", ":", "[", "!", "await", "@"):
            j = self.close(i + 1) + 1 if self.word(i + 1) == "<" else i + 1
            j = self.close(j) + 1
            while j < len(self.tokens) and self.word(j) not in (";", "}", "=") and (self.word(j) != "{" or self.word(j - 1) in (":", "|", "&", "<", ",")):
                if self.word(j) not in ("{", "(", "[", ":", "<", "|", "&", ",", ">") and self.line(j) != self.line(j - 1) and self.word(j - 1) not in (":", "|", "&", "<", ","):
                    break  # a signature without body that ends with its line
                j = self.close(j) + 1 if self.word(j) in ("{", "(", "[") else j + 1
            if w == "constructor" or self.word(i - 1) in ("get", "set"):
                return (("block", None, None), j) if self.word(j) == "{" else (None, j)
            full = f"{self.cls}.{w}"
            self.add(full, "method", i, False, self.cls)
            return (("function", full, None) if self.word(j) == "{" else None), j
        return None

    def a_typed(self, i: int) -> tuple[tuple | None, int] | None:
        """Functions without a keyword: a name, its parameters and a body, or in a class only their end."""
        lang = self.lang
        if lang.name == "objc" and self.word(i) in "-+" and self.word(i + 1) == "(":
            j = self.close(i + 1) + 1
            name = self.word(j)
            while j < len(self.tokens) and self.word(j) not in ("{", ";"):
                j += 1
            if self.word(j) != "{":
                return None, j
            full = f"{self.cls}.{name}" if self.cls else name
            self.add(full, "method" if self.cls else "function", i, True, self.cls)
            return ("function", full, None), j
        if not self.is_name(i) or self.word(i + 1) != "(" or self.word(i - 1) in (".", "->", "new", "=", "return", "(", ",", "@", "!", "&&", "#"):
            return None
        before = self.statement(i)
        name, cls = self.word(i), self.cls
        if self.word(i - 1) == "::" and lang.name == "cpp":
            cls = self.word(i - 2)
        ctor = cls == name
        if not before and not ctor and not cls or name.startswith("@"):
            return None
        j = self.close(i + 1) + 1
        while self.word(j) not in ("{", ";", "}", "=>", "=", ""):
            j = self.close(j) + 1 if self.word(j) in ("(", "[") else j + 1
        if self.word(j) != "{" and not (self.word(j) in ("=>", ";") and cls and before and lang.name in ("java", "csharp", "dart")):
            return None
        full = f"{cls}.{name}" if cls else name
        self.add(full, "method" if cls else "function", i, self.exported(name, before), cls)
        return (("function", full, None) if self.word(j) == "{" else None), j


def _ocaml(text: str, out: Parsed) -> None:
    bare = re.sub(_COMMENTS["star"] + "|" + _strings("ocaml"), lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    for n, row in enumerate(bare.split("\n"), 1):
        m = re.match(r"\s*(let|and|type|val)\s+(?:rec\s+)?([a-z_][\w']*)([^=\n]*)", row)
        if m and not row[:1].isspace():
            kind = "type" if m[1] == "type" else "function" if m[3].split(":")[0].strip() or m[1] == "val" and "->" in m[3] else "variable"
            out.symbols.append((m[2], kind, n, not m[2].startswith("_"), None))
    out.idents.update(w for w in re.findall(r"[A-Za-z_][\w']*", bare) if w not in KEYWORDS["ocaml"])


_SPECS = {
    "typescript": r"""(?m)^\s*import\s+(?:[^'";]*?\bfrom\s+)?['"]([^'"]+)['"]""",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;",
    "ruby": r"""(?m)^\s*(require|require_relative)\s*\(?\s*['"]([^'"]+)['"]""",
    "c": r'(?m)^\s*#\s*(?:include|import)\s*("[^"]+"|<[^>]+>)',
    "csharp": r"(?m)^\s*using\s+([\w.]+)\s*;",
    "php": r"""\b(?:include|require)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?['"]/?([^'"]+)['"]""",
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)",
    "kotlin": r"(?m)^\s*import\s+([\w.]+)",
    "swift": r"(?m)^\s*import\s+(\w+)",
    "dart": r"""(?m)^\s*import\s+['"]([^'"]+)['"]""",
    "scala": r"(?m)^\s*import\s+([\w.]+)",
    "lua": r"""\brequire\s*\(?\s*['"]([^'"]+)['"]""",
    "bash": r"""(?m)^\s*(?:source|\.)\s+['"]?([^\s'";]+)""",
    "elixir": r"(?m)^\s*(?:alias|import|use)\s+([\w.]+)",
    "ocaml": r"(?m)^\s*open\s+([\w.]+)",
    "zig": r'@import\("([^"]+)"\)',
    "go": r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\s]+)"\s*$',
}
_SPECS |= {"cpp": _SPECS["c"], "objc": _SPECS["c"]}


def _imports(lang: Language, rel: str, text: str, out: Parsed, go_module: str | None) -> None:
    """Each import's spec with its candidates in order: rel (a path), suffix (a path's end), folder (its first file), base (the one file of that name)."""
    here = posixpath.dirname(rel)
    bare = re.sub(_COMMENTS[lang.comments], lambda m: "" if m[0][:1] != "#" or lang.name not in ("c", "cpp", "objc") else m[0], text, flags=re.S) if lang.comments != "hash" and lang.name not in ("php", "dart", "typescript", "go") else text
    if lang.name == "go":
        blocks = re.findall(r"(?s)\bimport\s*\((.*?)\)", text) + re.findall(r'(?m)^import\s+(?:[\w.]+\s+)?"[^"]+"', text)
        bare = "\n".join(blocks)
    near = lambda path, exts: [("rel", posixpath.normpath(posixpath.join(base, path + e))) for base in (here, "") for e in exts] + [("base", posixpath.basename(path) + exts[-1])]
    for m in re.finditer(_SPECS.get(lang.name, r"(?!)"), bare):
        spec, options = m[m.lastindex], []
        if lang.name == "typescript":
            if spec.startswith("."):
                path = posixpath.normpath(posixpath.join(here, spec))
                options = [("rel", path + e) for e in _STUBS["typescript"]] + [("rel", path[:-3] + ".ts")] * path.endswith(".js") + [("rel", path[:-4] + ".tsx")] * path.endswith(".jsx")
                options = [o for o in options if o[1].rsplit(".", 1)[-1] in lang.exts]
        elif lang.name == "java":
            options = [("suffix", spec.replace(".", "/") + ".java")]
        elif lang.name == "go" and go_module and (spec == go_module or spec.startswith(go_module + "/")):
            options = [("folder", spec[len(go_module) + 1 :] or ".")]
        elif lang.name == "ruby":
            options = [("rel", posixpath.normpath(posixpath.join(here, spec + ".rb")))] if m[1] == "require_relative" else [("rel", f"lib/{spec}.rb"), ("rel", f"{spec}.rb")]
        elif lang.name in ("c", "cpp", "objc"):
            quoted, spec = spec[0] == '"', spec[1:-1]
            options = near(spec, ("",)) if quoted else []
        elif lang.name == "php":
            options = near(re.sub(r"\.php$", "", spec), (".php",))
        elif lang.name == "dart":
            if spec.startswith(("package:", "dart:")):
                continue
            options = near(spec, ("",))
        elif lang.name == "lua":
            options = near(spec.replace(".", "/"), ("/init.lua", ".lua"))
        elif lang.name == "bash":
            spec = re.sub(r"^\$\(?\{?[^/]*/", "", spec)
            options = near(re.sub(r"\.sh$", "", spec), (".sh",))
        elif lang.name == "zig":
            if not spec.endswith(".zig"):
                continue
            options = near(spec, ("",))
        out.imports.setdefault(spec, options)
