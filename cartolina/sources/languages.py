"""What the scanner knows of each language."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    name: str
    exts: tuple[str, ...]
    classes: dict[str, str] = field(default_factory=dict)  # keyword: kind of symbol
    containers: tuple[str, ...] = ()  # keywords whose block only lends its name to methods
    functions: tuple[str, ...] = ()  # keywords before a function's name
    typed: bool = False  # functions look like `type name(...) {`
    exported: str = "always"
    heritage: str = ""  # how bases are listed
    calls: bool = True
    comments: str = "c"
    blocks: str = "brace"


# The languages, their file extensions and what makes a symbol exported.
LANGUAGES = (
    Language("typescript", ("ts", "tsx", "js", "jsx", "mjs", "cjs"), {"class": "class", "interface": "interface", "enum": "enum"}, (), ("function",), False, "export", "words"),
    Language("python", ("py",), exported="plain", comments="hash", blocks="indent"),
    Language("go", ("go",), {"struct": "class", "interface": "interface"}, (), ("func",), False, "capital"),
    Language("java", ("java",), {"class": "class", "interface": "interface", "enum": "enum"}, (), (), True, "public", "words"),
    Language("ruby", ("rb",), {"class": "class", "module": "interface"}, (), ("def",), False, "always", "less", True, "hash", "end"),
    Language("c", ("c", "h"), {"struct": "class"}, (), (), True, "not static"),
    Language("cpp", ("cpp", "cc", "cxx", "hpp", "hh"), {"struct": "class", "class": "class"}, (), (), True, "not static", "colon"),
    Language("csharp", ("cs",), {"class": "class", "interface": "interface", "enum": "enum", "struct": "class", "record": "class"}, (), (), True, "public", "colon"),
    Language("php", ("php",), {"class": "class", "interface": "interface", "trait": "interface", "enum": "enum"}, (), ("function",), False, "not private", "words", True, "php"),
    Language("rust", ("rs",), {"struct": "class", "enum": "enum", "trait": "interface"}, ("impl",), ("fn",), False, "pub"),
    Language("kotlin", ("kt", "kts"), {"class": "class", "object": "class", "interface": "class"}, (), ("fun",), False, "not private", "colon"),
    Language("swift", ("swift",), {"class": "class", "struct": "class", "enum": "class", "protocol": "interface"}, (), ("func",), False, "not private", "colon", False),
    Language("dart", ("dart",), {"class": "class"}, (), (), True, "plain", "words", False),
    Language("scala", ("scala",), {"class": "class", "object": "class", "trait": "interface"}, (), ("def",), False, "not private", "words", False),
    Language("lua", ("lua",), {}, (), ("function",), False, "not local", "", True, "dash", "end"),
    Language("bash", ("sh", "bash"), {}, (), ("function",), False, "always", "", False, "hash"),
    Language("elixir", ("ex", "exs"), {"defmodule": "class"}, (), ("def", "defp"), False, "def", "", True, "hash", "end"),
    Language("objc", ("m", "mm"), {"@interface": "class"}, ("@implementation",), (), True, "always", "colon", False),
    Language("ocaml", ("ml", "mli"), {}, (), (), False, "plain", "", False, "star", "line"),
    Language("zig", ("zig",), {}, (), ("fn",), False, "pub", "", False),
)

BY_EXT = {e: lang for lang in LANGUAGES for e in lang.exts}
ORDER = {lang.name: i for i, lang in enumerate(LANGUAGES)}

#: Reserved words by language: never the name of a declaration or of a call.
_C = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short"
    " signed sizeof static struct switch typedef union unsigned void volatile while"
)
_CPP = (
    f"{_C} alignas alignof and bool catch class co_await co_return co_yield constexpr decltype delete explicit export false friend mutable"
    " namespace new noexcept not nullptr operator or private protected public static_assert template this throw true try typeid typename using virtual"
)
_RESERVED = {
    "typescript": "as async await break case catch class const continue debugger default delete do else enum export extends false finally for function if"
    " implements import in instanceof interface let new null package private protected public return static super switch this throw true try typeof var void while with yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import"
    " instanceof int interface long native new null package private protected public return short static super switch synchronized this throw throws true try false void while",
    "ruby": "alias and begin break case class def do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true"
    " undef unless until when while yield",
    "c": _C,
    "cpp": _CPP,
    "objc": f"{_CPP} self super nil",
    "csharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false"
    " finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected"
    " public readonly ref return sbyte sealed short sizeof static string struct switch this throw true try typeof uint ulong unsafe ushort using virtual void while await",
    "php": "abstract and array as break case catch class clone const continue declare default do echo else elseif empty enum exit extends false final finally fn for foreach"
    " function global goto if implements include include_once instanceof interface isset list match namespace new null or print private protected public require"
    " require_once return static switch throw trait true try unset use var while xor yield",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct"
    " super trait true type unsafe use where while",
    "kotlin": "as break catch class continue do else false finally for fun if import in interface is null object package return super this throw true try typealias val var when while",
    "swift": "as break case catch class continue default defer deinit do else enum extension false fileprivate for func guard if import in init internal is let nil private"
    " protocol public repeat return self Self static struct super switch throw throws true try typealias var where while",
    "dart": "assert await break case catch class const continue default do else enum extends false final finally for if import in is new null rethrow return super switch"
    " this throw true try var void while with",
    "scala": "abstract case catch class def do else extends false final finally for if implicit import lazy match new null object override package private protected"
    " return sealed super this throw trait true try type val var while with yield",
    "lua": "and break do else elseif end false for function goto if in local nil not or repeat return then true until while",
    "bash": "if then else elif fi case esac for select while until do done in function time",
    "elixir": "after and catch do else end false fn in nil not or rescue true when def defp defmodule defmacro defstruct alias import use require",
    "ocaml": "and as assert begin class constraint do done downto else end exception external false for fun function functor if in include inherit initializer lazy let"
    " match method module mutable new nonrec object of open or private rec sig struct then to true try type val virtual when while with",
    "zig": "align and anytype asm break callconv catch comptime const continue defer else enum errdefer error export extern fn for if inline noalias opaque or orelse"
    " packed pub resume return struct suspend switch test threadlocal try union unreachable usingnamespace var volatile while",
}
KEYWORDS = {lang.name: frozenset(_RESERVED.get(lang.name, "").split()) for lang in LANGUAGES}

#: Languages whose ' holds one character, so that a lifetime, a label or a type variable opens nothing.
CHARACTERS = frozenset(("c", "cpp", "objc", "java", "csharp", "go", "rust", "kotlin", "scala", "swift", "ocaml", "zig"))
#: Languages whose ` is no string: it quotes a name there, or is not used.
NAME_TICKS = frozenset(("kotlin", "scala", "swift", "java", "c", "cpp", "objc", "csharp", "rust", "ocaml", "zig", "lua", "dart", "elixir"))
