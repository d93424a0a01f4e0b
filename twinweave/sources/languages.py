"""The language registry: names, extensions, keywords and comment marks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    keywords: tuple[str, ...]
    line_comment: str = "//"
    block_comment: tuple[str, str] | None = ("/*", "*/")


# Extensions, keywords (a keyword's id is its place) and comment marks of each language.
_REGISTRY = (
    Language("Rust", ("rs",), tuple("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split())),
    Language("TypeScript", ("ts", "tsx"), tuple("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with as implements interface let package private protected public static yield any boolean constructor declare get module require number set string symbol type from of".split())),
    Language("JavaScript", ("js", "jsx", "cjs", "mjs"), tuple("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let await async null true false".split())),
    Language("Python", ("py",), tuple("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()), "#", None),
    Language("Go", ("go",), tuple("break default func interface select case defer go map struct chan else goto package switch const fallthrough if range type continue for import return var".split())),
    Language("Java", ("java",), tuple("abstract continue for new switch assert default goto package synchronized boolean do if private this break double implements protected throw byte else import public throws case enum instanceof return transient catch extends int short try char final interface static void class finally long strictfp volatile const float native super while null true false".split())),
    Language("C", ("c", "h"), tuple("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while".split())),
    Language("C++", ("cpp", "hpp", "cc", "hh", "cxx", "hxx"), tuple("alignas alignof and and_eq asm auto bitand bitor bool break case catch char char16_t char32_t class compl concept const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq".split())),
    Language("C#", ("cs",), tuple("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split())),
    Language("CSS", ("css", "scss", "sass", "less"), tuple("import media keyframes font-face page supports namespace".split())),
    Language("HTML", ("html", "htm"), (), "", ("<!--", "-->")),
    Language("JSON", ("json",), ("true", "false", "null")),
)

_languages: dict[str, Language] = {x.name: x for x in _REGISTRY}


def register_language(language: Language) -> None:
    """Add a language, or replace the one of its name, for sessions of this process."""
    _languages[language.name] = language


def languages() -> list[Language]:
    return list(_languages.values())


def language(name: str) -> Language:
    return _languages[name]


def extension_of(path: str) -> Column:
    """The last extension of a path's last component, in lower case; null if there is none."""
    name = F.element_at(F.split(F.regexp_replace(F.col(path), r"\\", "/"), "/"), -1)
    return F.nullif(F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1)), F.lit(""))


def language_of(path: str) -> Column:
    """The language of a path by its extension, the first of the registry that has it; null for other paths.

    The registry is small and fixed, so it is a literal map in the plan: no join, no shuffle.
    """
    pairs: dict[str, str] = {}
    for x in languages():
        for e in x.extensions:
            pairs.setdefault(e, x.name)
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv]), extension_of(path))


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    rows = [(x.name, list(x.extensions), list(x.keywords), x.line_comment, x.block_comment) for x in languages()]
    return spark.createDataFrame(rows, "name string, extensions array<string>, keywords array<string>, line_comment string, block_comment struct<open:string,close:string>")
