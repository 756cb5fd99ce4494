"""Syntax checks for source files: one lexer, and push-down checks with statement and expression rules for each language.

The check is stricter than bracket matching (statement heads, operand adjacency, dangling operators, block ends) and
accepts any text that a full parser accepts in the common subset of each language. Python uses the standard parser.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from collections.abc import Iterator
from itertools import islice

from loomcode.llm import grammar

# Reserved and contextual words, file extensions.
KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while var record sealed permits yield non true false null",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool bool size_t ssize_t uint8_t uint16_t uint32_t uint64_t int8_t int16_t int32_t int64_t",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while macro_rules union",
    "javascript": "as async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new null of return set static super switch this throw try typeof undefined var void while with yield true false",
    "typescript": "as async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new null of return set static super switch this throw try typeof undefined var void while with yield true false abstract any asserts bigint boolean declare enum global implements infer interface is keyof module namespace never number object override private protected public readonly require satisfies string symbol type unique unknown",
    "php": "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return self static string switch throw trait try unset use var void while xor yield true false null int float bool mixed never iterable object from parent",
    "ruby": "alias and begin break case class def defined do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield puts require require_relative raise private public protected include extend attr_reader attr_writer attr_accessor lambda proc loop print p new",
}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}
EXTENSIONS = {
    "py": "python", "pyi": "python", "go": "go", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "rs": "rust", "c": "c", "h": "c", "rb": "ruby", "php": "php",
}
LANGUAGES = ("python", "go", "typescript", "javascript", "java", "rust", "c", "ruby", "php")
TOP_LEVEL = {
    "go": frozenset("import func var const type ;".split()),
    "java": frozenset("package import public private protected static final abstract class interface enum record sealed non strictfp @ ;".split()),
    "rust": frozenset("use pub fn struct enum trait impl mod const static type unsafe async extern macro_rules union # crate ;".split()),
}
FOREIGN_HEADS = frozenset("class public private protected import package func fn def let var function namespace use interface impl from require export module".split())
#: Operators that need an operand after them.
DANGLING = frozenset("= += -= *= /= %= == != <= >= && || . => -> := ?? === !== :: <<= >>= &= |= ^= **=".split())
# End of the fixed values.

_CONFLICT = r"^(?:<{7}|>{7}|\|{7})(?:[ \t][^\n]*)?$|^={7}\r?$"
_WORD = r"[^\W\d]\w*"
_NUMBER = r"\d(?:[\w.]*\w)?(?:(?<=[eE])[+-]\d+)?"
_OPERATOR = r"<<=|>>=|\*\*=|===|!==|\.\.\.|\.\.=|&&=|\|\|=|\?\?=|<=>|[-+*/%&|^!=<>]=|&&|\|\||\?\?|\?\.|\?->|=>|->|:=|::|\+\+|--|<-|\.\.|<<|[-+*/%&|^!=<>.,;:?@~#\\$]"
_LINE = r"//[^\n]*"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"
_D, _S = r'"(?:[^"\\\n]|\\(?:.|\n))*"', r"'(?:[^'\\\n]|\\(?:.|\n))*'"
_DM, _SM = r'"(?:[^"\\]|\\.|\\\n)*"', r"'(?:[^'\\]|\\.|\\\n)*'"
_TEMPLATE = r"`(?:[^`\\$]|\\.|\\\n|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*\}|`[^`]*`)*\})*`"
_REGEX = r"(?:(?<=[(,=:\[!&|?{};\n+])|(?<=[(,=:\[!&|?{};+] ))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_REST = r"|(?P<bad>/\*|[\"'`])|(?P<word>" + _WORD + r")|(?P<num>" + _NUMBER + r")|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<op>" + _OPERATOR + r")|(?P<nl>\n)|(?P<other>[^\s])"


def _lexer(skip: list[str], strings: list[str], rest: str = _REST) -> re.Pattern[str]:
    return re.compile(f"(?P<skip>[^\\S\\n]+|{'|'.join(skip)})|(?P<conflict>{_CONFLICT})|(?P<str>{'|'.join(strings)})" + rest, re.M)


_LEXERS = {
    "go": _lexer([_LINE, _BLOCK], [_D, r"'(?:[^'\\\n]|\\[^\n']{1,10}|\\')'", r"`[^`]*`"]),
    "java": _lexer([_LINE, _BLOCK], [r'"""(?:[^"]|"(?!""))*"""', _D, _S]),
    "c": _lexer([_LINE, _BLOCK], [_D, _S]),
    "rust": _lexer([_LINE, _BLOCK], [r'b?r(?P<h>#*)".*?"(?P=h)', "b?" + _DM, r"b?'(?:[^'\\\n]|\\u\{[0-9a-fA-F]+\}|\\x..|\\.)'", r"'[A-Za-z_]\w*(?!')"]),
    "javascript": _lexer([_LINE, _BLOCK, r"\A#![^\n]*"], [_D, _S, _TEMPLATE, _REGEX]),
    "php": _lexer([_LINE, _BLOCK, r"#(?!\[)[^\n]*"], [_DM, _SM, r"<<<[ \t]*(['\"]?)(?P<tag>\w+)\1\n(?:.*\n)*?[ \t]*(?P=tag)\b"], _REST.replace("(?P<word>", r"(?P<var>\$\w+)|(?P<word>")),
    "ruby": _lexer([r"#[^\n]*", r"^=begin\b(?:.*\n)*?=end\b.*"], [_DM, _SM, r"%[wWiIqQ]?[(\[{<][^)\]}>]*[)\]}>]", r"<<[~-](?P<tag>[A-Z_]+)[^\n]*\n(?:.*\n)*?[ \t]*(?P=tag)\b", r":\"[^\"\n]*\"", r"(?<=[(,=~])[ \t]*/(?:[^/\\\n]|\\.)+/[a-z]*"], _REST.replace("(?P<word>" + _WORD, r"(?P<var>@{1,2}\w+|\$\w+|:\w+[?!]?|\w+:(?!:))|(?P<word>" + _WORD + "[?!]?(?!=(?!=))|" + _WORD)),
}
_LEXERS["typescript"] = _LEXERS["javascript"]
_PAIR = {")": "(", "]": "[", "}": "{"}
_JSX = re.compile(r"(?:return|=>|[(=?:&])\s*\(?\s*<(?:[A-Za-z][\w.]*(?:\s+[\w-]+(?:=|\s|/?>)|\s*/?>)|>)")
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line)\b(?:[^\n\\]|\\.|\\\n)*", re.M)


def lex(text: str, language: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, whether it is the first on its line) of each token without comments."""
    fresh = True
    keywords = KEYWORDS[language]
    for m in _LEXERS[language].finditer(text):
        kind = m.lastgroup
        if kind == "nl":
            fresh = True
        elif kind != "skip":
            if kind in ("h", "tag"):
                kind = "str"
            value = m.group()
            if kind == "word":
                kind = "kw" if value in keywords else "id"
            yield kind, value, fresh
            fresh = False
        elif "\n" in m.group():
            fresh = True


def check_python(text: str) -> str:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError) as error:
        return f"{type(error).__name__}: {error}"[:120]
    except (RecursionError, MemoryError):
        return _nesting(text)
    return ""


def _nesting(text: str) -> str:
    """What is left to check in a program nested beyond the parser's stack: its tokens, brackets and indentation."""
    open_brackets: list[str] = []
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type == tokenize.OP and token.string in "([{":
                open_brackets.append(token.string)
            elif token.type == tokenize.OP and token.string in ")]}" and (not open_brackets or open_brackets.pop() != _PAIR[token.string]):
                return f"unexpected {token.string}"
    except (tokenize.TokenError, SyntaxError) as error:
        return f"{type(error).__name__}: {error}"[:120]
    return f"{open_brackets[-1]} never closed" if open_brackets else ""


def _imports(tokens: list[tuple[str, str, bool]], at: int) -> str:
    """A static import of the script languages must name a module; the empty string if it does."""
    seen_from, depth = False, 0
    for kind, value, fresh in tokens[at + 1 :]:
        if kind == "open":
            if value == "(" and not depth:
                return ""
            depth += 1
        elif kind == "close":
            depth -= 1
        elif not depth:
            if value in (".", "="):
                return ""
            if kind == "str":
                return ""
            if value == "from":
                seen_from = True
            elif value == ";" or fresh and seen_from:
                break
    return "import without a module"


def _end_stack(tokens: list[tuple[str, str, bool]]) -> str:
    """The block ends of the keyword-delimited language."""
    stack: list[str] = []
    loop_line = False
    previous: tuple[str, str, bool] = ("nl", "\n", True)
    for k, (kind, value, fresh) in enumerate(tokens):
        if fresh:
            loop_line = False
        start = fresh or previous[1] in ("=", ";", "(", "[", "{", ",", "then", "do", "else", "return", "+=", "||=", "=>", "|", "||", "&&", "and", "or", "not", "!")
        if kind == "kw" and previous[1] not in (".", "?.", "def", "::"):
            if value in ("def", "class", "module", "begin", "case") or value in ("if", "unless", "while", "until", "for") and start:
                if value == "class" and k + 1 < len(tokens) and previous[1] in ("self",):
                    continue
                stack.append(value)
                loop_line = value in ("while", "until", "for")
                if value in ("def", "class", "module") and (k + 1 >= len(tokens) or tokens[k + 1][0] not in ("id", "kw", "op")):
                    return f"{value} without a name"
            elif value == "do":
                if loop_line:
                    loop_line = False
                else:
                    stack.append("do")
            elif value == "end":
                if not stack:
                    return "end without a block"
                stack.pop()
            elif value in ("else", "elsif", "when", "rescue", "ensure", "in") and fresh and not stack:
                return f"{value} outside a block"
        if value == "=" and stack and stack[-1] == "def" and previous[1] == ")" and not fresh:
            stack.pop()  # a definition in one line
        previous = (kind, value, fresh)
    return "block without an end" if stack else ""


def check_php(text: str) -> str:
    """Only what stands in the processing tags is code; text without any tag is no program here."""
    if not re.search(r"<\?(?:php\b|=)", text):
        return "no opening tag" if text.strip() else ""
    code = re.sub(r"\?>(?:[^<]|<(?!\?(?:php\b|=)))*(?:<\?(?:php\b|=)|\Z)", ";", re.sub(r"\A(?:[^<]|<(?!\?(?:php\b|=)))*<\?(?:php\b|=)", "", text, count=1))
    tokens = list(lex(code, "php"))
    return check_tokens(tokens, "php") or grammar.check(tokens, "php")


def check_tokens(tokens: list[tuple[str, str, bool]], language: str, partial: bool = False) -> str:
    """The first violation found, or the empty string; of a partial list only what stands inside it."""
    longest = {"c": 3, "ruby": 3, "java": 2, "go": 2, "rust": 1, "javascript": 1, "typescript": 1, "php": 1}[language]
    stack: list[str] = []
    chain = 0
    kind0, value0 = "nl", ""
    head, head_at = "", 0
    top = TOP_LEVEL.get(language)
    statement = True
    macro = 0
    for k, (kind, value, fresh) in enumerate(tokens):
        if kind == "conflict":
            return "conflict marker"
        if kind == "bad":
            return "unclosed literal or comment"
        if kind == "other" and language != "ruby":
            return f"character {value}"
        if not stack and (statement or language == "go" and fresh and kind0 not in ("op", "open") and value0 not in ("func", "type", "var", "const", "import")):
            if value not in ("}", ")", "]"):
                head, head_at = value, k
                if language == "go" and (k == 0) != (value == "package"):
                    return "package clause"
                if top is not None and not (language == "go" and k == 0) and value not in top and not (language == "rust" and k + 1 < len(tokens) and tokens[k + 1][1] in ("!", "::")):
                    return f"top level {value}"
                if language == "c" and value in FOREIGN_HEADS and k + 1 < len(tokens) and tokens[k + 1][0] in ("id", "kw", "str"):
                    return f"head {value}"
                if language == "c" and value == "#":
                    return "directive"
                if language in ("javascript", "typescript") and value == "{" and k + 2 < len(tokens) and tokens[k + 1][0] == "str" and tokens[k + 2][1] == ":":
                    return "data in place of a statement"
                if language == "ruby" and kind == "var" and value.endswith(":"):
                    return "key without a call"
                if language in ("javascript", "typescript") and value == "import" and not partial and (why := _imports(tokens, k)):
                    return why
        if kind == "open":
            if language == "rust" and (macro or value0 == "!" and k > 1 and tokens[k - 2][0] in ("id", "kw")):
                macro += 1
            if value == "[" and language == "javascript" and kind0 == "id" and k + 1 < len(tokens) and tokens[k + 1][1] == "]":
                return "array type"
            stack.append(value)
        elif kind == "close":
            if not stack or stack.pop() != _PAIR[value]:
                return f"unexpected {value}"
            macro = max(0, macro - 1)
            if value0 in DANGLING and not macro and not (language == "ruby" and value0 == "::"):
                return f"{value0} before {value}"
        elif value == ";" and (value0 in DANGLING or value0 in ("+", "-")) and not macro:
            return f"{value0} before ;"
        if kind == "id":
            chain = chain + 1 if not fresh or chain == 0 else 1
            if chain > longest and not macro:
                return f"words in a row: {value0} {value}"
            if not fresh and kind0 in ("num", "str") and not macro and language not in ("c", "ruby") and not (kind0 == "str" and language == "rust"):
                return f"operand {value0[:20]} before {value}"
            if language == "go" and stack and stack[-1] == "{" and chain == 2 and k + 1 < len(tokens) and tokens[k + 1][1] in ("=", ":="):
                return "declaration without var"
            if language == "go" and stack and stack[-1] == "(" and head == "func" and kind0 == "id" and value0 in ("int", "string", "boolean") and not fresh:
                return "type before name"
        else:
            chain = 0
            if kind in ("num", "str") and not fresh and kind0 in ("num", "id", "str") and not macro:
                if not (kind0 == "str" and kind == "str" and language in ("c", "ruby")) and not (language in ("c", "ruby") and kind == "str") and not (language == "rust" and (kind == "str" or kind0 == "str")) and not (kind0 == "id" and language == "ruby") and not (language == "javascript" and kind0 == "id" and kind == "str" and value0 in ("type",)):
                    if not (kind0 == "id" and kind == "str" and (language == "go" and (head == "import" or stack) or language in ("typescript",) and value0 in ("module",))):
                        return f"operand {value0[:20]} before {value[:20]}"
            if value == ":" and language == "javascript" and stack and stack[-1] == "(" and kind0 == "id" and _annotated(tokens, k):
                return "type annotation"
            if value == ":" and language == "javascript" and value0 == ")" and k + 1 < len(tokens) and tokens[k + 1][0] in ("id",) and k + 2 < len(tokens) and tokens[k + 2][1] in ("{", "[", "<", "=>"):
                return "return type"
            if kind == "kw" and value in ("class", "function", "fn", "func", "def", "interface", "struct", "trait", "enum") and language != "ruby" and k + 1 < len(tokens) and tokens[k + 1][0] in ("num", "str"):
                return f"{value} before {tokens[k + 1][1]}"
        statement = not stack and (value == ";" or value == "}" or language == "rust" and value == "]" and head == "#" or language in ("javascript", "typescript", "ruby") and fresh and not stack and kind != "op")
        if language in ("javascript", "typescript") and not stack and k + 1 < len(tokens) and tokens[k + 1][2] and kind not in ("op", "open") and value != "from":
            statement = True
        kind0, value0 = kind, value
    if partial:
        return ""
    if stack:
        return f"{stack[-1]} never closed"
    if not tokens:
        return ""
    if kind0 == "op" and value0 in DANGLING:
        return f"ends with {value0}"
    if language in ("c", "java", "php", "rust") and value0 not in ("}", ";") and not (language == "rust" and value0 in (")", "]") and head == "#"):
        return "unfinished statement"
    if language in ("javascript", "typescript", "go") and kind0 == "kw" and value0 in ("func", "function", "class", "export", "import", "async", "const", "let", "var", "type", "interface", "extends", "new", "package", "if", "for", "while", "else", "enum", "from", "default", "implements", "struct"):
        return f"ends with {value0}"
    if language in ("javascript", "typescript"):
        heads = [v for _, v, _ in tokens[head_at:]]
        bare = [v for v in heads[:5] if v not in ("export", "default", "async", "abstract", "declare")]
        if bare[:1] and bare[0] in ("function", "class", "interface", "enum") and value0 not in ("}", ";"):
            return "declaration without a body"
        if bare[:1] == ["import"] and (why := _imports(tokens, head_at)):
            return why
        if heads[0] in ("export", "async", "import") and len(heads) == 2 and kind0 == "id":
            return "unfinished statement"
    if language == "go" and head in ("func", "type", "var", "const", "import"):
        tail = tokens[head_at + 1 :]
        if head == "func" and not any(v == "(" for _, v, _ in tail) or head == "type" and len(tail) < 2 or head in ("var", "const") and len(tail) < 2 and head == "var" or head == "import" and not any(q == "str" for q, _, _ in tail) and tail and tail[0][1] != "(":
            return "unfinished declaration"
        if head == "func" and tail and tail[0][1] == "(" and sum(v == "(" for _, v, _ in tail) < 2:
            return "unfinished declaration"
    return ""


def _annotated(tokens: list[tuple[str, str, bool]], at: int) -> bool:
    """Whether the colon stands in a parameter list: name : type, then a comma, an equals sign or the end of the list."""
    before = tokens[at - 2][1] if at > 1 else ""
    return before in ("(", ",") and at + 1 < len(tokens) and tokens[at + 1][0] in ("id", "kw")


#: After so many tokens a foreign grammar looks whether they break a rule already.
GLANCES = (60, 240, 960)


def check(text: str, language: str, foreign: bool = False) -> str:
    """Why a text is no valid program of the language; the empty string if it is one. Empty text is valid.

    A grammar foreign to the file gives up within its first tokens if they already break a rule, which is the same verdict.
    """
    text = text.removeprefix("﻿")
    text = text.replace("\r\n", "\n") if "\r" in text else text
    if language == "python":
        return check_python(text)
    if language == "php":
        return check_php(text)
    if language == "c":
        if _MARKER.search(text) and _MARKER.search(_BLOCK_OR_STRING.sub(" ", text)):
            return "conflict marker"
        text = _DIRECTIVE.sub("", text) if "#" in text else text
    why = _check_text(text, language, foreign)
    if why and language in ("javascript", "typescript") and _JSX.search(text):
        plain = without_elements(text)
        why = why if plain == text else _check_text(plain, language, False)
    return why


def _check_text(text: str, language: str, foreign: bool) -> str:
    stream = lex(text, language)
    tokens: list[tuple[str, str, bool]] = []
    for size in GLANCES if foreign else ():
        tokens += islice(stream, size - len(tokens))
        if len(tokens) == size and (why := check_tokens(tokens, language, partial=True)):
            return why
    tokens += stream
    why = check_tokens(tokens, language) or grammar.check(tokens, language)
    return why or (_end_stack(tokens) if language == "ruby" else "")


_ELEMENT = re.compile(r"(?:[=(?:&|,{\[;]|=>|\breturn|^)\s*(?=<[A-Za-z>])", re.M)
_TAG = re.compile(r"<([\w.:-]*)")
_ATTRIBUTES = re.compile(r"(?:[^<>{}\"'/]|\"[^\"]*\"|'[^']*'|/(?!>)|=>)*")
_NESTED = re.compile(r"[^{}\"'`]+|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")


def _braces(text: str, at: int) -> int:
    """End of the expression in braces that starts there, or -1."""
    depth = 0
    while at < len(text):
        if text[at] == "{":
            depth += 1
        elif text[at] == "}":
            depth -= 1
            if not depth:
                return at + 1
        elif m := _NESTED.match(text, at):
            at = m.end()
            continue
        at += 1
    return -1


def _element_end(text: str, at: int) -> int:
    """End of the markup element that starts there with all its children, or -1."""
    names: list[str] = []
    while at < len(text):
        if text[at] == "{":
            at = _braces(text, at)
            if at < 0:
                return -1
        elif text.startswith("</", at):
            m = re.compile(r"</([\w.:-]*)\s*>").match(text, at)
            if not m or not names or names.pop() != m.group(1):
                return -1
            at = m.end()
            if not names:
                return at
        elif text[at] == "<":
            m = _TAG.match(text, at)
            at = _ATTRIBUTES.match(text, m.end()).end()
            while text[at : at + 1] == "{":
                at = _braces(text, at)
                if at < 0:
                    return -1
                at = _ATTRIBUTES.match(text, at).end()
            if text.startswith("/>", at):
                at += 2
                if not names:
                    return at
            elif text[at : at + 1] == ">":
                names.append(m.group(1))
                at += 1
            else:
                return -1
        else:
            at += 1
    return -1


def without_elements(text: str) -> str:
    """The text with each complete markup element as one string, which is an operand as the element is."""
    out, done = [], 0
    for m in _ELEMENT.finditer(text):
        if m.end() >= done and (end := _element_end(text, m.end())) > 0:
            out += [text[done : m.end()], '""']
            done = end
    return "".join([*out, text[done:]])


_MARKER = re.compile(_CONFLICT, re.M)
_BLOCK_OR_STRING = re.compile("|".join([_LINE, _BLOCK, _D, _S]))

#: Tokens typical of one language, for ranking: texts of which the pattern needs one, and the pattern.
SIGNS = {
    "python": (("def ", r"^[ \t]*(?:async )?def \w+\([^{;\n]*:[ \t]*$"), (":\n", r"^[ \t]*(?:elif|except|with|class|for|if|while)\b[^{;\n]*:[ \t]*$"), ("from ", r"^from [\w.]+ import "), ("self.", r"\bself\."), ("import ", r"^import [\w.]+(?: as \w+)?[ \t]*$"), ("None", r"\bNone\b")),
    "go": (("package ", r"^package \w+\s*$"), ("func ", r"^func (?:\(|\w+\()"), (":=", ":="), ('import "', r"^import \""), ("type ", r"^type \w+ (?:struct|interface)\b"), ("nil", r"\bnil\b")),
    "typescript": (("import ", r"^import .* from [\"']"), (": ", r"\w\??: (?:number|string|boolean|void|any|unknown)\b"), ("interface ", r"^(?:export )?interface \w+"), ("type ", r"^(?:export )?type \w+"), ("=== ", "=== "), ("Promise<", r"\bPromise<"), ("export ", r"^export ")),
    "javascript": (("import ", r"^import .* from [\"']"), ("function ", r"^(?:export )?(?:async )?function \w+\("), ("let ", r"\blet \w+ = "), ("const ", r"\bconst \w+ = "), ("=== ", "=== "), ("export ", r"^export "), ("require(", r"\brequire\(")),
    "java": (("package ", r"^package [\w.]+;"), ("import ", r"^import (?:static )?[\w.]+(?:\.\*)?;"), ("public ", r"\bpublic (?:static )?[\w<>\[\], ]+\("), ("private ", r"\bprivate (?:static )?[\w<>\[\], ]+\("), ("protected ", r"\bprotected (?:static )?[\w<>\[\], ]+\("), ("final ", r"\bfinal "), ("String", r"\bString\b")),
    "rust": (("use ", r"^use [\w:]+"), ("fn ", r"\bfn \w+\s*[(<]"), ("let mut ", r"\blet mut \b"), ("impl", r"\bimpl\b"), ("->", "->"), ("::", "::"), ("!(", r"\w+!\(")),
    "c": (("#include", r"^#include [<\"]"), ("#", r"^#(?:define|ifdef|ifndef|endif)\b"), ("(", r"^(?:static |extern )?(?:int|void|char|struct \w+) \*?\w+\("), ("NULL", r"\bNULL\b"), ("const char *", r"\bconst char \*")),
    "ruby": (("require", r"^require(?:_relative)? [\"']"), ("end\n", r"^[ \t]*end[ \t]*$"), ("def ", r"^[ \t]*def \w+[?!]?(?:\([^)\n]*\))?[ \t]*$"), ("do |", r"\bdo \|\w+\|"), ("attr_", r"^[ \t]*attr_\w+ :")),
    "php": (("<?php", r"<\?php"), ("$", r"\$\w+\s*(?:=|->|\+=|-=)"), ("use ", r"^use [\w\\]+;"), ("namespace ", r"^namespace [\w\\]+;"), ("function ", r"\bfunction \w+\([^)]*\$")),
}
_SIGNS = {k: [(needs, re.compile(p, re.M)) for needs, p in v] for k, v in SIGNS.items()}


def rank(text: str) -> list[tuple[str, int]]:
    """Languages by the number of their typical tokens in the text, the most first; ties by name."""
    counts = {k: sum(text.count(needs) if p.pattern == needs else len(p.findall(text)) for needs, p in signs if needs in text) for k, signs in _SIGNS.items()}
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))


def extension_language(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[-1].lower(), "") if "." in name else ""


def judge(text: str | None, path: str | None) -> tuple[bool, str, str, str]:
    """(broken, cause, language found, first violation) of a file; cause is '', 'wrong_extension' or 'corrupt'.

    Every grammar is tried on every file, in the order of the languages' typical tokens. A file that its own grammar refuses
    has a wrong extension if a foreign one accepts it, and is corrupt if none does. A grammar that finds none of its own
    typical tokens in the text proves nothing: it names no language, and it gives way to a foreign one that has at least
    three of its own and accepts the text too.
    """
    own = extension_language(path)
    if text is None or not own or not text.strip("﻿ \t\r\n"):
        return False, "", own, ""
    ranked = rank(text)
    verdicts = {language: check(text, language, foreign=language != own) for language, _ in ranked}
    accepted = [(language, score) for language, score in ranked if score and not verdicts[language]]
    if verdicts[own]:
        return (True, "wrong_extension", accepted[0][0], verdicts[own]) if accepted else (True, "corrupt", "", verdicts[own])
    scores = dict(ranked)
    best, score = ranked[0]
    if own != "python" and not scores[own] and score >= 3 and not {best, own} <= {"javascript", "typescript"} and not verdicts[best]:
        return True, "wrong_extension", best, f"typical of {best}"
    return False, "", own, ""
