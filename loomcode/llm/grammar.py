"""Statement and expression rules as tables: which token may follow which, what a statement head needs, what owns an else.

A token where an operand must stand is judged by the language's table of operators that begin none; heads and their
parentheses, declared names, clauses and parameters by tables of keywords. The rules run over the token list of
``syntax.lex`` in one pass with a stack of brackets; tokens inside Rust macro calls follow no grammar and are passed over.
"""

from __future__ import annotations

# Operators and keywords of the languages.
_COMPARE = "== != <= >= && || = += -= *= /= %="
#: Operators that cannot begin an operand.
BINARY = {
    "go": f"/ % | := << {_COMPARE}", "c": f"/ % | ^ << {_COMPARE}", "java": f"* / % | ^ & {_COMPARE}", "rust": "/ % == != <= >= = += -= *= /= %= ^",
    "javascript": f"* % === !== ?? ** | & ^ {_COMPARE}", "typescript": f"* % === !== ?? ** ^ {_COMPARE}", "php": f"* / % === !== ?? . | ^ {_COMPARE}", "ruby": "== != <= >= && = += -= *= === =>",
}
#: Operators after which an operand must follow; where types have angle brackets these say nothing.
AWAITS = {k: f"{v} + - * & : ," for k, v in BINARY.items()}
for _k in ("go", "c", "php", "javascript"):
    AWAITS[_k] += " < >"
#: Operators that cannot stand before a closing bracket or a semicolon.
UNENDING = {
    "go": f"+ - / % | := . {_COMPARE}", "c": f"+ - / % | ^ -> {_COMPARE}", "java": f"+ - / % | & ^ . {_COMPARE}", "rust": "+ - / % == != <= >= = += -= *= /= %= ^",
    "javascript": f"+ - % === !== ?? ** | & ^ . {_COMPARE}", "typescript": f"+ - % === !== ?? ** | & ^ . {_COMPARE}", "php": f"+ - * / % === !== ?? . | ^ -> {_COMPARE}", "ruby": "+ - == != <= >= && || = += -= *= === =>",
}
#: Operators before which no block can begin.
BEFORE_BLOCK = {"go": "== != <= >= && || + - / %", "c": "== != <= >= && || + - / %", "java": "== != <= >= && || + - / %", "php": "== != === !== <= >= && || + - / % ."}
#: Keywords whose condition stands in parentheses that hold something.
IN_PARENTHESES = {"c": "if while for switch", "java": "if while for switch catch", "javascript": "if while for switch", "typescript": "if while for switch", "php": "if elseif while for foreach switch catch"}
#: Keywords that need something before the block.
HEADED = {"go": "if", "rust": "if while match"}
#: Statement keywords that none of the heads can be followed by.
HEADS = {"go": "if for switch var const type package import", "c": "if while for switch", "java": "if while for switch", "javascript": "if while for switch let const var", "typescript": "if while for switch let const var", "php": "if while for foreach switch", "rust": "while let mod use"}
STATEMENTS = frozenset("if for while switch foreach return else break continue case default package import do class".split())
#: Keywords that declare a name, which no operator, literal or closing bracket is.
DECLARES = {"go": "var const type", "c": "int char float double struct enum union", "java": "int char float double boolean byte short class interface enum", "javascript": "let const var class", "typescript": "let const var", "php": "class interface trait", "rust": "let fn struct enum trait mod"}
NO_NAME = frozenset("= ; + - / % == += ,".split())
# End of the fixed values.

for _table in (BINARY, AWAITS, UNENDING, BEFORE_BLOCK, IN_PARENTHESES, HEADED, HEADS, DECLARES):
    for _k in _table:
        _table[_k] = frozenset(_table[_k].split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_NOTHING: frozenset[str] = frozenset()
#: Languages in which a list may leave elements out.
_HOLES = {"javascript", "typescript", "php"}

Token = tuple[str, str, bool]


def _group(tokens: list[Token], at: int) -> tuple[int, list[Token]]:
    """Index of the bracket that closes the one at ``at`` (or the end), and the tokens of its own level."""
    depth, own = 0, []
    for k in range(at, len(tokens)):
        kind, _, _ = tokens[k]
        if kind == "close":
            depth -= 1
            if not depth:
                return k, own
        if depth == 1:
            own.append(tokens[k])
        if kind == "open":
            depth += 1
    return len(tokens), own


def _loop(language: str, keyword: str, own: list[Token]) -> bool:
    """Whether the parentheses of a loop hold what the language wants there."""
    values = [v for _, v, _ in own]
    parts = values.count(";")
    if keyword == "foreach":
        return "as" in values
    if parts == 2 or language == "c":
        return parts == 2
    return parts == 0 and bool({"java": {":"}, "php": set()}.get(language, {"of", "in"}) & set(values))


def _typed(own: list[Token]) -> bool:
    """Whether each Rust parameter has a type or is self."""
    part: list[str] = []
    depth = 0
    for _, v, _ in [*own, ("op", ",", False)]:
        depth += (v == "<") - (v == ">")
        if v == "," and depth <= 0:
            if part and ":" not in part and "self" not in part and "..." not in part:
                return False
            part = []
        else:
            part.append(v)
    return True


def _parameters(tokens: list[Token], at: int) -> bool:
    """Of a Rust function whose name stands at ``at``."""
    k, depth = at + 1, 0
    while k < len(tokens) and (tokens[k][1] != "(" or depth > 0):
        depth += (tokens[k][1] == "<") - (tokens[k][1] == ">")
        if tokens[k][1] in ("{", ";"):
            return False
        k += 1
    return k >= len(tokens) or _typed(_group(tokens, k)[1])


def check(tokens: list[Token], language: str) -> str:
    """The first violation, or the empty string."""
    binary, awaits, unending, before_block = BINARY[language], AWAITS[language], UNENDING[language], BEFORE_BLOCK.get(language, _NOTHING)
    parenthesised, headed, heads, declares = (t.get(language, _NOTHING) for t in (IN_PARENTHESES, HEADED, HEADS, DECLARES))
    stack: list[tuple[str, str, int]] = []  # bracket, the keyword that owns its block, ifs without a block inside
    owner, closed, loose = "", "", 0
    macro = -1
    last = len(tokens) - 1
    for k, (kind, value, fresh) in enumerate(tokens):
        kind0, value0, _ = tokens[k - 1] if k else ("nl", "", True)
        if kind == "open":
            if language == "rust" and macro < 0 and value0 == "!" and k > 1 and tokens[k - 2][0] in ("id", "kw"):
                macro = len(stack)
            if macro < 0 and value == "{" and kind0 == "op" and value0 in before_block:
                return f"{value0} before a block"
            stack.append((value, owner, loose))
            if value == "{":
                owner, loose = "", 0
            continue
        if kind == "close":
            if not stack:
                return f"unexpected {value}"
            bracket, was, before = stack.pop()
            if bracket == "{":
                closed, owner, loose = was, "", before
            if macro == len(stack):
                macro = -1
            elif macro < 0 and kind0 == "op" and value0 in unending:
                return f"{value0} before {value}"
            elif macro < 0 and value0 == "," and value == ")" and language == "java":
                return ", before )"
            continue
        if macro >= 0:
            continue
        if kind == "op":
            if value == ";":
                if kind0 == "op" and value0 in unending:
                    return f"{value0} before ;"
                owner = owner if stack and stack[-1][0] == "(" else ""
            if value in binary and (kind0 == "op" and value0 in awaits or kind0 == "open" and value0 in ("(", "[")) and not (language == "ruby" and kind0 == "op" and k > 1 and tokens[k - 2][1] in ("def", ".")) and not (value == "*" and value0 == ","):
                return f"{value0} before {value}"
            if value == "," and (value0 == "," or value0 in ("(", "[")) and not (language in _HOLES and (value0 == "[" or stack and (stack[-1][0] == "[" or language == "php"))):
                return f"{value0} before ,"
            continue
        if language == "php" and not fresh and (kind == "var" and kind0 in ("var", "num", "str") or kind in ("num", "str") and kind0 == "var"):
            return f"{value0[:20]} before {value[:20]}"
        if kind != "kw" or value0 in (".", "?.", "->", "::", "&.", "def") or k == last:
            continue
        kind1, value1, fresh1 = tokens[k + 1]
        if value1 in (":", "=>") and language in ("javascript", "typescript", "php", "ruby") and value not in ("case", "else", "default"):
            continue  # a key or a label
        if value == "else" and language != "ruby" and not (language == "php" and value1 == ":"):
            if value0 == "}":
                if closed not in ("if", "elseif") and not loose:
                    return "else without an if"
            elif language != "rust":  # which has let with else
                if not loose:
                    return "else without an if"
                loose -= 1
        if value in ("if", "elseif") and value in parenthesised and value1 == "(":
            end, _ = _group(tokens, k + 1)
            loose += end + 1 < len(tokens) and tokens[end + 1][1] not in ("{", ":")
        if value in ("if", "elseif", "else", "for", "while", "switch", "match", "foreach", "func", "fn", "class", "struct", "function", "do", "try", "catch", "loop", "unsafe", "impl"):
            owner = value
        if value in parenthesised and not (language in ("javascript", "typescript") and (value1 in (",", "}", "=", "?", ")") or value == "for" and value1 == "await")):
            if value1 != "(":
                return f"{value} before {value1[:20]}"
            end, own = _group(tokens, k + 1)
            if end == k + 2 or value in ("for", "foreach") and end < len(tokens) and not _loop(language, value, own):
                return f"{value} without its condition"
        if value in headed and value1 == "{":
            return f"{value} without its condition"
        if value in heads and kind1 == "kw" and value1 in STATEMENTS and not fresh1:
            return f"{value} before {value1}"
        if value in declares and value0 != "as" and (kind1 in ("num", "str") or value1 in NO_NAME and kind1 == "op") and not (value1 in (",", ";") and (language == "c" or stack and stack[-1][0] == "(")):
            return f"{value} without a name"
        if value == "case" and value1 == ":":
            return "case without a value"
        if language == "rust" and value == "fn" and kind1 == "id" and not _parameters(tokens, k + 1):
            return "parameter without a type"
    return ""
