"""Functions paired with their documentation.

Signatures are found by regular expressions at the lines that the function table names, headers by a stack of brackets,
bodies by an indentation, brace or end-keyword stack over the text with its strings and comments blanked, and a comment
belongs to the definition next to it: directly above (decorators and attributes between do not part them) or, where the
language has it so, as the first string inside. A file and its functions meet in one task, so no code is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcode.functions.arrow import map_lists
from loomcode.session import parallelism

# Shapes of signatures, words that say nothing.
_SIGNATURES = (
    ("def", r"^(?P<i_def>[ \t]*)(?:async[ ]+)?def[ ]+(?:self\.)?(?P<n_def>\w+[?!=]?)"),
    ("go", r"^(?P<i_go>)func[ ]+(?:\((?:\w+[ ]+)?\*?\w+[^)\n]*\)[ ]*)?(?P<n_go>\w+)[ ]*[(\[]"),
    ("rust", r"^(?P<i_rust>[ \t]*)(?:pub(?:\([^)\n]*\))?[ ]+)?(?:(?:const|async|unsafe|default|extern(?:[ ]+\"[^\"\n]*\")?)[ ]+)*fn[ ]+(?P<n_rust>\w+)"),
    ("function", r"^(?P<i_function>[ \t]*)(?:(?:export|default|async|public|private|protected|static|final|abstract)[ ]+)*function[ ]*[&*]?[ ]*(?P<n_function>[\w$]+)[ ]*[<(]"),
    ("arrow", r"^(?P<i_arrow>[ \t]*)(?:export[ ]+)?(?:const|let|var)[ ]+(?P<n_arrow>[\w$]+)[ ]*(?::[^=\n]+)?=[ ]*(?:async[ ]*)?(?:\([^()\n]*\)|[\w$]+)[ ]*(?::[^=\n]+)?=>"),
    ("typed", r"^(?P<i_typed>[ \t]*)(?!(?:return|else|new|throw|if|for|while|switch|catch|case|do|in|await|yield|delete|package|import|use)\b)(?:[\w<>\[\],.?]+(?:[ ]+\*{0,2}|[ ]*\*{1,2}[ ]*)){0,7}(?P<n_typed>(?!(?:if|for|while|switch|catch|return|function|sizeof)\b)[\w$]+)[ ]*(?:<[^>()\n]*>)?\([^;{}\n]*\)[^;{}=\n]*[{;]"),
)
NO_CONTENT = frozenset(
    "a an the this that these it is are be to of for and or in on with by as function method func fn procedure routine class constructor destructor helper utility util wrapper getter setter test tests init initializer initialize main internal use used uses only private public"
    " does do stuff thing things something returns return returned docstring documentation document docs doc documented undocumented comment description describe here add your write written missing available none no not yet na n todo fixme xxx tbd hack note see above below base super parent class inherit inheritdoc inherited"
    " auto generated autogenerated stub placeholder empty nothing self explanatory implementation implement implements implemented code fix me later sin descripción beschreibung fehlt aucune sans description non documenté pendiente documentar".split()
)
# End of the fixed values.

_SIGNATURE = re.compile("|".join(f"(?:{p})" for _, p in _SIGNATURES), re.M)
_BETWEEN = re.compile(r"\s*(?:@[\w.]+(?:\(.*\))?|#\[.*\]|template\s*<.*>)\s*$")
_LINE, _BLOCK, _D, _S = r"//[^\n]*", r"/\*[\s\S]*?\*/", r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_DM, _SM = r'"(?:[^"\\]|\\[\s\S])*"', r"'(?:[^'\\]|\\[\s\S])*'"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*\}|`[^`]*`)*\})*`"
_PATTERN = r"(?<=[(,=:\[!&|?{};+])[ ]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_HEREDOC = r"<<<?[-~]?[ \t]*(?P<q>['\"]?)(?P<tag>[A-Z_]\w*)(?P=q)[^\n]*\n(?:.*\n)*?[ \t]*(?P=tag)\b"
#: Comments and literals by extension, whose brackets and keywords mean nothing.
_BLANKED = {
    "py": rf"#[^\n]*|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'{{3}}(?:[^\\]|\\[\s\S])*?'{{3}}|{_D}|{_S}", "rb": rf"^=begin\b[\s\S]*?^=end\b[^\n]*|#[^\n]*|{_HEREDOC}|{_DM}|{_SM}|%[wWiIqQ]?[(\[{{<][^)\]}}>]*[)\]}}>]",
    "go": rf"{_LINE}|{_BLOCK}|{_D}|`[^`]*`|'(?:[^'\\\n]|\\[^\n']{{1,10}}|\\')'", "js": rf"{_LINE}|{_BLOCK}|{_D}|{_S}|{_TEMPLATE}|{_PATTERN}", "java": rf"{_LINE}|{_BLOCK}|\"\"\"[\s\S]*?\"\"\"|{_D}|{_S}", "c": rf"{_LINE}|{_BLOCK}|{_D}|{_S}",
    "rs": rf"{_LINE}|{_BLOCK}|r(?P<h>#*)\"[\s\S]*?\"(?P=h)|{_DM}|'(?:[^'\\\n]|\\[^\n']{{1,10}}|\\')'", "php": rf"{_LINE}|{_BLOCK}|#(?!\[)[^\n]*|{_HEREDOC}|{_DM}|{_SM}",
}
_BLANKED = {k: re.compile(v, re.M) for k, v in _BLANKED.items()}
_FAMILY = {"pyi": "py", "pyw": "py", "ts": "js", "tsx": "js", "jsx": "js", "mjs": "js", "cjs": "js", "mts": "js", "cts": "js", "h": "c", "cpp": "c", "cc": "c", "hpp": "c", "rake": "rb"}
_SOLID = re.compile(r"[^\n]")
_BRACKET = re.compile(r"[()\[\]{};]")
_KEYWORD = re.compile(r"(?<![\w.:@$])(?:def|class|module|begin|case|do|if|unless|while|until|for|end)(?![\w?!:])|\n")
_BEFORE_VALUE = re.compile(r"(?:[=;(\[{,|&!?]|(?<!\w)(?:then|do|else|return|and|or|not|begin))[ \t]*$")
_ENDLESS = re.compile(r"def[ ]+[\w.]+[?!]?[ ]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?[ ]*=(?![=~])[ ]*\S")
_HEAD_END = re.compile(r"[()\[\]{}:]")


def _family(path: str) -> str:
    end = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    return end if end in _BLANKED else _FAMILY.get(end, "c")


def blanked(text: str, family: str) -> str:
    """The text with comments and literals as spaces; all else keeps its place."""
    return _BLANKED[family].sub(lambda m: _SOLID.sub(" ", m.group()), text)


def _python_head(masked: str, at: int) -> int:
    """Index after the colon that ends the header that starts at ``at``, or -1."""
    depth = 0
    for m in _HEAD_END.finditer(masked, at):
        c = m.group()
        if c == ":" and depth <= 0:
            return m.end()
        depth += (c in "([{") - (c in ")]}")
    return -1


def _python_end(masked: str, at: int, head: int) -> int:
    """End of a body by indentation; brackets and literals go on over lines whatever their indentation."""
    line_end = lambda k: e if (e := masked.find("\n", k)) >= 0 else len(masked)
    indent = lambda k, e: len(masked[k:e].expandtabs(8)) - len(masked[k:e].expandtabs(8).lstrip())
    own = indent(at, line_end(at))
    end = stop = line_end(head)
    if masked[head:stop].strip():
        return end
    depth = 0
    while stop < len(masked):
        start, stop = stop + 1, line_end(stop + 1)
        line = masked[start:stop]
        if line.strip():
            if depth <= 0 and indent(start, stop) <= own:
                break
            depth += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
            end = stop
    return end


def _ruby_end(masked: str, at: int) -> int:
    """End of a definition by the stack of end keywords; a condition after a statement opens nothing."""
    line_end = masked.find("\n", at)
    line = masked[at : line_end if line_end >= 0 else len(masked)]
    if _ENDLESS.search(line):
        return at + len(line)
    depth, loop, line_start = 0, False, at
    for m in _KEYWORD.finditer(masked, at):
        word = m.group()
        if word == "\n":
            loop, line_start = False, m.end()
            continue
        before = masked[line_start : m.start()]
        if word == "end":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif word == "do":
            depth += not loop
            loop = False
        elif word in ("def", "class", "module", "begin", "case") or not before.strip() or _BEFORE_VALUE.search(before):
            depth += 1
            loop = word in ("while", "until", "for")
    return len(masked)


def _brace_head(masked: str, at: int) -> tuple[int, bool]:
    """(index, whether a block starts there) of the brace or semicolon after a header's parentheses."""
    depth, seen = 0, False
    for m in _BRACKET.finditer(masked, at):
        c = m.group()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            seen = True
        elif c == ";":
            if depth <= 0:
                return m.start(), False
        elif c == "{" and depth <= 0 and seen:
            return m.start(), True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth < 0:
                return m.start(), False
    return len(masked), False


def _close(masked: str, at: int) -> int:
    """Index after the brace that closes the one at ``at``."""
    depth = 0
    for m in _BRACKET.finditer(masked, at):
        depth += (m.group() in "([{") - (m.group() in ")]}")
        if depth <= 0 and m.group() in ")]}":
            return m.end()
    return len(masked)


def _expression_end(masked: str, at: int) -> int:
    """End of an expression without a block: a semicolon, or the end of a line with all brackets closed."""
    depth = 0
    for k in range(at, len(masked)):
        c = masked[k]
        depth += (c in "([{") - (c in ")]}")
        if depth < 0 or depth == 0 and c == ";":
            return k + (c == ";")
        if depth == 0 and c == "\n" and masked[at:k].strip() and not masked[k:].lstrip()[:1] in (".", "?", ":", "+", "&", "|"):
            return k
    return len(masked)


def _brace_end(masked: str, at: int, arrow: bool) -> tuple[int, int]:
    """(end of the header, end of the definition)."""
    if arrow and (sign := masked.find("=>", at)) >= 0:
        start = sign + 2
        while masked[start : start + 1].isspace():
            start += 1
        return start, _close(masked, start) if masked[start : start + 1] == "{" else _expression_end(masked, start)
    head, block = _brace_head(masked, at)
    if not block:
        return head, min(head + 1, len(masked)) if masked[head : head + 1] == ";" else head
    while True:
        end = _close(masked, head)
        typed = masked[:head].rstrip().endswith(":")
        following = re.compile(r"\s*\{" if typed else r"[ \t\])*]*\{").match(masked, end)
        if not following:
            return head, end
        head = following.end() - 1  # what was closed is part of the result's type


def _above(lines: list[str], at: int, hash_marks: bool) -> str:
    k = at - 1
    while k >= 0 and _BETWEEN.match(lines[k]):
        k -= 1
    if k < 0:
        return ""
    line = lines[k].strip()
    if line.endswith("*/"):
        top = k
        while top >= 0 and "/*" not in lines[top]:
            top -= 1
        return "\n".join(lines[max(top, 0) : k + 1]) if top >= 0 and lines[top].lstrip().startswith("/*") else ""
    mark = "#" if hash_marks else "//"
    if not line.startswith(mark):
        return ""
    top = k
    while top > 0 and lines[top - 1].strip().startswith(mark):
        top -= 1
    return "\n".join(lines[top : k + 1])


def _inside(text: str, masked: str, head: int) -> str:
    """The string that begins a block."""
    if head < 0 or masked[head:].split("\n", 1)[0].strip():
        return ""
    m = re.compile(r"[^\n]*\n(?:[ \t]*\n)?[ \t]*[rRuUbB]{0,2}(\"\"\"|'''|\"|')").match(text, head)
    if not m:
        return ""
    quote = m.group(1)
    end = text.find(quote, m.end())
    body = text[m.end() : end] if end >= 0 else text[m.end() :] if len(quote) == 3 else ""
    return "" if len(quote) == 1 and "\n" in body else body


def _shape(text: str, at: int, line: str, name: str) -> tuple[str, int]:
    """(shape, index after the name) of the definition of a name on the line that starts at ``at``; ('', 0) if there is none."""
    named = re.compile(rf"(?<![\w$]){re.escape(name)}(?![\w$])").search(line)
    if not named:
        return "", 0
    m = _SIGNATURE.match(text, at)
    if m and name in m.groups():
        return next(x for x, _ in _SIGNATURES if m.group(f"n_{x}")), at + named.end()
    # A header over several lines: the name is followed by its parameters, or by what it is set to.
    rest = text[at + named.end() : at + named.end() + 400].lstrip()
    if re.search(r"\bdef\b", line[: named.start()]):
        return "def", at + named.end()
    return "typed" if rest[:1] in ("(", "<") else "arrow" if re.match(r"(?::[^=]+)?=\s*(?:async\b\s*)?(?:\(|\w+\s*=>|function\b)", rest) else "", at + named.end()


def definitions(path: str, text: str | None, wanted: list[tuple[str, int]]) -> list[tuple[str, str, str] | None]:
    """(signature, comment, code) of each wanted (name, line), None for those that do not stand there; a null or empty file
    has none. A byte order mark and carriage returns are no part of the lines. The shape of the definition, not the
    extension alone, says how its body ends."""
    text = (text or "").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    lines, family, masks = text.split("\n"), _family(path), {}
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    out: list[tuple[str, str, str] | None] = []
    for name, number in wanted:
        line = lines[number - 1] if 0 < number <= len(lines) else ""
        at = starts[number - 1] if line else 0
        shape, after = _shape(text, at, line, name) if line else ("", 0)
        if not shape:
            out.append(None)
            continue
        kind = ("py" if line.rstrip().endswith((":", "(", ",")) or family == "py" else "rb") if shape == "def" else "c" if family in ("py", "rb") else family
        if kind not in masks:
            masks[kind] = blanked(text, kind)
        masked, stop = masks[kind], at + len(line)
        if kind == "py":
            head = _python_head(masked, after)
            end = _python_end(masked, at, head) if head >= 0 else stop
            comment, head = _inside(text, masked, head), head - 1 if head >= 0 else stop
        elif kind == "rb":
            head, end, comment = stop, _ruby_end(masked, at + len(line) - len(line.lstrip())), _above(lines, number - 1, True)
        else:
            head, end = _brace_end(masked, after, shape == "arrow" and "function" not in masked[after : after + 40])
            comment = _above(lines, number - 1, False)
        out.append((re.sub(r"\s+", " ", text[at:head]).strip(), comment, text[at:end].rstrip()))
    return out


_MARKS = re.compile(r"^\s*(?:/\*\*?|\*/|\*(?!\w)|//[/!]?|#+)\s?|\s*\*/\s*$")
_QUOTES = re.compile(r"^\s*[rRuUbB]{0,2}(?:\"\"\"|''')|(?:\"\"\"|''')\s*$")
_TAG = re.compile(r"^\s*(?:[@\\:](?:param|parameter|arg|argument|returns?|rtype|type|raises?|throws?|yields?|exception|since|author|see|version|deprecated|template|tparam|internal)\b(?:\s*\{[^}]*\})?:?|-\s)\s*(.*)$", re.I)
_NAMED = re.compile(r"^\s*\$?[\w*&]+\s*:\s*(?:see (?:the )?type\.?)?\s*$", re.I)
_CODE = re.compile(
    r"^\s*(?:(?:let|var|const|int|long|float|double|auto|final|my|local)\s+[\w$\[\]<>]+(?:\s*:\s*\w+)?\s*[:=]?=?.*;?|\$?[\w.$\[\]>-]+\s*(?:[-+*/|&%]|:|\?\?|\|\|)?=(?!=)\s*\S.*|return\b[^.]*;?|(?:if|while|for|switch|elif|foreach|unless|until|match|catch)\b.*[({:;]\s*$|(?:if|while|for|switch)\s*\(.*|(?:else|try|finally|do|begin|end|default:|break|continue|pass)\b\s*[{:;]?|[\w.:$>!-]+\(.*\)\s*;?\s*\{?|(?:import|use|from|require|include|package|using)\s+[\w.:\\/\"'*{}, ]+;?|[{}()\[\];,]+|(?:public|private|protected|static)\s.*[{;]\s*|(?:def|func|fn|function|class|struct|impl)\s+\w+.*[({:]\s*.*)\s*$"
)
_PIECES = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+")


def plain(comment: str) -> list[str]:
    """The comment's lines without marks and quotes, empty ones left out."""
    text = comment.strip()
    text = _QUOTES.sub("", text) if text[:4].lstrip("rRuUbB")[:3] in ('"""', "'''") or text[-3:] in ('"""', "'''") else text
    out = []
    for line in text.replace("\r", "").split("\n"):
        previous = None
        while previous != line:
            previous, line = line, _MARKS.sub("", line, count=1)
        if line.strip():
            out.append(line.strip())
    return out


def _pieces(text: str) -> list[str]:
    return [x.lower() for x in _PIECES.findall(text)]


def _stem(word: str) -> str:
    for end in ("ing", "es", "ed", "s", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def trivial(comment: str | None, name: str | None, params: str | None = None, owner: str | None = None) -> bool:
    """Whether a comment says nothing of its own: it is empty, a marker, a stock phrase, the name again, tags without a
    description, or source code in a comment."""
    lines = plain(comment or "")
    kept, described = [], 0
    for line in lines:
        tag = _TAG.match(line)
        if tag:
            rest = re.sub(r"^\$?[\w*&.,]+\s*:?\s*(?:-\s*)?", "", tag.group(1)) if not re.match(r"\s*[@\\:]returns?", line, re.I) else tag.group(1).lstrip(": ")
            described += len([w for w in _pieces(rest) if w not in NO_CONTENT and w not in ("type", "value", "parameter", "argument", "result")]) >= 2
        elif not _NAMED.match(line):
            kept.append(line)
    if kept and all(_CODE.match(x) for x in kept):
        kept = []
        if not described:
            return True
    known = {_stem(x) for x in _pieces(name or "")} | {_stem(x) for x in _pieces(owner or "")}
    words = [w for line in kept for w in _pieces(line) if not w.isdigit()]
    new = [w for w in words if len(w) > 1 and w not in NO_CONTENT and _stem(w) not in known]
    return not new and not described


def documented_functions(functions: DataFrame, files: DataFrame) -> DataFrame:
    """``path, owner, name, params, line_number, signature, documentation, code`` of the functions whose documentation is
    not trivial.

    The documentation is the docstring or, where that is null or empty, the comment attached to the definition in the
    file. Repeated rows count once, of differing ones the longest docstring stands. Null owners count as ''; rows without
    a path or a name are left out. Signature and code are null where the definition does not stand in the file.
    """
    keyed = (
        functions.where("path is not null and name is not null")
        .groupBy("path", F.coalesce("owner", F.lit("")).alias("owner"), "name")
        .agg(F.max(F.struct(F.length(F.trim(F.coalesce("docstring", F.lit("")))).alias("n"), "docstring", "params", "line_number")).alias("f"))
        .select("path", F.struct("owner", "name", "f.params", F.col("f.line_number").cast("int").alias("line_number"), "f.docstring").alias("f"))
    )
    # The functions of one file, as many as it has.
    listed = keyed.groupBy("path").agg(F.collect_list("f").alias("listed"))
    spark = files.sparkSession
    parts = max(2 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = files.where("path is not null and content is not null").select("path", "content").repartition(parts, "path").dropDuplicates(["path"])

    def judge(paths: list, texts: list, lists: list) -> list:
        out = []
        for path, text, own in zip(paths, texts, lists, strict=True):
            found = definitions(path, text, [(f["name"], f["line_number"] or 0) for f in own])
            for f, d in zip(own, found, strict=True):
                signature, comment, code = d or (None, None, None)
                document = f["docstring"] if (f["docstring"] or "").strip() else comment
                if not trivial(document, f["name"], f["params"], f["owner"]):
                    out.append((path, f["owner"], f["name"], f["params"], f["line_number"], signature, "\n".join(plain(document)), code))
        return out

    joined = listed.join(source, "path", "left").select("path", "content", "listed")
    return map_lists(joined, judge, "path string, owner string, name string, params string, line_number int, signature string, documentation string, code string")


def pairs(functions: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """Code and description of each documented function that stands in its file, with the unit's signature where it has one."""
    known = units.where("signature is not null and trim(signature) <> ''").groupBy("unit_id").agg(F.max_by("signature", F.struct("indexed_at", "signature")).alias("unit_signature"))
    found = documented_functions(functions, files).where("code is not null")
    unit_id = F.concat(F.col("path"), F.lit(":"), F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat_ws(".", "owner", "name")))
    return (
        found.withColumn("unit_id", unit_id).join(known, "unit_id", "left")
        .select("unit_id", "path", "owner", "name", "params", F.regexp_replace(F.trim(F.coalesce("unit_signature", "signature")), r"\s+", " ").alias("signature"), "documentation", "code")
    )
