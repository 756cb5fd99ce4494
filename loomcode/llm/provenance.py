"""Rules on one file's path, header comments and token composition: generated, minified, third-party, data."""

from __future__ import annotations

import re

# Directory names that hold copies of other projects, and phrases of headers.
VENDOR_DIRS = frozenset("vendor _vendor vendors node_modules bower_components third_party thirdparty third-party 3rdparty external externals bundled jspm_packages site-packages Pods Godeps".split())
GENERATED_NAME = re.compile(r"(?:^zz_generated[._]|\.pb\.|_pb2(?:_grpc)?\.|\.g\.|_gen\.|\.gen\.|\.generated\.|_generated\.|\.designer\.|\.pb\.gw\.)", re.I)
GENERATED_HEADER = re.compile(
    r"(?:code|file|source|class|module|this file|bindings?|stubs?)\s+(?:(?:is|was|has been|were)\s+)?(?:(?:auto[- ]?|automatically |machine[- ]?)\s?)?(?:re)?generated\s+(?:by|with|from|using)\b"
    r"|^@generated\b|<auto-?generated\b|^auto-?generated\b(?!\s+method)|\bautogenerated\s+(?:on\s+)?\S*\d|\bgenerated from \S+ by\b|machine-made\b.*\bregenerate\b|\boutput of \S+ v?\d.*\b(?:overwritten|edit)"
    r"|\b(?:do not|don't|never)\s+(?:edit|modify|change)\b.*\b(?:generated|hand|manually)\b|\bgenerated\b.*\b(?:do not|don't|never)\s+(?:edit|modify|change)\b|\bchanges (?:made here )?will be (?:lost|overwritten)\b|\bmanual (?:edits|changes) (?:are|will be) (?:lost|overwritten)\b",
    re.I,
)
HAND_HEADER = re.compile(r"\b(?:edited|written|maintained) (?:by hand|manually)\b|\bmanually (?:now|maintained|edited)\b|\bmaintained\b.*\bmanually\b|\bfiles? that \S+ generates?\b|\bnext door\b|\bold generated\b|\breplaces\b.*\bgenerated\b", re.I)
VENDORED_HEADER = re.compile(r"\bvendored (?:copy|from|source)\b|\bthird[- ]party source\b|\bimported verbatim from\b|\bupstream:\s*\S+.*\blocal changes\b|\bcopied (?:verbatim |unmodified )?from (?:the )?\S+ (?:distribution|project|library|package)\b|\bsend patches upstream\b|\bbundled with this repository\b", re.I)
OWNER_HEADERS = (
    re.compile(r"^copyright (?:\(c\) )?(?:\d{4} )?the ([\w.-]+) contributors\b", re.I),
    re.compile(r"^part of the ([\w.-]+) project\b", re.I),
    re.compile(r"^([\w.-]+) - internal source\b", re.I),
)
MINIFIED_LINE = 160
NUMBERED_SHARE = 0.3
# End of the fixed values.

_COMMENT = re.compile(r"^\s*(?:<\?php)?\s*(?://+!?|#+!?|/\*+!?|\*+(?!/)|--|<!--|;+|\"\"\"|''')\s?(.*?)\s*(?:\*+/|-->|\"\"\"|''')?\s*$")
_MARKS = frozenset("/#*-<;\"'")
# Comments and strings of one line are named so that marks in them open nothing; the group holds strings of several lines.
_PLAIN = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_SLASHES = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
_HEREDOC = r"<<<?[-~]?[ \t]*['\"]?(?P<tag>[A-Za-z_]\w*)['\"]?[^\n]*\n(?:.*\n)*?[ \t]*(?P=tag)\b"
_OPEN = r'"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\'\\]|\\[\s\S])*\''
_STRINGS = {
    "py": re.compile(r'#[^\n]*|(?P<s>"""(?:[^\\]|\\[\s\S])*?"""|\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\')|' + _PLAIN),
    "java": re.compile(_SLASHES + r'|(?P<s>"""(?:[^\\]|\\[\s\S])*?""")|' + _PLAIN),
    "js": re.compile(_SLASHES + r"|(?P<s>`(?:[^`\\]|\\[\s\S])*`)|" + _PLAIN),
    "go": re.compile(_SLASHES + r"|(?P<s>`[^`]*`)|" + _PLAIN),
    "c": re.compile(_SLASHES + "|" + _PLAIN),
    "rs": re.compile(_SLASHES + r'|(?P<s>r(?P<n>#*)"[\s\S]*?"(?P=n)|"(?:[^"\\]|\\[\s\S])*")|\'(?:[^\'\\\n]|\\[^\n]+)\''),
    "rb": re.compile(rf"#[^\n]*|(?P<s>{_HEREDOC}|{_OPEN})"),
    "php": re.compile(rf"{_SLASHES}|#[^\n]*|(?P<s>{_HEREDOC}|{_OPEN})"),
}
_STRINGS |= {"h": _STRINGS["c"]}
_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLfF]*(?!\w)|\\x[0-9a-fA-F]{2}')
_BLOB = re.compile(r'"[A-Za-z0-9+/=\\x-]{40,}"|\'[A-Za-z0-9+/=\\x-]{40,}\'')
_WORDS = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBERED = re.compile(r"_*(?:field|item|entry|col|column|member|prop|value|tag|arg|param|node|case|state|rule|opcode)_?[A-Za-z_]*?_?\d+(?:_NUMBER|_get|_set|_)?$|(?:[gs]et|has|clear|is)_?[A-Za-z_]*?\d+$", re.I)
_NO_COMMENT = re.compile(r"/\*(?:[^*]|\*(?!/))*\*/|^\s*(?://|#(?!include|define|ifdef|ifndef|endif|if )).*$", re.M)
_JSON = re.compile(r'\A\s*[\[{]\s*(?:"(?:[^"\\\n]|\\.)*"\s*:|[\[{"\d-]).*[\]}]\s*\Z', re.S)
_KEYED = re.compile(r"^[ \t]*[\w.-]+:(?=\s)", re.M)
_YAML = re.compile(r"\A(?:(?:#[^\n]*|---|[ \t]*[\w.-]+:(?:[ \t]+[^\n{};()=]*)?|[ \t]*-[ \t]+[^\n{};()=]*)?\n)+\Z")


def literal_lines(path: str, text: str) -> set[int]:
    """The lines, from 0, that begin inside a string of several lines: what looks like a comment there is none."""
    inside: set[int] = set()
    line = position = 0
    for m in _STRINGS.get(path.rsplit(".", 1)[-1].lower(), _STRINGS["js"]).finditer(text):
        if m.lastgroup and "\n" in m.group():
            line += text.count("\n", position, m.start())
            position = m.start()
            inside.update(range(line + 1, line + 1 + m.group().count("\n")))
    return inside


def comment_lines(text: str) -> list[tuple[int, str]]:
    """Number, from 0, and text without marks of each line of the file that begins with a comment mark; a notice may stand
    below a long licence or at the very end."""
    found = []
    for k, line in enumerate(text.split("\n")):
        # Every comment mark, and the start of PHP, begins with one of these.
        m = _COMMENT.match(line) if line.lstrip()[:1] in _MARKS else None
        if m and m.group(1):
            found.append((k, m.group(1)))
    return found


def by_path(path: str) -> str:
    parts = path.split("/")
    if any(p in VENDOR_DIRS for p in parts[1:-1]):
        return "third_party"
    if GENERATED_NAME.search(parts[-1]):
        return "generated"
    return ""


def _notice(repo: str, comment: str) -> str:
    kind = "third_party" if VENDORED_HEADER.search(comment) else "generated" if GENERATED_HEADER.search(comment) else ""
    if not kind:
        owners = (pattern.match(comment) for pattern in OWNER_HEADERS)
        kind = "third_party" if any(m and m.group(1).lower() != repo.lower() for m in owners) else ""
    return "" if kind and HAND_HEADER.search(comment) else kind


def by_header(path: str, text: str) -> str:
    """What the first notice among all comment lines of the file says."""
    repo = path.split("/", 1)[0]
    text = text.removeprefix("\ufeff").replace("\r", "")
    literal = None
    for k, comment in comment_lines(text):
        kind = _notice(repo, comment)
        if kind:
            # Few files have a notice at all, so strings are looked for only here.
            literal = literal_lines(path, text) if literal is None else literal
            if k not in literal:
                return kind
    return ""


def by_composition(path: str, text: str) -> str:
    """What the mix of tokens says: long dense lines, literals in bulk, or numbered accessors throughout."""
    text = text.removeprefix("﻿").replace("\r", "")
    code = _NO_COMMENT.sub("", text).removeprefix("<?php").strip()
    size = len(code)
    if size < 40:
        return ""
    lines = [x for x in code.split("\n") if x.strip()]
    blobs = sum(len(x) for x in _BLOB.findall(code))
    if blobs > 0.6 * size:
        return "data"
    without = _LITERAL.sub("0", code)
    literal = sum(len(m) for m in _LITERAL.findall(code))
    solid = size - sum(map(code.count, " \t\n,[](){}"))
    words = _WORDS.findall(without)
    if literal > 0.5 * solid and (count := len(_LITERAL.findall(code))) >= 12 and 4 * len(words) <= count:
        return "data"
    spaces = sum(map(without.count, " \t\n"))
    if size / len(lines) >= MINIFIED_LINE and spaces < 0.12 * len(without) and path.rsplit(".", 1)[-1] in ("js", "ts", "tsx", "jsx", "mjs", "cjs", "php", "c", "java", "go", "rs"):
        return "minified"
    if _JSON.match(code) and literal > 0.4 * solid and len(words) <= 3 or len(_KEYED.findall(text)) >= 4 and _YAML.match(text) and not path.endswith((".yml", ".yaml")):
        return "data"
    numbered = [w for w in words if _NUMBERED.match(w)]
    if len(numbered) >= 3 and len(numbered) > NUMBERED_SHARE * len([w for w in words if len(w) > 6]) and len(set(numbered)) * 6 >= len(numbered) and _counts_up(numbered):
        return "generated"
    return ""


def _counts_up(names: list[str]) -> bool:
    """Whether the numbers in the names are those of a running count."""
    numbers = {int(x) for n in names for x in re.findall(r"\d+", n)[-1:]}
    return max(numbers) <= 2 * len(numbers) + 2


def classify(path: str | None, text: str | None) -> tuple[str, str]:
    """(kind, evidence) of a file: kind is '', third_party, generated, minified or data. Null path or text has none but by the other."""
    path, text = path or "", text or ""
    for evidence, kind in (("path", by_path(path)), ("header", by_header(path, text)), ("tokens", by_composition(path, text))):
        if kind:
            return kind, evidence
    return "", ""
