"""Declarations, functions, imports and calls read from source text with built-in regular expressions, one row for each
construct. Lines are the unit; what goes on over lines (import blocks, parameter lists, the class around a method) is
carried by windows over a file's lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcode.functions import paths
from loomcode.operators.text_search import lines

# Java regular expressions of one-line constructs, by language; group 1 is the name.
_MODIFIERS = r"(?:(?:export|default|public|private|protected|static|final|abstract|async|pub(?:\([^)]*\))?|unsafe|const|inline|extern|sealed|data|override|virtual|open)\s+)*"
CLASSES = {
    "python": r"^class\s+(\w+)\s*[:(\[]", "javascript": rf"^{_MODIFIERS}class\s+(\w+)", "typescript": rf"^{_MODIFIERS}(?:class|enum)\s+(\w+)", "java": rf"^{_MODIFIERS}(?:class|enum|record)\s+(\w+)",
    "go": r"^type\s+(\w+)\s+struct\b", "rust": rf"^{_MODIFIERS}(?:struct|enum)\s+(\w+)", "c": r"^(?:typedef\s+)?struct\s+(\w+)\s*\{", "ruby": r"^class\s+(\w+)", "php": rf"^{_MODIFIERS}class\s+(\w+)",
    "kotlin": rf"^{_MODIFIERS}(?:class|object)\s+(\w+)", "csharp": rf"^{_MODIFIERS}(?:class|struct|record)\s+(\w+)", "cpp": r"^(?:template\s*<.*>\s*)?(?:class|struct)\s+(\w+)",
}
INTERFACES = {
    "typescript": rf"^{_MODIFIERS}interface\s+(\w+)", "java": rf"^{_MODIFIERS}interface\s+(\w+)", "go": r"^type\s+(\w+)\s+interface\b", "rust": rf"^{_MODIFIERS}trait\s+(\w+)",
    "ruby": r"^module\s+(\w+)", "php": r"^(?:interface|trait)\s+(\w+)", "kotlin": rf"^{_MODIFIERS}interface\s+(\w+)", "csharp": rf"^{_MODIFIERS}interface\s+(\w+)",
}
IMPORTS = {
    "python": r"^(?:from|import)\s+(\.+|\.*\w+(?:\.\w+)*)(?:\s+import\b.*|\s+as\s+\w+[^\"'{]*|\s*[,#][^\"'{]*)?$", "javascript": r"^import\b.*?[\"']([^\"']+)[\"']|^(?:const|let|var)\b.*\brequire\([\"']([^\"']+)[\"']\)", "typescript": r"^import\b.*?[\"']([^\"']+)[\"']|^(?:const|let|var)\b.*\brequire\([\"']([^\"']+)[\"']\)",
    "java": r"^import\s+(?:static\s+)?([\w.*]+)\s*;", "go": r"^import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", "rust": r"^(?:pub\s+)?use\s+([\w:]+)(?:\{.*|\*|\s+as\s.*)?;?$", "c": r"^#\s*include\s*[<\"]([^>\"]+)[>\"]", "cpp": r"^#\s*include\s*[<\"]([^>\"]+)[>\"]",
    "ruby": r"^require(?:_relative)?\s*\(?[\"']([^\"']+)[\"']", "php": r"^use\s+(?:function\s+|const\s+)?(\w+(?:\\\w+)+|\w+)(?:\\?\{.*|\s+as\s.*)?;", "kotlin": r"^import\s+([\w.*]+)", "csharp": r"^using\s+(?:static\s+)?([\w.]+)\s*;",
}
#: Imports of a name out of a module, or of a file of this project.
FROM_IMPORTS = r"^from\s|^import\s+static\s|^import\s*(?:type\s*)?\{|^require_relative\b|^#\s*include\s*<"
BASES = r"(?:\bextends\s+([\w.<>]+(?:\s*,\s*[\w.<>]+)*)|^class\s+\w+\s*\(([^)]*)\)|^class\s+\w+\s*<\s*([\w:]+))"
CALL = r"([A-Za-z_][\w.]*)\s*\("
#: Heads of functions whatever the file's extension says: what stands before the name, and what follows it.
_HEAD = r"(?:(?:export|default|public|private|protected|static|final|abstract|async|override|virtual|inline|extern|synchronized|native|const|unsafe|pub(?:\([^)]*\))?)\s+)*"
FUNCTIONS = (
    r"^\s*(?:async\s+)?def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[\[(]", rf"^\s*{_HEAD}fn\s+([A-Za-z_]\w*)", rf"^\s*{_HEAD}function\s*[&*]?\s*([A-Za-z_$][\w$]*)\s*[<(]",
    rf"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^=]+)?=>",
    rf"^\s*{_HEAD}(?:[A-Za-z_][\w.]*(?:<[^;()={{}}]*>)?(?:\[\])*[\s*&]+)*([A-Za-z_$][\w$]*)\s*\([^;{{}}]*\)[^;{{}}=]*\{{\s*(?:.*\}})?\s*$",
)
NO_FUNCTIONS = "if for foreach while switch catch return else do match elif unless until new throw function with synchronized await case".split()
#: Heads of what owns methods: classes and the like, and implementations.
OWNERS = rf"^\s*{_HEAD}(?:class|interface|trait|enum|struct|record|module|object)\s+([A-Za-z_]\w*)|^impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)"
RECEIVER = r"^func\s+\(\s*(?:\w+\s+)?\*?\s*(\w+)"
#: Imports over several lines: what opens one, a line inside that names a module, and what ends it.
OPENS = {"go": r"^import\s*\($", "javascript": r"^(?:import|export)\s+(?:type\s+)?\{[^}\"']*$", "typescript": r"^(?:import|export)\s+(?:type\s+)?\{[^}\"']*$", "python": r"^from\s+\.*[\w.]+\s+import\s*\([^)]*$", "rust": r"^(?:pub\s+)?use\s+[\w:]+\{[^}]*$"}
MEMBER = {"go": r"^(?:[\w.]+\s+)?\"([^\"]+)\"", "javascript": r"^[^\"']*\}\s*from\s*[\"']([^\"']+)[\"']", "typescript": r"^[^\"']*\}\s*from\s*[\"']([^\"']+)[\"']"}
CLOSES = r"^[)}]|[)}]\s*;?\s*$|\bfrom\s*[\"']"
#: The list of names that an import brings in, by language.
NAMED = {
    "python": r"^from\s+\S+\s+import\s+\(?([^)#;]*)|^import\s+([^#;]*)", "javascript": r"^import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]*)\}|^import\s+((?:\*\s+as\s+)?[\w$]+)\s+from", "typescript": r"^import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]*)\}|^import\s+((?:\*\s+as\s+)?[\w$]+)\s+from",
    "java": r"^import\s+(?:static\s+)?[\w.]*?\.?([\w*]+)\s*;", "rust": r"^(?:pub\s+)?use\s+[\w:]*?\{([^}]*)\}|^(?:pub\s+)?use\s+(?:\w+::)*(\w+(?:\s+as\s+\w+)?)\s*;", "php": r"^use\s+(?:function\s+|const\s+)?(?:\w+\\)*(\w+(?:\s+as\s+\w+)?)\s*;", "kotlin": r"^import\s+(?:\w+\.)*(\w+(?:\s+as\s+\w+)?)", "go": r"^import\s+([\w.]+)\s+\"",
}
NO_CALLS = "if for while switch match catch return function def func fn class except elif unless until and or not in is new await async sizeof assert super typeof yield lambda print println printf isset array list foreach echo include require".split()
# End of the fixed values.


def _by_language(patterns: dict[str, str], language: Column, build) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in patterns.items():
        out = out.when(language == name, build(pattern))
    return out


def _first_group(line: Column):
    def build(pattern: str) -> Column:
        if pattern.count("([^\"']+)") == 2:
            return F.coalesce(F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")), F.regexp_extract(line, pattern, 2))
        return F.regexp_extract(line, pattern, 1)

    return build


#: Words of which a declaration or an import line has one: a cheap test before the expressions of each language.
DECLARING = "class struct enum interface trait module object record".split()
IMPORTING = "import from require use include using".split()


def _with(source: DataFrame, words: list[str]) -> DataFrame:
    """Lines that hold one of the words."""
    return source.where(reduce(lambda a, b: a | b, [F.col("line").contains(w) for w in words]))


def _without_blocks(content: Column, mark: str) -> Column:
    """The text with the strings between two of the marks emptied of all but their line ends."""
    parts = F.transform(F.split(content, mark), lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, r"[^\n]", "")).otherwise(x))
    return F.when(content.contains(mark), F.array_join(parts, mark)).otherwise(content)


def source_lines(files: DataFrame, block_strings: bool = True) -> DataFrame:
    """``path, language, line_no, line`` of each distinct file in a known language; comment lines are left out, and what
    stands in strings over several lines too if asked for."""
    if not block_strings:
        files = files.withColumn("content", _without_blocks(_without_blocks(F.col("content"), '"""'), "'''"))
    once = files.where("path is not null and content is not null").select("path", "content").distinct()
    text = lines(once.withColumn("content", F.regexp_replace("content", "^\\x{FEFF}", "")), "path", "content").withColumn("language", paths.detect_language(F.col("path"))).where("language <> ''")
    return text.where(~F.ltrim("line").rlike(r"^(?://|\*|/\*)") & ~((F.col("language").isin("python", "ruby", "php")) & F.ltrim("line").startswith("#"))).select("path", "language", "line_no", "line")


def declarations(source: DataFrame) -> DataFrame:
    """``path, line_no, kind, name, bases``: classes (structs and enums too) and interfaces (traits and modules too) that
    start a line, nested ones too; the bases as text, joined by commas."""
    line, language = F.col("line"), F.col("language")
    found = _with(source, DECLARING).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).withColumn("class", _by_language(CLASSES, language, _first_group(line))).withColumn("interface", _by_language(INTERFACES, language, _first_group(line)))
    kind = F.when(F.coalesce("class", F.lit("")) != "", "class").when(F.coalesce("interface", F.lit("")) != "", "interface")
    bases = F.concat_ws("", F.regexp_extract("line", BASES, 1), F.regexp_extract("line", BASES, 2), F.regexp_extract("line", BASES, 3))
    return found.withColumn("kind", kind).where("kind is not null").select("path", "line_no", "kind", F.when(F.col("kind") == "class", F.col("class")).otherwise(F.col("interface")).alias("name"), F.regexp_replace(bases, r"\s+", "").alias("bases"))


def _import_heads(source: DataFrame) -> DataFrame:
    """The lines that begin as an import does, without the space around them: two cheap tests before all other patterns."""
    begins = F.col("line").rlike(r"^\s*(?:(?:import|export|from|use|pub|require|require_relative|using|const|let|var)\b|#\s*include)")
    return _with(source, IMPORTING).where(begins).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))


def imports(source: DataFrame) -> DataFrame:
    """``path, line_no, module, is_from`` of each import: in one line, whatever its indentation, or over several (the lines of
    a block that name a module, each with its own number)."""
    heads = _import_heads(source)
    # The forms exclude each other, so a file with a wrong extension keeps its imports.
    module = F.coalesce(*[F.nullif(_first_group(F.col("line"))(p), F.lit("")) for p in dict.fromkeys(IMPORTS.values())])
    single = heads.withColumn("module", module).where("module is not null").select("path", "line_no", "module", F.col("line").rlike(FROM_IMPORTS).alias("is_from"))
    opens = _matches(OPENS)
    # Only files that open a block are sorted by their lines.
    opened = heads.where(F.col("language").isin(list(MEMBER)) & opens).select("path").distinct()
    several = source.join(opened, "path", "left_semi").withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(opens, F.lit(True)).when(F.col("line").rlike(CLOSES), F.lit(False))
    inside = several.withColumn("open", F.last(state, True).over(w)).withColumn("module", _by_language(MEMBER, F.col("language"), lambda p: F.regexp_extract("line", p, 1))).where("open and module <> ''")
    return single.unionByName(inside.select("path", "line_no", "module", (F.col("language") != "go").alias("is_from")))


def imported_names(source: DataFrame) -> DataFrame:
    """``path, line_no, name, alias`` of each name that an import line brings in; the alias is the name without one. The names
    of a list over several lines belong to the line that opens it."""
    w = Window.partitionBy("path").orderBy("line_no")
    heads = _import_heads(source)
    listed = source.join(heads.where(_matches(OPENS)).select("path").distinct(), "path", "left_semi").withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).withColumn("at", F.last(F.when(_matches(OPENS), F.col("line_no")), True).over(w))
    ended = F.max(F.when((F.col("line_no") > F.col("at")) & F.col("line").rlike(CLOSES), 1).otherwise(0)).over(Window.partitionBy("path", "at").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    # A list is as long as one statement.
    joined = listed.where("at is not null").withColumn("ended", ended).where("coalesce(ended, 0) = 0 and language <> 'go'").groupBy("path", "language", F.col("at").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("line"))
    whole = heads.where(~_matches(OPENS)).select("path", "language", "line_no", "line").unionByName(joined)
    groups = _by_language(NAMED, F.col("language"), lambda p: F.concat(F.regexp_extract("line", p, 1), F.regexp_extract("line", p, 2) if p.count("|^") else F.lit("")))
    each = whole.withColumn("names", groups).where("names <> ''").select("path", "line_no", F.explode(F.split("names", ",")).alias("n")).withColumn("n", F.trim("n"))
    name = F.regexp_extract("n", r"^(\*|[\w$.]+)", 1)
    return each.select("path", "line_no", name.alias("name"), F.coalesce(F.nullif(F.regexp_extract("n", r"\bas\s+([\w$]+)$", 1), F.lit("")), name).alias("alias")).where("name <> ''").distinct()


def _matches(patterns: dict[str, str]) -> Column:
    return reduce(lambda a, kv: a | ((F.col("language") == kv[0]) & F.col("line").rlike(kv[1])), patterns.items(), F.lit(False))


def functions(source: DataFrame) -> DataFrame:
    """``path, line_no, owner, name, params, is_async`` of each function or method with a body, whatever the extension says
    of the language.

    The owner is the receiver's type, else the class around it: the last head of a class or of an outer function above it
    decides, if that is a class and further out; '' at the top. Parameters go from the name to the closing parenthesis,
    over as many lines as they take.
    """
    line = F.col("line")
    word = F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in FUNCTIONS])
    name = F.when(~line.rlike(r"^\s*(?:return|else|new|throw|await|case|yield)\b") & ~word.isin(NO_FUNCTIONS), word)
    owner = F.coalesce(F.nullif(F.regexp_extract(line, OWNERS, 1), F.lit("")), F.nullif(F.regexp_extract(line, OWNERS, 2), F.lit("")))
    marked = source.withColumn("name", name).withColumn("class", F.when(F.col("name").isNull(), owner)).withColumn("indent", F.length(F.regexp_extract(F.regexp_replace("line", "\t", "    "), "^( *)", 1)))
    w = Window.partitionBy("path").orderBy("line_no")
    scope = F.when(F.col("class").isNotNull(), F.struct("class", "indent")).when(F.col("name").isNotNull() & (F.col("indent") == 0), F.struct(F.lit(None).cast("string").alias("class"), "indent"))
    around = F.last(scope, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    balance = F.length(F.regexp_replace("line", r"[^(]", "")) - F.length(F.regexp_replace("line", r"[^)]", ""))
    t = marked.withColumn("around", around).withColumn("head", F.last(F.when(F.col("name").isNotNull(), F.col("line_no")), True).over(w)).withColumn("balance", balance)
    # A header goes on while its parentheses are open; its lines are joined, as many as the parameters take.
    own = Window.partitionBy("path", "head").orderBy("line_no")
    t = t.withColumn("open", F.sum("balance").over(own.rowsBetween(Window.unboundedPreceding, -1))).withColumn("least", F.min(F.coalesce("open", F.lit(1))).over(own))
    wrapped = t.where("head is not null and line_no > head and least > 0").groupBy("path", F.col("head").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("text")))), lambda x: x["text"]), " ").alias("more"))
    heads = t.where("name is not null").join(wrapped, ["path", "line_no"], "left").withColumn("whole", F.concat_ws(" ", F.trim("line"), "more"))
    after = F.substring(F.col("whole"), F.position(F.col("name"), F.regexp_replace("whole", r"^func\s+\([^)]*\)", "")) + F.length(F.regexp_extract("whole", r"^(func\s+\([^)]*\))", 1)) + F.length("name"), F.length("whole"))
    params = F.regexp_extract(after, r"^[^(]*?(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))", 1)
    receiver = F.regexp_extract("line", RECEIVER, 1)
    inside = F.when(F.col("around.class").isNotNull() & (F.col("indent") > F.col("around.indent")), F.col("around.class"))
    return heads.select("path", "line_no", F.coalesce(F.nullif(receiver, F.lit("")), inside, F.lit("")).alias("owner"), "name", F.when(params.isin("", "(void)"), "()").otherwise(params).alias("params"), F.col("line").rlike(r"\basync\b").alias("is_async")).distinct()


def call_sites(source: DataFrame) -> DataFrame:
    """``path, line_no, base, name, call_type``: the calls of indented lines; of a dotted call the last part is the name.

    The type is method for calls on self or this, attribute for others with a base, and local for bare names; strings are
    no code. Each name counts once in a line.
    """
    bare = F.regexp_replace("line", r"\"[^\"]*\"|'[^']*'|`[^`]*`", " ")
    calls = source.where(F.col("line").rlike(r"^\s")).select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(CALL), 1))).alias("call"))
    split = calls.withColumn("name", F.regexp_extract("call", r"([^.]*)$", 1)).withColumn("base", F.regexp_replace("call", r"\.?[^.]*$", ""))
    kind = F.when(F.col("base").isin("self", "this", "cls"), "method").when(F.col("base") != "", "attribute").otherwise("local")
    return split.where((F.col("name") != "") & ~F.col("name").isin(NO_CALLS)).select("path", "line_no", "base", "name", kind.alias("call_type"))


def same_file_edges(sites: DataFrame, table: DataFrame, functions: DataFrame) -> DataFrame:
    """``func, callee, n_sites``: calls inside a function's lines of names that its own file defines."""
    where = table.select(F.col("func"), F.split_part("func", F.lit(":"), F.lit(1)).alias("path"), "line_no")
    own = functions.select("path", F.col("name").alias("callee")).distinct()
    inside = sites.withColumnRenamed("name", "callee").join(where, ["path", "line_no"])
    return inside.join(own, ["path", "callee"], "left_semi").groupBy("func", "callee").agg(F.count("*").alias("n_sites"))
