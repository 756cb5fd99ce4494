"""Code units: latest states, signatures, embedding text, summaries, compact projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Standard-library modules that are no dependency of note; prefix of a signature by language.
STDLIB = (
    "os sys re json time datetime math random collections itertools functools typing pathlib logging io subprocess threading asyncio abc copy dataclasses enum fmt errors strings strconv context sync net http fs path util events std"
).split()
PREFIX = {"python": "def", "go": "func", "javascript": "function", "typescript": "function", "rust": "fn", "ruby": "def", "php": "function"}
# End of the fixed values.
CUT = 200


def latest_units(units: DataFrame) -> DataFrame:
    """One row for each unit: its last indexed state. Exact repetitions fall together; rows without an id are left out.

    Of states with the same time the greater row stands, so the choice doesn't depend on the order of the rows.
    """
    order = F.struct("indexed_at", F.coalesce(F.array_join("dependencies", "\x01", "\x02"), F.lit("")).alias("d"), F.coalesce("signature", F.lit("")).alias("s"))
    rest = F.struct(*[F.col(c) for c in units.columns if c != "unit_id"])
    return units.where("unit_id is not null").groupBy("unit_id").agg(F.max_by(rest, order).alias("r")).select("unit_id", "r.*")


def strip_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def signature_prefix(language: Column) -> Column:
    pairs = [F.lit(x) for kv in PREFIX.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), language), F.lit("def"))


def function_signature(language: Column, owner: Column, name: Column, params: Column, returns: Column) -> Column:
    """The signature as its language writes it; methods carry their owner's name, Go ones as a receiver."""
    p = F.when(strip_spaces(params) == "", "()").otherwise(strip_spaces(params))
    r = strip_spaces(returns)
    own = F.coalesce(owner, F.lit(""))
    qualified = F.when((own != "") & (language != "go"), F.concat(own, F.lit("."), name)).otherwise(name)
    receiver = F.when((own != "") & (language == "go"), F.concat(F.lit("("), own, F.lit(") "))).otherwise("")
    arrow = F.when(r == "", "").when(language.isin("python", "rust"), F.concat(F.lit(" -> "), r)).when(language.isin("typescript", "javascript", "php"), F.concat(F.lit(": "), r)).otherwise(F.concat(F.lit(" "), r))
    return F.concat(signature_prefix(language), F.lit(" "), receiver, qualified, p, arrow)


def class_signature(language: Column, name: Column, bases: Column) -> Column:
    """``class A(B, C)``, ``type A struct`` or ``class A extends B`` (the first base only)."""
    some = F.coalesce(F.size(bases), F.lit(0)) > 0
    python = F.concat(F.lit("class "), name, F.when(some, F.concat(F.lit("("), F.array_join(bases, ", "), F.lit(")"))).otherwise(""))
    other = F.concat(F.lit("class "), name, F.when(some, F.concat(F.lit(" extends "), F.get(bases, F.lit(0)))).otherwise(""))
    return F.when(language == "go", F.concat(F.lit("type "), name, F.lit(" struct"))).when(language == "python", python).otherwise(other)


def interface_signature(name: Column, methods: Column) -> Column:
    return F.concat(F.lit("interface "), name, F.lit(" { "), F.array_join(methods, ", "), F.lit(" }"))


def shortened(text: Column, length: int = CUT) -> Column:
    """The first characters, followed by three dots if something was cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def embedding_text(units: DataFrame) -> DataFrame:
    """``unit_id, text``: what is embedded of a unit, one line for each part that isn't empty."""

    def part(label: str, value: Column) -> Column:
        v = F.coalesce(value, F.lit(""))
        return F.when(v != "", F.concat(F.lit(f"{label}: "), v))

    def listed(column: str) -> Column:
        return shortened(F.array_join(F.array_compact(column), ", "))

    text = F.concat_ws(
        "\n",
        F.concat(F.initcap(F.coalesce("type", F.lit("unit"))), F.lit(": "), F.coalesce("name", F.lit(""))),
        part("Signature", strip_spaces(F.col("signature"))), part("Description", F.trim("docstring")), part("Calls", listed("calls")), part("Called by", listed("called_by")),
        part("Dependencies", F.array_join(F.array_compact("dependencies"), ", ")), part("Control flow", F.col("cfg_summary")), part("Data flow", F.col("dfg_summary")),
    )
    return units.select("unit_id", text.alias("text"))


def significant_dependencies(units: DataFrame, keep: int = 5) -> DataFrame:
    """``unit_id, deps``: the first dependencies that are neither relative nor of the standard library, each once."""
    clean = F.filter(F.transform("dependencies", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "") & ~x.startswith(".") & ~x.isin(STDLIB))
    return units.select("unit_id", F.array_join(F.slice(F.array_distinct(clean), 1, keep), ",").alias("deps"))


def estimated_tokens(text: Column) -> Column:
    return F.coalesce(F.floor(F.octet_length(text) / 4), F.lit(0))


def compact_modules(modules: DataFrame, functions: DataFrame) -> DataFrame:
    """``file, doc, n_imports, functions``: a module in short, with its functions' names in order of their lines.

    The documentation is cut to 200 characters; imports count once without the spaces around them. Modules without a file
    are left out, of repeated rows the greatest documentation stands.
    """
    imports = F.array_distinct(F.filter(F.transform("imports", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    once = modules.where("file is not null").groupBy("file").agg(F.max(F.substring(F.coalesce("doc", F.lit("")), 1, CUT)).alias("doc"), F.max(F.coalesce(F.size(imports), F.lit(0))).alias("n_imports"))
    named = functions.select(F.col("path").alias("file"), "line_number", "owner", "name").distinct()
    lists = named.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_number", "name"))).alias("f"))
    return once.join(lists, "file", "left").select("file", "doc", "n_imports", F.coalesce(F.array_join(F.transform("f", lambda x: x["name"]), ","), F.lit("")).alias("functions"))


def summaries(units: DataFrame) -> DataFrame:
    """``unit_id, complexity, blocks, params, definitions``: the numbers in the flow summaries, null where they have none."""

    def number(column: str, label: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({column}, '{label}: (\\\\d+)', 1) as int)").alias(label)

    return units.select("unit_id", number("cfg_summary", "complexity"), number("cfg_summary", "blocks"), number("dfg_summary", "params"), number("dfg_summary", "definitions"))
