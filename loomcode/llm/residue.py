"""Template residue, filler, error pages and notices that scripts are needed.

Lines outside quoted code are masked (numbers, addresses, dates), equal masked lines are grouped by hash across documents
and sources, and each distinct message is classified once. Rules come in three strengths: a placeholder or an unmistakable
phrase counts wherever it stands; a bare status line counts if the message recurs widely or opens its document; the broad
rules, whose words stand in real text too, count only for messages that recur widely.

One Arrow pass looks for the rules' key words in all texts at once, which the built-in functions cannot do; masks, groups
and rules are built-in functions on what it finds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache, reduce

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcode.functions.arrow import map_lists
from loomcode.session import cut, spread

# The rules, as Java regular expressions.
#: Unfilled template fields, on the masked message with its letters as they stand.
PLACEHOLDERS = {
    "double_brace": r"\{\{\{?\s*[#/&>^]?[A-Za-z_][\w. |-]*\}?\}\}",
    "dollar_brace": r"\$\{[A-Za-z_][\w.]*\}",
    "single_brace": r"(?<![\w\"'$\\{=(\[])\{[A-Za-z_][\w.]*\}(?![\w\"'}=(\[])",
    "angle_percent": r"<%=?\s*[A-Za-z_][\w.]*\s*%>",
    "brace_percent": r"\{%-?\s*[A-Za-z_][\w. ]*-?%\}",
    "percent": r"%%[A-Za-z_][\w.]*%%",
    "at": r"@@[A-Za-z_][\w.]*@@",
    "angle": r"<<[A-Z][A-Z_. ]*>>",
    "underscore": r"(?<![\w])__[A-Z][A-Z0-9_]*__(?!\w)",
    "bracket": r"\[(?:INSERT|ENTER|ADD|YOUR|FILL IN|REPLACE|CHOOSE|SELECT|COMPANY|PLACEHOLDER|TBD|TODO)(?:[ _][A-Z][A-Z _]*)?\]",
}
#: What every placeholder holds.
PLACEHOLDER_MARKS = ("{", "[", "<%", "<<", "%%", "@@", "__")
_SCRIPTS = r"(?:javascript|scripts?|scripting|cookies)"
#: (text that every match holds at the start of a word, pattern) on the message in lower case: unmistakable wherever they stand.
PHRASES = {
    "filler": (
        ("lorem ipsum", r"\blorem ipsum (?!as\b|text\b|in\b|is\b|generator|for\b)\w+ \w+"), ("sample text", r"^sample text\b"), ("placeholder", r"\bplaceholder (?:copy|text)\b.*(?:will|real|replace|follow)"), ("goes here", r"\byour (?:text|content) goes here\b"),
        ("replace this", r"\breplace this (?:paragraph|text|section) with\b"), ("texte de remplissage", r"\btexte de remplissage\b"), ("texto de", r"\btexto de (?:ejemplo|relleno)\b.*(?:sustituir|reemplazar|publicar)"), ("blindtext", r"\b(?:ein|dies ist) blindtext\b"),
        ("coming soon", r"^[-*#> ]*\((?:[\w ]+ )?coming soon\)[.!]?$"), ("real content", r"\breal content will follow\b"), ("insert text", r"\binsert text here\b"), ("insert content", r"\binsert content here\b"),
    ),
    "script_notice": (
        ("script", rf"\b(?:please|must|need to|have to) (?:enable|activate|turn on|allow) scripts?(?:ing)?\b|^(?:enable|activate|turn on) scripts?(?:ing)?\b"), ("javascript", r"\b(?:please|must|need to|have to) (?:enable|activate|turn on|allow) javascript\b|^(?:enable|activate|turn on) javascript\b"),
        ("cookies", r"\b(?:please|must|need to|have to) (?:enable|activate|turn on|allow) cookies\b|^(?:enable|activate|turn on) cookies\b"), ("javascript", r"\bjavascript is (?:required|disabled in your|turned off|not enabled in your)\b(?!.*\bchecks?\b)"),
        ("javascript", r"\bonly be (?:shown|displayed|viewed) with javascript\b"), ("javascript", r"\b(?:requires?|needs?) javascript to (?:be enabled|run|work|view)"), ("javascript", r"\bactive[rz]?\s+(?:le )?javascript\b"), ("javascript", r"\bactivez\b.*\bjavascript\b"),
        ("javascript", r"\baktivieren sie (?:bitte )?javascript\b"), ("javascript", r"\bbrowser does not support javascript\b"), ("script", r"\bbrowser does not support scripts\b"), ("script", r"\bscript(?:ing|s) (?:is|are) (?:turned off|blocked|disabled)\b.*(?:will not|cannot|detected)"),
        ("javascript", r"\bjavascript (?:is|are) (?:turned off|blocked|disabled)\b.*(?:will not|cannot|detected)"), ("script", r"\bdetected that script(?:ing|s)\b|\bscript(?:ing|s) may be disabled\b"), ("javascript", r"\bdetected that javascript\b|\bjavascript may be disabled\b"),
    ),
    "error_page": (
        ("page you", r"\bpage you (?:requested|are looking for)\b.*\b(?:not be found|does not exist|cannot be found)\b"), ("can't find th", r"\bcan't find th(?:at|e|is) page\b"), ("cant find th", r"\bcant find th(?:at|e|is) page\b"), ("moved or deleted", r"\bit may have been moved or deleted\b"),
        ("permission to", r"\bdo not have permission to (?:view|access)\b"), ("this site", r"\bthis site can'?t be reached\b"), ("connection was", r"\bthe connection was (?:reset|refused|closed)\. err_\S+"), ("are you a robot", r"\bare you a robot\b"), ("server encountered", r"\bserver encountered an unexpected condition\b"),
        ("fatal error", r"^fatal error: "), ("parse error", r"^parse error: "), ("angeforderte seite", r"\bangeforderte seite\b"), ("seite nicht", r"^seite nicht gefunden\b"), ("dirección solicitada", r"\bdirección solicitada no existe\b"), ("página no", r"^página no encontrada\b"), ("page introuvable", r"^page introuvable\b"),
        ("erreur interne", r"\berreur interne est survenue\b"), ("zugriff verweigert", r"^zugriff verweigert\b"), ("session has", r"\bsession has expired\b.*\bsign in\b"), ("you are looking for", r"\byou are looking for is (?:disabled|private|unavailable|gone)\b"), ("page requested", r"\bpage requested is unavailable\b"),
    ),
}
_ENDED = "expired limited blocked suspended disabled removed deleted moved".split()
_ABLE = "completed found loaded processed reached displayed shown".split()
#: The same, but of words that real text uses too: only for short messages that recur widely and talk of nothing else.
BROAD = {
    "error_page": (
        *((f"did not {w}", rf"\bdid not {w}\b") for w in ("answer", "respond", "reply")), *((f"{c} be {w}", rf"\b{c} be {w}\b") for c in ("could not", "cannot", "can't") for w in _ABLE), *((f"has been {w}", rf"\bhas been {w}\b") for w in _ENDED), *((f"was {w}", rf"\bwas {w}\b") for w in ("reset", "refused", "denied")),
        *((w, rf"\b{w}\b") for w in ("timed out", "went wrong", "mistyped", "has expired", "unavailable", "maintenance", "be back shortly", "be back soon", "try again later", "try again in", "slow down", "under construction")), ("unexpected", r"\bunexpected (?:condition|error)\b"), ("edge node", r"^edge node\b"),
    ),
    "filler": (("coming soon", r"\bcoming soon\b"), ("tbd", r"^tbd[.!]?$"), ("placeholder", r"^placeholder\b"), ("goes here", r"\bgoes here\b")),
    "script_notice": (("javascript", r"\bjavascript\b.*\b(?:browser|enabled?|disabled|reload)\b"), ("script", r"\bscripts?(?:ing)?\b.*\b(?:disabled|blocked|turned off)\b"), ("cookies", r"\bcookies\b.*\b(?:enabled?|disabled|accept|allow)\b")),
}
#: A message that talks about such notices is none.
TALK = r"\b(?:our|we|i|test page|fixture|such as|for example|because|whenever|checks?|points to|logs?|logged|harmless|answered with)\b"
BROAD_WORDS = 16
_REASONS = r"(?:bad request|unauthorized|payment required|forbidden|not found|method not allowed|request time-?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
STATUS = rf"^(?:[\w. -]{{1,60}} \| )?(?:(?:error|http|status|http error)[ :]*)?(?:0\s*[-:|]*\s*)?{_REASONS}(?: ?\(0\))?(?:[.!]|\s*[-|].*)?$|^(?:error|http|status) 0(?:\s*[-:|].*)?$"
#: Status lines without a number, which need recurrence or the head of a document.
BARE_STATUS = rf"^(?:{_REASONS}|access denied|loading\.\.\.)[.!]?$"
STATUS_KEYS = ("bad request", "unauthorized", "payment required", "forbidden", "not found", "method not allowed", "request time", "conflict", "gone", "too many requests", "internal server error", "not implemented", "bad gateway", "service unavailable", "service temporarily", "gateway time", "access denied", "loading...")
STATUS_HEADS = ("error", "http", "status")
#: The customary filler passage, and words without which no sentence of the corpus' languages does.
FILLER_WORDS = "lorem ipsum dolor amet consectetur adipiscing eiusmod tempor incididunt magna aliqua".split()
FUNCTION_WORDS = "the of to and in is a an for with this that it on as are be or by der die das und ist ein eine zu mit den von el la los las de y en es un una que por le les des du une et est dans pour que".split()
# End of the fixed values.
#: A masked message recurs widely from so many documents and sources on.
RECURRING, RECURRING_SOURCES = 3, 2
#: Words in a row of which at most this share is distinct are filler.
REPETITION, REPETITION_WORDS = 0.4, 6


_NEWLINE = re.compile("\n")
_INLINE = re.compile(r"`[^`]*`")
_QUOTATION = re.compile(r"(?<![\w=])(?:\"[^\"]{1,120}\"|“[^”]{1,120}”|«[^»]{1,120}»|„[^“”]{1,120}[“”])")


def keys() -> list[str]:
    """The texts of which each phrase rule needs one, at the start of a word."""
    named = {k for rules in (*PHRASES.values(), *BROAD.values()) for k, _ in rules}
    return sorted(named | set(STATUS_KEYS) | set(FILLER_WORDS))


@cache
def _searcher() -> ahocorasick.Automaton:
    """Finds every key in one pass; the value says whether it counts anywhere, at the start of a word or of a line."""
    found = ahocorasick.Automaton()
    for where, words in (("line", STATUS_HEADS), ("word", keys()), ("any", PLACEHOLDER_MARKS)):
        for w in words:
            found.add_word(w, (where, len(w)))
    found.make_automaton()
    return found


def _repeats(line: str) -> bool:
    words = line.split()
    return len(words) >= REPETITION_WORDS and len(set(words)) <= REPETITION * len(words)


def _unquoted(line: str) -> str:
    """The line without inline code and short quotations: what these hold is shown, not meant."""
    return _QUOTATION.sub(" ` ", _INLINE.sub(" ` ", line)).strip()


def eligible_lines(text: str | None) -> list[tuple[int, str]]:
    """(number, line) of the lines outside fenced code that any rule could match, without what they quote.

    A line is eligible if it holds a key of the phrase rules, the first marks of a placeholder, or words over and over. This
    follows from the rules (each names its key), so it saves the rules' work and keeps no line from them.
    """
    low = (text or "").lower()
    starts, hits = [0, *(m.end() for m in _NEWLINE.finditer(low))], set()
    for end, (where, size) in _searcher().iter(low):
        begin = end + 1 - size
        if where == "any" or begin == 0 or not low[begin - 1].isalnum():
            at = bisect_right(starts, begin) - 1
            if where != "line" or not low[starts[at] : begin].strip(" \t\r"):
                hits.add(at)
    out, fence, first = [], "", None
    for at, line in enumerate((text or "").split("\n")):
        bare = line.strip()
        mark = bare.lstrip("> \t")[:3]
        if mark in ("```", "~~~") and fence in ("", mark):
            fence = "" if fence else mark
        elif not fence and bare:
            first = at if first is None else first
            if (at in hits or _repeats(low[starts[at] : starts[at] + len(line)])) and (shown := _unquoted(bare)):
                out.append((at - first, shown))
    return out


def mask(line: Column) -> Column:
    """Addresses, dates, long hex numbers and numbers masked; white space in single blanks; letters as they stand."""
    x = F.when(line.contains("http") | line.contains("www."), F.regexp_replace(line, r"\b(?:https?://|www\.)[^\s{}<>\[\]%@]+", "<url>")).otherwise(line)
    x = F.when(x.contains("@"), F.regexp_replace(x, r"[\w.+-]+@[\w-]+\.[\w.]+", "<mail>")).otherwise(x)
    numbers = F.regexp_replace(x, r"\b\d{1,4}[-./]\d{1,2}[-./]\d{1,4}\b(?:[Tt ]\d{1,2}:\d{2}(?::\d{2})?[Zz]?)?", "<date>")
    numbers = F.regexp_replace(numbers, r"\b[a-fA-F]{0,8}+\d[0-9a-fA-F]{5,}+\b", "0")
    x = F.when(x.rlike(r"\d"), F.regexp_replace(numbers, r"\d+(?:[.,]\d+)*", "0")).otherwise(x)
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _first(message: Column, rules: dict[str, tuple[tuple[str, str], ...]], start: Column | None = None) -> Column:
    pairs = [(name, "|".join(p for _, p in group)) for name, group in rules.items()]
    none = F.when(F.lit(False), "") if start is None else start
    return reduce(lambda a, kv: a.when(message.rlike(kv[1]), kv[0]), pairs, none)


def classify(message: Column) -> Column:
    """``strength, rule`` of a masked message (strength ``strict``, ``bare`` or ``broad``), or null.

    Text of the customary filler is known by its words together with the lack of function words.
    """
    lower = F.lower(message)
    words = F.array_remove(F.split(F.regexp_replace(lower, "<[a-z]+>", " "), r"[^\p{L}]+"), "")
    said = F.split(lower, " ")
    repeats = (F.size(said) >= REPETITION_WORDS) & (F.size(F.array_distinct(said)) <= REPETITION * F.size(said)) & F.size(F.array_distinct(words)).between(1, REPETITION_WORDS)
    sounds = (F.size(words) >= REPETITION_WORDS) & F.arrays_overlap(words, F.array(*map(F.lit, FILLER_WORDS))) & ~F.arrays_overlap(words, F.array(*map(F.lit, FUNCTION_WORDS)))
    bare = lower.rlike(BARE_STATUS)
    strict = _first(lower, PHRASES, F.when(message.rlike("|".join(PLACEHOLDERS.values())), "placeholder")).when(lower.rlike(STATUS) & ~bare, "error_page").when(repeats | sounds, "filler")
    broad = F.when((F.size(words) <= BROAD_WORDS) & ~lower.rlike(TALK), _first(lower, BROAD))
    verdict = lambda strength, rule: F.struct(F.lit(strength).alias("strength"), rule.alias("rule"))
    return F.when(strict.isNotNull(), verdict("strict", strict)).when(bare, verdict("bare", F.lit("error_page"))).when(broad.isNotNull(), verdict("broad", broad))


def classified_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, line, message, n_docs, n_sources, rule`` of each line that counts as residue; the counts are exact.

    Null and empty texts have no lines; a null source counts as a source of its own; texts of any length are taken whole.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    rows = spread(documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.lower(F.trim(source)), F.lit("")).alias("source"), F.col(text).alias("text")))

    def candidates(ids: list, sources: list, texts: list) -> list:
        return [(i, s, at, line) for i, s, t in zip(ids, sources, texts, strict=True) for at, line in eligible_lines(t)]

    lines = map_lists(rows, candidates, f"doc_id {kind}, source string, at int, line string").withColumn("message", mask(F.col("line"))).withColumn("hash", F.xxhash64("message"))
    # Eligible lines are a small part of all; they are written once and serve the messages and their places.
    lines = cut(lines)
    # A hot message is reduced to one row a task before the shuffle, and is classified once.
    messages = lines.groupBy("hash").agg(F.min("message").alias("message")).withColumn("verdict", classify(F.col("message"))).where("verdict is not null").select("hash", "verdict.*")
    ruled = cut(lines.join(messages, "hash"))
    per_doc = ruled.select("hash", "doc_id").distinct().groupBy("hash").agg(F.count("doc_id").alias("n_docs"))
    per_source = ruled.select("hash", "source").distinct().groupBy("hash").agg(F.count("source").alias("n_sources"))
    recurs = (F.col("n_docs") >= RECURRING) & (F.col("n_sources") >= RECURRING_SOURCES)
    counts = (F.col("strength") == "strict") | recurs | ((F.col("strength") == "bare") & (F.col("at") == 0))
    return ruled.join(per_doc, "hash").join(per_source, "hash").where(counts).select("doc_id", "line", "message", "n_docs", "n_sources", "rule")


def residue_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, rules, n_lines`` of the documents to leave out; the rules sorted and joined by commas."""
    return (
        classified_lines(documents).where(F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"), F.count("*").alias("n_lines"))
    )


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that remain."""
    return documents.join(residue_documents(documents).select("doc_id"), "doc_id", "left_anti")


def recurring_messages(documents: DataFrame) -> DataFrame:
    """``rule, message, n_lines, n_docs, n_sources`` for each masked message of the residue."""
    return (
        classified_lines(documents)
        .groupBy("rule", "message")
        .agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"), F.max("n_sources").alias("n_sources"))
    )
