"""Text cleaning, query normalisation and token arithmetic as Spark expressions.

Each cleaning rule maps a text column to (new text, detail). The patterns below are fixed values. Java's $ and . also
stop at CR, NEL and the Unicode separators, so (?d) keeps LF as the only line end, and (?U) widens the classes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftstone.functions import markup

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{FFFE}\x{FFFF}]"
QUERY_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
LOOKS_LIKE_HTML = r"<[a-zA-Z/][^>]{0,200}>"
BLOCK_TAG = r"(?i)<(?:p|div|br|li|tr|h[1-6]|blockquote)[^>]*>"
ANY_TAG = r"<[^>]+>"
#: In this order, so that &amp;lt; ends as <.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"))
BOILERPLATE = (
    r"(?mdU)^第\s*\d+\s*页.*$",
    r"(?mdU)^[Pp]age\s+\d+\s*(of\s+\d+)?.*$",
    r"(?mdUi)^.*(?:版权所有|copyright\s+©?|confidential|内部资料|仅供内部).*$",
    r"(?mdU)^[\-=·—\*]{4,}\s*$",
    r"(?mdUi)^(?:打印日期|导出时间|export(?:ed)?\s+(?:on|date)|print(?:ed)?\s+(?:on|date)).*$",
    r"(?mdU)^[\s（(]*(?:以下空白|本页无正文|此页空白)[\s）)]*$",
)
REPEATED = r"([!?~`@#$%^&*_+=|<>])\1{2,}"
DOTS, DASHES = r"[.。]{3,}", r"[-—]{3,}"
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}]"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
#: Operation names, in the order in which the rules run.
OPERATIONS = ("encoding_fix", "control_char_strip", "unicode_norm", "html_strip", "boilerplate_strip", "whitespace_norm", "repeated_punct_fix")


#: White space as (?U)\\s has it.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.btrim(text, F.lit(SPACES + "\x1c\x1d\x1e\x1f"))


def is_blank(text: Column) -> Column:
    """Whether strip() would leave nothing."""
    return ~F.rlike(text, F.lit(r"(?U)[^\s\x1c-\x1f]"))


@F.pandas_udf(StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition. Texts of Latin-1 characters alone are composed already and never reach Python's work."""
    return F.when(F.rlike(text, F.lit(r"[^\x00-\xff]")), _nfc(F.when(F.rlike(text, F.lit(r"[^\x00-\xff]")), text))).otherwise(text)


def half_width(text: Column) -> Column:
    return F.translate(text, WIDE, NARROW)


@dataclass(frozen=True)
class CleaningProfile:
    """Patterns of one business that run before the default boilerplate patterns. repair_encoding undoes wrong decodings, which is a skipped step otherwise; tree_html takes
    the text of pages by a tag state machine, without scripts and styles and with all entities, where the flat patterns leave these."""

    patterns: tuple[str, ...] = ()
    use_defaults: bool = True
    compose: bool = True
    repair_encoding: bool = False
    tree_html: bool = False

    FLAGS = {"IGNORECASE": "i", "MULTILINE": "m", "DOTALL": "s", "VERBOSE": "x", "UNICODE": "U", "ASCII": ""}

    @classmethod
    def from_dict(cls, data: dict) -> CleaningProfile:
        """{"boilerplate_patterns": [{"pattern", "flags": [names]}], "disable_default_boilerplate": bool}; unknown names and bad patterns fail at once."""
        out = []
        for n, entry in enumerate(data.get("boilerplate_patterns", [])):
            entry = {"pattern": entry} if isinstance(entry, str) else entry
            unknown = [f for f in entry.get("flags", ["MULTILINE"]) if f.upper() not in cls.FLAGS]
            if unknown:
                raise ValueError(f"pattern {n}: unknown flags {unknown}")
            letters = "d" + "".join(sorted({cls.FLAGS[f.upper()] for f in entry.get("flags", ["MULTILINE"])} | {"U"} - ({"U"} if "ASCII" in entry.get("flags", []) else set())))
            out.append(f"(?{letters}){entry['pattern']}")
        return cls(tuple(out), not data.get("disable_default_boilerplate", False))


#: What a rule says of the text before and after it, both columns that are there already: a rule's text is computed once.
Detail = Callable[[Column, Column], Column]


def _control(t: Column) -> tuple[Column, Detail]:
    gone = lambda old, new: F.length(old) - F.length(new)
    return F.regexp_replace(t, CONTROL, ""), lambda old, new: F.when(gone(old, new) > 0, F.format_string("removed %d control chars", gone(old, new))).otherwise("")


def _unicode(t: Column, compose: bool) -> tuple[Column, Detail]:
    gone = lambda old, new: F.length(old) - F.length(new)
    return half_width(nfc(t) if compose else t), lambda old, new: F.when(gone(old, new) == 0, "").otherwise(F.format_string("normalised %d chars", gone(old, new)))


def _html(t: Column) -> tuple[Column, Detail]:
    bare = F.regexp_replace(F.regexp_replace(t, BLOCK_TAG, "\n"), ANY_TAG, "")
    for entity, char in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    tagged = lambda x: F.rlike(x, F.lit(LOOKS_LIKE_HTML))
    detail = lambda old, new: F.when(tagged(old), F.format_string("regex stripped HTML; %d chars removed", F.length(old) - F.length(new))).otherwise("no HTML detected")
    return F.when(tagged(t), bare).otherwise(t), detail


def _whitespace(t: Column) -> tuple[Column, Detail]:
    new = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\r\n|\r", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    gone = lambda old, new: F.length(old) - F.length(new)
    return new, lambda old, new: F.when(gone(old, new) == 0, "").otherwise(F.format_string("%d chars normalised", gone(old, new)))


def _punctuation(t: Column) -> tuple[Column, Detail]:
    new = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, REPEATED, "$1"), DOTS, "…"), DASHES, "—")
    n = lambda old: F.regexp_count(old, F.lit(f"{REPEATED}|{DOTS}|{DASHES}"))
    # Each run that goes shortens the text, so runs are counted only in texts that got shorter.
    return new, lambda old, new: F.when(F.length(old) > F.length(new), F.format_string("collapsed %d punct run(s)", n(old))).otherwise("")


def clean(df: DataFrame, text: str = "raw_text", profile: CleaningProfile = CleaningProfile(), out: str = "text") -> DataFrame:
    """df with the cleaned text and `log`, the seven records array<struct<op, chars_before, chars_after, detail>>.

    Each rule adds its text as a column, so later rules and the log read it instead of computing it again. A null text is an empty one.
    """
    steps: list[tuple[str, Callable[[Column], tuple[Column, Detail]] | None]] = list(zip(OPERATIONS, (None, _control, lambda t: _unicode(t, profile.compose), _html, None, _whitespace, _punctuation)))
    df = df.withColumn("_t0", F.coalesce(F.col(text), F.lit("")))
    records = []
    for n, (op, rule) in enumerate(steps):
        old, new = F.col(f"_t{n}"), f"_t{n + 1}"
        if op == "encoding_fix" and profile.repair_encoding:
            df = df.withColumn(f"_t{n}_e", markup.repaired_encoding(old))
            text_, places = F.col(f"_t{n}_e.text"), F.col(f"_t{n}_e.places")
            detail = F.when(places > 0, F.format_string("repaired %d place(s)", places)).otherwise("")
        elif op == "html_strip" and profile.tree_html:
            df = df.withColumn(f"_t{n}_h", F.when(F.rlike(old, F.lit(LOOKS_LIKE_HTML)), markup.html_text(old)))
            text_ = F.coalesce(f"_t{n}_h", old)
            detail = F.when(F.col(f"_t{n}_h").isNotNull(), F.format_string("parsed HTML; %d chars removed", F.length(old) - F.length(text_))).otherwise("no HTML detected")
        elif op == "encoding_fix":
            text_, detail = old, F.lit("ftfy not installed; skipped")
        elif op == "boilerplate_strip":
            patterns = [*profile.patterns, *(BOILERPLATE if profile.use_defaults else ())]
            count = F.lit(0)
            for k, pattern in enumerate(patterns):
                at = old if not k else F.col(f"_t{n}_{k}")
                matches = F.regexp_count(at, F.lit(pattern))
                # The default patterns match no empty text: what they leave as it is has no match to count.
                count = count + (matches if k < len(profile.patterns) else F.when(F.col(f"_t{n}_{k + 1}") == at, 0).otherwise(matches))
                df = df.withColumn(f"_t{n}_{k + 1}", F.regexp_replace(at, pattern, ""))
            text_ = F.col(f"_t{n}_{len(patterns)}") if patterns else old
            detail = F.when(count > 0, F.format_string("removed %d boilerplate match(es)", count)).otherwise("") if patterns else F.lit("no patterns active")
        else:
            text_, of = rule(old)
            detail = of(old, F.col(new))
        df = df.withColumn(new, text_)
        records.append(F.struct(F.lit(op).alias("op"), F.length(old).alias("chars_before"), F.length(new).alias("chars_after"), detail.alias("detail")))
    last = f"_t{len(steps)}"
    df = df.withColumn("log", F.array(*records)).withColumn("original_length", F.length("_t0")).withColumn(out, F.col(last))
    return df.drop(*[c for c in df.columns if c.startswith("_t")])


def chars_removed(log: Column) -> Column:
    return F.aggregate(log, F.lit(0), lambda a, r: a + r["chars_before"] - r["chars_after"])


def any_change(log: Column) -> Column:
    """Whether a rule changed the length; replacements of equal length don't show."""
    return F.exists(log, lambda r: r["chars_before"] != r["chars_after"])


def normalize_query(text: Column, compose: bool = True) -> Column:
    """A query as one line: no control characters, narrow forms, single spaces; blank gives ''."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), QUERY_CONTROL, "")
    t = half_width(nfc(t) if compose else t)
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n+", " "), " +", " "))


def effective_query(rewritten: Column, normalized: Column, used: Column) -> Column:
    return F.when(used & (F.coalesce(F.length(rewritten), F.lit(0)) > 0), rewritten).otherwise(normalized)


# --- tokens: a CJK character counts one, others three to one ------------------------------------------------------


def token_count(text: Column) -> Column:
    # Texts of single bytes have no CJK characters to look for.
    cjk = F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.regexp_count(text, F.lit(CJK)))
    return cjk + F.floor((F.length(text) - cjk + 2) / 3).cast("int")


def fits(text: Column, most: int, reserve: int = 0) -> Column:
    return (token_count(text) <= most - reserve) & F.lit(most - reserve > 0)


def truncate_tokens(text: Column, most: int) -> Column:
    """The longest prefix of at most so many tokens. Without CJK it is 3 characters a token; else the prefix grows while its cost fits."""
    return F.when(token_count(text) <= most, text).when(F.rlike(text, F.lit(CJK)), _mixed_prefix(text, most)).otherwise(F.substring(text, 1, 3 * max(0, most)))


def _mixed_prefix(text: Column, most: int) -> Column:
    # Costs never fall along a text, so the number of fitting prefixes is the length of the longest.
    longest = F.least(F.length(text), F.lit(3 * max(0, most)))
    ends = F.filter(F.sequence(F.lit(0), longest), lambda i: token_count(F.substr(text, F.lit(1), i)) <= most)
    return F.substr(text, F.lit(1), F.coalesce(F.array_max(ends), F.lit(0)))


def token_suffix(text: Column, most: int) -> Column:
    return F.reverse(truncate_tokens(F.reverse(text), most))


def context_prefix(blurb: Column, heading_path: Column, budget: int) -> Column:
    if not budget:
        return F.lit("")
    trail = F.array_join(heading_path, " > ")
    return truncate_tokens(F.coalesce(F.nullif(blurb, F.lit("")), trail, F.lit("")), budget)


def with_prefix(prefix: Column, text: Column) -> Column:
    return F.when(F.length(prefix) > 0, strip(F.concat(prefix, F.lit("\n"), text))).otherwise(text)


def prefix_of(context: Column, text: Column, heading_path: Column) -> Column:
    """What stands before the text in its context; without it the heading trail."""
    at = F.instr(context, text)
    return F.when(at > 1, strip(F.substr(context, F.lit(1), at - 1))).otherwise(F.array_join(heading_path, " > "))


# --- lexical tokens ------------------------------------------------------------------------------------------------


def lexical_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; of CJK runs the overlapping pairs, or the character where it is alone."""
    small = F.lower(F.coalesce(text, F.lit("")))
    runs = lambda t, pattern=r"[\p{L}\p{N}]+": F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    words = runs(F.regexp_replace(small, f"({CJK[:-1]}]+)", " $1 "))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))
    paired = F.flatten(F.transform(words, lambda w: F.when(F.rlike(w, F.lit(f"^{CJK}{{2,}}$")), pairs(w)).otherwise(F.array(w))))
    # Texts of single bytes have neither CJK characters nor other letters and digits than these.
    return F.when(F.octet_length(small) == F.length(small), runs(small, "[a-z0-9]+")).when(F.rlike(small, F.lit(CJK)), paired).otherwise(runs(small))
