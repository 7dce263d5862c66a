"""Text cleaning and normalisation as column expressions.

Cleaning has two tiers.  The native tier is a fixed chain of built-in string
functions and stays inside code generation.  The exact tier (``exact=True``)
sends only the rows the native chain cannot settle (broken markup, rare
entities, characters NFKC may alter) to an Arrow UDF; every other row crosses
to Python as a null.
"""

from __future__ import annotations

import functools
import html
import re
import sys
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The UDF below travels with its helpers, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---------------------------------------------------------------- fixed values

#: White space as Python's ``str`` understands it (Java's ``\\s`` is ASCII only).
ASCII_SPACE = r"\t-\r\x1c-\x20"
OTHER_SPACE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

#: Characters beyond ASCII that NFKC leaves alone and that never combine.
NFKC_STABLE = (
    r"\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131"
    r"\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0391-\u03a1\u03a3-\u03c9"
    r"\u0400-\u0481\u048a-\u04ff\u2010\u2012-\u2015\u2018-\u201f\u2022\u20ac"
    r"\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
    r"\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0904-\u0928\u092a-\u0930\u0932\u0935-\u0939\u0e01-\u0e30\uac00-\ud7a3"
    "\U0001f300-\U0001faff"
)

#: Named and numeric references decoded natively; ``&amp;`` must come last.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&#34;", '"'),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&middot;", "·"),
    ("&bull;", "•"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&amp;", "&"),
)

#: Elements whose text is not part of the visible text.
HIDDEN_ELEMENTS = ("script", "style", "template", "rt", "rp")

#: Words that carry no identity in a title.
TITLE_STOP_WORDS = ("a", "an", "the", "and", "for", "of", "in", "on", "to")

#: Old city name -> current city name.
CITY_ALIASES = {
    "bengaluru": "bangalore",
    "bombay": "mumbai",
    "calcutta": "kolkata",
    "madras": "chennai",
}

#: Employment types with the pattern that selects each, tested in this order.
EMPLOYMENT_RULES = (
    ("FULL_TIME", "full ?time"),
    ("PART_TIME", "part ?time"),
    ("CONTRACT", "contract|freelance"),
    ("INTERNSHIP", "intern"),
    ("TEMPORARY", r"temporary|\btemp\b"),
)

EMPLOYMENT_LABELS = {
    "FULL_TIME": "Full Time",
    "PART_TIME": "Part Time",
    "CONTRACT": "Contract",
    "INTERNSHIP": "Internship",
    "TEMPORARY": "Temporary",
    "OTHER": "Other",
}

#: Work modes with the phrases that select each, tested in this order.
WORK_MODE_RULES = (
    ("Remote", ("remote", "work from home", "work-from-home", "fully distributed")),
    ("Hybrid", ("hybrid", "flexible location", "partial remote")),
)

#: Source -> pattern of text that changes on each fetch and must not be compared.
VOLATILE_PATTERNS = {
    "remoteok": (
        r"(?is)\s*Please mention the word\b.*?"
        r"when applying to show you read the job post completely.*$"
    ),
}

# -------------------------------------------------------------------- cleaning

# Every alternative starts at ``<``, so plain characters are passed over quickly.
_MARKUP = (
    r"(?is)<(?:!--.*?-->|!(?!\[|--)[^>]*>|\?[^>]*>|"
    + "|".join(rf"{name}\b[^>]*>.*?</{name}\s*>" for name in HIDDEN_ELEMENTS)
    + r"""|/?[a-z](?>[^>"']+|"[^"]*"|'[^']*')*+>)"""
)
_KNOWN_REFS = "|".join(re.escape(ref[1:-1]) for ref, _ in ENTITIES)
# The large class is looked at for characters beyond ASCII only.
_OTHER_SPACE = rf"[^\x00-\x7f](?<=[{OTHER_SPACE}])"
_UNSTABLE = rf"[^\x00-\x7f](?<=[^{NFKC_STABLE}{OTHER_SPACE}])"
_UNSETTLED = rf"<[a-zA-Z/!?]|&(?!(?:{_KNOWN_REFS});)[a-zA-Z#]|{_UNSTABLE}"


def _is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def _collapse_ascii(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{ASCII_SPACE}]+", " "))


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return _collapse_ascii(F.regexp_replace(c, _OTHER_SPACE, " "))


def _bound(c: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a value that it uses several times but that is computed once."""
    return F.element_at(F.transform(F.array(c), step), 1)


def _closing_only(name: str) -> Callable[[Column], Column]:
    """Renames the openings of a hidden element that no closing tag follows.

    They are ordinary tags then.  Left as they are, each would be searched to the
    end of the text.
    """

    def step(c: Column) -> Column:
        head = F.length(F.regexp_extract(c, rf"(?is)^.*</{name}\s*>", 0))
        rest = F.regexp_replace(F.substring(c, head + 1, F.length(c)), rf"(?i)<{name}\b", "<x")
        return F.when(c.rlike(rf"(?i)<{name}\b"), F.concat(F.substring(c, F.lit(1), head), rest)).otherwise(c)

    return step


def _closed_comments(c: Column) -> Column:
    """Marks comment openings that nothing closes, for the same reason."""
    head = F.length(F.regexp_extract(c, r"(?s)^.*-->", 0))
    rest = F.replace(F.substring(c, head + 1, F.length(c)), _literal("<!--"), _literal("\ue000!--"))
    return F.when(c.contains("<!--"), F.concat(F.substring(c, F.lit(1), head), rest)).otherwise(c)


def _tags_out(c: Column) -> Column:
    """Markup replaced by blanks; behind the last ``>`` there is none to look for."""
    tail = F.substring_index(c, ">", -1)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(tail))
    return F.concat(F.regexp_replace(head, _MARKUP, " "), tail)


def _without_markup(c: Column, exact: bool) -> Column:
    """Tags, comments and hidden elements out, in time linear in the text; null for texts
    with comments or hidden elements where the exact tier takes them."""
    hiding = c.rlike(rf"(?i)<(?:{'|'.join(HIDDEN_ELEMENTS)})\b|<!--")
    if exact:
        return F.when(~hiding, _tags_out(c))
    ready = _bound(c, _closed_comments)
    for name in HIDDEN_ELEMENTS:
        ready = _bound(ready, _closing_only(name))
    closed = F.replace(_bound(ready, _tags_out), _literal("\ue000!--"), _literal("<!--"))
    return F.when(hiding, closed).otherwise(_tags_out(c))


@functools.lru_cache(maxsize=None)
def _literal(value: str) -> Column:
    # Text expressions repeat the same few constants; each costs a round trip.
    return F.lit(value)


def _decoded(c: Column) -> Column:
    for ref, char in ENTITIES:
        c = F.replace(c, _literal(ref), _literal(char))
    return c


class _VisibleText(HTMLParser):
    """Collects visible text nodes, one entry per node."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = [""]
        self.hidden: list[str] = []

    def _break(self) -> None:
        if self.nodes[-1]:
            self.nodes.append("")

    def handle_starttag(self, tag, attrs):
        self._break()
        if tag in HIDDEN_ELEMENTS:
            self.hidden.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._break()

    def handle_endtag(self, tag):
        self._break()
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag):]

    def handle_comment(self, data):
        self._break()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._break()
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])
            self._break()

    def handle_data(self, data):
        if not self.hidden:
            self.nodes[-1] += data


def visible_text(value: str) -> str:
    """The cleaned text of one markup string (the exact tier, per value)."""
    if "<" in value:
        # Nothing behind the last ``>`` is markup; the parser would search it again and again.
        head, end, tail = value.rpartition(">")
        parser = _VisibleText()
        parser.feed(head + end)
        parser.close()
        if not parser.hidden:
            parser.nodes.append(html.unescape(tail))
        value = " ".join(node.strip() for node in parser.nodes if node.strip())
    else:
        value = html.unescape(value)
    return " ".join(unicodedata.normalize("NFKC", value).split())


# A plain series function: Spark sends the columns of a projection across together.
@F.pandas_udf(T.StringType())
def _exact_text(values: pd.Series) -> pd.Series:
    return values.map(visible_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _exact_texts(rows: pd.Series) -> pd.Series:
    return rows.map(lambda row: [None if v is None else visible_text(v) for v in row], na_action="ignore")


def _native(c: Column, exact: bool) -> Column:
    """The native tier: null where the value is, or where the exact tier is needed."""
    plain = ~(c.contains("<") | c.contains("&"))

    def settled(bare: Column) -> Column:
        """Clean text of a value without markup; null where the exact tier is needed."""
        decoded = F.when(bare.contains("&"), collapse_space(_decoded(bare))).otherwise(collapse_space(bare))
        return F.when(~bare.rlike(_UNSETTLED), decoded) if exact else decoded

    return (
        F.when(plain & _is_ascii(c), _collapse_ascii(c))
        .when(plain, F.when(~c.rlike(_UNSTABLE), collapse_space(c)) if exact else collapse_space(c))
        .otherwise(_bound(_without_markup(c, exact), settled))
    )


def clean_text(c: Column | str, exact: bool = False) -> Column:
    """Visible text of a possibly marked-up value; null becomes ``''``."""
    c = _col(c).cast("string")
    native = _native(c, exact)
    if exact:
        native = F.coalesce(native, _exact_text(F.when(native.isNull(), c)))
    return F.coalesce(native, F.lit(""))


def clean_all(columns: Sequence[Column | str]) -> Column:
    """Array of the natively cleaned texts; the chain is written once for all columns."""
    values = F.array(*[_col(c).cast("string") for c in columns])
    return F.transform(values, lambda c: F.coalesce(_native(c, False), F.lit("")))


def cleaned(df: DataFrame, columns: Mapping[str, Column | str] | Sequence[str], exact: bool = False) -> DataFrame:
    """``df`` with the named columns as cleaned texts, each value computed once.

    The native chain is one expression over an array of the values.  With ``exact``
    the values it leaves open cross to the Arrow tier together, and only rows that
    have such a value cross as more than a null.
    """
    named = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    values = F.array(*[_col(c).cast("string") for c in named.values()])
    if not exact:
        staged = df.withColumn("__clean", F.transform(values, lambda c: F.coalesce(_native(c, False), F.lit(""))))
    else:
        native = F.transform(values, lambda c: F.coalesce(_native(c, True), F.when(c.isNull(), F.lit(""))))
        staged = df.withColumn("__raw", values).withColumn("__native", native)
        open_ = F.zip_with("__native", "__raw", lambda n, v: F.when(n.isNull(), v))
        some = F.exists("__native", lambda n: n.isNull())
        staged = staged.withColumn("__exact", _exact_texts(F.when(some, open_)))
        both = F.zip_with("__native", "__exact", lambda n, e: F.coalesce(n, e))
        staged = staged.withColumn("__clean", F.coalesce(both, F.col("__native"))).drop("__raw", "__native", "__exact")
    return staged.withColumns({name: F.col("__clean")[i] for i, name in enumerate(named)}).drop("__clean")


def fold_words(c: Column) -> Column:
    """Lower case, ``&`` spelled out, only letters, digits and ``_ + # .`` kept."""
    spelled = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, r"[^\p{L}\p{N}_+#.]+", " "))


def normalize_text(c: Column | str, exact: bool = False) -> Column:
    """Cleaned text reduced to comparable words."""
    return fold_words(clean_text(c, exact))


def normalize_company(c: Column | str, exact: bool = False) -> Column:
    return normalize_text(c, exact)


def normalize_location(
    c: Column | str, exact: bool = False, aliases: dict[str, str] = CITY_ALIASES
) -> Column:
    """Normalised text with whole-word city aliases replaced."""
    return place_words(normalize_text(c, exact), aliases)


def place_words(words: Column, aliases: dict[str, str] = CITY_ALIASES) -> Column:
    """:func:`normalize_location` of a normalised text."""
    for old, new in aliases.items():
        words = F.regexp_replace(words, rf"(?U)\b{re.escape(old)}\b", new)
    return words


def normalize_title(
    c: Column | str, exact: bool = False, stop_words: tuple[str, ...] = TITLE_STOP_WORDS
) -> Column:
    """Normalised words without stop words, in sorted order, repeats kept."""
    return title_words(normalize_text(c, exact), stop_words)


def title_words(words: Column, stop_words: tuple[str, ...] = TITLE_STOP_WORDS) -> Column:
    """:func:`normalize_title` of a normalised text."""
    kept = F.filter(F.split(words, " "), lambda w: ~w.isin(*stop_words) & (w != ""))
    return F.array_join(F.array_sort(kept), " ")


def employment_type(c: Column | str, clean: bool = True, exact: bool = False) -> Column:
    """One of the fixed employment types; tests run in order, first hit wins."""
    base = clean_text(c, exact) if clean else F.coalesce(_col(c).cast("string"), F.lit(""))
    text = F.regexp_replace(F.translate(F.lower(base), "-_", "  "), f"[{ASCII_SPACE}]+", " ")
    out = F.lit("OTHER")
    for value, pattern in reversed(EMPLOYMENT_RULES):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def employment_label(normalized: Column | str) -> Column:
    """Display label of a normalised employment type, ``Other`` by default."""
    pairs = [F.lit(x) for kv in EMPLOYMENT_LABELS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[_col(normalized)], F.lit("Other"))


def strip_volatile(
    source: Column | str, c: Column | str, patterns: dict[str, str] = VOLATILE_PATTERNS
) -> Column:
    """Text without the per-source passages that change on each fetch."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    out = text
    for name, pattern in patterns.items():
        out = F.when(_col(source) == name, F.regexp_replace(text, pattern, "")).otherwise(out)
    return F.btrim(out, F.lit(SPACE_CHARACTERS))


# --------------------------------------------------------------------- display


def work_mode(location: Column | str, description: Column | str, title: Column | str) -> Column:
    """``Remote``, ``Hybrid`` or ``On-site`` by phrases in the three texts."""
    text = F.lower(_joined(location, description, title))
    out = F.lit("On-site")
    for value, phrases in reversed(WORK_MODE_RULES):
        out = F.when(text.rlike("|".join(phrases)), F.lit(value)).otherwise(out)
    return out


def search_text(*columns: Column | str) -> Column:
    """Lower-case haystack of the non-empty columns, joined by blanks."""
    return F.lower(_joined(*columns))


def slug(c: Column | str, width: int = 32, default: str = "source") -> Column:
    """URL-safe name: trimmed first, then cut, empty becomes ``default``."""
    dashed = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, width)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def preview(c: Column | str, width: int = 240) -> Column:
    """At most ``width`` characters, longer text ends in ``...``."""
    c = _col(c)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def grouped_number(c: Column | str) -> Column:
    """Integer text grouped as 12,34,567; null counts as 0."""
    digits = F.coalesce(_col(c).cast("bigint"), F.lit(0)).cast("string")
    return F.regexp_replace(digits, r"(?<=\d)(?=(?:\d\d)*\d{3}$)", ",")


def salary_text(low: Column | str, high: Column | str) -> Column:
    """``a - b``, ``a+``, ``Up to b`` or ``Salary not specified``."""
    low, high = _col(low), _col(high)
    a, b = _plain_number(low), _plain_number(high)
    return (
        F.when(low.isNull() & high.isNull(), F.lit("Salary not specified"))
        .when(high.isNull(), F.concat(a, F.lit("+")))
        .when(low.isNull(), F.concat(F.lit("Up to "), b))
        .otherwise(F.concat(a, F.lit(" - "), b))
    )


def paragraphs(c: Column | str) -> Column:
    """The parts of a text between runs of newlines."""
    return F.split(_col(c), r"\n+")


def _plain_number(c: Column) -> Column:
    # At most three decimals, no trailing zeros, thousands separated.
    return F.regexp_replace(F.format_number(c.cast("decimal(28,3)"), 3), r"\.?0+$", "")


def _joined(*columns: Column | str) -> Column:
    return F.concat_ws(" ", *[F.nullif(_col(c).cast("string"), F.lit("")) for c in columns])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
