"""Canonical identity and content hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.text import _col
from tidemark.functions.values import decimal_text, first_filled

#: Columns of a posting whose raw values are reported as changed fields.
TRACKED = (
    "title",
    "company",
    "location",
    "employment_type",
    "salary_min",
    "salary_max",
    "description",
    "apply_url",
)
KEY = "canonical_job_id"


def digest(parts: Sequence[Column], separator: str = "|") -> Column:
    """sha256 of the parts; nulls count as empty text."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def canonical_id(
    company: Column | str = "company",
    title: Column | str = "title",
    location: Column | str = "location",
    exact: bool = False,
) -> Column:
    """Sixteen hex digits shared by all postings of one job."""
    return _canonical(
        tx.normalize_company(company, exact),
        tx.normalize_title(title, exact),
        tx.normalize_location(location, exact),
    )


def _canonical(company: Column, title: Column, location: Column) -> Column:
    return F.substring(digest([company, title, location]), 1, 16)


def content_hash(exact: bool = False, clean: bool = True) -> Column:
    """Hash of the seven content columns of a posting, as ``name=value`` pairs.

    ``clean=False`` takes text columns that are cleaned already (see ``text.cleaned``).
    """
    return _content(_words(exact, clean), tx.employment_type("employment_type", clean, exact))


#: Text columns of a posting that its hashes normalise.
WORDS = ("title", "company", "location", "description")


def _words(exact: bool, clean: bool = True) -> dict[str, Column]:
    folded = {c: tx.normalize_text(c, exact) if clean else tx.fold_words(F.col(c)) for c in WORDS}
    return {**folded, "title": tx.title_words(folded["title"]), "location": tx.place_words(folded["location"])}


def _content(words: Mapping[str, Column], employment: Column) -> Column:
    absent = F.lit("None")
    values = {
        **words,
        "employment_type": employment,
        "salary_min": F.coalesce(decimal_text("salary_min"), absent),
        "salary_max": F.coalesce(decimal_text("salary_max"), absent),
    }
    return digest([F.concat(F.lit(f"{name}="), values[name]) for name in sorted(values)])


#: Text columns of a posting that the comparison cleans.
COMPARED = ("title", "company", "location", "employment_type", "description")


def comparable(
    patterns: Mapping[str, str] = tx.VOLATILE_PATTERNS, source: Column | str = "source"
) -> dict[str, Column]:
    """The compared text columns before cleaning: descriptions without volatile passages."""
    return {c: F.col(c) for c in COMPARED} | {"description": tx.strip_volatile(source, "description", dict(patterns))}


def comparison_hash(
    exact: bool = False,
    patterns: Mapping[str, str] = tx.VOLATILE_PATTERNS,
    source: Column | str = "source",
    clean: bool = True,
) -> Column:
    """Hash of the eight tracked columns that decides CHANGED or UNCHANGED.

    The URL is folded to words without the markup step, so an ``&`` in a query
    string is never taken for an entity.  ``clean=False`` takes the columns of
    :func:`comparable` cleaned already.
    """
    if not clean:
        return _compared({c: F.col(c) for c in COMPARED})
    texts = comparable(patterns, source)
    if exact:
        return _compared({c: tx.clean_text(v, True) for c, v in texts.items()})
    # One cleaning chain for all columns, its result used by position.
    together = F.transform(F.array(tx.clean_all(list(texts.values()))), lambda a: _compared({c: a[i] for i, c in enumerate(texts)}))
    return F.element_at(together, 1)


def _compared(texts: Mapping[str, Column]) -> Column:
    return digest(
        [
            *[tx.fold_words(texts[c]) for c in ("title", "company", "location", "employment_type")],
            tx.fold_words(F.coalesce(decimal_text("salary_min"), F.lit(""))),
            tx.fold_words(F.coalesce(decimal_text("salary_max"), F.lit(""))),
            tx.fold_words(texts["description"]),
            tx.fold_words(F.coalesce(_col("apply_url"), F.lit(""))),
        ]
    )


def tracked_hash(columns: Sequence[str]) -> Column:
    """Comparison hash of any table: raw values, length-prefixed, nulls kept apart."""

    def part(name: str) -> Column:
        value = F.col(name).cast("string")
        prefixed = F.concat(F.length(value).cast("string"), F.lit(":"), value)
        return F.coalesce(prefixed, F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def external_id() -> Column:
    """Feed id, else URL, else ``company|title|location``."""
    return F.coalesce(
        first_filled("source_id", "apply_url"), F.concat_ws("|", "company", "title", "location")
    )


def storage_id(job_id: Column | str | None = None) -> Column:
    """Key under which a posting is remembered in a saved list: its canonical id, else the
    ``job_id`` of rows that have one, else the URL, else source, title and company."""
    return F.coalesce(
        first_filled(*[KEY, job_id, "apply_url"] if job_id is not None else [KEY, "apply_url"]),
        F.concat_ws(
            ":",
            F.coalesce(first_filled("source"), F.lit("job")),
            F.coalesce(F.col("title"), F.lit("")),
            F.coalesce(F.col("company"), F.lit("")),
        ),
    )


def finalize(jobs: DataFrame, exact: bool = False) -> DataFrame:
    """Normalised employment type plus both derived columns of a posting.

    The text columns of ``jobs`` are expected to be cleaned already.  The second
    cleaning inside the hashes then only meets doubly escaped markup, for which
    the native tier is enough unless it hides a rare entity (``exact=True``).
    """
    names = (*WORDS, "employment_type")
    staged = tx.cleaned(jobs, {f"__{c}": c for c in names}, exact)
    # Both hashes share the normalised words, so they are one projection below.
    folded = {c: tx.fold_words(F.col(f"__{c}")) for c in WORDS}
    words = {**folded, "title": tx.title_words(folded["title"]), "location": tx.place_words(folded["location"])}
    staged = staged.withColumns(
        {
            **{f"__{name}": c for name, c in words.items()},
            "employment_type": tx.employment_type("__employment_type", clean=False),
        }
    )
    shared = {name: F.col(f"__{name}") for name in words}
    derived = staged.withColumns(
        {
            KEY: _canonical(shared["company"], shared["title"], shared["location"]),
            "content_hash": _content(shared, F.col("employment_type")),
        }
    )
    return derived.drop(*[f"__{name}" for name in names])
