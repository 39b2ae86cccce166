"""Text normalisation, keys and rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All characters that count as white space, for Java regular expressions.
SPACE = r"(?U)[\s\x1c-\x1f]+"

#: Fixed value: what text read in the wrong encoding looks like.
MOJIBAKE = "â€|ðŸ|Ã[^\\n]|Â[^\\n]"

#: The headings that end the part of a description which is scored.
EXCLUDED_HEADINGS = (
    "benefits",
    "benefits and perks",
    "compensation",
    "disclaimer",
    "eeo",
    "equal employment opportunity",
    "equal opportunity",
    "legal",
    "pay range",
    "perks",
    "privacy notice",
    "salary",
)


def squeeze(col: Column) -> Column:
    """White space as single blanks, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), SPACE, " "))


def squeezed(text: str) -> str:
    """As squeeze(), for one text: the same characters are white space for split()."""
    return " ".join(text.split())


def digest(*parts: Column, sep: str = "|") -> Column:
    """SHA-256 of joined parts; a null part makes it null, so that it can't collide."""
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(sep), p)
    return F.sha2(joined, 256)


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding, which lower() isn't (ß)."""
    return s.map(lambda t: None if t is None else t.casefold())


def application_key(company: Column, title: Column, source: Column) -> Column:
    return digest(*(squeeze(F.lower(c)) for c in (company, title, source)))


def role_company_key(company: Column, title: Column) -> Column:
    return digest(*(casefold(squeeze(c)) for c in (company, title)))


def preview_application_key(company: Column, canonical_url: Column, job_url: Column, title: Column, job_id: Column, source: Column) -> Column:
    """The application key of a posting that isn't saved yet: missing parts are filled from its address and id."""
    some = lambda c: F.nullif(c, F.lit(""))
    return application_key(F.coalesce(some(company), some(canonical_url), job_url), F.coalesce(some(title), some(job_id), F.lit("job")), F.coalesce(some(source), F.lit("preview")))


def input_fingerprint(key: Column, resume_hash: Column, description_hash: Column, version: Column, model: Column, revision: Column) -> Column:
    """Identity of what is scored and how; null if any part is, so that it can't collide."""
    return digest(key, resume_hash, description_hash, version, model, revision)


def cache_key(role_key: Column, resume_hash: Column, version: Column, model: Column, revision: Column) -> Column:
    """Identity of a score that applications for one role at one company share."""
    return digest(role_key, resume_hash, version, model, revision)


def band(score: Column) -> Column:
    return F.when(score >= 75, "Strong").when(score >= 55, "Moderate").otherwise("Weak")


#: Fixed value: phrases that open a section when they begin a line.
OPENER = r"(?iuU)(?:^|\n)\s*(?:summary|professional profile|professional summary|career profile)"


def issues(col: Column, openers: bool) -> Column:
    """Codes of what is wrong with a raw text, as an array; `openers` adds more than one section opening in one text."""
    text = F.coalesce(col, F.lit(""))
    found = [
        F.when(F.contains(text, F.lit("\ufffd")), "replacement_character"),
        F.when(F.contains(text, F.lit("\0")), "null_byte"),
        F.when(text.rlike(r"[\p{Cc}&&[^\n\r\t]]"), "control_character"),
        F.when(text.rlike(MOJIBAKE), "possible_mojibake"),
    ]
    if openers:
        found.append(F.when(F.regexp_count(text, F.lit(OPENER)) > 1, "possible_concatenation"))
    return F.array_compact(F.array(*found))


def structured(col: Column) -> Column:
    """One kind of line end, single blanks within lines, at most one empty line in a row, none at the ends."""
    lines = F.split(F.replace(F.replace(F.coalesce(col, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    joined = F.array_join(F.transform(lines, squeeze), "\n")
    return F.btrim(F.regexp_replace(joined, "\n{3,}", "\n\n"), F.lit("\n"))


def heading_key(col: Column) -> Column:
    """A line as a heading is compared: lower case letters, digits, "&" and "/", single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9&/ ]+", ""), " +", " "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` gives for a value that it names several times; the value is worked out once and not wherever it is named."""
    return F.transform(F.array(value), use)[0]


def _spelled(heading: str) -> str:
    """A heading in lower-case text, with characters in between that heading_key() drops."""
    return "[^a-z0-9&/ ]*+ [^a-z0-9&/]*+".join("[^a-z0-9&/ ]*+".join(word) for word in heading.split(" "))


#: A line in lower case whose heading_key() is or begins with an excluded one; told at its beginning, without making the key.
EXCLUDED = rf"^[^a-z0-9&/]*+(?:{'|'.join(map(_spelled, EXCLUDED_HEADINGS))})[^a-z0-9&/ ]*+(?: |\z)"


def scored_part(col: Column) -> Column:
    """A structured text up to the first line that is or begins with an excluded heading."""

    def kept(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda line: F.lower(line).rlike(EXCLUDED)), F.lit(True))
        return once(first, lambda n: F.when(n > 0, F.slice(lines, F.lit(1), (n - 1).cast("int"))).otherwise(lines))

    return F.btrim(F.array_join(once(F.split(structured(col), "\n"), kept), "\n"), F.lit("\n"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def utf16_chunks(s: pd.Series) -> pd.Series:
    """A text in parts of at most 2000 UTF-16 units, no pair of surrogates cut."""

    def cut(text: str | None) -> list[str]:
        out, units, start = [], 0, 0
        for i, c in enumerate(text or ""):
            n = 2 if ord(c) > 0xFFFF else 1
            if units + n > 2000:
                out.append(text[start:i])
                units, start = 0, i
            units += n
        return [*out, text[start:]] if text else []

    return s.map(cut)


def day(col: Column) -> Column:
    """The date that a text begins with, in the strict form YYYY-MM-DD; else null."""
    head = F.left(col, F.lit(10))
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def capped(description: Column, quality: Column, most: int = 50_000) -> tuple[Column, Column]:
    """A description's scored part cut to `most` characters, and its quality: partial if it was cut."""
    whole = scored_part(description)
    cut = lambda t: F.length(t) > most
    body = once(whole, lambda t: F.when(cut(t), F.regexp_replace(F.left(t, F.lit(most)), r"(?U)[\s\x1c-\x1f]+$", "")).otherwise(t))
    return body, F.when(cut(whole), "partial").otherwise(F.coalesce(quality, F.lit("complete")))


def month_bounds(month: Column) -> tuple[Column, Column]:
    """First and last day of a month YYYY-MM; null for anything else."""
    start = F.when(month.rlike(r"^\d{4}-\d{2}$"), F.concat(month, F.lit("-01")).try_cast("date"))
    return start, F.last_day(start)


#: Labels by class, and in the binary form.
CLASSES = {"No Fit": 0, "Potential Fit": 1, "Good Fit": 2}
BINARY = {"No Fit": 0, "Potential Fit": 1, "Good Fit": 1}


def encoded_label(label: Column, binary: bool = False) -> Column:
    """The class of a label; a label that isn't known is an error."""
    known = BINARY if binary else CLASSES
    out = F.raise_error(F.concat(F.lit("a label that is none of the known: "), F.coalesce(label, F.lit("null")))).cast("int")
    for name, value in known.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def unexpected_label(label: Column) -> Column:
    """Whether a label is there but not one of the known ones."""
    return (F.coalesce(label, F.lit("")) != "") & ~label.isin(*CLASSES)


def filler(phrase: str, length: Column) -> Column:
    """A text of exactly `length` characters made of a repeated phrase."""
    return F.substring(F.repeat(F.lit(phrase), F.ceil(length / len(phrase)).cast("int")), F.lit(1), length)


def capacity(quota: Column, seconds: Column) -> Column:
    """Whole runs that a quota of seconds allows; none where a run takes no time or less."""
    return F.when(seconds > 0, F.floor(quota / seconds)).otherwise(F.lit(0)).cast("long")


def retry_delay(attempt: Column, base: float = 5, jitter: float = 0, seed: int = 0) -> Column:
    """Seconds before the next attempt: the base doubled for each attempt after the first, and up to `jitter` more."""
    wait = F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1))
    return wait + F.rand(seed) * jitter if jitter else wait
