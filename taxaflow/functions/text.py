"""Column functions on sequences, quantities, accessions and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a quantity may look like; infinity is one, NaN and negative numbers are not.
QUANTITY = r"(?i)^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$|^[+-]?inf(inity)?$"
NUMERIC = QUANTITY + r"|(?i)^[+-]?nan$"
# Fixed value: the form of a UniProt accession, with an optional isoform.
UNIPROT = r"(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})(?:-\d+)?"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_sequence(text: Column) -> Column:
    """Upper-case letters A-Z only; modifications in digits and signs vanish, their letters stay. '' if none is left."""
    return F.regexp_replace(F.upper(stripped(text)), "[^A-Z]", "")


def outside_alphabet(sequence: Column, alphabet: str) -> Column:
    """The letters of a normalised sequence that are not in the alphabet, sorted."""
    return F.array_sort(F.array_except(F.split(sequence, ""), F.array(*map(F.lit, ["", *alphabet]))))


def is_numeric(text: Column) -> Column:
    return stripped(text).rlike(NUMERIC)


def parse_quantity(text: Column) -> Column:
    """A number that is not negative, or null."""
    value = stripped(text)
    number = F.expr("try_cast(null as double)")
    number = F.when(value.rlike(r"(?i)inf"), F.lit(float("inf"))).otherwise(F.regexp_replace(value, "_", "").try_cast("double"))
    return F.when(value.rlike(QUANTITY) & (~value.startswith("-") | (number == 0)), number)


def accession(subject: Column) -> Column:
    """The accession of a `db|accession|name` id; other ids stay as they are."""
    return F.coalesce(F.nullif(F.regexp_extract(subject, r"^[a-z]{2}\|([A-Za-z0-9_-]+)\|", 1), F.lit("")), subject)


def uniprot_accession(subject: Column) -> Column:
    """The UniProt accession of an sp or tr id, or of a bare accession; null for other ids."""
    piped = F.regexp_extract(subject, rf"(?i)^(?:sp|tr)\|({UNIPROT})\|", 1)
    bare = F.regexp_extract(subject, rf"(?i)^({UNIPROT})$", 1)
    return F.coalesce(F.nullif(piped, F.lit("")), F.nullif(bare, F.lit("")))


def uniprot_url(acc: Column, prefix: str = "https://www.uniprot.org/uniprotkb/") -> Column:
    return F.concat(F.lit(prefix), F.upper(F.element_at(F.split(acc, "-"), 1)))


def ratio(part: Column, total: Column, otherwise=0.0) -> Column:
    """part / total, or `otherwise` if there is no total."""
    return F.when(total > 0, part / total).otherwise(F.lit(otherwise))


def term_label(name: Column, is_obsolete: Column) -> Column:
    return F.coalesce(F.when(is_obsolete, F.concat(F.lit("OBSOLETE: "), name)).otherwise(name), F.lit(""))


def short_label(name: Column) -> Column:
    return F.when(F.length(name) > 40, F.concat(F.substring(name, 1, 37), F.lit("..."))).otherwise(name)


def wrapped(sequence: Column, width: int = 80) -> Column:
    """The sequence in lines of this width."""
    return F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), r"\n$", "")


def upper_letters(text: Column) -> Column:
    """Upper case, a sharp s as one capital letter, not as two that other words have."""
    return F.upper(F.replace(text, F.lit("\u00df"), F.lit("\u1e9e")))
