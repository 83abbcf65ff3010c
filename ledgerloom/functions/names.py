"""Company and party names: normal forms, acronym variants, distinctive words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.text import squeeze, strip, word_list


def norm_company(
    name: Column,
    abbreviations=fixed.NAME_ABBREVIATIONS,
    filler=fixed.NAME_FILLER,
) -> Column:
    """Upper case, '&' as AND, punctuation as space, abbreviations spelled out, filler dropped."""
    out = F.upper(F.coalesce(name.cast("string"), F.lit("")))
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " ")
    # most texts hold no abbreviation
    held = F.rlike(out, F.lit(rf"\b({'|'.join(short for short, _ in abbreviations)})\b"))
    spelt = out
    for short, spelled in abbreviations:
        spelt = F.regexp_replace(spelt, rf"\b{short}\b", f" {spelled} ")
    return squeeze(F.regexp_replace(F.when(held, spelt).otherwise(out), rf"\b({'|'.join(filler)})\b", " "))


def norm_strict(name: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(name.cast("string"), F.lit(""))), "[^a-z0-9]+", "")


def name_variants(name: Column, acronyms=fixed.NAME_ACRONYMS) -> Column:
    """Sorted distinct spellings: as is, acronyms expanded, phrases collapsed to acronyms."""
    clean = squeeze(F.coalesce(name.cast("string"), F.lit("")))
    expanded, collapsed = clean, clean
    for short, phrase in acronyms:
        expanded = F.regexp_replace(expanded, rf"(?i)\b{short}\b", phrase)
        collapsed = F.regexp_replace(collapsed, r"(?i)\b" + phrase.replace(" ", r"\s+") + r"\b", short)
    forms = F.array(clean, strip(expanded), strip(collapsed))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda v: v != "")))


def norm_client(name: Column) -> Column:
    """Lower case words separated by single spaces."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9\s]", " "))


def client_signature(name: Column, generic=fixed.ROSTER_GENERIC) -> Column:
    """Sorted distinctive words of a client name: no generic words, no numbers."""
    words = F.filter(word_list(norm_client(name)), lambda w: ~F.rlike(w, F.lit(r"^\d+$")))
    return F.array_sort(F.array_except(words, F.array(*[F.lit(g) for g in generic])))


def norm_party(party: Column, suffixes=fixed.PARTY_SUFFIXES) -> Column:
    """Lower case, punctuation as space, corporate suffix words dropped."""
    out = F.regexp_replace(strip(F.lower(F.coalesce(party, F.lit("")))), r"[,.\-_/]+", " ")
    return squeeze(F.regexp_replace(out, rf"\b({'|'.join(suffixes)})\b", " "))


def party_set(parties: Column) -> Column:
    """Sorted distinct normal forms of a party list, blanks dropped."""
    forms = F.transform(F.coalesce(parties, F.array().cast("array<string>")), lambda p: norm_party(p))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda p: p != "")))


def entity_tokens(
    parties: Column,
    filename: Column | None = None,
    vendor: tuple[str, ...] = (),
    generic=fixed.PARTY_GENERIC,
) -> Column:
    """Distinctive client-side words of a contract, from its parties and the filename's first segment.

    `vendor` lists normalised vendor names; a party that equals one, or starts with the
    first word of one, is the vendor's own side and is ignored.
    """
    names = F.coalesce(parties, F.array().cast("array<string>"))
    if filename is not None:
        head = F.split(F.coalesce(filename, F.lit("")), "_")[0]
        names = F.concat(names, F.array(F.regexp_replace(head, r"\.[^.]*$", "")))
    forms = F.transform(names, lambda p: norm_party(p))
    if vendor:
        firsts = sorted({v.split()[0] for v in vendor})
        forms = F.filter(forms, lambda p: ~F.split(p, " ")[0].isin(firsts))
    drop = F.array(*[F.lit(w) for w in (*generic, *vendor)])
    words = F.flatten(F.transform(forms, lambda p: word_list(p)))
    return F.array_sort(F.array_except(words, drop))


def no_shared_entity(a: Column, b: Column) -> Column:
    """True when both token sets are known and have nothing in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
