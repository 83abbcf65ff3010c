"""DuckDB spellings of shared expressions, for the oracle statements only."""

from ledgerloom.functions import fixed


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strict(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def norm_company(x: str) -> str:
    out = f"regexp_replace(replace(upper(coalesce({x}, '')), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')"
    for short, spelled in fixed.NAME_ABBREVIATIONS:
        out = rf"regexp_replace({out}, '\b{short}\b', ' {spelled} ', 'g')"
    return squeeze(rf"regexp_replace({out}, '\b({'|'.join(fixed.NAME_FILLER)})\b', ' ', 'g')")


def variants(x: str) -> str:
    expanded = collapsed = squeeze(x)
    for short, phrase in fixed.NAME_ACRONYMS:
        expanded = rf"regexp_replace({expanded}, '(?i)\b{short}\b', '{phrase}', 'g')"
        pattern = phrase.replace(" ", r"\s+")
        collapsed = rf"regexp_replace({collapsed}, '(?i)\b{pattern}\b', '{short}', 'g')"
    return f"[{squeeze(x)}, trim({expanded}), trim({collapsed})]"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def any_word(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"
