"""Cleaning, canonical forms and classification of descriptions, as rules for both dialects.

Each function takes SQL text (mostly a column's name) and gives a rule.  Deep rules are meant for layers: bind an input to a
name first, so that its text is not repeated.
"""

from __future__ import annotations

from . import rules
from .dialect import Dialect, Rule


def clean(x: str) -> Rule:
    """Abbreviations spelled out in their order, white space folded."""

    def sql(d: Dialect) -> str:
        out = x
        for short, long in rules.ABBREVIATIONS:
            out = d.replace(out, rf"\b{short}\b", long)
        return f"trim({d.replace(out, r'\s+', ' ')})"

    return sql


def clean_or_empty(x: str) -> Rule:
    """The variant of matching: null is the empty text."""
    return clean(f"coalesce({x}, '')")


def unit(x: str, default: str | None = None) -> Rule:
    """The common unit; unknown ones in upper case.  ``default`` stands for null and empty ones."""
    u = f"upper(trim({x}))"
    if default is not None:
        u = f"coalesce(nullif({u}, ''), '{default}')"
    return lambda d: d.one_of(u, rules.UNITS, u)


def same_unit_score(a: str, b: str) -> Rule:
    return lambda d: f"CASE WHEN {unit(a)(d)} = {unit(b)(d)} THEN 1.0e0 ELSE 0.4e0 END"


def category(x: str, hint: str | None = None) -> Rule:
    """Head nouns, then a valid hint, then keywords by priority."""

    def sql(d: Dialect) -> str:
        t = f"lower({x})"
        cases = [f"WHEN {d.matches(t, p)} THEN '{c}'" for c, p in rules.HEAD_NOUNS]
        if hint:
            known = ", ".join(f"'{c}'" for c in rules.CATEGORIES)
            cases.append(f"WHEN upper({hint}) IN ({known}) THEN upper({hint})")
        for c, words in rules.KEYWORDS.items():
            cases.append(f"WHEN {d.matches(t, rf'\b(?:{'|'.join(words)})\b')} THEN '{c}'")
        return "CASE " + " ".join(cases) + " ELSE 'OTHER' END"

    return sql


def subtype(x: str, of: str) -> Rule:
    """The first subtype of category ``of`` whose pattern matches."""

    def sql(d: Dialect) -> str:
        t = f"lower({x})"
        per = []
        for c, subs in rules.SUBTYPES.items():
            inner = " ".join(f"WHEN {d.matches(t, p)} THEN '{s}'" for s, p in subs)
            per.append(f"WHEN {of} = '{c}' THEN CASE {inner} END")
        return "CASE " + " ".join(per) + " END"

    return sql


def _inch(d: Dialect, n: str) -> str:
    return d.one_of(n, rules.INCHES)


def _mm(d: Dialect, n: str) -> str:
    return d.one_of(n, {n: f"DN{n}" for n in rules.MILLIMETRES})


def size(x: str) -> Rule:
    """Nominal diameter.  A bare number is read in inches first; what is not known stays as it is, in upper case."""
    number, fraction = r"\d+(?:\.\d+)?", r"\d+(?:[ -]\d+/\d+|\.\d+|/\d+)?"

    def sql(d: Dialect) -> str:
        s = f"upper(trim({x}))"
        nb, mm = (d.extract(s, rf"^({number})\s*{u}$") for u in ("NB", "MM"))
        inch_pattern = rf'^({fraction})\s*(?:"|INCH|IN|INCHES)?$'
        f = f"replace({d.extract(s, inch_pattern)}, ' ', '-')"
        whole = d.extract(f, r"^0*(\d+)(?:\.0+)?$")
        inches = {k: rules.INCHES[k] for k in rules.WHOLE_INCHES}
        return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN {d.matches(s, r'^DN\d+$')} THEN {s}
            WHEN {nb} IS NOT NULL THEN coalesce({_mm(d, nb)}, {_inch(d, nb)}, concat('DN', {nb}))
            WHEN {mm} IS NOT NULL THEN coalesce({_mm(d, mm)}, concat('DN', {mm}))
            WHEN {d.matches(s, inch_pattern)} THEN coalesce({_inch(d, f)}, {_mm(d, f)}, {d.one_of(whole, inches)}, {_mm(d, whole)}, {s})
            ELSE {s} END"""

    return sql


def pressure(x: str) -> Rule:
    """Pressure class: known spellings, then PN ratings, then the first number."""
    def sql(d: Dialect) -> str:
        p = f"upper(trim({x}))"
        folded = f"trim({d.replace(p, r'[#\s.]+', ' ')})"
        pn, n = d.extract(p, r"^PN\s*(\d+)$"), d.extract(p, r"(\d+)")
        return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN NULL ELSE coalesce({d.one_of(p, rules.PRESSURES)}, {d.one_of(folded, rules.PRESSURES)},
            'PN' || {pn}, {d.one_of(n, rules.PRESSURES)}, 'CL' || {n}, {p}) END"""

    return sql


def _number_text(d: Dialect, v: str) -> str:
    return f"CASE WHEN {v} = floor({v}) THEN {d.string(f'cast({v} as bigint)')} ELSE {d.string(v)} END"


def power(x: str) -> Rule:
    """Horse power: kW by the table of standard ratings, else converted to one decimal."""

    def sql(d: Dialect) -> str:
        s = f"upper(trim({x}))"
        kw = f"cast({d.extract(s, r'(\d+(?:\.\d+)?)\s*(?:KW|KILOWATT)')} as double)"
        hp = f"cast({d.extract(s, r'(\d+(?:\.\d+)?)\s*(?:HP|H\.P\.)')} as double)"
        converted = f"round({kw} * {rules.HP_PER_KW}e0, 1)"
        return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN NULL
            WHEN {kw} IS NOT NULL THEN concat({d.one_of(kw, rules.KILOWATTS, _number_text(d, converted), numbers=True)}, ' HP')
            WHEN {hp} IS NOT NULL THEN concat({_number_text(d, hp)}, ' HP') ELSE {s} END"""

    return sql


def material(x: str) -> Rule:
    """``grade|family|base metal``: grades and their names in order, then general words, else the text itself thrice.

    Bind it to a name and take its parts with ``part``, so that the patterns run once.
    """

    def sql(d: Dialect) -> str:
        s, cases = f"upper(trim({x}))", []
        for family, base, grades in rules.MATERIALS:
            for grade, names in grades:
                pattern = r"\b(?:" + "|".join(names).replace(".", r"\.") + r")\b"
                cases.append(f"WHEN {s} = '{grade}' OR {d.matches(s, pattern)} THEN '{grade}|{family}|{base}'")
        for pattern, *names in rules.MATERIAL_WORDS:
            cases.append(f"WHEN {d.matches(s, pattern)} THEN '{'|'.join(names)}'")
        return f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL {' '.join(cases)} ELSE concat({s}, '|', {s}, '|', {s}) END"

    return sql


def part(x: str, i: int) -> Rule:
    """The ``i``-th part, from 1, of a text like that of ``material``."""
    return lambda d: f"split_part({x}, '|', {i})"


def material_grade(x: str) -> Rule:
    return lambda d: f"split_part({material(x)(d)}, '|', 1)"


def material_family(x: str) -> Rule:
    return lambda d: f"split_part({material(x)(d)}, '|', 2)"


def material_status(a: str, b: str, family_a: str, family_b: str) -> Rule:
    """Of canonical grades and their families: EXACT_MATCH, COMPATIBLE_FAMILY, INCOMPATIBLE_FAMILY or UNKNOWN."""
    return lambda d: f"""CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'UNKNOWN' WHEN {a} = {b} THEN 'EXACT_MATCH'
        WHEN {family_a} = {family_b} THEN 'COMPATIBLE_FAMILY' ELSE 'INCOMPATIBLE_FAMILY' END"""


#: Scores of the statuses above.
MATERIAL_SCORES = {"EXACT_MATCH": 1.0, "COMPATIBLE_FAMILY": 0.85, "INCOMPATIBLE_FAMILY": 0.0, "UNKNOWN": 0.5}


def expand_synonyms(x: str) -> Rule:
    """Lower case with synonyms added, one rule after another; null is the empty text."""

    def sql(d: Dialect) -> str:
        out = f"lower(coalesce({x}, ''))"
        for pattern, by in rules.SYNONYMS:
            out = d.replace(out, pattern, by)
        return out

    return sql


def expected_attributes(of: str) -> Rule:
    """How many attributes a category's profile lists."""
    counts = {c: str(sum(map(len, p.values()))) for c, p in rules.PROFILES.items()}
    default = counts.pop("DEFAULT")
    return lambda d: f"cast({d.one_of(of, counts, chr(39) + default + chr(39))} as int)"


def is_critical(attributes: str, of: str) -> Rule:
    """Whether one of ``attributes`` is critical for a category."""
    wanted = set(attributes.split())
    yes = [c for c, p in rules.PROFILES.items() if wanted & set(p["critical"])]
    named = ", ".join(f"'{c}'" for c in yes if c != "DEFAULT") or "''"
    others = ", ".join(f"'{c}'" for c in rules.PROFILES if c != "DEFAULT")
    return lambda d: f"({of} IN ({named})" + (f" OR {of} NOT IN ({others}))" if "DEFAULT" in yes else ")")
